"""Evaluation cases from rows, and scores of captured outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SENTINEL, content_tokens, fact_present, is_missing_text, or_sentinel, plain, truncated

CASES = 25
STATUSES = ("passed", "failed", "needs_rag", "needs_more_data")


def prompt_cases(rows: DataFrame, prompt: str, answer: str, task: str = "sft_reference_eval", limit: int = CASES) -> DataFrame:
    """(case_id, question, expected): one case for each of the first ``limit`` rows, by row_index, that have both."""
    usable = rows.where(~is_missing_text(F.col(prompt)) & ~is_missing_text(F.col(answer)))
    return usable.orderBy("row_index").limit(limit).select(F.concat_ws(":", F.lit(task), "row_index", F.lit("prompt_completion")).alias("case_id"), truncated(F.trim(prompt), 240).alias("question"), truncated(F.trim(answer), 240).alias("expected"))


def message_cases(rows: DataFrame, messages: str = "messages", task: str = "sft_reference_eval", limit: int = CASES) -> DataFrame:
    """(case_id, question, expected): one case for each of the first ``limit`` rows, by row_index, whose messages hold an answered question.

    Turns of other roles than system, user and assistant and blank ones do not count. The answer is the last assistant's turn that any
    user's precedes, the question the last user's turn before it; null and empty arrays have no case."""
    said = F.transform(F.filter(messages, lambda m: m["role"].isin("system", "user", "assistant") & ~is_missing_text(m["content"])), lambda m: F.struct(m["role"].alias("role"), F.trim(m["content"]).alias("content")))
    places = lambda role: F.filter(F.transform("m", lambda m, i: F.when(m["role"] == role, i)), lambda i: i.isNotNull())
    each = rows.select("row_index", said.alias("m")).withColumns({"asked": places("user"), "told": places("assistant")})
    answer = F.array_max(F.filter("told", lambda i: i > F.array_min("asked")))
    pair = each.withColumn("a", answer).where("a IS NOT NULL").withColumn("q", F.array_max(F.filter("asked", lambda i: i < F.col("a"))))
    text = lambda at: truncated(F.get("m", F.col(at))["content"], 240)
    return pair.orderBy("row_index").limit(limit).select(F.concat_ws(":", F.lit(task), "row_index", F.lit("messages")).alias("case_id"), text("q").alias("question"), text("a").alias("expected"))


#: Columns of rows that hold a prompt, and its answer, first match first.
PROMPTS, COMPLETIONS = ("prompt", "instruction"), ("completion", "output", "response")


def sft_task(source: dict | None) -> str:
    """The task of cases from prompts: held out only if the source's split, name, path or the like says so."""
    held = {"eval", "evaluation", "validation", "valid", "test", "holdout"}
    for key in ("split", "source", "path", "name"):
        value = str((source or {}).get(key) or "").lower().replace("\\", "/")
        if any(held & set(value.split(mark)) for mark in "/_-. "):
            return "sft_holdout"
    return "sft_reference_eval"


def domain_of(columns: list[str], source: dict | None = None) -> str | None:
    """income_tax where the columns or the source speak of it, else none."""
    import json

    told = json.dumps(source or {}, sort_keys=True).lower()
    return "income_tax" if {"form no", "old/new regime applicability"} & {c.lower() for c in columns} or "tax" in told else None


def golden_cases(rows: DataFrame, limit: int = CASES, source: dict | None = None) -> DataFrame:
    """(case_id, question, expected) by the kind of table: messages, prompts with answers, else a reference table. Names of message and prompt
    columns are matched in any case, those of reference tables as they are. A table of none of these kinds has no case."""
    have = {c.lower(): c for c in rows.columns}
    prompt, answer = (next((have[n] for n in names if n in have), None) for names in (PROMPTS, COMPLETIONS))
    if "messages" in have:
        return message_cases(rows, have["messages"], sft_task(source), limit=limit)
    if prompt and answer:
        return prompt_cases(rows, prompt, answer, sft_task(source), limit=limit)
    return reference_cases(rows, limit, source).select("case_id", "question", "expected")


#: Columns of a table of forms, and of other reference tables their keys and answers, first match first.
FORM, PURPOSE, DUE, REGIME = "Form No", "Purpose", "Due Dates", "Old/New Regime Applicability"
KEYS, ANSWERS = ("Section", "Category", "Rule", "Code", "Name"), ("Description", "Purpose", "Limit", "Applicability", "Rule", "Rate")


def reference_cases(rows: DataFrame, limit: int = CASES, source: dict | None = None) -> DataFrame:
    """(case_id, question, expected, metadata, domain): the first ``limit`` cases, by row_index and kind, of a reference table.

    A table of forms with purposes asks for a form's purpose, for a purpose's form, and for due dates and regime where it has such columns, a
    missing one being expected as such. Any other table asks for the first answer column by the first key column; one without both has no case.
    Rows without a key give none. ``metadata`` is JSON: row, source, columns used and their values."""
    import json

    at = lambda c: F.col(f"`{c}`")
    given = lambda c: F.when(~is_missing_text(at(c)), truncated(F.trim(at(c).cast("string")), 240))
    made: list[tuple[str, str, str, str, Column, Column]] = []  # kind, question, asked, answered, key, expected
    if FORM in rows.columns and PURPOSE in rows.columns:
        made += [("purpose", "What is %s used for?", FORM, PURPOSE, given(FORM), given(PURPOSE)), ("reverse_lookup", "Which form is used for %s?", PURPOSE, FORM, given(PURPOSE), given(FORM))]
        made += [(kind, text, FORM, c, given(FORM), truncated(or_sentinel(at(c)), 240)) for kind, text, c in (("due_date", "What due date is listed for %s?", DUE), ("regime", "What regime applicability is listed for %s?", REGIME)) if c in rows.columns]
    else:
        key = next((k for k in KEYS if k in rows.columns), None)
        answer = next((a for a in ANSWERS if a in rows.columns and a != key), None)
        if key and answer:
            made.append(("lookup", f"What {answer.lower()} is listed for %s?", key, answer, given(key), given(answer)))
    empty = F.array().cast("array<struct<k:int,kind:string,question:string,expected:string,metadata:string>>")
    cases = [
        F.struct(
            F.lit(i).alias("k"), F.lit(kind).alias("kind"), truncated(F.format_string(text, key), 240).alias("question"), expected.alias("expected"),
            F.to_json(F.struct(F.col("row_index"), F.lit(json.dumps(source or {})).alias("source"), F.array(F.lit(asked), F.lit(told)).alias("columns_used"), F.create_map(F.lit(asked), key, F.lit(told), expected).alias("source_fields"))).alias("metadata"),
        )
        for i, (kind, text, asked, told, key, expected) in enumerate(made)
    ]
    keyed = [F.when(key.isNotNull() & expected.isNotNull(), c) for c, (*_, key, expected) in zip(cases, made)]
    each = rows.select("row_index", F.explode(F.array_compact(F.array(*keyed)) if keyed else empty).alias("c"))
    task = F.lit("structured_reference_qa")
    return each.orderBy("row_index", "c.k").limit(limit).select(F.concat_ws(":", task, "row_index", "c.kind").alias("case_id"), "c.question", "c.expected", "c.metadata", F.lit(domain_of(rows.columns, source)).alias("domain"))


#: Marks of an output that asks for sources instead of answering.
ASKS = (
    "need retrieval", "need rag", "need context", "need source", "needs retrieval", "needs context", "needs source", "not enough context", "without context", "cannot answer", "can't answer",
    "do not know", "don't know",
)


def score_outputs(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Cases (case_id, question, expected, and metadata and domain if there) left-joined to outputs (case_id, output): (case_id, status, score,
    missing_facts, topics, claims, reasons).

    Without an output a case needs more data; if the expected fact is missing and the output asks for sources, retrieval. It fails if the fact is
    missing, if it speaks of other subjects than income tax in a case about that, or if a sentence has two content words or more that
    neither question, answer nor metadata have (``claims`` names the first four); else it passes. A case that expects nothing expects the
    mark of an empty field. Several outputs of a case are rated each."""
    from .listings import other_topics

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in cases.columns else F.lit("")
    o = F.trim(F.coalesce(F.col("output"), F.lit("")))
    fact = F.when(F.trim(text("expected")) == "", F.lit(SENTINEL)).otherwise(F.trim(text("expected")))
    known = F.concat_ws(" ", text("question"), text("expected"), text("metadata"))
    rated = cases.join(outputs, "case_id", "left").select("case_id", o.alias("o"), fact.alias("fact"), known.alias("known"), text("domain").alias("domain"))
    rated = rated.withColumns({"present": fact_present(F.col("fact"), F.col("o")), "supported": content_tokens(F.col("known")), "topics": other_topics(F.col("domain"), F.col("known"), F.col("o"))})
    new = F.transform(F.split("o", r"(?<=[.!?])\s+"), lambda s: F.array_sort(F.array_except(content_tokens(s), F.col("supported"))))
    claims = F.transform(F.filter(new, lambda w: F.size(w) >= 2), lambda w: F.array_join(F.slice(w, 1, 4), " "))
    asks = F.lit(False)
    for mark in ASKS:
        asks = asks | F.contains(plain(F.col("o")), F.lit(mark))
    none = F.array().cast("array<string>")
    rated = rated.withColumn("claims", claims)
    status = F.when(F.col("o") == "", "needs_more_data").when(~F.col("present") & asks, "needs_rag").when(~F.col("present") | (F.size("topics") > 0) | (F.size("claims") > 0), "failed").otherwise("passed")
    rated = rated.withColumn("status", status)
    failed = F.col("status") == "failed"
    missing = F.when((F.col("o") != "") & ~F.col("present"), F.array("fact")).otherwise(none)
    listed = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, ", ")))
    reasons = (
        F.when(F.col("status") == "needs_more_data", F.array(F.lit("no output was given"))).when(F.col("status") == "needs_rag", F.array(F.lit("the output asks for sources instead of answering")))
        .when(failed, F.array_compact(F.array(listed("missing expected facts: ", missing), listed("off-topic: ", F.col("topics")), listed("unsupported claims: ", F.col("claims"))))).otherwise(F.array(F.lit("all expected facts are there")))
    )
    return rated.select(
        "case_id", "status", F.when(F.col("present") & F.col("status").isin("passed", "failed"), 1.0).otherwise(0.0).alias("score"), missing.alias("missing_facts"),
        F.when(failed, F.col("topics")).otherwise(none).alias("topics"), F.when(failed, F.col("claims")).otherwise(none).alias("claims"), reasons.alias("reasons"),
    )


def _overall(cases: Column, count) -> Column:
    """failed before all others, then passed if all did, then what is needed; without cases, more data."""
    return F.when(cases == 0, "needs_more_data").when(count("failed") > 0, "failed").when(count("passed") == cases, "passed").when(count("needs_more_data") > 0, "needs_more_data").otherwise("needs_rag")


def status_counts(rated: DataFrame) -> DataFrame:
    """One row: cases, the count of each status, and the overall status by precedence."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return rated.agg(F.count("*").alias("cases"), *counts).withColumn("overall", _overall(F.col("cases"), F.col))


def eval_summary(rated: DataFrame, report: DataFrame | None = None, most: int = 3) -> DataFrame:
    """One row: status, valid, the counts, and the first ``most`` different reasons by case. A ``report`` (one row as of ``status_counts``) is
    valid if it says what the cases say; the status of one that is not is unverified."""
    own = status_counts(rated)
    first = rated.select(F.explode("reasons").alias("reason"), "case_id").where("reason <> ''").groupBy("reason").agg(F.min("case_id").alias("at")).orderBy("at", "reason").limit(most)
    reasons = first.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "reason"))), lambda x: x["reason"]).alias("r")).scalar()
    names = ("cases", *STATUSES, "overall")
    told = (report if report is not None else own).select(*(F.col(n).alias(f"_{n}") for n in names))
    both = own.join(F.broadcast(told.limit(1)))
    valid = F.lit(True)
    for n in names:
        valid = valid & F.col(n).eqNullSafe(F.col(f"_{n}"))
    return both.select(F.when(valid, F.col("overall")).otherwise("unverified").alias("status"), valid.alias("valid"), "cases", *STATUSES, reasons.alias("top_reasons"))


def examples(records: DataFrame, key: str, templates: dict[str, tuple[str, str]], system: str) -> DataFrame:
    """Flat-map of reference rows to training messages: one row per template kind (question with the key, answer column)."""
    made = [
        F.struct(F.lit(kind).alias("qa_type"), F.array(
            F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), F.format_string(q, F.col(key)).alias("content")),
            F.struct(F.lit("assistant").alias("role"), or_sentinel(F.col(c)).alias("content")),
        ).alias("messages"))
        for kind, (q, c) in templates.items()
    ]
    return records.select("row_index", F.posexplode(F.array(*made)).alias("pos", "e")).select("row_index", "pos", "e.*")


#: Columns of a table of forms under the names the templates use, and the templates: kind, question, answer.
FORM_FIELDS = {"form": "Form No", "category": "Category", "purpose": "Purpose", "sections": "Applicable Sections", "filing": "Filing Frequency", "due": "Due Dates", "users": "User Categories", "regime": "Old/New Regime Applicability", "mapping": "API / E-Filing Mapping Possibilities"}
FORM_EXAMPLES = (
    ("purpose", "What is {form} used for?", "{form} is used for {purpose}."),
    ("applicability", "Who should use {form}, and which section applies?", "{form} applies to {users}. The applicable section is {sections}."),
    ("filing_timeline", "How often is {form} filed and what is its due date?", "{form} has {filing} filing frequency. The due date is {due}."),
    ("regime", "Is {form} applicable under the old regime, new regime, or both?", "For {form}, old/new regime applicability is {regime}."),
    ("efiling_mapping", "What e-filing or API mapping is listed for {form}?", "The listed e-filing/API mapping for {form} is {mapping}."),
    ("summary", "Summarize the Income Tax Master entry for {form}.", "{form} is a {category} form used for {purpose}. It applies to {users}, references {sections}, is filed {filing}, has due date {due}, regime applicability {regime}, and maps to {mapping}."),
)


def form_examples(rows: DataFrame, system: str) -> DataFrame:
    """Six training examples of each row of a table of forms: (row_index, qa_type, messages, form, category), in the order of the templates. Missing
    columns and blank values are said to be not specified."""
    import re

    value = {k: or_sentinel(F.col(f"`{c}`")) if c in rows.columns else F.lit(SENTINEL) for k, c in FORM_FIELDS.items()}

    def filled(template: str) -> Column:
        parts = re.split(r"\{(\w+)\}", template)
        return F.concat(*(value[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)))

    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    made = [F.struct(F.lit(kind).alias("qa_type"), F.array(turn("system", F.lit(system)), turn("user", filled(q)), turn("assistant", filled(a))).alias("messages")) for kind, q, a in FORM_EXAMPLES]
    each = rows.select("row_index", value["form"].alias("form"), value["category"].alias("category"), F.posexplode(F.array(*made)).alias("pos", "e"))
    return each.select("row_index", "pos", "e.*", "form", "category")


def formatted(rows: DataFrame, prompts: tuple[str, ...], answers: tuple[str, ...]) -> DataFrame:
    """``### User / ### Assistant`` text from the first non-empty of the prompt and of the answer columns."""
    first = lambda names: F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in names if c in rows.columns), F.lit(""))
    return rows.withColumn("formatted", F.concat(F.lit("### User\n"), first(prompts), F.lit("\n\n### Assistant\n"), first(answers)))
