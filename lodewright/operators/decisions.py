"""Trainability and strategy as rule tables over a table of many profiles: expressions only, nothing comes to the driver.

A profile has row_count, columns (array), format, sample_rows (JSON text of a list of objects, null if none were supplied), missing_fraction,
duplicate_fraction, statistics_basis and shape; absent columns count as null. Rows keep their other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import DOCUMENTS, INSTRUCTION_COLUMNS, REFERENCE_HINTS, SHAPES, TABULAR, TRAINABLE

FIELDS = {"row_count": "long", "columns": "array<string>", "format": "string", "sample_rows": "string", "missing_fraction": "double", "duplicate_fraction": "double", "statistics_basis": "string", "shape": "string"}
ROWS = "array<map<string,variant>>"


def _literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _first(rules: list[tuple[Column, object]], default=None) -> Column:
    """The value of the first rule that holds; a rule that is null does not."""
    out = F.lit(None) if default is None else default if isinstance(default, Column) else F.lit(default)
    for holds, value in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def _text(v: Column) -> Column:
    """Whether a VARIANT is a text that says something."""
    return F.coalesce((F.schema_of_variant(v) == "STRING") & (F.trim(F.try_variant_get(v, "$", "string")) != ""), F.lit(False))


def _prepared(profiles: DataFrame) -> DataFrame:
    for name, kind in FIELDS.items():
        profiles = profiles.withColumn(name, F.col(name).cast(kind) if name in profiles.columns else F.lit(None).cast(kind))
    fraction = lambda c: F.when(F.col(c) >= 0, F.least(F.col(c), F.lit(1.0)))
    lower = F.transform(F.coalesce("columns", F.array().cast("array<string>")), lambda c: F.lower(F.trim(c)))
    rows = F.filter(F.from_json("sample_rows", ROWS), lambda r: r.isNotNull())
    return profiles.withColumns({
        "_n": F.when(F.col("row_count").isNotNull(), F.greatest(F.col("row_count"), F.lit(0).cast("long"))), "_have": F.array_distinct(F.filter(lower, lambda c: c != "")), "_kind": F.nullif(F.ltrim(F.lower(F.trim("format")), F.lit(".")), F.lit("")),
        "_rows": rows, "_missing": fraction("missing_fraction"), "_twice": fraction("duplicate_fraction"), "_shape": F.lower(F.coalesce("shape", F.lit(""))),
    })


def _has(*names: str) -> Column:
    return F.size(F.array_intersect("_have", _literals(names))) == len(set(names))


def _value(row: Column, name: Column | str) -> Column:
    """A row's value under a name in any case."""
    return F.get(F.filter(F.map_entries(row), lambda e: F.lower(e["key"]) == name), F.lit(0))["value"]


def _filled(names: tuple[str, ...], holds=_text) -> Column:
    return F.exists("_rows", lambda r: F.forall(_literals(names), lambda c: holds(_value(r, c))))


def _chat() -> Column:
    """Whether some row's messages have a user's and an assistant's turn that say something; a list, or JSON text of one."""

    def both(r: Column) -> Column:
        given = _value(r, "messages")
        list_ = F.when(F.schema_of_variant(given) == "STRING", F.try_parse_json(F.try_variant_get(given, "$", "string"))).otherwise(given)
        said = F.filter(F.try_variant_get(list_, "$", "array<variant>"), lambda m: _text(F.try_variant_get(m, "$.content", "variant")))
        roles = F.transform(said, lambda m: F.try_variant_get(m, "$.role", "string"))
        return F.coalesce(F.array_contains(roles, "user") & F.array_contains(roles, "assistant"), F.lit(False))

    return F.exists("_rows", both)


def _any(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def _traits(rows: DataFrame) -> DataFrame:
    """Whether the columns name instruction data and the rows hold some, whether it is a reference table, whether a document corpus."""
    named = _any(F.lit(False))
    for names in INSTRUCTION_COLUMNS:
        named = named | _has(*names)
    usable = _first([(_has(*names), F.when(F.col("_rows").isNull(), True).otherwise(_any(_chat() if names == ("messages",) else _filled(names)))) for names in INSTRUCTION_COLUMNS], False)
    hints = F.size(F.array_intersect("_have", _literals(sorted(REFERENCE_HINTS))))
    kinds = lambda v: F.regexp_like(F.coalesce(F.schema_of_variant(v), F.lit("")), F.lit("^(ARRAY|OBJECT)"))
    flat = _any((F.size("_rows") > 0) & F.forall("_rows", lambda r: F.forall(F.map_values(r), lambda v: ~kinds(v))))
    table = (F.size("_have") > 0) & ~named & (hints >= 2) & (_any(F.col("_n") < 100) | (_any(F.col("_kind").isin(*TABULAR)) & (F.size("_have") >= 3) & flat))
    formats = F.transform("_rows", lambda r: F.lower(F.trim(F.try_variant_get(_value(r, "source_format"), "$", "string"))))
    corpus = _any(F.col("_kind").isin(*DOCUMENTS)) | (_has("text") & _any(F.arrays_overlap(formats, _literals(sorted(DOCUMENTS)))))
    return rows.withColumns({"_named": named, "_usable": usable, "_table": table, "_corpus": corpus, "_flat": flat, "_hints": hints})


def inferred(profiles: DataFrame) -> DataFrame:
    """Profiles with ``shape``, from columns, first rows and format; the first rule that holds decides."""
    rows = _traits(_prepared(profiles))
    full = lambda v: F.coalesce(~F.is_variant_null(v) & (F.trim(F.try_variant_get(v, "$", "string")) != ""), F.lit(False)) | F.regexp_like(F.coalesce(F.schema_of_variant(v), F.lit("")), F.lit("^(ARRAY|OBJECT)"))
    rules = [(_has("messages") & _chat(), "sft_messages")]
    for name, names in SHAPES:
        rest = ~_has("output") if "response" in names else F.lit(True)
        rules.append((_has(*names) & rest & _filled(names, full), name))
    rules += [
        (_has("prompt") & (F.size("_have") == 1) & _filled(("prompt",), full), "grpo_prompt_only"),
        (_has("question", "answer"), "qa"),
        (_has("text") & (_any(F.arrays_overlap(F.transform("_rows", lambda r: F.lower(F.try_variant_get(_value(r, "source_format"), "$", "string"))), _literals(sorted(DOCUMENTS)))) | _has("source_file", "chunk_index")), "document_corpus"),
        (_has("label") & (F.size(F.array_intersect("_have", _literals(("text", "sentence", "content")))) > 0), "classification"),
        ((F.size("_have") >= 3) & (F.col("_hints") >= 2) & (F.col("_flat") | _any(F.col("_kind").isin(*TABULAR))), "structured_reference_table"),
    ]
    return rows.withColumn("shape", _first(rules, "unknown")).drop(*(c for c in rows.columns if c.startswith("_")))


def _charges() -> list[tuple[Column, Column]]:
    """(points, reason) of every rule; a rule without points gives no reason."""
    n, missing, twice, kind = F.col("_n"), F.col("_missing"), F.col("_twice"), F.col("_kind")
    size = _first([(n.isNull(), 20), (n == 0, 70), (n < 50, 40), (n < 200, 25), (n < 1000, 10)], 0)
    return [
        (size, F.when(n.isNull(), "row count unknown").otherwise(F.concat(n.cast("string"), F.lit(" rows")))),
        (F.when(F.col("_usable"), 0).otherwise(25), F.when(F.col("_named"), "no usable instruction fields in the rows").otherwise("no instruction fields")),
        (_first([(F.col("_usable") & F.col("_named") & F.col("_rows").isNull(), 25)], 0), F.lit("no rows to confirm the fields")),
        (_first([(F.col("_table"), 30)], 0), F.lit("reference table")),
        (_first([(F.col("_corpus"), 35)], 0), F.lit("document corpus")),
        (_first([(kind.isNotNull() & ~kind.isin(*TRAINABLE), 10)], 0), F.concat(kind, F.lit(" format"))),
        (_first([(missing >= 0.30, 20), (missing >= 0.10, 10)], 0), F.lit("missing cells")),
        (_first([(twice >= 0.25, 15), (twice >= 0.10, 8)], 0), F.lit("duplicate rows")),
    ]


def assessed(profiles: DataFrame) -> DataFrame:
    """Profiles with ``trainability``: score (100 down), recommendation, risk_level and reasons, an estimate from samples named as one."""
    rows = _traits(_prepared(profiles))
    charges = _charges()
    rows = rows.withColumn("_points", F.greatest(F.lit(0), 100 - sum((by for by, _ in charges), F.lit(0))).cast("int"))
    n, points, usable = F.col("_n"), F.col("_points"), F.col("_usable")
    advice = _first([
        ((n == 0) | _any(F.col("_missing") >= 0.40), "data_needed"), (F.col("_corpus"), "rag"), (F.col("_table") & (n < 200), "rag"), (F.col("_table"), "hybrid"),
        (points < 35, "data_needed"), (usable & (points >= 55), "fine_tune"), (usable, "data_needed"), (points >= 50, "hybrid"),
    ], "data_needed")
    rows = rows.withColumn("_advice", advice)
    risk = _first([((F.col("_advice") == "data_needed") | (points < 50), "high"), ((points < 80) | F.col("_advice").isin("rag", "hybrid"), "medium")], "low")
    why = [F.when(by > 0, reason) for by, reason in charges] + [F.when(F.col("statistics_basis") == "sample_rows", "missing and duplicate shares are estimates from sample rows")]
    made = F.struct(points.alias("score"), F.col("_advice").alias("recommendation"), risk.alias("risk_level"), F.array_compact(F.array(*why)).alias("reasons"))
    return rows.withColumn("trainability", made).drop(*(c for c in rows.columns if c.startswith("_")))


#: What is told about a strategy, what to do next, and what an override means.
REASONS = {
    "weak": "the data are too few, too empty or too unclear for any strategy", "corpus": "extracted documents are best looked up", "reference": "small tables of facts should not be trained on blindly", "blocked": "the columns fit a method, the rows do not bear it out",
    "grpo": "prompts alone suit training by reward", "dpo": "preference pairs are there", "tiny": "the shape fits, but so few rows overfit", "sft": "instruction fields are there", "vague": "the shape fits neither training nor retrieval",
}
ACTIONS = {
    "data": ("collect, clean or relabel data", "inspect the dataset again before any training"), "corpus": ("index the chunks before answering", "make evaluation questions that cite the documents"),
    "rag": ("index the rows and answer from them", "make evaluation questions that check the grounding"), "hybrid": ("ground facts by retrieval, train only for what behaviour still lacks", "make evaluation questions that check the grounding"),
    "grpo": ("define the reward before training", "run a small evaluation first"), "dpo": ("use a preference trainer on prompt, chosen and rejected", "evaluate preferences on held-out prompts"), "sft": ("run a small job with held-out evaluation", "watch quality and overfitting"),
}
OVERRIDES = {"data": "more or cleaner data are needed first", "corpus": "documents are safer as retrieval context", "reference": "retrieval is safer than training", "grpo": "a validated reward is needed first", "high": "the dataset is too small or risky to train on unasked"}


def strategies(profiles: DataFrame) -> DataFrame:
    """Profiles with ``strategy``: strategy, method, confidence, risk_level, reasons (its own, then those of ``trainability`` not yet said),
    next_actions, can_train_without_override, requires_override and override_message (empty if none is needed).

    ``trainability`` is assessed where the column is absent."""
    if "trainability" not in profiles.columns:
        profiles = assessed(profiles)
    rows = _traits(_prepared(profiles))
    n, shape, t = F.col("_n"), F.col("_shape"), F.col("trainability")
    score, advice, risk = t["score"], t["recommendation"], t["risk_level"]
    method = _first([
        ((shape == "dpo") | _has("prompt", "chosen", "rejected"), "dpo"), ((shape == "grpo_prompt_only") | (_has("prompt") & (F.size("_have") == 1)), "grpo"),
        (shape.isin("sft_messages", "prompt_completion") | _has("messages") | _has("prompt", "completion") | _has("instruction", "output") | _has("instruction", "response"), "sft"),
    ])
    rows = rows.withColumn("_method", method)
    m = F.col("_method")
    validated = shape.isin("dpo", "grpo_prompt_only", "sft_messages", "prompt_completion")
    unusable = (F.col("_named") & ~F.col("_usable")) | (F.col("_named") & F.col("_usable") & F.col("_rows").isNull())
    blocked = (advice == "data_needed") | ((risk == "high") & (advice != "fine_tune")) | unusable | ((F.size("_rows") == 0) & ~validated)
    case = _first([
        ((n == 0) | _any(F.col("_missing") >= 0.40) | (shape.isin("", "unknown") & (advice == "data_needed") & (risk == "high")), "weak"), (shape == "document_corpus", "corpus"),
        ((shape == "structured_reference_table") | (F.col("_table") & advice.isin("rag", "hybrid")), "reference"), (m.isNotNull() & blocked, "blocked"), (m == "grpo", "grpo"),
        (m.isNotNull() | (advice == "fine_tune"), "train"), (advice.isin("rag", "hybrid"), "advised"),
    ], "vague")
    rows = rows.withColumn("_case", case)
    c, is_ = F.col("_case"), lambda *names: F.col("_case").isin(*names)
    plan = _first([(is_("weak", "blocked", "vague"), "data_needed"), (is_("corpus"), "rag"), (is_("reference"), F.when(n < 200, "rag").otherwise("hybrid")), (is_("grpo", "train"), "fine_tune")], advice)
    rows = rows.withColumn("_plan", plan).withColumn("_use", F.when(is_("grpo"), "grpo").when(is_("train"), F.coalesce(m, F.lit("sft"))))
    own_risk = _first([(is_("weak", "blocked", "vague"), "high"), (is_("corpus"), "medium"), (is_("grpo"), F.when(risk == "high", "high").otherwise("medium")), (is_("train"), F.when(n < 50, "high").otherwise(risk))], F.when(risk == "high", "high").otherwise("medium"))
    rows = rows.withColumn("_risk", own_risk)
    between = lambda low, high: F.round(F.greatest(F.lit(low), F.least(F.lit(high), score / 100)), 2)
    confidence = _first([
        (is_("weak"), 0.90), (is_("blocked"), 0.84), (is_("vague"), 0.80), (is_("corpus"), 0.88), (is_("reference", "advised"), F.when(F.col("_plan") == "rag", 0.86).otherwise(0.78)), (is_("grpo"), between(0.65, 0.82)),
        (F.col("_risk") == "high", 0.42), (n >= 1000, between(0.86, 0.96)),
    ], between(0.65, 0.84))
    high = F.col("_risk") == "high"
    override = ~is_("train") | high
    names = lambda table, key: F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v) if isinstance(v, str) else _literals(v))))[key]
    reason = names(REASONS, F.when(is_("advised"), "reference").when(is_("train"), F.when(F.col("_use") == "dpo", "dpo").when(n < 50, "tiny").otherwise("sft")).otherwise(c))
    action = names(ACTIONS, F.when(is_("weak", "blocked", "vague"), "data").when(is_("corpus"), "corpus").when(is_("grpo", "train"), F.col("_use")).otherwise(F.col("_plan")))
    asks = F.when(is_("train", "grpo") & high, _literals(("ask for an override before this high-risk run",))).otherwise(F.array().cast("array<string>"))
    asks = F.concat(asks, F.when(is_("grpo"), _literals(("ask for an override or validate the reward",))).otherwise(F.array().cast("array<string>")))
    message = names(OVERRIDES, F.when(is_("weak", "blocked", "vague"), "data").when(is_("corpus"), "corpus").when(is_("grpo"), "grpo").when(is_("train"), F.when(high, "high")).otherwise("reference"))
    made = F.struct(
        F.col("_plan").alias("strategy"), F.col("_use").alias("method"), confidence.cast("double").alias("confidence"), F.col("_risk").alias("risk_level"), F.array_distinct(F.concat(F.array(reason), t["reasons"])).alias("reasons"),
        F.concat(action, asks).alias("next_actions"), (~override).alias("can_train_without_override"), override.alias("requires_override"), F.coalesce(message, F.lit("")).alias("override_message"),
    )
    return rows.withColumn("strategy", made).drop(*(x for x in rows.columns if x.startswith("_")))


def profiles(df: DataFrame, by: str) -> DataFrame:
    """A profile of the rows of each value of ``by``, a null one too: (by, row_count, columns, missing_fraction, duplicate_fraction), over the other columns.
    A cell is missing if it is null or blank; copies meet under a 128-bit hash of the row, in a map-side sum."""
    from .profile import _fingerprint, _own, is_missing

    rest = df.select(*(_own(c) for c in df.columns if c != by))
    gaps = sum((F.when(is_missing(_own(f.name)) if f.dataType.typeName() == "string" else _own(f.name).isNull(), 1).otherwise(0) for f in rest.schema), F.lit(0))
    one = df.groupBy(by, _fingerprint(rest).alias("_row")).agg(F.count("*").alias("c"), F.sum(gaps).alias("g"))
    sums = one.groupBy(by).agg(F.sum("c").alias("row_count"), F.count("*").alias("d"), F.sum("g").alias("g"))
    share = lambda a, b: F.round(a / b, 6)
    return sums.select(by, "row_count", _literals(rest.columns).alias("columns"), share(F.col("g"), F.col("row_count") * len(rest.columns)).alias("missing_fraction"), share(F.col("row_count") - F.col("d"), F.col("row_count")).alias("duplicate_fraction"))
