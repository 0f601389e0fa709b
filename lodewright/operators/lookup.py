"""Deterministic lookup over reference tables, token-overlap retrieval and BM25 search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import aliases, is_missing_text, redacted, spaced
from ..sources.sinks import scratch

#: Scores below this answer nothing.
LEAST_SCORE = 40
#: Letters and digits of a key, spaces ignored, by which it meets the questions that hold them.
GRAM = 6


def value_score(question: Column, key: Column) -> Column:
    """How well a key answers a question: 130 + length for an identifier (letters and digits) found whole, else the best of 120 + length for its
    words standing in the question, 110 + length with spaces ignored, and 25 for each shared word; the best over the key's spellings."""
    q = spaced(question)
    words = F.split(q, " ")

    def one(a: Column) -> Column:
        compact = F.regexp_replace(a, " ", "")
        identifier = compact.rlike("[0-9]") & compact.rlike("[a-z]")
        whole, close = F.contains(q, a), F.contains(F.regexp_replace(q, " ", ""), compact)
        shared = F.size(F.array_intersect(words, F.split(a, " ")))
        # an identifier's characters in a row, anything but letters and digits between them, none beside them
        bounded = F.concat(F.lit("(?<![a-z0-9])"), F.regexp_replace(compact, "(.)(?=.)", "$1[^a-z0-9]*"), F.lit("(?![a-z0-9])"))
        found = F.when(F.regexp_like(F.lower(question), bounded), F.length(compact) + 130).otherwise(0)
        return F.when(identifier, found).otherwise(F.greatest(F.when(whole, F.length(a) + 120).otherwise(0), F.when(close, F.length(compact) + 110).otherwise(0), shared * 25))

    return F.coalesce(F.array_max(F.transform(aliases(key), one)), F.lit(0))


def scored(questions: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Pairs of questions (question_id, question) and reference rows (row_index, key...) that score LEAST_SCORE or more.

    Such a pair shares two words with one spelling of the key, or the spelling's letters and digits stand in the question, spaces ignored. So
    the sides meet, at any size in the same way, on words other than a spelling's most frequent one (of two shared words one is another), and on
    the first GRAM characters of a spelling. Every pair that meets is scored once. Blank keys and null questions give no pair."""
    rows = reference.where(~is_missing_text(F.col(key)))
    spelt = rows.select("row_index", F.explode(aliases(F.col(key))).alias("alias"))
    words = spelt.select("row_index", "alias", F.explode(F.array_distinct(F.split("alias", " "))).alias("meet"))
    often = words.groupBy("meet").agg(F.count("*").alias("often"))
    first = F.row_number().over(W.partitionBy("row_index", "alias").orderBy(F.desc("often"), "meet"))
    rare = words.join(often, "meet").withColumn("first", first).where("first > 1").select("row_index", "meet")
    compact = F.regexp_replace("alias", " ", "")
    starts = spelt.select("row_index", F.concat(F.lit(" "), F.left(compact, F.lit(GRAM))).alias("meet"))
    q = spaced(F.col("question"))
    run = F.regexp_replace(q, " ", "")
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - (n - 1), F.lit(1))), lambda i: F.concat(F.lit(" "), F.substr(run, i, F.lit(n))))
    asked = questions.where("question IS NOT NULL").select("question_id", F.explode(F.array_distinct(F.concat(F.split(q, " "), *(grams(n) for n in range(1, GRAM + 1))))).alias("meet"))
    ids = asked.join(rare.union(starts).distinct(), "meet").select("question_id", "row_index").distinct()
    pairs = ids.join(questions, "question_id").join(rows, "row_index")
    return pairs.withColumn("score", value_score(F.col("question"), F.col(key))).where(F.col("score") >= LEAST_SCORE)


#: What a question must hold, in order, and the columns that then answer it, the first that is there.
ANSWER_RULES = (
    (("which form", "what form"), ("form no", "form")),
    (("due date", "deadline", "when"), ("due dates",)),
    (("who", "user categor", "eligible"), ("user categories", "applicability")),
    (("section",), ("applicable sections", "section")),
    (("how often", "frequency", "filed"), ("filing frequency",)),
    (("regime",), ("old/new regime applicability",)),
    (("category", "type of"), ("category",)),
    (("api", "e filing", "mapping"), ("api / e-filing mapping possibilities",)),
    (("used for", "purpose"), ("purpose", "description", "applicability")),
)
#: Columns that can hold keys and answers, in order.
KEY_COLUMNS = ("Form No", "Form", "Category", "Purpose", "Applicable Sections", "Section", "User Categories", "Filing Frequency")
ANSWER_COLUMNS = (
    "Purpose", "Form No", "Due Dates", "Applicable Sections", "User Categories", "Filing Frequency", "Old/New Regime Applicability", "Category",
    "API / E-Filing Mapping Possibilities", "Description", "Limit", "Applicability", "Rate",
)


def answer_column(question: Column, columns: list[str]) -> Column:
    """The column that a question asks for: that of the first rule it meets, null where there is none or the table lacks it."""
    have = {c.lower(): c for c in columns}
    q, out = spaced(question), F.lit(None).cast("string")
    for marks, names in reversed(ANSWER_RULES):
        name = next((have[n] for n in names if n in have), None)
        met = F.contains(q, F.lit(marks[0]))
        for m in marks[1:]:
            met = met | F.contains(q, F.lit(m))
        out = F.when(met, F.lit(name).cast("string")).otherwise(out)
    return out


def _present(names: tuple[str, ...], columns: list[str]) -> list[str]:
    have = {c.lower(): c for c in columns}
    return [have[n.lower()] for n in names if n.lower() in have]


def table_answers(questions: DataFrame, reference: DataFrame) -> DataFrame:
    """(question_id, status, answer, answer_column, reason, rows): each question answered from the table row that fits best.

    The question names the column of the answer; a row's score is its best over the other key columns; ties go to the lowest row_index unless
    their answers differ (no_answer, ambiguous_top_match, with all rows tied). A blank answer is no_answer; no row at LEAST_SCORE, or no
    column, is unsupported. A table without key columns answers nothing. Answers are redacted."""
    keys, targets = _present(KEY_COLUMNS, reference.columns), reference.columns
    asked = questions.select("question_id", "question", answer_column(F.col("question"), targets).alias("answer_column"))
    found = None
    for k in keys:
        own = reference.select("row_index", F.col(f"`{k}`").cast("string").alias("key"))
        hit = scored(questions, own, "key").select("question_id", "row_index", "score", F.lit(k).alias("key_column"))
        found = hit if found is None else found.union(hit)
    if found is None:
        found = questions.where("false").select("question_id", F.lit(0).cast("long").alias("row_index"), F.lit(0).alias("score"), F.lit("").alias("key_column"))
    only = F.lit(len(keys) == 1)
    met = found.join(asked.select("question_id", "answer_column"), "question_id").where(F.col("answer_column").isNotNull() & (only | (F.col("key_column") != F.col("answer_column"))))
    per = met.groupBy("question_id", "answer_column", "row_index").agg(F.max("score").alias("score"))
    top = per.withColumn("place", F.rank().over(W.partitionBy("question_id").orderBy(F.desc("score")))).where("place = 1")
    held = reference.select("row_index", F.map_from_arrays(F.array(*(F.lit(c) for c in targets)), F.array(*(F.col(f"`{c}`").cast("string") for c in targets))).alias("held"))
    value = F.element_at("held", F.col("answer_column"))
    told = top.join(held, "row_index").withColumn("value", F.when(is_missing_text(value), F.lit("Not specified in the source table")).otherwise(redacted(F.trim(value))))
    best = told.groupBy("question_id").agg(F.min_by("value", "row_index").alias("value"), F.count_distinct("value").alias("n"), F.sort_array(F.collect_list("row_index")).alias("rows"))
    out = asked.join(best, "question_id", "left")
    many, blank = F.coalesce(F.col("n") > 1, F.lit(False)), F.col("value") == "Not specified in the source table"
    status = F.when(F.col("n").isNull(), "unsupported").when(many | blank, "no_answer").otherwise("answered")
    answer = F.when(F.col("n").isNull() | many, F.lit("Not specified in the source table")).otherwise(F.col("value"))
    return out.select(
        "question_id", status.alias("status"), answer.alias("answer"), "answer_column", F.when(many, F.lit("ambiguous_top_match")).alias("reason"),
        F.coalesce(F.when(many, F.col("rows")), F.slice("rows", 1, 1)).alias("rows"),
    )


def reference_summary(reference: DataFrame) -> DataFrame:
    """(ready, row_count, key_columns, answer_columns, status): a table answers questions if it has rows, a key and an answer column."""
    keys, targets = (_present(names, reference.columns) for names in (KEY_COLUMNS, ANSWER_COLUMNS))
    listed = lambda names: F.array(*(F.lit(n) for n in names)).cast("array<string>")
    ready = (F.col("row_count") > 0) & F.lit(bool(keys and targets))
    one = reference.agg(F.count("*").alias("row_count"))
    return one.select(ready.alias("ready"), "row_count", listed(keys).alias("key_columns"), listed(targets).alias("answer_columns"), F.when(ready, "ready").otherwise("insufficient_reference_columns").alias("status"))


def answers(questions: DataFrame, reference: DataFrame, key: str, answer: str) -> DataFrame:
    """(question_id, status, answer, score, rows): the best row of each question, ties to the lowest row; ties with different answers are
    ambiguous, blank answers and scores under LEAST_SCORE are no answer, no pair at all is unsupported."""
    best = scored(questions, reference, key).select("question_id", "row_index", F.col(answer).alias("answer"), "score")
    top = best.withColumn("place", F.rank().over(W.partitionBy("question_id").orderBy(F.desc("score")))).where("place = 1")
    per = top.groupBy("question_id").agg(F.min_by(F.col("answer").cast("string"), "row_index").alias("answer"), F.max("score").alias("score"), F.sort_array(F.collect_list("row_index")).alias("rows"), F.count_distinct("answer").alias("n"))
    out = questions.select("question_id").join(per, "question_id", "left")
    status = F.when(F.col("rows").isNull(), "unsupported").when(F.col("n") > 1, "ambiguous").when(is_missing_text(F.col("answer")), "no_answer").otherwise("answered")
    return out.select("question_id", status.alias("status"), F.when(F.col("n") == 1, F.col("answer")).alias("answer"), F.coalesce("score", F.lit(0)).cast("long").alias("score"), F.coalesce(F.when(F.col("n") > 1, F.col("rows")), F.slice("rows", 1, 1)).alias("rows"))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))


#: Words kept out of the join of questions and rows: one bit each of a long.
FREQUENT = 64
#: Sets of frequent words that go to the tasks at once, when rows that share nothing else are sought.
SETS = 50_000


def overlap_top1(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """Of (question_id, question) and (row_id long, text): (question_id, row_id, shared), most shared words, ties to the lowest row.

    Questions and rows meet on their words, but for the FREQUENT words that would join most pairs: each side has those as bits of one number,
    and a met pair adds their overlap. A row that shares frequent words alone never meets, but shares no more than the question has of them;
    only for questions whose best pair has no more than that are the rows' different sets of frequent words gone through, with their lowest row.
    Questions or texts that are null share nothing; a question that shares no word has no row. Rows and questions of one id count apart."""
    asked = questions.select("question_id", F.monotonically_increasing_id().alias("q"), tokens(F.col("question")).alias("words")).where("size(words) > 0")
    held = rows.select(F.col("row_id").cast("long").alias("row_id"), F.monotonically_increasing_id().alias("r"), tokens(F.col("text")).alias("own")).where("size(own) > 0")
    spark = rows.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        """Written once and read again: each text is taken apart once, and pairs are met once."""
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    held, asked = kept(held, "held"), kept(asked, "asked")
    counts = asked.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("asked"))
    often = held.select(F.explode("own").alias("word")).groupBy("word").agg(F.count("*").alias("held")).join(counts, "word")
    hot = [r.word for r in often.orderBy((F.col("asked").cast("double") * F.col("held")).desc(), "word").limit(FREQUENT).collect()]
    frequent = F.array(*(F.lit(w) for w in hot)).cast("array<string>")

    def bits(words: Column) -> Column:
        return F.aggregate(F.array_intersect(words, frequent), F.lit(0).cast("long"), lambda x, w: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position(frequent, w) - 1).cast("int"))))

    ask = asked.select("question_id", "q", bits(F.col("words")).alias("asks"), F.array_except("words", frequent).alias("words"))
    have = held.select("row_id", "r", bits(F.col("own")).alias("has"), F.array_except("own", frequent).alias("own"))
    met = ask.select("question_id", "q", "asks", F.explode("words").alias("word")).join(have.select("row_id", "r", "has", F.explode("own").alias("word")), "word")
    pairs = met.groupBy("question_id", "q", "asks", "row_id", "r", "has").agg(F.count("*").alias("n"))
    wide = lambda x: F.expr(x).cast("decimal(38,0)")
    best = pairs.withColumn("shared", F.col("n") + F.bit_count(F.col("asks").bitwiseAND(F.col("has"))))
    packed = (wide("shared * 18446744073709551616BD") + (wide("9223372036854775807") - wide("row_id"))).cast("decimal(38,0)")
    found = kept(best.select("question_id", "q", packed.alias("x")).groupBy("question_id", "q").agg(F.max("x").alias("x")), "found")
    open_ = ask.join(found.select("q", F.expr("x div 18446744073709551616BD").alias("top")), "q", "left").where("asks <> 0 AND coalesce(top, 0) <= bit_count(asks)")
    sets = open_.select("asks").distinct()
    lowest = have.where("has <> 0").groupBy("has").agg(F.min("row_id").alias("row_id"))
    blocks = -(-sets.count() // SETS)
    for k in range(blocks):
        block = sets.where(F.pmod(F.xxhash64("asks"), F.lit(blocks)) == k).agg(F.collect_list("asks").alias("b")).scalar()
        each = lowest.select("row_id", "has", F.explode(block).alias("asks")).withColumn("shared", F.bit_count(F.col("asks").bitwiseAND(F.col("has")))).where("shared > 0")
        of = each.select("asks", packed.alias("x")).groupBy("asks").agg(F.max("x").alias("x"))
        found = found.union(open_.join(of, "asks").select("question_id", "q", "x"))
    rest = F.expr("x % 18446744073709551616BD")
    top = found.groupBy("question_id").agg(F.max("x").alias("x"))
    return top.select("question_id", (wide("9223372036854775807") - rest).cast("long").alias("row_id"), F.expr("x div 18446744073709551616BD").cast("long").alias("shared"))


def _times(word: str, words: str = "w") -> Column:
    return F.size(F.filter(words, lambda x: x == word))


def bm25(docs: DataFrame, query: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score): top ``k`` of (doc_id, text) for any word of the query. Two passes over the text, one for its statistics and
    one for its hits; only rows with a query word leave the scan."""
    words = sorted(set(query.lower().split()))
    split = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))
    base = docs.select("doc_id", split.alias("w")).select("doc_id", F.size("w").alias("n"), *[_times(q).alias(f"t{i}") for i, q in enumerate(words)])
    s = base.agg(F.count("*").alias("docs"), F.avg("n").alias("avg"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(words))])
    one = base.join(F.broadcast(s))
    idf = lambda i: F.log(1 + (F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
    part = lambda i: idf(i) * F.col(f"t{i}") * (k1 + 1) / (F.col(f"t{i}") + k1 * (1 - b + b * F.col("n") / F.col("avg")))
    hit = F.greatest(*[F.col(f"t{i}") for i in range(len(words))], F.lit(0)) > 0
    return one.where(hit).select("doc_id", F.round(sum((part(i) for i in range(len(words))), F.lit(0.0)), 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


#: Endings that ``stem`` takes off, the first that matches, and what stands in their place.
STEM_RULES = ((r"^(.{2,}ss)es$", "$1"), (r"^(.{3,})ies$", "$1y"), (r"^(.{4,})ing$", "$1"), (r"^(.{4,})ed$", "$1"), (r"^(.{2,}(?:x|ch|sh|z))es$", "$1"), (r"^(.{3,}[^su])s$", "$1"))


def stem(word: Column) -> Column:
    """A word without a common English ending, if four letters or more stay: sses to ss, ies to y, ing, ed, es after a hiss, and a plural s."""
    out = word
    for pattern, to in reversed(STEM_RULES):
        out = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, to)).otherwise(out)
    return out


#: Weights of the fields of an endpoint in a search.
ENDPOINT_FIELDS = {"summary": 3.0, "operation_id": 2.0, "description": 1.0, "tags": 1.5, "param_names": 1.0}


def field_search(rows: DataFrame, fields: dict[str, float], query: str, k: int = 20, where: Column | None = None, order: tuple[str, ...] = ("path", "method"), k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The first ``k`` rows, all columns and ``score``, by the weighted sum of each field's BM25 over stemmed words, for any word of the query;
    ties by ``order``. Rows that ``where`` does not admit count in the statistics but never take a place: the filter comes before the limit.
    Null fields are empty. A query without a word finds nothing."""
    asked = sorted(set(_query_words(query)))
    if not asked:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    names = list(fields)
    words = {f: F.transform(F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), stem) for f in names}
    split = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), *(words[f].alias(f"w{i}") for i, f in enumerate(names)))
    counts = [_times(q, f"w{i}").alias(f"t{i}_{j}") for i in range(len(names)) for j, q in enumerate(asked)]
    base = split.select("row", *(F.size(f"w{i}").alias(f"n{i}") for i in range(len(names))), *counts)
    met = [(i, j) for i in range(len(names)) for j in range(len(asked))]
    stats = base.agg(F.count("*").alias("docs"), *(F.avg(f"n{i}").alias(f"mean{i}") for i in range(len(names))), *(F.count_if(F.col(f"t{i}_{j}") > 0).alias(f"d{i}_{j}") for i, j in met))
    hit = F.greatest(*(F.col(f"t{i}_{j}") for i, j in met), F.lit(0)) > 0

    def part(i: int, j: int) -> Column:
        t, d = F.col(f"t{i}_{j}"), F.col(f"d{i}_{j}")
        idf = F.log(1 + (F.col("docs") - d + 0.5) / (d + 0.5))
        return F.when(t > 0, F.lit(fields[names[i]]) * idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col(f"n{i}") / F.col(f"mean{i}")))).otherwise(0.0)

    scored_rows = base.where(hit).join(F.broadcast(stats)).select("row.*", F.round(sum((part(i, j) for i, j in met), F.lit(0.0)), 2).alias("score"))
    admitted = scored_rows if where is None else scored_rows.where(where)
    return admitted.orderBy(F.desc("score"), *order).limit(k)


def _query_words(query: str) -> list[str]:
    """The stemmed words of one query, by the rules of ``stem``."""
    import re

    def one(word: str) -> str:
        for pattern, to in STEM_RULES:
            if m := re.match(pattern, word):
                return m[1] + to[2:]
        return word

    return [one(w) for w in re.findall("[a-z0-9]+", query.lower())]


def tagged(tag: str | None, tags: str = "tags") -> Column | None:
    """Rows whose joined tags hold ``tag`` as a part; no filter for no tag."""
    return F.contains(F.coalesce(F.col(tags), F.lit("")), F.lit(tag)) if tag else None
