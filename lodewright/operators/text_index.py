"""A text index stored as tables: postings, lengths and counts are written once, and any number of queries is answered by joins on their words.

Words are stemmed by Porter's rules, stop words left out. A row's score for a query is the sum over its words and the fields of weight times
BM25. Postings of words that many rows hold are dealt over several salts, and a query that asks for such a word asks each salt.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words that are not indexed.
STOP = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from", "have", "if", "in", "is", "it", "may", "not", "of", "on", "or", "tbd", "that", "the", "this", "to", "us", "we",
    "when", "will", "with", "yet", "you", "your",
)
#: Weights of a document's fields, and the results of a search that asks for no number of them, and at most.
FIELDS = {"title": 2.0, "content": 1.0}
RESULTS, MOST = 20, 50
#: Postings of one word in one salt, about.
SALTED = 1_000_000
K1, B = 1.2, 0.75

_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel behind a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _closed(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def porter(word: str) -> str:
    """The stem of a word by Porter's algorithm of 1980; words of one or two letters and words with other than a-z stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif m := re.fullmatch("(.+?)(ed|ing)", word):
        base = m[1]
        if "v" in _shape(base):
            if base.endswith(("at", "bl", "iz")) or (_measure(base) == 1 and _closed(base)):
                word = base + "e"
            elif len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c" and base[-1] not in "lsz":
                word = base[:-1]
            else:
                word = base
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if end := max((e for e in table if word.endswith(e)), key=len, default=None):
            if _measure(word[: -len(end)]) > 0:
                word = word[: -len(end)] + table[end]
    if end := max((e for e in _STEP4 if word.endswith(e)), key=len, default=None):
        base = word[: -len(end)]
        if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
            word = base
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _closed(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def _stems(words: Column) -> Column:
    @F.pandas_udf("string")
    def stem(w):
        return w.map({x: porter(x) for x in w.unique()})

    return stem(words)


def _terms(rows: DataFrame, key: list[str], text: Column) -> DataFrame:
    """(key..., term, tf): the stems of a text's words with their numbers; words are counted before any is stemmed."""
    words = rows.select(*key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("word")).where(~F.col("word").isin(*STOP) & (F.length("word") > 1))
    counted = words.groupBy(*key, "word").agg(F.count("*").alias("n"))
    return counted.withColumn("term", _stems(F.col("word"))).groupBy(*key, "term").agg(F.sum("n").alias("tf"))


def build(docs: DataFrame, path: str, key: str = "doc_id", fields: dict[str, float] = FIELDS, salted: int = SALTED) -> None:
    """Write the index of (key, fields...) under ``path``: postings (field, term, salt, key, tf, length), words (field, term, df, salts) and fields
    (field, docs, mean). Null texts are empty; rows of one key are one row with all their words; null keys are left out."""
    from functools import reduce

    known = docs.where(F.col(key).isNotNull())
    each = [_terms(known, [key], F.coalesce(F.col(f).cast("string"), F.lit(""))).select(F.lit(f).alias("field"), F.col(key).alias("key"), "term", "tf") for f in fields]
    reduce(DataFrame.unionByName, each).write.mode("overwrite").parquet(f"{path}/terms")
    spark = docs.sparkSession
    terms = spark.read.parquet(f"{path}/terms")
    lengths = terms.groupBy("field", "key").agg(F.sum("tf").alias("length"))
    total = known.agg(F.count_distinct(key).alias("docs"))
    lengths.groupBy("field").agg(F.sum("length").alias("words")).crossJoin(F.broadcast(total)).select("field", "docs", (F.col("words") / F.col("docs")).alias("mean")).write.mode("overwrite").parquet(f"{path}/fields")
    terms.groupBy("field", "term").agg(F.count("*").alias("df")).withColumn("salts", F.expr(f"1 + df div {salted}")).write.mode("overwrite").parquet(f"{path}/words")
    words = spark.read.parquet(f"{path}/words")
    dealt = terms.join(lengths, ["field", "key"]).join(words.select("field", "term", "salts"), ["field", "term"])
    dealt.select("field", "term", F.pmod(F.xxhash64("key"), "salts").alias("salt"), "key", "tf", "length").write.mode("overwrite").parquet(f"{path}/postings")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int | None = None, fields: dict[str, float] = FIELDS, order: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, key, score) of the first ``k`` rows (RESULTS unless given, MOST at most) of every query (query_id, query), for any of its words;
    ties by key. The texts are not read.

    A query that finds nothing, is null or has no word gets the first rows of ``order`` (key, place) without a score, if that is given. Rows of
    one query id are one query of all their words."""
    if k is not None and k <= 0:
        raise ValueError("k must be greater than zero")
    k = min(k or RESULTS, MOST)
    asked = _terms(queries, ["query_id"], F.coalesce(F.col("query"), F.lit(""))).select("query_id", "term")
    weights = F.create_map(*(x for f, w in fields.items() for x in (F.lit(f), F.lit(w))))
    words = spark.read.parquet(f"{path}/words").where(F.col("field").isin(*fields)).join(spark.read.parquet(f"{path}/fields"), "field")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = asked.join(words, "term").select("query_id", "term", "field", "mean", (weights[F.col("field")] * idf).alias("weight"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    met = wanted.join(spark.read.parquet(f"{path}/postings"), ["field", "term", "salt"])
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = met.groupBy("query_id", "key").agg(F.round(F.sum(part), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    found = scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "key", "score")
    if order is None:
        return found
    first = order.orderBy("place", "key").limit(k).select("key", F.row_number().over(W.orderBy("place", "key")).cast("long").alias("rank"))
    rest = queries.select("query_id").distinct().join(found.select("query_id").distinct(), "query_id", "left_anti")
    # k rows at most on the right
    shown = rest.crossJoin(F.broadcast(first)).select("query_id", "rank", "key", F.lit(None).cast("double").alias("score"))
    return found.unionByName(shown)
