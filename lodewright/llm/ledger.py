"""Rule bitmask ledger: every quality rule is evaluated once, policies are applied later as bit masks.

``ledger`` gives one row per document: measurements and ``fail_bits``, bit k set if rule k fails. A policy is a named, versioned set of
rules; applying one, or finding what each of its rules removes alone, is bitwise arithmetic on the ledger and never reads a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import lean, ship
from ._words import SPACE, hashes, per_row, pieces, row_of, split

#: What is measured in a text, whole numbers all.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_stutter",
)
#: Rules in bit order: name and when it fails, as SQL over the measures (whole-number arithmetic, so engines agree).
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "n_symbols > 3 AND 100 * n_symbols > 10 * n_words"),
    ("repeated_lines", "n_dup_lines > 2 AND 100 * n_dup_lines > 40 * n_lines"),
    ("shouting", "n_upper > 20 AND 100 * n_upper > 25 * word_chars"),
    ("marks", "n_marks > 5 AND 100 * n_marks > 15 * n_words"),
    ("stutter", "n_stutter > 3 AND 100 * n_stutter > 20 * n_words"),
    ("short_words", "n_words >= 20 AND word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("no_words", "n_words = 0"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Versions are never edited; a change is a new version.
POLICIES = {
    "base/1": ("few_words", "repeated_windows"),
    "web/1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "shouting", "stutter", "no_words"),
    "web/2": tuple(BIT),
}
_SYMBOL, _UPPER, _MARK, _LINE = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_MARK[list(b"!?")] = True
_LINE[10] = True


def _repeats(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements equal to another of their row, and elements equal to an earlier one of their row."""
    salted = key ^ (row.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(salted, kind="stable")
    same = salted[order[1:]] == salted[order[:-1]]
    any_, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


def measure(column: pa.Array) -> np.ndarray:
    """One row of MEASURES for each text."""
    out = np.zeros((len(column), len(MEASURES)), np.int64)
    for a, b, raw, off in pieces(column):
        starts, ends, woff = split(raw, off)
        row, h = row_of(woff), hashes(raw, starts, ends)
        ls, le, loff = split(raw, off, _LINE)
        worded = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
        lrow = row_of(loff)[worded]
        later = _repeats(hashes(raw, ls, le)[worded], lrow)[1] if len(ls) else np.zeros(0, bool)
        covered, stutter = np.zeros(len(h), bool), np.zeros(len(h), bool)
        if len(h) > 1:
            stutter[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        if len(h) > 2:
            inside = np.flatnonzero(row[:-2] == row[2:])
            c = np.uint64(0x9E3779B97F4A7C15)
            three = (h[inside] * c + h[inside + 1]) * c + h[inside + 2]
            three ^= three >> np.uint64(32)
            again = inside[_repeats(three * c, row[inside])[0]]
            for k in range(3):
                covered[again + k] = True
        x = out[a:b]
        for k, v in enumerate((
            np.diff(woff), per_row(~SPACE[raw] & ((raw & 0xC0) != 0x80), off), per_row(_SYMBOL[raw], off), np.bincount(lrow, later, b - a), per_row(covered, woff),
            np.bincount(lrow, minlength=b - a), per_row(_UPPER[raw], off), per_row(_MARK[raw], off), per_row(stutter, woff),
        )):
            x[:, k] = v
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        m = measure(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(m[:, k])) for k in range(len(MEASURES)))], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, MEASURES..., fail_bits long) of every row, from whole texts and without a shuffle.

    Null texts measure as empty ones, which have zeros everywhere; null ids and repeated rows come back as they are; an empty
    table gives no rows; extra columns are not read.
    """
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(m, T.LongType()) for m in MEASURES)])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(_batches), schema)
    bits = F.expr(" | ".join(f"IF({when}, {BIT[name]}L, 0L)" for name, when in RULES))
    return rows.withColumn("fail_bits", bits)


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def passes(policy: str) -> Column:
    """Whether a ledger row passes every rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """(policy, rule, n_docs, n_fail, n_only, kept, kept_without) for each rule of the policy: documents that fail it, that fail it
    alone, and that are kept with and without it. One aggregation of at most 2**rules groups, whatever the number of documents."""
    m = mask(policy)
    groups = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    each = groups.select("bits", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]))).alias("r"))
    return each.groupBy(F.lit(policy).alias("policy"), F.col("r.rule").alias("rule")).agg(
        F.sum("n").alias("n_docs"), F.coalesce(F.sum(F.when(F.expr("bits & r.bit <> 0"), F.col("n"))), F.lit(0)).alias("n_fail"),
        F.coalesce(F.sum(F.when(F.expr("bits = r.bit"), F.col("n"))), F.lit(0)).alias("n_only"), F.coalesce(F.sum(F.when(F.expr("bits = 0"), F.col("n"))), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.when(F.expr("bits = 0 OR bits = r.bit"), F.col("n"))), F.lit(0)).alias("kept_without"),
    )


#: DuckDB SQL for op2: the same measures and rules.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, k, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM w WHERE len(w) > 2),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS n FROM p),
c AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY k),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_upper,
             len(regexp_extract_all(t, '[!?]')) AS n_marks, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_stutter FROM w LEFT JOIN c USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (%RULES%) AS kept, CAST(%BITS% AS BIGINT) AS fail_bits, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_upper AS BIGINT) AS n_upper,
       CAST(n_marks AS BIGINT) AS n_marks, CAST(n_stutter AS BIGINT) AS n_stutter FROM m
""".replace("%RULES%", " OR ".join(f"({when})" for _, when in RULES)).replace("%BITS%", " + ".join(f"(CASE WHEN {when} THEN {BIT[name]} ELSE 0 END)" for name, when in RULES))


def ablation_sql(policy: str) -> str:
    """DuckDB SQL of ``ablations`` over the ledger of documents."""
    m = mask(policy)
    rules = ", ".join(f"('{r}', {BIT[r]})" for r in POLICIES[policy])
    return f"""SELECT '{policy}' AS policy, r.rule, count(*) AS n_docs, count(*) FILTER (bits & bit <> 0) AS n_fail, count(*) FILTER (bits = bit) AS n_only,
    count(*) FILTER (bits = 0) AS kept, count(*) FILTER (bits = 0 OR bits = bit) AS kept_without
    FROM (SELECT fail_bits & {m} AS bits FROM ({SQL})), (VALUES {rules}) AS r(rule, bit) GROUP BY r.rule"""
