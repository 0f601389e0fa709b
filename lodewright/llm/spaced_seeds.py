"""Benchmark decontamination by spaced-seed hashing, in DataFrame expressions only.

A seed is a mask of token positions of which those between are ignored. A benchmark item is hashed under few masks at chosen places,
a document under the same masks at every position; equal hashes give an alignment (document, item, offset), and the alignment is
verified token by token over the whole item.

Nothing that the rule accepts is missed. At LEAST_SHARE an item of n tokens may differ in k = n div 5 of them, and ``index`` hashes it at
k + 1 places that share no token, so one of them has no differing token: two translates of a mask with gaps of two tile 2w tokens, three
of a mask with gaps of three tile 3w, for w tokens compared. Any LEAST_RUN tokens in a row, of items long enough for that to matter,
hold a place of the first mask too. Items under LEAST_TOKENS tokens are sought word for word, by one mask of their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import written

#: Positions a mask compares: four with gaps of two and of three, three likewise, and 1 to 5 in a row for the shortest items.
MASKS = ((0, 2, 4, 6), (0, 3, 6, 9), (0, 2, 4), (0, 3, 6), (0,), (0, 1), (0, 1, 2), (0, 1, 2, 3), (0, 1, 2, 3, 4))
#: An item's tokens that must agree at one alignment, of five, and the least number of them; shorter items must agree in all.
AGREE, LEAST_TOKENS = 4, 6
LEAST_SHARE = AGREE / 5
#: Or: so many tokens in a row that agree, for part of a longer item.
LEAST_RUN = 13
#: Hashes of items that are broadcast at most, 24 bytes each; more are joined by a shuffle of the documents' hashes.
BROADCAST_KEYS = 2_000_000


def tokens(text: Column) -> Column:
    """Lower-case words without the punctuation around them. Null reads as the empty text; an empty token stands before or after
    punctuation that begins or ends the text (a single one for a text of no word)."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+", -1)


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def places(n: int) -> list[tuple[int, int]]:
    """(mask, offset) at which an item of ``n`` tokens is hashed."""
    if n < LEAST_TOKENS:
        return [(3 + n, 0)] if n else []
    if n in (6, 7):
        return [(2, 0), (2, 1)]
    if n in (8, 9):
        return [(0, 0), (0, 1)]
    if n in (10, 11):
        return [(3, 0), (3, 1), (3, 2)]
    if n in (12, 13, 14):
        return [(1, 0), (1, 1), (1, 2)]
    if n == 15:
        return [(2, 0), (2, 1), (2, 6), (2, 7)]
    # blocks of eight tokens, two places each; where an odd number of places is needed, the last twelve tokens give three
    out = [(0, o) for o in range(n - 6) if o % 8 < 2]
    return out + [(1, n - 12 + i) for i in range(3)] if (n // 5 + 1) % 2 else out


def _key(mask: int, h: str, at: str) -> str:
    """Hash of what a mask compares at position ``at`` of the array ``h``; null where it runs past the end."""
    m = MASKS[mask]
    return f"CASE WHEN {at} + {m[-1]} < size({h}) THEN xxhash64({mask}, {', '.join(f'get({h}, {at} + {o})' for o in m)}) END"


def index(items: DataFrame) -> DataFrame:
    """(key, mask, i, item_at) of every place of the items (i, g: hashed tokens): ``places``, as expressions."""
    n = F.size("g")
    most, rows = len(MASKS), []
    for k in range(1, 16):
        rows.append(F.when(n == k, F.array(*(F.struct(F.lit(m).alias("mask"), F.lit(o).alias("at")) for m, o in places(k)))))
    long = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 7, F.lit(0))), lambda o: o % 8 < 2), lambda o: F.struct(F.lit(0).alias("mask"), o.alias("at")))
    odd = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda o: F.struct(F.lit(1).alias("mask"), (n - 12 + o).alias("at")))
    rows.append(F.when(n >= 16, F.concat(long, F.when(F.expr("(size(g) div 5 + 1) % 2 = 1"), odd).otherwise(F.slice(odd, 1, 0)))))
    at = items.select("i", "g", F.explode(F.coalesce(*rows)).alias("p")).select("i", "g", "p.mask", F.col("p.at").alias("item_at"))
    return at.select(F.expr(f"CASE mask {' '.join(f'WHEN {k} THEN {_key(k, "g", "item_at")}' for k in range(most))} END").alias("key"), "mask", "i", "item_at")


def _seeds(source: DataFrame, masks: list[int], keep: list[str]) -> DataFrame:
    """A row for every position and mask of the documents' hashed tokens ``h``."""
    at = source.select(*keep, "h", F.posexplode_outer("h").alias("at", "own"))
    return at.select(*keep, "h", "at", F.explode(F.array(*(F.expr(_key(m, "h", "at")) for m in masks))).alias("key")).where("key IS NOT NULL")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, item_tokens, at) of every document that holds an item with LEAST_SHARE of its tokens, LEAST_TOKENS at least,
    agreeing at one alignment, or LEAST_RUN of them in a row, or all of a shorter item.

    ``at`` is the place in ``tokens`` of the document under the item's first token, negative if the item's start is cut off; of several alignments
    the best, then the first, is given. Null or empty texts on either side give no row, nor do null ids. Rows that share an item id or a document
    id but not a text are each sought or searched, and the best pair of texts is given; repeated rows give one row.
    The documents are scanned once. Up to BROADCAST_KEYS hashes of items go to the tasks and no text is shuffled; beyond that, hashes meet in
    a shuffle and the documents hit are read once more. Both ways give the same rows.
    """
    listed = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), _hashed(F.filter(tokens(F.col(item_text)), lambda w: w != "")).alias("g")).where(F.size("g") > 0)
    items = written(listed.distinct().withColumn("i", F.monotonically_increasing_id()), "items")
    keys = written(index(items), "keys")
    found = keys.groupBy("mask").agg(F.count("*").alias("n")).collect()
    masks, many = sorted(r.mask for r in found) or [0], sum(r.n for r in found)
    keys = keys.drop("mask")
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), _hashed(tokens(F.col(text_col))).alias("h"))
    stretch = F.expr("slice(h, greatest(at, 0) + 1, size(g) + least(at, 0))").alias("w")
    if many <= BROADCAST_KEYS:
        # the generators and the join run in one compiled loop; only a hit is given the aligned stretch of its document
        hits = _seeds(source, masks, ["doc_id"]).join(F.broadcast(keys), "key").select("doc_id", "i", (F.col("at") - F.col("item_at")).alias("at"), "h")
        near = hits.join(items, "i").select("doc_id", "item_id", "at", "g", stretch)
    else:
        source = source.withColumn("u", F.xxhash64("h"))
        hits = _seeds(source, masks, ["doc_id", "u"]).drop("h").join(keys, "key")
        hits = written(hits.select("doc_id", "u", "i", (F.col("at") - F.col("item_at")).alias("at")).distinct(), "hits")
        near = hits.join(source, ["doc_id", "u"]).join(items, "i").select("doc_id", "item_id", "at", "g", stretch)
    agree = F.expr(
        "aggregate(sequence(1, size(w)), named_struct('n', 0, 'run', 0, 'most', 0), (a, i) -> IF(get(w, i - 1) = get(g, i - 1 - least(at, 0)),"
        " named_struct('n', a.n + 1, 'run', a.run + 1, 'most', greatest(a.most, a.run + 1)), named_struct('n', a.n, 'run', 0, 'most', a.most)))"
    )
    seen = near.where("size(w) > 0").select("doc_id", "item_id", "at", F.size("g").alias("item_tokens"), agree.alias("a"))
    seen = seen.select("doc_id", "item_id", "at", "item_tokens", F.col("a.n").alias("matched"), F.col("a.most").alias("run"))
    held = seen.where(f"matched >= {LEAST_TOKENS} AND 5 * matched >= {AGREE} * item_tokens OR run >= {LEAST_RUN} OR item_tokens < {LEAST_TOKENS} AND matched = item_tokens")
    best = held.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", F.expr("-at AS back"), F.expr("-item_tokens AS short"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.matched").cast("long").alias("matched"), F.expr("CAST(-b.short AS BIGINT) AS item_tokens"), F.expr("CAST(-b.back AS BIGINT) AS at"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item; rows with a null id stay. The list of hits is written first, and Spark
    broadcasts it only if its size on disk is under the session's threshold."""
    bad = written(overlaps(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct(), "bad")
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)
