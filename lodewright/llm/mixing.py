"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame expressions only.

A source's documents stand in the order of a hash of their ids and texts; the stream of their words, read again and again, is cut into
blocks of BLOCK words, as many as its target takes, the last one shortened to end there. Slot n of the mix takes the point
frac(n * phi), phi the golden ratio's fraction; the interval of cumulative weights it falls in, a source's weight being its number of
blocks, names the slot's source, and the r-th slot of a source takes its block r. Any prefix of the schedule is thus close to the weights.
A source that has had its last block leaves its later slots empty; blocks that the schedule has not reached, a few of each source,
follow at its end. Every source's target is met to the word, whatever its size beside the others, and reruns agree.
Equal rows are one row with a count until their places are known, so a row that a third of the table repeats is no large group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import discard, written

PHI = (math.sqrt(5) - 1) / 2
#: A source's total may be taken so many times at most.
REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Words of a block, at any size of the input.
BLOCK = 1024
#: Rows that one group of a prefix sum holds on average.
GROUP_ROWS = 2_000
#: Equal rows that one task lays out at a time.
LAID_OUT = 4_096
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> dict:
    """Target words of each source from the sources' sizes, in exact rational steps.

    Sources weigh ``weights`` in turn by code point (null last) and share all words; a share above ``repeats`` times its
    source's size stops there and the excess is shared again by weight among the others until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict = {}
    left, open_ = sum(sizes.values()), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] > repeats * sizes[s] * total]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = float(repeats * sizes[s])
        left -= sum(repeats * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def _prefix(rows: DataFrame, key: str, value: str, group: Column, order: list) -> DataFrame:
    """``before`` long: sum of ``value`` over the earlier rows of the same ``key``. ``group`` cuts the order in consecutive groups;
    a key of a third of all rows is thereby spread over many tasks, and only one sum per group meets in one."""
    rows = rows.withColumn("group", group)
    sums = rows.groupBy(key, "group").agg(F.sum(value).alias("sum"))
    ahead = sums.withColumn("ahead", F.sum("sum").over(W.partitionBy(key).orderBy("group").rowsBetween(W.unboundedPreceding, -1))).drop("sum")
    inside = F.sum(value).over(W.partitionBy(key, "group").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    out = rows.withColumn("inside", inside).join(ahead, [key, "group"])
    return out.withColumn("before", F.coalesce("ahead", F.lit(0)) + F.coalesce("inside", F.lit(0))).drop("group", "ahead", "inside")


def schedule(spark: SparkSession, blocks: list[int]) -> DataFrame:
    """(slot, s, rank): the source of every used slot and its rank among that source's slots; source s has ``blocks[s]`` of them."""
    total, at, edges = sum(blocks), 0, []
    for n in blocks[:-1]:
        at += n
        edges.append(at / total)
    point = F.expr(f"slot * {PHI!r}D - floor(slot * {PHI!r}D)")
    # how many edges the point has passed; the sources are few
    s = F.size(F.filter(F.lit(edges) if edges else F.array().cast("array<double>"), lambda e: e <= F.col("p")))
    named = spark.range(total).select(F.col("id").alias("slot")).withColumn("p", point).select("slot", s.alias("s"), F.lit(1).alias("one"))
    ranked = _prefix(named, "s", "one", F.floor(F.col("slot") / (2 * GROUP_ROWS)), ["slot"]).select("slot", "s", F.col("before").alias("rank"))
    own = spark.createDataFrame(list(enumerate(blocks)), "s int, blocks long")
    ranked = written(ranked.join(F.broadcast(own), "s").where("rank < blocks").select("slot", "s", "rank"), "slots")
    # what the schedule has not reached, some of each source in turn; slots end to end after the others
    had = own.join(ranked.groupBy("s").agg(F.count("*").alias("had")), "s", "left").select("s", "blocks", F.coalesce("had", F.lit(0)).alias("had"))
    late = had.where("had < blocks").select("s", F.explode(F.sequence("had", F.col("blocks") - 1)).alias("rank"))
    late = late.select((F.row_number().over(W.orderBy("rank", "s")) + (total - 1)).cast("long").alias("slot"), "s", "rank")
    return ranked.union(late)


def _streams(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], seed: int) -> tuple[DataFrame, list]:
    """The rows with their sources' numbers, written, and (s, source, size, documents, target, words, blocks) of each source."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), order_of(F.col(id_col), F.col(text_col), seed).alias("h"))
    base = written(base, "sizes")
    per = {r.source: (r.size, r.n) for r in base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    order = sorted(per, key=lambda s: (s is None, s or ""))
    want = targets({s: per[s][0] for s in order}, weights)
    return base, [(i, s, *per[s], float(want[s]), round(want[s]), -(-round(want[s]) // BLOCK)) for i, s in enumerate(order)]


def order_of(doc_id: Column, text: Column, seed: int = 42) -> Column:
    """The place of a document in its source's stream: documents go by this, then by id."""
    return F.xxhash64(F.lit(seed), doc_id, text)


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], seed: int) -> tuple[DataFrame, DataFrame | None, list]:
    """The rows with what their sources have, their pieces (None if there is no word), and the sources."""
    spark = docs.sparkSession
    base, sources = _streams(docs, id_col, text_col, source_col, weights, seed)
    names = spark.createDataFrame(sources, f"s int, source {base.schema['source'].dataType.simpleString()}, source_size long, n long, target double, words long, blocks long")
    alike = base.groupBy("source", "h", "doc_id", "size").agg(F.count("*").alias("m"))
    known = alike.join(F.broadcast(names), alike["source"].eqNullSafe(names["source"])).drop(names["source"]).withColumn("sum_size", F.expr("m * size"))
    # the hash's range is cut evenly, by each source's own number of documents
    group = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("n") / GROUP_ROWS))
    place = _prefix(known, "s", "sum_size", group, [F.col("h"), F.col("doc_id").asc_nulls_first(), "size"])
    laid = place.select("*", F.explode(F.expr(f"sequence(0L, (m - 1) div {LAID_OUT})")).alias("part")).repartition("h", "doc_id", "part")
    laid = laid.select("*", F.explode(F.expr(f"sequence(part * {LAID_OUT}, least(m, (part + 1) * {LAID_OUT}) - 1)")).alias("nth")).withColumn("before", F.expr("before + nth * size"))
    rows = written(laid.drop("m", "sum_size", "part", "nth").withColumn("row", F.monotonically_increasing_id()), "places")
    discard(base)
    if not sum(b for *_, b in sources):
        return rows, None, sources
    passes = rows.where("size > 0").select("*", F.explode(F.expr("sequence(0L, greatest((words - 1) div source_size, 0L))")).alias("pass"))
    spans = passes.withColumn("lo", F.expr("pass * source_size + before")).withColumn("hi", F.expr("least(lo + size, words)")).where("lo < hi")
    parts = spans.select("*", F.explode(F.expr(f"sequence(lo div {BLOCK}, (hi - 1) div {BLOCK})")).alias("rank"))
    parts = parts.withColumn("a", F.expr(f"greatest(lo, rank * {BLOCK})")).withColumn("b", F.expr(f"least(hi, (rank + 1) * {BLOCK})"))
    slots = schedule(spark, [b for *_, b in sources])
    met = parts.join(slots, ["s", "rank"])
    return rows, met.select("slot", "row", "h", "doc_id", "source", "pass", "rank", F.expr("a - lo").alias("first"), F.expr("b - a").alias("words")), sources


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: int = 42) -> DataFrame:
    """The mix itself: (slot, source, rank, doc_id, first, words), each a stretch of ``words`` words of a document from word ``first`` on.
    Ordered by slot, then rank, ``first`` and id, it is the interleaved training stream; a writer sorts by slot range. Nulls, repeats and
    empty tables are as in ``mixed``."""
    _, met, _ = _mix(docs, id_col, text_col, source_col, weights, seed)
    if met is None:
        kinds = {c: docs.schema[x].dataType.simpleString() for c, x in (("source", source_col), ("doc_id", id_col))}
        return docs.sparkSession.createDataFrame([], f"slot long, source {kinds['source']}, rank long, doc_id {kinds['doc_id']}, first long, words long")
    return met.select("slot", "source", "rank", "doc_id", "first", "words")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_slot, last_slot, n_pieces, h) for every row, ``taken`` the words of its pieces in
    the mix, which stand in the slots from first_slot to last_slot (null where nothing is taken).

    ``taken`` is at most REPEATS times the size. Null and empty texts have size 0 and take 0. Null sources are a source of their own;
    rows of one id go by a hash of their texts, and repeated rows stand one after another, each with its own share. Sources without words
    have target 0. An empty table gives no rows. Extra columns are not read. A source's documents add up to its target, rounded to a word,
    at any total. The number of sources is taken to be small (their sizes are gathered on the driver); documents never are.
    """
    rows, met, _ = _mix(docs, id_col, text_col, source_col, weights, seed)
    out = rows.select("row", "doc_id", "source", "size", "source_size", "target", "h")
    none = F.lit(None).cast("long")
    if met is None:
        zero = F.lit(0).cast("long")
        return out.select("doc_id", "source", "size", "source_size", "target", zero.alias("taken"), none.alias("first_slot"), none.alias("last_slot"), zero.alias("n_pieces"), "h")
    taken = met.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count("*").alias("n_pieces"))
    full = out.join(taken, "row", "left")
    return full.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot", "last_slot", F.coalesce("n_pieces", F.lit(0)).alias("n_pieces"), "h")


def remixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """The mix as documents in the order of the schedule, columns as they were: each row comes taken / size times, rounded to whole documents (half
    up), so a text is never cut; its n-th copy stands where the mix has the first piece of its n-th reading. Rows without words, or of
    which under half is taken, do not come. Partition k holds the k-th range of slots, sorted, so files written from it are in order.

    A source's rows come equally often up to one place in its order and once less from there on; that place is all that is gathered, one
    row a source. Rows that share id, text and source share that place, so they come equally often, and the n-th copies of all stand
    together. Null ids and sources are as in ``mixed``; an empty table gives no rows.
    """
    rows, met, _ = _mix(docs, id_col, text_col, source_col, WEIGHTS, seed)
    if met is None:
        return docs.limit(0)
    met = written(met.groupBy("row", "h", "doc_id", "source", "pass").agg(F.sum("words").alias("words"), F.min("slot").alias("slot")), "readings")
    taken = met.groupBy("row").agg(F.sum("words").alias("taken"))
    share = rows.where("size > 0").join(taken, "row", "left").withColumn("copies", F.expr("(2 * coalesce(taken, 0) + size) div (2 * size)"))
    share = share.withColumn("low", F.expr("CAST(round(target) AS BIGINT) div source_size"))
    cut = share.groupBy("source").agg(F.first("low").alias("low"), F.max(F.when(F.expr("copies > low"), F.col("h"))).alias("cut"))
    cut = written(cut.select(F.struct(F.col("source").alias("of"), "low", "cut").alias("cut")), "cuts")
    total = met.agg(F.max("slot")).first()[0] + 1
    place = met.groupBy("h", "doc_id", "source", "pass").agg(F.min("slot").alias("slot")).select(F.struct("*").alias("p"))
    own = docs.select(F.struct("*").alias("d"), order_of(F.col(id_col), F.col(text_col), seed).alias("h"))
    here = own.join(F.broadcast(cut), F.col("d")[source_col].eqNullSafe(F.col("cut.of"))).where(size_of(F.col("d")[text_col]) > 0)
    n = F.col("cut.low") + F.when(F.col("h") <= F.col("cut.cut"), 1).otherwise(0)
    copies = here.select("d", "h", n.alias("n")).where("n > 0").select("d", "h", F.explode(F.expr("sequence(0L, n - 1)")).alias("pass"))
    same = (F.col("h") == F.col("p.h")) & (F.col("pass") == F.col("p.pass")) & F.col("d")[id_col].eqNullSafe(F.col("p.doc_id")) & F.col("d")[source_col].eqNullSafe(F.col("p.source"))
    stood = copies.join(place, same, "left").select("d", "h", F.coalesce("p.slot", F.lit(total)).alias("slot"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    range_of = F.least(F.expr(f"slot * {ranges} div {total}"), F.lit(ranges - 1)).cast("int")
    return stood.repartitionById(ranges, range_of).sortWithinPartitions("slot", "h", F.col("d")[id_col]).select("d.*")
