"""Prefix tree of conversations: who owns which node, and what hangs below it.

A node is a sequence of first turns; the smallest conversation that begins with it owns it. If a conversation owns one of its nodes it owns all
deeper ones, so its nodes are one chain, and the chain's first depth is found by binary search: each round looks up one prefix digest of each
conversation in the table of digests' minima. Chains hang on the chain that owns the node before their first; sums go up chain by chain, from
the deepest level, and then once along each chain. Digests have 128 bits: with 10^12 different prefixes the odds that any two meet are 10^-15.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import discard, lean, ship, written

FAMILY = 100
HEADS = 6
#: Ids of one string on the way to a node's hash.
IDS = 65_536
_ROOT = bytes(16)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by family, its base first, then conversation and turn -> (conv_id, depth, digest, chars) of every rebuilt prefix, root included.

    A stream: what is held is the base's first HEADS - 1 turns and one digest."""
    family = conv = None
    base: list[tuple[str, str]] = []
    heads = own = depth = 0
    digest, out = _ROOT, []

    def step(role: str, text: str) -> None:
        nonlocal digest, depth
        name = role.encode()
        digest, depth = hashlib.blake2b(digest + len(name).to_bytes(8, "little") + name + text.encode(), digest_size=16).digest(), depth + 1
        out.append((conv, depth, digest, len(text)))

    def batch() -> pa.RecordBatch:
        rows, out[:] = list(out), []
        cols = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=["conv_id", "depth", "digest", "chars"])

    for b in batches:
        for f, c, role, text in zip(*(b.column(n).to_pylist() for n in ("family", "conv_id", "role", "text"))):
            if f != family:
                family, base = f, []
            if c != conv:
                conv, own, depth, digest = c, 0, 0, _ROOT
                heads = zlib.crc32(str(c).encode()) % HEADS
                out.append((c, 0, _ROOT, 0))
                if c != f:
                    for turn in base[:heads]:
                        step(*turn)
            own += 1
            if c == f:
                if own < HEADS:
                    base.append((role, text))
                step(role, text)
            elif own > heads:
                step(role, text)
        if len(out) > 20_000:
            yield batch()
    yield batch()


def prefixes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, digest, chars) of every prefix of every rebuilt conversation, depth 0 included: the first h turns of the conversation
    ``c - c % 100``, then its own after its first h, with h = crc32(c) % 6."""
    ship(turns.sparkSession)
    c = F.col(conv_col).cast("long")
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        (c - c % FAMILY).alias("family"), c.alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    order = ["family", F.col("conv_id") != F.col("family"), "conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition("family").sortWithinPartitions(*order).mapInArrow(lean(_prefixes), "conv_id long, depth long, digest binary, chars long")


def first_owned(every: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv_id, n, top): turns and first owned depth (n + 1: none) of each conversation, by binary search in batches of one join a round."""
    state = written(every.groupBy("conv_id").agg(F.max("depth").alias("n")).select("conv_id", "n", F.lit(0).cast("long").alias("lo"), (F.col("n") + 1).alias("hi")), "search")
    longest = state.agg(F.max("n")).first()[0]
    owners = minima.select("digest", "owner")
    for _ in range((longest + 1).bit_length() if longest is not None else 0):
        ask = state.where("lo < hi").withColumn("depth", F.expr("(lo + hi) div 2"))
        met = ask.join(every.select("conv_id", "depth", "digest"), ["conv_id", "depth"]).join(owners, "digest")
        own = F.col("owner") == F.col("conv_id")
        moved = met.select("conv_id", "n", F.when(own, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(own, F.col("depth")).otherwise(F.col("hi")).alias("hi"))
        last, state = state, written(state.where("lo >= hi").union(moved), "search")
        discard(last)
    return state.select("conv_id", "n", F.col("lo").alias("top"))


def _levels(chains: DataFrame) -> DataFrame:
    """(conv_id, level): how many chains stand above each, by doubling the steps each one looks up."""
    now = written(chains.select("conv_id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("level")), "levels")
    while not now.where("up IS NOT NULL").isEmpty():
        above = now.select(F.col("conv_id").alias("up"), F.col("up").alias("higher"), F.col("level").alias("more"))
        open_ = now.where("up IS NOT NULL").join(above, "up").select("conv_id", F.col("higher").alias("up"), (F.col("level") + F.col("more")).alias("level"))
        last, now = now, written(now.where("up IS NULL").union(open_), "levels")
        discard(last)
    return now.select("conv_id", "level")


def _totals(chains: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved) of whole chains with all that hangs on them, from the deepest level up."""
    level = written(chains.join(_levels(chains), "conv_id").select("conv_id", "parent", "level", "leaves", "saved"), "chains")
    deepest = level.agg(F.max("level")).first()[0]
    below, out = None, []
    for k in range(deepest if deepest is not None else -1, -1, -1):
        own = level.where(F.col("level") == k).select("conv_id", "parent", "leaves", "saved")
        if below is not None:
            hung = below.groupBy(F.col("parent").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
            own = own.join(hung, "conv_id", "left").select("conv_id", "parent", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        below = written(own, "totals")
        out.append(below)
    every = out[0] if out else level.select("conv_id", "parent", "leaves", "saved")
    for t in out[1:]:
        every = every.union(t)
    return every.select("conv_id", "leaves", "saved")


def _strings(most: int):
    """Sorted (digest, conv_id) -> (digest, first, ids): runs of at most ``most`` ids as one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.int64(), pa.string())
        now, ids = None, []

        def batch(rows) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) if rows else [[]] * 3, kinds)], names=["digest", "first", "ids"])

        for b in batches:
            out = []
            for digest, conv in zip(b.column("digest").to_pylist(), b.column("conv_id").to_pylist()):
                if digest != now or len(ids) >= most:
                    if ids:
                        out.append((now, ids[0], ",".join(map(str, ids))))
                    now, ids = digest, []
                ids.append(conv)
            yield batch(out)
        yield batch([(now, ids[0], ",".join(map(str, ids)))] if ids else [])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of one digest in order -> the hash of all, joined; one string at a time is held."""
    now, sha = None, None
    for b in batches:
        out = []
        for digest, ids in zip(b.column("digest").to_pylist(), b.column("ids").to_pylist()):
            if digest != now:
                if now is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = digest, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=["digest", "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["digest", "sha"])


def _ends(every: DataFrame, owned: DataFrame) -> DataFrame:
    """(digest, sha) of the nodes at which some conversation ends. A single id is hashed in place; the ids of larger nodes are sorted by
    range, joined to strings by many tasks, and only those strings meet in order, since SHA-256 is a chain."""
    last = written(every.join(owned.select("conv_id", F.col("n").alias("depth")), ["conv_id", "depth"]).select("digest", "conv_id"), "ends")
    count = written(last.groupBy("digest").agg(F.count("*").alias("c"), F.min("conv_id").alias("one")), "ends")
    many = last.join(count.where("c > 1").select("digest"), "digest")
    strings = many.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_strings(IDS), "digest binary, first long, ids string")
    shas = strings.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hashed, "digest binary, sha string")
    return count.where("c = 1").select("digest", F.sha2(F.col("one").cast("string"), 256).alias("sha")).union(shas)


def prefix_tree(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row a node.

    Turns stand by turn, null first, then role and text, so ties and repeated rows have one order; null roles and texts are empty. Rows without a
    conversation id belong to none. An empty table gives no rows; extra columns are not read. Ids are cast to long.
    """
    every = written(prefixes(turns, conv_col, turn_col, role_col, text_col), "prefixes")
    minima = written(every.groupBy("digest").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("depth").alias("depth")), "minima")
    owned = written(first_owned(every, minima), "owned")
    tops = owned.where("top <= n")
    before = tops.where("top > 0").select("conv_id", (F.col("top") - 1).alias("depth")).join(every.select("conv_id", "depth", "digest"), ["conv_id", "depth"])
    hung = written(before.join(minima.select("digest", F.col("owner").alias("parent")), "digest").select("conv_id", "parent", F.col("depth").alias("at")), "hung")
    places = written(hung.groupBy(F.col("parent").alias("owner"), F.col("at").alias("depth")).agg(F.count("*").alias("hung")), "places")
    nodes = minima.join(places, ["owner", "depth"], "left").join(owned.select(F.col("conv_id").alias("owner"), "n", "top"), "owner")
    ends_here = F.col("depth") == F.col("n")
    nodes = nodes.withColumn("leaf", F.when(ends_here & F.col("hung").isNull(), 1).otherwise(0)).withColumn("value", (F.col("n_convs") - 1) * F.col("chars"))
    nodes = written(nodes.select("digest", "owner", "depth", "n_convs", "n", "top", "leaf", "value", F.coalesce("hung", F.lit(0)).alias("hung")), "nodes")
    sums = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("leaf").alias("leaves"), F.sum("value").alias("saved"))
    chains = written(sums.join(hung.select("conv_id", "parent"), "conv_id", "left"), "chains")
    below = _totals(chains).join(hung, "conv_id").groupBy(F.col("parent").alias("owner"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    down = W.partitionBy("owner").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    full = nodes.join(below, ["owner", "depth"], "left")
    full = full.withColumn("n_leaves", F.sum(F.col("leaf") + F.coalesce("l", F.lit(0))).over(down)).withColumn("saved_tokens", F.sum(F.col("value") + F.coalesce("s", F.lit(0))).over(down))
    parent = F.when(F.col("depth") > F.col("top"), F.col("owner")).otherwise(F.col("parent"))
    full = full.join(hung.select(F.col("conv_id").alias("owner"), "parent"), "owner", "left").join(_ends(every, owned), "digest", "left")
    long = lambda c: c.cast("long")
    return full.select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > 0, parent).alias("parent_conv_id"), "n_convs",
        long(F.col("hung") + F.when(F.col("depth") < F.col("n"), 1).otherwise(0)).alias("n_children"), long(F.col("n_leaves")).alias("n_leaves"),
        long(F.col("saved_tokens")).alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


#: The same rows from all prefixes of all conversations.
SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
e AS (SELECT DISTINCT conv_id FROM o),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)),
        CAST(4294967295 AS BIGINT)) % 6 AS h FROM e),
r AS (SELECT c.conv_id, 0 AS part, o.i, role, text FROM c JOIN o ON o.conv_id = c.base AND o.i <= h
      UNION ALL SELECT c.conv_id, 1, o.i, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > h),
l AS (SELECT conv_id, list(sha256(role) || sha256(text) ORDER BY part, i) AS ks, list(length(text) ORDER BY part, i) AS ls FROM r GROUP BY conv_id),
v AS (SELECT c.conv_id, coalesce(ks, []) AS ks, ls FROM c LEFT JOIN l ON l.conv_id = c.conv_id),
u AS (SELECT conv_id, ks, ls, unnest(range(0, len(ks) + 1)) AS d FROM v),
p AS (SELECT conv_id, d, len(ks) AS n, sha256(array_to_string(ks[1:d], '')) AS k, CASE WHEN d = 0 THEN 0 ELSE ls[d] END AS chars FROM u),
m AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
             string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM p GROUP BY k, d),
q AS (SELECT m.k, p.k AS up FROM m JOIN p ON p.conv_id = m.conv_id AND p.d = m.d - 1),
h AS (SELECT up AS k, count(*) AS n_children FROM q GROUP BY up),
a AS (SELECT p.k, sum(CASE WHEN h.k IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.chars) AS saved
      FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d LEFT JOIN h ON h.k = m.k GROUP BY p.k)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, t.conv_id AS parent_conv_id, CAST(m.n_convs AS BIGINT) AS n_convs, CAST(coalesce(h.n_children, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m LEFT JOIN q ON q.k = m.k LEFT JOIN m t ON t.k = q.up LEFT JOIN h ON h.k = m.k JOIN a ON a.k = m.k
"""
