"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits. The binary [23,12,7] Golay code is perfect: every 23-bit word lies
within three bits of exactly one codeword. ``near(x)`` is the set of codewords that x or a one-bit neighbour of x decodes to, six at
most; if x and y differ in one bit at most, decode(x) is in near(y) and the reverse.

At three or fewer differing bits the segments' errors are one of two kinds. Either some segment has none and another at most one
(0-0-3, 0-1-2 and less): then for that ordered pair (i, j), x files under (x_i, decode(x_j)) and looks up under {x_i} x near(x_j), keys of
33 bits or 34. Or each segment has exactly one (1-1-1): x files under (decode(x_1), decode(x_3)) with near(x_2) between, and looks up
under near(x_1), decode(x_2), near(x_3), keys of 36 bits. Any linked pair meets, and the whole fingerprint verifies it: nothing is missed.
A fingerprint has 12 keys to file under and 60 to look up, on average; with keys so long, 10^9 different fingerprints at random put under one
row in a bucket, some 10 candidates for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import discard, lean, ship, written
from ._words import pieces
from .components import components

SEED = 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))
_GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1, a generator polynomial of the binary Golay code


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word modulo the generator polynomial."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= ((x >> bit) & 1) * (_GENERATOR << (bit - 11))
    return x


def _error_table() -> np.ndarray:
    """For each of the 2,048 syndromes, the only error pattern of three bits or fewer."""
    one = 1 << np.arange(23)
    errors = [np.zeros(1, np.int64), one]
    errors += [np.array([one[i] | one[j] for i in range(23) for j in range(i)])]
    errors += [np.array([one[i] | one[j] | one[k] for i in range(23) for j in range(i) for k in range(j)])]
    every = np.concatenate(errors)
    table = np.zeros(2048, np.int64)
    table[_syndromes(every)] = every
    return table


_ERRORS = _error_table()
_LOW, _HIGH = _syndromes(np.arange(1 << 12)), _syndromes(np.arange(1 << 11) << 12)


def decode(x: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    return (x ^ _ERRORS[_LOW[x & 0xFFF] ^ _HIGH[x >> 12]]) >> 11


def near(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codeword indices of each word and its one-bit neighbours, with a mask of their first occurrences."""
    flips = np.concatenate([[0], 1 << np.arange(bits)])
    keys = np.sort(decode(x[:, None] ^ flips), axis=1)
    first = np.ones(keys.shape, bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys, first


def _pairs(first: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the second) of every pair of marked places of two matrices with the same rows."""
    r, c = np.nonzero(first)
    n = other.sum(axis=1)[r]
    at = np.repeat(np.arange(len(r)), n)
    return at, np.nonzero(other[r])[1]


def bucket_keys(prints: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the buckets a fingerprint files under (side 0) or looks up (side 1)."""
    u = prints.view(np.uint64)
    seg = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    exact = [decode(s) for s in seg]
    fuzzy = [near(s, n) for s, (_, n) in zip(seg, SEGMENTS)]
    every, rows, keys = np.arange(len(u)), [], []
    for p, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        r, code = (every, exact[j]) if side == 0 else ((at := np.nonzero(fuzzy[j][1]))[0], fuzzy[j][0][at])
        rows.append(r)
        keys.append((p << 36) | (seg[i][r] << 12) | code)
    if side == 0:
        r, c = np.nonzero(fuzzy[1][1])
        code = (exact[0][r] << 24) | (fuzzy[1][0][r, c] << 12) | exact[2][r]
    else:
        a, b = np.nonzero(fuzzy[0][1])
        at, c = _pairs(fuzzy[0][1], fuzzy[2][1])
        r = a[at]
        code = (fuzzy[0][0][r, b[at]] << 24) | (exact[1][r] << 12) | fuzzy[2][0][r, c]
    return np.concatenate([*rows, r]), np.concatenate([*keys, (6 << 36) | code])


def fingerprints_of(column: pa.Array) -> np.ndarray:
    """SimHash of every text: lower-case A-Z, 3-word shingles with repeats, XXH64; no word gives zero."""
    out = np.zeros(len(column), np.uint64)
    digest = xxhash.xxh64_intdigest
    for a, b, raw, off in pieces(column):
        data, hs, counts = raw.tobytes().lower(), [], np.zeros(b - a, np.int64)
        for i in range(b - a):
            words = data[off[i] : off[i + 1]].split()
            n = len(words)
            if not n:
                continue
            text = b" ".join(words)
            if n <= 3:
                hs.append(digest(text, SEED))
                counts[i] = 1
                continue
            cut = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
            starts = [0, *cut[: n - 3].tolist()]
            hs += [digest(text[s:e], SEED) for s, e in zip(starts, (cut[2:] - 1).tolist())]
            counts[i] = n - 2
        if hs:
            ends = np.cumsum(counts)
            bits = np.unpackbits(np.array(hs, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
            full = np.flatnonzero(counts)
            ones = np.add.reduceat(bits, (ends - counts)[full], axis=0, dtype=np.int32)
            most = np.packbits(2 * ones > counts[full][:, None], axis=1)
            out[a + full] = most.view(">u8").ravel().astype(np.uint64)
    return out


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = fingerprints_of(b.column(b.num_columns - 1)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=[*b.schema.names[:-1], "fp"])


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """(id, fp long) of every row, with ``row`` between them if given; the text column is read once and leaves the plan here."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *([T.StructField("row", T.LongType())] if row is not None else []), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("doc_id"), *([row.alias("row")] if row is not None else []), F.col(text_col).alias("text")).mapInArrow(lean(_print_batches), schema)


def _filed(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(prints), 8192):
                part = np.ascontiguousarray(prints[at : at + 8192])
                rows, keys = bucket_keys(part, side)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    return run


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """All pairs (u, v), u < v, of different fingerprints in ``prints`` (fp long, distinct) at ``distance`` (at most 3) or fewer bits."""
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3")
    left = prints.select("fp").mapInArrow(lean(_filed(0)), "key long, fp long").withColumnRenamed("fp", "u")
    right = prints.select("fp").mapInArrow(lean(_filed(1)), "key long, fp long").withColumnRenamed("fp", "v")
    near_pairs = left.hint("merge").join(right, "key").where(F.expr(f"u <> v AND bit_count(u ^ v) <= {int(distance)}"))
    return near_pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, links) for every row.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the smallest id reachable over links of ``distance`` bits or
    fewer, ``links`` the number of other fingerprints linked to this one. Null and empty texts have fingerprint zero and link
    like any other. Rows with a null id are returned with what their fingerprint gives them but never name a component;
    a component of null ids only has a null component_id. Repeated rows each come back. Extra columns are not read.
    Copies are folded to one row per fingerprint before anything is joined, by a map-side-combined minimum.
    """
    prints = written(fingerprint_table(docs, id_col, text_col), "prints")
    out = _with_class(prints, _classes(prints, distance))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("links").cast("long").alias("links"))


def _classes(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, root, component_id, links) of every fingerprint; ``root`` tells components apart, also where repeated ids give two the same smallest id."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = written(links(nodes, distance), "links")
    degree = found.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    roots = components(found)
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = member.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(
        member.join(names, "root").join(degree, "fp", "left").select("fp", "root", "component_id", F.coalesce("links", F.lit(0)).alias("links")), "classes"
    )
    discard(found, nodes, roots)
    return classes


def _with_class(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """Left equi-join on fp; written as a merge join so that a fingerprint held by a third of all rows is split by adaptive execution."""
    return prints.join(classes.hint("merge"), "fp", "left")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id, null after all ids, and of several rows of that id the one with the
    smallest hash of all columns. Of rows alike in every column one stays. Columns are as they were.

    Rows are told apart by id and that 64-bit hash, so repeated ids with other texts are rows of their own, each in its own group.
    """
    row = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    prints = written(fingerprint_table(docs, id_col, text_col, row), "prints")
    classes = _classes(prints, distance)
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")
    named = written(prints.join(classes.select("fp", "root").hint("merge"), "fp").select("root", order.alias("at")), "named")
    first = written(named.groupBy("root").agg(F.min("at").alias("stays")), "stays")
    gone = written(named.join(first.hint("merge"), "root").where("at <> stays").select("at.*").distinct(), "gone")
    again = written(named.groupBy("at").agg(F.count("*").alias("n")).where("n > 1").join(first.select(F.col("stays").alias("at")), "at", "left_semi").select("at.*"), "again")
    discard(prints, classes, named, first)
    keyed = docs.select(F.struct("*").alias("d"), row.alias("key"))
    same = lambda t: (F.col("key") == t["row"]) & F.col("d")[id_col].eqNullSafe(t["doc_id"])
    kept = keyed.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return kept.select("d.*")
    once = kept.join(again, same(again), "left_semi").dropDuplicates(["key"])
    return kept.join(again, same(again), "left_anti").select("d.*").union(once.select("d.*"))
