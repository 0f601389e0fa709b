"""Phrase collocations from depth-limited count tries, built per shard, serialised sorted and merged by prefix range.

1. Words are counted; a phrase that is frequent has frequent words and word pairs only, so two filters cut the texts into the stretches in which
   frequent phrases can stand. The words' filter is a bit table; for the pairs each shard serialises its sorted pair hashes with their counts, cut
   by hash range, and each range is merged. Both filters let more through at worst, never less, at a fixed greatest size.
2. A shard (some SHARD bytes of text) counts its paths of up to DEPTH words: a trie, serialised as its sorted paths with the count of each end,
   one piece for each range of prefixes, a prefix being the hash of the first two words.
3. A range's pieces are merged in order; the walk adds up each node below its prefix. The paths of a pair that would fill a range alone are
   dealt by four words, and such a pair's nodes of two and three words come in parts, summed afterwards.
4. A node's left parts are the nodes on its way from the root, its right parts those on its suffix links, level by level.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _words
from ._store import discard, lean, ship, written

DEPTH = 5
LEAST = 100
TOP = 2000
#: Bytes of text of one trie.
SHARD = 12 << 20
#: Words of the texts for each range, so pairs or paths of one merge at most, on average.
RANGE = 1 << 21
#: Bits of a filter at most (32 MB).
MOST_BITS = 1 << 28
UNKNOWN = "und"
_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_SPACE = _CUT.copy()
_SPACE[[9, 32]] = True
_B = np.uint64(0x9E3779B97F4A7C15)


class _Shard:
    """Words of some texts of one language: ``ids`` into ``words`` (Arrow strings), ``joined`` whether a word goes on its predecessor's piece."""

    def __init__(self, texts: pa.Array):
        raw, off = _words.buffers(texts)
        raw = _words.lower(raw)
        starts, ends, first = _words.split(raw, off, _SPACE)
        cuts = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(_CUT[raw], out=cuts[1:])
        self.joined = np.zeros(len(starts), bool)
        if len(starts):
            row = _words.row_of(first)
            self.joined[1:] = (cuts[starts[1:]] == cuts[ends[:-1]]) & (row[1:] == row[:-1])
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        every = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[~_SPACE[raw]].tobytes())])
        coded = every.dictionary_encode()
        self.ids, self.words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    def hashes(self, lang: str) -> np.ndarray:
        """Hash of each different word, with the language."""
        raw, off = _words.buffers(self.words)
        salt = _words.hashes(*[np.frombuffer(lang.encode() or b" ", np.uint8), np.array([0]), np.array([len(lang.encode()) or 1])])
        return _words.mix(_words.hashes(raw, off[:-1], off[1:]) ^ salt) if len(self.words) else np.zeros(0, np.uint64)


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, _Shard]]:
    """Texts of about ``size`` bytes together, by language."""

    def cut(held):
        table = pa.Table.from_batches(held)
        for lang in table.column("lang").unique():
            yield lang.as_py(), _Shard(table.filter(pc.equal(table.column("lang"), lang)).column("text").combine_chunks())

    held, have = [], 0
    for b in batches:
        lengths = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False))
        a = 0
        while a < b.num_rows:  # whole rows up to the size, one at least
            n = max(1, int(np.searchsorted(lengths, (lengths[a - 1] if a else 0) + size - have, "right")) - a)
            held.append(b.slice(a, n))
            have += int(lengths[a + n - 1] - (lengths[a - 1] if a else 0))
            a += n
            if have >= size or a < b.num_rows:
                yield from cut(held)
                held, have = [], 0
    if held:
        yield from cut(held)


def _counted(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, s in _shards(batches, size):
            n = np.bincount(s.ids, minlength=len(s.words))
            columns = [pa.array([lang] * len(n), pa.string()), s.words.cast(pa.string()), pa.array(s.hashes(lang).view(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "hash", "a"])

    return run


def _holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 8 - 1)
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0


def _pairs(s: _Shard, lang: str, words) -> tuple[np.ndarray, np.ndarray]:
    """Places of second words of pairs of words the filter knows, and the pairs' hashes."""
    h = s.hashes(lang)
    good = _holds(words, h)[s.ids] if len(s.ids) else np.zeros(0, bool)
    at = np.flatnonzero(s.joined[1:] & good[1:] & good[:-1]) + 1
    return at, _words.mix(h[s.ids[at - 1]] * _B + h[s.ids[at]])


def _serialised_pairs(words, ranges: int, least: int, size: int):
    """(range, blob) of each shard: sorted pair hashes, then their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(words.value, np.uint8)
        for lang, s in _shards(batches, size):
            keys, n = np.unique(_pairs(s, lang, bits)[1], return_counts=True)
            which = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            edges = np.searchsorted(which, np.arange(ranges + 1)) if ranges < len(keys) else np.append(np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(keys) else [], len(keys)).astype(np.int64)
            n = np.minimum(n, least).astype(np.uint32)
            full = np.flatnonzero(np.diff(edges))
            blobs = [keys[edges[i] : edges[i + 1]].tobytes() + n[edges[i] : edges[i + 1]].tobytes() for i in full]
            yield pa.RecordBatch.from_arrays([pa.array(which[edges[full]].astype(np.int64) if len(full) else [], pa.int64()), pa.array(blobs, pa.binary())], names=["range", "blob"])

    return run


def _merged_pairs(least: int):
    def run(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for blob in table.column("blob"):
            raw = blob.as_py()
            n = len(raw) // 12
            keys.append(np.frombuffer(raw, np.uint64, n))
            counts.append(np.frombuffer(raw, np.uint32, n, 8 * n))
        k = np.concatenate(keys)
        order = np.argsort(k, kind="stable")
        k, n = k[order], np.concatenate(counts)[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        n = np.add.reduceat(n, first)
        return pa.table({"hash": pa.array(k[first][n >= least].view(np.int64)), "n": pa.array(n[n >= least])})

    return run


def _filter(hashes: DataFrame):
    """Bit table of the hashes' low bits, broadcast: 64 bits a hash up to MOST_BITS, so beyond some four million hashes it grows no more."""
    n, bits = hashes.count(), 1 << 16
    while bits < min(64 * n, MOST_BITS):
        bits *= 2
    place = F.col("hash").bitwiseAND(F.lit(bits - 1)) + 1
    blocks = hashes.select(F.bitmap_bucket_number(place).alias("block"), F.bitmap_bit_position(place).alias("bit"))
    table = np.zeros(bits // 8, np.uint8)
    for r in blocks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        table[(r.block - 1) * 4096 : r.block * 4096] = np.frombuffer(r.bits, np.uint8)[: len(table)]
    return hashes.sparkSession.sparkContext.broadcast(table.tobytes())


def _tries(words, pairs, hot, ranges: int, size: int):
    """(range, lang, piece) of each shard. Ranges from ``ranges`` on hold the paths of the pairs in ``hot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept, full = (np.frombuffer(x.value, kind) for x, kind in ((words, np.uint8), (pairs, np.uint8), (hot, np.uint64)))
        for lang, s in _shards(batches, size):
            at, h = _pairs(s, lang, known)
            on = np.zeros(len(s.ids) + DEPTH, bool)  # whether a word goes on a pair that may be frequent
            on[at[_holds(kept, h)]] = True
            prefix = np.zeros(len(on), np.uint64)
            prefix[at] = h
            start = np.flatnonzero(on[1 : len(s.ids) + 1])
            code, ids, go = s.ids[start], [s.ids[start]], np.ones(len(start), bool)
            for d in range(1, DEPTH):
                go = go & on[start + d]
                step = np.where(go, s.ids[np.minimum(start + d, len(s.ids) - 1)], -1)
                ids.append(step)
                code = np.unique(code * (len(s.words) + 1) + step + 1, return_inverse=True)[1]
            _, first, n = np.unique(code, return_index=True, return_counts=True)
            if not len(first):
                continue
            ids, prefix, own = [i[first] for i in ids], prefix[start[first] + 1], s.hashes(lang)
            alone = np.isin(prefix, full)
            for i in ids[2:4]:
                prefix = np.where(alone, _words.mix(prefix * _B + np.where(i >= 0, own[np.maximum(i, 0)], np.uint64(0))), prefix)
            which = (((prefix >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64) + np.where(alone, ranges, 0)
            blank = pa.scalar("", pa.large_string())
            parts = [pc.if_else(pa.array(i >= 0), pc.binary_join_element_wise(s.words.take(pa.array(np.maximum(i, 0))), blank, pa.scalar(" ", pa.large_string())), blank) for i in ids]
            table = pa.table({"range": which, "path": pc.binary_join_element_wise(*parts, blank), "n": n})
            table = table.take(pc.sort_indices(table, [("range", "ascending"), ("path", "ascending")])).combine_chunks()
            which, n = table.column("range").to_numpy(), table.column("n").to_numpy()
            raw, off = _words.buffers(table.column("path"))
            edges = np.append(np.flatnonzero(np.r_[True, which[1:] != which[:-1]]), len(which))
            pieces = [_piece(raw[off[a] : off[b]], off[a : b + 1] - off[a], n[a:b]) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(which[edges[:-1]]), pa.array([lang] * len(pieces), pa.string()), pa.array(pieces, pa.binary())], names=["range", "lang", "piece"])

    return run


def _piece(raw: np.ndarray, off: np.ndarray, n: np.ndarray) -> bytes:
    """Number of paths, their ends, their counts, their bytes."""
    return np.array([len(n)], np.int64).tobytes() + off[1:].astype(np.int64).tobytes() + n.astype(np.int64).tobytes() + raw.tobytes()


def _paths(piece: bytes) -> Iterator[tuple[bytes, int]]:
    k = int(np.frombuffer(piece, np.int64, 1)[0])
    ends, n, at = np.frombuffer(piece, np.int64, k, 8).tolist(), np.frombuffer(piece, np.int64, k, 8 + 8 * k).tolist(), 8 + 16 * k
    a = 0
    for b, count in zip(ends, n):
        yield piece[at + a : at + b], count
        a = b


def _merged_tries(least: int, ranges: int):
    """The pieces of one range -> nodes (lang, phrase, depth, a) of two words or more that reach ``least``, and all whose counts other ranges share."""

    def walk(stream: Iterator[tuple[bytes, int]], parts: bool) -> Iterator[tuple[bytes, int, int]]:
        stack: list[list] = []  # [prefix, count], outermost first

        def leave(depth: int) -> Iterator[tuple[bytes, int, int]]:
            while len(stack) > depth:
                prefix, n = stack.pop()
                if stack:
                    stack[-1][1] += n
                    if n >= least or parts and len(stack) < 3:
                        yield prefix[:-1], len(stack) + 1, n

        for path, n in stream:
            while stack and not path.startswith(stack[-1][0]):
                yield from leave(len(stack) - 1)
            at = len(stack[-1][0]) if stack else 0
            while at < len(path):
                at = path.index(b" ", at) + 1
                stack.append([path[:at], 0])
            stack[-1][1] += n
        yield from leave(0)

    def run(table: pa.Table) -> pa.Table:
        by, out = {}, []
        parts = table.num_rows > 0 and table.column("range")[0].as_py() >= ranges
        for lang, piece in zip(table.column("lang").to_pylist(), table.column("piece")):
            by.setdefault(lang, []).append(piece.as_py())
        for lang, pieces in by.items():
            out += [(lang, p.decode(), d, n) for p, d, n in walk(heapq.merge(*map(_paths, pieces)), parts)]
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.table({k: pa.array(c, t) for (k, t), c in zip({"lang": pa.string(), "phrase": pa.string(), "depth": pa.int32(), "a": pa.int64()}.items(), cols)})

    return run


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """((lang, n) of every language with a word, (lang, phrase, depth, a) of every phrase of up to DEPTH words that occurs ``least`` times or more)."""
    ship(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = written(docs.mapInArrow(lean(_counted(shard)), "lang string, phrase string, hash long, a long").groupBy("lang", "phrase", "hash").agg(F.sum("a").alias("a")), "words")
    total = words.groupBy("lang").agg(F.sum("a").alias("n"))
    every = total.agg(F.sum("n")).first()[0] or 0
    known = _filter(words.where(f"a >= {least}").select("hash"))
    blobs = docs.mapInArrow(lean(_serialised_pairs(known, max(1, every // RANGE), least, shard)), "range long, blob binary")
    kept = written(blobs.groupBy("range").applyInArrow(_merged_pairs(least), "hash long, n long"), "pairs")
    ranges = max(1, every // RANGE)
    # at most one pair in RANGE words
    hot = np.array([r.hash for r in kept.where(F.col("n") >= RANGE).select("hash").collect()], np.int64)
    pieces = docs.mapInArrow(lean(_tries(known, _filter(kept.select("hash")), docs.sparkSession.sparkContext.broadcast(hot.tobytes()), ranges, shard)), "range long, lang string, piece binary")
    parts = pieces.groupBy("range").applyInArrow(_merged_tries(least, ranges), "lang string, phrase string, depth int, a long")
    nodes = parts.groupBy("lang", "phrase", "depth").agg(F.sum("a").alias("a")).where(f"a >= {least}")
    first = words.where(f"a >= {least}").select("lang", "phrase", F.lit(1).alias("depth"), "a")
    out = written(first.union(nodes.select("lang", "phrase", "depth", "a")), "nodes")
    total = written(total, "totals")
    discard(words, kept)
    return total, out


def _parent(phrase: Column, depth: int) -> Column:
    return F.substring_index(phrase, " ", depth - 1)


def _suffix(phrase: Column) -> Column:
    return F.substring(phrase, F.instr(phrase, F.lit(" ")) + 1, F.length(phrase))


def linked(nodes: DataFrame) -> DataFrame:
    """Nodes of two words or more with ``lefts`` and ``rights``, the counts of the left and right part of each cut, and ``longer``, the
    greatest count of a node one word longer that holds it."""
    none = F.array().cast("array<bigint>")
    level, out = nodes.where("depth = 1").select("lang", "phrase", "a", none.alias("lefts"), none.alias("rights")), []
    for d in range(2, DEPTH + 1):
        up = level.select("lang", F.col("phrase").alias("parent"), F.concat("lefts", F.array("a")).alias("lefts"))
        link = level.select("lang", F.col("phrase").alias("suffix"), F.concat(F.array("a"), "rights").alias("rights"))
        own = nodes.where(f"depth = {d}").select("lang", "phrase", "a", _parent(F.col("phrase"), d).alias("parent"), _suffix(F.col("phrase")).alias("suffix"))
        level = written(own.join(up, ["lang", "parent"]).join(link, ["lang", "suffix"]).select("lang", "phrase", "a", "lefts", "rights", "parent", "suffix"), f"level{d}")
        out.append(level)
    every = out[0]
    for level in out[1:]:
        every = every.union(level)
    inside = every.select("lang", F.explode(F.array("parent", "suffix")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return every.drop("parent", "suffix").join(inside, ["lang", "phrase"], "left")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP, least: int = LEAST, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` collocations.

    Null texts are empty, a null language is UNKNOWN; repeated rows all count; empty tables and languages without a candidate give no rows;
    extra columns are not read. Scores are whole-number quotients of decimals of 38 digits.
    """
    total, nodes = phrases(docs, lang_col, text_col, least, shard)
    big = lambda c: c.cast("decimal(19,0)")
    one = linked(nodes).join(F.broadcast(total), "lang") if total.count() <= 10_000 else linked(nodes).join(total, "lang")
    one = one.where("longer IS NULL OR longer < a").withColumn("upper", (big(F.col("a") * 1000) * big(F.col("n"))))
    cuts = F.transform(F.arrays_zip("lefts", "rights"), lambda c, k: F.struct(c["lefts"].alias("l"), c["rights"].alias("r"), k.alias("k")))
    cut = one.select("lang", "phrase", "a", "n", "upper", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "n", "upper", "c.*")
    scored = cut.withColumn("score", F.expr("upper div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "n", "m.score", "m.l", "m.r")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = lowest.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


#: The same rows by counting every phrase.
SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m)),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM s GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2),
d AS (SELECT DISTINCT lang, unnest([array_to_string(w[1:m - 1], ' '), array_to_string(w[2:m], ' ')]) AS phrase, a FROM c),
x AS (SELECT lang, phrase, max(a) AS longer FROM d GROUP BY ALL),
k AS (SELECT c.*, unnest(range(1, m)) AS k FROM c LEFT JOIN x USING (lang, phrase) WHERE longer IS NULL OR longer < a),
q AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, n.n, (CAST(1000 AS HUGEINT) * k.a * n.n) // (CAST(l.f AS HUGEINT) * r.f) AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ')
      JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:k.m], ' ') JOIN n ON n.lang = k.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM q),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE nth = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM t WHERE rank <= 2000
"""
