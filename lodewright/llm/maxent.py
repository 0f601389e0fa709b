"""Hashed maximum-entropy language model with a class-factored softmax.

p(w | h) = p(class(w) | h) p(w | class(w), h). The class is a softmax over hashed features of the history h: the word before and, as a skip
feature, the word two before. Within a class a word is the end of a path of binary decisions (a Huffman tree over the class's counts), each
with a bias, the log odds of the smoothed counts, and, if enough tokens meet it, a hashed weight of it and the word before. All weights are trained by gradient steps on every training document, in ROUNDS rounds over parts of them: each task takes
mini-batch steps from the same start and returns how far each weight moved, and the moves are averaged by the number of tokens that touched it.

Frequent words (at most HEAD of them) go with the tasks; the counts of all others stay in a table that the tail of each document joins. In
its class the tail is one leaf of the tree, and within that leaf a word has its smoothed relative frequency.
"""

from __future__ import annotations

import gc
import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import lean, ship, written
from ._words import SPACE, lower, pieces, split

#: Words that are sent to tasks at most; words that are a class of their own; classes of the other words, by the hash of their last two bytes.
HEAD, SINGLE, GROUPS = 1 << 18, 31, 32
END = SINGLE
CLASSES = SINGLE + 1 + GROUPS
#: Feature kinds of the class, and of the decisions, the first of these. Hash buckets of each grow with the training tokens, as do the weights of the decisions within classes, by powers of two
#: between these: so many at most are held twice by each task and go to the driver once a round.
KINDS, INNER_KINDS, BUCKETS, INNER = 2, 1, (1 << 12, 1 << 16), (1 << 16, 1 << 22)
#: From 2**26 training tokens on, class buckets grow on, one to 1,024 tokens, up to this bound of memory.
MOST_BUCKETS = 1 << 17
#: Decisions depend on the history if at least this share of all tokens meets them; a Huffman tree's deeper ones are met by few.
LEAST_MET = 1 / 1024
#: Rounds of training, each over its own part of the rows and from the average of the one before (further passes over the same rows fit
#: them and lose held-out likelihood); decision weights sent in one row.
ROUNDS, SLAB = 2, 4096
#: Rows of class weights in one slab.
PER_SLAB = SLAB // CLASSES
SMOOTH = 0.1
#: Step of a decision weight, divided by the root of the decisions that touched it.
INNER_RATE = 1.5
BATCH = 4096
#: Rows of class probabilities worked on at once, so that they stay in a core's cache.
CACHED = 1024
#: Bytes of text worked on at once; from so many words they are looked up together.
RUN, LOOKED_UP = 4 << 20, 150_000
#: Words and counts a counting task holds before it sums them by word; it passes on what is then over half of that.
HELD = 800_000


def is_training(id_col: str = "doc_id") -> Column:
    """Documents to learn from: crc32 of the id's decimal text is not 0 modulo 10. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 != 0, F.lit(False))


def group_of(suffix: bytes) -> int:
    return SINGLE + 1 + xxhash.xxh64_intdigest(suffix, 42) % GROUPS


class _Groups(dict):
    def __missing__(self, suffix: bytes) -> int:
        self[suffix] = g = group_of(suffix)
        return g


def _words(raw: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of rows as one array, and how many each row has."""
    starts, ends, first = split(raw, off)
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(lower(raw)[~SPACE[raw]])]), np.diff(first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

    for b in batches:
        for _, _, raw, off in pieces(b.column(0)):
            counted = _words(raw, off)[0].value_counts()
            held.append(pa.table({"word": counted.field(0), "c": counted.field(1)}))
            if sum(map(len, held)) > HELD:
                held[:] = [summed()]
                if len(held[0]) > HELD // 2:
                    yield from held.pop().combine_chunks().to_batches(50_000)
    if held:
        yield from summed().combine_chunks().to_batches(50_000)


@dataclass
class Model:
    """What a task needs to score: ``head`` word -> rank, counts by rank, classes by rank, the softmax's weights, and totals."""

    head: dict[bytes, int]
    counts: np.ndarray
    classes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    tokens: int
    distinct: int
    ends: int
    tail_tokens: np.ndarray
    tail_distinct: np.ndarray
    inner: np.ndarray
    at: np.ndarray
    nodes: np.ndarray
    turns: np.ndarray
    odds: np.ndarray
    below: np.ndarray

    def ranks(self, words: pa.Array) -> np.ndarray:
        """Ranks of words, -1 outside the head."""
        if len(words) < LOOKED_UP:
            return np.fromiter(map(self.head.get, words.to_pylist(), repeat(-1)), np.int64, len(words))
        # hashes the head once a call
        known = self.__dict__.setdefault("_known", pc.SetLookupOptions(value_set=pa.array(list(self.head), pa.binary())))
        return pc.index_in(words, options=known).fill_null(-1).to_numpy().astype(np.int64)

    def ids(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        return self.ids_of(pa.array(list(chain.from_iterable(docs)), pa.binary()), np.array([len(x) for x in docs], np.int64))

    def ids_of(self, words: pa.Array, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(context id, class, rank or -1, document) of each token, an end after each document, and the tail words in order."""
        n, row = len(self.head), n_words + 1
        rank = np.full(len(words) + len(row), -2, np.int64)
        at_word = np.ones(len(rank), bool)
        at_word[np.cumsum(row) - 1] = False
        rank[at_word] = found = self.ranks(words)
        tail = words.filter(pa.array(found < 0))
        own = rank.copy()
        cls = np.full(len(rank), END, np.int64)
        known = rank >= 0
        cls[known] = self.classes[rank[known]]
        cls[rank == -1] = [_GROUPS[w] for w in pc.binary_slice(tail, -2).to_pylist()]
        own[~known] = n + cls[~known]
        return own, cls, rank, np.repeat(np.arange(len(row)), row), tail

    def histories(self, own: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The hashes of each token's histories; before a document stand its starts, id 2**40."""
        one, two = np.full(len(own), 1 << 40, np.uint64), np.full(len(own), 1 << 40, np.uint64)
        same1, same2 = row[1:] == row[:-1], row[2:] == row[:-2]
        one[1:][same1] = own[:-1][same1]
        two[2:][same2] = own[:-2][same2]
        out = np.empty((KINDS, len(own)), np.uint64)
        out[0] = (one + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out[1] = (two + np.uint64(5)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return out

    def rows(self, h: np.ndarray) -> np.ndarray:
        """The rows of class weights of each token, of its histories' hashes."""
        n = len(self.weights) // KINDS
        return (h >> np.uint64(65 - n.bit_length())).astype(np.int64) + n * np.arange(KINDS)[:, None]

    def features(self, own: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.rows(self.histories(own, row))

    def decisions(self, own: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token, turn 1 or -1, places in ``inner``, log odds of a turn 1) of every decision on the tokens' paths."""
        first, n = self.at[own], self.at[own + 1] - self.at[own]
        token = np.repeat(np.arange(len(own)), n)
        k = np.arange(len(token)) + np.repeat(first - np.cumsum(n) + n, n)
        node = self.nodes[k]
        mark = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        places = np.empty((INNER_KINDS, len(token)), np.int64)
        shift = np.uint64(65 - len(self.inner).bit_length())
        for j in range(INNER_KINDS):
            x = (h[j] ^ (h[j] >> np.uint64(32)))[token]
            x ^= mark
            x *= np.uint64(0x9E3779B97F4A7C15)
            places[j] = x >> shift
        z = self.odds[node]
        for j in range(INNER_KINDS):
            z += self.inner[places[j]]
        return token, self.turns[k], places, z

    def probabilities(self, f: np.ndarray) -> np.ndarray:
        out = np.empty((f.shape[1], CLASSES), np.float32)
        for at in range(0, len(out), CACHED):
            z = out[at : at + CACHED]
            np.take(self.weights, f[0, at : at + CACHED], axis=0, out=z, mode="clip")
            z += self.weights[f[1, at : at + CACHED]]
            z += self.bias
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(axis=1, keepdims=True)
        return out


_GROUPS = _Groups()


def _gathered(column: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(first row, words, words of each row) in runs of some ``RUN`` bytes."""
    for first, _, raw, off in pieces(column, RUN):
        yield first, *_words(raw, off)


def group_sums(g: np.ndarray, order: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of the rows ``g[order]`` between consecutive ``cut``: place by place over all groups, long groups' rests in one product."""
    size = np.diff(np.append(cut, len(order)))
    total = g[order[cut]]
    for k in range(1, 8):
        more = np.flatnonzero(size > k)
        if not len(more):
            return total
        total[more] += g[order[cut[more] + k]]
    long = np.flatnonzero(size > 8)
    if len(long):
        rest = size[long] - 8
        group = np.repeat(np.arange(len(long)), rest)
        place = np.arange(len(group)) + np.repeat(cut[long] + 8 - (np.cumsum(rest) - rest), rest)
        member = np.zeros((len(long), len(group)), g.dtype)
        member[group, np.arange(len(group))] = 1
        total[long] += member @ g[order[place]]
    return total


def _moves(f: np.ndarray, n: np.ndarray, move: np.ndarray) -> pa.RecordBatch:
    from pyspark import TaskContext

    task = pa.array(np.full(len(f), TaskContext.get().partitionId(), np.int32))
    return pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), task, pa.array([x.tobytes() for x in n], pa.binary()), pa.array([x.tobytes() for x in move], pa.binary())], names=["f", "task", "n", "move"])


def _moved(first: int, now: np.ndarray, start: np.ndarray, met: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The moves of the slabs that tokens met, numbered from ``first``."""
    now, start = now.reshape(-1, SLAB), start.reshape(-1, SLAB)
    met = met.reshape(len(now), -1)
    slabs = met.any(axis=1).nonzero()[0]
    for part in np.array_split(slabs, max(1, len(slabs) // 64)):
        if len(part):
            yield _moves(first + part, np.minimum(met[part], 65504).astype("<f2"), (now[part] - start[part]).astype("<f2"))


def _steps(shared, rate: float):
    """Gradient steps of one task; yields (slab, task, tokens and moves as float16, tokens 65,504 at most) of the slabs it touched: first those of
    class weights, with a number of tokens for each row, then those of decision weights, with a number for each weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        start = m.weights
        w = m.weights = start.copy()
        inner_start = m.inner
        inner = m.inner = inner_start.copy()
        try:
            energy = np.full(len(w), 1e-2, np.float32)
            touched = np.zeros(len(w), np.int64)
            inner_touched, last = np.zeros(len(inner), np.float32), np.zeros(len(inner), np.int32)
            bits = (BATCH - 1).bit_length()
            for b in batches:
                for _, words, n_words in _gathered(b.column(0)):
                    own, cls, _, row, _ = m.ids_of(words, n_words)
                    h = m.histories(own, row)
                    f = m.rows(h)
                    for at in range(0, len(cls), BATCH):
                        _, turn, places, z = m.decisions(own[at : at + BATCH], h[:, at : at + BATCH])
                        e = turn / -(1 + np.exp(np.clip(turn * z, -30, 30)))
                        for x in places:
                            # all decisions at one place are summed at the last of them
                            last[x] = np.arange(len(x), dtype=np.int32)
                            at_last = last[x]
                            n = np.bincount(at_last, minlength=len(x))
                            own_place = np.flatnonzero(n)
                            total, x = np.bincount(at_last, e, len(x))[own_place].astype(np.float32), x[own_place]
                            inner_touched[x] = n = inner_touched[x] + n[own_place].astype(np.float32)
                            inner[x] -= INNER_RATE * total / np.sqrt(n + 1)
                        part = f[:, at : at + BATCH]
                        g = m.probabilities(part)
                        g[np.arange(part.shape[1]), cls[at : at + BATCH]] -= 1
                        for k in range(KINDS):
                            # rows and positions in one number: such a sort is vectorised
                            key = np.sort((part[k] << bits) | np.arange(part.shape[1]))
                            order, ids = key & ((1 << bits) - 1), key >> bits
                            cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                            rows, total = ids[cut], group_sums(g, order, cut)
                            energy[rows] += np.einsum("ij,ij->i", total, total) / CLASSES * 4
                            w[rows] -= total * (rate / np.sqrt(energy[rows]))[:, None]
                            touched[rows] += np.diff(np.append(cut, len(ids)))
            yield from _moved(0, w, start, touched)
            yield from _moved(len(w) // PER_SLAB, inner, inner_start, inner_touched)
        finally:
            m.weights, m.inner = start, inner_start

    return run


def _averages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token-weighted mean move of each weight; tasks are added up in order, so that reruns agree to the last bit."""
    total: dict[int, np.ndarray] = {}
    weight: dict[int, np.ndarray] = {}
    for b in batches:
        for f, _, n, v in zip(*(c.to_pylist() for c in b.columns)):
            n = np.frombuffer(n, "<f2").astype("<f4")
            v = np.frombuffer(v, "<f2").astype("<f4").reshape(len(n), -1) * n[:, None]
            if f in total:
                total[f] += v
                weight[f] += n
            else:
                total[f], weight[f] = v, n
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([(v / np.maximum(weight[f], 1)[:, None]).astype("<f4").tobytes() for f, v in total.items()], pa.binary())], names=["f", "move"])


def trees(mass: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, nodes, turns, log odds, below): a Huffman tree over the leaves of each class above END. Leaf i has ``mass`` i, and the
    decisions of its path that enough tokens meet are ``nodes`` and ``turns`` between its two starts; ``below`` is the natural log of its share of
    what hangs from the last.
    At zero weights a path's probability is its leaf's share of the class."""
    paths: list[list] = [[] for _ in mass]
    below, size, least = np.zeros(len(mass)), [], LEAST_MET * mass.sum()
    odds, count = [], 0
    leaves = np.flatnonzero(classes > END)
    order = leaves[np.argsort(classes[leaves], kind="stable")]
    for own in np.split(order, np.flatnonzero(np.diff(classes[order])) + 1) if len(order) else []:
        heap = [(float(mass[i]), int(i)) for i in own]
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[1]], up[b[1]] = (count, -1), (count, 1)
            odds.append(np.log(b[0] / a[0]))
            heapq.heappush(heap, (a[0] + b[0], len(mass) + count))
            size.append(a[0] + b[0])
            count += 1
        for i in own:
            x, path = int(i), []
            while x in up:
                path.append(up[x])
                x = len(mass) + up[x][0]
            k = next((k for k, (node, _) in enumerate(path) if size[node] >= least), len(path))
            if k:
                below[i] = np.log(mass[i] / size[path[k - 1][0]])
            paths[i] = path[k:]
    at = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int64)
    flat = np.array([x for p in paths for x in p], np.int32).reshape(-1, 2)
    return at, flat[:, 0].copy(), flat[:, 1].astype(np.float32), np.array(odds, np.float32), below


def _sized(n: int, bounds: tuple[int, int]) -> int:
    return min(max(1 << max(n - 1, 0).bit_length(), bounds[0]), bounds[1])


def buckets(tokens: int) -> int:
    """Hash buckets of each feature kind of the class."""
    return max(_sized(tokens, BUCKETS), _sized(tokens >> 10, (BUCKETS[0], MOST_BUCKETS)))


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, c long) over all rows of the one text column: partial counts in the tasks, then one shuffle of distinct words."""
    return texts.mapInArrow(lean(_count), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """About the ``most`` most frequent words of (word, c), never over: a histogram of counts (32 steps a doubling, some 2,000 rows at most)
    gives the step from which all are taken; of the step below, words whose hash is low fill what is left. No word table is sorted."""
    step = F.floor(F.log2("c") * 32)
    rows = counts.groupBy(step.alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).collect()
    taken, lowest, share = 0, None, 1 << 20
    for r in rows:
        lowest = r.k
        if taken + r.n > most:
            # the hashes' share of a step strays by the root of its size: four times that stays free
            left = most - taken
            share = max(0, int((left - 4 * left**0.5) / r.n * (1 << 20)))
            break
        taken += r.n
    if lowest is None:
        return counts.limit(0)
    return counts.where((step > lowest) | ((step == lowest) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share)))


def train(docs: DataFrame, rounds: int = ROUNDS, rate: float = 0.6, text_col: str = "text", where: Column | None = None) -> tuple[Model, DataFrame]:
    """The model and the table of all counts, from every row of ``docs`` that ``where`` admits."""
    spark = docs.sparkSession
    ship(spark)
    own = (docs if where is None else docs.where(where)).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ends = own.count()
    counts = written(count_words(own), "counts")
    group = F.lit(SINGLE + 1) + F.pmod(F.xxhash64(F.expr("right_two")), F.lit(GROUPS)).cast("int")
    stats = counts.withColumn("right_two", F.expr("substring(word, -2, 2)")).groupBy(group.alias("g")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    top = frequent(counts, HEAD).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words, c = top["word"].to_pylist(), top["c"].to_numpy().astype(np.int64)
    tokens_in, distinct_in = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in stats:
        tokens_in[r.g], distinct_in[r.g] = r.n, r.v
    total, distinct = int(tokens_in.sum()) + ends, int(distinct_in.sum()) + (ends > 0)
    classes = np.array([_GROUPS[w[-2:]] for w in words], np.int64)
    for i, w in enumerate(words[:SINGLE]):
        tokens_in[classes[i]] -= c[i]
        distinct_in[classes[i]] -= 1
        classes[i] = i
    seen = tokens_in.astype(float)
    seen[: min(SINGLE, len(c))] = c[:SINGLE]
    seen[END] = ends
    bias = np.log((seen + SMOOTH) / (seen + SMOOTH).sum()).astype(np.float32)
    # what the head does not hold of each class is one leaf
    tail_tokens, tail_distinct = tokens_in.copy(), distinct_in.copy()
    rest = classes > END
    tail_tokens -= np.bincount(classes[rest], c[rest], CLASSES).astype(np.int64)
    tail_distinct -= np.bincount(classes[rest], minlength=CLASSES)
    mass = np.concatenate([c + SMOOTH, tail_tokens + SMOOTH * (tail_distinct + 1.0)])
    tree = trees(mass, np.concatenate([classes, np.arange(CLASSES)]))
    weights = np.zeros((KINDS * buckets(total), CLASSES), np.float32)
    model = Model({w: i for i, w in enumerate(words)}, c, classes, weights, bias, total, distinct, ends, tail_tokens, tail_distinct, np.zeros(_sized(4 * total, INNER), np.float32), *tree)
    # few long tasks take more steps each and send fewer moves
    parts = own.rdd.getNumPartitions()
    rows = own.coalesce(max(spark.sparkContext.defaultParallelism, parts // 4))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k)
        moves = part.mapInArrow(lean(_steps(shared, rate)), "f int, task int, n binary, move binary").repartition("f").sortWithinPartitions("f", "task").mapInArrow(lean(_averages), "f int, move binary").toArrow()
        model.weights, model.inner = model.weights.copy(), model.inner.copy()
        for f, v in zip(moves["f"].to_pylist(), moves["move"]):
            own_slabs = len(model.weights) // PER_SLAB
            held = model.weights.reshape(-1, SLAB)[f] if f < own_slabs else model.inner.reshape(-1, SLAB)[f - own_slabs]
            held += np.frombuffer(v.as_buffer(), "<f4")
        shared.destroy(blocking=True)
        # Spark deletes a round's shuffled moves once nothing on the driver refers to them any more
        del moves
        gc.collect()
        spark._jvm.System.gc()
    return model, counts


_SCORED = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                        T.StructField("base", T.DoubleType()), T.StructField("own", T.DoubleType()), T.StructField("tail", T.ArrayType(T.BinaryType()))])


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m: Model = shared.value
        at_row = TaskContext.get().partitionId() << 36
        base_all = np.log10(m.tokens + SMOOTH * (m.distinct + 1))
        # per class: log10 of what a count of its tail is divided by
        inner = np.log10(m.tail_tokens + SMOOTH * (m.tail_distinct + 1.0))
        logc = np.log10(m.counts + SMOOTH)
        end = np.log10(m.ends + SMOOTH)
        for b in batches:
            for first, words, n_words in _gathered(b.column(1)):
                own, cls, rank, row, tail = m.ids_of(words, n_words)
                h = m.histories(own, row)
                f = m.rows(h)
                lp, way = np.empty(len(cls)), np.empty(len(cls))
                for at in range(0, len(cls), BATCH):
                    p = m.probabilities(f[:, at : at + BATCH])
                    lp[at : at + BATCH] = p[np.arange(len(p)), cls[at : at + BATCH]]
                    token, turn, _, z = m.decisions(own[at : at + BATCH], h[:, at : at + BATCH])
                    way[at : at + BATCH] = np.bincount(token, np.logaddexp(0, -turn * z), len(p)) - m.below[own[at : at + BATCH]]
                known = rank >= 0
                lp = np.log10(np.maximum(lp, 1e-30)) - way / np.log(10) - np.where(rank == -1, inner[cls], 0)
                count = np.zeros(len(cls))
                count[known] = logc[rank[known]]
                base = count - base_all
                base[rank == -2] += end
                n = len(n_words)
                tails = np.bincount(row[rank == -1], minlength=n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(tails)]).astype(np.int32)), tail)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at_row + np.arange(n)), b.column(0).slice(first, n), pa.array(np.bincount(row, minlength=n)),
                     pa.array(np.bincount(row, known | ((rank == -2) & (m.ends > 0)), n).astype(np.int64)), pa.array(np.bincount(row, base, n)), pa.array(np.bincount(row, lp, n)), lists],
                    names=_SCORED.names,
                )
                at_row += n

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Null texts read as empty: one end token. Null ids and repeated rows come back as they are; an empty table gives no rows; extra
    columns are not read. Rows are numbered once and written, so a lost executor cannot renumber them. Only words outside the head are
    shuffled, by word, to meet their counts.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = T.StructType([T.StructField(f.name, docs.schema[id_col].dataType) if f.name == "doc_id" else f for f in _SCORED])
    shared = spark.sparkContext.broadcast(model)  # HEAD words and the bounded weights
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    done = written(rows.mapInArrow(lean(_scores(shared)), schema), "scored")
    tail = done.select("row", F.explode("tail").alias("word")).join(counts, "word", "left")
    late = tail.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("late"), F.count("c").alias("seen"))
    out = done.drop("tail").join(late, "row", "left")
    add, seen = F.coalesce("late", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + seen).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + add).alias("base_score"), (F.col("own") + add).alias("score"))
