"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over hashed words; each later model also sees the earlier categories'
probabilities. While fitting, those probabilities are out-of-fold predictions, so that a later model learns from what an earlier one
says of documents it has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import lean, ship
from ._words import hashes, lower, mix, pieces, row_of, split
from .ranking import labelled_sample

#: Labelled rows a fit reads at most, the smallest xxhash64(doc_id) first, and the size of the hashed feature space.
FIT_ROWS, BUCKETS, FOLDS = 8_000, 1 << 18, 3
#: Lengths in bytes of the beginnings of words that count as features of their own, and how often a word or beginning must come in a text to
#: count once more: chance brings a stem once, a subject brings it again.
STEMS, OFTEN = (4, 6, 8), (2, 4)
#: A word takes part if its log-likelihood ratio (G-test) with the label is at least this.
LEAST_GAIN = 12.0
#: Categories of the labels table in chain order.
CHAIN = ("low_quality", "toxic")
_EDGE = np.ones(256, bool)
_EDGE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row offsets, buckets): the distinct hashed words of each text, letters and digits with A-Z in lower case, the distinct beginnings of
    STEMS bytes of its longer words, which inflected forms of one stem share, and those of both that come OFTEN times or more."""
    parts, sizes = [], []
    for a, b, raw, off in pieces(column):
        raw = lower(raw)
        starts, ends, woff = split(raw, off, _EDGE)
        row = row_of(woff).astype(np.uint64) << np.uint64(32)
        keys = [row | (hashes(raw, starts, ends) % np.uint64(BUCKETS))]
        for k, n in enumerate(STEMS, 1):
            long = np.flatnonzero(ends - starts > n)
            stem = mix(hashes(raw, starts[long], starts[long] + n) + np.uint64(k))
            keys.append(row[long] | (stem % np.uint64(BUCKETS)))
        key, times = np.unique(np.concatenate(keys), return_counts=True)
        low = np.uint64(0xFFFFFFFF)
        more = [(key[times >= n] & ~low) | (mix((key[times >= n] & low) + np.uint64(n << 40)) % np.uint64(BUCKETS)) for n in OFTEN]
        key = np.unique(np.concatenate([key, *more]))
        sizes.append(np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=b - a))
        parts.append((key & np.uint64(0xFFFFFFFF)).astype(np.int32))
    n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(n)]), np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _sums(off: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


class Linear:
    """Logistic regression on the presence of words and of repeated ones and a few dense columns. A word's weight is scaled by its log-odds between the labels
    in the rows it is fitted on, so that rare and common words meet on one scale."""

    def __init__(self, off, idx, dense, y, steps: int = 60, l2: float = 2e-4):
        n, rate = max(len(y), 1), np.mean(y) if len(y) else 0.0
        row = np.repeat(np.arange(len(y)), np.diff(off))
        seen = np.bincount(idx, minlength=BUCKETS)
        hit = np.bincount(idx, y[row], BUCKETS)
        odds = np.log((hit + 0.5) / (np.sum(y) + 1)) - np.log((seen - hit + 0.5) / (np.sum(1 - y) + 1))
        # only words whose log-likelihood ratio against independence says that they matter
        cells = np.array([hit, seen - hit, np.sum(y) - hit, np.sum(1 - y) - seen + hit])
        means = np.array([seen * rate, seen * (1 - rate), (n - seen) * rate, (n - seen) * (1 - rate)])
        gain = 2 * (cells * np.log(np.maximum(cells, 1e-9) / np.maximum(means, 1e-9))).sum(0)
        self.scale = np.where(gain >= LEAST_GAIN, np.clip(odds, -5, 5), 0.0)
        self.w, self.dense, self.bias = np.zeros(BUCKETS), np.zeros(dense.shape[1]), float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
        value = self.scale[idx]
        use = value != 0
        r, i, v = row[use], idx[use], value[use]
        norm = 1.0
        first, second = np.zeros(BUCKETS), np.zeros(BUCKETS)
        fd, sd = np.zeros(dense.shape[1] + 1), np.zeros(dense.shape[1] + 1)
        for t in range(1, steps + 1):
            z = np.bincount(r, v * self.w[i], len(y)) * norm + dense @ self.dense + self.bias
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            g = np.bincount(i, v * e[r], BUCKETS) * norm + l2 * self.w
            gd = np.concatenate([dense.T @ e, [e.sum()]])
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            fd, sd = 0.9 * fd + 0.1 * gd, 0.99 * sd + 0.01 * gd * gd
            a, b = 1 - 0.9**t, 1 - 0.99**t
            self.w -= 0.1 * (first / a) / (np.sqrt(second / b) + 1e-9)
            step = 0.1 * (fd / a) / (np.sqrt(sd / b) + 1e-9)
            self.dense -= step[:-1]
            self.bias -= step[-1]
        self.weight = (self.w * self.scale).astype(np.float32)
        del self.w, self.scale

    def __call__(self, off, idx, dense) -> np.ndarray:
        z = _sums(off, self.weight[idx].astype(float)) + dense @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _rows(off, idx, pick):
    n = np.diff(off)[pick]
    parts = [idx[off[i] : off[i + 1]] for i in pick]
    return np.concatenate([[0], np.cumsum(n)]), np.concatenate(parts) if parts else idx[:0]


def fit_chain(off: np.ndarray, idx: np.ndarray, labels: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """One model for each column of ``labels``, in order; the k-th takes k dense columns. Rows go to folds by position."""
    n = len(labels)
    dense = np.zeros((n, 0))
    fold = np.arange(n) % folds
    models = []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        models.append(Linear(off, idx, dense, y))
        if k + 1 < labels.shape[1]:
            out = np.zeros(n)
            for f in range(folds):
                a, b = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                out[b] = Linear(*_rows(off, idx, a), dense[a], y[a])(*_rows(off, idx, b), dense[b])
            dense = np.column_stack([dense, out])
    return models


def distinct(x: list[np.ndarray]) -> list[int]:
    """Positions of word sets of which no near copy stands before: copies of one text would vouch for each of its words. Sets that
    share one of three groups of eight MinHashes count as copies."""
    seeds = np.random.default_rng(5).integers(1, 1 << 63, 24, dtype=np.uint64)
    seen: set[tuple] = set()
    out = []
    for i, v in enumerate(x):
        if len(v):
            low = [int(mix(v.astype(np.uint64) ^ s).min()) for s in seeds]
            keys = {(k, *low[8 * k : 8 * k + 8]) for k in range(3)}
            if len(v) >= 8 and keys & seen:
                continue
            seen |= keys
        out.append(i)
    return out


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        off, idx = buckets(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([idx[x:y].tobytes() for x, y in zip(off, off[1:])], pa.binary())], names=["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], bound: int = FIT_ROWS) -> list[Linear]:
    """Fit the chain on at most ``bound`` labelled rows; ``labels`` has doc_id and a 0/1 column for each category. Rows with a null
    in any of them are left out. Without any labelled row every probability is one half's lower neighbour: nothing is flagged."""
    ship(docs.sparkSession)
    code = sum((F.col(c).cast("int") * (1 << k) for k, c in enumerate(categories)), F.lit(0))
    rows = labelled_sample(docs, labels.select("doc_id", code.alias("y")), "y", bound).select("doc_id", "text", F.col("y").cast("int").alias("y"))
    got = rows.mapInArrow(lean(_sample), T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())])).toArrow().sort_by("doc_id")
    y = got["y"].to_numpy().astype(np.int64)
    x = [np.frombuffer(v, np.int32) for v in got["x"].to_pylist()]
    first = distinct(x)
    x, y = [x[i] for i in first], y[first]
    off = np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int64)
    return fit_chain(off, np.concatenate(x) if x else np.zeros(0, np.int32), np.column_stack([(y >> k) & 1 for k in range(len(categories))]))


def predict(docs: DataFrame, models: list[Linear], categories: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category> double ...) of every row, over whole texts, without a shuffle. Null texts read as empty ones; null ids
    and repeated rows come back as they are; extra columns are not read."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, idx = buckets(b.column(1))
            dense = np.zeros((b.num_rows, 0))
            for m in shared.value:
                dense = np.column_stack([dense, m(off, idx, dense)])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(dense[:, k])) for k in range(dense.shape[1]))], names=["doc_id", *(f"p_{c}" for c in categories)])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(f"p_{c}", T.DoubleType()) for c in categories)])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)


def chain_labels(labels: DataFrame) -> DataFrame:
    """The labels table as CHAIN columns."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic) of the documents whose toxicity is at least ``least``."""
    models = train(docs, chain_labels(labels), CHAIN)
    return predict(docs, models, CHAIN).where(F.col("p_toxic") >= least)
