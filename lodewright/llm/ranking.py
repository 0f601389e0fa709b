"""Quality classifier: Bradley-Terry pairwise ranking of documents.

Each document gets a feature vector x. A preference pair (good, bad) adds log(1 + exp(-w . (x_good - x_bad))) to the loss; there is
no intercept, so w . x is a score on an open scale, and a quantile of the labelled documents' scores sets the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import lean, ship
from ._words import SPACE, hashes, lower, mix, per_row, pieces, row_of, split

#: Labelled rows a fit reads at most, the smallest xxhash64(doc_id) first.
FIT_ROWS = 20_000
PAIRS_PER_ROW = 24
FEATURES = (
    "log_words", "upper", "symbols", "marks", "digits", "other_bytes", "word_length", "ends_with_stop", "unique_words", "repeat_bigrams",
    "repeat_trigrams", "stutter", "repeat_lines", "lines_per_word", "capital_words", "bars",
)


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_UPPER, _SYMBOL, _MARK = _class(bytes(range(65, 91))), _class(b"#*$%&<>{}[]\\^~=_@"), _class(b"!?")
_DIGIT, _STOP, _BAR = _class(b"0123456789"), _class(b".,;:"), _class(b"|")
_NOT_LINE = np.zeros(256, bool)
_NOT_LINE[10] = True


def repeated(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks elements equal to another of their row, and elements equal to an earlier one."""
    key = mix(key + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    any_, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    any_[order[1:]] = same
    later[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text, over whole texts; null and empty texts get zeros."""
    out = np.zeros((len(column), len(FEATURES)))
    for a, b, raw, off in pieces(column):
        starts, ends, woff = split(raw, off)
        n = np.diff(woff)
        h = hashes(lower(raw), starts, ends)
        row = row_of(woff)
        chars = np.maximum(per_row(~SPACE[raw], off), 1)
        lead = (raw & 0xC0) != 0x80
        points = per_row(~SPACE[raw] & lead, off)
        c1 = np.uint64(0x9E3779B97F4A7C15)
        inside2, inside3 = row[:-1] == row[1:], row[:-2] == row[2:]
        two = np.where(inside2, h[:-1] * c1 + h[1:], 0)
        three = h[:-2] * c1 * c1 + h[1:-1] * c1 + h[2:] if len(h) > 2 else np.zeros(0, np.uint64)
        later1 = repeated(h, row)[1]
        later2, later3 = np.zeros(len(h), bool), np.zeros(len(h), bool)
        if len(h) > 1:
            later2[: len(two)] = repeated(two, row[:-1])[1] & inside2
        if len(h) > 2:
            later3[: len(three)] = repeated(three, row[:-2])[1] & inside3
        stutter = np.zeros(len(h), bool)
        stutter[1:] = inside2 & (h[1:] == h[:-1])
        ls, le, loff = split(raw, off, _NOT_LINE)
        lines = hashes(raw, ls, le) if len(ls) else np.zeros(0, np.uint64)
        dup_lines = repeated(lines, row_of(loff))[1]
        words = np.maximum(n, 1)
        nl = np.maximum(np.diff(loff), 1)
        x = out[a:b]
        for i, v in enumerate((
            np.log1p(n), per_row(_UPPER[raw], off) / chars, per_row(_SYMBOL[raw], off) / chars, per_row(_MARK[raw], off) / words,
            per_row(_DIGIT[raw], off) / chars, per_row(raw > 127, off) / chars, points / words / 10, per_row(_STOP[raw[ends - 1]], woff) / words,
            1 - per_row(later1, woff) / words, per_row(later2, woff) / words, per_row(later3, woff) / words, per_row(stutter, woff) / words,
            per_row(dup_lines, loff) / nl, np.diff(loff) / words, per_row(_UPPER[raw[starts]], woff) / words, per_row(_BAR[raw], off) / words,
        )):
            x[:, i] = v
        x[n == 0] = 0
    return out


@dataclass(frozen=True)
class Ranker:
    """Scores ``basis(x) . weights``; ``threshold`` and ``scale`` map a score to (0, 1), one half at the threshold."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return basis((x - self.mean) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) / self.scale, -30, 30)))


#: Ends of the ramps that let a linear score bend, in standard deviations.
KNOTS = (-2.0, -1.0, -0.5, 0.5, 1.0, 2.0)


def basis(z: np.ndarray) -> np.ndarray:
    """The standardised features, clipped, and a ramp above or below each knot."""
    z = np.clip(z, -6, 6)
    return np.concatenate([z, *(np.maximum(0, z - k) if k > 0 else np.maximum(0, k - z) for k in KNOTS)], axis=1)


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 300, seed: int = 7) -> Ranker:
    """Bradley-Terry weights from pairs (label 1, label 0) drawn with a fixed seed; the threshold is the score quantile that
    separates the labels with the fewest errors. With one label or none there are no pairs: every document then scores on the
    side of that label (label 1 if there is no label at all)."""
    mean, spread = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    b = basis((x - mean) / spread)
    w = np.zeros(b.shape[1] if len(x) else x.shape[1] * (1 + len(KNOTS)))
    if not len(good) or not len(bad):
        return Ranker(mean, spread, w, 1.0 if len(bad) else -1.0, 1.0)
    rng = np.random.default_rng(seed)
    many = max(len(good), len(bad)) * PAIRS_PER_ROW // 4
    g, d = np.resize(rng.permutation(good), many), np.resize(rng.permutation(bad), many)
    rng.shuffle(g)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        part = slice((t * 8192) % max(many - 8192, 1), None)
        diff = (b[g[part][:8192]] - b[d[part][:8192]]).astype(np.float32)
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = -(diff * p[:, None]).mean(0) + l2 * w
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        w = w - 0.1 * (1 - t / (steps + 1)) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    s = b @ w
    order = np.argsort(s, kind="stable")
    # errors if everything up to a rank is called 0
    wrong = np.concatenate([[len(bad)], len(bad) + np.cumsum(np.where(y[order] == 1, 1, -1))])
    best = np.flatnonzero(wrong == wrong.min())
    rank = best[len(best) // 2]
    quantile = np.clip(rank / len(s), 0, 1)
    cut = float(np.quantile(s, quantile))
    return Ranker(mean, spread, w, cut, max(float(np.std(s)) / 4, 1e-6))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, where=None) -> DataFrame:
    """At most ``bound`` labelled rows (doc_id, text, labels), those whose ids hash lowest. Null ids and labels are left out;
    an id labelled twice takes its lowest label, one of several texts the first in byte order (null if all are). ``bound`` is the documented limit of what a fit reads."""
    own = labels.select("doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if where is not None:
        own = own.where(where)
    own = own.groupBy("doc_id").agg(F.min(label).alias(label)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text")).select("doc_id", "text", label)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = features(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = FIT_ROWS, where=None) -> Ranker:
    """Fit on at most ``bound`` labelled rows; features are made on the executors, the driver sees ``bound`` short vectors."""
    ship(docs.sparkSession)
    rows = labelled_sample(docs, labels, label, bound, where).select("doc_id", "text", F.col(label).cast("int").alias("y"))
    got = rows.mapInArrow(lean(_feature_batches), T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())])).toArrow()
    got = got.sort_by("doc_id")
    x = np.frombuffer(b"".join(got["x"].to_pylist()), float).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy())


def held_out(id_col: str = "doc_id"):
    """True for ids whose crc32 of the decimal text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score double, predicted int) for every row: no shuffle. Null texts score as empty ones; repeated rows each come
    back; extra columns are not read."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(features(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)


def keep_good(docs: DataFrame, model: Ranker, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the model does not reject, all columns as they were; narrow, so text is not shuffled."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = model.score(features(b.column(b.schema.get_field_index(text_col)))) >= 0.5
            yield b.filter(pa.array(good))

    return docs.mapInArrow(lean(run), docs.schema)
