"""Substring removal: passages of WINDOW words or more that a document with a smaller id also holds, found by automata over recurring phrases.

1. Confirm. The anchor of a window is the least hash of its PHRASE-word sequences, so equal windows have equal anchors and some one in 18
   positions is an anchor. Anchors of two or more documents are kept; only around them are whole windows compared, by anchor and a
   64-bit window hash together, and each that two documents hold is given to the smallest id. Runs of such windows, cut from that first document's
   text, are the recurring passages.
2. Compile. Documents go to shards of some SHARD bytes, and a passage goes to each shard that has one of its anchors. A shard compiles one
   Aho-Corasick automaton of its passages' anchor phrases, so its size follows the shard's own text and every text meets one automaton.
3. Stream. The automaton finds each occurrence of a phrase in the shard's texts; the words on both sides are compared with the passage's
   words, and a stretch of WINDOW equal words or more is removed if the passage's document has a smaller id. Hashes only choose what is compared.

Anchors and windows are summed by key with map-side minima, so a passage of a third of all documents is one row a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._store import discard, lean, ship, written

WINDOW = 50
PHRASE = 16
#: Bytes of text that one automaton reads, about.
SHARD = 4 << 20
#: Recurring anchors are broadcast (32 MB) up to this number, counted first; beyond it they are joined to the documents.
MOST_BROADCAST = 4_000_000
SIDE = WINDOW - PHRASE


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive word hashes."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _words._power("p", len(h)), out=total[1:])
    return _words.mix((total[n:] - total[:-n]) * _words._power("i", len(h) - n + 1))


def _least(g: np.ndarray, n: int) -> np.ndarray:
    """Place of the least of every ``n`` consecutive values, the leftmost of equal ones."""
    at, span = np.arange(len(g)), 1
    while span < n:
        step = min(span, n - span)
        a, b = at[:-step], at[step:]
        at, span = np.where(g[a] <= g[b], a, b), span + step
    return at


class _Piece:
    """Words and windows of some whole rows: ``start`` the first word of each window, ``row`` its row, ``anchor`` and ``hash`` its keys."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.starts, self.ends, self.first = _words.split(raw, off)
        n = len(self.starts)
        if n < WINDOW:
            self.start = self.row = np.zeros(0, np.int64)
            self.anchor = self.hash = np.zeros(0, np.int64)
            return
        h, row = _words.hashes(raw, self.starts, self.ends), _words.row_of(self.first)
        self.start = np.flatnonzero(row[: n - WINDOW + 1] == row[WINDOW - 1 :])
        self.row = row[self.start]
        g = _grams(h, PHRASE)
        self.place = _least(g, SIDE + 1)[self.start]
        self.anchor = g[self.place].view(np.int64)
        self.hash = _grams(h, WINDOW)[self.start].view(np.int64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Places where some column differs from the place before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(out)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, raw, off in _words.pieces(b.column("text")):
            p = _Piece(raw, off)
            if len(p.start):
                at = _changes(p.anchor, p.row)
                yield pa.RecordBatch.from_arrays([pa.array(p.anchor[at]), b.column("doc_id").slice(lo, hi - lo).take(pa.array(p.row[at]))], names=["anchor", "doc_id"])


def _recurring(keyed: DataFrame, *keys: str) -> DataFrame:
    """Keys that documents of two ids hold, with the smallest; rows without an id count as one more document after all others."""
    sums = keyed.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("open"))
    return sums.where("first < last OR (open AND first IS NOT NULL)").select(*keys, "first")


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


STATE = "doc_id long, n_words long, kept_sha256 string, text string, anchors array<bigint>"


def _state(known):
    """Rows without a recurring anchor are finished here; the others keep their text and list their recurring anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.frombuffer(known.value, np.int64) if known else None
        for b in batches:
            lists = None if known else b.column("anchors")
            for lo, hi, raw, off in _words.pieces(b.column("text")):
                p, data = _Piece(raw, off), raw.tobytes()
                ends = np.searchsorted(p.row, np.arange(hi - lo + 1))
                sizes, shas, texts, found = [], [], [], []
                for i in range(hi - lo):
                    own = np.unique(p.anchor[ends[i] : ends[i + 1]])
                    if known:
                        at = np.searchsorted(every, own)
                        own = own[every[np.minimum(at, len(every) - 1)] == own] if len(every) else own[:0]
                    else:
                        own = np.array(lists[lo + i].as_py() or [], np.int64)
                    sizes.append(int(p.first[i + 1] - p.first[i]))
                    found.append(own if len(own) else None)
                    texts.append(data[off[i] : off[i + 1]].decode("utf-8", "replace") if len(own) else None)
                    shas.append(None if len(own) else _digest(_cut_words(data[off[i] : off[i + 1]])))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string()), pa.array(found, pa.list_(pa.int64()))],
                    names=["doc_id", "n_words", "kept_sha256", "text", "anchors"],
                )

    return run


def _cut_words(data: bytes) -> list[bytes]:
    """Words of a text in bytes; bytes.split() cuts at these six characters alone."""
    return data.split()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("anchors")
        for lo, hi, raw, off in _words.pieces(b.column("text")):
            p = _Piece(raw, off)
            cuts = np.searchsorted(p.row, np.arange(hi - lo + 1))
            own = np.concatenate([np.zeros(0, np.int64), *(c + np.flatnonzero(np.isin(p.anchor[c:d], lists[lo + i].values.to_numpy())) for i, (c, d) in enumerate(zip(cuts, cuts[1:])))]).astype(np.int64)
            if len(own):
                ids = b.column("doc_id").slice(lo, hi - lo).take(pa.array(p.row[own]))
                yield pa.RecordBatch.from_arrays([pa.array(p.anchor[own]), pa.array(p.hash[own]), ids], names=["anchor", "window", "doc_id"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the listed windows of each text, a window's first occurrence only: their text and their anchors."""
    for b in batches:
        lists = b.column("windows")
        for lo, hi, raw, off in _words.pieces(b.column("text")):
            p, data = _Piece(raw, off), raw.tobytes()
            cuts, out = np.searchsorted(p.row, np.arange(hi - lo + 1)), []
            for i, (c, d) in enumerate(zip(cuts, cuts[1:])):
                once = np.zeros(d - c, bool)
                once[np.unique(p.hash[c:d], return_index=True)[1]] = True
                at = c + np.flatnonzero(once & np.isin(p.hash[c:d], lists[lo + i].values.to_numpy()))
                for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
                    s, e = p.start[run[0]], p.start[run[-1]] + WINDOW
                    out.append((lo + i, data[p.starts[s] : p.ends[e - 1]].decode("utf-8", "replace"), np.unique(p.anchor[run])))
            if out:
                rows, texts, anchors = zip(*out)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), pa.array(texts, pa.string()), pa.array(list(anchors), pa.list_(pa.int64()))], names=["first", "text", "anchors"])


class _Automaton:
    """Aho-Corasick automaton of the anchor phrases of some passages, and the comparison around its hits."""

    def __init__(self, firsts: list[int], texts: list[str]):
        import ahocorasick

        self.auto, self.ids, places = ahocorasick.Automaton(), {}, []
        gap, parts, owner, at = np.full(WINDOW, -2, np.int64), [np.full(WINDOW, -2, np.int64)], [np.zeros(WINDOW, np.int64)], WINDOW
        for first, text in zip(firsts, texts):
            data = text.encode()
            words, p = _cut_words(data), _Piece(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            for i in np.unique(p.place).tolist():
                phrase = (b" " + b" ".join(words[i : i + PHRASE]) + b" ").decode("latin-1")
                k = self.auto.get(phrase, None)
                if k is None:
                    self.auto.add_word(phrase, k := len(places))
                    places.append([])
                places[k].append(at + i)
            parts += [np.array([self.ids.setdefault(w, len(self.ids)) for w in words], np.int64), gap]
            owner.append(np.full(len(words) + WINDOW, first, np.int64))
            at += len(words) + WINDOW
        self.words, self.owner = np.concatenate(parts), np.concatenate(owner)
        self.places = [np.array(x, np.int64) for x in places]
        if places:
            self.auto.make_automaton()

    def removed(self, words: list[bytes], doc_id: int | None) -> np.ndarray:
        """Which of a document's words go."""
        n = len(words)
        marks = np.zeros(n + 2 * WINDOW + 1, np.int64)
        if not self.places or n < WINDOW:
            return marks[:n].astype(bool)
        own = np.full(n + 2 * WINDOW, -1, np.int64)
        own[WINDOW : WINDOW + n] = np.fromiter((self.ids.get(w, -1) for w in words), np.int64, n)
        after = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        ends, which = [], []
        for end, k in self.auto.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
            ends.append(end)
            which.append(k)
            if len(ends) >= 20_000:
                self._mark(marks, own, after, ends, which, doc_id)
                ends, which = [], []
        self._mark(marks, own, after, ends, which, doc_id)
        return np.cumsum(marks)[WINDOW : WINDOW + n] > 0

    def _mark(self, marks, own, after, ends, which, doc_id) -> None:
        x = np.searchsorted(after, np.array(ends, np.int64)) - PHRASE + 1 + WINDOW
        for a in range(0, len(x), 2_000):
            places = [self.places[k] for k in which[a : a + 2_000]]
            xs = np.repeat(x[a : a + 2_000], [len(p) for p in places])
            ys = np.concatenate(places)
            if doc_id is not None:
                lower = self.owner[ys] < doc_id
                xs, ys = xs[lower], ys[lower]
            for c in range(0, len(xs), 20_000):
                self._extend(marks, own, xs[c : c + 20_000], ys[c : c + 20_000])

    def _extend(self, marks, own, x, y) -> None:
        side = np.arange(1, SIDE + 1)
        left = np.logical_and.accumulate(own[x[:, None] - side] == self.words[y[:, None] - side], axis=1).sum(axis=1)
        right = np.logical_and.accumulate(own[x[:, None] + PHRASE - 1 + side] == self.words[y[:, None] + PHRASE - 1 + side], axis=1).sum(axis=1)
        held = left + PHRASE + right >= WINDOW
        np.add.at(marks, (x - left)[held], 1)
        np.add.at(marks, (x + PHRASE + right)[held], -1)


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _stream(docs: pa.Table, passages: pa.Table) -> pa.Table:
    """One shard: compile the automaton of its passages, then send its texts through."""
    auto = _Automaton(passages.column("first").to_pylist(), passages.column("text").to_pylist())
    rows = []
    for doc_id, text in zip(docs.column("doc_id"), docs.column("text")):
        words, doc_id = _cut_words(text.as_py().encode()), doc_id.as_py()
        gone = auto.removed(words, doc_id)
        kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
        rows.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
    return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())})


def _shards(docs: DataFrame, most_broadcast: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, passages, routes): the documents with what concerns them, the confirmed passages and (shard, pid) pairs."""
    spark = docs.sparkSession
    ship(spark)
    recurring = written(_recurring(docs.mapInArrow(lean(_anchors), "anchor long, doc_id long"), "anchor"), "anchors")
    if recurring.count() <= most_broadcast:
        known = spark.sparkContext.broadcast(np.sort(recurring.select("anchor").toPandas()["anchor"].to_numpy("int64")).tobytes())
        state = written(docs.mapInArrow(lean(_state(known)), STATE), "state")
    else:
        held = docs.select(F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("o"), F.xxhash64("text").alias("k")).alias("key"), "doc_id", "text")
        own = held.mapInArrow(lean(_keyed_anchors), "key struct<i:bigint,o:boolean,k:bigint>, anchor long").join(recurring, "anchor")
        lists = own.groupBy("key").agg(F.sort_array(F.collect_set("anchor")).alias("anchors"))
        state = written(held.join(lists, "key", "left").select("doc_id", "text", "anchors").mapInArrow(lean(_state(None)), STATE), "state")
    open_ = state.where("text IS NOT NULL")
    windows = open_.select("doc_id", "text", "anchors").mapInArrow(lean(_windows), "anchor long, window long, doc_id long")
    lists = _recurring(windows, "anchor", "window").groupBy("first").agg(F.collect_list("window").alias("windows"))
    cut = open_.select("doc_id", "text").join(lists, F.col("doc_id") == F.col("first")).select("doc_id", "text", "windows")
    passages = written(cut.mapInArrow(lean(_passages), "first long, text string, anchors array<bigint>").distinct().withColumn("pid", F.monotonically_increasing_id()), "passages")
    size = open_.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // SHARD))))
    state = state.withColumn("shard", F.when(F.col("text").isNotNull(), shard))
    held = state.where("text IS NOT NULL").select("shard", F.explode("anchors").alias("anchor")).distinct()
    routes = held.join(passages.select("pid", F.explode("anchors").alias("anchor")), "anchor").select("shard", "pid").distinct()
    discard(recurring)
    return state, passages, routes


def _keyed_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, raw, off in _words.pieces(b.column("text")):
            p = _Piece(raw, off)
            if len(p.start):
                at = _changes(p.anchor, p.row)
                yield pa.RecordBatch.from_arrays([b.column("key").slice(lo, hi - lo).take(pa.array(p.row[at])), pa.array(p.anchor[at])], names=["key", "anchor"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id long, n_words, n_removed, kept_sha256, kept) for every row: its words without those that a window of WINDOW words covers whose words
    also start in a document with a smaller id. ``kept`` is null where nothing was searched, the text being all kept.

    Words are runs without the six ASCII spaces, unchanged. A null text has no words. Rows with a null id come after all ids: they lose what any
    id holds and take nothing from others. Rows of one id never take from each other, so repeated rows come out alike. Within a document nothing
    repeats for this purpose. Empty tables give no rows; extra columns are not read. Ids are cast to long.
    A route is one shard and one passage, so a phrase that many different passages share sends them all to the shards that have it.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    state, passages, routes = _shards(docs, most_broadcast)
    sent = routes.join(passages.select("pid", "first", "text"), "pid").select(F.col("shard").alias("to"), "first", "text")
    texts = state.where("text IS NOT NULL").select("shard", "doc_id", "text")
    streamed = texts.groupBy("shard").cogroup(sent.groupBy("to")).applyInArrow(_stream, OUT)
    whole = state.where("text IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept"))
    return whole.union(streamed)


#: The same rows without ``kept``, by comparing all windows.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS x FROM s),
f AS (SELECT x, min(doc_id) AS first FROM h GROUP BY x),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN f USING (x) WHERE first < doc_id),
r AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(ps), 0) AS gone,
             CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(ps, j)) END AS kept FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(gone AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
