"""Token ids as wavelet-matrix shards.

A shard holds the token ids of consecutive documents (ascending id). Ids are renumbered by the shard's own alphabet, and the
sequence is stored as bit-planes: plane l holds bit l of every element in the order left by the planes before, zeros first.
With a count of ones at each BLOCK of bits, rank and select on planes give: the token at a position, the number of times a
token occurs in a range, and the place of its k-th occurrence, each touching one block per plane.

Bytes of a shard, little-endian: magic ``LWM2``; u64 tokens n, u32 alphabet size a, u32 planes p, u32 documents d, u32 blocks b per plane;
a x u32 alphabet; d x u64 ends of documents; then per plane u64 zeros, b x u32 ones before each block, (b + 1) x u64
offsets of compressed blocks; then u64 length and the blocks, each one Zstandard level 1 of BLOCK bits (np.packbits order).
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import lean, new_path, ship, written
from ._words import pieces

MAGIC = b"LWM2"
BLOCK = 1 << 16
_HEAD = struct.Struct("<4sQIIII")
#: Tokens after which a shard is closed; text of about this many bytes is held at a time.
SHARD_TOKENS, SHARD_BYTES = 1 << 20, 1 << 20
END_ID = 2


def build(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """Bytes of the shard of ``ids`` whose documents end at ``ends`` (exclusive)."""
    n = len(ids)
    present = np.zeros(int(ids.max(initial=0)) + 1, bool)
    present[ids] = True
    alphabet = np.flatnonzero(present).astype("<u4")
    code = np.zeros(len(present), np.uint32)
    code[alphabet] = np.arange(len(alphabet))
    seq = code[ids]
    if len(alphabet) <= 1 << 16:
        seq = seq.astype(np.uint16)
    planes = max(1, int(len(alphabet) - 1).bit_length()) if n else 0
    blocks, squeeze = -(-n // BLOCK), zstandard.ZstdCompressor(level=1).compress
    parts, data, at = [_HEAD.pack(MAGIC, n, len(alphabet), planes, len(ends), blocks), alphabet.tobytes(), ends.astype("<u8").tobytes()], [], 0
    for bit in range(planes - 1, -1, -1):
        ones = (seq & seq.dtype.type(1 << bit)) != 0
        up, packed = np.flatnonzero(ones), np.packbits(ones)
        before = np.searchsorted(up, np.arange(0, n, BLOCK))
        offsets = [at]
        for s in range(0, len(packed), BLOCK // 8):
            z = squeeze(packed[s : s + BLOCK // 8])
            data.append(z)
            at += len(z)
            offsets.append(at)
        parts += [struct.pack("<Q", n - len(up)), before.astype("<u4").tobytes(), np.array(offsets, "<u8").tobytes()]
        seq = np.concatenate([seq.take(np.flatnonzero(~ones)), seq.take(up)])
    return b"".join([*parts, struct.pack("<Q", at), *data])


class Shard:
    """Reads the bytes of one shard; blocks are decompressed as they are touched."""

    def __init__(self, blob: bytes):
        magic, self.n, a, self.planes, d, self.blocks = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = _HEAD.size
        self.alphabet = np.frombuffer(blob, "<u4", a, at)
        self.ends = np.frombuffer(blob, "<u8", d, at := at + 4 * a).astype(np.int64)
        at += 8 * d
        self.zeros, self.before, self.offsets = [], [], []
        for _ in range(self.planes):
            self.zeros.append(struct.unpack_from("<Q", blob, at)[0])
            self.before.append(np.frombuffer(blob, "<u4", self.blocks, at + 8))
            self.offsets.append(np.frombuffer(blob, "<u8", self.blocks + 1, at + 8 + 4 * self.blocks))
            at += 8 + 4 * self.blocks + 8 * (self.blocks + 1)
        self.blob, self.base, self.cache = blob, at + 8, {}

    def _bits(self, plane: int, block: int) -> np.ndarray:
        o = self.offsets[plane]
        raw = zstandard.ZstdDecompressor().decompress(self.blob[self.base + int(o[block]) : self.base + int(o[block + 1])])
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=min(BLOCK, self.n - block * BLOCK)).view(bool)

    def _block(self, plane: int, block: int) -> np.ndarray:
        if (plane, block) not in self.cache:
            self.cache = {**dict(list(self.cache.items())[-64:]), (plane, block): self._bits(plane, block)}
        return self.cache[plane, block]

    def rank1(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        b = i // BLOCK
        return int(self.before[plane][b]) + int(self._block(plane, b)[: i - b * BLOCK].sum())

    def select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of a plane."""
        first = self.before[plane].astype(np.int64)
        if not bit:
            first = np.arange(self.blocks) * BLOCK - first
        b = int(np.searchsorted(first, k, "right")) - 1
        return b * BLOCK + int(np.flatnonzero(self._block(plane, b) == bool(bit))[k - int(first[b])])

    def _code(self, token: int) -> int | None:
        c = int(np.searchsorted(self.alphabet, token))
        return c if c < len(self.alphabet) and self.alphabet[c] == token else None

    def access(self, i: int) -> int:
        """The token at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for p in range(self.planes):
            bit = int(self._block(p, i // BLOCK)[i % BLOCK])
            code = code << 1 | bit
            one = self.rank1(p, i)
            i = self.zeros[p] + one if bit else i - one
        return int(self.alphabet[code])

    def _range(self, code: int, a: int, b: int) -> tuple[int, int]:
        for p in range(self.planes):
            oa, ob = self.rank1(p, a), self.rank1(p, b)
            a, b = (self.zeros[p] + oa, self.zeros[p] + ob) if code >> (self.planes - 1 - p) & 1 else (a - oa, b - ob)
        return a, b

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of ``token`` in ``[start, end)``."""
        code, end = self._code(token), self.n if end is None else min(end, self.n)
        if code is None or start >= end:
            return 0
        a, b = self._range(code, start, end)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``."""
        code = self._code(token)
        if code is None or not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(code, 0, self.n)[0] + k
        for p in range(self.planes - 1, -1, -1):
            bit = code >> (self.planes - 1 - p) & 1
            i = self.select(p, bit, i - self.zeros[p] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All token ids, planes undone from the last to the first."""
        if not self.n:
            return np.zeros(0, np.uint32)
        rows = [np.concatenate([self._bits(p, b) for b in range(self.blocks)]) for p in range(self.planes)]
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        code = np.zeros(self.n, kind)
        for p in range(self.planes - 1, -1, -1):
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~rows[p])] = code[: self.zeros[p]]
            up[np.flatnonzero(rows[p])] = code[self.zeros[p] :] | kind(1 << (self.planes - 1 - p))
            code = up
        return self.alphabet[code]


#: The normaliser, the pre-tokenizer and the BPE settings of the one kind of tokenizer whose texts are taken apart.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
BPE = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>"}
_SPACE = r"\x20\t-\r"
#: Letters that NFC leaves alone and that are one letter in lower case too, and other signs that NFC and lower case leave alone.
_CAPITALS, _SMALL, _SIGNS = "A-ZÀ-ÖØ-ÞĀ-įı-ſА-ЯЁ", "a-zªµºß-öø-ÿĀ-įı-ſа-яё", "!-/:-@\\[-`{-~§°«»€‐-‧"
_WORD = re.compile(f"[^{_SPACE}]+")
#: The tokenizer's own pattern, on ASCII in lower case and on the characters above in lower case. Letters, which most pieces are, come first:
#: no other alternative begins with one.
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_ASCII_PARTS = re.compile(f"[a-z]+|{_ENDINGS}|[0-9]|[^a-z0-9{_SPACE}]+")
_PARTS = re.compile(f"[{_SMALL}]+|{_ENDINGS}|[0-9]|[{_SIGNS}]+")


class Encoder(dict):
    """Piece of a text without white space -> its ids (little-endian u32).

    What may be done with a text is read from the tokenizer's own definition. If its normaliser, pre-tokenizer and model are those above,
    ids of a text follow from its pre-tokens in order: white space is dropped and always cuts (no alternative of the pattern holds any,
    and NFC joins nothing across it). Texts of printable ASCII and of the letters and signs above are in NFC, so lower case and the pattern
    give their pre-tokens, and each pre-token's ids are kept once met. Letters alone are one pre-token, and a pre-token's last id,
    and no other, carries the model's end-of-word mark: so many new ones are encoded as one text and told apart by the marks; if the count
    of marks is not the count of pre-tokens, each is encoded by itself. In a text with any other character, or with the first character of
    an added token, each word that holds one is encoded by itself, as it is. Any other tokenizer gets whole texts.

    The pieces of late are kept in two generations of MOST each: a full one becomes the old one, and pieces met again move up.
    """

    MOST = 700_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        super().__init__()
        self.old: dict[str, bytes] = {}
        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode_batch_fast
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        self.apart = (
            spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == PRE_TOKENIZER and spec.get("post_processor") is None
            and not spec.get("truncation") and not spec.get("padding") and all(spec["model"].get(k) == v for k, v in BPE.items())
            and all(not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) and 32 < ord(t["content"][0]) < 127 and not t["content"][0].isalnum() for t in added)
        )
        first = re.escape("".join({t["content"][0] for t in added}))
        #: What keeps a text from being taken apart as a whole, and a word from being taken apart.
        self.bad = re.compile(f"[^{_SPACE}0-9{_CAPITALS}{_SMALL}{_SIGNS}]" + (f"|[{first}]" if added else ""))
        self.bad_ascii = re.compile("[\\x00-\\x08\\x0e-\\x1f\\x7f" + first + "]")
        if self.apart:
            # what is left to do on words of letters: nothing but cutting on ASCII ones, else lower case and the bytes
            cut = pre_tokenizers.WhitespaceSplit()
            plain, other = Tokenizer.from_file(path), Tokenizer.from_file(path)
            plain.normalizer, plain.pre_tokenizer = None, cut
            other.normalizer, other.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.Sequence([cut, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.plain, self.other = plain.encode_batch_fast, other.encode_batch_fast
        self.final = np.zeros(tokenizer.get_vocab_size(), bool)
        self.final[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.encode(texts, add_special_tokens=False)]

    def _alone(self, pieces: list[str]) -> None:
        self.update(zip(pieces, self._ids(pieces)))

    def _together(self, pieces: list[str], encode) -> None:
        """Pieces that are letters alone, so one pre-token each."""
        for at in range(0, len(pieces), 2000):
            part = pieces[at : at + 2000]
            ids = np.array(encode([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(part):
                self._alone(part)
                continue
            raw, a = ids.tobytes(), 0
            for w, e in zip(part, (4 * ends).tolist()):
                self[w] = raw[a:e]
                a = e

    def learn(self, pieces: set[str]) -> None:
        """Ids of pieces not known yet."""
        if self.old:
            again = [w for w in pieces if w in self.old]
            self.update(zip(again, map(self.old.__getitem__, again)))
            pieces.difference_update(again)
        odd, plain, other = [], [], []
        for w in pieces:
            if w.isascii():
                (plain if w.isalpha() and w.islower() else odd).append(w)
            else:
                (other if w.isalpha() and not self.bad.search(w) else odd).append(w)
        self._alone(odd)
        self._together(plain, self.plain)
        self._together(other, self.other)

    def cut(self, text: str) -> list[str]:
        """The pieces of a text in order."""
        if text.isascii():
            bad, parts = self.bad_ascii, _ASCII_PARTS
        else:
            bad, parts = self.bad, _PARTS
        if bad.search(text) is None:
            return parts.findall(text.lower())
        out = []
        for w in _WORD.findall(text):
            if bad.search(w) is None:
                out += parts.findall(w.lower())
            else:
                out.append(w)
        return out

    def texts(self, rows: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if not self.apart:
            return self._ids([r.decode("utf-8", "replace") for r in rows])
        if len(self) >= self.MOST:
            self.old = dict(self)
            self.clear()
        get, held, late = self.get, [], []
        for r in rows:
            # looked up text by text, while its pieces are in the processor's cache; what is new is encoded for all texts together
            pieces = self.cut(r.decode("utf-8", "replace"))
            got = list(map(get, pieces))
            if new := [i for i, g in enumerate(got) if g is None]:
                late.append((got, new, [pieces[i] for i in new]))
            held.append(got)
        self.learn(set(chain.from_iterable(pieces for *_, pieces in late)))
        for got, new, pieces in late:
            for i, w in zip(new, pieces):
                got[i] = self[w]
        return [b"".join(got) for got in held]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


SHARDS = T.StructType([T.StructField("shard", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("payload", T.BinaryType())])


def _shards(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, k = encoder(path), TaskContext.get().partitionId(), 0
        held, lengths, doc_ids, tokens = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal held, lengths, doc_ids, tokens, k
            blob = build(np.frombuffer(b"".join(held), "<u4"), np.cumsum(lengths))
            names = pa.concat_arrays(doc_ids)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", names.type)])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([names], names=["doc_id"]))
            row = [pa.array([(part << 32) + k]), pa.array([tokens]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([blob], pa.binary())]
            held, lengths, doc_ids, tokens = [], [], [], 0
            k += 1
            return pa.RecordBatch.from_arrays(row, names=SHARDS.names)

        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            for lo, hi, raw, off in pieces(b.column(1), SHARD_BYTES):
                data = raw.tobytes()
                at = off.tolist()
                for got in enc.texts([data[x:y] for x, y in zip(at, at[1:])]):
                    got += end
                    held.append(got)
                    lengths.append(len(got) // 4)
                    tokens += len(got) // 4
                doc_ids.append(b.column(0).slice(lo, hi - lo))
                if tokens >= SHARD_TOKENS:
                    yield close()
        if lengths:
            yield close()

    return run


def write_shards(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> str:
    """Encode all documents in ascending id order and write shards; returns their folder.

    A shard file is one row of a Parquet file, put there by Spark's committer, so a lost executor leaves no half-written one and
    any store that Spark can write will do: shard number (ascending with the ids), tokens, the ids of its documents, and the
    bytes of the wavelet matrix. A task holds one shard at a time. Null texts are empty texts: their end id alone. Null ids come
    first; rows with equal ids stand in the order of a hash of their texts, and that hash deals them out too, so that an id of a third of
    all rows is not one task's. There are as many tasks as the session's shuffles have, and as the input has if that is more.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or new_path(spark, "shards")
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", F.col("text").asc_nulls_first())
    dealt.select("doc_id", "text").mapInArrow(lean(_shards(tokenizer)), SHARDS).write.option("compression", "none").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def digest(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shard files."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, names, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                shard = Shard(blob)
                ids, ends = shard.tokens().astype("<u4").tobytes(), shard.ends
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                sums = [zlib.crc32(ids[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist())]
                who = pa.ipc.open_stream(names).read_all()["doc_id"].combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), s)), who, pa.array(starts), pa.array(ends - starts), pa.array(sums, pa.int64())], names=["shard", "doc_id", "own", "n_tokens", "ids_crc32"])

    kind = id_type or T.LongType()
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("own", "n_tokens", "ids_crc32"))])
    shards = read_shards(spark, path)
    rows = shards.select("shard", "ids", "payload").mapInArrow(lean(run), schema)
    return rows.join(offsets(shards), "shard").select("doc_id", (F.col("first") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def offsets(shards: DataFrame) -> DataFrame:
    """(shard, first): tokens before each shard. One row per shard: a running sum over groups of shards, then within a group."""
    sizes = shards.select("shard", "n_tokens").withColumn("g", F.expr("shard >> 40"))
    above = sizes.groupBy("g").agg(F.sum("n_tokens").alias("t"))
    above = above.select("g", F.coalesce(F.sum("t").over(W.orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("a"))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("g").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return written(sizes.withColumn("i", inside).join(above, "g").select("shard", F.expr("a + i").alias("first")), "offsets")


def _shard_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    wanted = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard(blob)
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(wanted), pa.int64()), pa.array(wanted, pa.int64()), pa.array([shard.count(t) for t in wanted], pa.int64())], names=["shard", "token", "n"])

    return shards.select("shard", "payload").mapInArrow(lean(run), "shard long, token long, n long")


def counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each of ``tokens`` in all shards, by rank on the bit-planes; no shard is decoded. Tokens that do not
    occur have 0; without a shard there are no rows. ``tokens`` is a short list that goes with the tasks."""
    ship(spark)
    return _shard_counts(read_shards(spark, path), tokens).groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, wanted: list[tuple[int, int]]) -> DataFrame:
    """(token, k, position) of the k-th (from 0) occurrence of each wanted (token, k), the position counted over all shards: counts find
    the shard, select the place in it. Pairs beyond a token's occurrences give no row. ``wanted`` is a short list."""
    ship(spark)
    shards = read_shards(spark, path)
    per = written(_shard_counts(shards, [t for t, _ in wanted]), "counts")
    before = per.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("token").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    asked = spark.createDataFrame(sorted(set(wanted)), "token long, k long")
    hits = before.join(F.broadcast(asked), "token").where("before <= k AND k < before + n").select("shard", "token", "k", (F.col("k") - F.col("before")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, token, k, own, blobs = (c.to_pylist() for c in b.columns)
            at = [f + Shard(blob).occurrence(t, i) for f, t, i, blob in zip(first, token, own, blobs)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(at, pa.int64())], names=["token", "k", "position"])

    found = hits.join(offsets(shards), "shard").join(shards.select("shard", "payload"), "shard").select("first", "token", "k", "own", "payload")
    return found.mapInArrow(lean(run), "token long, k long, position long")


def tokens_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """(position, token) of each of ``positions``, counted over all shards; those beyond the last token give no row. A short list."""
    ship(spark)
    shards = read_shards(spark, path)
    asked = spark.createDataFrame([(p,) for p in sorted(set(positions))], "position long")
    hits = shards.select("shard", "n_tokens").join(offsets(shards), "shard").join(F.broadcast(asked), F.expr("first <= position AND position < first + n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [Shard(blob).access(i) for i, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int64())], names=["position", "token"])

    found = hits.select("shard", "position", (F.col("position") - F.col("first")).alias("own")).join(shards.select("shard", "payload"), "shard")
    return found.select("position", "own", "payload").mapInArrow(lean(run), "position long, token long")
