"""Token ids in wavelet-matrix shards: one compressed file per shard that answers access, count and lookup.

A shard file is one line of the text writer, so Spark's own writer commits it in any store:

* 8 bytes ``WVMTRX01``, the shard's partition and part (10 digits each), its token count (20 digits), the length of
  the JSON header (10 digits), the header, the sections, a line break.
* Sections, each zstd-compressed: document ids (int64, little endian), a byte per document that is 1 where the id is
  NULL, tokens per document (uint32), and one section per bit-plane from the highest bit down.

Plane ``k`` holds bit ``k`` of every token in the order that the planes above leave: stable, zeros first. With a
running count of ones per 64 bits, rank and select take constant work per plane, so a token is read, counted in a
range or located without unpacking the rest.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerpulse.llm import textio

MAGIC = b"WVMTRX01"
FIXED = len(MAGIC) + 10 + 10 + 20 + 10


class Plane:
    """A bit vector with rank and select."""

    def __init__(self, packed: np.ndarray, size: int):
        self.size = size
        self.words = np.zeros(size // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = size - int(self.ones[-1])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.size, bitorder="little").view(bool)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[at >> 6] + np.bitwise_count(self.words[at >> 6] & mask)

    def select(self, bit: bool, nth: np.ndarray) -> np.ndarray:
        """Position of the ``nth`` one or zero, counted from 0."""
        before = self.ones if bit else np.arange(len(self.ones)) * 64 - self.ones
        word = np.searchsorted(before, nth, "right") - 1
        values = self.words[word] if bit else ~self.words[word]
        cumulative = np.cumsum(np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=1, dtype=np.int16)
        return word * 64 + np.argmax(cumulative > (nth - before[word])[:, None], axis=1)


class WaveletMatrix:
    """A sequence of token ids as bit-planes."""

    def __init__(self, planes: list[Plane], size: int):
        self.planes, self.size = planes, size

    @staticmethod
    def pack(ids: np.ndarray) -> list[bytes]:
        """The packed planes, highest bit first."""
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        ids = ids.astype(np.uint16 if width <= 16 else np.uint32)
        out = []
        for k in range(width - 1, -1, -1):
            bit = (ids >> ids.dtype.type(k)) & ids.dtype.type(1) == 1
            out.append(np.packbits(bit, bitorder="little").tobytes())
            ids = np.concatenate([np.compress(~bit, ids), np.compress(bit, ids)])
        return out

    @classmethod
    def of(cls, packed: list[bytes], size: int) -> WaveletMatrix:
        return cls([Plane(np.frombuffer(p, np.uint8), size) for p in packed], size)

    def access(self, at) -> np.ndarray:
        """The tokens at some positions."""
        at = np.asarray(at, np.int64)
        value = np.zeros(len(at), np.int64)
        for plane in self.planes:
            bit, ones = plane.get(at), plane.rank(at)
            value = value * 2 + bit
            at = np.where(bit, plane.zeros + ones, at - ones)
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        ends = np.array([low, high], np.int64)
        for k, plane in enumerate(self.planes):
            ones = plane.rank(ends)
            ends = plane.zeros + ones if token >> (len(self.planes) - 1 - k) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often a token stands in [low, high)."""
        low, high = self._range(token, low, self.size if high is None else high)
        return high - low

    def locate(self, token: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """All positions of a token in [low, high), ascending."""
        first, last = self._range(token, low, self.size if high is None else high)
        at = np.arange(first, last, dtype=np.int64)
        for k, plane in enumerate(reversed(self.planes)):
            if len(at):
                at = plane.select(True, at - plane.zeros) if token >> k & 1 else plane.select(False, at)
        return at

    def decode(self) -> np.ndarray:
        """All tokens: the planes are undone from the lowest bit up."""
        value = np.zeros(self.size, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, plane in enumerate(reversed(self.planes)):
            bit = plane.bits()
            out = np.empty_like(value)
            out[np.flatnonzero(~bit)] = value[: plane.zeros]
            out[np.flatnonzero(bit)] = value[plane.zeros :] | value.dtype.type(1 << k)
            value = out
        return value


def shard_bytes_of(partition: int, part: int, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    sections = [
        np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes(),
        np.array([i is None for i in doc_ids], np.uint8).tobytes(), lengths.astype("<u4").tobytes(), *WaveletMatrix.pack(ids),
    ]
    packed = [zstandard.compress(s, 1) for s in sections]
    header = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "sections": [len(p) for p in packed]}).encode()
    return b"".join([MAGIC, b"%010d%010d%020d%010d" % (partition, part, len(ids), len(header)), header, *packed])


class Shard:
    """A shard file in memory; ``matrix`` answers queries on its tokens."""

    def __init__(self, content: bytes):
        if content[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        self.partition, self.part = int(content[8:18]), int(content[18:28])
        at = FIXED + int(content[48:58])
        header = json.loads(content[FIXED:at])
        sections = []
        for length in header["sections"]:
            sections.append(zstandard.decompress(content[at : at + length]))
            at += length
        missing = np.frombuffer(sections[1], np.uint8)
        self.doc_ids = [None if m else i for i, m in zip(np.frombuffer(sections[0], "<i8").tolist(), missing.tolist(), strict=True)]
        self.lengths = np.frombuffer(sections[2], "<u4").astype(np.int64)
        self.matrix = WaveletMatrix.of(sections[3:], header["tokens"])


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 13, 32]] = True
# First bytes of what else counts as white space: control characters and the multi-byte spaces.
_EXOTIC = np.zeros(256, bool)
_EXOTIC[[11, 12, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_EXOTIC_SPACES = frozenset("\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | frozenset(map(chr, range(0x2000, 0x200B)))


def units(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces that the byte-level pre-tokenizer never joins: begin, end, and each text's first piece (one entry more).

    It breaks where white space follows something else, and after a single line break or tab. A text with other
    white space than blank, tab and line breaks stays whole.
    """
    n = len(data)
    space = _SPACES[data]
    cut = np.zeros(n + 1, bool)
    if n:
        before = np.concatenate([[False], space[:-1]])
        lone = np.concatenate([[False, False], space[1:-1] & ~space[:-2]]) if n > 1 else np.zeros(1, bool)
        cut[:-1] = (space & ~before) | (~space & lone & (np.concatenate([[32], data[:-1]]) != 32))
        for at in np.flatnonzero(_EXOTIC[data]).tolist():
            char = bytes(data[at : at + 3])
            if char.decode("utf8", "ignore")[:1] in _EXOTIC_SPACES:
                doc = np.searchsorted(starts, at, "right") - 1
                cut[starts[doc] : starts[doc + 1]] = False
    cut[starts[:-1][np.diff(starts) > 0]] = True
    cut[n] = False
    begin = np.flatnonzero(cut)
    return begin, np.concatenate([begin[1:], [n]])[: len(begin)], np.searchsorted(begin, starts)


def _encoder(path: str, special: bool) -> textio.UnitCache:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special

    def encode(pieces: list[bytes]) -> list[list[int]]:
        return [f.ids for f in tokenizer.encode_batch_fast([p.decode("utf8") for p in pieces], add_special_tokens=False)]

    return textio.UnitCache(encode)


_ENCODERS: dict[tuple[str, bool], textio.UnitCache] = {}  # lives as long as the Python worker


def encode_block(path: str, data: np.ndarray, starts: np.ndarray, special: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some texts one after the other, and where each text's ids begin (one entry more). With ``special``, a
    special token in a text is one id, as in a plain call of the library; else it is spelled out."""
    cache = _ENCODERS.get((path, special)) or _ENCODERS.setdefault((path, special), _encoder(path, special))
    begin, end, first = units(data, starts)
    ids, offsets = cache(data, begin, end)
    return ids, offsets[first]


def write_shards(
    df: DataFrame, id_col: str, text_col: str, path: str, tokenizer: str, end_id: int = 0,
    shard_bytes: int = 24_000_000, shard_tokens: int = 4_000_000, special: bool = False,
) -> None:
    """Encode every whole text, append ``end_id`` to each and write the shards in ascending order of ``id_col``.

    A task takes a range of ids of about ``shard_bytes`` of text and closes a file at ``shard_tokens``. NULL and empty
    texts consist of the end id alone; NULL ids come first; rows of one id follow each other in the order of their text.
    ``special`` is that of ``encode_block``.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.repartitionByRange(total // shard_bytes + 1, "id").sortWithinPartitions("id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, part = TaskContext.get().partitionId(), 0
        doc_ids, lengths, ids = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal part
            content = shard_bytes_of(partition, part, doc_ids, np.concatenate(lengths), np.concatenate(ids))
            part += 1
            for x in (doc_ids, lengths, ids):
                x.clear()
            return pa.record_batch([pa.array([content], pa.binary())], ["content"])

        for batch in batches:
            data, starts = textio.column_bytes(batch.column("text"))
            keys = batch.column("id").to_pylist()
            for a, z in textio.blocks(starts):
                found, at = encode_block(tokenizer, data[starts[a] : starts[z]], starts[a : z + 1] - starts[a], special)
                ids.append(np.insert(found, at[1:], end_id))
                lengths.append(np.diff(at) + 1)
                doc_ids.extend(keys[a:z])
                if sum(map(len, ids)) >= shard_tokens:
                    yield close()
        if doc_ids:
            yield close()

    blobs = ordered.mapInArrow(shards, "content binary")
    blobs.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard: partition, part, n_tokens, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    number = lambda at, n: F.substring("content", at, n).cast("string").cast("long")
    return files.where(F.length("content") > FIXED).select(
        number(9, 10).alias("partition"), number(19, 10).alias("part"), number(29, 20).alias("n_tokens"), "content"
    )


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids.

    ``start`` counts the ids of all documents before it, over all shards.
    """
    files = shard_files(spark, path)
    kinds = {"partition": pa.int64(), "part": pa.int64(), "doc_id": pa.int64(), "at": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
    if with_ids:
        kinds["ids"] = pa.list_(pa.int32())

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                shard = Shard(content.as_py())
                ids = shard.matrix.decode().astype("<u4")
                ends = np.cumsum(shard.lengths)
                raw, n = memoryview(ids.tobytes()), len(ends)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - shard.lengths).tolist(), ends.tolist(), strict=True)]
                columns = [[shard.partition] * n, [shard.part] * n, shard.doc_ids, ends - shard.lengths, shard.lengths, crc]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=False)]
                if with_ids:
                    arrays.append(textio.lists(ids.astype(np.int32), np.concatenate([[0], ends]), pa.int32()))
                yield pa.record_batch(arrays, list(kinds))

    schema = "partition long, part long, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = files.select("content").mapInArrow(documents, schema)
    order = Window.orderBy("partition", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("partition", "part", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("before"))
    out = rows.join(before, ["partition", "part"]).withColumn("start", F.col("before") + F.col("at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def lookup(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """Occurrences of some token ids, located in the shards without decoding them: token, doc_id, at (in the document)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                shard = Shard(content.as_py())
                ends = np.cumsum(shard.lengths)
                for token in tokens:
                    at = shard.matrix.locate(token)
                    doc = np.searchsorted(ends, at, "right")
                    yield pa.record_batch(
                        [
                            pa.array(np.full(len(at), token), pa.int32()), pa.array([shard.doc_ids[i] for i in doc.tolist()], pa.int64()),
                            pa.array(at - (ends - shard.lengths)[doc], pa.int64()),
                        ],
                        ["token", "doc_id", "at"],
                    )

    return shard_files(spark, path).select("content").mapInArrow(find, "token int, doc_id long, at long")
