"""Language model scores by context-tree weighting over bytes.

A text is read as a stream of bytes: its words in lower case (A to Z only), a blank between two, a line feed as the end; so the
stream stands for the tokens and nothing else. A byte is eight binary decisions. Each decision, in each context of 0 to
``DEPTH`` bytes before it, has counts of zeros and ones in the training texts, a Krichevsky-Trofimov estimate from them, and a weight
against the estimates of the longer contexts: half of the probability of its own training data, over that half and the other,
the product of what the longer contexts make of it. The probability of a bit is the weighted mean along its contexts; the
longest one that the training texts hold has all of the weight that is left. The counts stay fixed while texts are scored.

How it is spread:

1. Every task cuts its texts into blocks of about ``BLOCK_BYTES``. A block lists its distinct n-grams of ``DEPTH + 1`` bytes (the context
   backwards, then the byte) with their counts in training texts, and so its distinct tokens, by their hashes.
   The lists are cut into buckets: n-grams by the last two bytes of the context, tokens by their hash.
2. The lists of a bucket are merged, ``FAN`` at a time, until one is left. A bucket of n-grams holds whole subtrees of
   the context tree. Only the contexts of one byte and of none lie above; they are 257 times 255 decisions at most and
   go through the driver.
3. Every list gets its answer from its bucket: the log-probability of each n-gram, the count of each token.
4. A block meets the answers to its own lists and adds them up per text.

What is gathered grows with the texts: counts of all n-grams and tokens, with no cap. A task holds a block, or the lists
of ``FAN`` blocks in one bucket.

NULL texts are empty: they are an end and nothing else. Rows with a NULL id are training texts. Rows that repeat an id are texts of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerpulse.llm import textio
from tickerpulse.llm.stored import stored

DEPTH = 6
TEXT_BITS = 64 - 8 * (DEPTH + 1)  # an n-gram and the number of a text in its part fill 64 bits
BLOCK_BYTES = 32_000_000
PART_BYTES = 4_000_000
PART_TEXTS = 1 << TEXT_BITS
FAN = 64
TOKEN_BUCKETS = 10  # bits
FIRST_TOKENS = 1 << 16  # number of the first bucket of tokens
END = np.uint64(0x5851F42D4C957F2D)
U8, U64 = np.uint64(8), np.uint64

_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Part:
    """Some texts as one stream of bytes, with their n-grams and tokens."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.n_texts = len(starts) - 1
        data = _LOWER[data]
        begin, end = textio.runs(~_WHITE[data], starts[:-1])
        first = np.searchsorted(begin, starts)
        self.n_words = np.diff(first)
        self.tokens, self.token_text = textio.span_hashes(data, begin, end), np.repeat(np.arange(self.n_texts), self.n_words)
        # A text without words is its end only: a word of no bytes.
        empty = np.flatnonzero(self.n_words == 0)
        begin, end = (np.insert(x, first[:-1][empty], starts[:-1][empty]) for x in (begin, end))
        count = np.maximum(self.n_words, 1)
        size = end - begin + 1
        at = np.concatenate([[0], np.cumsum(size)])
        stream = np.append(data, np.uint8(0))[np.repeat(begin - at[:-1], size) + np.arange(at[-1])]
        stream[at[1:] - 1] = 32
        ends = at[np.cumsum(count)]
        stream[ends - 1] = 10
        self.stream, self.begin = stream, np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.n_bytes = ends - self.begin

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (n-gram, text) in order, and how often: the context backwards, a line feed before the text's first byte."""
        text = np.repeat(np.arange(self.n_texts, dtype=np.uint64), self.n_bytes)
        keys = np.zeros(len(self.stream), U64)
        for back in range(1, DEPTH + 1):
            before = np.full(len(self.stream), 10, np.uint8)
            before[back:] = self.stream[:-back] if back < len(self.stream) else self.stream[:0]
            for lag in range(back):  # the first places of a text have nothing that far back
                at = self.begin + lag
                before[at[lag < self.n_bytes]] = 10
            keys = keys << U8 | before
        keys = (keys << U8 | self.stream) << U64(TEXT_BITS) | text
        keys.sort()
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, count = keys[new], np.diff(np.append(new, len(keys)))
        return keys >> U64(TEXT_BITS), (keys & U64(PART_TEXTS - 1)).astype(np.int64), count


def parts(texts: pa.Array) -> Iterator[tuple[int, int, Part]]:
    data, starts = textio.column_bytes(texts)
    for a, z in textio.blocks(starts, PART_BYTES):
        for low in range(a, z, PART_TEXTS):
            high = min(low + PART_TEXTS, z)
            yield low, high, Part(data[starts[low] : starts[high]], starts[low : high + 1] - starts[low])


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order with the sums of their counts."""
    code, count = np.concatenate(codes), np.concatenate(counts)
    if not len(code):
        return code, count
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[new], np.add.reduceat(count, new)


class Pool:
    """Codes with counts that come in pieces. Pieces are merged once they are as many as what is there already, so
    that a code is moved a few times only and memory holds about twice the distinct codes."""

    def __init__(self):
        self.code, self.count = np.zeros(0, U64), np.zeros(0, np.int64)
        self.pieces: list[tuple] = []
        self.size = 0

    def add(self, code: np.ndarray, count: np.ndarray) -> None:
        self.pieces.append(merged([code], [count]))
        self.size += len(self.pieces[-1][0])
        if self.size > max(len(self.code), 1 << 20):
            self.all()

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        self.code, self.count = merged([self.code, *(c for c, _ in self.pieces)], [self.count, *(n for _, n in self.pieces)])
        self.pieces, self.size = [], 0
        return self.code, self.count


def packed(values: np.ndarray) -> bytes:
    """First all lowest bytes, then all second ones and so on: most of the higher ones are zero."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def packed_codes(codes: np.ndarray) -> bytes:
    return packed(np.diff(codes, prepend=U64(0)))


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def unpacked_codes(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n, U64), dtype=U64)


def buckets(grams: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """kind (0 n-grams, 1 tokens), bucket, and the first and last place of its codes."""
    for kind, codes, shift, first in ((0, grams, 8 * (DEPTH - 1), 0), (1, tokens, 64 - TOKEN_BUCKETS, FIRST_TOKENS)):
        number = (codes >> U64(shift)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
        for low, high in zip(new.tolist(), np.append(new[1:], len(number)).tolist(), strict=True):
            yield kind, first + int(number[low]), low, high


def gathered(rows: DataFrame) -> DataFrame:
    """The texts (kind 0: block, id, held_out, text) and what their blocks ask (kind 1: block, bucket, n, codes, counts)."""
    names = ["kind", "block", "id", "held_out", "text", "bucket", "n", "codes", "counts"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def batch_of(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, k) for c, k in zip(names, kinds, strict=True)], names)

    def asked(block: int, pools: tuple[Pool, Pool]) -> pa.RecordBatch:
        own, out = [pool.all() for pool in pools], []
        for kind, bucket, low, high in buckets(own[0][0], own[1][0]):
            codes, counts = own[kind]
            out.append((bucket, high - low, packed_codes(codes[low:high]), packed(counts[low:high])))
        columns = dict(zip(("bucket", "n", "codes", "counts"), (pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds[5:], strict=True)), strict=True))
        return batch_of(len(out), kind=pa.array([1] * len(out), pa.int32()), block=pa.array([block] * len(out), pa.int64()), **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 24, 0
        own = Pool(), Pool()
        for batch in batches:
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for a, z, part in parts(batch.column("text")):
                train = ~held[a:z]
                code, text, count = part.grams()
                own[0].add(code, count * train[text])
                own[1].add(np.append(part.tokens, np.full(z - a, END)), np.append(train[part.token_text], train).astype(np.int64))
                yield batch_of(
                    z - a, kind=pa.array(np.zeros(z - a), pa.int32()), block=pa.array(np.full(z - a, block)), id=batch.column("id").slice(a, z - a),
                    held_out=batch.column("held_out").slice(a, z - a), text=batch.column("text").slice(a, z - a),
                )
                size += len(part.stream)
                if size >= BLOCK_BYTES:
                    yield asked(block, own)
                    block, size, own = block + 1, 0, (Pool(), Pool())
        if size:
            yield asked(block, own)

    schema = "kind int, block long, id long, held_out boolean, text string, bucket int, n int, codes binary, counts binary"
    return rows.mapInArrow(run, schema)


def _lists(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    n = table.column("n").to_pylist()
    codes = [unpacked_codes(c, k) for c, k in zip(table.column("codes").to_pylist(), n, strict=True)]
    return codes, [unpacked(c, k, np.int64) for c, k in zip(table.column("counts").to_pylist(), n, strict=True)]


def bucket_counts(asked: DataFrame, n_blocks: int) -> DataFrame:
    """bucket, n, total, codes, counts: one row per bucket, only what stands in training texts."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        codes, counts = merged(*_lists(table))
        codes, counts = codes[counts > 0], counts[counts > 0]
        row = [[key[0].as_py()], [key[1].as_py()], [len(codes)], [int(counts.sum())], [packed_codes(codes)], [packed(counts)]]
        return pa.table([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "part", "n", "total", "codes", "counts"])

    lists = asked.select("bucket", F.xxhash64("block").alias("part"), "n", "codes", "counts")
    while True:
        n_blocks = -(-n_blocks // FAN)
        lists = lists.withColumn("part", F.pmod("part", F.lit(n_blocks)).cast("long")).groupBy("bucket", "part").applyInArrow(
            merge, "bucket int, part long, n int, total long, codes binary, counts binary"
        )
        if n_blocks == 1:
            return stored(lists.where("n > 0").drop("part"), "counts")
        lists = stored(lists.drop("total"), "lists")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series at x + 8, and back."""
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def weighted(own: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the mixture of a context's own estimate with that of the longer contexts, and the own one's weight in it."""
    both = np.logaddexp(own, longer) - np.log(2)
    return both, np.exp(own - np.log(2) - both)


class Tree:
    """The contexts from ``DEPTH`` down to ``least`` bytes of some n-grams in order: counts, mixtures and weights of every decision."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, least: int = 2):
        keys, n, to = codes, counts.astype(np.float64), np.arange(len(codes))
        self.codes, self.levels = codes, []
        below: list[tuple] = []
        for depth in range(DEPTH, least - 1, -1):
            if depth < DEPTH:
                shorter = (keys >> U64(16)) << U8 | keys & U64(255)
                keys, up = np.unique(shorter, return_inverse=True)
                n, to = np.bincount(up, n, len(keys)), up[to]
            level, mixtures = [], []
            for bit in range(8):
                node = keys >> U64(8 - bit)
                new = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(keys))))
                one = n * (keys >> U64(7 - bit) & U64(1))
                total, ones = np.add.reduceat(n, new), np.add.reduceat(one, new)
                own = log_estimate(total - ones, ones)
                if below:
                    first, longer = below[bit]  # of the decisions one level deeper
                    both, weight = weighted(own, np.bincount(of[up[first]], longer, len(new)))
                else:
                    both, weight = own, np.ones(len(new))
                level.append((of[to], weight, np.where(total > 0, (ones + 0.5) / (total + 1.0), np.nan)))
                mixtures.append((new, both))
                if depth == least:
                    prefix = (node[new] & U64((1 << bit) - 1)).astype(np.int64) | 1 << bit
                    self.top = [*getattr(self, "top", []), (prefix, total - ones, ones, both)]
            self.levels.append(level)
            below = mixtures

    def log_probabilities(self, top: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of the last byte of every n-gram; ``top`` holds weight and probability of a one per decision of the shorter contexts."""
        out = np.zeros(len(self.codes))
        for bit in range(8):
            one = (self.codes >> U64(7 - bit) & U64(1)).astype(bool)
            prefix = ((self.codes & U64(255)) >> U64(8 - bit)).astype(np.int64) | 1 << bit
            found = np.full(len(self.codes), np.nan)
            for of, weight, share in [level[bit] for level in self.levels] + [(prefix, *pair) for pair in top]:
                own, weight = share[of], weight[of]
                mixed = np.where(np.isnan(found), own, weight * own + (1 - weight) * found)
                found = np.where(np.isnan(own), found, mixed)
            found = np.where(np.isnan(found), 0.5, found)
            out += np.log(np.where(one, found, 1 - found))
        return out


def short_contexts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights and probabilities of a one, 257 contexts (256: none) x 256 decisions, for contexts of one byte and of none."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for bucket, codes, n in zip(batch.column("bucket").to_pylist(), *_lists(table), strict=True):
                columns = [np.concatenate(c) for c in zip(*Tree(codes, n).top, strict=True)]
                last = np.full(len(columns[0]), bucket >> 8)
                yield pa.RecordBatch.from_arrays([pa.array(last, pa.int32()), pa.array(columns[0], pa.int32()), *map(pa.array, columns[1:])], ["last", "node", "zeros", "ones", "mixture"])

    rows = counts.where(F.col("bucket") < FIRST_TOKENS).mapInArrow(tops, "last int, node int, zeros double, ones double, mixture double")
    found = rows.groupBy("last", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "mixture")]).toPandas()  # 256 x 255 rows at most
    weights, shares = np.zeros((257, 256)), np.full((257, 256), np.nan)
    sums = np.zeros((3, 256))
    at = found["last"].to_numpy(), found["node"].to_numpy()
    zeros, ones, longer = (found[c].to_numpy() for c in ("zeros", "ones", "mixture"))
    both, weights[at] = weighted(log_estimate(zeros, ones), longer)
    shares[at] = (ones + 0.5) / (zeros + ones + 1.0)
    for row, values in zip(sums, (zeros, ones, both), strict=True):
        np.add.at(row, at[1], values)
    _, weights[256] = weighted(log_estimate(sums[0], sums[1]), sums[2])
    total = sums[0] + sums[1]
    shares[256] = np.where(total > 0, (sums[1] + 0.5) / (total + 1.0), np.nan)
    return weights, shares


def answers(asked: DataFrame, counts: DataFrame, n_blocks: int, weights: np.ndarray, shares: np.ndarray) -> DataFrame:
    """block, bucket, n, codes, found: natural logarithms of n-grams (32-bit), counts of tokens (64-bit)."""
    shared = asked.sparkSession.sparkContext.broadcast((weights, shares))  # of fixed size
    salts = -(-n_blocks // FAN)

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        n = left.column("n").to_pylist()
        wanted = [unpacked_codes(c, k) for c, k in zip(left.column("codes").to_pylist(), n, strict=True)]
        known, count = _lists(right)
        codes, total = merged([*wanted, *known], [np.zeros(sum(n), np.int64), *count])
        values = total
        if bucket < FIRST_TOKENS and len(codes):
            weights, shares = shared.value
            values = Tree(codes, total).log_probabilities([(weights[c], shares[c]) for c in (bucket >> 8, 256)]).astype(np.float32)
        found = [packed(values[np.searchsorted(codes, w)]) for w in wanted]
        columns = [left.column("block"), pa.array([bucket] * len(n), pa.int32()), left.column("n"), left.column("codes"), pa.array(found, pa.binary())]
        return pa.table(columns, ["block", "bucket", "n", "codes", "found"])

    left = asked.select("block", "bucket", "n", "codes", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"))
    right = counts.select("bucket", "n", "codes", "counts", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return left.groupBy("bucket", "salt").cogroup(right.groupBy("bucket", "salt")).applyInArrow(answer, "block long, bucket int, n int, codes binary, found binary")


def in_training(doc_id: Column) -> Column:
    """False for the seventh of the texts that no model may learn from."""
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def scores(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, held_out, n_tokens (words and the end), n_known (of them in training texts), train_tokens, base_score (log10 by
    single tokens, one added to each count), score (log10 by the context tree), n_bytes of the stream and bits_per_byte."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = stored(gathered(rows), "gathered")
    texts, asked = found.where("kind = 0").select("block", "id", "held_out", "text"), found.where("kind = 1").select("block", "bucket", "n", "codes", "counts")
    n_blocks = max(1, asked.agg(F.count_distinct("block")).first()[0])
    counts = bucket_counts(asked, n_blocks)
    sizes = counts.where(F.col("bucket") >= FIRST_TOKENS).agg(F.sum("total"), F.sum("n")).first()
    train, types = sizes[0] or 0, sizes[1] or 0
    answered = answers(asked, counts, n_blocks, *short_contexts(counts))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]

    def add_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.column("text").combine_chunks() if left.num_rows else pa.array([], pa.string())
        order = np.argsort(right.column("bucket").to_numpy(), kind="stable").tolist()
        bucket, n, asked, found = (right.column(c).to_pylist() for c in ("bucket", "n", "codes", "found"))
        grams, types_here = [i for i in order if bucket[i] < FIRST_TOKENS], [i for i in order if bucket[i] >= FIRST_TOKENS]
        joined = lambda arrays: np.concatenate(arrays) if arrays else np.zeros(0, U64)
        logs, seen = joined([unpacked(found[i], n[i], np.float32) for i in grams]), joined([unpacked(found[i], n[i], np.int64) for i in types_here])
        codes, types_here = (joined([unpacked_codes(asked[i], n[i]) for i in x]) for x in (grams, types_here))
        out = []
        for a, z, part in parts(texts):
            code, text, count = part.grams()
            score = np.bincount(text, logs[np.searchsorted(codes, code)].astype(np.float64) * count, z - a) / np.log(10)
            c = seen[np.searchsorted(types_here, part.tokens)]
            end = seen[np.searchsorted(types_here, END)]
            known = np.bincount(part.token_text[c > 0], minlength=z - a) + int(end > 0)
            logs_of = lambda x: np.log10((x + 1.0) / (train + 1.0 * (types + 1)))
            base = np.bincount(part.token_text, logs_of(c), z - a) + logs_of(end)
            tokens = part.n_words + 1
            out.append((tokens, known, np.full(z - a, train), base, score, part.n_bytes, -score / np.log10(2) / part.n_bytes))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 7
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.int64(), pa.float64()]
        return pa.table([left.column("id"), left.column("held_out"), *[pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)]], names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return texts.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(add_up, schema)
