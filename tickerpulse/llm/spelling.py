"""Spelling variants of the words of a corpus, found by a frontier that walks a trie kept as a table.

The trie is a table of edges (parent, character, child) over all words, and one more over all words read backwards; a
node is named by two 64-bit hashes of its prefix. A state is (word, position, node, edits). Level by level, the states at one
depth are joined with the edges that leave their nodes: an unedited state may match, replace, insert or, behind a match,
delete a character, an edited one may only match. An edited state at the end of its word, in a node where another word ends, is a
neighbour: the two differ by exactly one inserted, deleted or replaced code point.

A word is walked twice, each time with its edit in the second half: forwards, and backwards for edits in its first half. So the
frontier begins below the crowded top of the trie. A bit set of the characters that may follow a node drops most states
before they are written. The last level compares the rest of words longer than ``deepest`` code points with what is left of
those that share their first ``deepest`` of them; the number of joins is thus bounded, not the length of words.

Nothing is collected: words, edges and states are tables, every level is written to the shared folder.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerpulse.llm import textio
from tickerpulse.llm.stored import dropping_shuffles, stored
from tickerpulse.session import work_path

RUNS = r"[A-Za-zÀ-ÿ]+"
DEEPEST = 40
NODE = ["side", "a", "b"]
_ODD = [np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)]


def vocabulary(
    df: DataFrame, id_col: str, text_col: str, least_length: int = 5, least_count: int = 3, spoil: int = 97,
) -> DataFrame:
    """word and n. The CRC-32 of ``<id>:<run>`` takes a letter out of one run in ``spoil``; runs of rows without an id stay whole."""
    low = F.translate(F.col(text_col), string.ascii_uppercase, string.ascii_lowercase)
    runs = df.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUNS), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % spoil == 0, shorter).otherwise(F.col("run"))
    counts = hashed.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least_count)


class _Spelled:
    """The words of a batch as code points, forwards or backwards, with hashes of their prefixes."""

    def __init__(self, words: list[str], side: int):
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.length) - self.length
        if side:
            owner = np.repeat(np.arange(len(words)), self.length)
            codes = codes[2 * self.start[owner] + self.length[owner] - 1 - np.arange(len(codes))]
        self.codes = codes
        self.values = [textio.mix(codes.astype(np.uint64) * k + k) for k in _ODD]
        half = self.length // 2
        self.first_edit = self.length - half if side else half

    def node(self, word: np.ndarray, depth: np.ndarray) -> list[pa.Array]:
        begin = self.start[word]
        return [pa.array(textio.sequence_hashes(v, begin, begin + depth).view(np.int64)) for v in self.values]

    def characters(self, at: np.ndarray) -> pa.Array:
        return pa.array(self.codes[at].view("<U1").tolist(), pa.string())


def trie_edges(words: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """The edges of both tries: side, k (depth of the child), parent (pa, pb), character, child (a, b), bits of the characters that
    follow the child, and the word that ends there with its n. Below ``deepest`` an edge holds all that is left of one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for side in (0, 1):
                own = _Spelled(texts, side)
                count = np.minimum(own.length, deepest) - 1
                word = np.repeat(np.arange(len(texts)), count)
                k = np.arange(len(word)) - (np.cumsum(count) - count)[word] + 2
                ends = own.length[word] == k
                after = own.codes[np.minimum(own.start[word] + k, len(own.codes) - 1)]
                bits = np.where(ends, np.uint64(0), np.uint64(1) << (after % 64).astype(np.uint64)).view(np.int64)
                last = np.flatnonzero(ends)
                endings: list = [None] * len(word)
                for i in last.tolist():
                    endings[i] = texts[word[i]]
                yield _edges(side, k, own.node(word, k - 1), own.characters(own.start[word] + k - 1), own.node(word, k), bits, endings, np.where(ends, n[word], 0))
                long = np.flatnonzero(own.length > deepest)
                if len(long):
                    rest = ["".join(map(chr, own.codes[own.start[w] + deepest : own.start[w] + own.length[w]].tolist())) for w in long.tolist()]
                    at = np.full(len(long), deepest)
                    yield _edges(side, at + 1, own.node(long, at), pa.array(rest, pa.string()), own.node(long, own.length[long]), at * 0, [texts[w] for w in long.tolist()], n[long])

    rows = words.mapInArrow(run, "side int, k int, pa long, pb long, letter string, a long, b long, bits long, ends string, end_n long")
    return rows.groupBy("k", *NODE).agg(
        F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("letter").alias("letter"), F.bit_or("bits").alias("bits"),
        F.max("ends").alias("ends"), F.max("end_n").alias("end_n"),
    )


def _edges(side, k, parent, letter, child, bits, ends, n) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(k), side), pa.int32()), pa.array(k, pa.int32()), *parent, letter, *child, pa.array(bits), pa.array(ends, pa.string()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["side", "k", "pa", "pb", "letter", "a", "b", "bits", "ends", "end_n"])


def first_states(words: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """Where each word enters both tries: one character before the half in which its edit may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("word").to_pylist()
            back = pa.array([t[::-1] for t in texts], pa.string())
            for side in (0, 1):
                own = _Spelled(texts, side)
                at = np.minimum(own.first_edit - 1, deepest)
                spelled = back if side else batch.column("word")
                columns = [pa.array(np.full(len(texts), side), pa.int32()), spelled, pa.array(at, pa.int32()), *own.node(np.arange(len(texts)), at)]
                edits = pa.array(np.where(own.first_edit > at, -1, 0), pa.int32())  # below the deepest level all of the rest is compared
                yield pa.RecordBatch.from_arrays([*columns, edits], ["side", "spelled", "at", "a", "b", "edits"])

    return words.mapInArrow(run, "side int, spelled string, at int, a long, b long, edits int")


def _letter(place: Column) -> Column:
    return F.substring("spelled", place + 1, F.lit(1))


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one level deeper; those that ended have their neighbour in ``near``. ``edits`` is -1 where the word only enters."""
    joined = states.join(edges.withColumnsRenamed({"a": "ca", "b": "cb", "pa": "a", "pb": "b"}), NODE)
    at, edits, length = F.col("at"), F.col("edits"), F.length("spelled")
    same = F.col("letter") == _letter(at)  # false at the end of the word
    new = lambda when, place, n: F.when(when, F.struct(place.cast("int").alias("at"), F.lit(n).alias("edits")))
    moves = F.array_compact(F.array(
        new(same & (edits <= 0), at + 1, 0),
        new(same & ((edits == 1) | (at + 1 < length)), F.when(edits == 1, at + 1).otherwise(at + 2), 1),  # match, or delete the character behind
        new(~same & (edits == 0) & (at < length), at + 1, 1),  # replace
        new(~same & (edits == 0), at, 1),  # insert
    ))
    moved = joined.where(same | (edits == 0)).select("side", "spelled", F.col("ca").alias("a"), F.col("cb").alias("b"), "bits", "ends", "end_n", F.explode(moves).alias("m"))
    moved = moved.select("*", "m.at", "m.edits").drop("m")
    over = (F.col("edits") == 1) & (F.col("at") == length)
    follows = F.getbit("bits", F.ascii(_letter(F.col("at"))) % 64) == 1
    alive = F.when(over, F.col("ends").isNotNull()).when(F.col("edits") == 1, follows).otherwise(F.col("bits") != 0)
    return moved.where(alive).select(
        "side", "spelled", "at", "a", "b", "edits", F.when(over, F.col("ends")).alias("near"), F.when(over, F.col("end_n")).alias("near_n"),
    )


def _last_step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours among words that go on below the deepest level: what is left of both is compared."""
    joined = states.join(edges.select("side", F.col("pa").alias("a"), F.col("pb").alias("b"), "letter", "ends", "end_n"), NODE)
    rest = F.substring("spelled", F.col("at") + 1, F.length("spelled"))
    fits = F.when(F.col("edits") == 1, rest == F.col("letter")).otherwise(
        (F.abs(F.length(rest) - F.length("letter")) <= 1) & (F.levenshtein(rest, F.col("letter"), 1) == 1)
    )
    return joined.where(fits).select("side", "spelled", "at", "a", "b", "edits", F.col("ends").alias("near"), F.col("end_n").alias("near_n"))


def neighbours(words: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """word, near, near_n: all ordered pairs of ``words`` (word, n; distinct, four code points or more) one edit apart."""
    spark = words.sparkSession
    most = words.agg(F.max(F.length("word"))).first()[0]
    if most is None:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n"))
    path = work_path(spark, "edges")
    with dropping_shuffles(spark):
        trie_edges(words, deepest).write.partitionBy("k").parquet(path)
    edges = spark.read.parquet(path)
    starts = stored(first_states(words, deepest), "starts")
    levels: list[DataFrame] = []
    for depth in range(1, min(most, deepest) + 1):
        states = starts.where(F.col("at") == depth)
        if levels:
            states = states.unionByName(levels[-1].where("near IS NULL").drop("near", "near_n"))
        step = _last_step if depth == deepest else _step
        levels.append(stored(step(states, edges.where(F.col("k") == depth + 1).drop("k")), "level"))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    word = F.when(F.col("side") == 1, F.reverse("spelled")).otherwise(F.col("spelled"))
    return found.where("near IS NOT NULL").select(word.alias("word"), "near", "near_n").distinct()


def variant_groups(words: DataFrame, ratio: float = 2.0, deepest: int = DEEPEST) -> DataFrame:
    """Every word with its form, the near word of largest n (ties: the smallest in code-point order) if that is at least
    ``ratio`` times its own, and its root, the last of the forms from it on.

    Columns: word, form, root (the word itself without a form), n, n_near, form_n. ``words`` has word and n. n grows along forms,
    so they never come back, and there are few of them: roots double their way in a few joins.
    """
    words = stored(words.select("word", "n"), "words")
    best = neighbours(words, deepest).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    )
    joined = words.join(best, "word", "left")
    good = -F.col("best.less") >= F.col("n") * ratio
    rows = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.form")).alias("form"),
        F.when(good, -F.col("best.less")).alias("form_n"),
    ), "forms")
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onwards = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(onwards, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    out = rows.join(roots.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
