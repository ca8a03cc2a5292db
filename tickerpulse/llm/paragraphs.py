"""Removal of paragraphs and passages that other documents hold as well: paragraph MinHash banding.

Two kinds of paragraph are compared. Words are those of the n-gram join.

* Lines of ``min_line`` words or more. Lines of one set of word 5-grams form a class. The band hashes of the classes are
  shuffled, classes that meet are joined to the smallest of the band (a star, no pairs), and within the components of
  these stars the exact Jaccard coefficient decides. The links that hold are clustered by connected components.
* Passages of ``min_words`` words or more, which may span lines or stand inside them. At the smallest 5-gram hash of every
  ``spread`` in a row begins a seed of ``seed`` words, so any run of ``seed + spread - 1`` = 22 words in two documents has
  a seed in common. Two passages with a coefficient of 0.8 have such a run: 5-grams that a changed word takes part
  in are lost, so 49 words allow one change at most, and every further change needs 45 more. Every document is joined to the
  smallest document of each of its seeds. The words around the seeds that two documents share are then compared,
  and the longest stretches whose 5-gram sets reach the threshold count, from their first common 5-gram to the last.
  The same ``PERIOD`` words or fewer over and over and nothing else are no passage.

Of every cluster the document with the smallest id keeps its paragraphs, all others lose theirs; a document never
loses words because they repeat within it. Rows with a NULL id and NULL or empty texts take no part. Rows that repeat
an id count as one document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerpulse.llm import textio
from tickerpulse.llm.components import connected, local_roots
from tickerpulse.llm.minhash import band_hashes, bands_for
from tickerpulse.llm.ngram_join import verify
from tickerpulse.llm.stored import free_name, release, stored
from tickerpulse.session import cut_lineage

BAND_ROWS = 4
SIZE = 5
PERIOD = 12
REACH = 64  # words compared on both sides of the seeds that two documents share
BLOCK = 1_000_000  # bytes of text cut and hashed at a time: the arrays take some fifty times as much
UNIT = 1 << 19  # seeds kept in one row
SHARE = 1 << 20  # seeds whose hashes one group compares

_FOUND = pa.schema([
    ("id", pa.int64()), ("h", pa.int64()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("bands", pa.list_(pa.int64())), ("unit", pa.int64()),
    ("n_seeds", pa.int32()), ("seed_hashes", pa.binary()), ("seed_words", pa.binary()), ("seed_ids", pa.binary()),
])


def _line_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([starts, np.flatnonzero(data == 10) + 1]))


def _lines(data: np.ndarray, starts: np.ndarray, min_words: int, words: tuple[np.ndarray, ...]):
    """Text, first word, number of words and n-gram set of every line long enough; ``words`` as ``textio.words`` gives them."""
    begin, _, hashes, first = words
    at = _line_starts(data, starts)
    line_first = np.searchsorted(begin, at)
    n = np.diff(line_first)
    values, offsets = textio.sets_of(*textio.shingles(hashes, line_first, SIZE))
    long = np.flatnonzero(n >= min_words)
    text = np.searchsorted(starts, at[long], "right") - 1
    keep = np.repeat(n >= min_words, np.diff(offsets))
    return text, line_first[long] - first[text], n[long], np.compress(keep, values), np.concatenate([[0], np.cumsum(np.diff(offsets)[long])])


def _set_hashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return textio.mix(np.add.reduceat(textio.mix(values), offsets[:-1]) + np.diff(offsets).astype(np.uint64)) if len(offsets) > 1 else np.zeros(0, np.uint64)


def _seeds(words: tuple[np.ndarray, ...], seed: int, spread: int):
    """Text, first word and hash of every seed of a passage."""
    _, _, hashes, first = words
    n = len(hashes)
    if n < max(seed, SIZE + spread):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    whole = textio.sequence_hashes(hashes, np.arange(n - SIZE + 1), np.arange(SIZE, n + 1))
    view = np.lib.stride_tricks.sliding_window_view(whole, spread)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = owner[: len(view)] == owner[spread + SIZE - 2 :]  # all these n-grams are of one text
    at = np.unique(np.compress(inside, np.arange(len(view)) + view.argmin(1)))
    at = at[at + seed <= first[1:][owner[at]]]
    return owner[at], at - first[owner[at]], textio.sequence_hashes(hashes, at, at + seed)


def _units(task: int, unit: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``most`` seeds or fewer: their hashes, first words and documents as the bytes of three arrays."""
    ids, at, hashes = (np.concatenate(c) for c in zip(*held, strict=True))
    for a in range(0, len(hashes), most):
        own = slice(a, a + most)
        values = {
            "n_words": seed, "unit": (task << 32) + unit, "n_seeds": len(hashes[own]), "seed_hashes": hashes[own].tobytes(),
            "seed_words": at[own].astype(np.int32).tobytes(), "seed_ids": ids[own].astype(np.int64).tobytes(),
        }
        yield pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in _FOUND], schema=_FOUND)
        unit += 1


def paragraphs(rows: DataFrame, min_line: int, seed: int, spread: int, bands: int, most: int = UNIT) -> DataFrame:
    """Every line of ``rows`` (id, text): id, hash, first word, number of words, band hashes. Beside them the seeds, packed
    into units (``_units``), each a row without id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, unit, held, n_held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            ids = batch.column("id").to_numpy()
            data, starts = textio.column_bytes(batch.column("text"))
            for a, z in textio.blocks(starts, BLOCK):
                own, place = data[starts[a] : starts[z]], starts[a : z + 1] - starts[a]
                words = textio.words(own, place)
                text, at, n, values, offsets = _lines(own, place, min_line, words)
                found = band_hashes(values, offsets, bands, BAND_ROWS) if len(text) else np.zeros((0, bands), np.int64)
                none = [pa.nulls(len(text), f.type) for f in list(_FOUND)[5:]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[a:z][text]), pa.array(_set_hashes(values, offsets).view(np.int64)), pa.array(at, pa.int32()), pa.array(n, pa.int32()),
                    textio.lists(found.reshape(-1), np.arange(len(text) + 1) * bands, pa.int64()), *none,
                ], schema=_FOUND)
                other, where, hashes = _seeds(words, seed, spread)
                held.append((ids[a:z][other], where, hashes))
                n_held += len(hashes)
                if n_held >= most:
                    yield from _units(task, unit, held, seed, most)
                    unit, held, n_held = unit + -(-n_held // most), [], 0
        if n_held:
            yield from _units(task, unit, held, seed, most)
        pa.default_memory_pool().release_unused()  # workers live on

    return rows.mapInArrow(
        run, "id long, h long, first_word int, n_words int, bands array<long>, unit long, n_seeds int, seed_hashes binary, seed_words binary, seed_ids binary"
    )


def _array(value: pa.BinaryScalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _repeated_seeds(found: DataFrame, share_seeds: int = SHARE) -> DataFrame:
    """h, id and first_word of the seeds that stand in more than one document.

    Most stand in one only. To tell them apart, the distinct hashes of every unit are cut into shares by their leading
    bits, so a seed of a third of all documents comes once per unit; the share tells each unit which of its own
    hashes another unit has as well, and only those leave it with their documents.
    """
    units = found.where("unit IS NOT NULL")
    total = units.agg(F.sum("n_seeds")).first()[0] or 0
    shares = max(1, -(-total // share_seeds))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, ids = _array(batch.column("seed_hashes")[i], np.uint64), _array(batch.column("seed_ids")[i], np.int64)
                order = np.argsort(hashes, kind="stable")
                hashes, ids = hashes[order], ids[order]
                new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                many = np.minimum.reduceat(ids, new) != np.maximum.reduceat(ids, new)
                hashes = hashes[new]
                share, first = np.unique(((hashes >> np.uint64(32)) * np.uint64(shares)) >> np.uint64(32), return_index=True)
                ends = np.append(first[1:], len(hashes))
                yield pa.RecordBatch.from_arrays([
                    pa.array(share.astype(np.int64)), pa.array(np.full(len(share), batch.column("unit")[i].as_py()), pa.int64()),
                    pa.array([hashes[a:z].tobytes() for a, z in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary()),
                    pa.array([many[a:z].tobytes() for a, z in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary()),
                ], ["share", "unit", "hashes", "many"])

    def compare(table: pa.Table) -> pa.Table:
        parts = [_array(x, np.uint64) for x in table.column("hashes")]
        hashes, many = np.concatenate(parts), np.concatenate([_array(x, np.bool_) for x in table.column("many")])
        order = np.argsort(hashes, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0]))
        n = np.diff(np.append(new, len(hashes)))
        wanted = np.zeros(len(hashes), bool)
        wanted[order] = np.repeat((n > 1) | np.logical_or.reduceat(many[order], new), n)
        ends = np.cumsum([len(p) for p in parts])[:-1]
        asked = [p[w].tobytes() for p, w in zip(parts, np.split(wanted, ends), strict=True)]
        out = pa.table([table.column("unit"), pa.array(asked, pa.binary())], ["unit", "wanted"])
        return out.filter(pa.array([len(x) > 0 for x in asked]))

    shared = units.select("unit", "seed_hashes", "seed_ids").mapInArrow(split, "share long, unit long, hashes binary, many binary")
    asked = stored(shared.groupBy("share").applyInArrow(compare, "unit long, wanted binary"), "asked_seeds")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = _array(batch.column("seed_hashes")[i], np.uint64)
                wanted = np.sort(np.concatenate([_array(x, np.uint64) for x in batch.column("wanted")[i].values]))
                at = np.searchsorted(wanted, hashes)
                there = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == hashes)
                ids, words = _array(batch.column("seed_ids")[i], np.int64), _array(batch.column("seed_words")[i], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[there].view(np.int64)), pa.array(ids[there]), pa.array(words[there])], ["h", "id", "first_word"])

    lists = asked.groupBy("unit").agg(F.collect_list("wanted").alias("wanted"))  # at most the hashes of one unit
    met = units.select("unit", "seed_hashes", "seed_words", "seed_ids").join(lists, "unit").drop("unit")
    repeated = stored(met.mapInArrow(answer, "h long, id long, first_word int"), "repeated_seeds")
    release(asked)
    return repeated


def _near_classes(rows: DataFrame, classes: DataFrame, threshold: float, min_line: int, block: int, block_grams: int) -> DataFrame:
    """h and keeper of the line classes in clusters of more than one class."""
    met = classes.select("h", F.posexplode("bands").alias("band", "hash"))
    roots = met.groupBy("band", "hash").agg(F.min("h").alias("root"), F.max("h").alias("other")).where("root < other").drop("other")
    parts = cut_lineage(connected(met.join(roots, ["band", "hash"]).where("h <> root").select("h", "root"), "h", "root"))
    members = parts.select(F.col("node").alias("h"), "component").join(classes.select("h", "keeper", "n_words"), "h")
    blocks = members.groupBy("component").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_words") / block_grams)).cast("int").alias("blocks")
    )
    members = cut_lineage(members.join(blocks, "component").withColumn("b", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")))
    # The n-grams of a class are read from the document that keeps it.
    wanted = members.groupBy("keeper").agg(F.collect_set("h").alias("wanted"))  # at most the lines of one document

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = textio.column_bytes(batch.column("text"))
            asked = batch.column("wanted").to_pylist()
            for a, z in textio.blocks(starts, BLOCK):
                own, place = data[starts[a] : starts[z]], starts[a : z + 1] - starts[a]
                text, _, _, values, offsets = _lines(own, place, min_line, textio.words(own, place))
                hashes = _set_hashes(values, offsets).view(np.int64)
                left = [set(x) for x in asked[a:z]]
                chosen = [i for i, (t, h) in enumerate(zip(text.tolist(), hashes.tolist(), strict=True)) if h in left[t] and not left[t].remove(h)]
                pieces = [values[offsets[i] : offsets[i + 1]] for i in chosen]
                ends = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
                flat = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[chosen]), textio.lists(flat.view(np.int64), ends, pa.int64())], ["h", "grams"])

    texts = rows.join(wanted, rows["id"] == wanted["keeper"]).select("text", "wanted").mapInArrow(sets, "h long, grams array<long>")
    members = texts.groupBy("h").agg(F.first("grams").alias("grams")).join(members, "h")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("b", x).alias("one"), F.greatest("b", x).alias("two")))
    spread = members.select("component", "h", "b", "grams", F.explode(tiles).alias("t")).select("component", "t.*", "h", "b", "grams")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        one, two = key[1].as_py(), key[2].as_py()
        table = table.combine_chunks()
        ids, b, grams = table.column("h").to_numpy(), table.column("b").to_numpy(), table.column("grams").chunk(0)
        sets_ = np.split(grams.flatten().to_numpy(zero_copy_only=False), np.cumsum(grams.value_lengths().to_numpy())[:-1])
        left = np.flatnonzero(b == one)
        right = left if one == two else np.flatnonzero(b == two)
        links = verify(sets_, left, right, threshold)
        links &= ids[left][:, None] != ids[right]
        roots = local_roots(links, ids[left], ids[right])
        parts = [(ids[left], links.any(1), roots[0])] + ([] if one == two else [(ids[right], links.any(0), roots[1])])
        h, linked, root = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pa.table([pa.array(np.compress(linked, h)), pa.array(np.compress(linked, root))], ["h", "root"])

    links = spread.groupBy("component", "one", "two").applyInArrow(compare, "h long, root long")
    clusters = connected(links, "h", "root").join(classes.select(F.col("h").alias("node"), "keeper"), "node")
    keepers = clusters.groupBy("component").agg(F.min("keeper").alias("keeper"))
    return clusters.drop("keeper").join(keepers, "component").select(F.col("node").alias("h"), "keeper")


def _chains(met: DataFrame) -> DataFrame:
    """Seeds of one document that follow each other in the same other document, as one row: id, chain, their place in both."""
    follow = Window.partitionBy("id", "keeper").orderBy("first_word", "k_first")  # the seeds of one document at most
    step, other = (F.col(c) - F.lag(c).over(follow) for c in ("first_word", "k_first"))
    new = F.coalesce((step > REACH) | (F.abs(other - step) > REACH), F.lit(False)).cast("int")
    chain = F.sum("new").over(follow.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return met.withColumn("new", new).withColumn("chain", chain).groupBy("id", "keeper", "chain").agg(
        F.min("first_word").alias("low"), F.max("first_word").alias("high"), F.min("k_first").alias("k_low"), F.max("k_first").alias("k_high")
    )


def _alike(x: np.ndarray, y: np.ndarray, threshold: float, min_words: int) -> list[tuple[int, int]]:
    """First word and number of words of the longest stretches of ``x`` that stand in ``y``: word hashes of two places.

    A stretch goes from a common 5-gram to another. If its 5-grams and those of ``y`` between the same two fall short
    of the threshold, it is cut where most words are not common.
    """
    if min(len(x), len(y)) < max(min_words, SIZE):
        return []
    x, y = (textio.sequence_hashes(w, np.arange(len(w) - SIZE + 1), np.arange(SIZE, len(w) + 1)) for w in (x, y))
    order = np.argsort(y, kind="stable")
    low, high = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
    at = np.flatnonzero(low < high)
    where = np.zeros(len(at), np.int64)  # of the places in y, the one that follows best
    single = bool((high[at] - low[at] == 1).all())
    if single:
        where = order[low[at]]
    follows = -1
    for i, (a, z) in enumerate(() if single else zip(low[at].tolist(), high[at].tolist(), strict=True)):
        places = order[a:z]
        follows = int(places[0] if follows < 0 or z - a == 1 else places[np.abs(places - follows - 1).argmin()])
        where[i] = follows
    out, left = [], [(0, len(at))]
    while left:
        a, z = left.pop()
        if z <= a or at[z - 1] - at[a] + SIZE < min_words:
            continue
        own, other = np.unique(x[at[a] : at[z - 1] + 1]), np.unique(y[where[a:z].min() : where[a:z].max() + 1])
        common = len(np.intersect1d(own, other, assume_unique=True))
        if common >= threshold * (len(own) + len(other) - common):
            if len(own) > PERIOD:
                out.append((int(at[a]), int(at[z - 1] - at[a]) + SIZE))
        else:
            cut = a + 1 + int(np.maximum(np.diff(at[a:z]), np.abs(np.diff(where[a:z]))).argmax())
            left += [(a, cut), (cut, z)]
    return out


def _shared_seeds(seeds: DataFrame) -> DataFrame:
    """h, id, first_word and keeper, the smallest document with this seed, of the seeds of more than one document."""
    shared = seeds.groupBy("h").agg(F.min("id").alias("keeper"), F.max("id").alias("last")).where("keeper < last").select("h", "keeper")
    shared = stored(shared, "shared")
    hits = stored(seeds.join(shared, "h").select("h", "id", "first_word", "keeper"), "hits")
    release(shared, seeds)
    return hits


def _lost_passages(rows: DataFrame, hits: DataFrame, threshold: float, min_words: int, seed: int) -> DataFrame:
    """id, first_word, n_words and keeper of the passages that a document with a smaller id holds."""
    places = hits.where("id = keeper").groupBy("h").agg(F.min("first_word").alias("k_first"))
    met = hits.where("id > keeper").join(places, "h").select("id", "first_word", "keeper", "k_first")
    chains = stored(_chains(met), "chains")
    asked = lambda doc, low, high, side: chains.select(
        F.col(doc).alias("doc"), F.greatest(F.col(low) - REACH, F.lit(0)).cast("long").alias("begin"),
        (F.col(high) + seed + REACH).cast("long").alias("end"),
        F.col("id").alias("owner"), "chain", "keeper", F.lit(side).alias("side"),
    )
    release(hits)
    wanted = stored(asked("id", "low", "high", 0).unionByName(asked("keeper", "k_low", "k_high", 1)), "asked")
    release(chains)
    names = ["owner", "chain", "keeper", "side", "begin"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, begin, end = batch.column("text"), batch.column("begin").to_numpy(), batch.column("end").to_numpy()
            # Rows that ask for one document follow each other: its words are hashed once.
            new = np.ones(len(text), bool)
            new[1:] = ~pc.equal(text.slice(1), text.slice(0, max(len(text) - 1, 0))).to_numpy(zero_copy_only=False)
            rows_of = np.append(np.flatnonzero(new), len(text))
            data, starts = textio.column_bytes(text.filter(pa.array(new)))
            for p, q in textio.blocks(starts, BLOCK):
                _, _, hashes, first = textio.words(data[starts[p] : starts[q]], starts[p : q + 1] - starts[p])
                a, z = rows_of[p], rows_of[q]
                own = np.repeat(np.arange(q - p), np.diff(rows_of[p : q + 1]))
                low, high = (np.minimum(first[own] + x[a:z], first[own + 1]) for x in (begin, end))
                ends = np.concatenate([[0], np.cumsum(high - low)])
                flat = hashes[np.repeat(low - ends[:-1], high - low) + np.arange(ends[-1])]
                kept = [batch.column(c).slice(a, z - a) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, textio.lists(flat.view(np.int64), ends, pa.int64())], [*names, "words"])

    words = rows.join(wanted, rows["id"] == wanted["doc"]).select(*names, "end", "text").mapInArrow(
        cut, "owner long, chain int, keeper long, side int, begin long, words array<long>"
    )
    # Rows that repeat an id may differ: each of their texts is compared.
    side = lambda k: F.collect_set(F.when(F.col("side") == k, F.col("words")))
    pairs = words.groupBy("owner", "chain", "keeper").agg(
        F.max(F.when(F.col("side") == 0, F.col("begin"))).alias("begin"), side(0).alias("one"), side(1).alias("two")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                one, two = (_word_lists(batch.column(c)[i]) for c in ("one", "two"))
                owner, begin, keeper = (batch.column(c)[i].as_py() for c in ("owner", "begin", "keeper"))
                spans = {s for x in one for y in two for s in _alike(x, y, threshold, min_words)}
                out += [(owner, begin + at, n, keeper) for at, n in sorted(spans)]
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "first_word", "n_words", "keeper"])

    return pairs.mapInArrow(compare, "id long, first_word int, n_words int, keeper long")


def _word_lists(value: pa.ListScalar) -> list[np.ndarray]:
    return [w.values.to_numpy(zero_copy_only=False).view(np.uint64) for w in value.values]


def removals(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, min_words: int = 32, spread: int = 13,
             recall: float = 0.995, block: int = 400, block_grams: int = 1_000_000, min_line: int = SIZE, seed: int = 10) -> DataFrame:
    """Every stretch of words that a document loses: doc_id, first_word, n_words, kept_in (documents with smaller
    ids that hold it or a near copy; the smallest of a cluster keeps its own)."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    bands = bands_for(threshold, recall, BAND_ROWS)
    found = stored(paragraphs(rows, min_line, seed, spread, bands), "paragraphs")
    lines = found.where("unit IS NULL").select("id", "h", "first_word", "n_words", "bands")
    classes = stored(lines.groupBy("h").agg(
        F.min("id").alias("keeper"), F.max("id").alias("last"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands")
    ), "lines")
    near = stored(_near_classes(rows, classes, threshold, min_line, block, block_grams), "near")
    equal = classes.where("keeper < last").select("h", "keeper").join(near.select("h"), "h", "left_anti")
    lost = stored(lines.join(near.unionByName(equal), "h").where("id > keeper").select("id", "first_word", "n_words", "keeper"), "lost")
    release(classes, near)
    seeds = _repeated_seeds(found)
    release(found)
    hits = _shared_seeds(seeds)
    # Written, so that what was shuffled to find them is gone before the texts are shuffled to cut them.
    passages = stored(_lost_passages(rows, hits, threshold, min_words, seed), "passages")
    return _merged(lost.unionByName(passages))


def _merged(lost: DataFrame) -> DataFrame:
    """Stretches of one document that overlap or touch become one. A document's stretches are as many as its words at most."""
    ordered = Window.partitionBy("id").orderBy("first_word")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    marked = lost.withColumn("end", F.col("first_word") + F.col("n_words")).withColumn("new", F.coalesce(F.col("first_word") > before, F.lit(True)).cast("int"))
    merged = marked.withColumn("part", part).groupBy("id", "part").agg(
        F.min("first_word").alias("first_word"), F.max("end").alias("end"), F.sort_array(F.collect_set("keeper")).alias("kept_in")
    )
    return merged.select(F.col("id").alias("doc_id"), "first_word", (F.col("end") - F.col("first_word")).alias("n_words"), "kept_in")


_WORD = re.compile(textio.WORD_PATTERN)


def without(df: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with the stretches of ``spans`` cut out of its texts, from the first word to the last of each; white space
    and punctuation around stay. Lines that lose all their words go with their line break."""
    fields = df.schema.fields
    own, at = free_name(df, "_id"), free_name(df, "_cuts")
    cuts = spans.groupBy(F.col("doc_id").alias(own)).agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias(at))
    joined = df.join(cuts, F.col(id_col) == F.col(own), "left").drop(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_cut(t, c) for t, c in zip(batch.column(text_col).to_pylist(), batch.column(at).to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if f.name == text_col else batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    changed = joined.where(F.col(at).isNotNull()).mapInArrow(run, df.schema)
    return joined.where(F.col(at).isNull()).drop(at).unionByName(changed)


def _cut(text: str, cuts: list[dict]) -> str:
    words = [m.span() for m in _WORD.finditer(text)]
    mark = next(c for c in map(chr, range(0x110000)) if c not in text)
    out, at = [], 0
    for cut in cuts:
        out.append(text[at : words[cut["first_word"]][0]])
        at = words[cut["first_word"] + cut["n_words"] - 1][1]
    out.append(text[at:])
    lines = mark.join(out).split("\n")
    return "\n".join(line for line in lines if mark not in line or _WORD.search(line.replace(mark, " "))).replace(mark, "")
