"""Similarity join of texts on the Jaccard coefficient of their word n-grams, by MinHash banding.

Words are runs of ASCII letters, digits, ``_`` and characters outside ASCII in lower case; a text of fewer than
``size`` words has one n-gram of all of them. The number of bands follows from the recall that pairs at the threshold
must reach.

1. Texts of one set of n-grams form a class; only its hash and its smallest id go on. Copies are thus never compared.
2. Every class sends its band hashes, nothing else. Classes that meet in a band are joined to the smallest hash there,
   a star and no pairs; the components of these stars hold every pair that banding finds.
3. The n-gram sets of the classes that met somebody are cut into blocks of bounded number and size within their
   component. A task verifies two blocks on the full sets and returns a row per class: how many documents and classes
   it is linked with, and the smallest class hash it reaches.
4. Components of these rows are the groups. The links of a document are those of its class, plus its copies.

One row per input row: doc_id; class_id, the smallest document of its group; copy_of, the smallest of its exact
copies; n_links, the number of other documents with a coefficient of at least the threshold; kept (doc_id =
class_id, and of several classes with that id only one); text_hash, Spark's xxhash64 of the text, which tells rows of one id apart. NULL texts and texts without words link with nothing. Rows with a NULL id count as documents, but never
represent a class; if all rows of a class have a NULL id, it is left alone with NULL as class. Rows that repeat an id
count as documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerpulse.llm import textio
from tickerpulse.llm.components import connected, local_roots
from tickerpulse.llm.minhash import band_hashes, bands_for
from tickerpulse.session import cut_lineage

BAND_ROWS = 4


def _shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of lower-case texts: first and last text, hashed n-grams without repeats, where each text's begin."""
    data, starts = textio.column_bytes(texts)
    for a, z in textio.blocks(starts):
        _, _, hashes, first = textio.words(data[starts[a] : starts[z]], starts[a : z + 1] - starts[a])
        yield a, z, *textio.sets_of(*textio.shingles(hashes, first, size))


def _set_hashes(values: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Two hashes of every set; the sets are not empty."""
    return [np.add.reduceat(textio.mix(values), begin[:-1]), np.bitwise_xor.reduceat(textio.mix(values + textio.U64(77)), begin[:-1])]


def sketches(rows: DataFrame, size: int, bands: int) -> DataFrame:
    """id, text_hash, two hashes of the n-gram set (NULL if empty), its size, and the band hashes of ``rows`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, values, offsets in _shingle_sets(batch.column("text"), size):
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                begin = np.append(offsets[:-1][full], offsets[-1])
                hashes = np.zeros((z - a, 2), np.uint64)
                found = np.zeros((z - a, bands), np.int64)
                if len(full):
                    hashes[full] = np.stack(_set_hashes(values, begin), axis=1)
                    found[full] = band_hashes(values, begin, bands, BAND_ROWS)
                empty = n == 0
                columns = [pa.array(hashes[:, k].view(np.int64), mask=empty) for k in (0, 1)]
                columns += [pa.array(n, pa.int32()), textio.lists(found.reshape(-1), np.arange(z - a + 1) * bands, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, z - a), batch.column("text_hash").slice(a, z - a), *columns], ["id", "text_hash", "h1", "h2", "n", "bands"])

    source = rows.select("id", F.xxhash64("text").alias("text_hash"), F.lower("text").alias("text"))
    return source.mapInArrow(run, "id long, text_hash long, h1 long, h2 long, n int, bands array<long>")


def verify(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, cells: int = 4_000_000) -> np.ndarray:
    """Which sets of ``left`` and ``right`` (numbers into ``sets``) have a Jaccard coefficient of the threshold or more."""
    length = np.fromiter(map(len, sets), np.int64, len(sets))
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), length)
    shared = np.bincount(column, minlength=len(values)) > 1
    number = np.cumsum(shared) - 1
    inside = shared[column]
    owner, column = owner[inside], number[column[inside]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    width = max(1, cells // len(sets))
    for at in range(0, int(shared.sum()), width):
        low, high = np.searchsorted(column, (at, at + width))
        part = np.zeros((len(sets), min(width, int(shared.sum()) - at)), np.float32)
        part[owner[low:high], column[low:high] - at] = 1
        common += part[left] @ part[right].T
    union = length[left][:, None] + length[right] - common
    return common / np.maximum(union, 1).astype(np.float64) >= threshold


def similar(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, size: int = 5, recall: float = 0.999,
            block: int = 400, block_grams: int = 1_000_000) -> DataFrame:
    """The join of a table of texts with itself; see the head of the module."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bands = bands_for(threshold, recall, BAND_ROWS)
    sketch = cut_lineage(sketches(rows, size, bands))
    classes = cut_lineage(sketch.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")
    ).withColumn("key", F.xxhash64("h1", "h2")))  # rows that repeat an id can give several classes one ``rep``
    known = classes.where("rep IS NOT NULL")
    met = known.select("key", F.posexplode("bands").alias("band", "hash"))
    roots = met.groupBy("band", "hash").agg(F.min("key").alias("root"), F.max("key").alias("other")).where("root < other").drop("other")
    parts = cut_lineage(connected(met.join(roots, ["band", "hash"]).where("key <> root").select("key", "root"), "key", "root"))
    members = parts.join(known.select("key", "rep", "h1", "h2", "copies", "n"), parts["node"] == F.col("key")).drop("node")
    blocks = members.groupBy("component").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_grams)).cast("int").alias("blocks")
    )
    members = members.join(blocks, "component").withColumn("b", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    found = cut_lineage(_verified(_with_sets(rows, members, size), threshold))
    links = found.groupBy("key").agg(F.sum("n_docs").alias("n_docs"))
    groups = cut_lineage(connected(found, "key", "root").join(known.select(F.col("key").alias("node"), "rep"), "node"))
    heads = cut_lineage(groups.groupBy("component").agg(F.min(F.struct("rep", "node")).alias("head")))
    groups = groups.join(heads, "component").select("node", "head")
    of_class = classes.select("key", "h1", "h2", "rep", "copies").join(links, "key", "left").join(groups, F.col("key") == F.col("node"), "left")
    of_class = of_class.select(
        "h1", "h2", "rep", F.coalesce("head.rep", "rep").alias("group"), F.coalesce("head.node", "key").eqNullSafe(F.col("key")).alias("heads"),
        (F.coalesce("n_docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    out = sketch.select("id", "text_hash", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    alone = F.col("h1").isNull()
    class_id = F.when(alone, F.col("id")).otherwise(F.col("group"))
    return out.select(
        F.col("id").alias("doc_id"), class_id.alias("class_id"), F.when(alone, F.col("id")).otherwise(F.col("rep")).alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("id").eqNullSafe(class_id) & (alone | F.col("heads"))).alias("kept"), "text_hash",
    )


def _with_sets(rows: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """The n-gram set of every member, from the row of its smallest id that has this set."""
    texts = rows.select(F.col("id").alias("rep"), "text").join(members, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "component", "copies", "blocks", "b"]
        for batch in batches:
            for a, z, values, offsets in _shingle_sets(batch.column("text"), size):
                full = np.flatnonzero(np.diff(offsets))
                own = np.zeros(z - a, bool)
                if len(full):
                    hashes = _set_hashes(values, np.append(offsets[:-1][full], offsets[-1]))
                    asked = [batch.column(c).to_numpy()[a:z][full].view(np.uint64) for c in ("h1", "h2")]
                    own[full] = (hashes[0] == asked[0]) & (hashes[1] == asked[1])
                kept = [batch.column(c).slice(a, z - a) for c in names]
                found = pa.RecordBatch.from_arrays([*kept, textio.lists(values.view(np.int64), offsets, pa.int64())], [*names, "grams"])
                yield found.filter(pa.array(own))

    return texts.select("key", "component", "copies", "blocks", "b", "h1", "h2", F.lower("text").alias("text")).mapInArrow(
        run, "key long, component long, copies long, blocks int, b int, grams array<long>"
    )


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """key, n_docs, root per class and tile: links by documents and the smallest class reached."""
    k = F.sequence(F.lit(0), F.col("blocks") - 1)
    tiles = F.transform(k, lambda x: F.struct(F.least("b", x).alias("one"), F.greatest("b", x).alias("two")))
    spread = members.select("component", "key", "copies", "b", "grams", F.explode(tiles).alias("t")).select("component", "t.*", "key", "copies", "b", "grams")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        one, two = key[1].as_py(), key[2].as_py()
        table = table.combine_chunks()
        ids, copies, b = (table.column(c).to_numpy() for c in ("key", "copies", "b"))
        ids, first = np.unique(ids, return_index=True)  # rows that repeat an id
        copies, b = copies[first], b[first]
        grams = table.column("grams").chunk(0) if table.column("grams").num_chunks else pa.array([], pa.list_(pa.int64()))
        flat, starts = grams.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(grams.value_lengths().to_numpy())])
        sets = [flat[starts[i] : starts[i + 1]] for i in first.tolist()]
        left = np.flatnonzero(b == one)
        right = left if one == two else np.flatnonzero(b == two)
        links = verify(sets, left, right, threshold)
        links &= ids[left][:, None] != ids[right]
        roots = local_roots(links, ids[left], ids[right])
        parts = [(ids[left], links @ copies[right], roots[0])] + ([] if one == two else [(ids[right], copies[left] @ links, roots[1])])
        out = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.table([pa.array(np.compress(out[1] > 0, c).astype(np.int64)) for c in out], ["key", "n_docs", "root"])

    return spread.groupBy("component", "one", "two").applyInArrow(compare, "key long, n_docs long, root long")
