"""Near-duplicate vectors of one label: tiled comparison in the order of principal components.

All vectors are turned onto the principal axes of the whole table, which keeps their cosines and moves most of the
length to the leading dimensions. The products of two tiles are summed over these first; what the rest can add is at
most the product of the suffix lengths, so a pair stops as soon as it cannot reach the threshold. The pairs that are
left get their cosine from the original components in double precision.

Unit vectors with cosine of at least t are at most sqrt(2 - 2t) apart, so on the first axis as well: strips of that
width along it are compared with themselves and the next strip only. A strip is cut into blocks of at most
``block`` vectors, and a task compares two blocks. It returns a row per linked vector, never a pair: the number of
its links and the smallest id it reaches inside the tile. Components follow from these rows.

Vectors of different length are compared with none. Rows that repeat a vec_id are not linked with each other, and
each gets the links of all of them. A NULL vec_id links with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerpulse.llm.components import connected, local_roots
from tickerpulse.session import cut_lineage

SLACK = 1e-9  # rounding of the turned products; pairs this close to the threshold are computed in full


def _usable(vector: Column) -> Column:
    """No NULL, no infinite or undefined component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)  # so that tiny and huge components survive squaring
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def principal_axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length d, the axes by descending length that the unit vectors have along them. The driver gets a
    d x d sum per length that occurs, never a vector."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                unit = _unit(_matrix(batch.filter(pa.array(lengths == d)).column("v")))
                total[d] = total.get(d, 0) + unit.T @ unit
        if total:
            flat = [(d, i, s) for d, t in total.items() for i, s in enumerate(t.reshape(-1).tolist())]
            yield pa.record_batch([pa.array(c) for c in zip(*flat, strict=True)], ["d", "i", "s"])

    found = rows.select("v").mapInArrow(sums, "d long, i long, s double").groupBy("d", "i").agg(F.sum("s").alias("s")).toPandas()
    axes = {}
    for d, part in found.groupby("d"):
        moment = part.sort_values("i")["s"].to_numpy().reshape(d, d)
        _, vectors = np.linalg.eigh((moment + moment.T) / 2)
        axes[int(d)] = vectors[:, ::-1]
    return axes


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, steps: tuple[int, ...] = (4, 8, 16, 32)) -> np.ndarray:
    """Which rows of a and b have a cosine of at least ``threshold``."""
    unit_a, unit_b = _unit(a), _unit(b)
    turned_a, turned_b = unit_a @ axes, unit_b @ axes
    rest = lambda x, k: np.sqrt((x[:, k:] ** 2).sum(1))
    links = np.zeros((len(a), len(b)), bool)
    done, product = 0, np.zeros((len(a), len(b)))
    alive = None  # pairs by number once they are few
    for k in (*[s for s in steps if s < a.shape[1]], a.shape[1]):
        suffix_a, suffix_b = rest(turned_a, k), rest(turned_b, k)
        if alive is None:
            product += turned_a[:, done:k] @ turned_b[:, done:k].T
            open_ = product + suffix_a[:, None] * suffix_b >= threshold - SLACK
            if open_.mean() < 0.05:
                alive = np.nonzero(open_)
                product = product[alive]
        else:
            i, j = alive
            product = product + np.einsum("ij,ij->i", turned_a[i, done:k], turned_b[j, done:k])
            open_ = product + suffix_a[i] * suffix_b[j] >= threshold - SLACK
            alive, product = (i[open_], j[open_]), product[open_]
        done = k
    if alive is None:
        alive = np.nonzero(open_)
    for at in range(0, len(alive[0]), 200_000):
        i, j = alive[0][at : at + 200_000], alive[1][at : at + 200_000]
        links[i, j] = np.einsum("ij,ij->i", unit_a[i], unit_b[j]) >= threshold
    return links


def near_duplicates(df: DataFrame, id_col: str, vector_col: str, label_col: str, threshold: float = 0.98, block: int = 1000) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("v"))).withColumn("d", F.size("v"))
    axes = principal_axes(usable)
    if not axes:
        return _result(rows, None, None)
    width = float(np.sqrt(2 - 2 * min(threshold, 1 - 1e-6))) + 1e-6
    first = F.create_map(*[F.lit(x) for d, a in axes.items() for x in (d, F.array(*[F.lit(float(x)) for x in a[:, 0]]))])[F.col("d")]
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    along = F.aggregate(F.zip_with("v", first, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / length
    strip = F.coalesce(F.floor(F.nanvl(along, F.lit(0.0)) / width).cast("int"), F.lit(0))
    placed = cut_lineage(usable.withColumn("strip", strip))
    n = placed.groupBy("label", "d", "strip").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    beside = lambda k, name: n.select("label", "d", (F.col("strip") + k).alias("strip"), F.col("n").alias(name))
    keys = ["label", "d", "strip"]
    # Written, so that the join with a crowded strip is one of plain tables, which Spark can split or broadcast by size.
    n = cut_lineage(n.join(beside(1, "below"), keys, "left").join(beside(-1, "above"), keys, "left"))
    blocked = placed.join(n, keys).withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda strip, across, one, two, side: F.struct(strip.alias("strip"), F.lit(across).alias("across"), one.alias("one"), two.alias("two"), side.alias("side"))
    s, b = F.col("strip"), F.col("b")
    tiles = F.concat(
        F.transform(upto("n"), lambda k: tile(s, False, F.least(b, k), F.greatest(b, k), (b > k).cast("int"))),
        F.transform(upto("above"), lambda k: tile(s, True, b, k, F.lit(0))),
        F.transform(upto("below"), lambda k: tile(s - 1, True, k, b, F.lit(1))),
    )
    spread = blocked.select("label", "d", "id", "v", F.explode(tiles).alias("t")).select("label", "d", "t.*", "id", "v")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        d, across, one, two = (key[i].as_py() for i in (1, 3, 4, 5))
        ids, side, v = table.column("id").to_numpy(), table.column("side").to_numpy(), _matrix(table.column("v"))
        own = not across and one == two
        left = np.flatnonzero(side == 0)
        right = left if own else np.flatnonzero(side == 1)
        links = tile_links(v[left], v[right], axes[d], threshold)
        links &= ids[left][:, None] != ids[right]
        roots = local_roots(links, ids[left], ids[right])
        parts = [(ids[left], links.sum(1), roots[0])] + ([] if own else [(ids[right], links.sum(0), roots[1])])
        out = [np.concatenate(c) for c in zip(*parts, strict=True)]
        linked = out[1] > 0
        return pa.table([pa.array(c[linked].astype(np.int64)) for c in out], ["id", "n_links", "root"])

    found = spread.groupBy("label", "d", "strip", "across", "one", "two").applyInArrow(compare, "id long, n_links long, root long")
    found = cut_lineage(found)
    # Rows of one id count their own links; the rows of a result get those of their id.
    links = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    return _result(rows, links, connected(found, "id", "root"))


def _result(rows: DataFrame, links: DataFrame | None, components: DataFrame | None) -> DataFrame:
    out = rows.select(F.col("id").alias("vec_id"))
    if links is None:
        out = out.withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("vec_id"))
    else:
        out = out.join(links, F.col("vec_id") == F.col("id"), "left").drop("id").join(components, F.col("vec_id") == F.col("node"), "left")
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))
