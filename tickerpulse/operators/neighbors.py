"""Exact k nearest neighbours of one table in another."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tickerpulse.session import cut_lineage

# Pivots grow with the root of the train rows, up to what the driver and every task can hold.
MAX_PIVOTS = 4096
# Distances to pivots that a task holds at a time.
CELLS_AT_ONCE = 1 << 18
# Bytes of a tile's vectors, and test rows that meet it at a time.
TILE_BYTES = 1 << 24
PART_ROWS = 1 << 14
MAX_TASKS = 2000
# Pairs whose distance is added up at a time.
PAIRS = 1 << 16
# Squares by a matrix product stray by less than this share of both squared lengths, rounding included, up to hundreds of dimensions.
STRAY = 1e-12


def nearest(
    test: DataFrame, train: DataFrame, key: str, vector: str, label: str, k: int,
    pivots: int | None = None, tile_rows: int | None = None,
) -> DataFrame:
    """(key, train_key, distance, label): the ``k`` nearest train rows of each test row, ties by train key.

    Train rows go to the cell of their nearest pivot. Cell sizes and radii bound the k-th distance of a test
    row from above and its distance to each cell from below, which rules most cells out. Cells side by side
    form tiles of about ``tile_rows`` rows, and crowded cells are cut into several. A test row is
    sent once to every tile in which a cell remains, in parts of bounded size; a part of a tile returns
    k rows per test row, never its pairs. So where nothing is ruled out, a test row travels once per tile, not per cell.
    By default tiles hold what a task can: tiles of fixed size are as many as the train rows, so what travels would
    grow with their square. Parts are smaller where all tasks would not get one.
    """
    # Both sides are read several times below.
    # Floats travel as they are, and become doubles in the tasks.
    floats = train.schema[vector].dataType == test.schema[vector].dataType == ArrayType(FloatType())
    vectors = F.col(vector).cast("array<float>" if floats else "array<double>").alias("x")
    train = cut_lineage(train.select(F.col(key).alias("train_key"), vectors, F.col(label).alias("label")))
    test = cut_lineage(test.select(F.col(key).alias("test_key"), vectors))
    pivots = pivots or min(max(int(train.count() ** 0.5), 16), MAX_PIVOTS)
    # A bounded number of pivots, spread by a hash of the key.
    sample = train.orderBy(F.xxhash64("train_key"), "train_key").limit(pivots).select("x").collect()
    centres = np.unique(np.array([r["x"] for r in sample], dtype=float), axis=0)
    if not len(centres):
        return _empty(test, train, key)

    celled = _assign(train, centres)
    # One row per pivot.
    cells = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("to_pivot").alias("radius")).collect()
    at = np.array([r["cell"] for r in cells])
    size = np.array([r["n"] for r in cells], dtype="int64")
    radius = np.array([r["radius"] for r in cells])
    part_rows = min(tile_rows or PART_ROWS, max(256, (1 << 23) // len(centres)))
    tile_rows = tile_rows or max(4096, TILE_BYTES // (8 * centres.shape[1]))
    order = np.argsort(_along(centres[at]), kind="stable")
    at, size, radius = at[order], size[order], radius[order]
    first, n_tiles = _tiles(size, tile_rows)

    visits = cut_lineage(_visits(test, centres[at], size, radius, first, n_tiles, k))
    load = {r["tile"]: r["n"] for r in visits.select(F.explode("tiles").alias("tile")).groupBy("tile").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = test.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    part_rows = max(256, min(part_rows, ceil(sum(load.values()) / tasks)))
    # One row per tile and one per pivot, so small enough to broadcast.
    parts_of = [(t, max(1, ceil(load.get(t, 0) / part_rows))) for t in range(int((first + n_tiles).max()))]
    parts = F.broadcast(spark.createDataFrame(parts_of, "tile int, parts int"))
    shape = F.broadcast(spark.createDataFrame(
        [(int(c), i, int(f), int(n)) for i, (c, f, n) in enumerate(zip(at, first, n_tiles))], "cell int, place int, first int, n_tiles int",
    ))
    # Each part of a tile's test rows meets the whole tile.
    test_side = visits.select("test_key", "x", "reach", F.explode("tiles").alias("tile")).join(parts, "tile").select(
        "tile", F.pmod(F.xxhash64("test_key"), "parts").cast("int").alias("part"), "test_key", "x", "reach",
    )
    tile = (F.col("first") + F.pmod(F.xxhash64("train_key"), "n_tiles")).cast("int").alias("tile")
    train_side = celled.join(shape, "cell").select(tile, "place", "train_key", "x", "label").join(parts, "tile").select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "place", "train_key", "x", "label",
    )
    by = ["tile", "part"]
    schema = ", ".join(
        f"{name} {frame.schema[name].dataType.simpleString()}"
        for name, frame in (("test_key", test), ("train_key", train), ("label", train))
    ) + ", distance double"
    placed = centres[at]

    def best_of_tile(_, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return _best(asked, known, k, placed, radius)

    # By their bytes a few tasks would do; by their pairs each part of a tile is worth one.
    dealt = min(MAX_TASKS, 4 * sum(n for _, n in parts_of))
    test_side, train_side = test_side.repartition(dealt, *by), train_side.repartition(dealt, *by)
    local = test_side.groupBy(*by).cogroup(train_side.groupBy(*by)).applyInPandas(best_of_tile, schema)
    closest = Window.partitionBy("test_key").orderBy("distance", "train_key")
    ranked = local.withColumn("rank", F.row_number().over(closest)).filter(F.col("rank") <= k)
    return ranked.select(F.col("test_key").alias(key), "train_key", "distance", "label")


def vote(neighbours: DataFrame, key: str) -> DataFrame:
    """(key, label, probability): votes weighted by 1 / distance; exact hits outvote all others."""
    hits = neighbours.withColumn("_exact", F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy(key)))
    weight = F.when(F.col("_exact") == 1, (F.col("distance") == 0).cast("double")).otherwise(
        F.try_divide(F.lit(1.0), F.col("distance"))
    )
    votes = hits.groupBy(key, "label").agg(F.sum(weight).alias("_votes"))
    total = F.sum("_votes").over(Window.partitionBy(key))
    return votes.select(key, "label", (F.col("_votes") / total).alias("probability"))


def classify(votes: DataFrame, key: str) -> DataFrame:
    """(key, prediction, confidence): the class with the largest vote, the smaller class on a tie."""
    top = F.struct((-F.col("probability")).alias("p"), "label")
    best = votes.groupBy(key).agg(F.min(top).alias("_top"))
    return best.select(key, F.col("_top.label").alias("prediction"), (-F.col("_top.p")).alias("confidence"))


def _along(centres: np.ndarray) -> np.ndarray:
    """Where the pivots stand on the axis along which they differ most."""
    centred = np.clip(np.nan_to_num(centres - centres.mean(axis=0)), -1e100, 1e100)
    return centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]


def _tiles(size: np.ndarray, tile_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First tile and number of tiles of every cell: cells in a row share a tile up to ``tile_rows`` rows, crowded ones have several."""
    first, n_tiles, tile, held = [], [], -1, tile_rows
    for n in size.tolist():
        if held + n > tile_rows:
            tile, held = tile + 1, 0
        first.append(tile)
        n_tiles.append(max(1, ceil(n / tile_rows)))
        tile, held = tile + n_tiles[-1] - 1, held + n
    return np.array(first), np.array(n_tiles)


def _slices(batch: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    """A batch in slices whose distances to ``width`` pivots are of bounded size."""
    step = max(1, CELLS_AT_ONCE // width)
    for start in range(0, len(batch), step):
        yield batch.iloc[start:start + step]


def _assign(train: DataFrame, centres: np.ndarray) -> DataFrame:
    def add_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in _slices(batch, len(centres)):
                x = _stacked(rows["x"])
                # The cell of a pivot that is as good as the nearest serves as well; its radius holds the true distances.
                cell = _squares(x, centres)[0].argmin(axis=1)
                yield rows.assign(cell=cell.astype("int32"), to_pivot=_between(x, centres[cell]))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in train.schema)
    return train.mapInPandas(add_cell, schema + ", cell int, to_pivot double")


def _near(distances: np.ndarray, radius: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which cells may hold a row within reach. The slack keeps rounding from ruling out a cell that just touches the bound."""
    return distances - radius <= (reach * (1 + 1e-9) + 1e-9)[:, None]


def _visits(
    test: DataFrame, centres: np.ndarray, size: np.ndarray, radius: np.ndarray, first: np.ndarray, n_tiles: np.ndarray, k: int,
) -> DataFrame:
    """Every test row with a bound of its k-th distance and the tiles that may hold one of its k nearest."""
    # Cells stand in the order of their tiles.
    starts = np.flatnonzero(np.diff(first, prepend=-1))
    owner = np.repeat(np.arange(len(starts)), n_tiles[starts])

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in _slices(batch, len(centres)):
                squares, stray = _squares(_stacked(rows["x"]), centres)
                distances = np.sqrt(np.maximum(squares - stray, 0.0))
                farthest = np.sqrt(np.maximum(squares + stray, 0.0)) + radius
                nearest_first = np.argsort(farthest, axis=1)
                covered = np.cumsum(size[nearest_first], axis=1) >= min(k, size.sum())
                reach = np.take_along_axis(farthest, nearest_first, axis=1)[np.arange(len(rows)), covered.argmax(axis=1)]
                keep = np.logical_or.reduceat(_near(distances, radius, reach), starts, axis=1)[:, owner]
                tiles = pd.Series([np.flatnonzero(row).astype("int32") for row in keep], index=rows.index, dtype=object)
                yield rows.assign(reach=reach, tiles=tiles)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in test.schema)
    return test.mapInPandas(pick, schema + ", reach double, tiles array<int>")


def _best(asked: pd.DataFrame, known: pd.DataFrame, k: int, centres: np.ndarray, radius: np.ndarray) -> pd.DataFrame:
    """The k nearest of a tile's rows, of each asking row; ``place`` is the cell of a known row."""
    columns = ["test_key", "train_key", "label", "distance"]
    if not len(asked) or not len(known):
        return pd.DataFrame({c: pd.Series(dtype="float64") for c in columns}).iloc[:0]
    known = known.sort_values("train_key", kind="stable")
    known = known.iloc[_first_copies(_stacked(known["x"]), k)]
    x, y = _stacked(asked["x"]), _stacked(known["x"])
    cells, cell = np.unique(known["place"].to_numpy(), return_inverse=True)
    near, nearest_cell = [], []
    for a in range(0, len(x), 4096):
        squares, stray = _squares(x[a:a + 4096], centres[cells])
        near.append(_near(np.sqrt(np.maximum(squares - stray, 0.0)), radius[cells], asked["reach"].to_numpy()[a:a + 4096]))
        nearest_cell.append(squares.argmin(axis=1))
    near = np.concatenate(near)
    together = np.argsort(np.concatenate(nearest_cell), kind="stable")  # rows that ask for the same cells
    parts = []
    width = int(np.clip((1 << 22) // len(y), 1, 256))  # distances held at a time
    for start in range(0, len(x), width):
        rows = together[start:start + width]
        wanted = near[rows].any(axis=0)
        there = np.arange(len(y)) if wanted.all() else np.flatnonzero(wanted[cell])
        if not len(there):
            continue
        row, at = _candidates(x[rows], y if len(there) == len(y) else y[there], k)
        distances = np.concatenate([_between(x[rows[row[a:a + PAIRS]]], y[there[at[a:a + PAIRS]]]) for a in range(0, len(row), PAIRS)])
        # Known rows stand in key order, so their place settles ties by the key.
        order = np.lexsort((at, distances, row))
        row, at, distances = row[order], at[order], distances[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, at, distances = row[first], at[first], distances[first]
        parts.append(pd.DataFrame({
            "test_key": asked["test_key"].to_numpy()[rows[row]],
            "train_key": known["train_key"].to_numpy()[there[at]],
            "label": known["label"].to_numpy()[there[at]],
            "distance": distances,
        }))
    return pd.concat(parts)[columns] if parts else _best(asked.iloc[:0], known, k, centres, radius)


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float, copy=False)


def _first_copies(y: np.ndarray, k: int) -> np.ndarray:
    """All rows but those with ``k`` equal ones before them, which are nobody's k nearest."""
    y = np.ascontiguousarray(y)
    digest = (y @ np.random.default_rng(0).normal(size=y.shape[1])).round(9)
    _, of, n = np.unique(digest, return_inverse=True, return_counts=True)
    crowded = np.flatnonzero(n[of] > k)
    # Only rows that crowd by the digest are compared bit by bit.
    _, of = np.unique(y[crowded].view(f"V{y.dtype.itemsize * y.shape[1]}").ravel(), return_inverse=True)
    order = np.argsort(of, kind="stable")
    late = np.arange(len(order)) - np.searchsorted(of[order], of[order]) >= k
    return np.delete(np.arange(len(y)), crowded[order[late]])


def _candidates(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y), row by row, among which are the k nearest of every x, ties included."""
    if len(y) <= k:
        return np.nonzero(np.ones((len(x), len(y)), bool))
    squares, stray = _squares(x, y)
    if not np.isfinite(squares).all():
        # NaN and what overflows: nothing is told by the product.
        distances = np.stack([_between(np.broadcast_to(one, y.shape), y) for one in x])
        return np.nonzero(~(distances > np.partition(distances, k - 1, axis=1)[:, k - 1, None]))
    # The k-th of a few columns bounds the k-th of all, and leaves few values to order.
    few = np.ascontiguousarray(squares[:, ::max(1, len(y) // max(1024, 8 * k))])
    bound = np.partition(few, k - 1, axis=1)[:, k - 1, None]
    row, at = np.divmod(np.flatnonzero(squares <= bound + 2 * stray), len(y))
    values = squares[row, at]
    begins = np.searchsorted(row, np.arange(len(x)))
    best = np.array([np.partition(part, k - 1)[k - 1] for part in np.split(values, begins[1:])])
    held = values <= (best[:, None] + 2 * stray)[row, 0]
    return row[held], at[held]


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and per row of x how far they may stray."""
    with np.errstate(over="ignore", invalid="ignore"):
        own, other = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        squares = np.column_stack([x, own, np.ones(len(x))]) @ np.column_stack([-2.0 * y, np.ones(len(y)), other]).T
        return squares, (STRAY * (own + other.max(initial=0.0)))[:, None]


def _between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows side by side, added up dimension by dimension: a pair has the same number in any batch."""
    squares = np.zeros(len(x))
    for a, b in zip(x.T, y.T):
        squares += (a - b) ** 2
    return np.sqrt(squares)


def _empty(test: DataFrame, train: DataFrame, key: str) -> DataFrame:
    fields = [("test_key", test, key), ("train_key", train, "train_key"), ("label", train, "label")]
    kinds = {n: f"`{n}` {t.schema[c].dataType.simpleString()}" for c, t, n in fields}
    schema = f"{kinds[key]}, {kinds['train_key']}, distance double, {kinds['label']}"
    return test.sparkSession.createDataFrame([], schema)
