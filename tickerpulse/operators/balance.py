"""Classes balanced with simulated rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerpulse.operators.common import union_all
from tickerpulse.operators.mvstats import covariance

# A covariance that is not positive definite gets a growing ridge, until its
# determinant reaches this value or the steps are used up.
ENOUGH_DETERMINANT = 15.0
MAX_STEPS = 50


def simulate(spark: SparkSession, mean: Sequence[float], cov: np.ndarray, features: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` rows of a normal distribution with this covariance, whose column means are exactly ``mean``.

    Rows are drawn in parallel from seeds; the d column means of the draw are its only result on the driver.
    """
    factor = _factor(np.asarray(cov, dtype=float))
    d = len(features)
    # A fixed number of partitions makes the seeded draw repeatable.
    rows = spark.range(0, n, 1, max(1, ceil(n / 1_000_000)))
    noise = rows.select(*[F.randn(seed * d + j).alias(f"e{j}") for j in range(d)])
    names = list(features)

    def mix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros((len(batch), d))
            for j, e in enumerate(batch.to_numpy().T):
                out[:, j:] += e[:, None] * factor[j:, j]
            yield pd.DataFrame(out, columns=names)

    drawn = noise.mapInPandas(mix, ", ".join(f"`{f}` double" for f in names))
    centre = drawn.agg(*[F.mean(f).alias(f) for f in features]).first()
    return drawn.select(*[(F.col(f) - centre[f] + float(m)).alias(f) for f, m in zip(features, mean)])


def balance(df: DataFrame, label: str, features: Sequence[str], n: int | None = None, seed: int = 0) -> DataFrame:
    """Every class filled up to ``n`` rows (the largest class by default) with simulated ones.

    Returns (features, label, simulated).
    """
    stats = covariance(df, features, [label])
    means = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.mean(f) for f in features]).alias("mean"))
    # One row of d² + d numbers per class.
    classes = means.join(stats, label).orderBy(label).collect()
    n = n or max(r["n"] for r in classes)
    too_big = [r[label] for r in classes if r["n"] > n]
    if too_big:
        raise ValueError(f"n={n} is smaller than class {too_big[0]!r}")
    kind = df.schema[label].dataType
    observed = df.select(*[F.col(f).cast("double").alias(f) for f in features], label, F.lit(False).alias("simulated"))
    parts = [observed]
    for at, r in enumerate(classes):
        if r["n"] < n:
            cov = np.reshape(r["cov"], (len(features), len(features)))
            extra = simulate(df.sparkSession, r["mean"], cov, features, n - r["n"], seed + at)
            parts.append(extra.select(*features, F.lit(r[label]).cast(kind).alias(label), F.lit(True).alias("simulated")))
    return union_all(*parts)


def _factor(cov: np.ndarray) -> np.ndarray:
    """Lower triangular factor of the covariance, made positive definite where it is not."""
    try:
        return np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        return np.linalg.cholesky(cov + _ridge(cov) * np.eye(len(cov)))


def _ridge(cov: np.ndarray) -> float:
    """After k steps the ridge has grown to k(k−1)/2 times the smallest eigenvalue; the first k that is enough counts."""
    values = np.linalg.eigvalsh(cov)
    k = np.arange(MAX_STEPS + 1)
    ridges = np.abs(values).min() * k * (k - 1) / 2
    enough = np.prod(values[None, :] + ridges[:, None], axis=1) >= ENOUGH_DETERMINANT
    ridge = ridges[int(np.argmax(enough)) if enough.any() else MAX_STEPS]
    # A covariance of lower rank has a zero eigenvalue and never grows: add the least that can be factored.
    least = 1e-9 * max(float(values.max()), 1.0)
    return float(ridge if values.min() + ridge > least / 10 else ridge + least - min(values.min() + ridge, 0.0))
