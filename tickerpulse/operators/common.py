"""Thin helpers over select, filter, sort and union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL; a NULL key meets a NULL key. The columns are those of a join by name."""
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all tasks, for costly work on each: a file of few row groups is read by as few tasks."""
    session = df.sparkSession
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism))


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def lookup_rows(df: DataFrame, key: str, value: object, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows of one key; the comparison reaches the scan."""
    found = df.filter(F.col(key) == F.lit(value))
    return found.select(*cols) if cols else found


def after_day(df: DataFrame, date: str, day: str | Column) -> DataFrame:
    """Drop the edge of the range: rows up to and including ``day``."""
    return df.filter(F.col(date) > (F.lit(day).cast("date") if isinstance(day, str) else day))


def with_text(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose texts are all present."""
    return df.dropna(subset=list(cols))


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows in a stated order; there is no unordered form."""
    return df.orderBy(*order).limit(n)


def farthest(df: DataFrame, col: str, key: str) -> DataFrame:
    """The one row with the largest absolute value."""
    return df.orderBy(F.abs(col).desc(), key).limit(1)


def bernoulli_sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    return df.sample(False, fraction, seed)


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    """Frequency table in the order of the values."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label)


def largest_class(df: DataFrame, label: str) -> DataFrame:
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n").alias("max_class_len"))


def rows_at_extreme(df: DataFrame, col: str, largest: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Rows that hold the maximum (or minimum) of ``col``, ties included, overall or per key.

    The extreme is an aggregate merged before the shuffle and joined back by equality, so neither a
    big key nor a big tie is gathered in one task. A NULL key is a key; a key whose values are all NULL has no extreme.
    """
    extreme = df.groupBy(*[F.col(k).alias(f"_r_{k}") for k in keys]).agg((F.max if largest else F.min)(col).alias("_extreme"))
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return df.join(extreme, [*same, F.col(col) == F.col("_extreme")], "left_semi").select(*df.columns)
