"""Checks of the raw tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null), counted in one pass."""
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null")) for c in cols or df.columns]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows repeat an earlier key; NULL keys equal each other."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def duplicate_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All rows after the first of their key.

    ``order`` must tell rows of one key apart. The first row is found by a minimum, merged before
    the shuffle, and joined back: no task sorts a key's rows, however many share it.
    """
    position = F.struct(*order)
    first = df.groupBy(*keys).agg(F.min(position).alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = first.filter(F.col("_n") > 1).select(*[F.col(k).alias(f"_{k}") for k in keys], "_first")
    same_key = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(first, [*same_key, position > F.col("_first")]).select(*df.columns)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def distinct_count(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count_distinct(col).alias("n_distinct"))


def missing_days(days: DataFrame, start: str | Column, end: str | Column, date: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    """Days of the closed range [start, end] that a table has no row for (per key, if keys are given)."""
    first, last = (F.lit(x).cast("date") if isinstance(x, str) else x for x in (start, end))
    days = days.select(*keys, F.col(date).cast("date").alias(date)).distinct()
    calendar = F.explode(F.sequence(first, last)).alias(date)
    if keys:
        wanted = days.select(*keys).distinct().select(*keys, calendar)
    else:
        wanted = days.sparkSession.range(1).select(calendar)
    return wanted.join(days, [*keys, date], "left_anti")


def is_covered(days: DataFrame, start: str | Column, end: str | Column, date: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    missing = missing_days(days, start, end, date, keys)
    return missing.agg(F.count(F.lit(1)).alias("n_missing")).withColumn("covered", F.col("n_missing") == 0)


def has_no_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    total = sum((F.count_if(F.col(c).isNull()) for c in cols or df.columns), F.lit(0))
    return df.agg(total.alias("n_null")).withColumn("complete", F.col("n_null") == 0)
