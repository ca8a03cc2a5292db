"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickerpulse.session import dropping_shuffles, remove, work_path

def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, read by column, and safe from lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with dropping_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_in = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read any more."""
    for table in tables:
        remove(table.sparkSession, table.stored_in)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
