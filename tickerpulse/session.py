"""Session settings and lineage control."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Join choice by measured sizes: copies to all executors only below this size, hash tables per
    # partition only if every partition of the side is small, otherwise sort and merge.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "2m",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # A group-by that collects sets keeps hashing until this many groups per task.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go when the last plan that reads them does.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "tickerpulse", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate data: ``spark.checkpoint.dir``, else one below the warehouse. The rule is the
    same for every master; on a cluster both settings name folders that all executors reach.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    return path or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store its path names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the program ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            remove(spark, path)

    atexit.register(clean)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for what is written inside; the one before comes back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def dropping_shuffles(spark: SparkSession) -> contextlib.AbstractContextManager:
    """What is written inside lets go of its shuffle files once it is written."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and its shuffle files are gone."""
    path = work_path(df.sparkSession, name)
    with dropping_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
