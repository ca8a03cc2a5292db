"""The driver's tables in the roles of posts, links, prices and dictionaries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tickerpulse.operators.prices import daily_close
from tickerpulse.sources.schemas import LEMMAS, LEXICON

# Ship dates move by this many days, so that prices cover the days of the events.
PRICE_SHIFT_DAYS = 8150

LEXICON_ROWS = [
    ("tion", 1.9), ("ble", 2.4), ("ing", 1.1), ("erin", 0.8), ("qui", 1.6), ("thing", 0.3), ("rewh", 0.5),
    ("ther", -1.3), ("erer", -2.1), ("anea", -0.7), ("sich", -0.9), ("eror", -1.7), ("los", -0.4), ("erst", -1.1),
]
LEMMA_ROWS = [
    ("eren", "erin"), ("thti", "tion"), ("thble", "ble"), ("dans", "sur"), ("erly", "erer"), ("inoran", "oran"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts."""
    return table(spark, sf_dir, "documents")


def local_table(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A small table whose size Spark knows when it plans joins."""
    columns = zip(*rows, strict=True)
    kinds = [pa.float64() if isinstance(f.dataType, DoubleType) else pa.string() for f in schema.fields]
    arrow = pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)
    return spark.createDataFrame(arrow, schema)


def lexicon(spark: SparkSession) -> DataFrame:
    return local_table(spark, LEXICON_ROWS, LEXICON)


def lemmas(spark: SparkSession) -> DataFrame:
    return local_table(spark, LEMMA_ROWS, LEMMAS)


def seconds_of(ts: str) -> Column:
    """Epoch seconds of a time without zone, read as UTC."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a post; its body is the document of the same number, if there is one."""
    events, docs = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    joined = events.join(docs, events["event_id"] == docs["doc_id"], "left")
    return joined.select(
        F.col("event_id").alias("tweet_id"), F.col("user_id").cast("string").alias("writer"),
        seconds_of("ts").alias("post_date"), F.col("text").alias("body"),
        F.floor("value").cast("int").alias("comment_num"), F.col("user_id").cast("int").alias("retweet_num"),
        F.coalesce(F.col("n_chars") % 100, F.lit(0)).cast("int").alias("like_num"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item links a post to one of six tickers, often more than once."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_orderkey").alias("tweet_id"), F.concat("l_returnflag", "l_linestatus").alias("ticker_symbol"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return daily_close(
        items, F.concat("l_returnflag", "l_linestatus"), F.date_add(F.to_date("l_shipdate"), PRICE_SHIFT_DAYS), "l_extendedprice"
    )


def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticker per order priority; many days have no order."""
    return daily_close(table(spark, sf_dir, "orders"), "o_orderpriority", F.to_date("o_orderdate"), "o_totalprice")
