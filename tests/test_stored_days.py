"""Reports make the daily table once, and what is written lets go of its shuffles."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.conftest import rows
from tickerpulse.operators import tfidf
from tickerpulse.plans import reports
from tickerpulse.session import setting, written


def _tables(spark):
    data = [(t, f"2024-01-{d:02d}", float((d * k) % 7) - 3.0, 0.1 * d) for k, t in ((3, "A"), (5, "B")) for d in range(1, 12)]
    days = spark.createDataFrame(data, "ticker string, date string, Y2 double, weighted_vader double").withColumn("date", F.to_date("date"))
    return days.select("ticker", "date", "Y2"), days.select("ticker", "date", "weighted_vader")


def test_reports_read_stored_days(spark):
    refined, weighted = _tables(spark)
    runs = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        runs.add(1)
        return v

    counting = weighted.withColumn("weighted_vader", counted.asNondeterministic()("weighted_vader"))
    out = reports.sentiment_against_price(refined, counting, days=4)
    assert len(rows(out)) == 8 and runs.value == 22
    posts = refined.select(F.lit(1).alias("tweet_id"), "ticker", F.col("date").alias("post_date"), F.lit("positive").alias("sentiment"), F.lit(5).alias("total_engagement"))
    found = reports.peak_days_with_posts(refined, counting, posts)
    assert {(r["ticker"], r["move"]) for r in found.collect()} == {(t, m) for t in "AB" for m in ("rise", "fall")} and runs.value == 44


def test_written_tables_keep_no_shuffles(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with setting(spark, name, "3"):
        assert spark.conf.get(name) == "3"
    assert spark.conf.get(name) == before
    files = lambda: spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    spark._jvm.System.gc()
    held = files()
    out = written(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    assert files() <= held and rows(out, "k") == [(k, 100) for k in range(10)]


def test_texts_without_terms_do_not_crowd_a_pack(monkeypatch):
    monkeypatch.setattr(tfidf, "PACK_TOKENS", 1600)
    n = 1000
    batch = pa.RecordBatch.from_arrays([
        pa.array([{"g": float("nan") if i < 500 else None} for i in range(n)]), pa.array([{"d": i} for i in range(n)]),
        pa.array([{"d": i, "e": i % 2} for i in range(n)]), pa.array([["aa"] if i % 100 == 0 else [] for i in range(n)], pa.list_(pa.string())),
    ], [tfidf.GROUP, "_doc", "_head", "_terms"])
    packs = [r for one in tfidf._pack(iter([batch.slice(0, 700), batch.slice(700)])) for r in one.to_pylist()]
    assert max(sum(len(r["heads"]) for r in packs if r["pack"] == p) for p in {r["pack"] for r in packs}) <= 101
    assert sum(len(r["heads"]) for r in packs) == n and sum(sum(r["tf"]) for r in packs) == 10
    assert len({r["pack"] for r in packs}) <= len(packs) <= len({r["pack"] for r in packs}) + 1
    assert np.array_equal(tfidf._names(pa.chunked_array([batch.column(0)])), [0] * 500 + [1] * 500)
