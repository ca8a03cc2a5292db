"""Many features: whole classes are played in tasks, covariances and draws are matrix products."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickerpulse.operators import balance, mvstats, outlier_rounds, outliers


def test_classes_in_tasks_follow_the_literal_rule(spark, monkeypatch):
    random = np.random.default_rng(5)
    names = [f"f{i}" for i in range(5)]
    pdf = pd.DataFrame(random.standard_t(3, size=(160, 5)), columns=names).assign(id=range(160), y=["p", "q"] * 80)
    df = spark.createDataFrame(pdf)
    ids = lambda kept: sorted(r["id"] for r in kept.select("id").collect())
    got = ids(outlier_rounds.remove_outliers_of_many_features(df, "y", "id", names, share=0.04, directions=60))
    assert got == ids(outliers.remove_outliers(df, "y", "id", names, 1, share=0.04, directions=60)) and len(got) < 160
    nulls = df.withColumn("y", F.when(F.col("id") >= 150, None).otherwise(F.col("y")))
    assert set(range(150, 160)) <= set(ids(outlier_rounds.remove_outliers_of_many_features(nulls, "y", "id", names, share=0.02, directions=20)))


def test_wide_covariance_equals_the_narrow_one(spark, monkeypatch):
    random = np.random.default_rng(6)
    x = (random.normal(size=(60, 3)) + 1e6).astype(object)
    x[::7, 1] = None
    x[40:, 2] = None
    df = spark.createDataFrame([(None if i % 3 == 0 else i % 3, *v) for i, v in enumerate(x.tolist())], "k int, a double, b double, c double")
    for keys in ([], ["k"]):
        want = {tuple(r)[:-1]: r["cov"] for r in mvstats.covariance(df, ["a", "b", "c"], keys).collect()}
        got = {tuple(r)[:-1]: r["cov"] for r in mvstats._covariance_by_products(df, ["a", "b", "c"], keys).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert [v is None for v in got[k]] == [v is None for v in want[k]]
            assert np.allclose(*[[0.0 if v is None else v for v in m] for m in (got[k], want[k])], atol=1e-6)


def test_the_planner_bears_draws_of_many_features(spark):
    names = [f"x{i}" for i in range(64)]
    out = balance.simulate(spark, np.arange(64.0), np.eye(64) + 0.5, names, 300, 1)
    assert np.allclose([out.agg(F.mean(f)).first()[0] for f in ("x0", "x63")], [0.0, 63.0], atol=1e-9) and out.count() == 300
