"""Order statistics of outlier rounds from histograms, and how much travels for neighbours."""

from math import ceil

import numpy as np
import pandas as pd
import pytest

from tickerpulse.operators import neighbors, outliers


def plain(pdf, names, per_round, share, directions):
    """Keys that stay, round by round in numpy."""
    kept = set(pdf.id)
    for _, part in pdf.dropna(subset=["y"]).groupby("y"):
        x, ids = part[names].to_numpy(dtype=float), part.id.to_numpy()
        sd = x.std(0)
        z, left, number = (x - x.mean(0)) / np.where(sd == 0, 1.0, sd), ceil(len(x) * share), 0
        step = per_round or max(1, ceil(left / 10))
        while left > 0:
            u = outliers.round_directions(0, number, directions, len(names))
            number += 1
            k = outliers.DirectionMoments(u).kurtosis(outliers.monomials(z, outliers.moment_powers(len(names))).sum(0))
            if not np.isfinite(k).any():
                break
            p = outliers.along(z, u[int(np.nanargmax(k))])
            q1, q3 = np.quantile(p, [0.25, 0.75])
            flagged = np.flatnonzero((p < q1 - 1.5 * (q3 - q1)) | (p > q3 + 1.5 * (q3 - q1)))
            out = flagged[np.lexsort((ids[flagged], -np.abs(p[flagged])))[: min(step, left)]]
            if not len(out):
                break
            left -= len(out)
            kept -= set(ids[out].tolist())
            z, ids = np.delete(z, out, axis=0), np.delete(ids, out)
    return kept


@pytest.mark.parametrize("per_round, bins, few", [(9, 4096, 4096), (7, 64, 8)])
def test_rounds_equal_the_plain_loop(spark, monkeypatch, per_round, bins, few):
    monkeypatch.setattr(outliers, "BINS", bins)
    monkeypatch.setattr(outliers, "FEW", few)
    random = np.random.default_rng(3)
    pdf = pd.DataFrame(np.round(random.standard_t(2, size=(900, 2)), 2), columns=["a", "b"])
    # Repeated rows, also far out.
    pdf.loc[:199, ["a", "b"]] = [0.0, 1.0]
    pdf.loc[200:239, ["a", "b"]] = [30.0, -20.0]
    pdf = pdf.assign(id=np.arange(900), y=[None if i % 50 == 1 else "pq"[i % 3 == 0] for i in range(900)])
    got = outliers.remove_outliers(spark.createDataFrame(pdf).repartition(3), "y", "id", ["a", "b"], per_round, 0.03, 50)
    assert {r["id"] for r in got.collect()} == plain(pdf, ["a", "b"], per_round, 0.03, 50)


def test_a_pass_moves_no_values(spark):
    rows = spark.range(20_000).selectExpr("'p' AS label", "id AS key", "CAST(id % 7919 AS double) AS x0").repartition(4)
    centre, spread = {"p": np.zeros(1)}, {"p": np.ones(1)}
    one = {"p": np.ones(1)}
    limits = outliers._whiskers(rows, one, {"p": []}, centre, spread, {"p": 8000.0}, {"p": 20_000})["p"]
    q1, q3 = np.quantile(np.arange(20_000) % 7919, [0.25, 0.75])
    assert limits == pytest.approx((q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
    # All rows of a file that one task reads are dealt to all tasks before the rounds.
    kept = outliers.remove_outliers(rows.coalesce(1), "label", "key", ["x0"], None, 0.01, 4)
    assert kept.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_tiles_hold_more_rows_of_short_vectors(spark, monkeypatch):
    seen = []
    tiles = neighbors._tiles
    monkeypatch.setattr(neighbors, "_tiles", lambda size, rows: seen.append(rows) or tiles(size, rows))
    random = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": np.arange(300), "x": list(random.normal(size=(300, 6))), "y": 1})
    df = spark.createDataFrame(pdf)
    found = neighbors.nearest(df, df, "id", "x", "y", 3).toPandas()
    assert seen == [neighbors.TILE_BYTES // 48] and len(found) == 900
    x = np.stack(pdf.x)
    want = np.sort(np.linalg.norm(x[:, None] - x[None], axis=2), axis=1)[:, :3]
    assert np.allclose(np.stack(found.sort_values(["id", "distance"]).groupby("id")["distance"].apply(list)), want, atol=1e-6)
