import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tickerpulse.operators import balance as B
from tickerpulse.operators import common, explore, models, mvstats, neighbors, outliers, tfidf
from tickerpulse.operators.quantiles import exact_quantile_columns, values_at_ranks
from tickerpulse.plans.modelling import refined_to_model


@pytest.fixture(scope="module")
def table():
    """One class with most rows, heavy ties, NULLs and a long tail."""
    random = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({
        "id": np.arange(n), "y": np.where(np.arange(n) % 10 < 7, "a", np.where(np.arange(n) % 10 < 9, "b", "c")),
        "u": random.normal(size=n), "v": random.exponential(size=n) ** 3, "t": random.integers(0, 4, n).astype(float),
    })
    pdf.loc[pdf.index % 17 == 0, "v"] = None
    return pdf


def test_exact_quantiles_equal_numpy(spark, table):
    named = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.9, "q4": 1.0}
    df = spark.createDataFrame(table)
    for col in ("u", "v", "t"):
        clean = df.withColumn(col, F.nanvl(col, F.lit(None)))
        for y, *got in rows(exact_quantile_columns(clean, ["y"], col, named)):
            assert np.allclose(got, np.quantile(table[table.y == y][col].dropna(), list(named.values())))


def test_ranks_hold_even_where_the_sketch_is_coarse(spark, table, monkeypatch):
    from tickerpulse.operators import quantiles

    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 5)
    df = spark.createDataFrame(table[["y", "u"]])
    ranks = spark.createDataFrame([("a", 0), ("a", 1000), ("b", 599), ("c", 150)], "y string, rank bigint")
    got = {(y, r): v for y, r, v in rows(values_at_ranks(df, ["y"], "u", ranks, [0.1, 0.5]))}
    assert got == {(y, r): sorted(table[table.y == y].u)[r] for y, r in got} and len(got) == 4


def test_describe_and_class_statistics_equal_pandas(spark, table):
    df = spark.createDataFrame(table[["y", "u", "t"]])
    want = table[["u", "t"]].describe()
    for r in explore.describe(df, ["u", "t"]).collect():
        got = [r[c] for c in ("count", "mean", "std", "min", "q1", "median", "q3", "max")]
        assert np.allclose(got, want[r["feature"]])
    grouped = table[["y", "u", "t"]].groupby("y")
    for r in explore.class_statistics(df, ["u", "t"], "y").collect():
        for name in ("mean", "median", "std", "skew"):
            assert r[name] == pytest.approx(getattr(grouped, name)().loc[r["y"], r["feature"]])


def test_histogram_equals_numpy(spark, table):
    df = spark.createDataFrame(table[["y", "t"]])
    for y in "abc":
        got = [r["n"] for r in explore.histogram(df, ["t"], ["y"], 5).filter(F.col("y") == y).orderBy("bin").collect()]
        assert got == np.histogram(table[table.y == y].t, 5)[0].tolist()
    flat = spark.createDataFrame([("k", 2.0)] * 3, "y string, t double")
    assert [r["n"] for r in explore.histogram(flat, ["t"], ["y"], 3).orderBy("bin").collect()] == [3, 0, 0]


def test_density_equals_formula(spark, table):
    x = table[table.y == "c"].u.to_numpy()
    df = spark.createDataFrame(table[table.y == "c"][["y", "u"]])
    h = x.std(ddof=1) * len(x) ** -0.2
    for r in explore.kernel_density(df, ["u"], ["y"], 9).collect():
        assert r["density"] == pytest.approx(np.exp(-0.5 * ((r["x"] - x) / h) ** 2).sum() / (len(x) * h * np.sqrt(2 * np.pi)))


def test_matrices_equal_numpy(spark, table):
    cols = ["u", "t", "w"]
    pdf = table.assign(w=table.u + table.t + np.arange(len(table)) % 7)[["y", *cols]]
    df = spark.createDataFrame(pdf)
    cov = np.array(mvstats.covariance(df, cols).first()["cov"]).reshape(3, 3)
    assert np.allclose(cov, pdf[cols].cov())
    r2 = dict(rows(mvstats.multiple_r2(df, cols)))
    assert np.allclose([r2[c] for c in cols], 1 - 1 / (np.diag(cov) * np.diag(np.linalg.inv(cov))))
    for y, value in rows(mvstats.generalised_std(df, cols, ["y"])):
        assert value == pytest.approx(np.sqrt(np.linalg.det(pdf[pdf.y == y][cols].cov())))


def test_scaling_and_back(spark, table):
    df = spark.createDataFrame(table[["id", "y", "u", "t"]])
    for keys in ([], ["y"]):
        fitted = mvstats.scaler(df, ["u", "t"], keys)
        scaled = mvstats.scale(df, fitted, ["u", "t"], keys)
        back = mvstats.scale(scaled, fitted, ["u", "t"], keys, inverse=True).orderBy("id").toPandas()
        assert np.allclose(back[["u", "t"]], table[["u", "t"]])
        assert scaled.agg(F.stddev_pop("u")).first()[0] == pytest.approx(1.0, abs=0.05 if keys else 1e-9)


def test_projected_kurtosis_equals_moments(spark):
    random = np.random.default_rng(2)
    x, u = random.normal(size=(500, 3)) ** 3, random.normal(size=(4, 3))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    p = x @ u.T
    want = ((p - p.mean(0)) ** 4).mean(0) / p.var(0) ** 2 - 3
    got = [r["kurtosis"] for r in mvstats.projected_kurtosis(df, "x", u).orderBy("direction").collect()]
    assert np.allclose(got, want)


def test_medoids_equal_brute_force(spark):
    random = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(900), "y": np.arange(900) % 3, "a": random.normal(size=900), "b": random.exponential(size=900)})
    # A third of the rows of one class are the same point.
    pdf.loc[(pdf.y == 0) & (pdf.id < 300), ["a", "b"]] = [0.1, 0.7]
    got = {(r["y"], r["id"]) for r in mvstats.medoids(spark.createDataFrame(pdf), "y", "id", ["a", "b"], batch=4).collect()}
    want = set()
    for y, part in pdf.groupby("y"):
        x = part[["a", "b"]].to_numpy()
        sums = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)).sum(1)
        want |= {(y, i) for i in part.id[sums <= sums.min() * (1 + 1e-9)]}
    assert got == want


def test_outliers_one_at_a_time(spark):
    random = np.random.default_rng(4)
    pdf = pd.DataFrame(random.normal(size=(200, 3)), columns=["a", "b", "c"]).assign(id=range(200), y=["p", "q"] * 100)
    pdf.loc[pdf.id < 4, ["a", "b", "c"]] = 25.0
    kept = outliers.remove_outliers(spark.createDataFrame(pdf), "y", "id", ["a", "b", "c"], share=0.02, directions=500, per_round=1)
    assert sorted(r["id"] for r in kept.select("id").collect()) == list(range(4, 200))


def test_outliers_in_rounds_never_exceed_the_share(spark):
    random = np.random.default_rng(5)
    pdf = pd.DataFrame(random.standard_t(2, size=(600, 2)), columns=["a", "b"]).assign(id=range(600), y=["p", "p", "q"] * 200)
    df = spark.createDataFrame(pdf)
    kept = outliers.remove_outliers(df, "y", "id", ["a", "b"], directions=200, per_round=15)
    counts = dict(rows(kept.groupBy("y").count()))
    assert 360 <= counts["p"] < 400 and 180 <= counts["q"] < 200


def test_moments_give_the_kurtosis_of_projections(spark):
    random = np.random.default_rng(6)
    x, u = random.exponential(size=(400, 3)), random.normal(size=(5, 3))
    df = spark.createDataFrame([("p", *v.tolist()) for v in x], "label string, x0 double, x1 double, x2 double")
    centre, spread = {"p": x.mean(0)}, {"p": x.std(0)}
    p = ((x - x.mean(0)) / x.std(0)) @ u.T
    want = ((p - p.mean(0)) ** 4).mean(0) / p.var(0) ** 2 - 3
    for method in outliers.METHODS:
        assert np.allclose(outliers._kurtoses(df, centre, spread, u, method)["p"], want)


def test_kurtosis_with_a_large_mean_null_keys_and_constants(spark):
    random = np.random.default_rng(2)
    x = random.normal(size=(600, 3)) + 1e6
    keys = ["a", None, "a"] * 200
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x)] + [("c", [5.0, 5.0, 5.0])] * 4, "k string, x array<double>")
    u = random.normal(size=(5, 3))
    got = {(r["k"], r["direction"]): r["kurtosis"] for r in mvstats.projected_kurtosis(df, "x", u, ["k"], block=2).collect()}
    for k in ("a", None):
        own = (x[[i for i, other in enumerate(keys) if other == k]] - 1e6) @ u.T
        want = ((own - own.mean(0)) ** 4).mean(0) / own.var(0) ** 2 - 3
        assert np.allclose([got[k, d] for d in range(5)], want, atol=1e-4)
    assert all(got["c", d] is None for d in range(5)) and len(got) == 15


def test_a_constant_class_keeps_its_rows(spark):
    rows_ = [(i, "c", 1.0, 2.0) for i in range(20)] + [(100 + i, "v", float(i % 7), float(i * i % 11)) for i in range(40)] + [(999, "v", 90.0, 90.0)]
    df = spark.createDataFrame(rows_, "id int, y string, a double, b double")
    for method in outliers.METHODS:
        kept = {r["id"] for r in outliers.remove_outliers(df, "y", "id", ["a", "b"], per_round=1, share=0.02, directions=50, method=method).collect()}
        assert kept >= set(range(20)) and 999 not in kept


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (None, 8.0), ("a", 2.0), ("a", 4.0)], "k string, v double")
    stats = {r["k"]: (r["mean"], r["median"]) for r in explore.class_statistics(df, ["v"], "k").collect()}
    assert stats == {None: (4.0, 3.0), "a": (3.0, 3.0)}
    assert {r["k"]: r["median"] for r in explore.box_plot(df, ["v"], "k").collect()} == {None: 3.0, "a": 3.0}
    assert sum(r["n"] for r in explore.histogram(df, ["v"], ["k"], 2).filter("k IS NULL").collect()) == 3
    assert explore.kernel_density(df, ["v"], ["k"], 3).filter("k IS NULL").count() == 3
    assert explore.z_scores(df, ["v"], ["k"]).count() == 5
    assert {tuple(r) for r in common.rows_at_extreme(df, "v", True, ["k"]).collect()} == {(None, 8.0), ("a", 4.0)}
    train, test = models.stratified_split(df, "k", "v", share=0.67)
    assert train.filter("k IS NULL").count() == 2 and test.filter("k IS NULL").count() == 1


def test_tfidf_of_a_null_group(spark):
    docs = spark.createDataFrame([(None, 1, "red blue", 1), (None, 2, "green grey", 1), ("a", 3, "red blue", 1), ("a", 4, "green grey", 1)], "g string, d int, t string, e int")
    assert {tuple(r) for r in tfidf.dispersion(docs, ["g"], "d", "t", "e").collect()} == {(None, 1.0), ("a", 1.0)}
    assert tfidf.mean_similarity(docs, ["g"], "d", "t").filter("g IS NULL").count() == 2


def test_balance_keeps_class_means(spark):
    random = np.random.default_rng(7)
    pdf = pd.DataFrame(random.normal(size=(80, 2)), columns=["a", "b"]).assign(y=[0] * 50 + [1] * 30)
    df = spark.createDataFrame(pdf)
    out = B.balance(df, "y", ["a", "b"])
    assert dict(rows(out.groupBy("y").count())) == {0: 50, 1: 50}
    made = out.filter("simulated").agg(F.mean("a"), F.mean("b")).first()
    assert np.allclose(made, pdf[pdf.y == 1][["a", "b"]].mean())
    with pytest.raises(ValueError):
        B.balance(df, "y", ["a", "b"], n=40)


def test_simulation_of_a_singular_covariance(spark):
    out = B.simulate(spark, [1.0, 2.0], np.array([[1.0, 1.0], [1.0, 1.0]]), ["a", "b"], 100, seed=3)
    assert out.count() == 100 and np.allclose(out.agg(F.mean("a"), F.mean("b")).first(), [1.0, 2.0])


def _points(seed, n, d=3):
    random = np.random.default_rng(seed)
    return pd.DataFrame({"id": range(n), "x": [v.tolist() for v in random.normal(size=(n, d)).round(1)], "y": random.integers(0, 3, n)})


@pytest.mark.parametrize("tile_rows", [4096, 16])
def test_neighbours_equal_brute_force(spark, tile_rows):
    train, test = _points(8, 300), _points(9, 60)
    # A crowd on one point fills several tiles of its cell.
    for i in range(100):
        train.at[i, "x"] = [0.0, 0.0, 0.0]
    found = neighbors.nearest(spark.createDataFrame(test), spark.createDataFrame(train), "id", "x", "y", 7, pivots=8, tile_rows=tile_rows)
    got = {}
    for r in found.orderBy("id", "distance", "train_key").collect():
        got.setdefault(r["id"], []).append(r["train_key"])
    a, b = np.stack(test.x), np.stack(train.x)
    distance = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    assert got == {i: np.argsort(distance[i], kind="stable")[:7].tolist() for i in range(60)}


def test_a_test_row_travels_once_per_tile_of_cells(spark):
    """In 64 dimensions no cell is ruled out: 30 cells in 3 tiles, and a crowded cell in tiles of its own."""
    size = np.array([20] * 30 + [900])
    first, n_tiles = neighbors._tiles(size, 200)
    assert first.tolist() == [0] * 10 + [1] * 10 + [2] * 10 + [3] and n_tiles.tolist() == [1] * 30 + [5]
    random = np.random.default_rng(4)
    centres = random.normal(size=(31, 64))
    test = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(random.normal(size=(50, 64)))], "test_key long, x array<double>")
    visits = neighbors._visits(test, centres, size, np.full(31, 9.0), first, n_tiles, 32).collect()
    assert len(visits) == 50 and all(r["tiles"] == list(range(8)) for r in visits)
    train, test = (pd.DataFrame({"id": range(n), "x": random.normal(size=(n, 64)).tolist(), "y": 0}) for n in (700, 40))
    found = neighbors.nearest(spark.createDataFrame(test), spark.createDataFrame(train), "id", "x", "y", 9, pivots=40, tile_rows=128)
    got = {}
    for r in found.orderBy("id", "distance", "train_key").collect():
        got.setdefault(r["id"], []).append(r["train_key"])
    distance = np.sqrt(((np.stack(test.x)[:, None] - np.stack(train.x)[None]) ** 2).sum(-1))
    assert got == {i: np.argsort(distance[i], kind="stable")[:9].tolist() for i in range(40)}


def test_an_exact_hit_decides(spark):
    near = spark.createDataFrame([(1, 10, 0.0, 2), (1, 11, 0.1, 0), (1, 12, 0.1, 0), (2, 13, 1.0, 1), (2, 14, 0.5, 0)], "id int, train_key int, distance double, label int")
    votes = neighbors.vote(near, "id")
    assert rows(votes.filter("id = 2").select("label", F.round("probability", 6)), "label") == [(0, 0.666667), (1, 0.333333)]
    assert rows(neighbors.classify(votes, "id").select("id", "prediction"), "id") == [(1, 2), (2, 0)]


def test_stratified_split_is_exact_and_disjoint(spark, table):
    df = spark.createDataFrame(table[["id", "y"]])
    train, test = models.stratified_split(df, "y", "id", seed=5)
    assert dict(rows(train.groupBy("y").count())) == {"a": 1470, "b": 420, "c": 210}
    assert train.join(test, "id").count() == 0 and train.count() + test.count() == 3000


def test_confusion_and_selective(spark):
    predictions = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.7), (1, 1, 0.6)], "y int, prediction int, confidence double")
    assert rows(models.confusion(predictions, "y", [0, 1, 2]), "y") == [(0, 1, 1, 0), (1, 0, 1, 0)]
    assert rows(models.selective(predictions, "y")) == [(3, 2, 1, 0.5)]
    assert rows(models.selective(predictions, "y", inclusive=False)) == [(3, 1, 2, 1.0)]
    assert models.accuracy(predictions, "y").first()["accuracy"] == pytest.approx(2 / 3)


def test_model_comparison_on_separable_classes(spark):
    random = np.random.default_rng(10)
    y = np.arange(240) % 3
    pdf = pd.DataFrame(random.normal(size=(240, 3)) + 6 * np.eye(3)[y], columns=["a", "b", "c"]).assign(y=y, id=range(240))
    pdf = pdf[(pdf.y < 2) | (pdf.id % 2 == 0)]
    report = refined_to_model(spark.createDataFrame(pdf), "y", "id", ["a", "b", "c"], directions=200, neighbours=5, per_round=None).collect()
    assert {(r["model"], r["sample"]) for r in report} == {("logistic", "train"), ("logistic", "test"), ("tree", "train"), ("tree", "test"), ("neighbours", "train"), ("neighbours", "test")}
    assert all(r["accuracy"] > 0.85 and r["answered"] + r["unanswered"] == r["n"] for r in report)
