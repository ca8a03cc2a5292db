"""Descriptions, multivariate statistics, scaling and exact order statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tickerpulse.fixtures.registry import query
from tickerpulse.fixtures.tables import table
from tickerpulse.functions.columns import argmax
from tickerpulse.operators import common, explore, models, mvstats

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CLASS = "l_returnflag"

_LONG = "long AS (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value)"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def _rounded(df, cols, places=6):
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in cols})


def _round_sql(cols: dict[str, str], places: int = 6) -> str:
    return ", ".join(f"round({e}, {places}) + 0.0 AS {n}" for n, e in cols.items())


_SUMMARY = {
    "mean": "avg(value)", "std": "stddev_samp(value)", "min": "min(value)", "max": "max(value)",
    "q1": "quantile_cont(value, 0.25)", "median": "quantile_cont(value, 0.5)", "q3": "quantile_cont(value, 0.75)",
}


@query("describe", f"WITH {_LONG} SELECT feature, count(value) AS count, {_round_sql(_SUMMARY)} FROM long GROUP BY 1")
def describe(spark, sf_dir):
    return _rounded(explore.describe(_items(spark, sf_dir), FEATURES), _SUMMARY)


_STATS = {"mean": "avg(value)", "std": "stddev_samp(value)", "skew": "skewness(value)", "median": "quantile_cont(value, 0.5)"}


@query("class_stats", f"WITH {_LONG} SELECT l_returnflag, feature, {_round_sql(_STATS)} FROM long GROUP BY 1, 2")
def class_stats(spark, sf_dir):
    return _rounded(explore.class_statistics(_items(spark, sf_dir), FEATURES, CLASS), _STATS)


_BOX = {"q1": "q1", "median": "median", "q3": "q3", "whisker_low": "min(value) FILTER (inside)", "whisker_high": "max(value) FILTER (inside)"}


@query("boxplot", f"""
WITH {_LONG}, q AS (SELECT l_returnflag, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1, 2),
j AS (SELECT *, value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) AS inside FROM long JOIN q USING (l_returnflag, feature))
SELECT l_returnflag, feature, {_round_sql(_BOX)}, count(*) FILTER (NOT inside) AS n_outside FROM j GROUP BY l_returnflag, feature, q1, median, q3""")
def boxplot(spark, sf_dir):
    return _rounded(explore.box_plot(_items(spark, sf_dir), FEATURES, CLASS), _BOX)


@query("histogram", f"""
WITH {_LONG}, r AS (SELECT l_returnflag, feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1, 2),
c AS (SELECT l_returnflag, feature, CAST(least(floor((value - lo) / (hi - lo) * 30) + 1, 30) AS INTEGER) AS bin, count(*) AS n
      FROM long JOIN r USING (l_returnflag, feature) GROUP BY 1, 2, 3),
f AS (SELECT l_returnflag, feature, CAST(unnest(range(1, 31)) AS INTEGER) AS bin, lo, hi FROM r)
SELECT l_returnflag, feature, bin, round(lo + (hi - lo) / 30 * (bin - 1), 6) AS bin_start, coalesce(n, 0) AS n FROM f LEFT JOIN c USING (l_returnflag, feature, bin)""")
def histogram(spark, sf_dir):
    return _rounded(explore.histogram(_items(spark, sf_dir), FEATURES, [CLASS], 30), ["bin_start"])


@query("kde_grid", """
WITH v AS (SELECT l_returnflag, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS total, stddev_samp(l_quantity) * pow(count(*), -0.2) AS h FROM lineitem GROUP BY 1),
g AS (SELECT l_returnflag, CAST(unnest(range(0, 50)) AS INTEGER) AS point, lo, hi, total, h FROM s)
SELECT l_returnflag, 'l_quantity' AS feature, point, round(lo + (hi - lo) / 49 * point, 6) AS x,
       round(sum(n * exp(-0.5 * pow((lo + (hi - lo) / 49 * point - value) / h, 2)) / (h * sqrt(2 * pi()) * total)), 8) AS density
FROM g JOIN v USING (l_returnflag) GROUP BY l_returnflag, point, lo, hi""")
def kde_grid(spark, sf_dir):
    curve = explore.kernel_density(_items(spark, sf_dir), ["l_quantity"], [CLASS], 50)
    return curve.select(CLASS, "feature", "point", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query("kde_binned", """
WITH s AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS total, stddev_samp(l_extendedprice) * pow(count(*), -0.2) AS h FROM lineitem GROUP BY 1),
w AS (SELECT *, (hi - lo) / ceil((hi - lo) / (h * sqrt(8 * 1e-4))) AS w FROM s),
p AS (SELECT l_returnflag, (l_extendedprice - lo) / w AS p FROM lineitem JOIN w USING (l_returnflag)),
m AS (SELECT l_returnflag, floor(p) AS bin, 1 - (p - floor(p)) AS mass FROM p UNION ALL SELECT l_returnflag, floor(p) + 1, p - floor(p) FROM p),
b AS (SELECT l_returnflag, bin, sum(mass) AS mass FROM m GROUP BY ALL),
g AS (SELECT *, CAST(unnest(range(0, 50)) AS INTEGER) AS point FROM w)
SELECT l_returnflag, 'l_extendedprice' AS feature, point, round(lo + (hi - lo) / 49 * point, 4) AS x,
  round(sum(mass * exp(-0.5 * pow((lo + (hi - lo) / 49 * point - (lo + w * bin)) / h, 2)) / (h * sqrt(2 * pi()) * total)), 10) AS density
FROM g JOIN b USING (l_returnflag) GROUP BY l_returnflag, point, lo, hi""")
def kde_binned(spark, sf_dir):
    curve = explore.kernel_density_binned(_items(spark, sf_dir), ["l_extendedprice"], [CLASS], 50)
    return curve.select(CLASS, "feature", "point", F.round("x", 4).alias("x"), F.round("density", 10).alias("density"))


def _pairs_sql(function: str, out: str, where: str = "", keys: str = "") -> str:
    rows = [
        f"SELECT {keys}'{a}' AS feature_i, '{b}' AS feature_j, round({function}({a}, {b}), 6) + 0.0 AS {out} FROM lineitem{where}"
        for a in FEATURES for b in FEATURES
    ]
    return " UNION ALL ".join(rows)


@query("corr_matrix", _pairs_sql("corr", "r"))
def corr_matrix(spark, sf_dir):
    return _rounded(mvstats.correlation(_items(spark, sf_dir), FEATURES), ["r"])


@query("cov_matrix", _pairs_sql("covar_samp", "cov", " GROUP BY l_returnflag", "l_returnflag, "))
def cov_matrix(spark, sf_dir):
    return _rounded(mvstats.covariance_rows(_items(spark, sf_dir), FEATURES, [CLASS]), ["cov"])


@query("cov_r2", """
WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc FROM lineitem)
SELECT 'l_quantity' AS feature, round((ab*ab + ac*ac - 2*ab*ac*bc) / (1 - bc*bc), 8) AS r2 FROM c
UNION ALL SELECT 'l_extendedprice', round((ab*ab + bc*bc - 2*ab*ac*bc) / (1 - ac*ac), 8) FROM c
UNION ALL SELECT 'l_discount', round((ac*ac + bc*bc - 2*ab*ac*bc) / (1 - ab*ab), 8) FROM c""")
def cov_r2(spark, sf_dir):
    return mvstats.multiple_r2(_items(spark, sf_dir), FEATURES[:3]).select("feature", F.round("r2", 8).alias("r2"))


@query("redundant_features", """
WITH v AS (SELECT l_quantity + l_extendedprice / 2000 + l_tax AS summed, l_quantity, l_extendedprice FROM lineitem),
c AS (SELECT corr(summed, l_quantity) AS ab, corr(summed, l_extendedprice) AS ac, corr(l_quantity, l_extendedprice) AS bc FROM v),
r AS (SELECT 'summed' AS feature, (ab*ab + ac*ac - 2*ab*ac*bc) / (1 - bc*bc) AS r2 FROM c
  UNION ALL SELECT 'l_quantity', (ab*ab + bc*bc - 2*ab*ac*bc) / (1 - ac*ac) FROM c
  UNION ALL SELECT 'l_extendedprice', (ac*ac + bc*bc - 2*ab*ac*bc) / (1 - ab*ab) FROM c)
SELECT feature FROM r WHERE r2 > 0.99 ORDER BY r2 DESC LIMIT 1""")
def redundant_features(spark, sf_dir):
    items = _items(spark, sf_dir).withColumn("summed", F.col("l_quantity") + F.col("l_extendedprice") / 2000 + F.col("l_tax"))
    out = mvstats.redundant_features(items, ["l_quantity", "summed", "l_extendedprice"], cut=0.99)
    return items.sparkSession.createDataFrame([(f,) for f in out], "feature string")


@query("gen_std", """
WITH c AS (SELECT l_returnflag, var_samp(l_quantity) AS a, covar_samp(l_quantity, l_extendedprice) AS b, covar_samp(l_quantity, l_discount) AS c,
  var_samp(l_extendedprice) AS e, covar_samp(l_extendedprice, l_discount) AS f, var_samp(l_discount) AS i FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(sqrt(a*(e*i - f*f) - b*(b*i - f*c) + c*(b*f - e*c)), 3) AS gen_std FROM c""")
def gen_std(spark, sf_dir):
    return _rounded(mvstats.generalised_std(_items(spark, sf_dir), FEATURES[:3], [CLASS]), ["gen_std"], 3)


@query("medoid", """
WITH c AS (SELECT c_custkey, c_mktsegment, c_acctbal, CAST(c_nationkey AS DOUBLE) AS nation FROM customer),
d AS (SELECT a.c_mktsegment, a.c_custkey, sum(sqrt(pow(a.c_acctbal - b.c_acctbal, 2) + pow(a.nation - b.nation, 2))) AS s
      FROM c a JOIN c b USING (c_mktsegment) GROUP BY 1, 2)
SELECT c_mktsegment, c_custkey, round(s, 3) AS distance_sum FROM d
QUALIFY s <= min(s) OVER (PARTITION BY c_mktsegment) * (1 + 1e-9)""")
def medoid(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumn("nation", F.col("c_nationkey").cast("double"))
    out = mvstats.medoids(customers, "c_mktsegment", "c_custkey", ["c_acctbal", "nation"])
    return out.select("c_mktsegment", "c_custkey", F.round("distance_sum", 3).alias("distance_sum"))


@query("zscore_scale_unscale", """
WITH m AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) + 0.0 AS l_quantity, round((l_tax - mt) / st, 6) + 0.0 AS l_tax,
       round(l_quantity, 6) AS quantity_back, round(l_tax, 6) AS tax_back FROM lineitem, m""")
def zscore_scale_unscale(spark, sf_dir):
    items, cols = _items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"]
    fitted = mvstats.scaler(items, cols)
    scaled = mvstats.scale(items, fitted, cols)
    kept = scaled.withColumns({f"_{c}": F.col(c) for c in cols})
    back = mvstats.scale(kept, fitted, cols, inverse=True)
    names = {"l_quantity": "quantity_back", "l_tax": "tax_back"}
    return back.select(
        "l_orderkey", "l_linenumber", *[(F.round(f"_{c}", 6) + F.lit(0.0)).alias(c) for c in cols],
        *[F.round(c, 6).alias(names[c]) for c in cols],
    )


@query("zscore_per_class", """
WITH m AS (SELECT l_returnflag, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / s, 6) + 0.0 AS z_l_extendedprice FROM lineitem JOIN m USING (l_returnflag)""")
def zscore_per_class(spark, sf_dir):
    z = explore.z_scores(_items(spark, sf_dir), ["l_extendedprice"], [CLASS])
    return _rounded(z.select("l_orderkey", "l_linenumber", "z_l_extendedprice"), ["z_l_extendedprice"])


# Three fixed directions over the 64 dimensions.
_DIRECTIONS = np.stack([np.eye(64)[0], np.eye(64)[5], (np.eye(64)[1] - np.eye(64)[2])])
_PROJECTED = ["e[1]", "e[6]", "e[2] - e[3]"]


@query("projection_kurtosis", "WITH v AS (SELECT CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings) " + " UNION ALL ".join(
    f"SELECT label, {i} AS direction, round(kurtosis_pop({p}), 6) AS kurtosis FROM v GROUP BY label" for i, p in enumerate(_PROJECTED)))
def projection_kurtosis(spark, sf_dir):
    out = mvstats.projected_kurtosis(table(spark, sf_dir, "embeddings"), "embedding", _DIRECTIONS, ["label"])
    return out.withColumn("kurtosis", F.round("kurtosis", 6))


@query("argmax_class", """
SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS at, round(CAST(list_max(e) AS DOUBLE), 5) AS best
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
def argmax_class(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    return vectors.select("vec_id", argmax("e").alias("at"), F.round(F.array_max("e"), 5).alias("best"))


@query("stratified_cut", """
SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) <= floor(0.7 * count(*) OVER (PARTITION BY c_mktsegment)) AS train
FROM customer""")
def stratified_cut(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    train, test = models.stratified_split(customers, "c_mktsegment", "c_custkey", order="c_custkey")
    return common.union_all(train.withColumn("train", F.lit(True)), test.withColumn("train", F.lit(False)))


@query("frequency_table", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def frequency_table(spark, sf_dir):
    return common.class_sizes(_items(spark, sf_dir), CLASS)
