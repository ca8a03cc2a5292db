"""Outliers, balancing, splits and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerpulse.fixtures.registry import query
from tickerpulse.fixtures.tables import documents, table
from tickerpulse.functions.text import words_refined
from tickerpulse.operators import balance as B
from tickerpulse.operators import common, models, neighbors, outlier_rounds, outliers
from tickerpulse.plans import modelling
from tickerpulse.session import cut_lineage

ITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
VECTOR_FEATURES = [f"x{i}" for i in range(64)]
# Those that ``balance`` fills up.
LEADING_FEATURES = VECTOR_FEATURES[:6]


def _vectors(spark, sf_dir):
    """Embeddings with their dimensions as feature columns."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f) for i, f in enumerate(VECTOR_FEATURES)])


def _split(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return models.stratified_split(vectors, "label", "vec_id", order="vec_id")


_KNN = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) <= floor(0.7 * count(*) OVER (PARTITION BY label)) AS train FROM embeddings),
nb AS (SELECT a.vec_id, a.label AS real, b.vec_id AS train_key, b.label, list_distance(a.e, b.e) AS distance
  FROM v a JOIN v b ON NOT a.train AND b.train
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) <= 32),
ex AS (SELECT *, max(distance = 0) OVER (PARTITION BY vec_id) AS exact FROM nb),
vt AS (SELECT vec_id, real, label, sum(CASE WHEN exact THEN CAST(distance = 0 AS INTEGER) ELSE 1 / distance END) AS w FROM ex GROUP BY ALL),
pr AS (SELECT vec_id, real, label, w / sum(w) OVER (PARTITION BY vec_id) AS probability FROM vt),
pred AS (SELECT vec_id, real, label AS prediction, probability AS confidence FROM pr QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY probability DESC, label) = 1)"""


def _neighbours(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return test, neighbors.nearest(test, train, "vec_id", "embedding", "label", models.NEIGHBOURS)


@query("knn_neighbours", _KNN + " SELECT vec_id, train_key, label, round(distance, 5) AS distance FROM nb")
def knn_neighbours(spark, sf_dir):
    _, found = _neighbours(spark, sf_dir)
    return found.withColumn("distance", F.round("distance", 5))


@query("knn_vote", _KNN + " SELECT vec_id, label, round(probability, 6) AS probability FROM pr")
def knn_vote(spark, sf_dir):
    _, found = _neighbours(spark, sf_dir)
    return neighbors.vote(found, "vec_id").withColumn("probability", F.round("probability", 6))


def _knn_predictions(spark, sf_dir):
    test, found = _neighbours(spark, sf_dir)
    real = test.select("vec_id", F.col("label").alias("real"))
    return neighbors.classify(neighbors.vote(found, "vec_id"), "vec_id").join(real, "vec_id")


@query("knn_confusion", _KNN + " SELECT real, " + ", ".join(f"count(*) FILTER (prediction = {c}) AS predicted_{c}" for c in range(10)) + " FROM pred GROUP BY 1")
def knn_confusion(spark, sf_dir):
    return models.confusion(_knn_predictions(spark, sf_dir), "real", list(range(10)))


@query("knn_accuracy", _KNN + " SELECT round(avg(CAST(prediction = real AS INTEGER)), 6) AS accuracy, count(*) AS n FROM pred")
def knn_accuracy(spark, sf_dir):
    out = models.accuracy(_knn_predictions(spark, sf_dir), "real")
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query("selective_knn", _KNN + """ SELECT count(*) AS n, count(*) FILTER (confidence >= 0.2) AS answered, count(*) FILTER (NOT confidence >= 0.2) AS unanswered,
round(avg(CAST(prediction = real AS INTEGER)) FILTER (confidence >= 0.2), 6) AS accuracy_answered FROM pred""")
def selective_knn(spark, sf_dir):
    out = models.selective(_knn_predictions(spark, sf_dir), "real", sure_from=0.2)
    return out.withColumn("accuracy_answered", F.round("accuracy_answered", 6))


@query("answered_by_class", _KNN + " SELECT real, count(*) AS n FROM pred WHERE confidence >= 0.2 GROUP BY 1")
def answered_by_class(spark, sf_dir):
    return common.class_sizes(models.answered(_knn_predictions(spark, sf_dir), sure_from=0.2), "real")


@query("outlier_projection")
def outlier_projection(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    skewed = items.withColumn("l_extendedprice", F.pow("l_extendedprice", F.lit(2.0)))
    kept = outliers.remove_outliers(skewed, "l_returnflag", "row_id", ITEM_FEATURES, per_round=None)
    return kept.select("l_returnflag", "row_id", *ITEM_FEATURES)


@query("outlier_one_by_one")
def outlier_one_by_one(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", F.pow("o_totalprice", F.lit(2.0)).alias("price"),
        F.dayofyear("o_orderdate").cast("double").alias("day"), F.col("o_custkey").cast("double").alias("customer"),
    )
    kept = outlier_rounds.remove_outliers_one_by_one(orders, "o_orderpriority", "o_orderkey", ["price", "day", "customer"])
    return orders.join(kept.select("o_orderkey", F.lit(True).alias("kept")), "o_orderkey", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


@query("balance")
def balance(spark, sf_dir):
    return B.balance(_vectors(spark, sf_dir), "label", LEADING_FEATURES)


@query("random_split")
def random_split(spark, sf_dir):
    train, test = models.random_split(table(spark, sf_dir, "customer"))
    return common.union_all(train.withColumn("train", F.lit(True)), test.withColumn("train", F.lit(False)))


@query("bernoulli_sample")
def bernoulli_sample(spark, sf_dir):
    return common.bernoulli_sample(table(spark, sf_dir, "events"), 0.1, seed=0)


@query("random_split_parts", """
SELECT c_nationkey, count(*) AS n, count(*) AS n_customers, CAST(0 AS BIGINT) AS in_both FROM customer GROUP BY 1""")
def random_split_parts(spark, sf_dir):
    """Whatever the seed: the two parts are the table, and no row is in both."""
    rows = random_split(spark, sf_dir).groupBy("c_nationkey", "c_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("train").alias("parts"))
    return rows.groupBy("c_nationkey").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_customers"), F.count_if(F.col("parts") > 1).alias("in_both")
    )


@query("bernoulli_sample_rows", """
SELECT count(*) AS n_rows, true AS near_a_tenth, CAST(0 AS BIGINT) AS strangers, CAST(0 AS BIGINT) AS repeated FROM events""")
def bernoulli_sample_rows(spark, sf_dir):
    """Whatever the seed: a sample holds rows of the table, none twice, and a tenth of them to within five deviations."""
    events = table(spark, sf_dir, "events").withColumn("_all", F.lit(1))
    drawn = bernoulli_sample(spark, sf_dir).groupBy("event_id").agg(F.count(F.lit(1)).alias("k"))
    joined = events.join(drawn, "event_id", "full")
    n, k = F.count("_all"), F.coalesce(F.sum("k"), F.lit(0))
    return joined.agg(
        n.alias("n_rows"), (F.abs(k - n * 0.1) <= 5 * F.sqrt(n * 0.09) + 1).alias("near_a_tenth"),
        F.count_if(F.col("_all").isNull()).alias("strangers"), F.count_if(F.col("k") > 1).alias("repeated"),
    )


@query("balance_sizes", """
WITH c AS (SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1)
SELECT label, (SELECT max(n) FROM c) AS n FROM c""")
def balance_sizes(spark, sf_dir):
    """Whatever is simulated: all classes have the size of the largest."""
    return balance(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _model_sets(spark, sf_dir):
    train, test = models.stratified_split(_vectors(spark, sf_dir), "label", "vec_id")
    return tuple(cut_lineage(models.to_vector(part, VECTOR_FEATURES).select("vec_id", "label", "features")) for part in (train, test))


@query("logreg")
def logreg(spark, sf_dir):
    train, test = _model_sets(spark, sf_dir)
    return models.predict(models.fit_logistic(train, "label"), test, "vec_id", "label")


@query("tree")
def tree(spark, sf_dir):
    train, test = _model_sets(spark, sf_dir)
    return models.predict(models.fit_tree(train, "label"), test, "vec_id", "label")


@query("tree_rules")
def tree_rules(spark, sf_dir):
    train, _ = _model_sets(spark, sf_dir)
    return models.tree_rules(models.fit_tree(train, "label"), train)


def _labelled_documents(spark, sf_dir):
    return documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")


@query("naive_bayes")
def naive_bayes(spark, sf_dir):
    predictions, _ = modelling.text_classifier(_labelled_documents(spark, sf_dir), "doc_id", "text", "quality")
    return predictions


@query("text_classifier_scores")
def text_classifier_scores(spark, sf_dir):
    _, scores = modelling.text_classifier(_labelled_documents(spark, sf_dir), "doc_id", "text", "lang")
    return spark.createDataFrame(sorted(scores.items()), "metric string, value double")


@query("hashing_tf_idf")
def hashing_tf_idf(spark, sf_dir):
    docs = documents(spark, sf_dir)
    features = models.fit_text_features(docs, "text").transform(common.spread(docs.select("doc_id", "text")))
    return features.select("doc_id", F.size(F.array_distinct("grams")).alias("n_terms"), F.col("features").cast("string").alias("features"))


@query("word2vec")
def word2vec(spark, sf_dir):
    docs = documents(spark, sf_dir).select(words_refined("text").alias("words"))
    return models.word_vectors(docs, "words")


@query("refined_to_model")
def refined_to_model(spark, sf_dir):
    return modelling.refined_to_model(_vectors(spark, sf_dir), "label", "vec_id", VECTOR_FEATURES, method="projection")
