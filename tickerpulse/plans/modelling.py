"""Feature table → cleaned, balanced, split, modelled and evaluated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerpulse.operators.balance import balance
from tickerpulse.operators.common import union_all
from tickerpulse.operators.models import (
    fit_logistic, fit_naive_bayes, fit_text_features, fit_tree, predict, random_split, scores, selective,
    stratified_split, to_vector,
)
from tickerpulse.operators.mvstats import redundant_features, scale, scaler
from tickerpulse.operators.neighbors import classify, nearest, vote
from tickerpulse.operators.outlier_rounds import remove_outliers_of_many_features, remove_outliers_one_by_one
from tickerpulse.operators.outliers import remove_outliers
from tickerpulse.session import cut_lineage


def refined_to_model(
    refined: DataFrame, label: str, key: str, features: Sequence[str], redundancy_cut: float = 0.99,
    directions: int = 10_000, neighbours: int = 32, seed: int = 0, per_round: int | None = 1, method: str = "moments",
) -> DataFrame:
    """Metrics of three classifiers: (model, sample, n, accuracy, answered, unanswered, accuracy_answered).

    The observed rows are split before anything is fitted: scaler, simulated rows and models see the training
    part only, and the test part holds no simulated row. One row ``per_round`` is the literal outlier rule; ``method`` "projection"
    plays it for many features.
    """
    # Of many columns made by expressions, the planner would derive a filter for every mix of their names.
    rows = cut_lineage(refined.select(key, label, *features)).dropna()
    if per_round == 1:
        one_by_one = remove_outliers_one_by_one if method == "moments" else remove_outliers_of_many_features
        clean = one_by_one(rows, label, key, features, directions=directions, seed=seed)
    else:
        clean = remove_outliers(rows, label, key, features, per_round, directions=directions, seed=seed, method=method)
    dropped = redundant_features(clean, features, redundancy_cut)
    kept = [f for f in features if f not in dropped]
    train, test = stratified_split(clean, label, key, seed=seed)
    balanced = cut_lineage(balance(train, label, kept, seed=seed))
    fitted = scaler(balanced, kept)
    numbered = balanced.withColumn(key, F.monotonically_increasing_id())
    train_set = cut_lineage(to_vector(scale(numbered, fitted, kept), kept).select(key, label, "features"))
    test_set = cut_lineage(to_vector(scale(test, fitted, kept), kept).select(key, label, "features"))

    reports = []
    for name, model, inclusive in (
        ("logistic", fit_logistic(train_set, label), False),
        ("tree", fit_tree(train_set, label, seed=seed), True),
    ):
        for sample, rows in (("train", train_set), ("test", test_set)):
            reports.append(_report(name, sample, predict(model, rows, key, label), label, inclusive))
    as_array = vector_to_array("features").alias("x")
    known, asked = train_set.select(key, label, as_array), test_set.select(key, label, as_array)
    for sample, rows in (("train", known), ("test", asked)):
        votes = vote(nearest(rows, known, key, "x", label, neighbours), key)
        reports.append(_report("neighbours", sample, classify(votes, key).join(rows.select(key, label), key), label, True))
    return union_all(*reports)


def _report(name: str, sample: str, predictions: DataFrame, label: str, inclusive: bool) -> DataFrame:
    report = selective(predictions, label, inclusive=inclusive, overall=True)
    return report.select(F.lit(name).alias("model"), F.lit(sample).alias("sample"), "n", "accuracy", "answered", "unanswered", "accuracy_answered")


def text_classifier(docs: DataFrame, key: str, text: str, category: str, seed: int = 12345) -> tuple[DataFrame, dict[str, float]]:
    """Naive Bayes on tf-idf: predictions of the test part, and its scores."""
    known = docs.filter(F.col(category).isNotNull()).withColumn(text, F.coalesce(text, F.lit("")))
    train, test = random_split(known, seed=seed)
    prepared = fit_text_features(train, text, category)
    model = fit_naive_bayes(prepared.transform(train))
    predicted = cut_lineage(
        model.transform(prepared.transform(test))
        .select(key, "label", "prediction", vector_to_array("probability").alias("probabilities"))
    )
    return predicted, scores(predicted)
