"""Only hits are put into their context: words without a valence cost one look-up and no more."""

import pytest

from tickerpulse.operators import lexicon as L
from tickerpulse.plans.trusted import clean_and_score
from tickerpulse.sources.schemas import POSTS


def test_words_that_are_no_hits_are_not_put_into_context(spark):
    words = ["not", "very", "good", "plain", "good", "bad"]
    docs = spark.createDataFrame([(1, words), (2, ["plain"] * 5), (3, [])], "k long, w array<string>")
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")
    scored = L.score_with_context(docs, "k", "w", lexicon, "s")
    first = (1.9 + 0.293) * -0.74
    total = first + (1.9 + 0.293 * 0.9) - 2.5
    assert {r["k"]: r["s"] for r in scored.collect()} == {1: pytest.approx(round(total / (total * total + 15) ** 0.5, 4)), 2: 0.0, 3: 0.0}
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN isnull(_valences" in plan


def test_texts_are_cleaned_once_for_their_scores(spark):
    bodies = [(1, "a good tion of bad"), (1, "bad"), (2, None), (None, "good good"), (3, "none of these")]
    posts = spark.createDataFrame([(k, "w", 0, b, 1, 1, 1) for k, b in bodies], POSTS)
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")
    lemmas = spark.createDataFrame([("tion", "good")], "form string, lemma string")
    done = clean_and_score(posts, lexicon, lemmas, "refined")
    value = lambda t: round(t / (t * t + 15) ** 0.5, 4)
    want = {(1, "good good bad", value(1.3)), (1, "bad", value(-2.5)), (2, "", 0.0), (None, "good good", value(3.8)), (3, "none", 0.0)}
    assert {tuple(r) for r in done.select("tweet_id", "bow", "score_vader").collect()} == want
    plan = done.select("score_vader")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
