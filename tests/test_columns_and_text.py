import datetime
import time

from pyspark.sql import functions as F

from tests.conftest import rows
from tickerpulse.functions import columns as C
from tickerpulse.functions import text as T
from tickerpulse.operators import enrich, lexicon as L
from tickerpulse.plans.trusted import raw_to_trusted
from tickerpulse.sources.schemas import LEMMAS, LEXICON, POST_TICKERS, POSTS


def test_score_classes_at_the_limits(spark):
    df = spark.createDataFrame([(0.05,), (0.0499,), (0.0,), (-0.0499,), (-0.05,), (None,)], "s double")
    got = [r[0] for r in df.select(C.score_class("s")).collect()]
    assert got == ["positive", "neutral", "neutral", "neutral", "negative", "neutral"]


def test_class_codes_are_alphabetical(spark):
    df = spark.createDataFrame([("negative",), ("neutral",), ("positive",), ("other",)], "s string")
    assert [r[0] for r in df.select(C.class_code("s")).collect()] == [0, 1, 2, None]


def test_missing_change_is_class_zero(spark):
    df = spark.createDataFrame([(3.0,), (-3.0,), (0.5,), (None,)], "c double")
    assert [r[0] for r in df.select(C.move_class("c", F.lit(-1.0), F.lit(1.0))).collect()] == [1, 2, 0, 0]


def test_engagement_with_a_missing_part_is_missing(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, None, 3)], "a int, b int, c int")
    assert [r[0] for r in df.select(C.total_engagement("a", "b", "c")).collect()] == [6, None]


def test_epoch_as_text_and_number(spark):
    df = spark.createDataFrame([("1420070457", 1420070457)], "t string, n bigint")
    got = df.select(C.epoch_to_timestamp("t").cast("string"), C.epoch_to_timestamp("n").cast("string")).first()
    assert tuple(got) == ("2015-01-01 00:00:57",) * 2


def test_list_text(spark):
    df = spark.createDataFrame([("['AAPL' 'GOOG']",), ("['AAPL', 'GOOG']",), ("[]",)], "s string")
    assert [r[0] for r in df.select(C.list_text_to_array("s")).collect()] == [["AAPL", "GOOG"], ["AAPL", "GOOG"], []]


def test_unstandardise_undoes_standardise(spark):
    df = spark.createDataFrame([(4.0, 1.0, 2.0), (4.0, 4.0, 0.0)], "v double, m double, s double")
    back = df.withColumn("z", C.standardise("v", "m", "s")).select("z", C.unstandardise("z", "m", "s"))
    assert rows(back) == [(1.5, 4.0), (0.0, 4.0)]


def test_tags_and_links_go(spark):
    df = spark.createDataFrame([("buy $AAPL now http://a.b/c ok",)], "s string")
    assert df.select(T.strip_tags_and_links("s")).first()[0] == "buy  now  ok"


def test_words_keep_inner_joiners(spark):
    df = spark.createDataFrame([("A foo-bar, and/or AT&T's end.",)], "s string")
    assert df.select(T.word_tokens("s")).first()[0] == ["A", "foo-bar", ",", "and/or", "AT", "&", "T's", "end", "."]


def test_refined_words_are_the_letters_only_tokens(spark):
    texts = ["ab a-b ab-cd x/yz ab.cd. 'ab' ab' 'cd ab''cd ab1 1ab 1-ab ab-1 ab_cd", "É été ÉTÉ’s naïve straße ŉ ﬁn", "a\\\\b cd\\\\ ef--gh ij-,kl", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    found = df.select(T.words_refined("s", []), T.word_tokens("s")).collect()
    for words, tokens in found:
        assert words == [t.lower() for t in tokens if len(t) > 1 and t.isalpha()]


def test_refined_and_stripped_differ_as_stated(spark):
    df = spark.createDataFrame([("The Foo-Bar rises 20 x2 $T to 1,000 now now",)], "s string")
    assert df.select(T.words_refined("s")).first()[0] == ["rises"]
    assert df.select(T.words_stripped("s")).first()[0] == ["foobar", "rises", "x2"]
    assert df.select(T.without_digits(T.words_stripped("s"))).first()[0] == ["foobar", "rises"]


def test_bag_of_words_accepts_missing_bodies(spark):
    df = spark.createDataFrame([(1, "The Sky is blue"), (2, None), (3, "")], "id int, body string")
    assert rows(T.bag_of_words(df).select("id", "bow"), "id") == [(1, "sky blue"), (2, ""), (3, "")]


def _tokens(spark, *texts):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "id int, w array<string>")


def test_lemmas_keep_order_and_repeats(spark):
    lemmas = spark.createDataFrame([("cars", "car"), ("men", "man")], LEMMAS)
    out = L.lemmatize(_tokens(spark, "men like cars cars", "none here", ""), "id", "w", lemmas, "l")
    assert rows(out.select("id", "l"), "id") == [(0, ["man", "like", "car", "car"]), (1, ["none", "here"]), (2, [])]


def test_score_sums_repeats_and_is_zero_without_hits(spark):
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -3.0)], LEXICON)
    out = L.score_tokens(_tokens(spark, "good good", "bad", "plain", ""), "id", "w", lexicon, "s")
    want = [round(4 / (16 + 15) ** 0.5, 4), round(-3 / (9 + 15) ** 0.5, 4), 0.0, 0.0]
    assert [r[1] for r in rows(out.select("id", "s"), "id")] == want


def test_score_uses_the_lemma(spark):
    lexicon = spark.createDataFrame([("win", 2.0), ("wins", 9.0)], LEXICON)
    lemmas = spark.createDataFrame([("wins", "win")], LEMMAS)
    out = L.lemmatize_and_score(_tokens(spark, "wins today"), "id", "w", lemmas, lexicon, "l", "s").select("l", "s").first()
    assert tuple(out) == (["win", "today"], round(2 / 19**0.5, 4))


def test_context_negates_and_boosts(spark):
    lexicon = spark.createDataFrame([("good", 2.0)], LEXICON)
    out = L.score_with_context(_tokens(spark, "good", "never good", "really good", "hardly good", "x"), "id", "w", lexicon, "s")
    score = lambda v: round(v / (v * v + 15) ** 0.5, 4)
    assert [r[1] for r in rows(out.select("id", "s"), "id")] == [score(2.0), score(-1.48), score(2.293), score(1.707), 0.0]


def test_texts_under_one_id_are_scored_apart(spark):
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -3.0)], LEXICON)
    lemmas = spark.createDataFrame([("better", "good")], LEMMAS)
    texts = spark.createDataFrame([(1, ["better"]), (1, ["bad"]), (1, ["bad"]), (2, ["plain"])], "id int, w array<string>")
    score = lambda v: round(v / (v * v + 15) ** 0.5, 4)
    want = [("bad", "bad", score(-3.0)), ("bad", "bad", score(-3.0)), ("better", "good", score(2.0)), ("plain", "plain", 0.0)]
    out = L.lemmatize_and_score(texts, "id", "w", lemmas, lexicon, "l", "s")
    assert rows(out.selectExpr("w[0]", "l[0]", "s"), "w[0]") == want
    assert [r[2] for r in rows(L.score_with_context(texts, "id", "w", lexicon, "s"), "w")] == [score(-3.0), score(-3.0), 0.0, 0.0]


def test_apostrophes_stay_in_words_and_negate(spark):
    df = spark.createDataFrame([("I won't say isn't it good? It’s 'quoted'",)], "t string")
    assert df.select(T.words_refined("t")).first()[0] == ["say", "good", "quoted"]
    assert df.select(T.words_in_context("t")).first()[0] == ["i", "wont", "say", "isnt", "it", "good", "its", "quoted"]


def _raw(spark):
    posts = spark.createDataFrame([
        (1, "w", 1420070457, "good $AAPL day", 1, 2, 3), (2, None, 1420070457, None, 0, 0, 0), (3, "v", 1420156800, "bad", 1, 0, 0),
    ], POSTS)
    links = spark.createDataFrame([(1, "AAPL"), (1, "GOOG"), (1, "AAPL"), (2, "GOOGL")], POST_TICKERS)
    return posts, links


def test_ticker_groups_are_sets_and_match_whole_elements(spark):
    posts, links = _raw(spark)
    grouped = enrich.with_ticker_groups(posts, links)
    assert rows(grouped.select("tweet_id", "ticker_symbol_group"), "tweet_id") == [(1, ["AAPL", "GOOG"]), (2, ["GOOGL"]), (3, None)]
    assert rows(enrich.mentions(grouped, "GOOG").select("tweet_id")) == [(1,)]
    assert rows(enrich.by_ticker(grouped).select("tweet_id", "ticker"), "tweet_id", "ticker") == [(1, "AAPL"), (1, "GOOG"), (2, "GOOGL")]


def test_raw_to_trusted_in_all_cleanings(spark):
    posts, links = _raw(spark)
    lexicon, lemmas = spark.createDataFrame([("good", 2.0)], LEXICON), spark.createDataFrame([("days", "day")], LEMMAS)
    for cleaning, bow in (("refined", "good day"), ("stripped", "good aapl day"), ("bag", "good $aapl day")):
        out = raw_to_trusted(posts, links, lexicon, lemmas, cleaning)
        got = rows(out.select("ticker", "tweet_id", "total_engagement", "post_date", "bow", "sentiment"), "ticker")
        day = datetime.date(2015, 1, 1)
        assert got == [("AAPL", 1, 6, day, bow, "positive"), ("GOOG", 1, 6, day, bow, "positive"), ("GOOGL", 2, 0, day, "", "neutral")]


def test_context_scoring_in_the_job(spark):
    posts = spark.createDataFrame([(1, "w", 1420070457, "don't call it good", 0, 0, 0), (1, "w", 1420070457, "good", 0, 0, 0)], POSTS)
    links = spark.createDataFrame([(1, "AAPL")], POST_TICKERS)
    lexicon = spark.createDataFrame([("good", 2.0)], LEXICON)
    moods = lambda how: sorted(r[0] for r in raw_to_trusted(posts, links, lexicon, scoring=how).select("sentiment").collect())
    assert moods("sum") == ["positive", "positive"] and moods("context") == ["negative", "positive"]


def test_lexicon_tables_are_the_copied_side_and_hashes_are_below_the_explode(spark):
    from tickerpulse.fixtures.tables import lexicon, lemmas

    df = spark.range(10**9).selectExpr("id", "array('good', 'x' || id) w")  # planned, not run
    found = L.lemmatize_and_score(df, "id", "w", lemmas(spark), lexicon(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan[: plan.index("Generate posexplode")]
    generate = plan[plan.index("Generate posexplode") :]
    assert "xxhash64" in generate and "xxhash64" not in plan[plan.index("BroadcastHashJoin") : plan.index("Generate posexplode")]


def test_null_keys_score(spark):
    lexicon = spark.createDataFrame([("good", 1.9)], "token string, valence double")
    df = spark.createDataFrame([(None, ["good"]), (1, ["good"]), (None, ["bad"])], "id int, w array<string>")
    scored = [tuple(r) for r in L.score_tokens(df, "id", "w", lexicon, "s").select("id", "w", "s").collect()]
    assert sorted(scored, key=str) == sorted([(None, ["good"], 0.4404), (1, ["good"], 0.4404), (None, ["bad"], 0.0)], key=str)


def test_long_texts_take_no_longer_per_word(spark):
    """The hash of a text is computed once: with one per token, this would hash 40 000 x 40 000 words."""
    lexicon = spark.createDataFrame([("good", 0.0)], "token string, valence double")
    df = spark.range(4).selectExpr("id", "transform(sequence(1, 40000), x -> concat('w', x)) w")
    start = time.perf_counter()
    assert L.score_tokens(df, "id", "w", lexicon, "s").agg({"s": "sum"}).first()[0] == 0.0
    assert time.perf_counter() - start < 60
