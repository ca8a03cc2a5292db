"""Cleaning, lemmas, sentiment, term weights, and the posts' way to the daily features."""

from __future__ import annotations


from pyspark.sql import functions as F

from tickerpulse.fixtures import sql as S
from tickerpulse.fixtures.registry import query
from tickerpulse.fixtures.tables import documents, lemmas, lexicon, links, posts, prices
from tickerpulse.functions import text as T
from tickerpulse.functions.columns import class_code, score_class
from tickerpulse.operators import daily, lexicon as L, models, tfidf
from tickerpulse.operators.sentiment import Rule, score_bodies
from tickerpulse.plans import refined, reports, trusted
from tickerpulse.session import dropping_shuffles, work_path
from tickerpulse.sources import io

GROUP = ["source", "lang"]


def _documents(spark, sf_dir):
    return documents(spark, sf_dir)


def _text(date: str):
    return F.date_format(date, "yyyy-MM-dd")


@query("clean_tokens_bag", f"SELECT doc_id, array_to_string({S.bag('text')}, ' ') AS bow FROM documents")
def clean_tokens_bag(spark, sf_dir):
    return T.bag_of_words(_documents(spark, sf_dir), "text").select("doc_id", "bow")


@query("clean_tokens_refined", f"SELECT doc_id, array_to_string({S.refined('text')}, ' ') AS clean FROM documents")
def clean_tokens_refined(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.join_tokens(T.words_refined("text")).alias("clean"))


@query("clean_tokens_stripped", f"SELECT doc_id, array_to_string(list_filter({S.stripped('text')}, lambda t: NOT regexp_matches(t, '[0-9]')), ' ') AS clean FROM documents")
def clean_tokens_stripped(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.join_tokens(T.without_digits(T.words_stripped("text"))).alias("clean"))


@query("word_tokens", f"SELECT doc_id, CAST(len({S.words('text')}) AS INTEGER) AS n, array_to_string({S.words('text')}, ' ') AS words FROM documents")
def word_tokens(spark, sf_dir):
    tokens = T.word_tokens("text")
    return _documents(spark, sf_dir).select("doc_id", F.size(tokens).alias("n"), T.join_tokens(tokens).alias("words"))


@query("distinct_terms", f"""
WITH c AS (SELECT doc_id, array_to_string({S.refined('text')}, ' ') AS clean FROM documents)
SELECT doc_id, CAST(len(list_distinct(string_split(clean, ' '))) AS INTEGER) AS n_terms FROM c""")
def distinct_terms(spark, sf_dir):
    clean = T.join_tokens(T.words_refined("text"))
    return _documents(spark, sf_dir).select("doc_id", F.size(T.distinct_terms(clean)).alias("n_terms"))


_TOKENS = f"tok AS (SELECT doc_id, unnest(w) AS form, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {S.refined('text')} AS w FROM documents))"


@query("lemma_join", f"""
WITH {S.LEMMAS}, {_TOKENS},
j AS (SELECT doc_id, string_agg(coalesce(lemma, form), ' ' ORDER BY pos) AS clean FROM tok LEFT JOIN lemmas USING (form) GROUP BY 1)
SELECT doc_id, coalesce(clean, '') AS clean FROM documents LEFT JOIN j USING (doc_id)""")
def lemma_join(spark, sf_dir):
    words = _documents(spark, sf_dir).withColumn("words", T.words_refined("text"))
    out = L.lemmatize(words, "doc_id", "words", lemmas(spark))
    return out.select("doc_id", T.join_tokens("lemmatized_tokens").alias("clean"))


_SCORED = f"""WITH {S.LEXICON}, {_TOKENS},
s AS (SELECT doc_id, {S.COMPOUND} AS score FROM tok JOIN lexicon ON form = token GROUP BY 1),
scored AS (SELECT doc_id, lang, coalesce(score, 0.0) AS score FROM documents LEFT JOIN s USING (doc_id))"""


@query("lexicon_score", f"{_SCORED} SELECT doc_id, score FROM scored")
def lexicon_score(spark, sf_dir):
    words = _documents(spark, sf_dir).withColumn("words", T.words_refined("text"))
    return L.score_tokens(words, "doc_id", "words", lexicon(spark), "score").select("doc_id", "score")


@query("score_class", f"""{_SCORED}, c AS (SELECT *, {S.CLASS.format(s='score')} AS sentiment FROM scored)
SELECT lang, sentiment, CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS code, count(*) AS n
FROM c GROUP BY 1, 2""")
def score_classes(spark, sf_dir):
    words = _documents(spark, sf_dir).withColumn("words", T.words_refined("text"))
    scored = L.score_tokens(words, "doc_id", "words", lexicon(spark)).withColumn("sentiment", score_class("score_vader"))
    return scored.groupBy("lang", "sentiment", class_code("sentiment").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def _literals(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# Words of the fixture texts in the roles of negators and boosters.
_NEGATORS, _UP, _DOWN = ("thre", "thin"), ("thor", "thea"), ("eres", "erre")
_LOOK_BACK = ""
for _i, _decay in enumerate(L.BOOST_DECAY, start=1):
    _known = f"(v{_i} IS NULL)"
    _step = f"(CASE WHEN w{_i} IN {_literals(_UP)} THEN {L.BOOST} WHEN w{_i} IN {_literals(_DOWN)} THEN -{L.BOOST} ELSE 0.0 END) * {_decay}"
    _factor = f"(CASE WHEN w{_i} IN {_literals(_NEGATORS)} THEN {L.NEGATION_FACTOR} ELSE 1.0 END)"
    _LOOK_BACK += f", a{_i} AS (SELECT *, CASE WHEN {_known} THEN (x{_i - 1} + sign(v) * {_step}) * {_factor} ELSE x{_i - 1} END AS x{_i} FROM {'hits' if _i == 1 else f'a{_i - 1}'})"


@query("context_score", f"""
WITH {S.LEXICON}, {_TOKENS},
t AS (SELECT doc_id, pos, form, CAST(valence AS DOUBLE) AS v FROM tok LEFT JOIN lexicon ON form = token),
n AS (SELECT *, {', '.join(f'lag(form, {i}) OVER d AS w{i}, lag(v, {i}) OVER d AS v{i}' for i in (1, 2, 3))}
      FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
hits AS (SELECT *, v AS x0 FROM n WHERE v IS NOT NULL){_LOOK_BACK},
s AS (SELECT doc_id, round(sum(x3) / sqrt(sum(x3) * sum(x3) + 15), 4) + 0.0 AS score FROM a3 GROUP BY 1)
SELECT doc_id, coalesce(score, 0.0) AS score FROM documents LEFT JOIN s USING (doc_id)""")
def context_score(spark, sf_dir):
    words = _documents(spark, sf_dir).withColumn("words", T.words_refined("text"))
    scored = L.score_with_context(words, "doc_id", "words", lexicon(spark), "score", _NEGATORS, _UP, _DOWN)
    return scored.select("doc_id", "score")


_RULE = Rule(_NEGATORS, _UP, _DOWN, contrast=("thea", "sich"), idioms={"the tion": -2.5, "des qui": 3.0})
_BACK = ""
for _i, _decay in enumerate(L.BOOST_DECAY, start=1):
    _step = f"coalesce(sign(v) * ((CASE WHEN w{_i} IN {_literals(_UP)} THEN {L.BOOST} WHEN w{_i} IN {_literals(_DOWN)} THEN -{L.BOOST} END) + CASE WHEN mixed AND u{_i} THEN 0.733 ELSE 0.0 END) * {_decay}, 0.0)"
    _factor = f"(CASE WHEN w{_i} IN {_literals(_NEGATORS)} THEN {L.NEGATION_FACTOR} ELSE 1.0 END)"
    _BACK += f", a{_i} AS (SELECT *, CASE WHEN w{_i} IS NOT NULL AND v{_i} IS NULL THEN (x{_i - 1} + {_step}) * {_factor} ELSE x{_i - 1} END AS x{_i} FROM {'caps' if _i == 1 else f'a{_i - 1}'})"
_IDIOM = "CASE w1 || ' ' || low " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in _RULE.idioms.items()) + " END"


@query("full_score", f"""
WITH {S.LEXICON},
b AS (SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '\\$\\S+|http\\S+', '', 'g') AS bare FROM documents),
ws AS (SELECT doc_id, body, list_filter(regexp_split_to_array(bare, '\\s+'), lambda w: w <> '') AS ws FROM b),
raw AS (SELECT doc_id, body, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM ws),
cased AS (SELECT doc_id, body, n, pos, CASE WHEN length(regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) > 2
  THEN regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') ELSE w END AS w FROM raw),
low AS (SELECT *, regexp_replace(lower(w), '[''’]', '', 'g') AS low, upper(w) = w AND lower(w) <> w AS up FROM cased),
k AS (SELECT low.*, CAST(valence AS DOUBLE) AS known FROM low LEFT JOIN lexicon ON low.low = token),
d AS (SELECT *, count(*) FILTER (up) OVER a BETWEEN 1 AND n - 1 AS mixed, min(pos) FILTER (low IN ('thea', 'sich')) OVER a AS turn,
  {', '.join(f'lag(low, {i}) OVER o AS w{i}, lag(known, {i}) OVER o AS v{i}, lag(up, {i}) OVER o AS u{i}' for i in (1, 2, 3))}
  FROM k WINDOW a AS (PARTITION BY doc_id), o AS (PARTITION BY doc_id ORDER BY pos)),
v AS (SELECT *, coalesce({_IDIOM}, CASE WHEN low NOT IN {_literals(_UP + _DOWN)} THEN known END) AS v FROM d),
caps AS (SELECT *, v + CASE WHEN mixed AND up THEN sign(v) * 0.733 ELSE 0.0 END AS x0 FROM v WHERE v IS NOT NULL){_BACK},
least AS (SELECT *, CASE WHEN w1 = 'least' AND v1 IS NULL AND coalesce(w2 NOT IN ('at', 'very'), true) THEN x3 * {L.NEGATION_FACTOR} ELSE x3 END
  * CASE WHEN pos < turn THEN 0.5 WHEN pos > turn THEN 1.5 ELSE 1.0 END AS x FROM a3),
s AS (SELECT doc_id, any_value(body) AS body, list_sum(list(x ORDER BY pos)) AS t FROM least GROUP BY doc_id),
q AS (SELECT doc_id, t, length(body) - length(replace(body, '!', '')) AS e, length(body) - length(replace(body, '?', '')) AS q FROM s),
p AS (SELECT doc_id, t + sign(t) * (least(e, 4) * 0.292 + CASE WHEN q <= 1 THEN 0.0 WHEN q <= 3 THEN q * 0.18 ELSE 0.96 END) AS t FROM q)
SELECT doc_id, coalesce(round(t / sqrt(t * t + 15), 4) + 0.0, 0.0) AS score FROM documents LEFT JOIN p USING (doc_id)""")
def full_score(spark, sf_dir):
    return score_bodies(_documents(spark, sf_dir), "doc_id", "text", lexicon(spark), "score", _RULE).select("doc_id", "score")


_CORPUS = f"""WITH t AS (SELECT source, lang, unnest({S.refined('text')}) AS term FROM documents),
c AS (SELECT source, lang, term, count(*) AS n FROM t GROUP BY ALL)"""


def _corpus(spark, sf_dir):
    return tfidf.corpus_terms(_documents(spark, sf_dir), GROUP, T.words_refined("text"))


@query("term_top_k", f"""{_CORPUS}
SELECT source, lang, term, n, rank FROM (SELECT *, CAST(rank() OVER (PARTITION BY source, lang ORDER BY n DESC) AS INTEGER) AS rank FROM c) WHERE rank <= 10""")
def term_top_k(spark, sf_dir):
    return tfidf.top_terms(_corpus(spark, sf_dir), GROUP, 10)


@query("corpus_tfidf", f"""{_CORPUS}
SELECT source, lang, term, n, 1.0::DOUBLE AS idf, round(n / sqrt(sum(n * n) OVER (PARTITION BY source, lang)), 8) AS tfidf FROM c""")
def corpus_tfidf(spark, sf_dir):
    weighted = tfidf.corpus_tfidf(_corpus(spark, sf_dir), GROUP)
    return weighted.withColumn("tfidf", F.round("tfidf", 8))


@query("corpus_shape", f"{_CORPUS} SELECT source, lang, count(*) AS vocabulary, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY 1, 2")
def corpus_shape(spark, sf_dir):
    return tfidf.corpus_shape(_corpus(spark, sf_dir), GROUP)


@query("joined_corpus", f"""
WITH c AS (SELECT doc_id, source, lang, array_to_string({S.refined('text')}, ' ') AS clean,
  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS digest,
  CAST(ceil(count(*) OVER (PARTITION BY source, lang) / 25) AS BIGINT) AS chunks FROM documents)
SELECT source, lang, digest % chunks AS chunk, string_agg(clean, ' ' ORDER BY doc_id) AS corpus FROM c GROUP BY 1, 2, 3""")
def joined_corpus(spark, sf_dir):
    clean = _documents(spark, sf_dir).withColumn("clean", T.join_tokens(T.words_refined("text")))
    return daily.joined_corpus(clean, GROUP, "doc_id", "clean", chunk_rows=25)


_DOCS = "docs AS (SELECT source, lang, doc_id AS doc, n_chars AS e, text FROM documents WHERE text IS NOT NULL)"


@query("tfidf_per_group", f"""WITH {_DOCS}, {S.weights('docs', 'source, lang')}
SELECT source, lang, doc AS doc_id, term, round(v, 8) AS weight FROM weights""")
def tfidf_per_group(spark, sf_dir):
    weights = tfidf.tfidf(_documents(spark, sf_dir), GROUP, "doc_id", "text")
    return weights.withColumn("weight", F.round("weight", 8))


@query("dispersion", f"""WITH {_DOCS}, {S.dispersions('docs', 'source, lang')}
SELECT source, lang, round(dispersion, 6) AS dispersion FROM dispersions""")
def dispersion(spark, sf_dir):
    out = tfidf.dispersion(_documents(spark, sf_dir), GROUP, "doc_id", "text", "n_chars")
    return out.withColumn("dispersion", F.round("dispersion", 6))


@query("overall_dispersion", f"""WITH {_DOCS}, {S.dispersions('docs', 'source, lang')},
sums AS (SELECT source, lang, sum(e) AS sum_eng FROM docs GROUP BY 1, 2)
SELECT source, round(sum(dispersion * sum_eng) / nullif(sum(sum_eng), 0), 6) AS dispersion_tweets_content
FROM dispersions JOIN sums USING (source, lang) GROUP BY 1""")
def overall_dispersion(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    parts = tfidf.dispersion(docs, GROUP, "doc_id", "text", "n_chars")
    sums = docs.groupBy(*GROUP).agg(F.sum("n_chars").alias("sum_eng"))
    out = daily.overall_dispersion(parts.join(sums, GROUP), ["source"])
    return out.withColumn("dispersion_tweets_content", F.round("dispersion_tweets_content", 6))


@query("mean_similarity", f"""WITH {_DOCS}, {S.weights('docs', 'source, lang')},
p AS (SELECT source, lang, a.doc AS i, sum(a.v * b.v) AS s FROM weights a JOIN weights b USING (source, lang, term) WHERE a.doc <> b.doc GROUP BY ALL),
d AS (SELECT DISTINCT source, lang, doc FROM weights)
SELECT source, lang, doc AS doc_id, round(coalesce(s, 0.0) / nullif(n - 1, 0), 6) + 0.0 AS mean_cosine
FROM d JOIN ns USING (source, lang) LEFT JOIN p ON d.source = p.source AND d.lang = p.lang AND d.doc = p.i""")
def mean_similarity(spark, sf_dir):
    out = tfidf.mean_similarity(_documents(spark, sf_dir), GROUP, "doc_id", "text")
    return out.withColumn("mean_cosine", F.round("mean_cosine", 6) + F.lit(0.0))


@query("similarity_rows", f"""WITH {_DOCS}, {S.weights('docs', 'source, lang')},
wanted AS (SELECT source, lang, min(doc_id) AS doc FROM documents JOIN (SELECT source, lang, max(n_chars) AS n_chars FROM documents GROUP BY 1, 2) USING (source, lang, n_chars) GROUP BY 1, 2)
SELECT source, lang, a.doc AS doc_id_row, b.doc AS doc_id, round(sum(a.v * b.v), 6) AS cosine
FROM weights a JOIN wanted w USING (source, lang, doc) JOIN weights b USING (source, lang, term) GROUP BY ALL""")
def similarity_rows(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    longest = docs.groupBy(*GROUP).agg(F.min(F.struct((-F.col("n_chars")).alias("n"), "doc_id")).alias("top"))
    wanted = longest.select(*GROUP, F.col("top.doc_id").alias("doc_id"))
    out = tfidf.similarity_rows(docs, GROUP, "doc_id", "text", wanted)
    return out.withColumn("cosine", F.round("cosine", 6))


@query("category_index", "SELECT doc_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang_index FROM documents")
def category_index(spark, sf_dir):
    return models.category_index(_documents(spark, sf_dir), "lang", "lang_index").select("doc_id", "lang_index")


_TRUSTED_COLUMNS = "ticker, tweet_id, writer, post_datetime_epoch, comment_num, retweet_num, like_num, total_engagement, strftime(post_date, '%Y-%m-%d') AS day, coalesce(length(body), -1) AS body_len, bow, score_vader, sentiment"


def _trusted(spark, sf_dir):
    return trusted.raw_to_trusted(posts(spark, sf_dir), links(spark, sf_dir), lexicon(spark), lemmas(spark))


@query("raw_to_trusted", f"WITH {S.TRUSTED} SELECT {_TRUSTED_COLUMNS} FROM trusted")
def raw_to_trusted(spark, sf_dir):
    out = _trusted(spark, sf_dir).withColumn("day", _text("post_date"))
    return out.withColumn("body_len", F.coalesce(F.length("body").cast("bigint"), F.lit(-1))).drop("body", "post_date", "post_datetime")


@query("raw_to_trusted_bag", f"""WITH {S.LEXICON}, {S.POSTS}, {S.LINKS},
bags AS (SELECT tweet_id, comment_num, {S.bag("coalesce(body, '')")} AS w FROM posts),
tok AS (SELECT tweet_id, unnest(list_filter(w, lambda t: t <> '')) AS t FROM bags),
bare AS (SELECT tweet_id, t, regexp_replace(t, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS b FROM tok),
s AS (SELECT tweet_id, {S.COMPOUND} AS score FROM bare JOIN lexicon ON token = CASE WHEN length(b) > 2 THEN b ELSE t END GROUP BY 1)
SELECT ticker, tweet_id, array_to_string(w, ' ') AS bow, coalesce(score, 0.0) AS score_vader
FROM bags JOIN links USING (tweet_id) LEFT JOIN s USING (tweet_id)""")
def raw_to_trusted_bag(spark, sf_dir):
    out = trusted.raw_to_trusted(posts(spark, sf_dir), links(spark, sf_dir), lexicon(spark), cleaning="bag")
    return out.select("ticker", "tweet_id", "bow", "score_vader")


@query("tokenized_posts", f"""WITH {S.POSTS},
g AS (SELECT l_orderkey AS tweet_id, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus)), ',') AS tickers FROM lineitem GROUP BY 1)
SELECT tweet_id, tickers, comment_num + retweet_num + like_num AS total_engagement,
       strftime(to_timestamp(post_date) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, array_to_string({S.words("coalesce(body, '')")}, ' ') AS words
FROM posts LEFT JOIN g USING (tweet_id)""")
def tokenized_posts(spark, sf_dir):
    out = trusted.tokenized_posts(posts(spark, sf_dir), links(spark, sf_dir))
    return out.select(
        "tweet_id", F.array_join("ticker_symbol_group", ",").alias("tickers"), "total_engagement",
        _text("post_date").alias("day"), T.join_tokens("body_tokenized").alias("words"),
    )


_REFINED = f"""{S.TRUSTED}, {S.PRICES}, {S.changes()}, {S.LIMITS_STD}, {S.LABELS},
docs AS (SELECT ticker, post_date AS date, sentiment, tweet_id AS doc, total_engagement AS e, bow AS text FROM trusted),
{S.dispersions('docs', 'ticker, date, sentiment')},
sums AS (SELECT ticker, date, sentiment, sum(e) AS sum_eng FROM docs GROUP BY ALL),
content AS (SELECT ticker, date, sum(dispersion * sum_eng) / nullif(sum(sum_eng), 0) AS dispersion_tweets_content
  FROM dispersions JOIN sums USING (ticker, date, sentiment) GROUP BY ALL),
weighted AS (SELECT ticker, post_date AS date, CASE WHEN sum(total_engagement) = 0 THEN 0.0
  ELSE CAST(sum(CAST(total_engagement * score_vader AS DECIMAL(38, 12))) AS DOUBLE) / sum(total_engagement) END AS weighted_vader FROM trusted GROUP BY ALL),
refined AS (SELECT ticker, date,
    {', '.join(f"CAST(coalesce(sum(e) FILTER (sentiment = '{c}'), 0) AS BIGINT) AS sum_eng_{c}, count(*) FILTER (sentiment = '{c}') / count(*) AS {c}" for c in ('negative', 'neutral', 'positive'))},
    count(*) AS n_tweets, any_value(dispersion_tweets_content) AS dispersion_tweets_content, any_value(Y) AS Y, any_value(Y2) AS Y2
  FROM docs JOIN content USING (ticker, date) LEFT JOIN labels_of_day USING (ticker, date) GROUP BY ALL)"""
_ROUNDED = ["negative", "neutral", "positive", "dispersion_tweets_content", "Y2"]


def _trusted_zone(spark, sf_dir):
    """The trusted table as the first job leaves it: written per ticker and read back."""
    path = work_path(spark, "trusted")
    with dropping_shuffles(spark):
        io.write_by_ticker(_trusted(spark, sf_dir), path)
    return io.read_parquet(spark, path)


def _daily(spark, sf_dir):
    done = _trusted_zone(spark, sf_dir)
    return done, refined.trusted_to_refined(done, prices(spark, sf_dir)), refined.weighted_sentiment(done)


@query("trusted_to_refined", f"""WITH {_REFINED} SELECT ticker, strftime(date, '%Y-%m-%d') AS day, sum_eng_negative, sum_eng_neutral, sum_eng_positive,
n_tweets, Y, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)} FROM refined""")
def trusted_to_refined(spark, sf_dir):
    _, features, _ = _daily(spark, sf_dir)
    return features.withColumn("day", _text("date")).withColumns({c: F.round(c, 6) for c in _ROUNDED}).drop("date")


@query("weighted_sentiment", f"WITH {_REFINED} SELECT ticker, strftime(date, '%Y-%m-%d') AS day, round(weighted_vader, 6) + 0.0 AS weighted_vader FROM weighted")
def weighted_sentiment(spark, sf_dir):
    weighted = refined.weighted_sentiment(_trusted(spark, sf_dir))
    return weighted.select("ticker", _text("date").alias("day"), (F.round("weighted_vader", 6) + F.lit(0.0)).alias("weighted_vader"))


@query("peak_report", f"""WITH {_REFINED},
peaks AS (SELECT ticker, date, 'rise' AS move, 'positive' AS sentiment, Y2 FROM refined JOIN (SELECT ticker, max(Y2) AS Y2 FROM refined GROUP BY 1) USING (ticker, Y2)
  UNION ALL SELECT ticker, date, 'fall', 'negative', Y2 FROM refined JOIN (SELECT ticker, min(Y2) AS Y2 FROM refined GROUP BY 1) USING (ticker, Y2)),
top AS (SELECT ticker, post_date AS date, sentiment, tweet_id, total_engagement FROM trusted
  QUALIFY rank() OVER (PARTITION BY ticker, post_date, sentiment ORDER BY total_engagement DESC) = 1)
SELECT ticker, strftime(date, '%Y/%m/%d') AS day, move, sentiment, round(Y2, 6) AS Y2, round(weighted_vader, 6) + 0.0 AS weighted_vader, tweet_id, total_engagement
FROM peaks LEFT JOIN top USING (ticker, date, sentiment) LEFT JOIN weighted USING (ticker, date)""")
def peak_report(spark, sf_dir):
    done, features, weighted = _daily(spark, sf_dir)
    out = reports.peak_days_with_posts(features, weighted, done)
    return out.select(
        "ticker", "day", "move", "sentiment", F.round("Y2", 6).alias("Y2"),
        (F.round("weighted_vader", 6) + F.lit(0.0)).alias("weighted_vader"), "tweet_id", "total_engagement",
    )


@query("series_compare", f"""WITH {_REFINED},
d AS (SELECT ticker, date, Y2, weighted_vader, row_number() OVER (PARTITION BY ticker ORDER BY date) AS day_no FROM refined JOIN weighted USING (ticker, date)),
m AS (SELECT ticker, avg(Y2) AS my, stddev_pop(Y2) AS sy, avg(weighted_vader) AS mw, stddev_pop(weighted_vader) AS sw FROM d GROUP BY 1)
SELECT ticker, strftime(date, '%Y-%m-%d') AS day, CAST(day_no AS INTEGER) AS day_no, round((weighted_vader - mw) / sw, 5) + 0.0 AS z_weighted_vader, round((Y2 - my) / sy, 5) + 0.0 AS z_Y2
FROM d JOIN m USING (ticker) WHERE day_no <= 50""")
def series_compare(spark, sf_dir):
    _, features, weighted = _daily(spark, sf_dir)
    out = reports.sentiment_against_price(features, weighted, days=50)
    z = [(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("z_weighted_vader", "z_Y2")]
    return out.select("ticker", _text("date").alias("day"), "day_no", *z)


@query("quality_all", f"""WITH {S.POSTS}, l AS (SELECT l_orderkey AS tweet_id, l_returnflag || l_linestatus AS ticker_symbol FROM lineitem)
{' UNION ALL '.join(f"SELECT 'posts' AS table, 'nulls' AS check, '{c}' AS column, count(*) FILTER ({c} IS NULL) AS n FROM posts" for c in ('tweet_id', 'writer', 'post_date', 'body', 'comment_num', 'retweet_num', 'like_num'))}
UNION ALL {' UNION ALL '.join(f"SELECT 'links', 'nulls', '{c}', count(*) FILTER ({c} IS NULL) FROM l" for c in ('tweet_id', 'ticker_symbol'))}
UNION ALL {' UNION ALL '.join(f"SELECT '{t}', 'duplicates', 'tweet_id', count(*) - count(DISTINCT tweet_id) FROM {c} UNION ALL SELECT '{t}', 'distinct', 'tweet_id', count(DISTINCT tweet_id) FROM {c}" for t, c in (('posts', 'posts'), ('links', 'l')))}""")
def quality_all(spark, sf_dir):
    return reports.quality_of({"posts": (posts(spark, sf_dir), "tweet_id"), "links": (links(spark, sf_dir), "tweet_id")})
