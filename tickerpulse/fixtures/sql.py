"""Shared parts of the SQL side."""

from tickerpulse.fixtures.tables import LEMMA_ROWS, LEXICON_ROWS, PRICE_SHIFT_DAYS
from tickerpulse.functions.stopwords import ENGLISH
from tickerpulse.functions.text import TAGS_AND_LINKS, TERMS, WORDS

STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH) + "]"

LEXICON = "lexicon(token, valence) AS (VALUES " + ", ".join(f"('{t}', CAST({v} AS DOUBLE))" for t, v in LEXICON_ROWS) + ")"
LEMMAS = "lemmas(form, lemma) AS (VALUES " + ", ".join(f"('{f}', '{l}')" for f, l in LEMMA_ROWS) + ")"

POSTS = """posts AS (
  SELECT event_id AS tweet_id, CAST(user_id AS VARCHAR) AS writer, CAST(floor(epoch(ts)) AS BIGINT) AS post_date,
         text AS body, CAST(floor(value) AS INTEGER) AS comment_num, CAST(user_id AS INTEGER) AS retweet_num,
         CAST(coalesce(n_chars % 100, 0) AS INTEGER) AS like_num
  FROM events LEFT JOIN documents ON event_id = doc_id)"""

LINKS = "links AS (SELECT DISTINCT l_orderkey AS tweet_id, l_returnflag || l_linestatus AS ticker FROM lineitem)"

PRICES = f"""prices AS (
  SELECT l_returnflag || l_linestatus AS ticker, CAST(l_shipdate AS DATE) + {PRICE_SHIFT_DAYS} AS date,
         avg(l_extendedprice) AS adj_close
  FROM lineitem GROUP BY 1, 2)"""

ORDER_PRICES = """prices AS (
  SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS adj_close
  FROM orders GROUP BY 1, 2)"""


def changes(lead_days: int = 0) -> str:
    """CTEs from ``prices`` to ``changes``."""
    return f"""spine AS (
      SELECT ticker, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
      FROM (SELECT DISTINCT ticker FROM prices), (SELECT min(date) AS lo, max(date) AS hi FROM prices)),
    filled AS (
      SELECT ticker, date, last_value(adj_close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adj_close
      FROM spine LEFT JOIN prices USING (ticker, date)),
    changes AS (
      SELECT ticker, date - {lead_days} AS date, change FROM (
        SELECT ticker, date, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS change,
               row_number() OVER (PARTITION BY ticker ORDER BY date) AS day_no FROM filled)
      WHERE day_no > {1 + lead_days})"""


LIMITS_STD = """limits AS (
  SELECT ticker, median(change) - 2 * stddev_samp(change) AS lower, median(change) + 2 * stddev_samp(change) AS upper
  FROM changes GROUP BY ticker)"""
LIMITS_IQR = """limits AS (
  SELECT ticker, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM (
    SELECT ticker, quantile_cont(change, 0.25) AS q1, quantile_cont(change, 0.75) AS q3 FROM changes GROUP BY ticker))"""
LABELS = """labels_of_day AS (
  SELECT ticker, date, CASE WHEN change > upper THEN 1 WHEN change < lower THEN 2 ELSE 0 END AS Y, change AS Y2
  FROM changes JOIN limits USING (ticker))"""


def words(text: str) -> str:
    quoted = WORDS.replace("'", "''")
    return f"regexp_extract_all({text}, '{quoted}')"


def terms(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{TERMS}')"


def refined(text: str) -> str:
    tokens = words(f"regexp_replace({text}, '{TAGS_AND_LINKS}', '', 'g')")
    letters = rf"list_filter({tokens}, lambda t: regexp_full_match(t, '\p{{L}}{{2,}}'))"
    return f"list_filter(list_transform({letters}, lambda t: lower(t)), lambda t: NOT list_contains({STOP}, t))"


def stripped(text: str) -> str:
    bare = f"list_transform({words(text)}, lambda t: regexp_replace(t, '[^A-Za-z0-9]+', '', 'g'))"
    kept = f"list_filter({bare}, lambda t: length(t) > 1 AND NOT regexp_full_match(t, '[0-9]+'))"
    return f"list_filter(list_transform({kept}, lambda t: lower(t)), lambda t: NOT list_contains({STOP}, t))"


def bag(text: str) -> str:
    split = rf"string_split_regex(regexp_replace(lower({text}), '\s+$', ''), '\s')"
    return f"list_filter({split}, lambda t: NOT list_contains({STOP}, t))"


COMPOUND = "round(coalesce(sum(valence), 0.0) / sqrt(coalesce(sum(valence), 0.0) * coalesce(sum(valence), 0.0) + 15), 4) + 0.0"
CLASS = "CASE WHEN {s} >= 0.05 THEN 'positive' WHEN {s} <= -0.05 THEN 'negative' ELSE 'neutral' END"

TRUSTED = f"""{LEXICON}, {LEMMAS}, {POSTS}, {LINKS},
  words AS (SELECT tweet_id, {refined("coalesce(body, '')")} AS w FROM posts),
  tok AS (SELECT tweet_id, unnest(w) AS form, generate_subscripts(w, 1) AS pos FROM words),
  lem AS (SELECT tweet_id, pos, coalesce(lemma, form) AS t FROM tok LEFT JOIN lemmas USING (form)),
  scored AS (
    SELECT tweet_id, string_agg(t, ' ' ORDER BY pos) AS bow, {COMPOUND} AS score_vader
    FROM lem LEFT JOIN lexicon ON t = token GROUP BY tweet_id),
  trusted AS (
    SELECT ticker, tweet_id, writer, post_date AS post_datetime_epoch, body, comment_num, retweet_num, like_num,
           comment_num + retweet_num + like_num AS total_engagement,
           CAST(to_timestamp(post_date) AT TIME ZONE 'UTC' AS DATE) AS post_date,
           coalesce(bow, '') AS bow, coalesce(score_vader, 0.0) AS score_vader,
           {CLASS.format(s="coalesce(score_vader, 0.0)")} AS sentiment
    FROM posts JOIN links USING (tweet_id) LEFT JOIN scored USING (tweet_id))"""


def weights(docs: str, keys: str) -> str:
    """CTEs from ``docs`` (keys, doc, e, text) to ``weights`` (keys, doc, e, term, v): tf-idf per group."""
    return f"""tf AS (SELECT {keys}, doc, e, term, count(*) AS tf
      FROM (SELECT {keys}, doc, e, unnest({terms('text')}) AS term FROM {docs}) GROUP BY ALL),
    dfs AS (SELECT {keys}, term, count(*) AS df FROM tf GROUP BY ALL),
    ns AS (SELECT {keys}, count(*) AS n FROM {docs} GROUP BY ALL),
    raw AS (SELECT {keys}, doc, e, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS r
      FROM tf JOIN dfs USING ({keys}, term) JOIN ns USING ({keys})),
    weights AS (SELECT {keys}, doc, e, term, r / sqrt(sum(r * r) OVER (PARTITION BY {keys}, doc)) AS v FROM raw)"""


def dispersions(docs: str, keys: str) -> str:
    """The pair form: every ordered pair of different texts counts 1 − cosine, weighted by the second text's e."""
    return f"""{weights(docs, keys)},
    pairs AS (SELECT {keys}, sum(e_b * cosine) AS alike FROM (
        SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.doc AS i, b.doc AS j, any_value(b.e) AS e_b, sum(a.v * b.v) AS cosine
        FROM weights a JOIN weights b USING ({keys}, term) WHERE a.doc <> b.doc GROUP BY ALL) GROUP BY ALL),
    totals AS (SELECT {keys}, (count(*) - 1) * sum(e) AS total FROM {docs} GROUP BY ALL),
    dispersions AS (SELECT {keys},
        CASE WHEN total = 0 OR NOT EXISTS (SELECT 1 FROM weights w WHERE {' AND '.join(f'w.{k.strip()} = totals.{k.strip()}' for k in keys.split(','))})
             THEN 0.0 ELSE (total - coalesce(alike, 0.0)) / total END AS dispersion
      FROM totals LEFT JOIN pairs USING ({keys}))"""
