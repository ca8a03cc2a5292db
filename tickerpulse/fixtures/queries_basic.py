"""Scans, projections, joins, daily aggregates, prices and quality checks."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tickerpulse.fixtures import sql as S
from tickerpulse.fixtures.registry import query
from tickerpulse.fixtures.tables import links, order_prices, posts, prices, seconds_of, table
from tickerpulse.functions import columns as C
from tickerpulse.operators import common, daily, enrich, explore, quality
from tickerpulse.operators import prices as P
from tickerpulse.session import work_path
from tickerpulse.sources import io, schemas

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _text(date: str):
    return F.date_format(date, "yyyy-MM-dd")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("day", _text("ts"))


_MIX = ", ".join(f"round(count(*) FILTER (event_type = '{t}') / count(*), 6) AS \"{t}\"" for t in EVENT_TYPES)


@query("daily_mix", f"SELECT strftime(ts, '%Y-%m-%d') AS day, {_MIX}, count(*) AS n_tweets FROM events GROUP BY 1")
def daily_mix(spark, sf_dir):
    mix = daily.sentiment_mix(_events(spark, sf_dir), ["day"], "event_type", EVENT_TYPES)
    return mix.select("day", *[F.round(t, 6).alias(t) for t in EVENT_TYPES], "n_tweets")


_COUNTS = ", ".join(f"count(*) FILTER (event_type = '{t}') AS \"{t}\"" for t in EVENT_TYPES)


@query("daily_counts", f"SELECT strftime(ts, '%Y-%m-%d') AS day, {_COUNTS} FROM events GROUP BY 1")
def daily_counts(spark, sf_dir):
    return daily.sentiment_counts(_events(spark, sf_dir), ["day"], "event_type", EVENT_TYPES)


_SUMS = ", ".join(f"round(coalesce(sum(value) FILTER (event_type = '{t}'), 0), 4) AS sum_eng_{t}" for t in EVENT_TYPES)


@query("daily_value_pivot", f"SELECT strftime(ts, '%Y-%m-%d') AS day, {_SUMS} FROM events GROUP BY 1")
def daily_value_pivot(spark, sf_dir):
    sums = daily.engagement_sums(_events(spark, sf_dir), ["day"], "event_type", "value", EVENT_TYPES)
    return sums.select("day", *[F.round(f"sum_eng_{t}", 4).alias(f"sum_eng_{t}") for t in EVENT_TYPES])


@query("daily_table", f"SELECT strftime(ts, '%Y-%m-%d') AS day, {_SUMS}, {_MIX}, count(*) AS n_tweets FROM events GROUP BY 1")
def daily_table(spark, sf_dir):
    both = daily.daily_table(_events(spark, sf_dir), ["day"], "event_type", "value", EVENT_TYPES)
    rounded = [F.round(f"sum_eng_{t}", 4).alias(f"sum_eng_{t}") for t in EVENT_TYPES] + [F.round(t, 6).alias(t) for t in EVENT_TYPES]
    return both.select("day", *rounded, "n_tweets")


@query("weighted_daily_score", """
WITH w AS (SELECT strftime(ts, '%Y-%m-%d') AS day,
             CASE WHEN sum(user_id) = 0 THEN 0.0 ELSE sum(user_id * value) / sum(user_id) END AS s FROM events GROUP BY 1)
SELECT day, round(s, 6) AS weighted_vader, round((s - (SELECT avg(s) FROM w)) / (SELECT stddev_pop(s) FROM w), 6) AS z_weighted_vader FROM w""")
def weighted_daily_score(spark, sf_dir):
    scored = daily.weighted_score(_events(spark, sf_dir), ["day"], "value", "user_id")
    z = explore.z_scores(scored, ["weighted_vader"])
    return z.select("day", F.round("weighted_vader", 6).alias("weighted_vader"), F.round("z_weighted_vader", 6).alias("z_weighted_vader"))


@query("group_set_left_join", """
WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS s FROM lineitem GROUP BY 1)
SELECT o_orderkey, array_to_string(s, ',') AS tickers, coalesce(CAST(len(s) AS INTEGER), -1) AS n_tickers, list_contains(s, 'AF') AS has_af
FROM orders LEFT JOIN g ON o_orderkey = l_orderkey""")
def group_set_left_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tweet_id"))
    joined = enrich.with_ticker_groups(orders, links(spark, sf_dir))
    group = F.col("ticker_symbol_group")
    return joined.select(
        F.col("tweet_id").alias("o_orderkey"), F.array_join(group, ",").alias("tickers"),
        F.coalesce(F.size(group), F.lit(-1)).alias("n_tickers"), F.array_contains(group, "AF").alias("has_af"),
    )


@query("posts_of_ticker", """
SELECT ticker, count(*) AS n_posts, sum(o_totalprice_cents) AS cents, count(*) FILTER (ticker = 'AF') AS n_af
FROM (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS ticker FROM lineitem)
JOIN (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS o_totalprice_cents FROM orders) ON o_orderkey = l_orderkey
GROUP BY ticker""")
def posts_of_ticker(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tweet_id"), F.round("o_totalprice").cast("bigint").alias("cents"))
    grouped = enrich.with_ticker_groups(orders, links(spark, sf_dir))
    per_ticker = enrich.by_ticker(grouped).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_posts"), F.sum("cents").alias("cents"))
    af = enrich.mentions(grouped, "AF").select(F.lit("AF").alias("ticker")).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_af"))
    return per_ticker.join(af, "ticker", "left").na.fill(0, ["n_af"])


@query("semi_join_sample", """
SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 2000) GROUP BY 1""")
def semi_join_sample(spark, sf_dir):
    sample = common.first_rows(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), 2000, "l_orderkey")
    kept = enrich.keep_linked(table(spark, sf_dir, "lineitem"), sample, "l_orderkey")
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("qty"))


@query("engagement_sum", "SELECT l_orderkey, l_linenumber, round(l_quantity + l_extendedprice + l_tax, 4) AS total_engagement FROM lineitem")
def engagement_sum(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    total = C.total_engagement("l_quantity", "l_extendedprice", "l_tax")
    return items.select("l_orderkey", "l_linenumber", F.round(total, 4).alias("total_engagement"))


@query("quality_report", """
SELECT 'nulls' AS "check", 'text' AS item, count(*) FILTER (text IS NULL) AS n FROM conversations
UNION ALL SELECT 'nulls', 'value', count(*) FILTER (value IS NULL) FROM events
UNION ALL SELECT 'duplicates', 'conv_id', count(*) - count(DISTINCT conv_id) FROM conversations
UNION ALL SELECT 'duplicates', 'conv_id,turn', count(*) - count(DISTINCT (conv_id, turn)) FROM conversations
UNION ALL SELECT 'missing_days', 'events', 31 - count(DISTINCT CAST(ts AS DATE)) FROM events
UNION ALL SELECT 'empty_cells', 'events', count(*) FILTER (ts IS NULL) + count(*) FILTER (user_id IS NULL) FROM events""")
def quality_report(spark, sf_dir):
    talks, events = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "events")
    row = lambda check, item, n: (F.lit(check).alias("check"), (F.lit(item) if isinstance(item, str) else item).alias("item"), F.col(n).alias("n"))
    return common.union_all(
        quality.null_counts(talks, ["text"]).select(*row("nulls", F.col("column"), "n_null")),
        quality.null_counts(events, ["value"]).select(*row("nulls", F.col("column"), "n_null")),
        quality.duplicate_count(talks, ["conv_id"]).select(*row("duplicates", "conv_id", "n_duplicates")),
        quality.duplicate_count(talks, ["conv_id", "turn"]).select(*row("duplicates", "conv_id,turn", "n_duplicates")),
        quality.is_covered(events, "2024-01-01", "2024-01-31", "ts").select(*row("missing_days", "events", "n_missing")),
        quality.has_no_nulls(events, ["ts", "user_id"]).select(*row("empty_cells", "events", "n_null")),
    )


@query("duplicate_rows", """
SELECT conv_id, turn, role FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1""")
def duplicate_rows(spark, sf_dir):
    return quality.duplicate_rows(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role")


@query("missing_days", """
WITH days AS (SELECT DISTINCT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date FROM orders),
spine AS (SELECT ticker, CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT ticker FROM days))
SELECT ticker, strftime(date, '%Y-%m-%d') AS day FROM spine ANTI JOIN days USING (ticker, date)""")
def missing_days(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date"))
    gaps = quality.missing_days(days, "1995-01-01", "2001-08-01", keys=["ticker"])
    return gaps.select("ticker", _text("date").alias("day"))


@query("epoch_roundtrip", """
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, strftime(ts, '%Y-%m-%d') AS day,
       strftime(ts, '%Y/%m/%d') AS slash_day, strftime(CAST(ts AS DATE) - 1, '%Y-%m-%d') AS day_before,
       TRY_CAST(props AS TIMESTAMP) IS NULL AS unparsed, strftime(TRY_CAST(strftime(ts, '%Y-%m-%d') AS TIMESTAMP), '%Y/%m/%d') AS parsed
FROM events""")
def epoch_roundtrip(spark, sf_dir):
    seconds = table(spark, sf_dir, "events").withColumn("epoch", seconds_of("ts"))
    at = C.epoch_to_timestamp(F.col("epoch").cast("string"))
    return seconds.select(
        "event_id", "epoch", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"), _text(F.to_date(at)).alias("day"),
        C.slash_date(at).alias("slash_day"), _text(F.date_sub(F.to_date(at), 1)).alias("day_before"),
        C.lenient_timestamp("props").isNull().alias("unparsed"),
        C.slash_date(C.lenient_timestamp(_text("ts"))).alias("parsed"),
    )


@query("price_spine_ffill", f"""
WITH {S.ORDER_PRICES}, {S.changes()}
SELECT ticker, strftime(date, '%Y-%m-%d') AS day, round(adj_close, 4) AS adj_close FROM filled""")
def price_spine_ffill(spark, sf_dir):
    filled = P.fill_calendar(io.read_prices(order_prices(spark, sf_dir)))
    return filled.select("ticker", _text("date").alias("day"), F.round("adj_close", 4).alias("adj_close"))


@query("price_segments_ffill", f"""
WITH {S.ORDER_PRICES}, {S.changes()}
SELECT ticker, strftime(date, '%Y-%m-%d') AS day, round(adj_close, 4) AS adj_close FROM filled""")
def price_segments_ffill(spark, sf_dir):
    filled = P.fill_calendar_in_segments(io.read_prices(order_prices(spark, sf_dir)), days=31)
    return filled.select("ticker", _text("date").alias("day"), F.round("adj_close", 4).alias("adj_close"))


def _labels_sql(limits: str, lead_days: int = 0) -> str:
    return f"""WITH {S.ORDER_PRICES}, {S.changes(lead_days)}, {limits}, {S.LABELS}
      SELECT ticker, strftime(date, '%Y-%m-%d') AS day, Y, round(Y2, 6) AS Y2 FROM labels_of_day"""


def _labels(spark, sf_dir, **options):
    labels = P.move_labels(order_prices(spark, sf_dir), **options)
    return labels.select("ticker", _text("date").alias("day"), "Y", F.round("Y2", 6).alias("Y2"))


@query("pct_change_label_std", _labels_sql(S.LIMITS_STD))
def pct_change_label_std(spark, sf_dir):
    return _labels(spark, sf_dir)


@query("pct_change_label_iqr", _labels_sql(S.LIMITS_IQR))
def pct_change_label_iqr(spark, sf_dir):
    return _labels(spark, sf_dir, method="iqr")


@query("pct_change_label_next_day", _labels_sql(S.LIMITS_STD, 1))
def pct_change_label_next_day(spark, sf_dir):
    return _labels(spark, sf_dir, lead_days=1)


@query("move_thresholds", f"""
WITH {S.ORDER_PRICES}, {S.changes()}, {S.LIMITS_STD}, iqr AS (WITH {S.LIMITS_IQR} SELECT * FROM limits)
SELECT 'std' AS method, ticker, round(lower, 6) AS lower, round(upper, 6) AS upper FROM limits
UNION ALL SELECT 'iqr', ticker, round(lower, 6), round(upper, 6) FROM iqr""")
def move_thresholds(spark, sf_dir):
    changes = P.daily_change(P.fill_calendar(order_prices(spark, sf_dir)))
    return common.union_all(*[
        P.thresholds(changes, m).select(F.lit(m).alias("method"), "ticker", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))
        for m in ("std", "iqr")
    ])


@query("outlier_moves", f"""
WITH {S.ORDER_PRICES}, {S.changes()}, {S.LIMITS_IQR}
SELECT ticker, strftime(date, '%Y-%m-%d') AS day, round(change, 6) AS change FROM changes JOIN limits USING (ticker)
WHERE change > upper OR change < lower""")
def outlier_moves(spark, sf_dir):
    changes = P.daily_change(P.fill_calendar(order_prices(spark, sf_dir)))
    far = P.outlier_moves(changes, P.thresholds(changes, "iqr"))
    return far.select("ticker", _text("date").alias("day"), F.round("change", 6).alias("change"))


@query("label_lookup", f"""
WITH {S.PRICES}, {S.changes()}, {S.LIMITS_STD}, {S.LABELS},
days AS (SELECT l_returnflag || l_linestatus AS ticker, CAST(ts AS DATE) AS date, count(*) AS n_tweets
         FROM events JOIN lineitem ON event_id = l_orderkey GROUP BY 1, 2)
SELECT ticker, strftime(date, '%Y-%m-%d') AS day, n_tweets, Y, round(Y2, 6) AS Y2 FROM days LEFT JOIN labels_of_day USING (ticker, date)""")
def label_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("tweet_id"), F.to_date("ts").alias("date"))
    days = events.join(links(spark, sf_dir), "tweet_id").groupBy(F.col("ticker_symbol").alias("ticker"), "date").agg(F.count(F.lit(1)).alias("n_tweets"))
    out = P.with_labels(days, P.move_labels(prices(spark, sf_dir)))
    return out.select("ticker", _text("date").alias("day"), "n_tweets", "Y", F.round("Y2", 6).alias("Y2"))


@query("wide_prices_to_long", f"""
WITH {S.ORDER_PRICES} SELECT ticker, strftime(date, '%Y-%m-%d') AS day, round(adj_close, 4) AS adj_close FROM prices
WHERE ticker IN ('1-URGENT', '5-LOW') AND date >= DATE '1996-01-01' AND date < DATE '2000-01-01'""")
def wide_prices_to_long(spark, sf_dir):
    wide = order_prices(spark, sf_dir).groupBy(F.col("date").alias("Date")).pivot(
        "ticker", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    ).agg(F.first("adj_close"))
    long = io.wide_prices_to_long(wide)
    wanted = io.read_prices(long, ["1-URGENT", "5-LOW"], "1996-01-01", "2000-01-01")
    return wanted.select("ticker", _text("date").alias("day"), F.round("adj_close", 4).alias("adj_close"))


@query("ticker_list", "SELECT DISTINCT o_orderpriority AS ticker_symbol FROM orders")
def ticker_list(spark, sf_dir):
    return io.ticker_list(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ticker_symbol")))


@query("project_filter_basics", """
SELECT l_orderkey AS order_key, l_linenumber, l_returnflag, round(sqrt(l_quantity), 6) AS root, round(abs(l_discount - l_tax), 6) AS gap,
       CAST(ceil(l_extendedprice) AS BIGINT) AS price_up, round(pow(l_discount, 2), 6) AS squared,
       round(sqrt(l_discount * l_discount + l_tax * l_tax), 6) AS length,
       CASE WHEN l_tax = 0 THEN 0.0 ELSE round(l_discount / l_tax, 6) END AS ratio0,
       round(l_discount / nullif(l_tax, 0), 6) AS ratio
FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F' AND l_shipdate > TIMESTAMP '1996-06-30 00:00:00'""")
def project_filter_basics(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R") & (F.col("l_linestatus") == "F"))
    items = common.after_day(items.drop("l_suppkey"), "l_shipdate", F.lit("1996-06-30").cast("timestamp_ntz"))
    discount, tax = F.col("l_discount"), F.col("l_tax")
    return common.rename(items, {"l_orderkey": "order_key"}).select(
        "order_key", "l_linenumber", "l_returnflag", F.round(F.sqrt("l_quantity"), 6).alias("root"),
        F.round(F.abs(discount - tax), 6).alias("gap"), F.ceil("l_extendedprice").alias("price_up"),
        F.round(F.pow(discount, F.lit(2.0)), 6).alias("squared"), F.round(C.norm(F.array(discount, tax)), 6).alias("length"),
        F.round(C.ratio_or_zero(discount, tax), 6).alias("ratio0"), F.round(C.ratio_or_null(discount, tax), 6).alias("ratio"),
    )


@query("lookup_and_limits", """
SELECT 'lookup' AS what, o_orderkey, o_orderpriority FROM orders WHERE o_orderkey = 77
UNION ALL SELECT 'first', o_orderkey, o_orderpriority FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50)
UNION ALL SELECT 'farthest', o_orderkey, o_orderpriority FROM (SELECT * FROM orders ORDER BY abs(o_totalprice) DESC, o_orderkey LIMIT 1)""")
def lookup_and_limits(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cols = ["o_orderkey", "o_orderpriority"]
    parts = {
        "lookup": common.lookup_rows(orders, "o_orderkey", 77), "first": common.first_rows(orders, 50, "o_orderkey"),
        "farthest": common.farthest(orders, "o_totalprice", "o_orderkey"),
    }
    return common.union_all(*[df.select(F.lit(what).alias("what"), *cols) for what, df in parts.items()])


@query("distinct_null_fill", """
WITH d AS (SELECT d.doc_id, d.source, d.lang, CASE WHEN quality = 1 THEN text END AS body, coalesce(toxic, 0) AS toxic
           FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source, count(DISTINCT lang) AS n_langs, count(*) FILTER (body IS NOT NULL) AS n_bodies, CAST(sum(toxic) AS BIGINT) AS toxic,
       TRY_CAST(replace(source, 'src', '') AS DOUBLE) AS source_no, TRY_CAST(source AS DOUBLE) IS NULL AS bad_cast
FROM d GROUP BY source""")
def distinct_null_fill(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").na.fill(0, ["toxic"])
    docs = docs.withColumn("body", F.when(F.col("quality") == 1, F.col("text")))
    bodies = common.with_text(docs, "body").groupBy("source").agg(F.count(F.lit(1)).alias("n_bodies"))
    out = docs.groupBy("source").agg(F.count_distinct("lang").alias("n_langs"), F.sum("toxic").alias("toxic"))
    return out.join(bodies, "source", "left").na.fill(0, ["n_bodies"]).select(
        "source", "n_langs", "n_bodies", "toxic",
        F.replace("source", F.lit("src"), F.lit("")).try_cast("double").alias("source_no"),
        F.col("source").try_cast("double").isNull().alias("bad_cast"),
    )


@query("list_text_parse", """
SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus)), ',') AS tickers,
       CAST(count(DISTINCT l_returnflag || l_linestatus) AS INTEGER) AS n FROM lineitem GROUP BY 1""")
def list_text_parse(spark, sf_dir):
    groups = enrich.ticker_groups(links(spark, sf_dir))
    quoted = F.transform("ticker_symbol_group", lambda t: F.concat(F.lit("'"), t, F.lit("'")))
    as_text = F.concat(F.lit("["), F.array_join(quoted, " "), F.lit("]"))
    parsed = C.list_text_to_array(as_text)
    return groups.select(F.col("tweet_id").alias("l_orderkey"), F.array_join(parsed, ",").alias("tickers"), F.size(parsed).alias("n"))


@query("list_agg_per_group", """
WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, event_id, props, value,
             CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) AS digest,
             CAST(ceil(count(*) OVER (PARTITION BY CAST(ts AS DATE), event_type) / 40) AS BIGINT) AS chunks FROM events)
SELECT day, event_type, digest % chunks AS chunk, string_agg(props, '|' ORDER BY event_id) AS bow,
       string_agg(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), '|' ORDER BY event_id) AS eng
FROM e GROUP BY 1, 2, 3""")
def list_agg_per_group(spark, sf_dir):
    cents = _events(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("bigint").cast("string"))
    lists = daily.collected_lists(cents, ["day", "event_type"], "event_id", "props", "cents", chunk_rows=40)
    return lists.select("day", "event_type", "chunk", F.array_join("bow", "|").alias("bow"), F.array_join("eng", "|").alias("eng"))


@query("outer_join_days", """
WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_events FROM events WHERE event_type <> 'view' GROUP BY 1),
p AS (SELECT strftime(CAST(l_shipdate AS DATE) + 8150, '%Y-%m-%d') AS day, count(*) AS n_items FROM lineitem GROUP BY 1)
SELECT day, n_events, n_items FROM e FULL JOIN p USING (day)""")
def outer_join_days(spark, sf_dir):
    events = _events(spark, sf_dir).filter(F.col("event_type") != "view").groupBy("day").agg(F.count(F.lit(1)).alias("n_events"))
    shifted = _text(F.date_add(F.to_date("l_shipdate"), 8150)).alias("day")
    items = table(spark, sf_dir, "lineitem").groupBy(shifted).agg(F.count(F.lit(1)).alias("n_items"))
    return daily.outer_join(events, items, ["day"]).select("day", "n_events", "n_items")


@query("features_left_scores", """
WITH f AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, CASE WHEN sum(user_id) = 0 THEN 0.0 ELSE sum(user_id * value) / sum(user_id) END AS w
      FROM events WHERE value > 1 GROUP BY 1, 2)
SELECT day, event_type, n, round(w, 6) AS weighted_vader FROM f LEFT JOIN s USING (day, event_type)""")
def features_left_scores(spark, sf_dir):
    events, by = _events(spark, sf_dir), ["day", "event_type"]
    features = events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    scores = daily.weighted_score(events.filter(F.col("value") > 1), by, "value", "user_id")
    return daily.left_join(features, scores, by).select(*by, "n", F.round("weighted_vader", 6).alias("weighted_vader"))


@query("peak_posts", """
SELECT day, event_type, event_id, value FROM (
  SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, event_id, value,
         rank() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY value DESC) AS r FROM events) WHERE r = 1""")
def peak_posts(spark, sf_dir):
    return explore.most_engaged(_events(spark, sf_dir), ["day", "event_type"], "value").select("day", "event_type", "event_id", "value")


@query("extreme_rows", """
SELECT 'max' AS what, event_id, value FROM events WHERE value = (SELECT max(value) FROM events)
UNION ALL SELECT 'min', event_id, value FROM events WHERE value = (SELECT min(value) FROM events)""")
def extreme_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return common.union_all(*[
        common.rows_at_extreme(events, "value", largest).select(F.lit(what).alias("what"), "event_id", "value")
        for what, largest in (("max", True), ("min", False))
    ])


@query("class_size_and_union", """
WITH u AS (SELECT l_returnflag FROM lineitem UNION ALL SELECT o_orderstatus FROM orders), c AS (SELECT l_returnflag, count(*) AS n FROM u GROUP BY 1)
SELECT l_returnflag, n, (SELECT max(n) FROM c) AS max_class_len FROM c""")
def class_size_and_union(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").select("l_returnflag")
    both = common.union_all(flags, table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("l_returnflag")))
    return common.class_sizes(both, "l_returnflag").withColumn("max_class_len", common.largest_class(both, "l_returnflag").scalar())


@query("profile", """
WITH n AS (SELECT count(*) AS n_rows FROM conversations)
SELECT n_rows, 4 AS n_columns, c.column, c.type, n_null FROM n,
 (SELECT 'conv_id' AS "column", 'bigint' AS type, count(*) FILTER (conv_id IS NULL) AS n_null FROM conversations
  UNION ALL SELECT 'turn', 'bigint', count(*) FILTER (turn IS NULL) FROM conversations
  UNION ALL SELECT 'role', 'string', count(*) FILTER (role IS NULL) FROM conversations
  UNION ALL SELECT 'text', 'string', count(*) FILTER (text IS NULL) FROM conversations) c""")
def profile(spark, sf_dir):
    return io.profile(table(spark, sf_dir, "conversations"))


@query("preview", "SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 20")
def preview(spark, sf_dir):
    return io.preview(table(spark, sf_dir, "events"), 20, "event_id").select("event_id", "event_type")


@query("export_formats", f"""
WITH {S.POSTS}, {S.LINKS}, t AS (SELECT ticker, comment_num, body FROM posts JOIN links USING (tweet_id))
SELECT format, ticker, count(*) AS n, CAST(sum(comment_num) AS BIGINT) AS comments, CAST(sum(length(coalesce(body, ''))) AS BIGINT) AS chars
FROM t, (SELECT unnest(['parquet', 'json', 'csv', 'view']) AS format) GROUP BY 1, 2""")
def export_formats(spark, sf_dir):
    grouped = enrich.with_ticker_groups(posts(spark, sf_dir), links(spark, sf_dir))
    rows = enrich.by_ticker(grouped)
    root = work_path(spark, "exports")
    plain = rows.drop("ticker")
    io.write_by_ticker(rows, f"{root}/parquet")
    back = {"parquet": io.read_parquet(spark, f"{root}/parquet")}
    io.write_json(back["parquet"], f"{root}/json")
    io.write_csv(back["parquet"].select(*plain.columns, "ticker"), f"{root}/csv")
    schema = StructType([*schemas.POSTS.fields, StructField("ticker", StringType())])
    back["json"] = spark.read.schema(schema).json(f"{root}/json")
    back["csv"] = io.read_csv(spark, f"{root}/csv", schema, multi_line=True)
    view = f"trusted_posts_{uuid4().hex}"
    back["parquet"].createOrReplaceTempView(view)
    back["view"] = io.read_catalog(spark, view)
    spark.catalog.dropTempView(view)
    sums = [
        F.count(F.lit(1)).alias("n"), F.sum("comment_num").alias("comments"),
        F.sum(F.length(F.coalesce("body", F.lit("")))).alias("chars"),
    ]
    return common.union_all(*[df.groupBy(F.lit(fmt).alias("format"), "ticker").agg(*sums) for fmt, df in back.items()])
