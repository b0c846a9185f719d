"""Queries: clocks, gaps and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clock as c
from .registry import events, feed, query, table

_LAG = "CAST(floor((epoch_us(received) - epoch_us(source)) / 1000.0) AS BIGINT)"
_HOUR = "CAST(floor(epoch_us({}) / 3600000000.0) AS BIGINT)"


@query("lag_stats", f"SELECT count(*) AS n_rows, count(*) FILTER (d < 0) AS n_negative, min(d) AS min_ms, round(quantile_cont(d, 0.5), 6) AS median_ms, round(quantile_cont(d, 0.95), 6) AS p95_ms, max(d) AS max_ms FROM (SELECT {_LAG} AS d FROM v_feed)", "v_feed")
def lag_stats(spark, sf):
    return c.lag_stats(feed(spark, sf))


@query("lag_histogram", f"SELECT {_HOUR.format('received')} AS hour, {_LAG} AS delta_ms, count(*) AS n FROM v_feed GROUP BY 1, 2", "v_feed")
def lag_histogram(spark, sf):
    return c.lag_histogram(feed(spark, sf))


@query("freq_quantile", f"SELECT kind, round(quantile_cont(d, 0.5), 6) AS q0500, round(quantile_cont(d, 0.95), 6) AS q0950, round(quantile_cont(d, 0.99), 6) AS q0990 FROM (SELECT kind, {_LAG} AS d FROM v_feed) GROUP BY 1", "v_feed")
def freq_quantile(spark, sf):
    return c.freq_quantile(c.lag_histogram(feed(spark, sf), ["kind"]), "delta_ms", "n", [0.5, 0.95, 0.99], ["kind"])


def _audit_sql(by: str) -> str:
    group, pick, join = (f"{by}, ", f"GROUP BY {by}", f"USING ({by})") if by else ("", "", "ON true")
    over = f"PARTITION BY {group}stream"
    return f"""
WITH d AS (SELECT {by + ", " if by else ""}stream, received, source, {_LAG} AS d, {_HOUR.format('received')} AS h FROM x),
o AS (SELECT {group}count(*) AS n_rows, round(quantile_cont(d, 0.5), 6) AS p50_ms, round(quantile_cont(d, 0.95), 6) AS p95_ms, round(quantile_cont(abs(d), 0.99), 6) AS abs_p99_ms, round(count(*) FILTER (d < 0) / count(*), 6) AS negative_rate, count(DISTINCT h % 24) AS hours_of_day FROM d {pick}),
m AS (SELECT {group}h, quantile_cont(d, 0.5) AS m FROM d GROUP BY {group}h),
r AS (SELECT {group}round(arg_min(m, h), 6) AS first_median_ms, round(arg_max(m, h), 6) AS last_median_ms, round(arg_max(m, h) - arg_min(m, h), 6) AS drift_ms FROM m {pick}),
w AS (SELECT {group}source < lag(source) OVER ({over} ORDER BY received, source) AS back, lag(source) OVER ({over} ORDER BY received, source) IS NOT NULL AS cmp FROM d),
q AS (SELECT {group}round(count(*) FILTER (back) / count(*) FILTER (cmp), 6) AS disorder_rate FROM w {pick})
SELECT *, negative_rate >= 0.001 OR abs_p99_ms > 5000 OR hours_of_day < 24 AS downgrade FROM o JOIN r {join} JOIN q {join}"""


@query("timestamp_audit", _audit_sql("").replace("FROM x)", "FROM v_feed)"), "v_feed")
def timestamp_audit(spark, sf):
    return c.timestamp_audit(feed(spark, sf), ["stream"])


@query("multi_day_audit", _audit_sql("day").replace("FROM x)", "FROM (SELECT *, CAST(received AS DATE) AS day FROM v_feed) JOIN (SELECT day FROM (SELECT CAST(ts AS DATE) AS day FROM events GROUP BY 1 HAVING count(DISTINCT hour(ts)) = 24) ORDER BY sha256('audit|7|' || CAST(day AS VARCHAR)) LIMIT 4) USING (day))"), "v_feed")
def multi_day_audit(spark, sf):
    from ..operators.review import hash_sample

    rows = feed(spark, sf).withColumn("day", F.to_date("received"))
    days = c.complete_days(rows, "received").where("hours = 24").select("day")
    picked = hash_sample(days, ["day"], "audit", "7", 4)
    return c.timestamp_audit(rows.join(F.broadcast(picked), "day"), ["stream"], ["day"])


@query("day_preflight", "SELECT CAST(ts AS DATE) AS day, count(*) AS n_rows, count(*) FILTER (user_id IS NULL OR event_type IS NULL) AS n_incomplete, count(DISTINCT user_id) AS n_keys, CAST(min(epoch_us(ts)) AS BIGINT) AS first_us, CAST(max(epoch_us(ts)) AS BIGINT) AS last_us, count(DISTINCT event_type) AS n_kinds, count(DISTINCT hour(ts)) AS n_hours FROM events GROUP BY 1")
def day_preflight(spark, sf):
    return c.day_preflight(events(spark, sf), "ts", ["user_id", "event_type"], "user_id", "event_type")


@query("hour_coverage", f"SELECT event_type, max(h) - min(h) + 1 AS expected, count(*) AS present, max(h) - min(h) + 1 - count(*) AS missing, round(count(*) / (max(h) - min(h) + 1), 6) AS ratio FROM (SELECT DISTINCT event_type, {_HOUR.format('ts')} AS h FROM events) GROUP BY 1")
def hour_coverage(spark, sf):
    return c.hour_coverage(events(spark, sf), "ts", ["event_type"])


@query("missing_hours", f"WITH h AS (SELECT DISTINCT event_type, {_HOUR.format('ts')} AS hour FROM events), r AS (SELECT event_type, unnest(range(min(hour), max(hour) + 1)) AS hour FROM h GROUP BY 1) SELECT event_type, hour FROM r ANTI JOIN h USING (event_type, hour)")
def missing_hours(spark, sf):
    return c.missing_hours(events(spark, sf), "ts", ["event_type"])


@query("complete_days", "SELECT CAST(hour_start AS DATE) AS day, count(*) AS objects, count(DISTINCT hour(hour_start)) AS hours, count(*) = 24 AND count(DISTINCT hour(hour_start)) = 24 AS complete FROM (SELECT DISTINCT date_trunc('hour', ts) AS hour_start, event_type FROM events WHERE event_type = 'click') GROUP BY 1")
def complete_days(spark, sf):
    objects = events(spark, sf).where("event_type = 'click'").select(F.date_trunc("hour", "ts").alias("hour_start"), "event_type").distinct()
    return c.complete_days(objects, "hour_start")


@query("capture_health", f"""
WITH s AS (SELECT event_type, ts, octet_length(encode(props)) AS b, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) AS step FROM events)
SELECT event_type, count(*) AS frames, CAST(sum(b) AS BIGINT) AS bytes, count(DISTINCT {_HOUR.format('ts')}) AS hours, round(sum(b) / count(DISTINCT {_HOUR.format('ts')}) * 24, 6) AS bytes_a_day, CAST(coalesce(sum(step) FILTER (step <= 3600000000), 0) AS BIGINT) AS uptime_us, count(*) FILTER (step > 3600000000) AS gaps FROM s GROUP BY 1""")
def capture_health(spark, sf):
    return c.capture_health(events(spark, sf), "ts", "event_type", F.octet_length("props").cast("long"), 3_600_000_000)


@query("hourly_counts", f"SELECT event_type, {_HOUR.format('ts')} AS hour, count(*) AS frames, count(*) FILTER (value < 5) AS parse_errors, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes FROM events GROUP BY 1, 2")
def hourly_counts(spark, sf):
    return c.hourly_counts(events(spark, sf), "ts", "event_type", F.octet_length("props").cast("long"), F.col("value") < 5)


_LAGGED = "SELECT *, lag(source) OVER (PARTITION BY stream ORDER BY received, source) AS before, epoch_us(received) - epoch_us(lag(received) OVER (PARTITION BY stream ORDER BY received)) AS step FROM v_feed"


@query("disorder_count", f"WITH l AS ({_LAGGED}) SELECT stream, count(*) FILTER (source < before) AS regressions, count(before) AS comparisons FROM l GROUP BY 1", "v_feed")
def disorder_count(spark, sf):
    return c.disorder(feed(spark, sf), ["stream"])


@query("gap_candidates", f"WITH l AS ({_LAGGED}) SELECT stream, count(*) FILTER (step > 86400000000) AS gaps, CAST(max(step) AS BIGINT) AS widest_us FROM l GROUP BY 1", "v_feed")
def gap_candidates(spark, sf):
    return c.gap_candidates(feed(spark, sf), ["stream"], 86_400_000)


@query("clock_regressions", f"WITH l AS ({_LAGGED}) SELECT kind, count(*) FILTER (source < before) AS regressions FROM l GROUP BY 1", "v_feed")
def clock_regressions(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("stream").orderBy("received", "source")
    rows = feed(spark, sf).select("kind", (F.col("source") < F.lag("source").over(w)).alias("back"))
    return rows.groupBy("kind").agg(F.count_if("back").alias("regressions"))


@query("sequence_gaps", """
WITH s AS (SELECT conv_id, turn, (turn * 7) % 5 AS s FROM conversations),
t AS (SELECT *, max(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s)
SELECT conv_id, count(*) AS n_rows, CAST(sum(CASE WHEN s > top THEN s - top - 1 ELSE 0 END) AS BIGINT) AS missing, count(*) FILTER (s <= top) AS out_of_order FROM t GROUP BY 1""")
def sequence_gaps(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", ((F.col("turn") * 7) % 5).alias("s"))
    return c.sequence_gaps(rows, ["conv_id"], "s", ["turn"])


@query("coverage_islands", """
WITH s AS (SELECT user_id, ts, event_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT user_id, t, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM s)
SELECT user_id, island, CAST(min(t) AS BIGINT) AS start_us, CAST(max(t) AS BIGINT) AS end_us, count(*) AS n FROM i GROUP BY 1, 2""")
def coverage_islands(spark, sf):
    return c.coverage_islands(events(spark, sf), ["user_id"], "ts", 43_200_000_000)


@query("common_window", "SELECT CAST(max(a) AS BIGINT) AS start_us, CAST(min(b) AS BIGINT) AS end_us FROM (SELECT event_type, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events GROUP BY 1) HAVING max(a) <= min(b)")
def common_window(spark, sf):
    return c.common_window(c.coverage_islands(events(spark, sf), ["event_type"], "ts", 864_000_000_000), ["event_type"])


@query("nearest_rank", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS largest, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def nearest_rank(spark, sf):
    return c.nearest_rank(events(spark, sf), "value", ["event_type"])


@query("candle_monotone", """
WITH c AS (SELECT stream, CAST(floor(epoch_us(received) / 3600000000.0) AS BIGINT) * 3600 AS end_ts, min(price) AS low, max(price) AS high FROM v_feed GROUP BY 1, 2)
SELECT stream, count(*) AS candles, count(*) FILTER (high <= before) AS not_rising, CAST(max(high - low) AS DECIMAL(10,2)) AS widest FROM (SELECT *, lag(high) OVER (PARTITION BY stream ORDER BY end_ts) AS before FROM c) GROUP BY 1""", "v_feed")
def candle_monotone(spark, sf):
    from ..sources.records import monotone

    candles = feed(spark, sf).groupBy("stream", (c.hour(F.col("received")) * 3600).alias("end_ts")).agg(F.min("price").alias("low"), F.max("price").alias("high"))
    checked = monotone(candles, ["stream"], "high", ["end_ts"])  # ends of hours rise by their making, their highs need not
    return checked.groupBy("stream").agg(F.count(F.lit(1)).alias("candles"), F.count_if("not_rising").alias("not_rising"), F.max(F.col("high") - F.col("low")).cast("decimal(10,2)").alias("widest"))
