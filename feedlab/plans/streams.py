"""Queries that run a stream over the events to its end and return what it gave out."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..sources.scratch import shared_dir
from ..streaming import streams as s
from .clock import _HOUR, _LAGGED
from .registry import query, shifted


def _events(spark, sf):
    raw = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(out, spark, name: str, mode: str):
    """Rows that a stream gives out until its input ends, through a Parquet table in the shared folder."""
    path = shared_dir(spark, name)
    schema = out.schema

    def put(batch, batch_id):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/rows/b={batch_id}")

    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)
    return spark.read.schema(schema.add("_batch", IntegerType())).parquet(f"{path}/rows")


def _last(got, keys: list[str], values: list[str]):
    """The last row that a stream in the update mode gave out for each key."""
    return got.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("x")).select(*keys, *[f"x.{c}" for c in values])


@query("stream_hourly", f"SELECT event_type, {_HOUR.format('ts')} * 3600000000 AS hour_us, count(*) AS frames, count(*) FILTER (value < 5) AS parse_errors, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes FROM events GROUP BY 1, 2")
def stream_hourly(spark, sf):
    out = s.stream_hourly_counts(_events(spark, sf), "ts", "event_type", F.octet_length("props").cast("long"), F.col("value") < 5)
    got = _last(_run(out, spark, "hourly", "update"), ["event_type", "hour_start"], ["frames", "parse_errors", "bytes"])
    return got.select("event_type", F.unix_micros("hour_start").alias("hour_us"), "frames", "parse_errors", "bytes")


@query("stream_disorder", f"WITH l AS ({_LAGGED}) SELECT stream, count(*) FILTER (source < before) AS regressions, count(before) AS comparisons, CAST(0 AS BIGINT) AS late FROM l GROUP BY 1", "v_feed")
def stream_disorder(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    rows = _events(spark, sf).select("user_id", F.col("ts").alias("received"), shifted(F.col("ts"), -k * 900_000_000).alias("source"))
    got = _run(s.stream_disorder(rows, "user_id", "received", "source"), spark, "disorder", "update")
    return _last(got, ["key"], ["regressions", "comparisons", "late"]).withColumnRenamed("key", "stream")


@query("stream_sequence_gaps", """
WITH n AS (SELECT user_id, event_id, event_id * 7919 % 1000 AS seq, ts FROM events),
l AS (SELECT *, max(seq) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM n)
SELECT user_id AS key, CAST(max(seq) AS BIGINT) AS top, CAST(coalesce(sum(CASE WHEN seq > l.top THEN seq - l.top - 1 END), 0) AS BIGINT) AS missing, count(*) FILTER (seq <= l.top) AS late FROM l GROUP BY 1""")
def stream_sequence_gaps(spark, sf):
    numbered = _events(spark, sf).withColumn("seq", F.col("event_id") * 7919 % 1000)  # numbers that don't rise with arrival
    got = _run(s.stream_sequence_gaps(numbered, "user_id", "seq", "ts"), spark, "gaps", "update")
    return _last(got, ["key"], ["top", "missing", "late"])


@query("stream_dedupe", "SELECT DISTINCT event_id, event_type FROM events")
def stream_dedupe(spark, sf):
    e = _events(spark, sf)
    out = s.stream_dedupe(e.unionByName(e), "ts", ["event_id", "ts", "user_id", "event_type", "value", "props"]).select("event_id", "event_type")
    return _run(out, spark, "dedupe", "append").select("event_id", "event_type")


@query("stream_segments", "SELECT 'feed' AS source, 'events' AS stream, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS record_count, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM events GROUP BY 3, 4")
def stream_segments(spark, sf):
    path = shared_dir(spark, "segments")
    s.write_raw_segments(_events(spark, sf), "ts", "feed", "events", path, f"{path}/checkpoint").awaitTermination()
    got = spark.read.schema("source string, stream string, date date, hour int, record_count long, first_receive_at timestamp, last_receive_at timestamp").json(f"{path}/manifests")
    # An hour that several batches have written has a manifest of each; together they are the hour's.
    hours = got.groupBy("source", "stream", "date", "hour").agg(F.sum("record_count").alias("record_count"), F.min("first_receive_at").alias("first"), F.max("last_receive_at").alias("last"))
    return hours.select("source", "stream", "date", "hour", "record_count", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


@query("stream_continuity", """
WITH n AS (SELECT user_id, event_id * 7919 % 1000 AS seq, ts, event_type = 'error' AS cut FROM events),
e AS (SELECT *, sum(CAST(cut AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, cut, seq) AS epoch FROM n),
l AS (SELECT *, max(seq) OVER (PARTITION BY user_id, epoch ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e WHERE NOT cut),
m AS (SELECT user_id, max(epoch) AS final FROM e GROUP BY 1)
SELECT m.user_id AS key, CAST(max(seq) FILTER (epoch = final) AS BIGINT) AS top, CAST(coalesce(sum(CASE WHEN seq > l.top THEN seq - l.top - 1 END), 0) AS BIGINT) AS missing, count(*) FILTER (seq <= l.top) AS late, CAST(any_value(final) AS BIGINT) AS unknown
FROM m LEFT JOIN l USING (user_id) GROUP BY m.user_id""")
def stream_continuity(spark, sf):
    rows = _events(spark, sf).withColumn("seq", F.col("event_id") * 7919 % 1000)
    out = s.stream_continuity(rows, "user_id", "seq", "ts", F.col("event_type") == "error", idle_ms=10 * 365 * 86_400_000)
    return _last(_run(out, spark, "continuity", "update"), ["key"], ["top", "missing", "late", "unknown"])


@query("segment_source", """
SELECT event_type AS stream, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS frames, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, CAST(0 AS BIGINT) AS problems
FROM events WHERE event_type IN ('click', 'error') AND ts >= (SELECT min(ts) + INTERVAL 36 HOUR FROM events) GROUP BY 1, 2, 3""")
def segment_source(spark, sf):
    from ..sources import segments

    path = shared_dir(spark, "segments")
    rows = _events(spark, sf).withColumn("venue", F.lit("venue"))
    segments.stream_segments(rows, f"{path}/captured", f"{path}/checkpoint", source="venue", stream="event_type", receive_at="ts", payload="props").awaitTermination()
    since = spark.read.parquet(f"{sf}/events.parquet").agg(F.min(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 36 HOURS")).first()[0]
    got = segments.read_segments(spark, f"{path}/captured").where(F.col("stream").isin("click", "error") & (F.col("receive_at") >= F.lit(since)))
    counts = got.groupBy("stream", "date", "hour").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"), F.min(F.unix_micros("receive_at")).alias("first_us"), F.max(F.unix_micros("receive_at")).alias("last_us"))
    wrong = segments.frame_problems(got).groupBy("stream", "date", "hour").agg(F.count(F.lit(1)).alias("n")).withColumnsRenamed({"stream": "_s", "date": "_d", "hour": "_h"})
    both = counts.join(wrong, (F.col("stream") == F.col("_s")) & (F.col("date") == F.col("_d")) & (F.col("hour") == F.col("_h")), "left")
    return both.select(*counts.columns, F.coalesce("n", F.lit(0)).alias("problems"))
