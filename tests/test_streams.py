"""Streams over several micro-batches give the rows of their batch twins, however frames are spread over the batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedlab.operators import clock
from feedlab.plans.streams import _last, _run
from feedlab.streaming import streams

T0 = datetime(2026, 3, 1)


def frames(spark, folder, batches):
    """A stream that takes each list of (key, seconds, lag, seq) as a micro-batch of its own."""
    schema = "key long, ts timestamp, source timestamp, seq long, kind string"
    for i, rows in enumerate(batches):
        data = [(k, T0 + timedelta(seconds=t), T0 + timedelta(seconds=t - lag), seq, "a") for k, t, lag, seq in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"file://{folder}/in/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/in/*"), spark.read.schema(schema).parquet(f"file://{folder}/in/*")


BATCHES = [[(1, 20, 1, 5), (1, 10, 0, 1), (2, 5, 0, 9)], [(1, 30, 25, 3), (1, 40, 2, 9), (2, 3_700, 0, 12)], [(1, 7_300, 5, 7), (1, 7_300, 9, 8), (2, 3_701, 9, 11)]]


@pytest.fixture
def feed(spark, tmp_path):
    return frames(spark, tmp_path, BATCHES)


def test_hours_are_all_given_out(spark, feed):
    stream, table = feed
    out = streams.stream_hourly_counts(stream, "ts", "kind", F.lit(10), F.col("seq") == 9)
    got = {(r.hour_start, r.frames, r.parse_errors, r.bytes) for r in _last(_run(out, spark, "t-hours", "update"), ["kind", "hour_start"], ["frames", "parse_errors", "bytes"]).collect()}
    assert got == {(T0, 5, 2, 50), (T0 + timedelta(hours=1), 2, 0, 20), (T0 + timedelta(hours=2), 2, 0, 20)}
    twin = clock.hourly_counts(table, "ts", "kind", F.lit(10), F.col("seq") == 9)
    assert sorted((r.frames, r.parse_errors, r.bytes) for r in twin.collect()) == sorted(x[1:] for x in got)


def test_disorder_over_batches(spark, feed):
    stream, table = feed
    got = _last(_run(streams.stream_disorder(stream, "key", "ts", "source"), spark, "t-disorder", "update"), ["key"], ["regressions", "comparisons", "late"])
    want = clock.disorder(table.withColumnRenamed("ts", "received"), ["key"])
    assert sorted((r.key, r.regressions, r.comparisons) for r in got.collect()) == sorted((r.key, r.regressions, r.comparisons) for r in want.collect())
    assert all(r.late == 0 for r in got.collect())


def test_rows_behind_a_judged_time_are_late(spark, tmp_path):
    stream, _ = frames(spark, tmp_path, [[(1, 10, 0, 1), (1, 20, 0, 2), (1, 30, 0, 3)], [(1, 15, 0, 4), (1, 40, 30, 5)]])
    got = _last(_run(streams.stream_disorder(stream, "key", "ts", "source"), spark, "t-late", "update"), ["key"], ["regressions", "comparisons", "late"]).collect()
    assert [tuple(r) for r in got] == [(1, 1, 3, 1)]


def test_sequence_numbers_in_order_of_arrival(spark, feed):
    stream, _ = feed
    got = _last(_run(streams.stream_sequence_gaps(stream, "key", "seq", "ts"), spark, "t-gaps", "update"), ["key"], ["top", "missing", "late"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 9, 6, 3), (2, 12, 2, 1)]  # 1 5 3 9 7 8; 9 12 11


def test_repeats_in_later_batches_go(spark, tmp_path):
    stream, table = frames(spark, tmp_path, [BATCHES[0], BATCHES[0] + BATCHES[1], BATCHES[1]])
    out = _run(streams.stream_dedupe(stream, "ts", ["key", "ts", "source", "seq", "kind"]).select("key", "seq"), spark, "t-dedupe", "append")
    assert sorted((r.key, r.seq) for r in out.collect()) == sorted((k, s) for b in BATCHES[:2] for k, _, _, s in b)


def test_segments_have_frames_and_manifests(spark, feed, tmp_path):
    stream, table = feed
    path = f"file://{tmp_path}/segments"
    streams.write_raw_segments(stream, "ts", "src", "name", path, f"{path}-checkpoint").awaitTermination()
    kept = spark.read.json(f"{path}/frames/batch=*/source=src/stream=name/date=*/hour=*")
    assert sorted(r.seq for r in kept.collect()) == sorted(r.seq for r in table.collect())
    manifests = spark.read.json(f"{path}/manifests/batch=*").collect()
    assert sum(r.record_count for r in manifests) == 9 and {(r.date, r.hour) for r in manifests} == {("2026-03-01", 0), ("2026-03-01", 1), ("2026-03-01", 2)}


CONTINUITY = "key long, ts timestamp, seq long, kind string"


def cut_frames(spark, folder, batches):
    for i, rows in enumerate(batches):
        data = [(k, T0 + timedelta(seconds=t), seq, kind) for k, t, seq, kind in rows]
        spark.createDataFrame(data, CONTINUITY).coalesce(1).write.parquet(f"file://{folder}/cut/{i:03d}")
    return spark.readStream.schema(CONTINUITY).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/cut/*")


def test_reconnects_expiry_and_a_seeded_start(spark, tmp_path):
    stream = cut_frames(spark, tmp_path, [
        [(1, 10, 5, "f"), (1, 20, 8, "f"), (2, 15, 100, "f"), (3, 12, 7, "f")],
        [(1, 30, None, "reconnect"), (1, 40, 50, "f"), (1, 50, 52, "f"), (1, 60, 51, "f"), (3, 61, 9, "f")],
        [(3, 9_000, 12, "f")],
        [(3, 9_600, 13, "f"), (1, 9_500, 60, "f")],
    ])
    seed = spark.createDataFrame([(2, 97, 4, 1, 2, int(T0.timestamp() * 1000)), (9, 40, 0, 0, 0, int(T0.timestamp() * 1000))], "key long, top long, missing long, late long, unknown long, last_ms long")
    out = _run(streams.stream_continuity(stream, "key", "seq", "ts", F.col("kind") == "reconnect", idle_ms=3_600_000, initial=seed), spark, "t-continuity", "update")
    rows = [tuple(r) for r in out.orderBy("_batch").select("key", "top", "missing", "late", "unknown", "ended").collect()]
    of = lambda k: [r[1:] for r in rows if r[0] == k]
    assert of(1)[:2] == [(8, 2, 0, 0, False), (52, 3, 1, 1, False)]  # 50 after the reconnect is no gap
    assert (52, 3, 1, 1, True) in of(1) and of(1)[-1][:4] in [(60, 0, 0, 0), (52, 3, 1, 1)]  # ended by silence, then a stream of its own
    assert of(2)[0] == (100, 6, 1, 2, False) and of(2)[-1] == (100, 6, 1, 2, True)  # went on from 97
    assert of(9) == [(40, 0, 0, 0, True)]  # from the snapshot alone: never seen, ended
    assert [r for r in of(3) if not r[-1]][:2] == [(7, 0, 0, 0, False), (9, 1, 0, 0, False)]
