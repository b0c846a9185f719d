"""The segment source: commit, pruning, replay of batches, and what a dead task leaves."""

import glob
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedlab.sources import segments

T0 = datetime(2026, 6, 1, 22)
COLUMNS = {"source": "venue", "stream": "kind", "receive_at": "at", "payload": "body"}


@pytest.fixture(scope="module")
def captured(spark):
    rows = [(v, k, T0 + timedelta(minutes=7 * i, microseconds=i), f"{v}{k}{i}é".encode()) for i in range(60) for v, k in (("p", "book"), ("p", "trade"), ("q", "book"))]
    return spark.createDataFrame([*rows, rows[0]], "venue string, kind string, at timestamp, body binary")


def test_frames_come_back_and_filters_choose_segments(spark, captured, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/cap"
    segments.write_segments(captured, path, **COLUMNS)
    got = segments.read_segments(spark, path)
    back = sorted((r["source"], r["stream"], r["receive_at"], bytes(r["payload"])) for r in got.collect())
    assert back == sorted((r["venue"], r["kind"], r["at"], bytes(r["body"])) for r in captured.collect())
    assert segments.frame_problems(got).count() == 0
    listed = segments.manifests(path)
    assert sum(m["record_count"] for m in listed) == 181 and len(listed) == 21  # three streams, seven hours
    assert all(m["object_path"].endswith(f"{m['object_sha256']}.jsonl.zst") for m in listed)
    reader = segments.SegmentReader(path)
    left = list(reader.pushFilters([segments.EqualTo(("stream",), "book"), segments.GreaterThan(("receive_at",), T0 + timedelta(hours=5)), segments.EqualTo(("payload_sha256",), "x")]))
    assert [f.attribute for f in left] == [("receive_at",), ("payload_sha256",)]
    assert sum(len(p.segments) for p in reader.partitions()) == 4  # two streams of two hours each
    asked = got.where((F.col("stream") == "book") & (F.col("receive_at") >= F.lit(T0 + timedelta(hours=5))) & (F.col("hour") < 5))
    want = captured.where((F.col("kind") == "book") & (F.col("at") >= F.lit(T0 + timedelta(hours=5))) & (F.hour("at") < 5))
    assert asked.count() == want.count() > 0
    left = next(line for line in asked._jdf.queryExecution().executedPlan().toString().split("\n") if "Filter" in line)
    assert "receive_at" in left and "book" not in left  # what manifests decide is pushed whole


def test_a_dead_task_leaves_no_visible_segment(spark, captured, tmp_path):
    path = f"file://{tmp_path}/cap"
    bad = captured.withColumn("body", F.when((F.col("kind") == "trade") & (F.minute("at") == 14), F.assert_true(F.lit(False) & (F.col("at") > "2000-01-01"), F.lit("dies")).cast("binary")).otherwise(F.col("body")))
    with pytest.raises(Exception, match="dies"):
        segments.write_segments(bad, path, **COLUMNS)
    assert segments.read_segments(spark, path).count() == 0
    segments.write_segments(captured, path, **COLUMNS)
    assert segments.read_segments(spark, path).count() == 181


def test_streams_commit_once_a_batch(spark, captured, tmp_path):
    captured.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(captured.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    path, checkpoint = f"file://{tmp_path}/cap", f"{tmp_path}/check"
    segments.stream_segments(stream, path, checkpoint, **COLUMNS).awaitTermination()
    assert segments.read_segments(spark, path).count() == 181
    commits = sorted(glob.glob(f"{tmp_path}/cap/commits/*.json"))
    assert len(commits) == 3
    for name in ("2", ".2.crc"):  # as if the driver had died after the commit
        os.remove(f"{checkpoint}/commits/{name}")
    segments.stream_segments(stream, path, checkpoint, **COLUMNS).awaitTermination()
    assert segments.read_segments(spark, path).count() == 181 and sorted(glob.glob(f"{tmp_path}/cap/commits/*.json")) == commits


def test_changed_files_are_refused(spark, captured, tmp_path):
    path = f"file://{tmp_path}/cap"
    segments.write_segments(captured, path, **COLUMNS)
    name = segments.manifests(path)[3]["object_path"]
    with open(f"{tmp_path}/cap/{name}", "r+b") as f:
        f.seek(20)
        f.write(b"\x00")
    with pytest.raises(Exception, match="not what its manifest names"):
        segments.read_segments(spark, path).count()
    with pytest.raises(Exception, match="immutable"):
        segments.frames(captured, **COLUMNS).write.format(segments.FORMAT).option("path", path).mode("overwrite").save()
    assert json.loads(open(glob.glob(f"{tmp_path}/cap/commits/*.json")[0]).read())["manifests"]
