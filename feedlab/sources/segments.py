"""Raw captures as a Spark data source: immutable segments named by their hash, seen only once their batch is committed.

A segment is a Zstandard file of JSON lines (capture_version, capture_session_id, record_ordinal, receive_at, payload_base64,
payload_sha256) of one source and stream and one UTC hour. Tasks write segments and a file of their manifests; the driver's
commit writes the names of those files, in one move. What no commit names is not read: a task that dies, or the first try of
one that is repeated, leaves no visible segment. A stream's batch has one commit whatever is run again.

Readers plan from the manifests: segments of other sources, streams, sessions, days or hours, or outside of the receive times
that are asked for, are not opened.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "raw_segments"
SCHEMA = "source string, stream string, date date, hour int, capture_session_id string, record_ordinal long, receive_at timestamp, payload binary, payload_sha256 string"
#: Bytes of lines that a writing task holds before it seals its largest segment, and of segment files that a reading task gets at least.
HELD_BYTES, TASK_BYTES = 64 << 20, 32 << 20
_MICROS = "%Y-%m-%dT%H:%M:%S.%fZ"


def _open(path: str):
    """(file system, path in it) of a URI or local path."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _put(fs, path: str, data: bytes) -> None:
    """Write a file that is there whole or not at all."""
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(draft, compression=None) as f:
        f.write(data)
    fs.move(draft, path)


def _names(fs, folder: str) -> list[str]:
    from pyarrow.fs import FileSelector

    return sorted(f.path for f in fs.get_file_info(FileSelector(folder, allow_not_found=True)) if f.path.endswith(".json"))


class RawSegments(DataSource):
    """``spark.read.format("raw_segments").option("path", ..)``, and the same to write a table or a stream."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return SegmentReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("segments are immutable: append to them")
        return SegmentWriter(self.options["path"], self.options.get("session", ""))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return SegmentStreamWriter(self.options["path"], self.options.get("session", ""))


@dataclass
class Planned(InputPartition):
    """Segments of one task."""

    segments: tuple


def manifests(path: str) -> list[dict]:
    """The manifests of all committed segments."""
    fs, root = _open(path)
    out = []
    for commit in _names(fs, f"{root}/commits"):
        with fs.open_input_stream(commit) as f:
            lists = json.loads(f.read())["manifests"]
        for name in lists:
            with fs.open_input_stream(f"{root}/{name}") as f:
                out += json.loads(f.read())
    return out


class SegmentReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.keep = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what manifests can decide; filters on times and sessions are checked again by Spark, row by row."""
        for f in filters:
            column, value = f.attribute[0], getattr(f, "value", None)
            if column in ("source", "stream", "date", "hour", "capture_session_id") and isinstance(f, (EqualTo, In)) and len(f.attribute) == 1:
                self.keep.append((column, "in", tuple(value) if isinstance(f, In) else (value,)))
                continue  # all rows of a segment agree on these
            if column == "receive_at" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.keep.append((column, type(f).__name__, value))
            yield f

    def _asked(self, m: dict) -> bool:
        for column, how, value in self.keep:
            if how == "in":
                have = date.fromisoformat(m["date"]) if column == "date" else m[column]
                if have not in value:
                    return False
                continue
            first, last = (datetime.strptime(m[c], _MICROS).replace(tzinfo=timezone.utc) for c in ("first_receive_at", "last_receive_at"))
            value = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
            if how.startswith(("Greater", "Equal")) and last < value or how.startswith(("Less", "Equal")) and first > value:
                return False
        return True

    def partitions(self) -> list[Planned]:
        asked, packed, size = [m for m in manifests(self.path) if self._asked(m)], [[]], 0
        for m in asked:
            if size >= TASK_BYTES:
                packed, size = [*packed, []], 0
            packed[-1].append(m)
            size += m["object_size_bytes"]
        return [Planned(tuple(p)) for p in packed]

    def read(self, partition: Planned) -> Iterator[pa.RecordBatch]:
        import pyarrow.json as pj
        import zstandard

        fs, root = _open(self.path)
        lines = pa.schema([("capture_session_id", pa.string()), ("record_ordinal", pa.int64()), ("receive_at", pa.string()), ("payload_base64", pa.string()), ("payload_sha256", pa.string())])
        for m in partition.segments:
            with fs.open_input_stream(f"{root}/{m['object_path']}", compression=None) as f:
                data = f.read()
            if hashlib.sha256(data).hexdigest() != m["object_sha256"]:
                raise ValueError(f"segment {m['object_path']} is not what its manifest names")
            with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)) as z:
                rows = pj.read_json(io.BytesIO(z.read()), parse_options=pj.ParseOptions(explicit_schema=lines, unexpected_field_behavior="ignore"))
            for b in rows.to_batches(max_chunksize=4096):
                n = b.num_rows
                at = pa.array([datetime.strptime(x, _MICROS).replace(tzinfo=timezone.utc) for x in b.column("receive_at").to_pylist()], pa.timestamp("us", "UTC"))
                payload = pa.array([base64.b64decode(x) for x in b.column("payload_base64").to_pylist()], pa.binary())
                each = [pa.array([m["source"]] * n), pa.array([m["stream"]] * n), pa.array([date.fromisoformat(m["date"])] * n), pa.array([m["hour"]] * n, pa.int32())]
                yield pa.RecordBatch.from_arrays([*each, b.column("capture_session_id"), b.column("record_ordinal"), at, payload, b.column("payload_sha256")], names=[c.split()[0] for c in SCHEMA.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: the file of its manifests, and its segments."""

    manifests: str | None
    objects: tuple


class _Segment:
    """A segment being written: its lines, until it is sealed."""

    def __init__(self, key: tuple, session: str) -> None:
        self.key, self.session, self.rows, self.first, self.last = key, session, 0, None, None
        self.lines = bytearray()

    def add(self, at: datetime, payload: bytes) -> None:
        text = at.strftime(_MICROS)
        record = {"capture_version": "v0", "capture_session_id": self.session, "record_ordinal": self.rows, "receive_at": text, "payload_base64": base64.b64encode(payload).decode(), "payload_sha256": f"sha256:{hashlib.sha256(payload).hexdigest()}"}
        self.lines += json.dumps(record, sort_keys=True, separators=(",", ":")).encode() + b"\n"
        self.first, self.last = min(self.first or text, text), max(self.last or text, text)
        self.rows += 1

    def seal(self, fs, root: str) -> dict:
        import zstandard

        data = zstandard.ZstdCompressor(level=3).compress(bytes(self.lines))
        digest = hashlib.sha256(data).hexdigest()
        source, stream, day, hour = self.key
        path = f"objects/source={source}/stream={stream}/date={day}/hour={hour:02d}/{digest}.jsonl.zst"
        _put(fs, f"{root}/{path}", data)
        return {
            "source": source, "stream": stream, "date": day, "hour": hour, "capture_session_id": self.session, "record_count": self.rows, "first_ordinal": 0, "last_ordinal": self.rows - 1,
            "first_receive_at": self.first, "last_receive_at": self.last, "object_sha256": digest, "object_size_bytes": len(data), "object_path": path,
        }


class _Writes:
    """What batch and stream writers share."""

    def __init__(self, path: str, session: str) -> None:
        self.path, self.session = path, session or uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        task, done, begun = uuid.uuid4().hex, [], 0
        being: dict[tuple, _Segment] = {}
        held = 0

        def seal(key: tuple) -> None:
            nonlocal held
            held -= len(being[key].lines)
            done.append(being.pop(key).seal(fs, root))

        for batch in batches:
            for source, stream, at, payload in zip(*(batch.column(c).to_pylist() for c in ("source", "stream", "receive_at", "payload")), strict=True):
                at = at.astimezone(timezone.utc) if at.tzinfo else at.replace(tzinfo=timezone.utc)
                key = (source, stream, at.date().isoformat(), at.hour)
                if key not in being:
                    being[key], begun = _Segment(key, f"{self.session}-{task}-{begun}"), begun + 1
                held -= len(being[key].lines)
                being[key].add(at, payload)
                held += len(being[key].lines)
                if held >= HELD_BYTES:
                    seal(max(being, key=lambda k: len(being[k].lines)))
        for key in list(being):
            seal(key)
        if not done:
            return Written(None, ())
        name = f"manifests/{task}.json"
        _put(fs, f"{root}/{name}", json.dumps(done, sort_keys=True, separators=(",", ":")).encode())
        return Written(name, tuple(m["object_path"] for m in done))

    def _publish(self, messages: list[Written | None], name: str) -> None:
        fs, root = _open(self.path)
        if f"{root}/commits/{name}.json" in _names(fs, f"{root}/commits"):
            return self._remove(messages)  # the batch was committed before the query stopped; its first try stands
        text = json.dumps({"manifests": [m.manifests for m in messages if m and m.manifests]}, separators=(",", ":"))
        _put(fs, f"{root}/commits/{name}.json", text.encode())

    def _remove(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        for m in messages:
            for path in (*m.objects, m.manifests) if m and m.manifests else ():
                fs.delete_file(f"{root}/{path}")


class SegmentWriter(_Writes, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._publish(messages, f"write-{self.session}")

    def abort(self, messages: list[Written | None]) -> None:
        self._remove(messages)


class SegmentStreamWriter(_Writes, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._publish(messages, f"batch-{batchId:012d}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._remove(messages)


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(RawSegments)
    return spark


def frames(df: DataFrame, source: str, stream: str, receive_at: str, payload: str) -> DataFrame:
    """``df`` as (source, stream, receive_at, payload) in the order of segments: each stream's hour in one task, in order of arrival."""
    out = df.select(F.col(source).cast("string").alias("source"), F.col(stream).cast("string").alias("stream"), F.col(receive_at).cast("timestamp").alias("receive_at"), F.col(payload).cast("binary").alias("payload"))
    hour = F.date_trunc("hour", "receive_at")
    return out.repartition("source", "stream", hour).sortWithinPartitions("source", "stream", "receive_at")


def write_segments(df: DataFrame, path: str, **columns: str) -> None:
    """Write a table's frames as committed segments; ``columns`` as in ``frames``. Nulls in them are refused."""
    _registered(df.sparkSession)
    frames(df, **columns).write.format(FORMAT).option("path", path).mode("append").save()


def stream_segments(rows: DataFrame, path: str, checkpoint: str, **columns: str):
    """Start a query that appends a stream's frames, a commit a batch."""
    _registered(rows.sparkSession)
    out = rows.select(*[F.col(columns[c]).cast(kind).alias(c) for c, kind in (("source", "string"), ("stream", "string"), ("receive_at", "timestamp"), ("payload", "binary"))])
    out = out.repartition("source", "stream", F.date_trunc("hour", "receive_at"))  # an hour of a stream is one segment of a batch
    return out.writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Committed frames. Filters on source, stream, date, hour, session and receive_at choose the segments that are opened."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return _registered(spark).read.format(FORMAT).option("path", path).load()


def frame_problems(df: DataFrame) -> DataFrame:
    """Frames that are not what they say, with reasons: payload hash, place in their session, hour."""
    from pyspark.sql import Window

    from ..operators.quality import reasons

    before = F.lag("record_ordinal").over(Window.partitionBy("capture_session_id").orderBy("record_ordinal"))
    rows = df.withColumn("_before", before)
    rules = {
        "hash": F.sha2("payload", 256) != F.regexp_replace("payload_sha256", "^sha256:", ""), "ordinal": F.col("record_ordinal") != F.coalesce(F.col("_before") + 1, F.lit(0)),
        "hour": (F.to_date("receive_at") != F.col("date")) | (F.hour("receive_at") != F.col("hour")),
    }
    return rows.withColumn("reasons", reasons(rules)).drop("_before").where(F.size("reasons") > 0)
