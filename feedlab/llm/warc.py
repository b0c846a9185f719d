"""WARC archives: writing them as whole-file gzip streams, rewriting those with one gzip member a record, reading by offset.

``write_monolithic`` lets Spark's text sink write the records, so each file is one gzip stream, as many crawlers leave
them. ``normalise`` inflates each such stream once, record by record, writes every record as a member of its own and
beside each archive a sidecar with the offset and length of each member. ``read_records`` then opens members by offset.
Files are reached by their URI through pyarrow's file systems; a task writes to a name of its own and renames at the end,
so a task that is run again leaves one whole file. Memory is bounded by the largest record.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads below this many bytes are always stored whole.
LEAST_REVISIT_BYTES = 100
_END = b"\r\n\r\n"
_CHUNK = 1 << 20
INDEX_SCHEMA = "archive string, offset long, length long, warc_type string, record_id string"
RECORD_SCHEMA = "record_id string, target_uri string, warc_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def _fs(uri: str):
    return FileSystem.from_uri(re.sub(r"^(\w+):/+(?=[^/])", r"\1:///", uri) if re.match(r"file:", uri) else uri)


def plan_records(pages: DataFrame, key: str, uri: str, payload: str) -> DataFrame:
    """key, uri, payload, payload_bytes, payload_digest, record_type and refers_to of each row.

    Of rows with equal payloads of at least 100 bytes, the smallest key is the response and the others revisit it. Null
    payloads count as empty; rows that repeat the smallest key are responses too; a null key is larger than any other.
    """
    from .common import stored

    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(uri).alias("uri"), body.alias("payload"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body.cast("binary"), 256).alias("payload_digest"))
    # The table of repeated payloads is small next to the pages and is written first, so Spark knows its size before it plans the join.
    twice = rows.where(F.col("payload_bytes") >= LEAST_REVISIT_BYTES).groupBy("payload_digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(stored(twice, "warc-repeats"), "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return joined.select("key", "uri", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _record(date: str):
    """One WARC record as text; a revisit has the HTTP head without the body."""
    nl = "\r\n"
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{nl}Content-Type: text/html; charset=utf-8{nl}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(nl + nl))
    revisit = F.col("record_type") == "revisit"
    block_bytes = F.octet_length(head) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{nl}WARC-Type: "), F.col("record_type"),
        F.lit(f"{nl}WARC-Record-ID: "), urn(F.col("key")),
        F.lit(f"{nl}WARC-Date: {date}{nl}WARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col("uri"), F.lit("urn:none")), r"\s", "%20"),
        F.lit(f"{nl}WARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{nl}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{nl}WARC-Refers-To: "), urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit(f"{nl}Content-Type: application/http; msgtype=response{nl}Content-Length: "), block_bytes.cast("string"), F.lit(nl + nl),
        head, F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )


def write_monolithic(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", max_records_per_file: int = 0) -> None:
    """Records of ``plan_records`` as WARC files below ``path``, each file a single gzip stream."""
    records.select(_record(date).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max_records_per_file).text(path)


def _inflated(stream) -> Iterator[bytes]:
    """The plain bytes of a gzip stream, read once in order, whatever members it has."""
    inflate = zlib.decompressobj(31)
    while data := stream.read(_CHUNK):
        while data:
            yield inflate.decompress(data, _CHUNK)
            while inflate.unconsumed_tail:
                yield inflate.decompress(inflate.unconsumed_tail, _CHUNK)
            data = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                inflate = zlib.decompressobj(31)
    yield inflate.flush()


def head_fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, whole record) in order; ValueError where the bytes are no WARC or end within a record."""
    buffer, done = bytearray(), False

    def more() -> bool:
        nonlocal done
        for x in chunks:
            buffer.extend(x)
            if x:
                return True
        done = True
        return False

    start = 0
    while True:
        while (end := buffer.find(_END, start)) < 0:
            if not more():
                if bytes(buffer[start:]).strip():
                    raise ValueError("the archive ends within a record's head")
                return
        head = bytes(buffer[start:end])
        if not head.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = head_fields(head)
        stop = end + 4 + int(fields["content-length"]) + 4
        while len(buffer) < stop:
            if not more():
                raise ValueError("the archive ends within a record")
        yield fields, bytes(buffer[start:stop])
        start = stop
        if start > _CHUNK:
            del buffer[:start]
            start = 0


def target_name(path: str, source_dir: str) -> str:
    """Name of the archive that is written for one below ``source_dir``, without endings; no two archives share one."""
    plain = lambda x: re.sub(r"^\w+:(//[^/]*)?/*", "/", x)
    own, top = plain(path), plain(source_dir).rstrip("/") + "/"
    return quote(own.removeprefix(top).removesuffix(".gz"), safe="")


def _rewrite(source: str, name: str, target_dir: str) -> tuple[str, int]:
    fs, path = _fs(source)
    out_fs, out_dir = _fs(target_dir)
    mine = f"{out_dir}/_{name}-{uuid.uuid4().hex}"
    count = offset = 0
    out_fs.create_dir(out_dir, recursive=True)
    with fs.open_input_file(path) as stream, out_fs.open_output_stream(mine + ".a", compression=None) as archive, out_fs.open_output_stream(mine + ".i", compression=None) as index:
        for fields, record in split_records(_inflated(stream)):
            member = gzip.compress(record, 6, mtime=0)
            archive.write(member)
            index.write(json.dumps({"archive": f"{target_dir}/{name}.warc.gz", "offset": offset, "length": len(member), "warc_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id")}).encode() + b"\n")
            offset += len(member)
            count += 1
    out_fs.move(mine + ".a", f"{out_dir}/{name}.warc.gz")
    out_fs.move(mine + ".i", f"{out_dir}/{name}.idx.json")
    return f"{target_dir}/{name}.warc.gz", count


def normalise(spark: SparkSession, source_dir: str, target_dir: str) -> DataFrame:
    """Rewrite every archive below ``source_dir``; (archive, n_records) of each. Runs when the result is used.

    An archive is inflated by one task, as a single stream can only be read in order; there is a task for each archive.
    An archive without records gets an empty archive and index; a folder without archives gives no rows. A stream that
    is no WARC, or ends within a record, raises ValueError. Repeated records are all kept.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source_dir).select("path")
    n_files = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                archive, n = _rewrite(path, target_name(path, source_dir), target_dir)
                yield pa.RecordBatch.from_pydict({"archive": [archive], "n_records": [n]})

    return files.repartition(n_files).mapInArrow(run, "archive string, n_records long")


def read_index(spark: SparkSession, archive_dir: str) -> DataFrame:
    """Offsets of all records below ``archive_dir``; no rows where it has no archives."""
    fs, path = _fs(archive_dir)
    if fs.get_file_info(path).type == FileType.NotFound:
        return spark.createDataFrame([], INDEX_SCHEMA)
    return spark.read.schema(INDEX_SCHEMA).option("pathGlobFilter", "*.idx.json").json(archive_dir)


def parse_record(record: bytes, with_payload: bool = True) -> dict:
    """Fields of one record; the digest of a response is taken from its bytes, that of a revisit from its header."""
    import hashlib

    end = record.index(_END)
    fields = head_fields(record[:end])
    block = record[end + 4 : end + 4 + int(fields["content-length"])]
    http_head, _, payload = block.partition(_END)
    revisit = fields["warc-type"] == "revisit"
    return {
        "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "warc_type": fields["warc-type"], "refers_to": fields.get("warc-refers-to"),
        "payload_bytes": int(head_fields(http_head)["content-length"]) if revisit else len(payload),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
        "payload": payload if with_payload and not revisit else None,
    }


def read_records(index: DataFrame, with_payload: bool = True, run_bytes: int = 16 << 20) -> DataFrame:
    """The records that rows of an index point to, each read and inflated alone.

    Runs of records of about ``run_bytes`` of an archive are read together, by a task for each run. Repeated index rows
    give repeated records; an index without rows gives none.
    """
    schema = RECORD_SCHEMA
    names = [x.split()[0] for x in schema.split(", ")]
    types = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive not in files:
                    fs, path = _fs(archive)
                    files = {archive: fs.open_input_file(path)}  # rows of an archive come together
                member = files[archive].read_at(length, offset)
                rows.append(parse_record(gzip.decompress(member), with_payload))
                held += len(rows[-1]["payload"] or b"")
                if held > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, types)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, types)

    slim = index.select("archive", "offset", "length", F.expr(f"offset DIV {run_bytes}").alias("part"))
    n_parts = slim.select("archive", "part").distinct().count()
    return slim.repartition(max(1, n_parts), "archive", "part").sortWithinPartitions("archive", "offset").mapInArrow(run, schema)
