"""WARC archives as a Spark data source, ``spark.read.format("warc")`` and its writer.

Reading: whole files are packed into partitions of ``partitionBytes``. Each record's
header is parsed first; predicates on ``record_type`` and on header columns that Spark
pushes down are decided on the header alone, and the payload of a record that fails
them, or of any record if the ``payload`` option is off, is skipped by its
Content-Length without being decoded. In plain files the skipped bytes are not read;
in gzip files, with one member for each record, they are only inflated.

Writing: every task rolls files of about ``fileBytes`` under fresh names; only when all
tasks have ended does the driver publish a manifest of the files that count. A lost or
repeated task leaves unlisted files at worst. Readers of a folder with a manifest read
the listed files alone; of any other folder or file, each ``*.warc`` or ``*.warc.gz``.

Rows written: record_type, record_id, target_uri, date, refers_to, payload_digest,
payload_bytes, payload (binary; null or of a revisit: no payload follows). Rows read:
the same. Spark keeps one reader for each loaded frame, so two different filters of one
frame in one plan would both be pushed to it: load the path once for each. A null header is left out and read back as null. A record whose headers lack
Content-Length or whose bytes end early raises an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from .common import drop_work_table, filesystem, new_dir, work_table

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
ARROW = pa.schema([(n, pa.string()) for n in ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest")] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])
#: Column of each named field; fixed values of the format.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
}
BY_HEADER = {v.lower(): k for k, v in HEADERS.items()}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_warc_manifest.json"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


# --- records -------------------------------------------------------------------------


def record(row: dict) -> bytes:
    """One record; line breaks in header values become blanks."""
    payload = row.get("payload")
    revisit = row.get("record_type") == "revisit"
    size = row.get("payload_bytes")
    if size is None:
        size = len(payload or b"")
    block = HTTP % size + (b"" if revisit or payload is None else payload)
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        value = size if column == "payload_bytes" else row.get(column)
        if value is not None:
            lines.append(f"{header}: {' '.join(str(value).splitlines())}")
    if revisit:
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def read_headers(f) -> tuple[dict, int] | None:
    """(columns, Content-Length) of the next record; None at the end."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    found, length = {}, None
    while (line := f.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("a WARC header ends early")
        name, _, value = line.decode("utf-8", "replace").partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "content-length":
            length = int(value)
        elif name in BY_HEADER:
            found[BY_HEADER[name]] = value
    if length is None:
        raise ValueError("a WARC record without Content-Length")
    if "payload_bytes" in found:
        found["payload_bytes"] = int(found["payload_bytes"])
    return found, length


def records(f, wanted, with_payload: bool, seek: bool) -> Iterator[dict]:
    """The records whose header columns pass ``wanted``."""
    while (head := read_headers(f)) is not None:
        columns, length = head
        if not wanted(columns) or not with_payload or columns.get("record_type") == "revisit":
            if seek:
                f.seek(length, 1)
            else:
                skip(f, length)
            if wanted(columns):
                yield columns
            continue
        block = f.read(length)
        if len(block) < length:
            raise ValueError("a WARC record ends early")
        if block.startswith(b"HTTP/"):
            block = block[block.index(b"\r\n\r\n") + 4 :]
        yield columns | {"payload": block}


def skip(f, n: int) -> None:
    while n > 0:
        got = len(f.read(min(n, 1 << 20)))
        if not got:
            raise ValueError("a WARC record ends early")
        n -= got


def accepts(filters: list[tuple]) -> callable:
    """A test of header columns, for pushed filters as (kind, column, value)."""

    def test(columns: dict) -> bool:
        for kind, column, value in filters:
            have = columns.get(column)
            if kind == "eq" and (have is None or have != value):
                return False
            if kind == "same" and have != value:
                return False
            if kind == "in" and (have is None or have not in value):
                return False
            if kind == "prefix" and (have is None or not have.startswith(value)):
                return False
            if kind == "null" and have is not None or kind == "not null" and have is None:
                return False
        return True

    return test


# --- the source ----------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", 64 << 20))
        self.filters: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            kinds = {EqualTo: "eq", EqualNullSafe: "same", In: "in", StringStartsWith: "prefix", IsNull: "null", IsNotNull: "not null"}
            kind = kinds.get(type(f))
            if kind and column in HEADERS and column != "payload_bytes":
                self.filters.append((kind, column, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = filesystem(self.path)
        info = fs.get_file_info(root)
        if info.type == FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == FileType.File:
            files = [info]
        else:
            files = [x for x in fs.get_file_info(FileSelector(root)) if x.type == FileType.File]
            listed = next((x for x in files if x.base_name == MANIFEST), None)
            if listed:
                with fs.open_input_stream(listed.path) as f:
                    names = set(json.loads(f.read()))
                files = [x for x in files if x.base_name in names]
            else:
                files = [x for x in files if x.base_name.endswith((".warc", ".warc.gz"))]
        out, size, names = [], 0, []
        for x in sorted(files, key=lambda x: x.path):
            if names and size + x.size > self.partition_bytes:
                out.append(Files(tuple(names)))
                size, names = 0, []
            names.append(x.path)
            size += x.size
        if names or not out:
            out.append(Files(tuple(names)))
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        import gzip
        import io

        fs, _ = filesystem(self.path)
        test, rows, size = accepts(self.filters), [], 0
        for name in partition.names:
            with fs.open_input_file(name) as raw:
                zipped = name.endswith(".gz")
                f = gzip.GzipFile(fileobj=raw) if zipped else io.BufferedReader(raw, 1 << 18)
                for row in records(f, test, self.payload, not zipped):
                    rows.append(row)
                    size += len(row.get("payload") or b"") + 256
                    if size > 8 << 20 or len(rows) >= 8192:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.zipped = options.get("compression", "none").lower() == "gzip"
        self.file_bytes = int(options.get("filebytes", 256 << 20))
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        import gzip

        fs, root = filesystem(self.path)
        out, files = None, []
        for row in (row for b in batches for at in range(0, b.num_rows, 64) for row in b.slice(at, 64).to_pylist()):
            if out is None:
                files.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.zipped)
                out = fs.open_output_stream(f"{root}/{files[-1]}", compression=None)
            raw = record(row)
            out.write(gzip.compress(raw, 3, mtime=0) if self.zipped else raw)
            if out.tell() >= self.file_bytes:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        names = [f for m in messages if m for f in m.files]
        place = f"{root}/{MANIFEST}"
        from pyarrow.fs import FileType

        if not self.overwrite and fs.get_file_info(place).type == FileType.File:
            with fs.open_input_stream(place) as f:
                names = json.loads(f.read()) + names
        with fs.open_output_stream(place + ".new") as f:
            f.write(json.dumps(names).encode())
        fs.move(place + ".new", place)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            for name in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """Options: path, payload (true), partitionBytes, compression (none, gzip), fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# --- pages to records ----------------------------------------------------------------

#: Digits of Spark's base 32 and of RFC 4648's, in order; fixed values.
BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Repeated payloads whose digests are broadcast at most: about 100 MB.
BROADCAST_ROWS = 1_000_000


def base32(hexes: F.Column) -> F.Column:
    """Upper-case base-32 form of a SHA-1 in hexadecimal: 4 groups of 40 bits."""
    groups = [F.lpad(F.conv(F.substring(hexes, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), *BASE32)


def mark_revisits(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(page_id, url, payload, payload_bytes, sha1, first) and the table of repeated
    digests behind it, which the caller drops: ``first`` is the largest page_id of the
    records with the same payload.

    Only digests and ids are shuffled to find it, pre-aggregated, so a payload that a
    third of all pages share costs a row a task. The digests that occur more than once
    are counted; up to ``broadcast_rows`` they are broadcast, so that no payload is
    shuffled. Beyond, payloads meet them in a sort-merge join, in which Spark splits the
    partition of a frequent digest (AQE skew join). Rows that share payload and largest
    page_id are responses alike; null page_ids are the smallest.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    often = rows.groupBy(F.unhex("sha1").alias("digest")).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    often = work_table(often.select(F.lower(F.hex("digest")).alias("sha1"), "first"), "repeated-payloads")
    side = F.broadcast(often) if often.count() <= broadcast_rows else often.hint("merge")
    return rows.join(side, "sha1", "left").withColumn("payload_bytes", F.length("payload").cast("long")), often


def write_pages(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", **options: str) -> None:
    """Write a record for each page; repeated payloads become revisits."""
    register(pages.sparkSession)
    rows, often = mark_revisits(pages)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), base32(F.col("sha1"))).alias("payload_digest"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").options(**options).mode("append").save(path)
    drop_work_table(often)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives
    that ``write_pages`` makes of ``pages``.

    The archives are read twice, each time with a predicate on the record type that the
    source decides on the headers: the responses' lengths and digests come from their
    payloads as read, those of the revisits, which have none, from their headers. The
    archives stay, since the frame reads them.
    """
    spark = pages.sparkSession
    path = new_dir(spark, "warc")
    write_pages(pages, path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) AS BIGINT)")

    def of_type(name: str, n_bytes: F.Column, digest: F.Column) -> DataFrame:
        archive = spark.read.format("warc").load(path)
        return archive.where(F.col("record_type") == name).select(number("record_id").alias("page_id"), n_bytes.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))

    responses = of_type("response", F.length("payload").cast("long"), base32(F.sha1("payload")))
    return responses.unionByName(of_type("revisit", F.col("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "")))
