"""WARC archives as a data source: written from tables, read with predicates on headers."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage,
)

from shelfwise.llm.common import arrow_schema, shared_path, table

#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 100
#: A file is closed when it has so many bytes; a partition reads whole files, about so many bytes in all.
FILE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "_manifest.json"
SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes bigint, "
    "refers_to string, payload binary"
)
# fixed values of the format
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    """A header value: one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def member(record: dict) -> bytes:
    """A record as one gzip member.

    Its header names the compressed length (extra field ``sl``), so a reader can
    go on to the next record without inflating this one.
    """
    payload, kind = record["payload"] or b"", record["record_type"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % record["payload_bytes"]
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    for column, header in HEADERS.items():
        if record[column] is not None:
            lines.append(f"{header}: {_clean(record[column])}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {REVISIT}")
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    length = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + (8).to_bytes(2, "little") + length.to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra
    return head + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    """Each task attempt writes files of its own; the manifest, written last, names those that count."""

    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for at in range(batch.num_rows):  # one payload at a time
                record = batch.slice(at, 1).to_pylist()[0]
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record)
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        files = sorted(f for m in messages if m for f in m.files)
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written]) -> None:
        """Files without a manifest are not read."""


@dataclass
class Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    """Reads header after header; inflates a payload only if its record is wanted and payloads are."""

    def __init__(self, path: str, file_bytes: int, payloads: bool):
        self.path, self.file_bytes, self.payloads, self.tests = path, file_bytes, payloads, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = _open(self.path)
        with store.open_input_stream(f"{root}/{MANIFEST}") as f:
            files = json.loads(f.read())
        out, size = [], self.file_bytes
        for name, length in files:
            if size + length > self.file_bytes:
                out.append(Files([]))
                size = 0
            out[-1].names.append(name)
            size += length
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema, store_root = arrow_schema(SCHEMA), _open(self.path)
        rows, held = [], 0
        for name in partition.names:
            for row in self.records(*store_root, name):
                rows.append(row)
                held += len(row["payload"] or b"") + 500
                if held >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def wanted(self, row: dict) -> bool:
        return all(
            row[name] is not None and (row[name] in value if how == "in" else row[name].startswith(value))
            for name, how, value in self.tests
        )

    def records(self, store: fs.FileSystem, root: str, name: str) -> Iterator[dict]:
        columns = {header.lower(): column for column, header in HEADERS.items()}
        with store.open_input_file(f"{root}/{name}") as f:
            at, end = 0, f.size()
            while at < end:
                f.seek(at)
                head = f.read(24)
                if head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"sl":
                    raise ValueError(f"{name} has no record with its length at {at}")
                length = int.from_bytes(head[16:20], "little")
                inflate = zlib.decompressobj(-15)
                first = f.read(min(length - 24, 4096))
                data = inflate.decompress(first, 2048)
                while b"\r\n\r\n" not in data and not inflate.eof:
                    data += self.more(f, inflate, 2048, at + length)
                top, _, rest = data.partition(b"\r\n\r\n")
                row = dict.fromkeys(["record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload"])
                for line in top.decode("utf-8", "replace").split("\r\n")[1:]:
                    key, _, value = line.partition(": ")
                    if key.lower() in columns:
                        row[columns[key.lower()]] = value
                    elif key == "Content-Length":
                        block = int(value)
                if self.wanted(row):
                    while b"\r\n\r\n" not in rest and not inflate.eof:
                        rest += self.more(f, inflate, 2048, at + length)
                    http, _, body = rest.partition(b"\r\n\r\n")
                    row["payload_bytes"] = int(http.rpartition(b"Content-Length: ")[2])
                    if self.payloads and row["record_type"] == "response":
                        parts, n, want = [body], len(body), block - len(http) - 4
                        while n < want and not inflate.eof:
                            parts.append(self.more(f, inflate, 0, at + length))
                            n += len(parts[-1])
                        row["payload"] = b"".join(parts)[:want]
                    yield row
                at += length

    @staticmethod
    def more(f, inflate, most: int, end: int) -> bytes:
        data = inflate.unconsumed_tail or f.read(min(1 << 16, end - f.tell()))
        if not data:
            raise ValueError("a record ends early")
        return inflate.decompress(data, most)


class WarcSource(DataSource):
    """Format ``warc``. Options: path; payloads (false: none are inflated); file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)), self.options.get("payloads", "true") == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and turn on the push-down of filters that it needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive_records(pages: DataFrame) -> DataFrame:
    """A record for each row of ``pages``, in the columns of the format.

    Of rows with equal payloads of at least LEAST_BYTES bytes, that with the
    smallest page_id is the response and the others revisit it; all others are
    responses. A null html is an empty payload. A null page_id is larger than any:
    where no row of a group has an id, all are responses; rows that repeat page_id
    and payload of a response are responses as well. Payloads that occur once find
    no partner in the join; those that occur often are a skewed join.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("target_uri"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.length("payload").cast("bigint"))
    groups = rows.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    joined = rows.join(groups.where("n > 1").drop("n"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), "payload_bytes",
        F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    register(pages.sparkSession)
    archive_records(pages).write.format("warc").option("file_bytes", file_bytes).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)


def page_of(record_id: str) -> Column:
    """The page_id in a record's name; null if it had none."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")


def round_trip(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` to ``path`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are measured on the payload that was read; of revisits only the
    headers are. Repeated rows stay; other columns are ignored; an empty table
    gives an empty result.
    """
    spark = pages.sparkSession
    write_archives(pages, path, file_bytes)
    responses = read_archives(spark, path).where("record_type = 'response'").select(
        page_of("record_id").alias("page_id"), F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", page_of("refers_to").alias("refers_to"),
    )
    revisits = read_archives(spark, path, payloads=False).where("record_type = 'revisit'").select(
        page_of("record_id").alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type", page_of("refers_to").alias("refers_to"),
    )
    return responses.union(revisits)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to an archive and read back."""
    return round_trip(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))


ORACLE = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha256(coalesce(html, '')) AS d FROM pages
), g AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN b >= {LEAST_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= {LEAST_BYTES} AND page_id <> first THEN first END AS refers_to
FROM g
"""
