"""WARC files as a Python data source: ``spark.read.format("warc")`` and back.

Reading plans one partition per group of files (small files share one).  A
record's headers are parsed first; pushed predicates on headers decide whether
its payload is decoded or skipped.  Each record is a gzip member of its own
that states its length in the ``sl`` extra field, so a skipped record costs a
seek and the few kilobytes that hold its headers.  Plain ``.warc`` files and
members without that field are read too.

Writing gives one file per task under a temporary name; only the files of
tasks that Spark commits get their final names, so lost executors and repeated
attempts leave nothing behind.

Files are opened by pyarrow's filesystems (local, HDFS, S3, GCS) on workers.

Defined cases: a null payload is written as an empty one; a record without a
header has null in its column; headers are matched in any case, and the last
of repeated ones counts; records of unknown types are returned like any other;
an empty folder has no rows, and an empty table writes no archive.  Records
with equal ids or payloads are records of their own.  A long payload is held
whole, one record at a time.  Pages' other columns are not read, so their
names don't matter.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo,
                                    Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage)

from ..session import scratch_path, ship_package
from .tables import land

SCHEMA = ("record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, "
          "refers_to string, headers map<string,string>, payload binary")
ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
                   ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()),
                   ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
#: Columns that are known once the headers are, and can carry a pushed predicate.
HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")
PARTITION_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
DATE = "2025-01-01T00:00:00Z"
LEAST_REVISIT = 100


# ---- files ------------------------------------------------------------------

def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def warc_files(path: str) -> list[tuple[str, int]]:
    fs, inner = filesystem(path)
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=True, allow_not_found=True))
    if not found and fs.get_file_info(inner).type == pafs.FileType.File:
        found = [fs.get_file_info(inner)]
    hidden = re.compile(r"(^|/)[_.]")
    return sorted((i.path, i.size) for i in found if i.type == pafs.FileType.File
                  and not hidden.search(i.path[len(inner):]) and i.path.endswith((".warc", ".warc.gz")))


# ---- records ----------------------------------------------------------------

def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member with its own length and that of ``data`` in an ``sl`` field."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body) + len(tail)
    if max(size, len(data)) >> 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, size, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def record(fields: dict[str, str | None], http: dict[str, str] | None, payload: bytes) -> bytes:
    block = payload
    if http is not None:
        lines = "".join(f"{k}: {v}\r\n" for k, v in http.items())
        block = f"HTTP/1.1 200 OK\r\n{lines}\r\n".encode() + payload
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


class _Plain:
    """Records of an uncompressed file."""

    def __init__(self, file) -> None:
        self.file, self.at, self.size = file, 0, file.size()

    def __iter__(self) -> Iterator[tuple[bytes, object]]:
        while self.at < self.size:
            head = b""
            while b"\r\n\r\n" not in head and self.at + len(head) < self.size:
                self.file.seek(self.at + len(head))
                head += self.file.read(4096)
            head, _, _ = head.partition(b"\r\n\r\n")
            begin = self.at + len(head) + 4
            size = int(parse_headers(head).get("content-length", 0))

            def block(begin=begin, size=size) -> bytes:
                self.file.seek(begin)
                return self.file.read(size)
            yield head, block
            self.at = begin + size
            while self.at < self.size:
                self.file.seek(self.at)
                if self.file.read(1) not in (b"\r", b"\n"):
                    break
                self.at += 1


class _Members:
    """Records of a file of gzip members."""

    def __init__(self, file) -> None:
        self.file, self.size = file, file.size()

    def _length(self, at: int) -> int | None:
        self.file.seek(at)
        start = self.file.read(24)
        if len(start) >= 24 and start[3] & 4 and start[12:14] == b"sl":
            return struct.unpack("<I", start[16:20])[0]
        return None

    def __iter__(self) -> Iterator[tuple[bytes, object]]:
        at = 0
        while at < self.size:
            length = self._length(at)
            self.file.seek(at)
            raw = self.file.read(min(length or 1 << 16, 4096))
            unzip = zlib.decompressobj(31)
            data = unzip.decompress(raw, 1 << 14)
            read = len(raw)
            while b"\r\n\r\n" not in data and not unzip.eof:
                more = unzip.unconsumed_tail
                if not more:
                    more = self.file.read(4096)
                    read += len(more)
                    if not more:
                        raise ValueError("a WARC member ends within its headers")
                data += unzip.decompress(more, 1 << 14)
            head, _, rest = data.partition(b"\r\n\r\n")
            state = {"unzip": unzip, "rest": rest, "read": read, "done": False}

            def block(at=at, state=state, head=head) -> bytes:
                self._finish(at, state)
                return state["rest"][:int(parse_headers(head).get("content-length", 0))]
            yield head, block
            if length is None:
                self._finish(at, state)
                at += state["read"] - len(state["unzip"].unused_data)
            else:
                at += length

    def _finish(self, at: int, state: dict) -> None:
        """Decode what is left of the member."""
        if state["done"]:
            return
        unzip, parts = state["unzip"], [state["rest"]]
        if unzip.unconsumed_tail:
            parts.append(unzip.decompress(unzip.unconsumed_tail))
        self.file.seek(at + state["read"])
        while not unzip.eof:
            more = self.file.read(1 << 18)
            if not more:
                raise ValueError("a WARC member is cut off")
            state["read"] += len(more)
            parts.append(unzip.decompress(more))
        state["rest"], state["done"] = b"".join(parts), True


def _records(file) -> Iterator[tuple[bytes, object]]:
    magic = file.read(2)
    file.seek(0)
    return iter(_Members(file) if magic == b"\x1f\x8b" else _Plain(file))


def _payload(headers: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """Payload of a block and the length that its protocol headers state."""
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return block, len(block)
    head, _, payload = block.partition(b"\r\n\r\n")
    stated = parse_headers(head).get("content-length")
    return payload, int(stated) if stated and stated.isdigit() else len(payload)


# ---- data source ------------------------------------------------------------

def _matches(f: Filter, row: dict) -> bool:
    value = row[f.attribute[0]]
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    return True


@dataclass
class Files(InputPartition):
    paths: Sequence[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.decode = options.get("payload", "true").lower() != "false"
        self.target = int(options.get("partitionbytes", PARTITION_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull, StringStartsWith)) \
                    and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        groups: list[list[str]] = []
        size = 0
        for path, n in warc_files(self.path):
            if not groups or size + n > self.target:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        rows: list[dict] = []
        held = 0
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for head, block in _records(file):
                    h = parse_headers(head)
                    digest = h.get("warc-payload-digest")
                    row = {"record_id": h.get("warc-record-id"), "record_type": h.get("warc-type"),
                           "target_uri": h.get("warc-target-uri"),
                           "payload_digest": digest.rpartition(":")[2] if digest else None,
                           "refers_to": h.get("warc-refers-to")}
                    if not all(_matches(f, row) for f in self.filters):
                        continue
                    row["headers"] = list(h.items())
                    if self.decode:
                        data = block()
                        payload, row["payload_bytes"] = _payload(h, data)
                        row["payload"] = None if row["record_type"] == "revisit" else payload
                        held += len(data)
                    held += len(head)
                    rows.append(row)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


@dataclass
class Written(WriterCommitMessage):
    """A task's file; no name if it had no rows."""

    temporary: str | None
    final: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.level = int(options.get("level", 1))
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, inner = filesystem(self.path)
        name = f"{self.job}-{uuid.uuid4().hex[:12]}.warc.gz"
        temporary, out = f"{inner}/_temporary-{self.job}/{name}", None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(f"{inner}/_temporary-{self.job}", recursive=True)
                    out = fs.open_output_stream(temporary, compression=None)
                out.write(member(self._record(row), self.level))
        if out is None:
            return Written(None, None)
        out.close()
        return Written(temporary, f"{inner}/{name}")

    @staticmethod
    def _record(row: dict) -> bytes:
        payload = bytes(row["payload"] or b"")
        stated = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
        fields = {"WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": DATE,
                  "WARC-Target-URI": row["target_uri"],
                  "WARC-Payload-Digest": f"sha256:{row['payload_digest']}" if row["payload_digest"] else None,
                  "WARC-Refers-To": row["refers_to"],
                  "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                  if row["record_type"] == "revisit" else None,
                  "Content-Type": "application/http;msgtype=response"}
        http = {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(stated)}
        return record({k: re.sub(r"[\r\n]+", " ", v) if v else v for k, v in fields.items()}, http, payload)

    def commit(self, messages: list[Written | None]) -> None:
        fs, inner = filesystem(self.path)
        if self.overwrite:
            for path, _ in warc_files(self.path):
                fs.delete_file(path)
        for m in messages:
            if m is not None and m.temporary:
                fs.move(m.temporary, m.final)
        self._clean(fs, inner)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*filesystem(self.path))

    def _clean(self, fs: pafs.FileSystem, inner: str) -> None:
        folder = f"{inner}/_temporary-{self.job}"
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class WarcDataSource(DataSource):
    """Options: ``path``; reading: ``payload`` (false: headers only),
    ``partitionBytes``; writing: ``level`` (gzip)."""

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
    ship_package(spark)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---- pages ------------------------------------------------------------------

def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 least: int = LEAST_REVISIT) -> DataFrame:
    """A record per page, in the schema of the source.

    Of equal payloads of at least ``least`` bytes the page with the least id is
    the response and the others revisit it.  Payloads are equal if their
    SHA-256 digests are.  The choice is made on ids and digests alone; texts
    cross one exchange, by page, which no group of copies can share.  Rows that
    repeat the least id with the same payload are responses too; a null id is
    never the least beside others.
    """
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("target_uri"),
                        html.alias("payload"), F.sha2(html, 256).alias("payload_digest"),
                        F.octet_length(html).cast("long").alias("payload_bytes"))
    keys = land(rows.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest"), "warc-keys")
    first = keys.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")) \
                .where("n > 1").select("payload_digest", "first")
    again = (keys.join(first, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
             .select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "first").distinct())
    joined = rows.join(again, rows["page_id"].eqNullSafe(again["_id"])
                       & (rows["payload_digest"] == again["_digest"]), "left")
    revisit = F.col("first").isNotNull()
    return joined.select(
        record_id(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", "payload_digest",
        "payload_bytes", F.when(revisit, record_id(F.col("first"))).alias("refers_to"),
        F.lit(None).cast("map<string,string>").alias("headers"), F.when(~revisit, F.col("payload")).alias("payload"))


def record_id(page: F.Column) -> F.Column:
    """A record's id from a page's, of any type; nothing stands for null, ``%`` for an empty string."""
    text = F.url_encode(page.cast("string"))     # no bracket or line break gets into a header
    return F.concat(F.lit("<urn:x-page:"), F.when(text == "", F.lit("%")).otherwise(F.coalesce(text, F.lit(""))), F.lit(">"))


def page_of(column: str, kind: str = "long") -> F.Column:
    """The page of a record id (null if it names none), as a ``kind``."""
    text = F.regexp_extract(column, "^<urn:x-page:(.+)>$", 1)     # no match: empty
    page = F.when(text == "%", F.lit("")).when(text != "", F.try_url_decode(text))
    return page.try_cast(kind)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives under ``spark.checkpoint.dir`` and read them back."""
    spark = pages.sparkSession
    register(spark)
    path = scratch_path(spark, "warc")
    page_records(pages).write.format("warc").mode("append").save(path)
    return spark.read.format("warc").load(path)
