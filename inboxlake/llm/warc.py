"""WARC archives as a PySpark Python data source.

Writing: one gzip member per record with the skip-length extra field (compressed and plain size), so a reader can jump
over a member without inflating it.  Every task writes files of about FILE_BYTES under names of its own; the commit
writes a manifest, a line for each file that belongs to the table, so a retried or lost task leaves nothing in the
result.  Reading: a partition is one or more whole files of about SPLIT_BYTES together; filters on record_type and the
header columns are pushed down; of each member only the headers are inflated first, and the payload only for records
that pass and only if payloads are wanted.  A folder without manifest is read as any crawl's: its .warc and .warc.gz
files, whose gzip members have no lengths, so unwanted payloads are inflated piece by piece and thrown away.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In,
                                    InputPartition, WriterCommitMessage)

from ..session import ship_package
from . import common

SCHEMA = ("page_id long, target_uri string, record_type string, refers_to long, payload_digest string, "
          "payload_bytes long, payload binary")
#: Compressed bytes of an archive file, of a partition at most, and of a partition of a small table, about.
FILE_BYTES, SPLIT_BYTES, LEAST_BYTES = 128 << 20, 128 << 20, 4 << 20
#: A payload of more than 1/HOT_SHARE of all pages (and of HOT_ROWS) is joined by broadcast: HOT_SHARE rows at most.
HOT_SHARE, HOT_ROWS = 10_000, 1000
MANIFEST = "_MANIFEST.tsv"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIXED = struct.Struct("<2sBBIBBH2sHII")  # gzip header with one extra field: SL, 8 bytes
_HEAD_BYTES = 1 << 10


def filesystem(path: str):
    """(file system, path in it) of a path or URI of the shared folder."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if "://" in path else path)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digest_column(sha1_hex: Column) -> Column:
    """The same of a hexadecimal SHA-1, as SQL: 40 bits at a time are eight digits of base 32."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(sha1_hex, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def member(data: bytes) -> bytes:
    """A gzip member with its sizes in the extra field."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = _FIXED.size + len(body) + 8
    return (_FIXED.pack(b"\x1f\x8b", 8, 4, 0, 0, 255, 12, b"sl", 8, size, len(data)) + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def _clean(value: str) -> str:
    """A header value: line ends would begin another field."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _raw(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, uri: str | None, refers_to: int | None, payload_digest: str, payload_bytes: int,
           payload: bytes | None) -> bytes:
    """A response record, or a revisit (headers only) where ``payload`` is None."""
    revisit = payload is None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    fields = [("WARC-Type", "revisit" if revisit else "response"),
              ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
              ("WARC-Date", "1970-01-01T00:00:00Z"),
              ("WARC-Target-URI", None if uri is None else _clean(uri)),
              ("X-Page-Id", page_id),
              ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
              ("X-Payload-Length", payload_bytes)]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("X-Refers-To-Page", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"),
               ("Content-Length", len(http) + len(payload or b""))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + http + (payload or b"") + b"\r\n\r\n"


def parse_head(head: bytes) -> dict:
    """The columns that the headers of a record give; of another writer's records those that they have.

    Names count without case, a line that begins with white space goes on with the one before.
    """
    lines = head.decode(errors="replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")[1:]
    fields = {k.strip().lower(): v.removeprefix(" ") for k, sep, v in (line.partition(":") for line in lines) if sep}
    number = lambda k: int(fields[k]) if k in fields else None
    uri, sha = fields.get("warc-target-uri"), fields.get("warc-payload-digest")
    return {"page_id": number("x-page-id"),
            "target_uri": None if uri is None else _raw(uri) if "x-payload-length" in fields else uri.strip().strip("<>"),
            "record_type": fields["warc-type"].strip() if "warc-type" in fields else None, "refers_to": number("x-refers-to-page"),
            "payload_digest": None if sha is None else sha.strip().removeprefix("sha1:"),
            "payload_bytes": number("x-payload-length"), "block_bytes": number("content-length") or 0,
            "http": fields.get("content-type", "").strip().startswith("application/http")}


class _Inflate:
    """Inflates a member as far as asked."""

    def __init__(self, body: bytes):
        self.z, self.out = zlib.decompressobj(-15), b""
        self.rest = body

    def head(self) -> bytes:
        """The headers, or what there is of them where the given bytes end before."""
        while b"\r\n\r\n" not in self.out:
            more = self.z.decompress(self.rest, _HEAD_BYTES)
            self.out += more
            self.rest = self.z.unconsumed_tail
            if not more and not self.rest:
                break
        return self.out.split(b"\r\n\r\n", 1)[0]

    def payload(self) -> bytes:
        block = (self.out + self.z.decompress(self.rest)).split(b"\r\n\r\n", 1)[1]
        return block.split(b"\r\n\r\n", 1)[1][:-4]


class Members:
    """Records of an archive of any origin, one after another; bytes are inflated (or read, if plain) as needed."""

    STEP = 1 << 16

    def __init__(self, f, compressed: bool):
        self.f, self.z, self.out, self.raw = f, None, b"", b""
        self.compressed = compressed

    def _more(self) -> bool:
        """Inflates a bounded piece more; whether there was any."""
        if not self.compressed:
            piece = self.f.read(self.STEP)
            self.out += piece
            return bool(piece)
        while True:
            self.raw = self.raw or self.f.read(self.STEP)
            if self.z is None or self.z.eof:
                if not self.raw:
                    return False
                self.z = zlib.decompressobj(31)
            before = len(self.raw)
            piece = self.z.decompress(self.raw, self.STEP)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.out += piece
            if piece:
                return True
            if not self.z.eof and not self.raw and before == 0:
                return False  # a file that ends within a member

    def head(self) -> bytes | None:
        """Headers of the next record, None at the end."""
        while True:
            self.out = self.out.lstrip(b"\r\n")
            end = self.out.find(b"\r\n\r\n")
            if end >= 0:
                head, self.out = self.out[:end], self.out[end + 4:]
                return head
            if not self._more():
                return None

    def block(self, size: int, keep: bool) -> bytes:
        """The next ``size`` bytes; not kept ones are thrown away as they come."""
        parts = []
        while True:
            piece, self.out = self.out[:size], self.out[size:]
            size -= len(piece)
            if keep:
                parts.append(piece)
            if not size or not self._more():
                return b"".join(parts)


@dataclass
class Written(WriterCommitMessage):
    """Archive files of a task: (name, bytes)."""

    files: list


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of SCHEMA: a revisit where record_type says so, else a response with its payload."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files: list = []
        out, size = None, 0
        for batch in iterator:
            names = batch.schema.names
            for at in range(batch.num_rows):  # a row at a time: no second copy of a batch of payloads
                r = {k: batch.column(i)[at].as_py() for i, k in enumerate(names)}
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                        files[-1][1] = size
                    files.append([f"{uuid.uuid4().hex}.warc.gz", 0])
                    out, size = fs.open_output_stream(posixpath.join(root, files[-1][0]), compression=None), 0
                payload = None if r["record_type"] == "revisit" else r["payload"] or b""
                data = member(record(r["page_id"], r["target_uri"], r["refers_to"], r["payload_digest"],
                                     r["payload_bytes"], payload))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            files[-1][1] = size
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(posixpath.join(root, MANIFEST), compression=None) as f:
            for m in messages:
                for name, size in m.files if m else ():
                    f.write(f"{name}\t{size}\n".encode())

    def abort(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(posixpath.join(root, name))


@dataclass
class Archives(InputPartition):
    """Whole archive files: paths and whether they have lengths of their members."""

    paths: list
    own: bool


class WarcReader(DataSourceReader):
    """Reads the archives of a folder, or one archive; option ``payload``: false leaves payloads undecoded (null)."""

    _HEADERS = {"page_id", "target_uri", "record_type", "refers_to", "payload_digest"}

    def __init__(self, path: str, payload: bool, parallelism: int = 1):
        self.path, self.payload, self.parallelism = path, payload, parallelism
        self.wanted: list[tuple[str, set]] = []

    def pushFilters(self, filters: list[Filter]):
        """Takes equality and membership on header columns (a null equals nothing); the rest is left to Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in self._HEADERS:
                self.wanted.append((name, set(f.value if isinstance(f, In) else [f.value]) - {None}))
            else:
                yield f

    def files(self) -> tuple[list[tuple[str, int]], bool]:
        """(path, bytes) of the archives, and whether a manifest names them."""
        from pyarrow.fs import FileSelector, FileType
        fs, root = filesystem(self.path)
        if fs.get_file_info(posixpath.join(root, MANIFEST)).type == FileType.File:
            with fs.open_input_stream(posixpath.join(root, MANIFEST), compression=None) as f:
                lines = [line.split("\t") for line in f.read().decode().splitlines()]
            return [(posixpath.join(root, name), int(size)) for name, size in lines], True
        info = fs.get_file_info(root)
        found = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(root, recursive=True))
        return sorted((i.path, i.size) for i in found if i.path.endswith((".warc", ".warc.gz"))), False

    def partitions(self) -> list[Archives]:
        files, own = self.files()
        target = min(SPLIT_BYTES, max(LEAST_BYTES, sum(n for _, n in files) // max(1, self.parallelism)))
        groups, held = [], target
        for path, size in files:
            if held + size > target:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [Archives(g, own) for g in groups] or [Archives([], own)]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                for row in self._own(f) if partition.own else self._foreign(f, path.endswith(".gz")):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _rejects(self, row: dict) -> bool:
        return any(row[k] not in values for k, values in self.wanted)

    def _own(self, f) -> Iterator[dict]:
        """Records of an archive whose members tell their length: what isn't wanted is jumped over."""
        at, end = 0, f.size()
        while at < end:
            f.seek(at)
            start = f.read(_FIXED.size + _HEAD_BYTES)
            size = _FIXED.unpack(start[:_FIXED.size])[-2]
            row = self._row(start, size, f)
            at += size
            if row:
                yield row

    def _foreign(self, f, compressed: bool) -> Iterator[dict]:
        """Records of an archive of another writer."""
        members = Members(f, compressed)
        while (head := members.head()) is not None:
            row = parse_head(head)
            kind, size = row["record_type"], row.pop("block_bytes")
            rejected = self._rejects(row)
            wanted = self.payload and not rejected and kind in ("response", "resource", "conversion")
            block = members.block(size, wanted)
            if rejected:
                continue
            row["payload"] = None
            if wanted:
                http = row.pop("http")
                row["payload"] = block.split(b"\r\n\r\n", 1)[-1] if http and b"\r\n\r\n" in block else b"" if http else block
                row["payload_bytes"] = len(row["payload"])
            yield row

    def _row(self, start: bytes, size: int, f) -> dict | None:
        """The record whose member begins with ``start``, or None if a pushed filter rejects it."""
        inflate = _Inflate(start[_FIXED.size:size])
        head = inflate.head()
        if b"\r\n\r\n" not in inflate.out:  # long headers: take the whole member
            inflate = _Inflate(start[_FIXED.size:] + f.read(size - len(start)))
            head, start = inflate.head(), b"\0" * size
        row = parse_head(head)
        if self._rejects(row):
            return None
        row["payload"] = None
        if self.payload and row["record_type"] == "response":
            if size > len(start):
                inflate.rest += f.read(size - len(start))
            row["payload"] = inflate.payload()
        return row


def _batch(rows: list[dict]) -> pa.RecordBatch:
    types = {"page_id": pa.int64(), "target_uri": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
             "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in types.items()})


class WarcSource(DataSource):
    """Format ``warc`` over a folder in the shared store."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false",
                          int(self.options.get("parallelism", "1")))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html) to archives under ``path``.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is the response
    and the others revisit it; smaller ones are all responses.  Who revisits whom is found on ids and digests alone,
    so a payload that a third of all pages share moves no page text; the texts are joined by page.  A null html is an
    empty payload; a null page_id is smaller than any other; rows equal in page_id and payload are all responses or
    all revisits.  An empty table gives archives without records.  Other columns are ignored.
    """
    spark = pages.sparkSession
    ship_package(spark)
    spark.dataSource.register(WarcSource)
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"),
                        body.alias("payload"))
    ids = common.stored(rows.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n"))
                        .where(F.col("n") >= min_bytes).select("page_id", "sha"), "warc-ids")
    last = (ids.groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies"))
            .where("copies > 1"))
    hot_rows = max(HOT_ROWS, ids.count() // HOT_SHARE)
    hot = common.stored(last.where(F.col("copies") > hot_rows).select("sha", "last"), "warc-hot")
    rest = ids.join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(last.where(F.col("copies") <= hot_rows), "sha")
    revisits = (ids.join(F.broadcast(hot), "sha").unionByName(rest.select("sha", "page_id", "last"))
                .where(~F.col("page_id").eqNullSafe(F.col("last")))
                .select(F.col("page_id").alias("__id"), F.col("sha").alias("__sha"), F.col("last").alias("refers_to"),
                        F.lit(True).alias("__revisit")).distinct())
    typed = (rows.withColumn("sha", F.sha1("payload"))
             .join(revisits, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha")), "left"))
    revisit = F.coalesce("__revisit", F.lit(False))
    typed.select(
        "page_id", "target_uri", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        "refers_to", digest_column(F.col("sha")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload")).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives under ``path`` (columns of SCHEMA; payload null if not asked for).

    Archives of ``write_pages`` are read by their manifest; without one, all .warc and .warc.gz files of any writer
    below ``path`` (or that file): page_id and refers_to are null there, payload_bytes is known where the payload is
    decoded.  Revisits, requests and other records without content of their own have a null payload.
    """
    ship_package(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return (spark.read.format("warc").option("payload", str(payload).lower())
            .option("parallelism", str(spark.sparkContext.defaultParallelism)).load(path))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written and read back; responses are measured on the payload that was read."""
    path = common.scratch(spark, "warc")
    write_pages(common.table(spark, sf_dir, "pages"), path)
    measured = lambda of, header: F.when(F.col("payload").isNull(), F.col(header)).otherwise(of)
    return read_archives(spark, path).select(
        "page_id", measured(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        measured(digest_column(F.sha1("payload")), "payload_digest").alias("payload_digest"), "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x FROM p),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
  (((strpos('0123456789abcdef', substr(x, 5 * k // 4 + 1, 1)) - 1) * 16
    + strpos('0123456789abcdef', substr(x, 5 * k // 4 + 2, 1)) - 1) >> (3 - 5 * k % 4)) % 32, 1)), '') AS d,
  max(page_id) OVER (PARTITION BY x) AS last FROM s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM b
"""
