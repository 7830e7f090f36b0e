"""Media columns: archives of images, and a Spark data source that reads their members by byte range.

Writing: each task packs its documents' payloads as 8-bit grey PNG images, 64 samples wide, into ZIP archives in the
shared folder; the manifest, a table of the archives that Spark committed, names those that count, so archives of
failed or repeated tasks are never read.

Reading: the data source plans partitions as byte ranges over the archives of a directory or a manifest. A task
reads the directory of its archive, streams the members that begin in its range, and hands them on as Arrow batches
of bounded size. A member that can't be read is tried again by itself, from its offset, on a newly opened file.

Files are opened through pyarrow's file systems, by URI.

Defined results: null text is the empty text, whose payload is 64 zero bytes; long texts are one member each; equal
rows are members of their own; an empty table gives no archive and an empty result; a null id stays null; other
columns aren't read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import fresh_path, materialize, table

WIDTH = 64
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
TRIES = 4
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(text: bytes) -> bytes:
    """The text, padded with zeros to a positive multiple of WIDTH, as an 8-bit grey image that tells its length."""
    height = max(1, -(-len(text) // WIDTH))
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # each row begins with filter 0
    rows[:, 1:] = np.frombuffer(text.ljust(height * WIDTH, b"\0"), np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"bytes\0%d" % len(text)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int]:
    """The samples, and the length before padding."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not an image")
    at, parts, size, width = len(SIGNATURE), [], 0, 0
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("an image chunk is damaged")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"tEXt":
            size = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, width + 1)
    return rows[:, 1:].tobytes(), size


class Archive:
    """A ZIP archive written to a stream, members stored as they are."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.zip"
        system, path = opened(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.members = self.bytes = 0

    def add(self, name: str, data: bytes) -> None:
        self.zip.writestr(zipfile.ZipInfo(name), data)
        self.members += 1
        self.bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        self.zip.close()
        size = self.stream.tell()
        self.stream.close()
        return self.uri, size, self.members


def write_archives(docs: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """Write every text as a member `<id>/<number>.png`; rows (archive, bytes, members), which become the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done, n = None, [], 0
        for batch in batches:
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                archive = archive or Archive(folder)
                archive.add(f"{'' if own is None else own}/{n}.png", to_png(value.as_py() or b""))
                n += 1
                if archive.bytes >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "bytes", "members"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "archive string, bytes long, members long")


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.manifest, self.path = options.get("manifest"), options.get("path")
        self.range = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def archives(self) -> list[tuple[str, int]]:
        system, path = opened(self.manifest or self.path)
        if self.manifest:
            import pyarrow.dataset as ds

            files = [f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.path.endswith(".parquet")]
            rows = ds.dataset(files, filesystem=system, format="parquet").to_table(["archive", "bytes"]).to_pylist() if files else []
            return sorted((r["archive"], r["bytes"]) for r in rows)
        head = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return sorted((head + f.path, f.size) for f in found if f.path.endswith(".zip"))

    def partitions(self) -> list[ByteRange]:
        out = [ByteRange(uri, a, min(a + self.range, size)) for uri, size in self.archives() for a in range(0, size, self.range)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        rows: list[tuple] = []
        held = 0
        for name, offset, data in members(partition.archive, partition.start, partition.end):
            rows.append((partition.archive, name, offset, data))
            held += len(data)
            if held >= BATCH_BYTES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["archive", "member", "offset", "data"])


def retried(step, tries: int = TRIES):
    for k in range(tries):
        try:
            return step()
        except (OSError, zipfile.BadZipFile, zlib.error):
            if k + 1 == tries:
                raise
            time.sleep(0.2 * 2**k)


def directory(uri: str) -> list[zipfile.ZipInfo]:
    system, path = opened(uri)
    with system.open_input_file(path) as f, zipfile.ZipFile(io.BufferedReader(f, 1 << 16)) as z:
        return z.infolist()


def members(uri: str, start: int, end: int, open_file=None) -> Iterator[tuple[str, int, bytes]]:
    """(name, offset, data) of the members that begin in the range."""
    system, path = opened(uri)
    open_file = open_file or (lambda: system.open_input_file(path))
    files: list = []

    def fetch(entry: zipfile.ZipInfo) -> bytes:
        try:
            if not files:
                files.append(open_file())
            f = files[0]
            f.seek(entry.header_offset)
            head = f.read(30)
            name, extra = struct.unpack("<HH", head[26:30])
            f.seek(entry.header_offset + 30 + name + extra)
            data = f.read(entry.compress_size)
            if len(data) != entry.compress_size or zlib.crc32(data) != entry.CRC:
                raise OSError(f"{entry.filename} at {entry.header_offset} is damaged")
            return data
        except OSError:
            while files:
                files.pop().close()
            raise

    for entry in sorted(retried(lambda: directory(uri)), key=lambda e: e.header_offset):
        if start <= entry.header_offset < end:
            yield entry.filename, entry.header_offset, retried(lambda: fetch(entry))
    while files:
        files.pop().close()


class ArchiveSource(DataSource):
    """format("archive_members"): options path (a directory) or manifest, and rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, member string, offset long, data binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an image and read it back: rows (archive, member, offset, data)."""
    spark = docs.sparkSession
    manifest = materialize(write_archives(docs, fresh_path(spark, "archives"), id_col, text_col), "manifest")
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive_members").option("manifest", manifest._shared_path).load()


def features(payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256, dtype=np.int64)
    return f"rows={len(x) // WIDTH};sum={int(counts @ values)};squares={int(counts @ (values * values))};distinct={int((counts > 0).sum())};high={int(counts[128:].sum())}"


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), all as read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = value.as_py()
                payload, size = from_png(data)
                own = name.partition("/")[0]
                rows.append((int(own) if own else None, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(payload)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    stored = media_table(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text")
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("member", "data").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op6_media": op6_media}
SQL: dict[str, str] = {}
