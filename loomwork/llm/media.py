"""Media columns: the members of archives as rows, by a Spark data source.

``ArchiveMembers`` reads folders of ZIP archives. Planning lists files, or the manifest that
``write_archives`` keeps, and cuts their sizes into byte ranges; it opens no archive, so a folder of any
size is planned from its listing. A task reads the directory at the end of its archive, once for all the
ranges that come to its process, and takes the members whose headers lie in its range, in order of
offset, and streams them as Arrow batches bounded in rows and bytes. Every member is read on its own by
its offset: a failure is tried again from a fresh handle, and a member that keeps failing becomes a row
with the error while its neighbours go on. A member over ``chunkBytes`` comes as several rows, numbered
by ``part``: it is checked in a first pass, so that no part of a broken member comes out, and then
streamed, so that a member of any size takes the memory of one part.

``write_archives`` packs payloads into such archives. Each is written under a name of its attempt's own,
and only those of the attempts that Spark committed are in the manifest. Folders may be mounted or any
that Arrow's file systems know; others raise.

Defined cases: an archive that can't be opened gives one row of status ``archive_failed``; an empty
archive or folder gives no rows; members of no bytes have an empty payload; members that share a name
are separate rows, told apart by offset; very long payloads are written and read like others. When
writing, a null payload makes no member, a null key is named ``null``, repeated rows make a member each,
and columns beside the two are never read.
"""

from __future__ import annotations

import functools
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ._io import opened, shared_path, table

#: Bytes of a byte range; bounds of a batch; tries of a member; bytes of an archive when writing; bytes
#: of a payload in one row.
RANGE_BYTES, BATCH_BYTES, BATCH_ROWS, TRIES, ARCHIVE_BYTES, CHUNK_BYTES = 8 << 20, 4 << 20, 1000, 3, 64 << 20, 64 << 20
_SCHEMA = "archive string, member string, offset long, size long, part int, parts int, media_type string, status string, error string, content binary"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("media_type", pa.string()), ("status", pa.string()), ("error", pa.string()), ("content", pa.binary())])
_MANIFEST = "archive string, n_members long, n_bytes long"
_MAGIC = [
    (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"%PDF-", "application/pdf"), (b"PK\x03\x04", "application/zip"),
    (b"OggS", "audio/ogg"), (b"ID3", "audio/mpeg"), (b"fLaC", "audio/flac"), (b"\x1f\x8b", "application/gzip"),
]


def media_type(content: bytes) -> str:
    """The type that a payload's first bytes show."""
    for magic, kind in _MAGIC:
        if content.startswith(magic):
            return kind
    if content[:4] == b"RIFF":
        return {b"WEBP": "image/webp", b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo"}.get(content[8:12], "application/octet-stream")
    if content[4:8] == b"ftyp":
        return "video/mp4"
    head = content[:256].lstrip().lower()
    if head.startswith((b"<!doctype html", b"<html")):
        return "text/html"
    return "application/octet-stream" if b"\0" in head else "text/plain"


@dataclass
class ByteRange(InputPartition):
    archive: str
    size: int
    start: int
    end: int


@functools.lru_cache(maxsize=2)
def directory(path: str, size: int) -> list[zipfile.ZipInfo]:
    """An archive's members; read once for the ranges that a process works on in turn."""
    where, at = opened(path)
    with where.open_input_file(at) as file, zipfile.ZipFile(file) as whole:
        return sorted((m for m in whole.infolist() if not m.is_dir()), key=lambda m: m.header_offset)


def read_member(path: str, info: zipfile.ZipInfo, piece: int = 1 << 20) -> Iterator[bytes]:
    """A member's payload from its own offset, in pieces; raises after the last one if its checksum is wrong."""
    if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError("encrypted, or packed in a way that isn't supported")
    where, at = opened(path)
    with where.open_input_file(at) as file:
        file.seek(info.header_offset)
        header = file.read(30)
        if len(header) < 30 or header[:4] != b"PK\x03\x04":
            raise ValueError("no member header at the offset")
        name, extra = struct.unpack("<HH", header[26:30])
        file.seek(info.header_offset + 30 + name + extra)
        left, size, crc = info.compress_size, 0, 0
        unpack = zlib.decompressobj(-15) if info.compress_type == zipfile.ZIP_DEFLATED else None
        while left:
            packed = file.read(min(piece, left))
            if not packed:
                raise ValueError("the archive ends within the member")
            left -= len(packed)
            while packed:
                data = unpack.decompress(packed, piece) if unpack else packed
                packed = unpack.unconsumed_tail if unpack else b""
                size, crc = size + len(data), zlib.crc32(data, crc)
                yield data
        if unpack and (data := unpack.flush()):
            size, crc = size + len(data), zlib.crc32(data, crc)
            yield data
    if size != info.file_size or crc != info.CRC:
        raise ValueError("the payload's checksum is wrong")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.manifest = options["path"].rstrip("/"), options.get("manifest")
        self.range_bytes, self.chunk = int(options.get("rangeBytes", RANGE_BYTES)), int(options.get("chunkBytes", CHUNK_BYTES))
        self.batch_bytes, self.batch_rows = int(options.get("batchBytes", BATCH_BYTES)), int(options.get("batchRows", BATCH_ROWS))
        self.tries, self.wait = int(options.get("tries", TRIES)), float(options.get("waitSeconds", 0.1))

    def partitions(self) -> list[ByteRange]:
        if self.manifest:
            where, at = opened(self.manifest)
            rows = pyarrow.parquet.read_table(at, filesystem=where, columns=["archive", "n_bytes"])
            files = sorted(zip(rows.column("archive").to_pylist(), rows.column("n_bytes").to_pylist()))
        else:
            where, at = opened(self.path)
            found = where.get_file_info(fs.FileSelector(at, recursive=True))
            files = sorted((f.path[len(at.rstrip("/")) + 1 :], f.size) for f in found if f.path.endswith(".zip"))
        ranges = [ByteRange(name, size, a, min(a + self.range_bytes, size)) for name, size in files for a in range(0, max(1, size), self.range_bytes)]
        return ranges or [ByteRange("", 0, 0, 0)]

    def _again(self, what):
        """What a call gives that may be tried again, and why not if it gives nothing."""
        for k in range(self.tries):
            try:
                return what(), None
            except (OSError, ValueError, zlib.error) as error:
                why = f"{type(error).__name__}: {error}"
                if k + 1 < self.tries:
                    time.sleep(self.wait * 2**k)
        return None, why

    def _chunk(self, path: str, info: zipfile.ZipInfo, part: int) -> bytes:
        """One part of a member that was checked."""
        begin, at, out = part * self.chunk, 0, []
        for piece in read_member(path, info):
            if at + len(piece) > begin and at < begin + self.chunk:
                out.append(piece[max(0, begin - at) : begin + self.chunk - at])
            at += len(piece)
            if at >= begin + self.chunk:
                break
        return b"".join(out)

    def _rows(self, archive: str, path: str, info: zipfile.ZipInfo) -> Iterator[tuple]:
        head = archive, info.filename, info.header_offset, info.file_size
        parts = max(1, -(-info.file_size // self.chunk))
        if parts == 1:
            content, why = self._again(lambda: b"".join(read_member(path, info)))
            yield *head, 0, 1, None if content is None else media_type(content), "failed" if why else "ok", why, content
            return
        _, why = self._again(lambda: sum(map(len, read_member(path, info))))
        kind = None
        for part in range(1 if why else parts):
            content, why = (None, why) if why else self._again(lambda part=part: self._chunk(path, info, part))
            kind = media_type(content) if content and not part else kind
            yield *head, part, parts, kind, "failed" if why else "ok", why, content

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.archive:  # a folder without archives
            return
        path = f"{self.path}/{part.archive}"
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
            rows.clear()
            return out

        try:
            members = directory(path, part.size)
        except (OSError, ValueError, zipfile.BadZipFile) as error:
            if part.start == 0:
                rows.append((part.archive, None, 0, part.size, 0, 1, None, "archive_failed", f"{type(error).__name__}: {error}", None))
                yield batch()
            return
        held = 0
        for info in members:
            if part.start <= info.header_offset < part.end:
                for row in self._rows(part.archive, path, info):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held >= self.batch_bytes or len(rows) >= self.batch_rows:
                        yield batch()
                        held = 0
        if rows:
            yield batch()


class ArchiveMembers(DataSource):
    """``format("archive_members")``: option ``path``, and ``manifest``, ``rangeBytes``, ``chunkBytes``,
    ``batchBytes``, ``batchRows``, ``tries``, ``waitSeconds``."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def members(spark: SparkSession, path: str, **options) -> DataFrame:
    """The members of all archives under a folder, or of those in its ``manifest``."""
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").options(**options).load(path)


def write_archives(payloads: DataFrame, path: str, key_col: str, content_col: str, suffix: str = "", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Packs payloads (text or bytes) into archives under a folder that all executors share. Returns
    ``archive, n_members, n_bytes`` and keeps it as ``manifest`` in the folder."""
    where, folder = opened(path)
    where.create_dir(folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = opened(path)
        mine, out, file, count, number = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None, None, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            size = file.tell()
            file.close()
            return pa.RecordBatch.from_pydict({"archive": pa.array([f"{mine}-{number:04d}.zip"]), "n_members": pa.array([count], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for key, content in zip(batch.column("key").to_pylist(), batch.column("content")):
                if not content.is_valid:
                    continue
                if out is None:
                    file, count = where.open_output_stream(f"{folder}/{mine}-{number:04d}.zip", buffer_size=1 << 20), 0
                    out = zipfile.ZipFile(_Unseekable(file), "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                out.writestr(zipfile.ZipInfo(f"{'null' if key is None else key}{suffix}"), content.as_buffer().to_pybytes(), zipfile.ZIP_DEFLATED, 1)
                count += 1
                if file.tell() >= archive_bytes:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    rows = payloads.select(F.col(f"`{key_col}`").cast("string").alias("key"), F.col(f"`{content_col}`").cast("binary").alias("content"))
    rows.mapInArrow(work, _MANIFEST).write.parquet(f"{path}/manifest")
    return payloads.sparkSession.read.schema(_MANIFEST).parquet(f"{path}/manifest")


class _Unseekable:
    """A stream as an archive writer takes it that never goes back."""

    def __init__(self, file):
        self.write, self.flush = file.write, file.flush


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages packed into archives and read back as media columns."""
    path = shared_path(spark, "media")
    write_archives(table(spark, sf_dir, "pages"), path, "page_id", "html", ".html")
    rows = members(spark, path, manifest=f"{path}/manifest")
    return rows.select(
        F.regexp_extract("member", r"^(-?\d+)\.html$", 1).try_cast("long").alias("page_id"), "part", "media_type", F.col("size").alias("n_bytes"), F.md5("content").alias("digest"), "status", F.col("content").cast("string").alias("content")
    )


ORACLE = """
select page_id, 0 part, 'text/html' media_type, strlen(html)::bigint n_bytes, md5(html) digest, 'ok' status, html "content"
from pages where html is not null
"""
