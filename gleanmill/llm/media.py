"""Media columns: payloads stored losslessly as images in archive files, and a Spark data source that reads them.

An archive is a run of members, each a fixed header (magic, id, sizes, checksum) and its media bytes, then an index of
member offsets and a footer. The source ``media_archive`` writes one archive a task and lists the archives of successful
tasks in a manifest. Reading plans byte ranges over all archives of a directory from their footers' sizes; a range holds
the members that begin in it. Payload batches of bounded size stream through Arrow. Each member is fetched by its
offset, and a failed or damaged read of one is tried again by itself, with the archive opened anew.

A payload is the text's UTF-8 bytes (null: none), padded with spaces to a positive multiple of 192, as 8-bit RGB samples
of a PNG image 64 pixels wide, so equal texts have equal media. Repeated rows give repeated members, a null id is kept by a
flag in the header, an empty table gives no members. Only the id and the text are read; other names cannot clash.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import runtime

#: Payloads are padded to a multiple of this: one row of 64 RGB pixels.
ROW = 192
_MAGIC = b"GMA1"
_HEADER = struct.Struct("<4sBqQQI")  # magic, id present, id, unpadded bytes, media bytes, crc32 of the media
_FOOTER = struct.Struct("<QQ4s")  # where the index begins, members, magic
_MEMBERS = "doc_id long, n_bytes long, media binary, archive string, offset long"
#: Bytes of media in an Arrow batch.
BATCH = 4 << 20


# ---- the stored form


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(payload: bytes, level: int = 1) -> bytes:
    """A PNG file whose samples are the payload's bytes."""
    width = ROW // 3
    height = len(payload) // ROW
    samples = np.zeros((height, ROW + 1), np.uint8)  # each row begins with its filter type, 0
    samples[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(samples, level)) + _chunk(b"IEND", b"")


def from_image(image: bytes) -> bytes:
    """The samples of a PNG file written by ``to_image``; raises on anything else."""
    if image[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, found = 8, {}
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError("damaged chunk")
        found[kind] = found.get(kind, b"") + data
        at += 12 + n
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", found[b"IHDR"])
    if (3 * width, depth, colour, interlace) != (ROW, 8, 2, 0):
        raise ValueError("another kind of image")
    rows = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(height, ROW + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the bytes that are the text."""
    raw = (text or "").encode()
    return raw + b" " * ((-len(raw)) % ROW or (0 if raw else ROW)), len(raw)


def feature_of(payload: bytes) -> str:
    """Mean and spread of the samples, a 16-bin histogram in thousandths, and the mean step between samples."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    wide = x.astype(np.int64)
    mean, square = wide.sum() / len(x), (wide * wide).sum() / len(x)
    step = np.abs(np.diff(wide)).sum() / max(len(x) - 1, 1)
    return f"{mean:.4f} {max(square - mean * mean, 0.0) ** 0.5:.4f} {step:.4f} " + ",".join(map(str, bins.tolist()))


# ---- archives


def _open(uri: str):
    """The file system of a URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class Written(WriterCommitMessage):
    path: str
    members: int
    size: int


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes an archive under a name of its own; those of successful tasks go into a manifest."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.gma"
        offsets, at = [], 0
        with system.open_output_stream(f"{folder}/{name}", compression=None, buffer_size=1 << 20) as out:
            for batch in iterator:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    payload, n = payload_of(text)
                    media = to_image(payload)
                    out.write(_HEADER.pack(_MAGIC, doc_id is not None, doc_id or 0, n, len(media), zlib.crc32(media)) + media)
                    offsets.append(at)
                    at += _HEADER.size + len(media)
            out.write(np.array(offsets, "<u8").tobytes() + _FOOTER.pack(at, len(offsets), _MAGIC))
        return Written(name, len(offsets), at + 8 * len(offsets) + _FOOTER.size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        done = [{"name": m.path, "members": m.members, "size": m.size} for m in messages if m is not None]
        with system.open_output_stream(f"{folder}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(done).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = _open(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{folder}/{m.path}")


@dataclass
class Span(InputPartition):
    archive: str
    first: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, span: int, attempts: int):
        self.path, self.span, self.attempts = path, span, attempts

    def partitions(self) -> list[Span]:
        from pyarrow import fs

        system, folder = _open(self.path)
        out = []
        for info in system.get_file_info(fs.FileSelector(folder)):
            if info.base_name.startswith("manifest-"):
                with system.open_input_stream(info.path) as f:
                    listed = json.loads(f.read())
                for a in listed:
                    out += [Span(a["name"], at, at + self.span) for at in range(0, a["size"], self.span) if a["members"]]
        return out or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        system, folder = _open(self.path)
        source = Members(system, f"{folder}/{partition.archive}", self.attempts)
        rows, size = [], 0
        for offset in source.offsets(partition.first, partition.end):
            doc_id, n, media = source.member(offset)
            rows.append((doc_id, n, media, partition.archive, offset))
            size += len(media)
            if size >= BATCH:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)
        source.close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "media", "archive", "offset"])


class Members:
    """Reads single members of an archive; each call tries again by itself."""

    def __init__(self, system, path: str, attempts: int):
        self.system, self.path, self.attempts, self.file = system, path, attempts, None

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None

    def _retry(self, what: str, read):
        for attempt in range(self.attempts):
            try:
                if self.file is None:
                    self.file = self.system.open_input_file(self.path)
                return read(self.file)
            except (OSError, ValueError) as e:
                self.close()
                if attempt == self.attempts - 1:
                    raise OSError(f"{self.path}: {what} could not be read in {self.attempts} attempts: {e}") from e
                time.sleep(min(0.05 * 2**attempt, 2))

    def offsets(self, first: int, end: int) -> list[int]:
        """Offsets of members that begin in a byte range; only the needed part of the index is read."""

        def read(f) -> list[int]:
            size = f.size()
            index, members, magic = _FOOTER.unpack(f.read_at(_FOOTER.size, size - _FOOTER.size))
            if magic != _MAGIC or index + 8 * members + _FOOTER.size != size:
                raise ValueError("damaged footer")

            def at(k: int) -> int:
                return struct.unpack("<Q", f.read_at(8, index + 8 * k))[0]

            def place(value: int) -> int:  # how many members begin before it
                lo, hi = 0, members
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if at(mid) < value else (lo, mid)
                return lo

            lo, hi = place(first), place(end)
            return np.frombuffer(f.read_at(8 * (hi - lo), index + 8 * lo), "<u8").tolist()

        return self._retry("the index", read)

    def member(self, offset: int) -> tuple[int | None, int, bytes]:
        def read(f) -> tuple[int | None, int, bytes]:
            magic, known, doc_id, n, size, crc = _HEADER.unpack(f.read_at(_HEADER.size, offset))
            if magic != _MAGIC:
                raise ValueError("no member begins here")
            media = f.read_at(size, offset + _HEADER.size)
            if len(media) != size or zlib.crc32(media) != crc:
                raise ValueError("damaged member")
            return doc_id if known else None, n, media

        return self._retry(f"the member at {offset}", read)


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(dir)``; options ``span`` (bytes of a partition) and ``attempts``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return _MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("span", 8 << 20)), int(self.options.get("attempts", 4)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


# ---- the operator


def write_archives(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store the payload of every row's whole text; one archive a partition."""
    spark = docs.sparkSession
    runtime.ship(spark)
    spark.dataSource.register(MediaArchive)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows.write.format("media_archive").mode("append").option("path", path).save()


def read_archives(spark, path: str, span: int = 8 << 20, attempts: int = 4) -> DataFrame:
    """``doc_id, n_bytes, media, archive, offset`` of every member."""
    runtime.ship(spark)
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("span", str(span)).option("attempts", str(attempts)).load(path)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for doc_id, n, media in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            payload = from_image(media)
            rows.append((doc_id, n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), sha256(media).hexdigest(), feature_of(payload)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def features(members: DataFrame) -> DataFrame:
    """Digests and a feature string of every member, all from the bytes as stored."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return members.select("doc_id", "n_bytes", "media").mapInArrow(partial(_features), schema)
