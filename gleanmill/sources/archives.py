"""ZIP archives: directories read as a stream, members read where they lie, archives written by all tasks together."""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_SLICE = 1 << 20
_LARGE = 0xFFFFFFFF


def file_system(path: str):
    """The file system of a path or a URI as Spark writes them, and the path in it."""
    from pyarrow import fs

    inner = path.removeprefix("file:")
    if inner != path or "://" not in path:
        return fs.LocalFileSystem(), "/" + inner.lstrip("/") if inner != path else path
    return fs.FileSystem.from_uri(path)


def open_file(path: str):
    """A file that can be read anywhere."""
    system, inner = file_system(path)
    return system.open_input_file(inner)


# ---- reading


def _directory_place(f) -> tuple[int, int, int]:
    """Where an archive's directory begins, its bytes, and by how much the places in it are short (something before the archive)."""
    f.seek(0, 2)
    size = f.tell()
    first = max(0, size - (1 << 16) - 98)
    f.seek(first)
    tail = f.read(size - first)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or len(tail) < at + 22:
        raise zipfile.BadZipFile("File is not a zip file")
    length, start = struct.unpack_from("<2L", tail, at + 12)
    if at >= 76 and tail[at - 20 : at - 16] == b"PK\x06\x07" and tail[at - 76 : at - 72] == b"PK\x06\x06":  # of a large archive
        length, start = struct.unpack_from("<2Q", tail, at - 36)
        at -= 76
    shift = first + at - length - start
    return start + shift, length, shift


def _name(raw: bytes, flags: int, extra: bytes) -> str:
    """A member's name, as ``zipfile`` has it."""
    name = raw.decode("utf-8" if flags & 0x800 else "cp437")
    told = _extra(extra, 0x7075) if extra else None
    if told and told[:1] == b"\x01" and struct.unpack_from("<L", told, 1)[0] == zlib.crc32(raw) and told[5:]:
        name = told[5:].decode("utf-8")
    return name.partition("\0")[0]


def _extra(extra: bytes, kind: int) -> bytes | None:
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<2H", extra, at)
        if tag == kind:
            return extra[at + 4 : at + 4 + n]
        at += 4 + n
    return None


def directory(f) -> Iterator[tuple[str, int, int, int, int]]:
    """Name, size, compressed size, place and checksum of each member but folders; of the directory only a slice is held."""
    start, left, shift = _directory_place(f)
    f.seek(start)
    held, at = b"", 0
    while left > 0 or at < len(held):
        if len(held) - at < 1 << 18 and left > 0:  # an entry is shorter
            more = f.read(min(_SLICE, left))
            if not more:
                raise zipfile.BadZipFile("Truncated central directory")
            held, at, left = held[at:] + more, 0, left - len(more)
        if held[at : at + 4] != b"PK\x01\x02":
            raise zipfile.BadZipFile("Bad magic number for central directory")
        flags, crc, packed, size, named, more, said, place = struct.unpack_from("<8xH6x3L3H8xL", held, at)
        extra = held[at + 46 + named : at + 46 + named + more]
        if _LARGE in (size, packed, place):
            large = _extra(extra, 1) or b""
            numbers = iter(struct.unpack_from(f"<{len(large) // 8}Q", large))
            size, packed, place = (next(numbers) if n == _LARGE else n for n in (size, packed, place))
        name = _name(held[at + 46 : at + 46 + named], flags, extra)
        at += 46 + named + more + said
        if not name.endswith("/"):
            yield name, size, packed, place + shift, crc


def member(f, name: str, place: int, packed: int, crc: int) -> bytes:
    """One member's content; nothing else of the archive is read."""
    f.seek(place)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("Bad magic number for file header")
    flags, kind = struct.unpack_from("<2H", head, 6)
    if flags & 0x61 or kind not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):  # rare: encrypted, patched or packed otherwise
        with zipfile.ZipFile(f) as z:
            return z.read(name)
    f.seek(place + 30 + sum(struct.unpack_from("<2H", head, 26)))
    content = f.read(packed)
    if kind == zipfile.ZIP_DEFLATED:
        content = zlib.decompress(content, -15)
    if zlib.crc32(content) != crc:
        raise zipfile.BadZipFile(f"Bad CRC-32 for file {name!r}")
    return content


class Opened:
    """Files of a task: the last one stays open, so that members which follow each other don't open it again."""

    def __init__(self):
        self.path, self.file = None, None

    def __call__(self, path: str):
        if path != self.path or self.file.closed:
            self.close()
            self.file = open_file(path)
            self.path = path
        return self.file

    def close(self) -> None:
        if self.file is not None and not self.file.closed:
            self.file.close()
        self.path = None


# ---- writing


def write(rows: DataFrame, path: str) -> None:
    """``folder, archive, member, content`` as ZIP archives below ``path``.

    Each task packs the rows it has, a file for each archive and task; one task an archive then puts these one after the
    other and writes the directory. No archive and no directory is held, and no content is shuffled.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = file_system(path)
        system.create_dir(f"{inner}/_parts", recursive=True)
        parts: dict[tuple[str, str], list] = {}
        for b in batches:
            for folder, archive, name, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = parts.get((folder, archive))
                if part is None:
                    stem = f"{inner}/_parts/{uuid.uuid4().hex}"
                    part = parts[folder, archive] = [stem, system.open_output_stream(f"{stem}.members", buffer_size=_SLICE), system.open_output_stream(f"{stem}.directory", buffer_size=_SLICE), 0, 0]
                raw, data = name.encode(), content.encode()
                packed = zlib.compress(data, 6, -15)
                # version 4.5, name in UTF-8, deflated, first day of 1980; sizes are below 4 GB, places are always long
                told = struct.pack("<5H3L2H", 45, 0x800, 8, 0, 33, zlib.crc32(data), len(packed), len(data), len(raw), 0)
                part[1].write(b"PK\x03\x04" + told + raw + packed)
                part[2].write(b"PK\x01\x02\x2d\x03" + told[:-2] + struct.pack("<4H2L", 12, 0, 0, 0, 0o600 << 16, _LARGE) + raw + struct.pack("<2HQ", 1, 8, part[3]))
                part[3] += 30 + len(raw) + len(packed)
                part[4] += 1
        for stem, *streams, _, _ in parts.values():
            for s in streams:
                s.close()
        if parts:
            keys, told = zip(*parts.items(), strict=True)
            yield pa.RecordBatch.from_pydict({"folder": [k[0] for k in keys], "archive": [k[1] for k in keys], "stem": [p[0] for p in told], "bytes": [p[3] for p in told], "members": [p[4] for p in told]})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = file_system(path)
        for b in batches:
            for folder, archive, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system.create_dir(f"{inner}/{folder}", recursive=True)
                with system.open_output_stream(f"{inner}/{folder}/{archive}", buffer_size=_SLICE) as out:
                    for p in parts:
                        with system.open_input_file(f"{p['stem']}.members") as f:
                            while piece := f.read(_SLICE):
                                out.write(piece)
                    start, before, length = sum(p["bytes"] for p in parts), 0, 0
                    for p in parts:
                        with system.open_input_file(f"{p['stem']}.directory") as f:
                            length += _moved(f, before, out)
                        before += p["bytes"]
                    n = sum(p["members"] for p in parts)
                    out.write(b"PK\x06\x06" + struct.pack("<Q2H2L4Q", 44, 45, 45, 0, 0, n, n, length, start) + b"PK\x06\x07" + struct.pack("<LQL", 0, start + length, 1))
                    out.write(b"PK\x05\x06" + struct.pack("<4H2LH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(length, _LARGE), min(start, _LARGE), 0))
                for p in parts:
                    for kind in ("members", "directory"):
                        system.delete_file(f"{p['stem']}.{kind}")
                yield pa.RecordBatch.from_pydict({"members": [n]})

    spark = rows.sparkSession
    kinds = "folder string, archive string, stem string, bytes long, members long"
    found = rows.select("folder", "archive", "member", "content").mapInArrow(pack, kinds).collect()
    whole: dict[tuple[str, str], list] = {}
    for r in found:
        whole.setdefault((r.folder, r.archive), []).append((r.stem, r.bytes, r.members))
    if whole:
        parts = spark.createDataFrame([(*k, p) for k, p in whole.items()], "folder string, archive string, parts array<struct<stem string, bytes long, members long>>")
        parts.repartition(len(whole)).mapInArrow(join, "members long").collect()


def _moved(f, by: int, out) -> int:
    """Write a part's directory with its places moved; its bytes."""
    held, at, length = b"", 0, 0
    while True:
        more = f.read(_SLICE)
        if not more:
            break
        held, at = bytearray(held[at:] + more), 0
        while at + 46 <= len(held):
            end = at + 58 + struct.unpack_from("<H", held, at + 28)[0]
            if end > len(held):
                break
            struct.pack_into("<Q", held, end - 8, struct.unpack_from("<Q", held, end - 8)[0] + by)
            at = end
        out.write(bytes(held[:at]))
        length += at
        held = bytes(held)
    return length
