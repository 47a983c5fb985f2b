"""Media archives: exact round trip, byte ranges, retries of single members."""

import os
import zlib
from collections import Counter
from hashlib import sha256

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import types as T

from gleanmill.llm import media

ROWS = [(1, "plain text"), (2, None), (3, ""), (None, "no id é日"), (4, "x" * 192), (5, "x" * 193), (1, "plain text"), (6, "lang " * 60000), (7, " \n\x00\x7f")]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("media", T.StringType())])


def expected(doc_id, text):
    raw = (text or "").encode()
    padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
    return doc_id, len(raw), len(padded), sha256(padded).hexdigest(), zlib.crc32(padded[-16:])


@pytest.mark.parametrize("span", [100, 8 << 20])
def test_round_trip(spark, tmp_path, span):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA).repartition(3)
    path = f"file://{tmp_path}/archives"
    media.write_archives(df, path)
    members = media.read_archives(spark, path, span)
    got = media.features(members).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == Counter(expected(*r) for r in ROWS)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    if span == 100:
        assert members.rdd.getNumPartitions() > 8
    # files of tasks that did not commit are not read
    with open(tmp_path / "archives" / "part-lost.gma", "wb") as f:
        f.write(b"half an archive")
    assert media.read_archives(spark, path, span).count() == len(ROWS)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    media.write_archives(df, str(tmp_path / "none"))
    assert media.features(media.read_archives(spark, str(tmp_path / "none"))).count() == 0


def test_images_are_read_by_other_code():
    payload, n = media.payload_of("some text é")
    image = media.to_image(payload)
    assert media.from_image(image) == payload and payload[:n].decode() == "some text é"
    broken = bytearray(image)
    broken[60] ^= 1
    with pytest.raises(ValueError):
        media.from_image(bytes(broken))


class Flaky:
    """A file system whose reads fail or give wrong bytes now and then."""

    def __init__(self, fail):
        self.inner, self.fail, self.reads, self.opened = fs.LocalFileSystem(), fail, Counter(), 0

    def open_input_file(self, path):
        self.opened += 1
        outer, f = self, self.inner.open_input_file(path)

        class File:
            def size(self):
                return f.size()

            def close(self):
                f.close()

            def read_at(self, n, at):
                outer.reads[at] += 1
                kind = outer.fail.get((at, outer.reads[at]))
                if kind == "error":
                    raise OSError("connection lost")
                data = f.read_at(n, at)
                return data[:-1] + bytes([data[-1] ^ 1]) if kind == "damage" else data[:-1] if kind == "short" else data

        return File()


def test_members_are_retried_alone(tmp_path):
    path = str(tmp_path)
    writer = media.ArchiveWriter(path)
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([f"text {i} " * (i + 1) for i in range(20)])], names=["doc_id", "text"])
    done = writer.write(iter([batch]))
    writer.commit([done, None])
    archive = os.path.join(path, done.path)
    offsets = media.Members(fs.LocalFileSystem(), archive, 1).offsets(0, done.size)
    assert len(offsets) == 20
    head = media._HEADER.size
    flaky = Flaky({(offsets[3], 1): "error", (offsets[5] + head, 1): "damage", (offsets[5] + head, 2): "short", (offsets[9], 1): "damage"})
    members = media.Members(flaky, archive, 3)
    got = [members.member(o) for o in offsets]
    assert [g[0] for g in got] == list(range(20))
    assert all(media.from_image(m)[:n].decode() == f"text {i} " * (i + 1) for i, n, m in got)
    assert flaky.reads[offsets[4]] == 1 and flaky.reads[offsets[5]] == 3
    with pytest.raises(OSError):
        media.Members(Flaky({(offsets[0], k): "error" for k in range(1, 9)}), archive, 3).member(offsets[0])
    halves = [media.Members(fs.LocalFileSystem(), archive, 1).offsets(a, b) for a, b in ((0, 700), (700, 1500), (1500, done.size))]
    assert sum(halves, []) == offsets


def test_abort_removes_archives(tmp_path):
    writer = media.ArchiveWriter(str(tmp_path))
    done = writer.write(iter([]))
    writer.abort([done, None])
    assert not os.path.exists(tmp_path / done.path)
