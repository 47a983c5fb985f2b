"""Tables in the folder that the driver and all executors share: cutting lineage, deleting what is done, filters by key."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Shuffle files of a query go as soon as what it made is written, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of a filter that is sent to all executors: 8 for each key, 64 MB at most.
FILTER_BITS = 1 << 29


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a local one where none is set and Spark is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="gleanmill-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is there when the application ends is deleted."""
    path = f"{shared_dir(spark)}/gleanmill-{what}-{uuid.uuid4().hex}"
    at, fs = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Rows of a small table that a task writes, where their number is known.
ROWS_A_FILE = 20_000


def cut(df: DataFrame, what: str, about: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends here, and sizes are known.

    The shuffle files that ``df`` needed are deleted once it is written. ``about`` so many rows (of keys and labels) come in
    few files: no more tasks end in the write than they need.
    """
    spark = df.sparkSession
    path = shared_path(spark, what)
    if about is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-about // ROWS_A_FILE)))
    with _setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gleanmill_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has made, after their last reader has written its result."""
    for df in tables:
        at, fs = _file_system(df.sparkSession, df._gleanmill_path)
        fs.delete(at, True)


def hits(keys: DataFrame, rows: DataFrame, key: Column) -> DataFrame:
    """``rows`` with ``hit``: true wherever ``key`` is among ``keys`` (one column), and for few others.

    The keys become a bitmap of bounded size that is sent to all executors, so no row moves. A null key never hits.
    """
    bits = min(max(8 * keys.count(), 1), FILTER_BITS)
    place = lambda c: F.when(c.isNotNull(), F.pmod(F.xxhash64(c.cast("long")), F.lit(bits)) + 1)
    at = place(F.col(keys.columns[0]))
    maps = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
    row, bit = F.struct(*[F.col(f"`{c}`") for c in rows.columns]), place(key)
    placed = rows.select(row.alias("row"), F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("bit"))
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))
    return placed.join(F.broadcast(maps), "bucket", "left").select("row", hit.alias("hit"))


#: Rows of an Arrow batch that are Python objects at once; rows and characters that go back at once.
_TAKEN, _GIVEN, _CHARACTERS = 200, 10_000, 4 << 20


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one; of a batch only a slice becomes Python objects at a time."""
    for b in batches:
        for first in range(0, b.num_rows, _TAKEN):
            yield from zip(*(c.to_pylist() for c in b.slice(first, _TAKEN).columns), strict=True)


def batches_of(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == _GIVEN or n >= _CHARACTERS:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()
