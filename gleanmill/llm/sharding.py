"""Contiguous shards of balanced bytes: prefix sums of sizes over the whole table, cut at equal targets.

Rows are dealt into ranges of (doc_id, text checksum, arrival), each range totals its bytes and rows, a running sum over
the few range totals gives every range its offset, and a running sum inside each range gives every row its place. A
row belongs to the shard in whose equal share of all bytes its middle byte falls. Only ids, sizes and checksums move.
DataFrame functions only.

A null text has no bytes and checksum 0; a null id comes first in the order. Repeated rows (and a hot id) are spread over
ranges by their arrival. Fewer rows than shards leave shards empty. An empty table gives an empty result. Only the id
and the text are read, so other names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime


def shard_by_bytes(docs: DataFrame, shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, start_byte``: contiguous in doc_id, slots gapless from 0.

    ``size`` is the UTF-8 length plus ``overhead``. Broadcast are the range totals (one row a partition) and the
    shards' first rows (one row a shard).
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    # written once, so that ranges stay as they are whenever a task is run again
    dealt = runtime.cut(rows.withColumn("arrival", F.monotonically_increasing_id()), "sizes")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = runtime.cut(dealt.repartitionByRange(ranges, "doc_id", "text_crc32", "arrival").withColumn("part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_offset"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_offset"),
        F.sum("bytes").over(everything).alias("all_bytes"),
    )
    order = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "arrival")
    placed = (
        ranged.select("*", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("inside"), (F.row_number().over(order) - 1).alias("nth"))
        .join(F.broadcast(offsets), "part")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (F.col("byte_offset") + F.coalesce("inside", F.lit(0))).alias("start_byte"),
            (F.col("row_offset") + F.col("nth")).alias("place"),
            "all_bytes",
        )
        # the middle byte's share, in doubled bytes to stay in whole numbers; decimals hold any corpus
        .withColumn("shard", F.expr(f"cast(((cast(2 * start_byte + size as decimal(38, 0)) * {shards}) div (2 * all_bytes)) as int)"))
    )
    placed = runtime.cut(placed.drop("all_bytes"), "places")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"), "start_byte")
