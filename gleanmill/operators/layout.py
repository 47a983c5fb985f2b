"""Page layout: reading order and block cleaning (CHK-16, CHK-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse

# Edge bands, repetition, headings, full width.
TOP_BAND, BOTTOM_BAND, REPEATED_SHARE, HEADING_RATIO, FULL_WIDTH = 0.12, 0.88, 0.5, 1.25, 0.65
PAGE_NUMBER = r"^\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*$"


def reading_order(blocks: DataFrame) -> DataFrame:
    """CHK-16: ``reading_order`` of blocks ``doc_id, page_num, x0, y0, x1, y1, width``.

    Blocks that cross the centre or are wide are full-width. With blocks on both sides, those above the first column
    block come first, then the left column, the right one, and the other full-width ones; else by (y, x).
    """
    page = Window.partitionBy("doc_id", "page_num")
    centre = F.col("width") / 2
    full = ((F.col("x0") < centre) & (F.col("x1") > centre)) | ((F.col("x1") - F.col("x0")) >= FULL_WIDTH * F.col("width"))
    side = F.when(full, "full").when(F.col("x1") <= centre, "left").otherwise("right")
    rows = blocks.withColumn("_side", side)
    has = lambda s: F.max((F.col("_side") == s).cast("int")).over(page) == 1
    top = F.min(F.when(F.col("_side") != "full", F.col("y0"))).over(page)
    band = F.when(~(has("left") & has("right")), 0).when(F.col("_side") == "left", 1).when(F.col("_side") == "right", 2).when(F.col("y0") <= top, 0).otherwise(3)
    order = page.orderBy("_band", "y0", "x0")
    return rows.withColumn("_band", band).withColumn("reading_order", F.row_number().over(order) - 1).drop("_side", "_band")


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """CHK-17: without blank, page-number and repeated edge blocks; headings marked; reading order renumbered.

    Needs ``doc_id, page_num, reading_order, text, y0, y1, height, font_size``.
    """
    rows = blocks.withColumn("text", collapse(F.col("text")))
    edge = (F.col("y1") <= TOP_BAND * F.col("height")) | (F.col("y0") >= BOTTOM_BAND * F.col("height"))
    seen = rows.where(edge).groupBy("doc_id", "text").agg(F.count_distinct("page_num").alias("n"))
    pages = rows.groupBy("doc_id").agg(F.count_distinct("page_num").alias("pages"))
    repeated = seen.join(pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(2), F.bround(F.col("pages") * REPEATED_SHARE))).select("doc_id", "text", F.lit(True).alias("_edge"))
    kept = rows.where((F.col("text") != "") & ~F.col("text").rlike(PAGE_NUMBER)).join(repeated, ["doc_id", "text"], "left").where(~(edge & F.col("_edge").isNotNull())).drop("_edge")
    page = Window.partitionBy("doc_id", "page_num")
    sizes = F.sort_array(F.collect_list("font_size").over(page))
    median = F.element_at(sizes, (F.size(sizes) / 2).cast("int") + 1)  # the upper one
    heading = kept.withColumn("is_heading", F.col("font_size") >= HEADING_RATIO * median)
    return heading.withColumn("reading_order", F.row_number().over(page.orderBy("reading_order")) - 1)


def page_title(blocks: DataFrame) -> DataFrame:
    """SRC-07: ``doc_id, title``: of short blocks on the first two pages, the largest font, then the earliest page."""
    first = blocks.where((F.col("page_num") <= 2) & (F.length("text") <= 200) & (F.trim("text") != ""))
    return first.groupBy("doc_id").agg(F.max(F.struct("font_size", (-F.col("page_num")).alias("p"), "text"))["text"].alias("title"))
