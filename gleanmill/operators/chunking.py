"""Chunkers: rows that become several rows (CHK-01..15, WIN-05, WIN-06, JN-09)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as tx

_FIELD = r"\b(Subject|Description|Resolution|Tags):"
_GAP = "\u0001"


# ---- labelled fields


def _labelled(content: Column) -> Column:
    """Array of (field, text): the text before any label has no field unless there is no label at all."""
    marked = F.split(F.regexp_replace(tx.blank(content), _FIELD, _GAP + "$1" + _GAP), _GAP, -1)
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest((F.size(marked) - 1) / 2, F.lit(1)).cast("int")),
        lambda k: F.struct(F.lower(F.coalesce(F.get(marked, 2 * k - 1), F.lit(""))).alias("field"), tx.clean_text(F.coalesce(F.get(marked, 2 * k), F.lit(""))).alias("text")),
    )
    whole = F.array(F.struct(F.lit("content").alias("field"), tx.clean_text(content).alias("text")))
    return F.filter(F.when(F.size(marked) > 1, pairs).otherwise(whole), lambda p: p["text"] != "")


def field_chunks(docs: DataFrame) -> DataFrame:
    """CHK-01: a chunk for each labelled field of a ticket; other documents pass through as one ``message`` chunk."""
    return _fields(docs, "__chunk_", lambda c: F.concat(c["field"], F.lit(": "), c["text"]))


def contextual_chunks(docs: DataFrame) -> DataFrame:
    """CHK-02: the same with the ticket's context before the field's text. Needs the metadata columns of tickets."""
    named = [("title", "title"), ("priority", "priority"), ("ticket type", "ticket_type"), ("queue", "queue"), ("status", "status"), ("business type", "business_type")]
    parts = [F.when(tx.blank(F.col(c)) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for label, c in named if c in docs.columns]
    docs = docs.withColumn("_context", tx.clean_text(F.concat_ws(" ", *parts)))
    said = lambda c: tx.clean_text(F.concat(F.lit("Ticket context: "), F.col("_context"), F.lit(" Current field: "), c["field"], F.lit(". Field text: "), c["text"]))
    return _fields(docs, "__ctx_", said)


def _fields(docs: DataFrame, mark: str, content) -> DataFrame:
    ticket = F.col("source_type") == "ticket"
    one = F.array(F.struct(F.lit("message").alias("field"), F.col("content").alias("text")))
    rows = docs.select("doc_id", "source_type", "title", *[c for c in ("_context",) if c in docs.columns], "content", F.posexplode(F.when(ticket, _labelled(F.col("content"))).otherwise(one)).alias("chunk_index", "c"))
    c = F.col("c")
    return rows.select(
        F.when(ticket, F.concat(F.col("doc_id"), F.lit(mark), F.lpad(F.col("chunk_index").cast("string"), 2, "0"), F.lit("_"), c["field"])).otherwise(F.col("doc_id")).alias("doc_id"),
        F.col("doc_id").alias("parent_doc_id"),
        F.when(ticket, F.trim(F.concat(F.col("title"), F.lit(" ["), c["field"], F.lit("]")))).otherwise(F.col("title")).alias("title"),
        F.when(ticket, content(c)).otherwise(c["text"]).alias("content"),
        c["field"].alias("chunk_field"),
        F.col("chunk_index").cast("long").alias("chunk_index"),
    )


# ---- token windows


def windows(n: Column, size: int, overlap: int) -> Column:
    """Array of (start, end) of windows over n tokens; the last one ends at n."""
    step = max(size - overlap, 1)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * step).alias("start"), F.least(k * step + size, n).alias("end"))))


def fixed_chunks(docs: DataFrame, size: int = 512, overlap: int = 64, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """CHK-03: windows of regex tokens with overlap: ``chunk_index, token_start, token_end, content``.

    Each token is kept with the gap before it, so a window's text is a join of pieces.
    """
    pieces = F.regexp_extract_all(tx.blank(F.col(text_col)), F.lit(rf"(?s)\s*(?:{tx.TOKEN})"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), pieces.alias("p")).select("doc_id", "p", F.size("p").alias("n"))
    spans = rows.select("doc_id", "p", F.posexplode(windows(F.col("n"), size, overlap)).alias("chunk_index", "w"))
    body = F.array_join(F.slice("p", F.col("w.start") + 1, F.col("w.end") - F.col("w.start")), "")
    return spans.select(
        "doc_id",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("w.start").cast("long").alias("token_start"),
        F.col("w.end").cast("long").alias("token_end"),
        F.regexp_replace(body, r"^\s+", "").alias("content"),
    )


def page_ranges(pages: DataFrame) -> DataFrame:
    """WIN-06: ``char_start, char_end`` of pages joined by two characters, from ``doc_id, page_num, text``."""
    w = Window.partitionBy("doc_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    n = F.length(tx.blank(F.col("text"))).cast("long")
    start = F.coalesce(F.sum(n + 2).over(w), F.lit(0)).cast("long")
    return pages.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + n)


def with_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """JN-02: documents with ``pages``, an ordered array of (page_num, text), empty where there are none."""
    page = F.struct("page_num", "text")
    grouped = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))  # a document's own pages
    return docs.join(grouped, "doc_id", "left").withColumn("pages", F.when(F.col("pages").isNull(), F.array().cast(grouped.schema["pages"].dataType)).otherwise(F.col("pages")))


def pages_of_chunks(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """CHK-04, JN-09: first and last page that a chunk's ``start, end`` overlaps, 0 if none."""
    met = chunks.alias("c").join(ranges.select("doc_id", "page_num", "char_start", "char_end").alias("r"), (F.col("c.doc_id") == F.col("r.doc_id")) & (F.col("r.char_end") > F.col("c.start")) & (F.col("r.char_start") < F.col("c.end")), "left")
    return met.groupBy("c.doc_id", "c.chunk_index").agg(F.coalesce(F.min("page_num"), F.lit(0)).alias("page_start"), F.coalesce(F.max("page_num"), F.lit(0)).alias("page_end"))


def page_chunks(pages: DataFrame) -> DataFrame:
    """CHK-05: a chunk for each page that is not blank; indexes count all pages, so blank ones leave gaps."""
    w = Window.partitionBy("doc_id").orderBy("page_num")
    rows = pages.withColumn("chunk_index", (F.row_number().over(w) - 1).cast("long"))
    return rows.where(F.trim(tx.blank(F.col("text"))) != "")


def sections(lines: DataFrame) -> DataFrame:
    """CHK-15, WIN-05: sections of ``doc_id, page_num, line_no, line``: an island starts at each heading line."""
    order = Window.partitionBy("doc_id").orderBy("page_num", "line_no")
    rows = lines.withColumn("kind", tx.section_type(F.col("line"))).withColumn("island", F.sum(F.col("kind").isNotNull().cast("int")).over(order))
    head = F.min(F.when(F.col("kind").isNotNull(), F.struct("page_num", "line_no", "kind", "line")))
    body = F.sort_array(F.collect_list(F.struct("page_num", "line_no", "line")))
    out = rows.groupBy("doc_id", "island").agg(head.alias("head"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("text"), F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end"))
    index = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("island")) - 1
    return out.select("doc_id", index.cast("long").alias("section_index"), F.coalesce("head.kind", F.lit("body")).alias("section_type"), F.coalesce(F.substring("head.line", 1, 180), F.lit("body")).alias("section_title"), "page_start", "page_end", "text")


# ---- units


def sentences(text: Column) -> Column:
    """CHK-11: cut after an end sign and white space."""
    return F.filter(F.transform(F.split(tx.blank(text), r"(?<=[.!?])\s+", -1), lambda x: F.trim(x)), lambda x: x != "")  # F.trim itself would take the place as signs to trim


def passages(text: Column) -> Column:
    """CHK-11: cut at blank lines; one passage or none: cut in sentences."""
    found = F.filter(F.transform(F.split(tx.blank(text), r"\n\s*\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(found) > 1, found).otherwise(sentences(text))


_TOKENS = re.compile(r"\w+|[^\w\s]")


def pack_units(units: list[str], budget: int, least: int, overlap: int = 1) -> list[tuple[str, int, int, int]]:
    """CHK-12 for one text: (text, first, end, tokens) of chunks of whole units.

    A chunk ends with the unit that brings it to ``least`` tokens, or before the one that would exceed ``budget``, or
    before one that exceeds it alone. Both ends are looked up in the running sum of tokens. The next chunk begins
    ``overlap`` units before a chunk's end. A unit above the budget is cut into windows of its own tokens.
    """
    counts = np.array([len(_TOKENS.findall(u)) for u in units], np.int64)
    until = np.concatenate(([0], np.cumsum(counts)))
    huge = np.append(np.flatnonzero(counts > budget), len(units))
    out: list[tuple[str, int, int, int]] = []
    first = 0
    while first < len(units):
        wall = int(huge[np.searchsorted(huge, first)])
        if wall == first:
            out += _cut_unit(units[first], budget)
            first += 1
            continue
        enough = int(np.searchsorted(until, until[first] + least, "left"))
        fits = int(np.searchsorted(until, until[first] + budget, "right")) - 1
        end = min(max(enough, first + 1), fits, wall)
        text = "\n".join(units[first:end])
        out.append((text, first, end, int(until[end] - until[first])))
        first = len(units) if end == len(units) else max(first + 1, end - overlap)
    return out


def _cut_unit(unit: str, budget: int) -> list[tuple[str, int, int, int]]:
    """Consecutive windows of a unit's tokens."""
    starts, ends = np.array([m.span() for m in _TOKENS.finditer(unit)]).T
    n = len(starts)
    return [(unit[starts[a] : ends[min(a + budget, n) - 1]], a, min(a + budget, n), min(budget, n - a)) for a in range(0, n, budget)]


def packed_units(rows: DataFrame, budget: int = 512, kind: str = "sentence") -> DataFrame:
    """CHK-12, CHK-13: sentence (at least budget / 2) or passage (at least 0.8 budget) chunks of ``doc_id, text``.

    Packing is a fold over a row's own units, so each row is done where it is, in Arrow batches.
    """
    least = budget // 2 if kind == "sentence" else int(budget * 0.8)
    units = rows.select("doc_id", (sentences if kind == "sentence" else passages)(F.col("text")).alias("units"))

    schema = "doc_id long, chunk_index long, content string, unit_start long, unit_end long, token_count long"
    kinds = shared.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = ((d, k, *c) for d, us in shared.rows_of(batches) for k, c in enumerate(pack_units(us, budget, least)))
        yield from shared.batches_of(packed, kinds)

    return units.mapInArrow(run, schema)


def pack_blocks(blocks: list[tuple[int, str, bool]], least: int = 350, most: int = 700) -> list[tuple[str, str, int, int]]:
    """CHK-06 for one document: (text, heading, first page, last page) of sections of ordered (page, text, is_heading)."""
    size = lambda ts: len(_TOKENS.findall("\n\n".join(ts)))
    found: list[tuple[list[str], list[int], str]] = []
    texts, pages, heading = [], [], ""

    def flush() -> None:
        if texts:
            found.append((texts.copy(), pages.copy(), heading))
            texts.clear()
            pages.clear()

    for page, text, is_heading in ((page, text.strip(), is_heading) for page, text, is_heading in blocks):
        if not text:
            continue
        if is_heading:
            flush()
            heading = text
        if texts and size([*texts, text]) > most:
            flush()
        texts.append(text)
        pages.append(page)
    flush()
    merged: list[tuple[list[str], list[int], str]] = []
    both = lambda a, b: (a[0] + b[0], a[1] + b[1], " > ".join(h for h in (a[2], b[2]) if h))
    k = 0
    while k < len(found):
        now = found[k]
        while k + 1 < len(found) and size(now[0]) < least and size(now[0] + found[k + 1][0]) <= most:
            now = both(now, found[k + 1])
            k += 1
        merged.append(now)
        k += 1
    if len(merged) > 1 and size(merged[-1][0]) < least and size(merged[-2][0] + merged[-1][0]) <= most:
        last = merged.pop()
        merged[-1] = both(merged[-1], last)
    return [("\n\n".join(t), h, min(p), max(p)) for t, p, h in merged]


def structure_chunks(blocks: DataFrame, least: int = 350, most: int = 700) -> DataFrame:
    """CHK-06: structure chunks of ``doc_id, page_num, reading_order, text, is_heading``; one group is one document."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["page_num", "reading_order"], kind="stable")
        out = pack_blocks(list(zip(g["page_num"], g["text"].fillna(""), g["is_heading"], strict=True)), least, most)
        return pd.DataFrame([(g["doc_id"].iloc[0], k, *c) for k, c in enumerate(out)], columns=["doc_id", "chunk_index", "content", "section_path", "page_start", "page_end"])

    return blocks.groupBy("doc_id").applyInPandas(run, "doc_id long, chunk_index long, content string, section_path string, page_start long, page_end long")


def with_context(chunks: DataFrame) -> DataFrame:
    """CHK-07: four header lines before the content, from ``title, document_type, publisher, section_path``."""
    # The header's labels.
    labels = [("문서 제목", "title"), ("문서 유형", "document_type"), ("발행처", "publisher"), ("섹션", "section_path")]
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), tx.blank(F.col(c))) for label, c in labels])
    return chunks.withColumn("content", F.concat(head, F.lit("\n\n"), F.col("content")))


def section_chunks(sections: DataFrame, docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """CHK-09, CHK-10, JN-01, WIN-08: windows inside sections (or pages) of known documents, numbered on through a document."""
    known = sections.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("_key", F.struct("doc_id", "section_index"))
    cut = fixed_chunks(known, size, overlap, id_col="_key")
    order = Window.partitionBy("doc_id").orderBy("section_index", "part")
    rows = cut.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.section_index").alias("section_index"), F.col("chunk_index").alias("part"), "token_start", "token_end", "content")
    return rows.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("long")).drop("part")


def bm25_text(text: Column, preserved: Column) -> Column:
    """CHK-14: the text and its first 40 preserved elements."""
    return F.concat_ws("\n", text, F.when(F.size(preserved) > 0, F.array_join(F.slice(preserved, 1, 40), "\n")))
