"""Queries on chunkers, pages and sections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking as ck
from .base import query, table

_TOKENS = r"regexp_extract_all(text, '(?s)\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])')"
FIXED = rf"""
p AS (SELECT doc_id, {_TOKENS} AS p FROM documents),
k AS (SELECT doc_id, p, len(p) AS n, unnest(range(0, greatest(ceil((len(p) - 512) / 448.0), 0)::BIGINT + 1)) AS k FROM p WHERE len(p) > 0),
fixed AS (SELECT doc_id, k AS chunk_index, k * 448 AS token_start, least(k * 448 + 512, n) AS token_end, regexp_replace(array_to_string(p[k * 448 + 1 : least(k * 448 + 512, n)], ''), '^\s+', '') AS content FROM k)"""


@query(f"WITH {FIXED} SELECT doc_id, chunk_index::BIGINT AS chunk_index, token_start::BIGINT AS token_start, token_end::BIGINT AS token_end, md5(content) AS content_md5 FROM fixed")
def fixed_chunks(spark, sf):
    """CHK-03."""
    return ck.fixed_chunks(table(spark, sf, "documents")).select("doc_id", "chunk_index", "token_start", "token_end", F.md5("content").alias("content_md5"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"


@query(f"SELECT doc_id, (i - 1)::BIGINT AS unit_index, md5(u[i]) AS unit_md5 FROM (SELECT doc_id, u, unnest(range(1, len(u) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES.format('text')} AS u FROM documents))")
def sentence_units(spark, sf):
    """CHK-11."""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(ck.sentences(F.col("text"))).alias("i", "u"))
    return rows.select("doc_id", F.col("i").cast("long").alias("unit_index"), F.md5("u").alias("unit_md5"))


_PARAGRAPHS = r"list_filter(list_transform(string_split(regexp_replace({0}, '\n\s*\n', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"
_DOUBLED = "CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || ' ' || chr(10)) ELSE text END"


@query(
    f"SELECT doc_id, (i - 1)::BIGINT AS unit_index, md5(u[i]) AS unit_md5 FROM (SELECT doc_id, u, unnest(range(1, len(u) + 1)) AS i FROM (SELECT doc_id, CASE WHEN len(p) > 1 THEN p ELSE s END AS u FROM (SELECT doc_id, {_PARAGRAPHS.format('t')} AS p, {_SENTENCES.format('t')} AS s FROM (SELECT doc_id, {_DOUBLED} AS t FROM documents))))"
)
def passage_units(spark, sf):
    """CHK-11 over texts of which every other one has blank lines."""
    t = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\n \n"))).otherwise(F.col("text"))
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(ck.passages(t)).alias("i", "u"))
    return rows.select("doc_id", F.col("i").cast("long").alias("unit_index"), F.md5("u").alias("unit_md5"))


def pages(spark, sf):
    """Lines of a text as its pages, every seventh of them blank."""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    return rows.select("doc_id", (F.col("i") + 1).alias("page_num"), F.when((F.col("doc_id") + F.col("i")) % 7 == 0, "").otherwise(F.col("text")).alias("text"))


PAGES = "pg AS (SELECT doc_id, i AS page_num, CASE WHEN (doc_id + i - 1) % 7 = 0 THEN '' ELSE l[i] END AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"


@query(f"WITH {PAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1 AS chunk_index FROM pg) SELECT doc_id, page_num::INT AS page_num, chunk_index::BIGINT AS chunk_index FROM n WHERE trim(text, ' ') <> ''")
def page_index_gaps(spark, sf):
    """CHK-05."""
    return ck.page_chunks(pages(spark, sf)).select("doc_id", "page_num", "chunk_index")


@query(
    f"""WITH {PAGES},
r AS (SELECT doc_id, page_num, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(text) AS n FROM pg),
c AS (SELECT doc_id, (k - 1) AS chunk_index, (k - 1) * 900 AS s, k * 900 AS e FROM (SELECT doc_id, unnest(range(1, length(text) // 900 + 2)) AS k FROM documents))
SELECT c.doc_id, c.chunk_index::BIGINT AS chunk_index, coalesce(min(page_num), 0)::INT AS page_start, coalesce(max(page_num), 0)::INT AS page_end
FROM c LEFT JOIN r ON c.doc_id = r.doc_id AND r.a + r.n > c.s AND r.a < c.e GROUP BY ALL"""
)
def chunk_page_ranges(spark, sf):
    """CHK-04, WIN-06, JN-09."""
    k = F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 900).cast("int")))
    chunks = table(spark, sf, "documents").select("doc_id", k.alias("k")).select("doc_id", F.col("k").cast("long").alias("chunk_index")).withColumns({"start": F.col("chunk_index") * 900, "end": F.col("chunk_index") * 900 + 900})
    return ck.pages_of_chunks(chunks, ck.page_ranges(pages(spark, sf)))


def lines_with_headings(spark, sf):
    """Lines of a text; short ones become headings by their place."""
    heads = F.element_at(F.array(*[F.lit(x) for x in ("Abstract", "1. Introduction", "2. Method", "Results", "References")]), (F.col("i") % 5 + 1).cast("int"))
    heads = F.when(heads == "Results", "result of tests").otherwise(heads)
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "t"))
    return rows.select("doc_id", F.floor(F.col("i") / 10).cast("int").alias("page_num"), F.col("i").alias("line_no"), F.when(F.length("t") < 40, heads).otherwise(F.col("t")).alias("line"))


SECTION_ISLANDS = (
    """
l AS (SELECT doc_id, i - 1 AS i, CASE WHEN length(l[i]) < 40 THEN ['Abstract', '1. Introduction', '2. Method', 'result of tests', 'References'][(i - 1) % 5 + 1] ELSE l[i] END AS line
      FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
k AS (SELECT *, CASE """
    + " ".join(f"WHEN regexp_matches(trim(line, ' '), '(?i){p[:-2]}($|[^\\p{{L}}\\p{{N}}_])') THEN '{t}'" for t, p in tx.SECTION_PATTERNS)
    + """ END AS kind FROM l),
g AS (SELECT *, count(kind) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM k),
islands AS (SELECT doc_id, (dense_rank() OVER (PARTITION BY doc_id ORDER BY island) - 1)::BIGINT AS section_index, coalesce(arg_min(kind, i) FILTER (WHERE kind IS NOT NULL), 'body') AS section_type,
       coalesce(substr(arg_min(line, i) FILTER (WHERE kind IS NOT NULL), 1, 180), 'body') AS section_title, (min(i) // 10)::INT AS page_start, (max(i) // 10)::INT AS page_end, string_agg(line, chr(10) ORDER BY i) AS text
  FROM g GROUP BY doc_id, island)"""
)


@query(f"WITH {SECTION_ISLANDS} SELECT * EXCLUDE (text), md5(text) AS text_md5 FROM islands")
def section_islands(spark, sf):
    """CHK-15, WIN-05, FN-16."""
    return ck.sections(lines_with_headings(spark, sf)).withColumn("text_md5", F.md5("text")).drop("text")


@query(
    rf"""WITH {SECTION_ISLANDS}, p AS (SELECT doc_id, section_index, {_TOKENS} AS p FROM islands),
w AS (SELECT *, len(p) AS n, unnest(range(0, greatest(ceil((len(p) - 128) / 112.0), 0)::BIGINT + 1)) AS k FROM p WHERE len(p) > 0)
SELECT doc_id, section_index, (k * 112)::BIGINT AS token_start, least(k * 112 + 128, n)::BIGINT AS token_end, md5(regexp_replace(array_to_string(p[k * 112 + 1 : least(k * 112 + 128, n)], ''), '^\s+', '')) AS content,
 row_number() OVER (PARTITION BY doc_id ORDER BY section_index, k) - 1 AS chunk_index FROM w"""
)
def section_chunks(spark, sf):
    """CHK-10, JN-01, WIN-08: windows inside sections, numbered on through a document."""
    found = ck.sections(lines_with_headings(spark, sf))
    return ck.section_chunks(found, table(spark, sf, "documents"), 128, 16).withColumn("content", F.md5("content"))


@query(None)
def structure_chunks(spark, sf):
    """CHK-06."""
    lines = lines_with_headings(spark, sf)
    blocks = lines.select("doc_id", "page_num", F.col("line_no").alias("reading_order"), F.col("line").alias("text"), tx.section_type(F.col("line")).isNotNull().alias("is_heading"))
    return ck.structure_chunks(blocks, 100, 300).withColumn("content", F.md5("content"))


@query(None)
def packed_units(spark, sf):
    """CHK-12, CHK-13."""
    return ck.packed_units(table(spark, sf, "documents"), 128).withColumn("content", F.md5("content"))


@query(None)
def reading_order(spark, sf):
    """CHK-16, CHK-17 over lines laid out as blocks of two columns."""
    from ..operators import layout

    rows = lines_with_headings(spark, sf)
    left = F.col("line_no") % 3
    blocks = rows.select(
        "doc_id",
        "page_num",
        F.col("line").alias("text"),
        F.when(left == 0, 40.0).when(left == 1, 310.0).otherwise(40.0).alias("x0"),
        F.when(left == 0, 290.0).when(left == 1, 560.0).otherwise(560.0).alias("x1"),
        (F.col("line_no") % 10 * 78.0 + 10).alias("y0"),
        (F.col("line_no") % 10 * 78.0 + 60).alias("y1"),
        F.lit(600.0).alias("width"),
        F.lit(800.0).alias("height"),
        F.when(F.length("line") < 40, 18.0).otherwise(10.0).alias("font_size"),
    )
    out = layout.clean_blocks(layout.reading_order(blocks))
    return out.select("doc_id", "page_num", "reading_order", "is_heading", F.md5("text").alias("text_md5"))


@query(
    f"WITH {PAGES} SELECT doc_id, arg_max(page_num, struct_pack(n := length(text), p := -page_num))::INT AS longest_page FROM pg GROUP BY doc_id"
)
def longest_page(spark, sf):
    """TOP-10."""
    return pages(spark, sf).groupBy("doc_id").agg(F.max_by("page_num", F.struct(F.length("text"), -F.col("page_num"))).alias("longest_page"))


