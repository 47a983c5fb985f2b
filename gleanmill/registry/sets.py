"""Queries on question sets, sampling, marts and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking as ck
from ..operators import marts as mr
from ..operators import questions as qs
from .base import query, table
from .chunks import FIXED, PAGES, pages
from .ranking import gold, questions


def topic_docs(spark, sf):
    """Documents with a field (their source) and topic words (their first three long words)."""
    return table(spark, sf, "documents").select("doc_id", F.col("source").alias("field"), F.array_distinct(F.transform(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0)), 1, 3), F.lower)).alias("topics"))


_TOPICS = "t AS (SELECT doc_id, source AS field, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]{6,}')[1:3], lambda x: lower(x))) AS topics FROM documents)"


@query(
    f"""WITH {_TOPICS}, p AS (SELECT a.doc_id, b.doc_id AS negative_id, (CASE WHEN a.field = b.field THEN 3 ELSE 0 END + len(list_intersect(a.topics, b.topics)))::BIGINT AS score FROM t a JOIN t b ON a.doc_id <> b.doc_id)
SELECT doc_id, negative_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, negative_id) AS nth FROM p WHERE score > 0 QUALIFY nth <= 10"""
)
def hard_negatives(spark, sf):
    """JN-07."""
    return qs.hard_negatives(topic_docs(spark, sf))


@query("SELECT a.doc_id, b.doc_id AS negative_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id) AS nth FROM documents a JOIN documents b ON a.source = b.source AND a.lang = b.lang AND a.doc_id <> b.doc_id QUALIFY nth <= 3")
def group_negatives(spark, sf):
    """JN-08."""
    return qs.group_negatives(table(spark, sf, "documents"), ["source", "lang"])


def candidates(spark, sf):
    """Questions from passages; every fifth repeats one, some lack fields."""
    b = table(spark, sf, "benchmark")
    i = F.col("item_id")
    return b.select(
        i.alias("pos"),
        F.concat(F.lit("q"), i.cast("string")).alias("question_id"),
        F.when(i % 5 == 4, "What is  THIS about?").when(i % 7 == 6, "").otherwise(F.concat(F.substring("text", 1, 40), F.when(i % 2 == 0, "?").otherwise(""))).alias("question"),
        F.when(i % 6 == 5, "x").otherwise(F.substring("text", 1, 60)).alias("reference_answer"),
        F.when(i % 9 == 8, F.substring("text", 1, 30)).otherwise(F.col("text")).alias("evidence_text"),
        F.when(i % 8 == 7, F.array().cast("array<string>")).otherwise(F.array(i.cast("string"))).alias("gold_doc_ids"),
        F.array((i % 4 + 1).cast("int")).alias("gold_pages"),
        ((i % 10) / 10.0).alias("lexical_overlap"),
        F.when(i % 3 == 0, "abstract").otherwise("method").alias("gold_section"),
        F.transform(F.sequence(F.lit(1), (i % 8 + 1).cast("int")), lambda k: F.concat(F.lit("d"), k.cast("string"))).alias("hard_negative_doc_ids"),
    )


_CANDIDATES = r"""
c AS (SELECT item_id AS pos, 'q' || item_id AS question_id, CASE WHEN item_id % 5 = 4 THEN 'What is  THIS about?' WHEN item_id % 7 = 6 THEN '' ELSE substr(text, 1, 40) || CASE WHEN item_id % 2 = 0 THEN '?' ELSE '' END END AS question,
 CASE WHEN item_id % 6 = 5 THEN 'x' ELSE substr(text, 1, 60) END AS answer, CASE WHEN item_id % 9 = 8 THEN substr(text, 1, 30) ELSE text END AS evidence, item_id % 8 <> 7 AS has_gold, (item_id % 10) / 10.0 AS overlap, item_id % 3 = 0 AS abstract, item_id % 8 + 1 AS negatives FROM benchmark),
k AS (SELECT *, lower(trim(regexp_replace(question, '\s+', ' ', 'g'), ' ')) AS key FROM c),
r AS (SELECT *, key <> '' AND row_number() OVER (PARTITION BY key ORDER BY pos) > 1 AS again FROM k)"""


@query(
    f"""WITH {_CANDIDATES},
o AS (SELECT question_id, concat_ws('|', CASE WHEN trim(question) = '' THEN 'missing_question' END, CASE WHEN trim(answer) = '' THEN 'missing_reference_answer' END, CASE WHEN trim(evidence) = '' THEN 'missing_evidence' END, CASE WHEN NOT has_gold THEN 'missing_gold_doc_ids' END, CASE WHEN again THEN 'duplicate_question' END, CASE WHEN trim(evidence) <> '' AND length(trim(evidence)) < 80 THEN 'too_short_evidence' END) AS reasons,
 concat_ws('|', CASE WHEN trim(answer) <> '' AND length(trim(answer)) < 2 THEN 'very_short_answer' END, CASE WHEN trim(question) <> '' AND NOT regexp_matches(trim(question), '[?？]$') THEN 'question_mark_missing' END, CASE WHEN overlap < 0.05 THEN 'low_lexical_overlap' END) AS flags FROM r)
SELECT *, CASE WHEN reasons <> '' THEN 'rejected' ELSE 'approved' END AS review_status FROM o"""
)
def golden_review(spark, sf):
    """QA-02, WIN-03."""
    out = qs.review_office(candidates(spark, sf))
    return out.select("question_id", F.array_join("auto_reject_reasons", "|").alias("reasons"), F.array_join("review_flags", "|").alias("flags"), "review_status")


_PAPERS = f"""{_CANDIDATES},
o AS (SELECT question_id, overlap, negatives, concat_ws('|', CASE WHEN trim(question) = '' THEN 'missing_question' END, CASE WHEN trim(evidence) = '' THEN 'missing_evidence' END, CASE WHEN trim(answer) = '' THEN 'missing_reference_answer' END, CASE WHEN NOT has_gold THEN 'missing_gold_doc_ids' END, CASE WHEN trim(evidence) <> '' AND length(trim(evidence)) < 240 THEN 'too_short_evidence' END, CASE WHEN again THEN 'duplicate_question' END) AS reasons,
 concat_ws('|', CASE WHEN abstract THEN 'abstract_based' END, CASE WHEN greatest((length(question) - length(replace(question, '?', ''))) / greatest(length(question), 1), (length(evidence) - length(replace(evidence, '?', ''))) / greatest(length(evidence), 1)) > 0.08 THEN 'encoding_noise' END, CASE WHEN negatives < 5 THEN 'few_hard_negatives' END, CASE WHEN overlap > 0.55 THEN 'high_lexical_overlap' END, CASE WHEN overlap < 0.15 THEN 'low_lexical_overlap' END) AS flags FROM r),
s AS (SELECT *, CASE WHEN reasons <> '' THEN 'rejected' WHEN flags <> '' THEN 'manual_review' ELSE 'approved_auto_review' END AS review_status FROM o)"""


@query(f"WITH {_PAPERS} SELECT question_id, reasons, flags, review_status FROM s")
def qaset_review(spark, sf):
    """QA-07, FN-37, FN-38."""
    out = qs.review_papers(candidates(spark, sf))
    return out.select("question_id", F.array_join("auto_reject_reasons", "|").alias("reasons"), F.array_join("review_flags", "|").alias("flags"), "review_status")


@query(f"WITH {_PAPERS} SELECT question_id, CASE WHEN review_status = 'manual_review' THEN 'approved_provisional_review' ELSE review_status END AS review_status, review_status = 'manual_review' AS requires_human_review FROM s WHERE review_status <> 'rejected'")
def canonical_qaset(spark, sf):
    """QA-08."""
    return qs.promote(qs.review_papers(candidates(spark, sf))).select("question_id", "review_status", "requires_human_review")


@query(f"WITH {_PAPERS} SELECT flag, count(*) AS questions FROM (SELECT unnest(string_split(flags, '|')) AS flag FROM s WHERE flags <> '') GROUP BY flag")
def review_flags(spark, sf):
    """AGG-08."""
    return qs.review_papers(candidates(spark, sf)).select(F.explode("review_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("questions"))


@query(
    f"""WITH {_PAPERS}, d AS (SELECT *, CASE WHEN overlap < 0.2 AND negatives >= 5 THEN 'adversarial' WHEN overlap < 0.35 OR negatives >= 8 THEN 'hard' WHEN overlap < 0.55 THEN 'medium' ELSE 'easy' END AS difficulty FROM s)
SELECT count(*) AS questions, round(avg(overlap), 6)::DOUBLE AS mean_overlap, round(quantile_cont(overlap, 0.5), 6)::DOUBLE AS median_overlap, round(avg((overlap < 0.2)::INT), 6) AS low_overlap_ratio, round(avg((overlap >= 0.55)::INT), 6) AS high_overlap_ratio, round(avg(negatives), 6) AS mean_negatives, min(negatives)::BIGINT AS min_negatives,
 round(avg((difficulty IN ('hard', 'adversarial'))::INT), 6) AS hard_ratio, round(avg((review_status = 'manual_review')::INT), 6) AS manual_ratio, round(avg((review_status = 'rejected')::INT), 6) AS rejected_ratio FROM d"""
)
def qaset_summary(spark, sf):
    """AGG-09, FN-32."""
    rows = qs.review_papers(candidates(spark, sf)).withColumn("difficulty", tx.difficulty(F.col("lexical_overlap"), F.size("hard_negative_doc_ids")))
    return qs.qaset_summary(rows)


@query("SELECT doc_id, lang, nth FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth FROM documents) ORDER BY nth, lang LIMIT 37")
def round_robin_sample(spark, sf):
    """TOP-04: a sampling operator."""
    return qs.round_robin(table(spark, sf, "documents").select("doc_id", "lang"), "lang", [F.col("doc_id")], 37)


@query("SELECT doc_id, lang, nth FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '42')) AS nth FROM documents) ORDER BY nth, lang LIMIT 50")
def hash_sample(spark, sf):
    """TOP-05, TOP-09: a sampling operator."""
    return qs.round_robin(table(spark, sf, "documents").select("doc_id", "lang"), "lang", [qs.hash_order("doc_id")], 50)


@query(
    "WITH g AS (SELECT DISTINCT d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT doc_id, doc_id AS parent_id, g.doc_id IS NOT NULL AS is_gold FROM documents d LEFT JOIN g USING (doc_id) ORDER BY (g.doc_id IS NULL), doc_id LIMIT greatest(10000, (SELECT count(*) FROM g))"
)
def eval_subset(spark, sf):
    """TOP-11, JN-14: all gold, filled up to the reference's 10,000."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("parent_id"))
    return qs.eval_subset(docs, gold(spark, sf).select(F.col("parent_id").alias("doc_id")))


def section_candidates(spark, sf):
    kinds = F.array(*[F.lit(x) for x in qs.QUOTAS])
    return table(spark, sf, "documents").select(
        "doc_id",
        F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")).alias("question_type"),
        F.element_at(F.array(*[F.lit(x) for x in qs.SECTION_ORDER]), (F.col("doc_id") % 7 + 1).cast("int")).alias("gold_section"),
        (F.col("doc_id") % 7).cast("long").alias("section_priority"),
        F.col("doc_id").alias("pos"),
    )


def _listed(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_SECTIONS = f"""s AS (SELECT doc_id, {_listed(qs.QUOTAS)}[doc_id % 6 + 1] AS question_type, {_listed(qs.SECTION_ORDER)}[doc_id % 7 + 1] AS gold_section, doc_id % 7 AS section_priority, doc_id AS pos FROM documents)"""
_GOALS = "(VALUES " + ", ".join(f"('{t}', {n}, {i})" for i, (t, n) in enumerate(qs.targets(60).items())) + ") g(question_type, goal, place)"


@query(
    f"""WITH {_SECTIONS}, o AS (SELECT s.*, goal, place, row_number() OVER (PARTITION BY question_type ORDER BY md5(doc_id || '42')) AS n FROM s JOIN {_GOALS} USING (question_type)),
r AS (SELECT *, row_number() OVER (ORDER BY n > goal, place, n) AS taken FROM o)
SELECT doc_id, question_type, gold_section, section_priority, pos FROM r WHERE taken <= 60"""
)
def quota_select(spark, sf):
    """TOP-06: documents have one type each here, so the greedy choice is a ranking."""
    return qs.select_quota(section_candidates(spark, sf), 60)


@query(
    f"""WITH {_SECTIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY gold_section ORDER BY pos) AS n FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY n > 6, CASE WHEN n <= 6 THEN list_position({_listed(qs.SECTION_ORDER)}, gold_section) END, pos) AS taken FROM o)
SELECT doc_id, question_type, gold_section, section_priority, pos FROM r WHERE taken <= 45"""
)
def balanced_select(spark, sf):
    """TOP-07: six of each section, then three more in the candidates' order."""
    return qs.select_balanced(section_candidates(spark, sf), 45, "gold_section", qs.SECTION_ORDER)


@query(
    "SELECT protocol, item_id, nth FROM (SELECT 'low_overlap' AS protocol, item_id, row_number() OVER (ORDER BY (item_id % 10) / 10.0, (item_id % 8 + 1) DESC, item_id) AS nth FROM benchmark UNION ALL SELECT 'hard_negative', item_id, row_number() OVER (ORDER BY (item_id % 8 + 1) DESC, (item_id % 10) / 10.0, item_id) FROM benchmark) WHERE nth <= 20"
)
def protocol_orders(spark, sf):
    """TOP-08: the first 20 of two protocols (a top-k report)."""
    rows = table(spark, sf, "benchmark").select("item_id", F.col("item_id").alias("doc_id"), ((F.col("item_id") % 10) / 10.0).alias("lexical_overlap"), (F.col("item_id") % 8 + 1).alias("n_negatives"))
    out = None
    for name in ("low_overlap", "hard_negative"):
        first = rows.orderBy(*qs.protocol_order(name)).limit(20)
        ids = first.agg(F.collect_list("item_id").alias("ids")).select(F.lit(name).alias("protocol"), F.posexplode("ids").alias("nth", "item_id")).select("protocol", "item_id", (F.col("nth") + 1).cast("long").alias("nth"))
        out = ids if out is None else out.unionByName(ids)
    return out


@query(
    """SELECT 'orders_have_customers' AS name, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*)::VARCHAR AS observed, '0' AS expected FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lines_have_orders', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*)::VARCHAR, '0' FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL SELECT 'line_keys', CASE WHEN count(*) - count(DISTINCT (l_orderkey, l_linenumber)) = 0 THEN 'PASS' ELSE 'FAIL' END, (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::VARCHAR, '0' FROM lineitem
UNION ALL SELECT 'empty_texts', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARN' END, count(*)::VARCHAR, '0' FROM documents WHERE trim(coalesce(text, '')) = ''
UNION ALL SELECT 'labels_vs_documents', CASE WHEN (SELECT count(*) FROM labels) = (SELECT count(*) FROM documents) THEN 'PASS' ELSE 'FAIL' END, (SELECT count(*) FROM labels)::VARCHAR, (SELECT count(*) FROM documents)::VARCHAR
UNION ALL SELECT 'inverted', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*)::VARCHAR, '0' FROM lineitem WHERE l_linenumber > l_quantity"""
)
def dq_checks(spark, sf):
    """DQ-01..04, JN-05, WIN-04."""
    t = lambda n: table(spark, sf, n)
    checks = [
        mr.orphans("orders_have_customers", t("orders").withColumnRenamed("o_custkey", "k"), t("customer").select(F.col("c_custkey").alias("k")), "k"),
        mr.orphans("lines_have_orders", t("lineitem").withColumnRenamed("l_orderkey", "k"), t("orders").select(F.col("o_orderkey").alias("k")), "k"),
        mr.duplicates("line_keys", t("lineitem"), ["l_orderkey", "l_linenumber"]),
        mr.empty_content("empty_texts", t("documents"), "text"),
        mr.same_count("labels_vs_documents", t("labels"), t("documents")),
        mr.inverted_pages("inverted", t("lineitem"), "l_linenumber", "l_quantity"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


@query("SELECT CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, 1::BIGINT AS checks FROM (SELECT count(*) - count(DISTINCT doc_id) AS n FROM documents)")
def dq_roll_up(spark, sf):
    """DQ-05."""
    return mr.roll_up(mr.duplicates("ids", table(spark, sf, "documents"), ["doc_id"]))


def _manifest(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id"), F.when(F.col("doc_id") % 5 == 0, "validation").otherwise("training").alias("split"), F.col("lang").alias("document_type"), F.col("source").alias("source_archive"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_member"), F.octet_length("text").cast("long").alias("file_size"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'training' END AS split, lang AS document_type, source AS source_archive, source || '/' || doc_id AS source_member, strlen(text) AS file_size FROM documents")
def dim_document(spark, sf):
    """MART-01."""
    return mr.dim_document(_manifest(spark, sf))


@query("SELECT doc_id, lang AS title, length(coalesce(text, '')) AS content_chars, length(coalesce(text, '')) = 0 AS is_empty, len(string_split(text, chr(10))) AS page_count, len(string_split(text, chr(10))) AS text_layer_pages, '' AS parse_error FROM documents")
def fact_parse_quality(spark, sf):
    """MART-02."""
    n = F.size(F.split("text", "\n", -1)).cast("long")
    meta = F.struct(n.alias("page_count"), n.alias("text_layer_pages"), F.lit("").alias("parse_error"))
    return mr.fact_parse_quality(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("title"), F.col("text").alias("content"), meta.alias("metadata")))


@query(f"WITH {FIXED} SELECT doc_id, doc_id AS parent_doc_id, 'page' AS chunking_strategy, 1::INT AS page_start, 1::INT AS page_end, length(coalesce(text, '')) AS content_chars FROM documents UNION ALL SELECT chunk_index, doc_id, 'fixed', NULL, NULL, length(content) FROM fixed")
def fact_chunk_quality(spark, sf):
    """MART-03, SET-01: whole texts as pages, and their fixed chunks."""
    d = table(spark, sf, "documents")
    page = d.select("doc_id", F.col("doc_id").alias("parent_doc_id"), F.lit("page").alias("chunking_strategy"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.col("text").alias("content"))
    fixed = ck.fixed_chunks(d).select(F.col("chunk_index").alias("doc_id"), F.col("doc_id").alias("parent_doc_id"), F.lit("fixed").alias("chunking_strategy"), "content")
    return mr.fact_chunk_quality(page, fixed)


@query(
    f"""WITH {PAGES}, {FIXED}, g AS (SELECT item_id, min(d.doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id),
l AS (SELECT doc_id, string_agg(page_num::VARCHAR, '|' ORDER BY page_num) FILTER (WHERE page_num <= 3) AS pages FROM pg GROUP BY doc_id),
kk AS (SELECT doc_id, string_agg(doc_id || '_' || chunk_index, '|' ORDER BY chunk_index) FILTER (WHERE chunk_index < 3) AS chunks FROM fixed GROUP BY doc_id)
SELECT item_id AS query_id, g.doc_id, coalesce(pages, '') AS pages, coalesce(chunks, '') AS chunks FROM benchmark LEFT JOIN g USING (item_id) LEFT JOIN l ON l.doc_id = g.doc_id LEFT JOIN kk ON kk.doc_id = g.doc_id"""
)
def lineage_links(spark, sf):
    """JN-13: question to its first document and up to three of its pages and chunks."""
    from ..operators import builders as bd

    found = gold(spark, sf).groupBy("query_id").agg(F.sort_array(F.collect_list("parent_id")).alias("gold_doc_ids"))
    asked = questions(spark, sf).select("query_id").join(found, "query_id", "left").withColumn("gold_doc_ids", F.coalesce("gold_doc_ids", F.array().cast("array<bigint>")))
    lines = pages(spark, sf).select("doc_id", F.col("page_num").alias("id"), F.col("page_num").alias("pos"))
    chunks = ck.fixed_chunks(table(spark, sf, "documents")).select("doc_id", F.concat_ws("_", "doc_id", "chunk_index").alias("id"), F.col("chunk_index").alias("pos"))
    out = bd.lineage(asked, {"pages": lines, "chunks": chunks})
    return out.select("query_id", "doc_id", F.array_join("pages", "|").alias("pages"), F.array_join("chunks", "|").alias("chunks"))
