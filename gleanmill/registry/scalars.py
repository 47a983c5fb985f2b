"""Queries on the remaining scalar functions and small relational operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import builders as bd
from ..operators import chunking as ck
from ..operators import documents as dc
from ..operators import marts as mr
from ..operators import questions as qs
from .base import query, table
from .chunks import PAGES, pages
from .texts import clean_sql, logs


def _one_of(id_: str, *values: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(id_) % len(values) + 1).cast("int"))


@query(
    """WITH c AS (SELECT event_id, ['High ', 'low', 'In-Progress', '<b>critical</b>', 'Un known'][event_id % 5 + 1] AS said,
 CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE 'not a time' END AS told, ts FROM events)
SELECT event_id, CASE lower(trim(said)) WHEN 'high' THEN 'high' WHEN 'low' THEN 'low' WHEN '<b>critical</b>' THEN 'critical' ELSE 'unknown' END AS priority,
 CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN strftime(ts, '%Y-%m-%d 00:00:00') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM c"""
)
def choices_and_times(spark, sf):
    """FN-03, FN-04."""
    e = table(spark, sf, "events")
    i = F.col("event_id") % 4
    told = F.when(i == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(i == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(i == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("not a time")
    said = _one_of("event_id", "High ", "low", "In-Progress", "<b>critical</b>", "Un known")
    return e.select("event_id", tx.normalize_choice(said, tx.PRIORITIES).alias("priority"), F.date_format(tx.lenient_timestamp(told), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS line_md5, md5(lower(regexp_replace(text, '[^0-9A-Za-z가-힣]', '', 'g'))) AS matching_md5 FROM documents")
def matching_text(spark, sf):
    """FN-11, FN-12."""
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.collapse(F.col("text"))).alias("line_md5"), F.md5(tx.for_matching(F.col("text"))).alias("matching_md5"))


@query(
    r"""WITH p AS (SELECT doc_id, source || '/ST-' || doc_id || ' é_' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE (1950 + doc_id % 100)::VARCHAR END AS name, CASE WHEN doc_id % 2 = 0 THEN 'x_OC2_1_AB-1_' || doc_id || ' (2)' ELSE 'plain ' || doc_id END AS stem FROM documents)
SELECT doc_id, 'paper_' || substr(regexp_replace(regexp_replace(name, '[^0-9A-Za-z가-힣]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 140) AS stable_id, regexp_extract(name, '((19|20)\d{2})', 1) AS year, CASE WHEN doc_id % 2 = 0 THEN 'OC2_1_AB-1_' || doc_id ELSE stem END AS document_id FROM p"""
)
def paper_names(spark, sf):
    """FN-10, FN-14, FN-15."""
    i = F.col("doc_id")
    name = F.concat("source", F.lit("/ST-"), i.cast("string"), F.lit(" é_"), F.when(i % 3 == 0, "").otherwise((i % 100 + 1950).cast("string")))
    stem = F.when(i % 2 == 0, F.concat(F.lit("x_OC2_1_AB-1_"), i.cast("string"), F.lit(" (2)"))).otherwise(F.concat(F.lit("plain "), i.cast("string")))
    return table(spark, sf, "documents").select("doc_id", tx.stable_doc_id(name).alias("stable_id"), tx.publication_year(name).alias("year"), tx.document_id(stem).alias("document_id"))


@query(
    r"""WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\n+|\[#\]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')), lambda x: length(x) >= 80) AS parts FROM documents),
u AS (SELECT doc_id, parts[i] AS x, i FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)),
b AS (SELECT doc_id, arg_max(x, struct_pack(n := length(x), i := -i)) FILTER (WHERE length(x) <= 900) AS fits, arg_max(x, struct_pack(n := length(x), i := -i)) AS longest FROM u GROUP BY doc_id)
SELECT p.doc_id, md5(coalesce(fits, substr(longest, 1, 900), substr(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 1, 900))) AS segment_md5 FROM p LEFT JOIN b USING (doc_id)"""
)
def evidence_segments(spark, sf):
    """FN-35."""
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.evidence_segment(F.col("text"))).alias("segment_md5"))


_KINDS = list(bd.FALLBACK_QUESTIONS)
_TOPICS = list(bd.TOPIC_QUESTIONS)
_listed = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(
    f"""SELECT doc_id, coalesce(CASE WHEN doc_id % 7 < 6 THEN {_listed(bd.FALLBACK_QUESTIONS.values())}[doc_id % 7 + 1] END, {_listed([bd.FALLBACK_QUESTIONS['summary']])}[1]) AS fallback,
 coalesce(CASE WHEN doc_id % 7 < 6 THEN {_listed(bd.TOPIC_QUESTIONS.values())}[doc_id % 7 + 1] END, {_listed([bd.TOPIC_QUESTIONS['section']])}[1]) AS topic,
 coalesce(CASE WHEN doc_id % 7 < 6 THEN {_listed(bd.LOW_OVERLAP_QUESTIONS.values())}[doc_id % 7 + 1] END, {_listed([bd.LOW_OVERLAP_QUESTIONS['section']])}[1]) AS low_overlap FROM documents"""
)
def question_templates(spark, sf):
    """FN-36."""
    kind, topic = _one_of("doc_id", *_KINDS, "other"), _one_of("doc_id", *_TOPICS, "other")
    return table(spark, sf, "documents").select("doc_id", bd.by_kind(kind, bd.FALLBACK_QUESTIONS, "summary").alias("fallback"), bd.by_kind(topic, bd.TOPIC_QUESTIONS, "section").alias("topic"), bd.by_kind(topic, bd.LOW_OVERLAP_QUESTIONS, "section").alias("low_overlap"))


@query("SELECT doc_id, doc_id % 5 = 4 OR (doc_id % 4 + 1 BETWEEN doc_id % 3 + 1 AND doc_id % 3 + 1 + doc_id % 2) AS meets FROM documents")
def page_overlaps(spark, sf):
    """FN-39, JN-11: gold pages against a result's pages; no gold page meets all."""
    i = F.col("doc_id")
    pages_ = F.when(i % 5 == 4, F.array().cast("array<int>")).otherwise(F.array((i % 4 + 1).cast("int")))
    return table(spark, sf, "documents").select("doc_id", tx.page_overlap(pages_, i % 3 + 1, i % 3 + 1 + i % 2).alias("meets"))


@query(
    """SELECT doc_id, md5(CASE WHEN length(text) > 900 THEN rtrim(substr(text, 1, 897), ' ') || '...' ELSE text END) AS clip_900, md5(CASE WHEN length(text) > 180 THEN rtrim(substr(text, 1, 177), ' ') || '...' ELSE text END) AS clip_180,
 CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN source ELSE '' END AS preferred, CASE WHEN doc_id % 6 = 5 THEN 1.0 ELSE least(greatest((doc_id % 13 - 1) / greatest(doc_id % 11, 1), 0.0), 1.0) END::DOUBLE AS ratio FROM documents"""
)
def clips_and_choices(spark, sf):
    """FN-42, FN-43, FN-44."""
    i = F.col("doc_id")
    first = F.when(i % 3 == 0, F.col("lang")).when(i % 3 == 1, " ")
    second = F.when(i % 3 == 1, F.col("source"))
    start = F.when(i % 6 != 5, (i % 13 - 1).cast("string")).otherwise("none")
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.clip(t, 900)).alias("clip_900"), F.md5(tx.clip(t, 180)).alias("clip_180"), tx.preferred(first, second).alias("preferred"), tx.position_ratio(start, i % 11).alias("ratio"))


@query(
    r"""WITH w AS (SELECT doc_id, w[i] AS x, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_-]{4,}') AS w FROM documents))),
f AS (SELECT doc_id, lower(x) AS low, min(i) AS i, arg_min(x, i) AS x FROM w GROUP BY ALL),
t AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f) WHERE n <= 6 GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(www\.|http|\[provider:|download by ip)')) AS l FROM documents)
SELECT l.doc_id, coalesce(topics, '') AS topics, md5(substr(array_to_string(l, ' '), 1, 800)) AS evidence_md5 FROM l LEFT JOIN t USING (doc_id)"""
)
def topics_and_evidence(spark, sf):
    """FN-30, FN-31."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(tx.topic_words(F.col("text")), " ").alias("topics"), F.md5(tx.clean_evidence(F.col("text"))).alias("evidence_md5"))


_LOGS = f"""r AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE event_id || CASE event_id % 3 WHEN 0 THEN ' ERROR ' WHEN 1 THEN ' warn ' ELSE ' note ' END || event_type END AS raw, CASE WHEN event_id % 5 = 0 THEN 'ui' ELSE '' END AS component FROM events),
s AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN '' ELSE raw || ' <b>x</b>' END AS message, lower(regexp_extract(raw, '(?i)\\b(INFO|WARN|WARNING|ERROR|ERR|FATAL|ALERT)\\b', 1)) AS word FROM r),
v AS (SELECT event_id, component, CASE word WHEN '' THEN 'unknown' WHEN 'warn' THEN 'warning' WHEN 'warning' THEN 'warning' WHEN 'err' THEN 'error' WHEN 'fatal' THEN 'error' ELSE word END AS severity, {clean_sql("CASE WHEN trim(message) <> '' THEN message ELSE raw END")} AS content FROM s),
log_docs AS (SELECT 'log_ev_' || event_id AS doc_id, 'WEB ' || severity || ' log' AS title, content, {clean_sql("concat_ws(' ', 'system: web', CASE WHEN severity <> 'unknown' THEN 'severity: ' || severity END, CASE WHEN component <> '' THEN 'component: ' || component END, 'log message: ' || content)")} AS embedding_text, severity FROM v WHERE content <> '')"""


@query(f"WITH {_LOGS} SELECT * FROM log_docs")
def log_documents(spark, sf):
    """FN-09."""
    return dc.log_documents(logs(spark, sf)).select("doc_id", "title", "content", "embedding_text", "severity")


@query(
    """WITH p AS (SELECT u.conv_id, u.turn, list_distinct(regexp_extract_all(lower(u.text), '[0-9A-Za-z가-힣]+')) AS a, list_distinct(regexp_extract_all(lower(r.text), '[0-9A-Za-z가-힣]+')) AS b FROM conversations u JOIN conversations r ON u.conv_id = r.conv_id AND r.turn = u.turn + 1)
SELECT conv_id, turn, len(list_intersect(a, b)) AS common FROM p"""
)
def common_words(spark, sf):
    """SET-03: words that a turn shares with the next one."""
    c = table(spark, sf, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.array_intersect(tx.word_set(F.col("text")), tx.word_set(F.col("next")))).cast("long").alias("common"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def unlabelled_ids(spark, sf):
    """SET-06."""
    return mr.without(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT item_id AS query_id FROM benchmark WHERE item_id % 3 <> 0")
def unanswered(spark, sf):
    """JN-15: questions that an earlier run has not answered."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    return qs.unanswered(asked, asked.where("query_id % 3 = 0").unionByName(asked.where("query_id % 6 = 0")))


@query(f"WITH {PAGES}, g AS (SELECT doc_id, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY page_num)) AS h FROM pg WHERE doc_id % 4 <> 1 GROUP BY doc_id) SELECT doc_id, coalesce(n, 0) AS pages, coalesce(h, md5('')) AS text_md5 FROM documents LEFT JOIN g USING (doc_id)")
def documents_with_pages(spark, sf):
    """JN-02: documents without pages have none."""
    rows = ck.with_pages(table(spark, sf, "documents").select("doc_id"), pages(spark, sf).where("doc_id % 4 <> 1"))
    return rows.select("doc_id", F.size("pages").cast("long").alias("pages"), F.md5(F.array_join(F.transform("pages", lambda p: p["text"]), "\n")).alias("text_md5"))


@query(
    """SELECT doc_id, md5('문서 제목: ' || lang || chr(10) || '문서 유형: ' || source || chr(10) || '발행처: ' || chr(10) || '섹션: a > b' || chr(10) || chr(10) || text) AS context_md5,
 md5(concat_ws(chr(10), text, CASE WHEN doc_id % 3 > 0 THEN array_to_string(list_transform(range(1, least(doc_id % 3 * 30, 40) + 1), lambda i: 'e' || i), chr(10)) END)) AS bm25_md5 FROM documents"""
)
def chunk_texts(spark, sf):
    """CHK-07, CHK-14."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("title"), F.col("source").alias("document_type"), F.lit(None).cast("string").alias("publisher"), F.lit("a > b").alias("section_path"), F.col("text").alias("content"))
    n = (F.col("doc_id") % 3 * 30).cast("int")
    kept = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("e"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    told = d.withColumn("bm25", ck.bm25_text(F.col("content"), kept))
    return ck.with_context(told).select("doc_id", F.md5("content").alias("context_md5"), F.md5("bm25").alias("bm25_md5"))


@query(
    f"""WITH {PAGES}, o AS (SELECT doc_id, page_num, lower(regexp_replace(text, '[^0-9A-Za-z가-힣]', '', 'g')) AS t FROM pg)
SELECT doc_id, page_num::INT AS page_num, md5(t) AS oracle_md5, md5(CASE WHEN page_num % 5 = 0 THEN '' ELSE t END) AS parsed_md5 FROM o"""
)
def page_pairs(spark, sf):
    """JN-03: labelled pages with what was parsed; every fifth page was not."""
    p = pages(spark, sf)
    rows = bd.parsing_evaluation(p, p.where("page_num % 5 <> 0"))
    return rows.select("doc_id", "page_num", F.md5("oracle").alias("oracle_md5"), F.md5("parsed").alias("parsed_md5"))


@query("SELECT lang AS profile, count(*) AS rows, round(avg(doc_id % 10 / 10.0), 6)::DOUBLE AS avg_noise_before, round(avg(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE doc_id % 10 / 20.0 END), 6)::DOUBLE AS avg_noise_after, round(avg(doc_id % 4 / 4.0), 6)::DOUBLE AS avg_sentence_break_before, round(avg(doc_id % 3 / 4.0), 6)::DOUBLE AS avg_sentence_break_after, sum(doc_id % 6)::BIGINT AS preserved_elements FROM documents GROUP BY lang")
def reconstruction_summary(spark, sf):
    """AGG-12: missing figures count as 0."""
    i = F.col("doc_id")
    figures = {"noise_score_before": i % 10 / 10.0, "noise_score_after": F.when(i % 7 != 0, i % 10 / 20.0), "sentence_boundary_break_before": i % 4 / 4.0, "sentence_boundary_break_after": i % 3 / 4.0, "preserved_element_count": i % 6}
    return bd.reconstruction_summary(table(spark, sf, "documents").select(F.col("lang").alias("profile"), *[c.alias(n) for n, c in figures.items()]))


@query("SELECT count(*) AS questions, round(avg(conv_id % 2), 6)::DOUBLE AS gold_in_context, round(avg(turn % 3 / 4.0), 6)::DOUBLE AS token_f1, quantile_cont(length(text)::DOUBLE, 0.5) AS p50, quantile_cont(length(text)::DOUBLE, 0.95) AS p95 FROM conversations")
def answer_summary(spark, sf):
    """AGG-16."""
    rows = table(spark, sf, "conversations").select((F.col("conv_id") % 2).cast("double").alias("gold_in_context"), (F.col("turn") % 3 / 4.0).alias("token_f1"), F.length("text").cast("double").alias("latency_ms"))
    return bd.answer_summary(rows, ["gold_in_context", "token_f1"])


@query("SELECT lang AS chunking_strategy, 'documents' AS index_name, count(*) AS indexed_count FROM documents GROUP BY lang")
def fact_indexing_result(spark, sf):
    """MART-04: counts that an indexing run reports on the driver."""
    counts = table(spark, sf, "documents").groupBy("lang").count().collect()  # one row a strategy
    return mr.fact_indexing_result(spark, [(r["lang"], "documents", r["count"]) for r in counts])
