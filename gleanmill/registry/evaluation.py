"""Queries on evaluation loops and their summaries, with their SQL.

Three methods rank documents for the passages as questions; documents that contain a passage are gold. Latencies are made
from ids here, as measured ones differ from run to run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import shared
from ..operators import metrics as mt
from ..operators import questions as qs
from ..operators import retrieval as rt
from .base import query, table
from .ranking import _GOLD, _HYBRID, gold, questions, two_rankings

_METHODS = ("bm25", "vector", "hybrid")
_LATENCY = {"bm25": 7, "vector": 11, "hybrid": 13}


def rankings(spark, sf):
    """``method, query_id, parent_id, score, rank`` of the three methods."""
    found = dict(zip(("bm25", "vector"), two_rankings(spark, sf), strict=True))
    found["hybrid"] = rt.fuse(found, 50).drop("source_scores")
    out = None
    for name, df in found.items():
        rows = df.select(F.lit(name).alias("method"), "query_id", F.col("doc_id").alias("parent_id"), "score", "rank")
        out = rows if out is None else out.unionByName(rows)
    return shared.cut(out, "rankings")


_FUSED = """f_u AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS s, rank AS seen FROM x UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank), 1000000 + rank FROM v),
f_s AS (SELECT query_id, doc_id, round(sum(s), 9)::DOUBLE AS score, min(seen) AS seen FROM f_u GROUP BY ALL),
f AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM f_s QUALIFY rank <= 50)"""
_RANKINGS = f"""{_HYBRID}, {_FUSED}, {_GOLD}, ng AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY query_id),
rankings AS (SELECT 'bm25' AS method, query_id, doc_id, score, rank FROM x UNION ALL SELECT 'vector', query_id, doc_id, score, rank FROM v UNION ALL SELECT 'hybrid', query_id, doc_id, score, rank FROM f)"""


def _metrics_sql(k: int = 10, hit: bool = False) -> str:
    recall = lambda h: f"least({h}, 1)" if hit else f"{h} / n_gold"
    return f"""j AS (SELECT r.method, r.query_id, r.doc_id, r.rank, g.parent_id IS NOT NULL AS relevant, coalesce(n_gold, 0) AS n_gold FROM rankings r LEFT JOIN gold g ON r.query_id = g.query_id AND r.doc_id = g.parent_id LEFT JOIN ng ON ng.query_id = r.query_id WHERE rank <= {k}),
m AS (SELECT method, query_id, any_value(n_gold) AS n_gold, min(rank) FILTER (WHERE relevant) AS first, count_if(relevant AND rank <= 5) AS h5, count_if(relevant) AS hk, sum(CASE WHEN relevant THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) AS n FROM j GROUP BY ALL),
per AS (SELECT method, query_id, coalesce(first, 0)::BIGINT AS rank, CASE WHEN n_gold = 0 THEN 0.0 ELSE {recall('h5')} END::DOUBLE AS recall_at_5, CASE WHEN n_gold = 0 THEN 0.0 ELSE {recall('hk')} END::DOUBLE AS recall_at_10, coalesce(1 / first, 0.0)::DOUBLE AS mrr,
 round(CASE WHEN n_gold = 0 THEN 0.0 ELSE dcg / list_sum(list_transform(range(1, least(n_gold, {k}) + 1), lambda i: 1 / log2(i + 1))) END, 6)::DOUBLE AS ndcg_at_10, round(hk / greatest(n, 1), 6)::DOUBLE AS context_precision_at_10, (hk > 0)::INT::DOUBLE AS context_recall FROM m)"""


def _latency(method, query_id):
    return F.when(method == "bm25", query_id * 7 % 50).when(method == "vector", query_id * 11 % 50).otherwise(query_id * 13 % 50).cast("double")


_LATENCY_SQL = "(query_id * CASE method WHEN 'bm25' THEN 7 WHEN 'vector' THEN 11 ELSE 13 END % 50)::DOUBLE"


def _rows(spark, sf):
    """Metrics of each method and question."""
    found, right = rankings(spark, sf), gold(spark, sf)
    out = None
    for name in _METHODS:
        rows = mt.per_question(mt.judged(found.where((F.col("method") == name) & (F.col("rank") <= 10)).drop("method"), right)).withColumn("method", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    kind = F.concat(F.lit("type"), (F.col("query_id") % 3).cast("string"))
    return out.withColumns({"question_type": kind, "latency_ms": _latency(F.col("method"), F.col("query_id"))})


_INDEXED = "l[n // 2 + 1] AS p50_latency_ms, l[least(round_even(n * 0.95, 0), n - 1)::BIGINT + 1] AS p95_latency_ms"
_MEANS = lambda names: ", ".join(f"round(avg({m}), 6)::DOUBLE AS {m}" for m in names)
_OFFICE = f"""{_RANKINGS}, {_metrics_sql()}, t AS (SELECT per.*, 'type' || (query_id % 3) AS question_type, {_LATENCY_SQL} AS latency_ms FROM per),
e AS (SELECT *, unnest(['overall', question_type]) AS grp FROM t),
s AS (SELECT method, grp, count(*) AS n, list_sort(list(latency_ms)) AS l, {_MEANS(mt.OFFICE_METRICS)} FROM e GROUP BY ALL),
office AS (SELECT method, grp, n AS questions, {', '.join(mt.OFFICE_METRICS)}, {_INDEXED} FROM s)"""


@query(f"WITH {_OFFICE} SELECT * FROM office")
def office_summary(spark, sf):
    """AGG-01 without the resampled interval, which SQL can't draw (tests check it)."""
    return mt.office_summary(_rows(spark, sf)).drop("recall_at_10_ci_low", "recall_at_10_ci_high")


@query(f"WITH {_OFFICE} SELECT max(recall_at_10) AS max_recall, min(recall_at_10) AS min_recall, round(max(recall_at_10) - min(recall_at_10), 6)::DOUBLE AS spread, round(avg(recall_at_10), 6)::DOUBLE AS mean_recall, round(avg(mrr), 6)::DOUBLE AS mean_mrr, round(avg(recall_at_10) FILTER (WHERE method = 'bm25') - avg(recall_at_10) FILTER (WHERE method = 'vector'), 6)::DOUBLE AS bm25_vector_gap FROM office WHERE grp = 'overall'")
def retrieval_discrimination(spark, sf):
    """AGG-10 over the summary of the three methods."""
    return qs.discrimination(mt.office_summary(_rows(spark, sf)))


@query(
    f"""WITH {_RANKINGS}, {_metrics_sql()}, q AS (SELECT DISTINCT query_id FROM gold), l AS (SELECT DISTINCT method, query_id, {_LATENCY_SQL} AS latency_ms FROM rankings),
w AS (SELECT unnest(['bm25', 'vector', 'hybrid']) AS method)
SELECT w.method, greatest(count(*), 1)::DOUBLE AS questions, round(avg(coalesce(recall_at_5, 0)), 6)::DOUBLE AS recall_at_5, round(avg(coalesce(recall_at_10, 0)), 6)::DOUBLE AS recall_at_10, round(avg(coalesce(mrr, 0)), 6)::DOUBLE AS mrr, round(avg(coalesce(ndcg_at_10, 0)), 6)::DOUBLE AS ndcg_at_10,
 quantile_cont(latency_ms, 0.5)::DOUBLE AS p50_latency_ms, quantile_cont(latency_ms, 0.95)::DOUBLE AS p95_latency_ms FROM w CROSS JOIN q LEFT JOIN per ON per.method = w.method AND per.query_id = q.query_id LEFT JOIN l ON l.method = w.method AND l.query_id = q.query_id GROUP BY w.method"""
)
def evaluated_methods(spark, sf):
    """MET-04, MET-14: means over all questions with gold, interpolated latency."""
    found, right = rankings(spark, sf), gold(spark, sf)
    found = found.withColumn("latency_ms", _latency(F.col("method"), F.col("query_id"))).withColumnRenamed("parent_id", "doc_id")
    out = None
    for name in _METHODS:
        rows = mt.evaluate_answers(found.where(F.col("method") == name).drop("method"), right).withColumn("method", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


_CASE = f"""{_RANKINGS}, {_metrics_sql(hit=True)},
d AS (SELECT j.query_id, string_agg(j.doc_id::VARCHAR, '|' ORDER BY rank) AS docs, string_agg(j.doc_id || '_0', '|' ORDER BY rank) AS chunks, string_agg(CASE WHEN j.doc_id % 2 = 0 THEN (j.doc_id % 9)::VARCHAR ELSE (j.doc_id % 9) || '-' || (j.doc_id % 9 + 1) END, '|' ORDER BY rank) AS pages, string_agg('s' || (j.doc_id % 4), '|' ORDER BY rank) AS sections,
  string_agg(substr(trim(regexp_replace(t.text, '\\s+', ' ', 'g'), ' '), 1, 180), ' || ' ORDER BY rank) AS snippets, lower(string_agg(t.text, ' ' ORDER BY rank)) AS ctx FROM j JOIN documents t ON t.doc_id = j.doc_id WHERE method = 'bm25' GROUP BY j.query_id),
e AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')), ' '), lambda x: length(x) > 1)) AS terms FROM benchmark),
details AS (SELECT e.query_id, 'type' || (e.query_id % 3) AS question_type, CASE WHEN e.query_id % 4 = 0 THEN '' ELSE 'level' || (e.query_id % 2) END AS difficulty, coalesce(per.rank, 0)::BIGINT AS rank, coalesce(recall_at_5, 0)::DOUBLE AS recall_at_5, coalesce(recall_at_10, 0)::DOUBLE AS recall_at_10, coalesce(mrr, 0)::DOUBLE AS mrr, coalesce(ndcg_at_10, 0)::DOUBLE AS ndcg_at_10, coalesce(context_precision_at_10, 0)::DOUBLE AS context_precision_at_10,
  CASE WHEN len(terms) = 0 THEN 0.0 ELSE round(len(list_filter(terms, lambda x: contains(coalesce(ctx, ''), x))) / len(terms), 6) END::DOUBLE AS gold_evidence_in_retrieved_context, coalesce(docs, '') AS retrieved_doc_ids, coalesce(chunks, '') AS retrieved_chunk_ids, coalesce(pages, '') AS retrieved_pages, coalesce(sections, '') AS retrieved_section_ids, md5(coalesce(snippets, '')) AS snippets_md5
  FROM e LEFT JOIN per ON per.query_id = e.query_id AND per.method = 'bm25' LEFT JOIN d ON d.query_id = e.query_id)"""


def _details(spark, sf):
    asked, right = questions(spark, sf), gold(spark, sf).groupBy("query_id").agg(F.collect_list("parent_id").alias("gold_doc_ids"))
    i = F.col("query_id")
    told = asked.join(right, "query_id", "left").select(
        "query_id", F.concat(F.lit("type"), (i % 3).cast("string")).alias("question_type"), F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("level"), (i % 2).cast("string"))).alias("difficulty"), F.coalesce("gold_doc_ids", F.array().cast("array<bigint>")).alias("gold_doc_ids"), F.col("text").alias("evidence_text")
    )
    p = F.col("parent_id")
    ranking = rankings(spark, sf).where("method = 'bm25'").join(table(spark, sf, "documents").select(F.col("doc_id").alias("parent_id"), F.col("text").alias("content")), "parent_id")
    ranking = ranking.withColumns({"chunk_id": F.concat(p.cast("string"), F.lit("_0")), "page_start": p % 9, "page_end": p % 9 + p % 2, "section_id": F.concat(F.lit("s"), (p % 4).cast("string"))})
    return mt.evaluate_case(told, ranking)


@query(f"WITH {_CASE} SELECT * FROM details")
def case_details(spark, sf):
    """MET-07."""
    return _details(spark, sf).withColumn("snippets_md5", F.md5("retrieved_snippets")).drop("retrieved_snippets")


@query(
    f"""WITH {_CASE}, c AS (SELECT *, 'case' || (query_id % 2) AS case_id, (query_id * 7 % 50)::DOUBLE AS latency_ms FROM details),
g AS (SELECT *, unnest(list_filter(['overall', question_type, CASE WHEN difficulty <> '' THEN 'difficulty:' || difficulty END], lambda x: x IS NOT NULL)) AS grp FROM c),
s AS (SELECT case_id, 'bm25' AS method, grp, count(*) AS n, list_sort(list(latency_ms)) AS l, {_MEANS(mt.CASE_METRICS)} FROM g GROUP BY ALL)
SELECT case_id, method, grp, n AS questions, {', '.join(mt.CASE_METRICS)}, {_INDEXED} FROM s"""
)
def case_summary(spark, sf):
    """AGG-02: no group for questions without a difficulty."""
    i = F.col("query_id")
    rows = _details(spark, sf).withColumns({"case_id": F.concat(F.lit("case"), (i % 2).cast("string")), "method": F.lit("bm25"), "latency_ms": _latency(F.lit("bm25"), i)})
    return mt.case_summary(rows)


@query(
    f"""WITH {_RANKINGS}, q AS (SELECT query_id, min(parent_id) AS gold_id FROM gold GROUP BY query_id),
d AS (SELECT q.query_id, 'type' || (q.query_id % 3) AS source_type, CASE WHEN n < 250 THEN '<250' WHEN n < 500 THEN '250-499' WHEN n < 1000 THEN '500-999' WHEN n < 2000 THEN '1000-1999' ELSE '>=2000' END AS gold_len_bucket, n AS len, x.rank AS b, v.rank AS c, f.rank AS h
  FROM q JOIN (SELECT doc_id, length(text) AS n FROM documents) t ON t.doc_id = gold_id LEFT JOIN x ON x.query_id = q.query_id AND x.doc_id = gold_id LEFT JOIN v ON v.query_id = q.query_id AND v.doc_id = gold_id LEFT JOIN f ON f.query_id = q.query_id AND f.doc_id = gold_id),
g AS (SELECT 'source_type' AS group_key, source_type AS grp, * FROM d UNION ALL SELECT 'gold_len_bucket', gold_len_bucket, * FROM d)
SELECT group_key, grp, count(*) AS questions, median(len)::DOUBLE AS median_gold_content_len, {', '.join(f"round(avg((coalesce({c}, 99) <= 10)::INT), 6)::DOUBLE AS {m}_recall_at_10, round(avg(coalesce(1 / {c}, 0)), 6)::DOUBLE AS {m}_mrr" for m, c in zip(_METHODS, 'bch'))}, count_if(coalesce(c, 99) > 10)::BIGINT AS vector_miss_at_10 FROM g GROUP BY ALL"""
)
def rank_summary(spark, sf):
    """AGG-03, FN-34, MET-13: ranks of a question's first gold document by method, in two groupings."""
    from ..functions import text as tx

    first = gold(spark, sf).groupBy("query_id").agg(F.min("parent_id").alias("parent_id"))
    sizes = table(spark, sf, "documents").select(F.col("doc_id").alias("parent_id"), F.length("text").alias("gold_content_len"))
    ranks = rankings(spark, sf).groupBy("query_id", "parent_id").agg(*[F.min(F.when(F.col("method") == m, F.col("rank"))).alias(f"{m}_rank") for m in _METHODS])
    rows = first.join(sizes, "parent_id").join(ranks, ["query_id", "parent_id"], "left")
    rows = rows.withColumns({"source_type": F.concat(F.lit("type"), (F.col("query_id") % 3).cast("string")), "gold_len_bucket": tx.length_bucket(F.col("gold_content_len"))})
    return mt.rank_summary(rows, ["source_type", "gold_len_bucket"])
