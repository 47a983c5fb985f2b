"""Queries on retrieval, fusion and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking as ck
from ..operators import metrics as mt
from ..operators import retrieval as rt
from .base import query, table
from .chunks import FIXED


def questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(source: str, name: str, k: int, text: str = "text", id_: str = "doc_id", asked: str = "benchmark") -> str:
    words = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
    return rf"""
{name}_t AS (SELECT {id_} AS doc_id, {words.format(text)} AS w FROM {source}),
{name}_p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM {name}_t) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {name}_t),
{name}_q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({words.format('text')}) AS term FROM {asked}) GROUP BY ALL),
{name}_r AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS score
  FROM {name}_q JOIN {name}_p USING (term) JOIN {name}_df USING (term), {name}_s GROUP BY ALL),
{name} AS (SELECT query_id, doc_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_r QUALIFY rank <= {k})"""


@query(f"WITH {_bm25('documents', 'b', 10)} SELECT * FROM b")
def bm25_topk(spark, sf):
    """RET-01, WIN-01."""
    return rt.search(questions(spark, sf), table(spark, sf, "documents"), dedupe=False)


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def asked_vectors(spark, sf):
    return vectors(spark, sf).where("doc_id % 25 = 0").select(F.col("doc_id").alias("query_id"), "embedding", "label")


def _vector(name: str, k: int, where: str = "true") -> str:
    return f"""{name}_s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, q.label AS q_label, v.label AS label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS score FROM embeddings q, embeddings v WHERE q.vec_id % 25 = 0 AND {where}),
{name} AS (SELECT query_id, doc_id, q_label, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_s QUALIFY rank <= {k})"""


@query(f"WITH {_vector('v', 10)} SELECT query_id, doc_id, score, rank FROM v")
def vector_topk(spark, sf):
    """RET-02."""
    return rt.vector_topk(asked_vectors(spark, sf), vectors(spark, sf))


@query(f"WITH {_vector('v', 10, 'v.label = 3')} SELECT query_id, doc_id, score, rank FROM v")
def vector_topk_filtered(spark, sf):
    """RET-08: the filter lies below the top k."""
    return rt.vector_topk(asked_vectors(spark, sf), vectors(spark, sf).where("label = 3"))


def two_rankings(spark, sf, k=50):
    """BM25 and vectors over the same documents: those that have a vector. Questions are passages, with the vector of their id."""
    v = vectors(spark, sf)
    asked = questions(spark, sf).join(F.broadcast(v.select(F.col("doc_id").alias("query_id"), "embedding")), "query_id") if v.count() <= rt.FEW_WORDS else questions(spark, sf).join(v.select(F.col("doc_id").alias("query_id"), "embedding"), "query_id")
    docs = table(spark, sf, "documents")
    known = docs.join(v.select("doc_id"), "doc_id", "left_semi")
    return rt.search(asked.select("query_id", "text"), known, k, dedupe=False), rt.vector_topk(asked.select("query_id", "embedding"), v.join(docs.select("doc_id"), "doc_id", "left_semi"), k)


_HYBRID = f"""known AS (SELECT * FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)), {_bm25('known', 'x', 50, asked='(SELECT * FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings))')},
v_s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS score FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND v.vec_id IN (SELECT doc_id FROM documents)),
v AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM v_s QUALIFY rank <= 50)"""


@query(
    f"""WITH {_HYBRID},
u AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS s, rank AS seen FROM x UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank), 1000000 + rank FROM v),
f AS (SELECT query_id, doc_id, round(sum(s), 9)::DOUBLE AS score, min(seen) AS seen FROM u GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM f QUALIFY rank <= 10"""
)
def rrf_hybrid(spark, sf):
    """RET-05, RET-06, JN-12, TOP-01, TOP-02."""
    lexical, near = two_rankings(spark, sf)
    return rt.fuse({"bm25": lexical, "vector": near}).drop("source_scores")


@query(
    f"""WITH {_HYBRID}, w AS (SELECT unnest([0.6, 0.7, 0.8, 0.9])::DOUBLE AS w),
u AS (SELECT w AS bm25_weight, query_id, doc_id, w / (60 + rank) AS s, rank AS seen FROM x, w UNION ALL SELECT w, query_id, doc_id, 1.0::DOUBLE / (60 + rank), 1000000 + rank FROM v, w),
f AS (SELECT bm25_weight, query_id, doc_id, round(sum(s), 9) AS score, min(seen) AS seen FROM u GROUP BY ALL)
SELECT bm25_weight, query_id, doc_id, score, row_number() OVER (PARTITION BY bm25_weight, query_id ORDER BY score DESC, seen) AS rank FROM f QUALIFY rank <= 10"""
)
def weighted_grid(spark, sf):
    """RET-07."""
    lexical, near = two_rankings(spark, sf)
    return rt.weight_grid(lexical, near, [0.6, 0.7, 0.8, 0.9])


def chunk_ranking(spark, sf, k=50):
    """BM25 over fixed chunks: the flagship path up to parent dedupe. A chunk is named by its document and its number."""
    docs = table(spark, sf, "documents")
    chunks = ck.fixed_chunks(docs).select(F.struct(F.col("doc_id").alias("parent_id"), "chunk_index").alias("doc_id"), F.col("content").alias("text"))
    return rt.search(questions(spark, sf), chunks, k, dedupe=False).select("query_id", "doc_id.*", "score", "rank")


_CHUNKS = f"{FIXED}, chunks AS (SELECT {{'parent_id': doc_id, 'chunk_index': chunk_index}} AS doc_id, content AS text FROM fixed), {_bm25('chunks', 'c', 50)}"
_DEDUPED = f"""{_CHUNKS}, o AS (SELECT query_id, doc_id.parent_id AS parent_id, doc_id.chunk_index AS chunk_index, score, rank FROM c),
e AS (SELECT query_id, parent_id, chunk_index, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS again FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) = 1)),
d AS (SELECT query_id, parent_id, chunk_index, score, again AS rank FROM e WHERE again <= 10)"""


@query(f"WITH {_DEDUPED} SELECT query_id, parent_id, chunk_index, score, rank FROM d")
def parent_dedupe(spark, sf):
    """WIN-02, TOP-03."""
    return rt.dedupe_parents(chunk_ranking(spark, sf)).select("query_id", "parent_id", "chunk_index", "score", "rank")


def gold(spark, sf):
    """JN-10: documents that contain a passage."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("parent_id"), F.col("text").alias("body"))
    return rt.containing(questions(spark, sf).withColumnRenamed("text", "passage"), docs)


_GOLD = "gold AS (SELECT item_id AS query_id, d.doc_id AS parent_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"WITH {_GOLD} SELECT query_id, parent_id FROM gold")
def evidence_containment(spark, sf):
    """JN-04, JN-10, AGG-14."""
    return gold(spark, sf)


_METRICS = f"""{_DEDUPED}, {_GOLD}, g AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY query_id),
j AS (SELECT d.query_id, d.rank, gold.parent_id IS NOT NULL AS relevant, coalesce(n_gold, 0) AS n_gold FROM d LEFT JOIN gold ON d.query_id = gold.query_id AND d.parent_id = gold.parent_id LEFT JOIN g ON g.query_id = d.query_id),
m AS (SELECT query_id, any_value(n_gold) AS n_gold, min(rank) FILTER (WHERE relevant) AS first, count_if(relevant AND rank <= 5) AS h5, count_if(relevant AND rank <= 10) AS hk, sum(CASE WHEN relevant THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) AS n FROM j GROUP BY query_id),
per AS (SELECT query_id, coalesce(first, 0)::BIGINT AS rank, CASE WHEN n_gold = 0 THEN 0.0 ELSE h5 / n_gold END::DOUBLE AS recall_at_5, CASE WHEN n_gold = 0 THEN 0.0 ELSE hk / n_gold END::DOUBLE AS recall_at_10, coalesce(1 / first, 0.0)::DOUBLE AS mrr,
 round(CASE WHEN n_gold = 0 THEN 0.0 ELSE dcg / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))) END, 6)::DOUBLE AS ndcg_at_10, round(hk / greatest(n, 1), 6)::DOUBLE AS context_precision_at_10, (hk > 0)::INT::DOUBLE AS context_recall FROM m)"""


def evaluated(spark, sf):
    return mt.per_question(mt.judged(rt.dedupe_parents(chunk_ranking(spark, sf)), gold(spark, sf)))


@query(f"WITH {_METRICS} SELECT * FROM per")
def retrieval_metrics(spark, sf):
    """MET-01..03, MET-05, MET-06, JN-11, WIN-07."""
    return evaluated(spark, sf)


@query(
    f"""WITH {_METRICS}, t AS (SELECT 'bm25' AS method, 'type' || (query_id % 3) AS question_type, * FROM per)
SELECT method, CASE WHEN grouping(question_type) = 0 THEN question_type ELSE 'overall' END AS grp, count(*) AS questions, round(avg(recall_at_10), 6) AS recall_at_10, round(avg(mrr), 6) AS mrr, round(avg(ndcg_at_10), 6) AS ndcg_at_10
FROM t GROUP BY GROUPING SETS ((method), (method, question_type))"""
)
def retrieval_summary(spark, sf):
    """AGG-01: the flagship query."""
    rows = evaluated(spark, sf).withColumns({"method": F.lit("bm25"), "question_type": F.concat(F.lit("type"), (F.col("query_id") % 3).cast("string"))})
    return mt.summary(rows, ["question_type"], ["recall_at_10", "mrr", "ndcg_at_10"])


@query(
    f"""WITH {_bm25('documents', 'b', 10)}, t AS (SELECT b.query_id, lower(string_agg(d.text, ' ' ORDER BY rank)) AS ctx FROM b JOIN documents d USING (doc_id) GROUP BY b.query_id),
e AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')), ' '), lambda x: length(x) > 1)) AS terms FROM benchmark)
SELECT query_id, CASE WHEN len(terms) = 0 THEN 0.0 ELSE round(len(list_filter(terms, lambda x: contains(ctx, x))) / len(terms), 6) END::DOUBLE AS coverage FROM e JOIN t USING (query_id)"""
)
def evidence_coverage(spark, sf):
    """MET-08."""
    top = bm25_topk(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    ctx = top.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("x")).select("query_id", F.array_join(F.transform("x", lambda r: r["text"]), " ").alias("ctx"))
    return questions(spark, sf).join(ctx, "query_id").select("query_id", mt.evidence_coverage(F.col("text"), F.col("ctx")).alias("coverage"))


@query(
    """WITH p AS (SELECT u.conv_id * 1000 + u.turn AS pair_id, lower(u.text) AS a, lower(r.text) AS b FROM conversations u JOIN conversations r ON u.conv_id = r.conv_id AND r.turn = u.turn + 1 WHERE u.role = 'user' AND r.role = 'assistant'),
x AS (SELECT pair_id, t, count(*) AS n FROM (SELECT pair_id, unnest(regexp_extract_all(a, '[0-9A-Za-z가-힣]+')) AS t FROM p) GROUP BY ALL), y AS (SELECT pair_id, t, count(*) AS n FROM (SELECT pair_id, unnest(regexp_extract_all(b, '[0-9A-Za-z가-힣]+')) AS t FROM p) GROUP BY ALL),
s AS (SELECT coalesce(x.pair_id, y.pair_id) AS pair_id, sum(least(coalesce(x.n, 0), coalesce(y.n, 0))) AS c, sum(x.n) AS a, sum(y.n) AS r FROM x FULL JOIN y ON x.pair_id = y.pair_id AND x.t = y.t GROUP BY 1)
SELECT pair_id, round(CASE WHEN s.c > 0 THEN 2 * (s.c / s.a) * (s.c / s.r) / (s.c / s.a + s.c / s.r) ELSE 0.0 END, 6)::DOUBLE AS token_f1 FROM p LEFT JOIN s USING (pair_id)"""
)
def token_f1(spark, sf):
    """MET-09, SET-05: a user's words against the next assistant turn."""
    c = table(spark, sf, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("answer"))
    r = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return mt.token_f1(u.join(r, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "answer", "reference"))


@query("SELECT event_type, quantile_cont(value, 0.5)::DOUBLE AS p50, quantile_cont(value, 0.95)::DOUBLE AS p95 FROM events GROUP BY event_type")
def percentile_interp(spark, sf):
    """AGG-04."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95"))


@query(
    "SELECT event_type, l[n // 2 + 1] AS p50, l[least(round_even(n * 0.95, 0), n - 1)::BIGINT + 1] AS p95_round, l[floor((n - 1) * 0.95)::BIGINT + 1] AS p95_floor FROM (SELECT event_type, list_sort(list(value)) AS l, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)"
)
def percentile_index(spark, sf):
    """AGG-05, AGG-06."""
    return mt.pick_by_index(table(spark, sf, "events"), "event_type", "value", {"p50": "half", "p95_round": "round", "p95_floor": "floor"})


@query(
    r"""WITH g AS (SELECT item_id, b.text AS q, d.doc_id, d.text AS e FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
o AS (SELECT *, list_distinct(regexp_extract_all(lower(q), '[0-9A-Za-z가-힣]+')) AS a, list_distinct(regexp_extract_all(lower(e), '[0-9A-Za-z가-힣]+')) AS b,
 list_distinct(list_filter(regexp_split_to_array(q, '\s+'), lambda x: length(x) > 1)) AS qa, list_distinct(list_filter(regexp_split_to_array(e, '\s+'), lambda x: length(x) > 1)) AS qb FROM g)
SELECT item_id AS query_id, doc_id AS parent_id, round(len(list_intersect(a, b)) / greatest(len(a), 1), 6)::DOUBLE AS office, round(CASE WHEN len(qa) = 0 OR len(qb) = 0 THEN 0.0 ELSE len(list_intersect(qa, qb)) / len(qa) END, 6)::DOUBLE AS spaces FROM o"""
)
def lexical_overlap(spark, sf):
    """FN-28, FN-29."""
    g = gold(spark, sf).join(questions(spark, sf), "query_id").join(table(spark, sf, "documents").select(F.col("doc_id").alias("parent_id"), F.col("text").alias("e")), "parent_id")
    return g.select("query_id", "parent_id", F.round(tx.overlap_office(F.col("text"), F.col("e")), 6).alias("office"), F.round(tx.overlap_spaces(F.col("text"), F.col("e")), 6).alias("spaces"))


@query(None)
def char_similarity(spark, sf):
    """MET-11: each benchmark passage against the whole document that ranks first for it."""
    top = bm25_topk(spark, sf).where("rank = 1").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    rows = top.select("query_id", tx.for_matching(F.col("text")).alias("parsed")).join(questions(spark, sf), "query_id")
    m = mt.char_similarity(F.col("parsed"), tx.for_matching(F.col("text")))
    return rows.select("query_id", m.alias("m")).select("query_id", F.round("m.precision", 6).alias("precision"), F.round("m.recall", 6).alias("recall"), F.round("m.similarity", 6).alias("similarity"))


@query(None)
def bootstrap_ci(spark, sf):
    """AGG-07: event values by type."""
    return mt.bootstrap(table(spark, sf, "events").where("value is not null"), "event_type", "value")


@query(
    f"""WITH {_bm25('documents', 'b', 5)}, {_GOLD},
c AS (SELECT query_id, string_agg('parent_doc_id=' || doc_id || ', pages=1', chr(10) ORDER BY rank) AS cited, list(doc_id::VARCHAR ORDER BY doc_id) AS ids FROM b GROUP BY query_id),
a AS (SELECT q.item_id AS query_id, 'According to the context: ' || trim(regexp_extract(q.text, '(?s)(?:.*Question: )?(.*)', 1), chr(10) || ' ') || CASE WHEN cited <> '' THEN chr(10) || chr(10) || '근거:' || chr(10) || cited ELSE '' END AS answer, coalesce(ids, []) AS ids FROM benchmark q LEFT JOIN c ON c.query_id = q.item_id),
g AS (SELECT query_id, list(parent_id::VARCHAR ORDER BY parent_id) AS golds FROM gold GROUP BY query_id)
SELECT a.query_id, answer, (len(list_filter(ids, lambda x: contains(answer, x))) > 0)::INT::DOUBLE AS cites_context, (contains(answer, '확인할 수 없습니다') OR contains(answer, '확인할 수는 없습니다') OR contains(answer, '근거가 부족'))::INT::DOUBLE AS unsupported_answer, (trim(answer) <> '')::INT::DOUBLE AS non_empty,
 (len(list_intersect(ids, coalesce(golds, []))) > 0)::INT::DOUBLE AS gold_in_context, (coalesce(golds[1], '') <> '' AND contains(answer, coalesce(golds[1], '')))::INT::DOUBLE AS cites_gold, length(answer) AS answer_chars FROM a LEFT JOIN g ON a.query_id = g.query_id"""
)
def rag_mock(spark, sf):
    """RET-09, RET-10, MET-10, MET-12, SET-04: mock answers over the five best documents, judged."""
    asked = questions(spark, sf)
    top = rt.search(asked, table(spark, sf, "documents"), 5, dedupe=False).join(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    ctx = top.select("query_id", F.col("doc_id").alias("parent_id"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), "rank", "content")
    told = rt.answer(asked.select("query_id", F.col("text").alias("question")), ctx)
    named = lambda df, name: df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.col("parent_id"))).alias(name))
    rows = told.join(named(ctx, "ids"), "query_id", "left").join(named(gold(spark, sf), "golds"), "query_id", "left")
    ids, golds = (F.coalesce(c, F.array().cast("array<bigint>")) for c in ("ids", "golds"))
    return rows.select("query_id", "answer", *[c.alias(n) for n, c in mt.grounded(F.col("answer"), ids, golds).items()])
