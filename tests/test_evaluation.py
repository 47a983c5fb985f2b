"""Evaluation loops, summaries and picks: pinned facts and plain versions."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gleanmill import registry
from gleanmill.operators import builders as bd
from gleanmill.operators import marts as mr
from gleanmill.operators import metrics as mt
from gleanmill.operators import retrieval as rt


def test_picks_equal_sorted_lists(spark):
    rng = random.Random(1)
    groups = {g: [rng.choice([rng.randint(0, 5), rng.random()]) * 1.0 for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 19), ("d", 20), ("e", 500))} | {None: [3.0] * 50 + [1.0]}
    df = spark.createDataFrame([(g, v) for g, xs in groups.items() for v in xs] + [("a", None)], "g string, v double").repartition(5)
    got = {r.g: (r.half, r.round, r.floor) for r in mt.pick_by_index(df, "g", "v", {h: h for h in ("half", "round", "floor")}).collect()}
    for g, xs in groups.items():
        xs = sorted(xs)
        n = len(xs)
        assert got[g] == (xs[n // 2], xs[min(round(n * 0.95), n - 1)], xs[int((n - 1) * 0.95)])


def test_bootstrap_interval(spark):
    rng = random.Random(2)
    xs = [float(rng.random() < 0.3) for _ in range(400)]
    df = spark.createDataFrame([("x", v) for v in xs] + [("y", 5.0)] * 3 + [(None, 1.0), (None, 2.0)], "g string, v double")
    a, b = ({r.grp: r for r in mt.bootstrap(d, "g", "v").collect()} for d in (df.repartition(1), df.repartition(7)))
    assert a == b and set(a) == {"x", "y", None}  # partitions don't matter
    mean = statistics.fmean(xs)
    spread = 1.96 * math.sqrt(mean * (1 - mean) / len(xs))
    assert a["x"].mean == pytest.approx(mean) and abs(a["x"].low - (mean - spread)) < 0.012 and abs(a["x"].high - (mean + spread)) < 0.012
    assert (a["y"].mean, a["y"].low, a["y"].high) == (5.0, 5.0, 5.0)


ROW = "method string, question_type string, recall_at_5 double, recall_at_10 double, mrr double, ndcg_at_10 double, context_precision_at_10 double, context_recall double, latency_ms double"


def test_office_summary(spark):
    rows = [("bm25", "fact", 1.0, 1.0, 0.5, 0.6, 0.1, 1.0, 10.0), ("bm25", "fact", 0.0, 1.0, 0.2, 0.4, 0.1, 1.0, 20.0), ("bm25", None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 30.0), ("vector", "fact", 1.0, 1.0, 1.0, 1.0, 0.1, 1.0, 5.0)]
    got = {(r.method, r.grp): r for r in mt.office_summary(spark.createDataFrame(rows, ROW)).collect()}
    assert set(got) == {("bm25", "overall"), ("bm25", "fact"), ("bm25", "unknown"), ("vector", "overall"), ("vector", "fact")}
    whole = got["bm25", "overall"]
    assert (whole.questions, whole.recall_at_10, whole.p50_latency_ms, whole.p95_latency_ms) == (3, pytest.approx(2 / 3, abs=1e-6), 20.0, 30.0)
    assert whole.recall_at_10_ci_low <= whole.recall_at_10 <= whole.recall_at_10_ci_high
    report = mr.retrieval_report(mt.office_summary(spark.createDataFrame(rows, ROW)))
    assert "| bm25 | overall | 3 |" in report and report.startswith("# Retrieval")


def test_case_details_and_summary(spark):
    asked = spark.createDataFrame([(1, "a", "hard", [10, 11], "deep net works"), (2, "b", "", [99], "none at all"), (3, "a", None, [], "")], "query_id long, question_type string, difficulty string, gold_doc_ids array<long>, evidence_text string")
    ranked = [(1, 1, 12, "12_0", 1, 1, "s", "first text"), (1, 2, 10, "10_3", 3, 4, None, "a deep  net"), (1, 3, 10, "10_1", 1, 1, "s", "again"), (1, 4, 11, "11_0", 5, None, "t", "x" * 300)]
    ranking = spark.createDataFrame(ranked, "query_id long, rank long, parent_id long, chunk_id string, page_start int, page_end int, section_id string, content string")
    rows = {r.query_id: r for r in mt.evaluate_case(asked, ranking).collect()}
    one = rows[1]
    assert (one["rank"], one.mrr, one.recall_at_5, one.retrieved_doc_ids, one.retrieved_chunk_ids) == (2, 0.5, 1.0, "12|10|11", "12_0|10_3|11_0")
    assert one.retrieved_pages == "1|3-4|5" and one.retrieved_section_ids == "s||t" and one.retrieved_snippets == "first text || a deep net || " + "x" * 180
    assert one.gold_evidence_in_retrieved_context == round(2 / 3, 6) and one.context_precision_at_10 == round(2 / 3, 6)
    assert (rows[2]["rank"], rows[2].recall_at_10, rows[2].retrieved_doc_ids) == (0, 0.0, "") and rows[3].gold_evidence_in_retrieved_context == 0.0
    told = mt.evaluate_case(asked, ranking).withColumns({"case_id": F.lit("c"), "method": F.lit("m"), "latency_ms": F.col("query_id") * 1.0})
    got = {r.grp: r.questions for r in mt.case_summary(told).collect()}
    assert got == {"overall": 3, "a": 2, "b": 1, "difficulty:hard": 1}


def test_methods_over_all_questions(spark):
    ranking = spark.createDataFrame([(1, "a_1", "a", 3.0, 1, 4.0), (1, "a_2", "a", 2.0, 2, 4.0), (1, "b_1", "b", 1.0, 3, 4.0)], "query_id long, doc_id string, parent_id string, score double, rank long, latency_ms double")
    gold = spark.createDataFrame([(1, "b"), (2, "z")], "query_id long, parent_id string")
    r = mt.evaluate_answers(ranking, gold, match_parent=True).collect()[0]
    assert (r.questions, r.recall_at_10, r.mrr, r.p50_latency_ms) == (2.0, 0.5, 0.25, 4.0)
    none = mt.evaluate_answers(ranking, gold.limit(0)).collect()[0]
    assert (none.questions, none.mrr) == (1.0, 0.0)
    timed = mt.timed(lambda q: ranking.drop("latency_ms").join(q, "query_id"), spark.createDataFrame([(1,)], "query_id long"))
    assert timed.count() == 3 and timed.first().latency_ms > 0


def test_rank_summary(spark):
    rows = spark.createDataFrame([("t", 1, None, 2, 100), ("t", 11, 3, None, 300), ("u", None, 20, 1, 200)], "kind string, bm25_rank int, vector_rank int, hybrid_rank int, gold_content_len int")
    got = {(r.group_key, r.grp): r for r in mt.rank_summary(rows, ["kind"]).collect()}
    t = got["kind", "t"]
    assert (t.questions, t.median_gold_content_len, t.bm25_recall_at_10, t.bm25_mrr, t.vector_miss_at_10) == (2, 200.0, 0.5, round((1 + 1 / 11) / 2, 6), 1)
    assert got["kind", "u"].vector_miss_at_10 == 1


def test_answers_and_parsing(spark):
    df = spark.createDataFrame([("see 7 and 9", [7, 8], [9]), ("근거가 부족합니다", [9], [9]), ("", [], [])], "answer string, ids array<long>, golds array<long>")
    flags = mt.grounded(F.col("answer"), F.col("ids"), F.col("golds"))
    got = [tuple(r) for r in df.select(*[flags[k].alias(k) for k in ("cites_context", "unsupported_answer", "non_empty", "gold_in_context", "cites_gold", "answer_chars")]).collect()]
    assert got == [(1.0, 0.0, 1.0, 0.0, 1.0, 11), (0.0, 1.0, 1.0, 1.0, 0.0, 9), (0.0, 0.0, 0.0, 0.0, 0.0, 0)]
    failed = spark.createDataFrame([("x", "timeout"), ("x", None)], "a string, e string").select(mt.unsupported(F.col("a"), F.col("e")).alias("u")).collect()
    assert [r.u for r in failed] == [1.0, 0.0]
    ctx = spark.createDataFrame([(1, "a", 1, 2), (2, "a", 5, 6)], "query_id long, parent_id string, page_start int, page_end int")
    gold = spark.createDataFrame([(1, "a", [2]), (2, "a", [2])], "query_id long, parent_id string, gold_pages array<int>")
    assert {r.query_id: r.gold_in_context for r in mt.context_has_gold(ctx, gold).collect()} == {1: 1.0, 2: 0.0}
    pages = "doc_id string, page_num int, text string"
    oracle = spark.createDataFrame([("d", 1, "Abc def"), ("d", 2, "xyz"), ("d", 3, " - ")], pages)
    parsed = spark.createDataFrame([("d", 1, "abc"), ("d", 9, "no")], pages)
    r = bd.parsing_summary(oracle, parsed).collect()[0]
    assert (r.pages, r.documents, r.skipped_pages, r.character_precision, r.character_recall, r.page_extracted) == (2, 1, 1, 0.5, 0.25, 0.5)
    assert "character_recall: 0.2500" in mr.parsing_report(bd.parsing_summary(oracle, parsed))


def test_long_documents_keep_their_chunks(spark, tmp_path):
    """A document of more than 1,000 chunks beside the next id: its last chunks are its own."""
    text = " ".join(f"t{i % 977}" for i in range(449_400)) + " zebra quartz " + " ".join(f"t{i}" for i in range(100))
    docs = spark.createDataFrame([(5, text, "en", "h", len(text)), (6, "something else", "en", "h", 14)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "zebra quartz")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = registry.QUERIES["parent_dedupe"](spark, str(tmp_path)).collect()
    assert [(r.parent_id, r["rank"]) for r in rows] == [(5, 1)] and rows[0].chunk_index >= 1000


def test_hybrid_filters_both_sides(spark):
    docs = spark.createDataFrame([(1, "red fox", "a"), (2, "red hen", "b"), (3, "blue fox", "a")], "doc_id long, text string, kind string")
    vectors = docs.select("doc_id", "kind", F.array(F.col("doc_id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    asked = spark.createDataFrame([(9, "red", [1.0, 1.0])], "query_id long, text string, embedding array<float>")
    assert [r.doc_id for r in rt.hybrid(asked, docs, vectors).orderBy("rank").collect()][0] == 1
    assert {r.doc_id for r in rt.hybrid(asked, docs, vectors, keep=F.col("kind") == "a").collect()} == {1, 3}
    encoded = rt.encoded(docs, "text", rt.hashed_words(8), "document", batch=2, prefix="passage: ").collect()
    assert all(len(r.embedding) == 8 for r in encoded) and encoded[0].kind == "a"
