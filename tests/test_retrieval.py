"""Rankings, fusion and metrics: pinned facts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanmill import shared
from gleanmill.operators import metrics as mt
from gleanmill.operators import retrieval as rt

RANKED = "query_id long, doc_id string, score double, rank long"


def test_fusion(spark):
    bm25 = spark.createDataFrame([(1, "a", 9.0, 1), (1, "b", 5.0, 2)], RANKED)
    vector = spark.createDataFrame([(1, "b", 0.9, 1), (1, "c", 0.8, 2)], RANKED)
    out = rt.fuse({"bm25": bm25, "vector": vector}).orderBy("rank").collect()
    assert [r.doc_id for r in out] == ["b", "a", "c"] and out[0].source_scores == {"bm25": 5.0, "vector": 0.9}
    tied = rt.fuse({"bm25": bm25.where("doc_id = 'a'"), "vector": vector.where("doc_id = 'b'")}, weights={"bm25": 2.0}).orderBy("rank").collect()
    assert [r.doc_id for r in tied] == ["a", "b"]
    assert [r.doc_id for r in rt.fuse({"bm25": bm25.where("doc_id = 'a'"), "vector": vector.where("doc_id = 'b'")}).orderBy("rank").collect()] == ["a", "b"]
    grid = rt.weight_grid(bm25, vector, [0.5, 2.0]).orderBy("bm25_weight", "rank").collect()
    assert [(r.bm25_weight, r.doc_id) for r in grid if r["rank"] == 1] == [(0.5, "b"), (2.0, "b")]


def test_bm25_prefers_rare_terms_and_ignores_duplicates(spark):
    docs = spark.createDataFrame([(1, "an older text", 1), (2, "common common", 1), (3, "other words", 1), (1, "common rare", 2), (4, None, 1)], "doc_id long, text string, at int")
    asked = spark.createDataFrame([(9, "rare COMMON"), (10, "absent")], "query_id long, text string")
    out = rt.bm25(asked, rt.postings(docs, order="at")).orderBy("rank").collect()
    assert [(r.query_id, r.doc_id) for r in out] == [(9, 1), (9, 2)]


def test_vector_topk_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(60, [0.0] * 8)], "doc_id long, embedding array<float>").repartition(4)
    asked = vectors.where("doc_id < 12").select(F.col("doc_id").alias("query_id"), "embedding")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(q, int(d)) for q in range(12) for d in np.argsort(-(unit @ unit[q]), kind="stable")[:5]}
    assert {(r.query_id, r.doc_id) for r in rt.vector_topk(asked, vectors, 5).collect()} == want
    monkeypatch.setattr(rt, "QUERY_BLOCK", 5)
    assert {(r.query_id, r.doc_id) for r in rt.vector_topk(asked, vectors, 5).collect()} == want
    monkeypatch.setattr(rt, "QUERIES", 5)
    assert {(r.query_id, r.doc_id) for r in rt.vector_topk(asked, vectors, 5).collect()} == want


def test_parent_dedupe_masks_later_pages(spark):
    rows = spark.createDataFrame([(1, "a_1", "a", 9.0, 1, 9, 9), (1, "a_2", "a", 8.0, 2, 3, 4), (1, "b_1", "b", 7.0, 3, 1, 1)], "query_id long, doc_id string, parent_id string, score double, rank long, page_start int, page_end int")
    once = rt.dedupe_parents(rows)
    assert [(r.doc_id, r["rank"]) for r in once.orderBy("rank").collect()] == [("a_1", 1), ("b_1", 2)]
    gold = spark.createDataFrame([(1, "a", [3])], "query_id long, parent_id string, gold_pages array<int>")
    m = mt.per_question(mt.judged(once, gold), hit=True).collect()[0]
    assert (m["rank"], m.recall_at_10) == (0, 0.0)
    gold = gold.withColumn("gold_pages", F.array().cast("array<int>"))
    assert mt.per_question(mt.judged(once, gold)).collect()[0].recall_at_10 == 1.0


def test_metrics(spark):
    rows = spark.createDataFrame([(1, "d3", 1), (1, "d1", 2), (1, "d2", 3)], "query_id long, parent_id string, rank long")
    gold = spark.createDataFrame([(1, "d1"), (1, "d2")], "query_id long, parent_id string")
    j = mt.judged(rows, gold)
    m = mt.per_question(j).collect()[0]
    assert (m["rank"], m.mrr, m.recall_at_10) == (2, 0.5, 1.0)
    assert m.ndcg_at_10 == pytest.approx((1 / np.log2(3) + 1 / np.log2(4)) / (1 + 1 / np.log2(3)), abs=1e-6)
    assert mt.per_question(j, k=1).collect()[0].recall_at_10 == 0.0
    none = mt.per_question(mt.judged(rows, gold.where("query_id = 2"))).collect()[0]
    assert (none.recall_at_10, none.ndcg_at_10, none["rank"]) == (0.0, 0.0, 0)


def test_percentiles(spark):
    df = spark.createDataFrame([(10.0,), (20.0,)], "x double")
    assert df.select(F.percentile("x", F.lit(0.95))).collect()[0][0] == 19.5


def test_summary_grouping_sets(spark):
    rows = spark.createDataFrame([("bm25", "a", 1.0), ("bm25", "b", 0.0)], "method string, question_type string, mrr double")
    assert {(r.grp, r.questions, r.mrr) for r in mt.summary(rows, ["question_type"], ["mrr"]).collect()} == {("overall", 2, 0.5), ("a", 1, 1.0), ("b", 1, 0.0)}


def test_answers(spark):
    df = spark.createDataFrame([(1, "근거는 벡터 검색이다", "근거는 벡터 검색"), (2, "", "x"), (3, "a a b", "a b b")], "pair_id long, answer string, reference string")
    f = {r.pair_id: r.token_f1 for r in mt.token_f1(df).collect()}
    assert f[1] > 0.7 and f[2] == 0.0 and f[3] == pytest.approx(2 / 3, abs=1e-6)
    ctx = spark.createDataFrame([(1, "doc-1", 3, 4, 1, "first"), (1, "doc-1", 3, 4, 2, "again"), (1, "doc-2", 5, 5, 3, "third")], "query_id long, parent_id string, page_start int, page_end int, rank long, content string")
    assert rt.citations(ctx).collect()[0].citations == "parent_doc_id=doc-1, pages=3-4\nparent_doc_id=doc-2, pages=5"
    told = rt.answer(spark.createDataFrame([(1, "why?"), (2, "none?")], "query_id long, question string"), ctx)
    got = {r.query_id: r.answer for r in told.collect()}
    assert "why?" in got[1] and got[1].endswith("pages=5") and "근거" not in got[2]


def test_text_similarity(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("ab", "abcd"), ("", "")], "a string, b string")
    r = [tuple(x.m) for x in df.select(mt.char_similarity(F.col("a"), F.col("b")).alias("m")).collect()]
    assert r[0] == (1.0, 1.0, 1.0) and r[1][0] == 1.0 and r[1][1] == 0.5 and r[2] == (1.0, 1.0, 1.0)
    d = spark.createDataFrame([("ab" * 20,), ("short",)], "t string").select(mt.duplicate_ngrams(F.col("t")).alias("d")).collect()
    assert d[0].d == pytest.approx(1 - 2 / 21) and d[1].d == 0.0
    cov = spark.createDataFrame([("Deep nets a", "deep networks and nets")], "e string, c string").select(mt.evidence_coverage(F.col("e"), F.col("c"))).collect()[0][0]
    assert cov == 1.0


def test_duplicate_windows_of_characters(spark):
    dice = random.Random(3)
    texts = ["".join(dice.choice("ab") for _ in range(n)) for n in (19, 20, 21, 400, 3000)] + ["😀가b" * 9, "😀" * 25, "", None]
    plain = [0.0 if len(t or "") < 20 else 1 - len({t[i : i + 20] for i in range(len(t) - 19)}) / (len(t) - 19) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", mt.duplicate_ngrams(F.col("t")).alias("d")).orderBy("i").collect()
    assert [r.d for r in rows] == plain
    for n in (1, 2, 3, 7, 20, 33):
        codes = np.arange(100, dtype=np.uint32) % 10
        assert len(np.unique(mt._window_hashes(codes, n))) == 10 and len(mt._window_hashes(codes, n)) == 101 - n


def test_search_scores_documents_in_their_rows(spark, monkeypatch):
    dice = random.Random(5)
    text = lambda n: " ".join(dice.choice("abcdefgh") for _ in range(n))
    docs = spark.createDataFrame([((i % 7, i // 7), text(i % 30)) for i in range(700)] + [((9, i), "a b a") for i in range(20)], "doc_id struct<p:int,q:int>, text string").repartition(5)
    asked = spark.createDataFrame([(i, text(1 + i % 6)) for i in range(40)] + [(98, "nowhere"), (99, None)], "query_id long, text string")
    told = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    found = rt.search(asked, docs, 7, dedupe=False)
    by_postings = told(rt.bm25(asked, rt.postings(docs, dedupe=False), 7))
    assert told(found) == by_postings and len(by_postings) == 280
    assert "HashAggregate" not in found._jdf.queryExecution().toString()  # pairs of queries and documents are not gathered
    standing = rt.bm25(asked, shared.cut(rt.postings(docs, dedupe=False), "standing"), 7)
    assert told(standing) == by_postings and "sum(" not in standing._jdf.queryExecution().toString()
    monkeypatch.setattr(rt, "FEW_WORDS", 2)
    assert told(rt.search(asked, docs, 7, dedupe=False)) == by_postings


def test_blocks_hold_all_queries(monkeypatch):
    of, place, weights = np.array([2, 0, 1, 0, 2]), np.array([0, 1, 2, 3, 1]), np.arange(1.0, 6)
    whole = np.zeros((4, 3))
    whole[place, of] = weights
    for cells in (1, 6, 100):
        monkeypatch.setattr(rt, "_CELLS", cells)
        got = np.zeros((4, 3))
        for queries, at, matrix in rt._blocks(of, place, weights, 4):
            got[np.ix_(at >= 0, queries)] = matrix[at[at >= 0]]
        assert (got == whole).all()
