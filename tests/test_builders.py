"""Builders of question sets, evaluation rows and declared retrievers."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gleanmill.operators import builders as bd


@pytest.fixture(scope="module")
def candidates(spark):
    docs = spark.createDataFrame([(i, f"Paper {i}", 10, "science", [f"topic{i % 3}", "shared"]) for i in range(8)], "doc_id long, title string, page_count int, field string, topics array<string>")
    body = "Method words about measuring things carefully. " * 8
    rows = [(i, k, kind, page, page + 1, "" if kind == "references" else f"{kind} {i} {body}") for i in range(8) for k, (kind, page) in enumerate([("abstract", 1), ("method", 6), ("result", 9), ("references", 10)])]
    sections = spark.createDataFrame(rows, "doc_id long, section_index long, section_type string, page_start int, page_end int, text string")
    return bd.section_rows(docs, sections).cache()


def test_section_rows(candidates):
    rows = candidates.collect()
    assert len(rows) == 24 and {r.question_type for r in rows} == {"summary", "method", "result"}
    m = next(r for r in rows if r.doc_id == 3 and r.gold_section == "method")
    assert m.gold_pages == [6, 7] and m.page_position_ratio == 0.6 and len(m.hard_negative_doc_ids) == 7 and m.question.startswith("For ")
    assert "abstract_based" in next(r for r in rows if r.gold_section == "abstract").review_flags


def test_selection_and_protocols(candidates):
    assert len({r.doc_id for r in bd.paper_questions(candidates, 6).collect()}) == 6
    assert {r.gold_section for r in bd.one_section_each(candidates).collect()} == {"method"}
    for name in bd.PROTOCOLS:
        rows = bd.protocol(candidates, name, 3).collect()
        assert len(rows) == 3 == len({r.doc_id for r in rows}) and sorted(r.question_id for r in rows)[0] == f"{name}_0001"
    low = bd.protocol(candidates, "low_overlap", 3).collect()
    assert all("Item" in r.question and r.lexical_overlap < 0.55 for r in low)
    late = bd.protocol(candidates, "late_evidence", 6).collect()  # one of each type that there is, then the latest
    first = candidates.groupBy("question_type").agg(F.max("page_position_ratio").alias("r")).collect()
    assert {(r.question_type, r.r) for r in first} <= {(r.question_type, r.page_position_ratio) for r in late}
    assert [r.question_type for r in bd.protocol(candidates, "late_evidence", 1).collect()] == ["summary"]
    with pytest.raises(ValueError):
        bd.protocol(candidates, "none")


def test_golden_and_validation(spark):
    docs = spark.createDataFrame([(i, "law" if i % 2 else "news", "P") for i in range(6)], "doc_id long, document_type string, publisher string")
    pages = spark.createDataFrame([(i, p, "x" * (50 + 40 * p)) for i in range(6) for p in (1, 2)], "doc_id long, page_num int, content string")
    rows = bd.golden_candidates(docs, pages, 4).orderBy("question_id").collect()
    assert [r.question_id for r in rows] == [f"office_q_000{k}" for k in (1, 2, 3, 4)] and all(r.gold_pages == [2] and len(r.hard_negative_doc_ids) == 2 for r in rows)
    assert [r.question_type for r in rows] == ["fact", "procedure", "comparison", "numeric"]
    d = spark.createDataFrame([(f"t{i}", "ticket" if i < 5 else "log", "T", "c " * 300) for i in range(7)], "doc_id string, source_type string, title string, content string")
    v = bd.validation_set(d, 3, 1).collect()
    assert sorted(r.source_type for r in v) == ["log", "ticket", "ticket", "ticket"] and all(len(r.question) <= 242 for r in v)


def test_chunk_and_answer_evaluation(spark):
    chunks = spark.createDataFrame([("d", "The whole evidence text is in here", 1, 2), ("d", "", 3, 3)], "parent_id string, content string, page_start int, page_end int")
    q = spark.createDataFrame([(1, ["d"], [2], "evidence text"), (2, ["d"], [9], "evidence text that breaks off"), (3, ["x"], [1], "")], "query_id long, gold_doc_ids array<string>, gold_pages array<int>, evidence_text string")
    r = bd.chunk_evaluation(chunks, q).collect()[0]
    assert (r.questions, r.gold_containment_rate, r.gold_page_coverage, r.fragmentation_proxy, r.chunks, r.empty_chunk_rate) == (2, 0.5, 0.5, 0.5, 2, 0.5)
    p = bd.parsing_evaluation(spark.createDataFrame([("d", 1, "A b"), ("d", 2, "c")], "doc_id string, page_num int, text string"), spark.createDataFrame([("d", 1, "a-b")], "doc_id string, page_num int, text string"))
    assert {(x.page_num, x.oracle, x.parsed) for x in p.collect()} == {(1, "ab", "ab"), (2, "c", "")}
    rows = spark.createDataFrame([(1.0, 10.0), (0.0, 20.0)], "f1 double, latency_ms double")
    s = bd.answer_summary(rows, ["f1"]).collect()[0]
    assert (s.f1, s.p95) == (0.5, 19.5) and bd.answer_summary(rows.limit(0), ["f1"]).collect()[0].f1 == 0.0
    a = bd.length_audit(spark.createDataFrame([("page", "a b"), ("page", "a b c d")], "unit string, text string"), 3).collect()[0]
    assert (a["min"], a["max"], a.over) == (2, 4, 1)


def test_model_windows(spark):
    content = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    df = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again"), (2, None)], "doc_id long, text string")
    rows = bd.model_windows(df, content, 5, 1).orderBy("chunk_index").collect()
    assert [(r.token_start, r.token_end) for r in rows][:2] == [(0, 5), (4, 9)] and rows[0].content == "the quick brown fox jumps"


def test_declared_retrievers(spark):
    ranking = spark.createDataFrame([(1, f"c{k}", f"p{k % 2}", s, k + 1) for k, s in enumerate([10.0, 9.0, 8.0, 6.0, 1.0])], "query_id long, doc_id string, parent_id string, score double, rank long")
    assert [r.doc_id for r in bd.adaptive_k(ranking, 2).orderBy("rank").collect()] == ["c0", "c1", "c2", "c3"]
    assert [(r.parent_id, r.score) for r in bd.parent_scores(ranking, "sum").orderBy("rank").collect()] == [("p0", 19.0), ("p1", 15.0)]
    boosted = bd.soft_boost(ranking, spark.createDataFrame([(1, "c1", 2)], "query_id long, doc_id string, n_fields int")).orderBy("rank").first()
    assert boosted.doc_id == "c1" and boosted.score == 10.8
    edges = bd.section_edges(spark.createDataFrame([(7, 0, "a"), (7, 1, "a"), (7, 2, "b")], "doc_id long, section_index long, section_type string"))
    assert {(r.src, r.dst, r.edge_type) for r in edges.collect()} >= {("7_0", "7_1", "adjacent"), ("7_1", "7_2", "section_transition"), ("7_0", "7", "parent")}
    near = spark.createDataFrame([("c4", "c0")], "src string, dst string")
    assert {r.doc_id: r.score for r in bd.graph_rerank(ranking, near).collect()}["c4"] == 6.0
    assert edges.where(F.col("src") == F.col("dst")).count() == 0
