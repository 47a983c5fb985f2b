"""Question sets, negatives, selection: pinned facts."""

import pytest
from pyspark.sql import functions as F

from gleanmill.operators import questions as qs

ROW = "pos long, question string, reference_answer string, evidence_text string, gold_doc_ids array<string>, gold_pages array<int>, lexical_overlap double, hard_negative_doc_ids array<string>, gold_section string, review_flags array<string>"


def row(pos, question="What is shown here?", answer="an answer", evidence="e" * 300, docs=("d1",), pages=(1,), overlap=0.3, negatives=5, section="method", flags=()):
    return (pos, question, answer, evidence, list(docs), list(pages), overlap, [f"n{i}" for i in range(negatives)], section, list(flags))


def test_office_review(spark):
    rows = [row(1), row(2, "what IS  shown here?"), row(3, "No mark", answer="x", overlap=0.0), row(4, "", docs=()), row(5, "Short evidence?", evidence="e" * 79), row(6, None, None, None, (), (), None)]
    out = {r.pos: r for r in qs.review_office(spark.createDataFrame(rows, ROW)).collect()}
    assert out[1].review_status == "approved" and out[1].review_flags == []
    assert out[2].auto_reject_reasons == ["duplicate_question"] and out[2].review_status == "rejected"
    assert out[3].review_status == "approved" and out[3].review_flags == ["very_short_answer", "question_mark_missing", "low_lexical_overlap"]
    assert out[4].auto_reject_reasons == ["missing_question", "missing_gold_doc_ids"]
    assert out[5].auto_reject_reasons == ["too_short_evidence"]
    assert out[6].auto_reject_reasons == ["missing_question", "missing_reference_answer", "missing_evidence", "missing_gold_doc_ids", "missing_gold_pages"]
    fallback = qs.review_office(spark.createDataFrame(rows[:1], ROW), ("What is",)).collect()[0]
    assert fallback.auto_reject_reasons == ["fallback_question_template"]


def test_rejected_first_occurrence_claims_the_key(spark):
    out = {r.pos: r.review_status for r in qs.review_office(spark.createDataFrame([row(1, docs=()), row(2)], ROW)).collect()}
    assert out == {1: "rejected", 2: "rejected"}


def test_paper_review_and_promotion(spark):
    rows = [row(1), row(2, "Other question?", section="abstract", overlap=0.1), row(3, "Third?", docs=()), row(4, "A fourth question of some length?", flags=("kept_flag",))]
    reviewed = qs.review_papers(spark.createDataFrame(rows, ROW))
    out = {r.pos: r for r in reviewed.collect()}
    assert out[1].review_status == "approved_auto_review"
    assert out[2].review_status == "manual_review" and out[2].review_flags == ["abstract_based", "low_lexical_overlap"]
    assert out[3].review_status == "rejected" and out[4].review_flags == ["kept_flag"]
    kept = {r.pos: (r.review_status, r.requires_human_review) for r in qs.promote(reviewed).collect()}
    assert kept == {1: ("approved_auto_review", False), 2: ("approved_provisional_review", True), 4: ("approved_provisional_review", True)}


def test_hard_negatives_equal_brute_force(spark):
    docs = [(i, f"f{i % 4}", [f"t{i % 7}", f"t{i % 5}", f"u{i % 3}"]) for i in range(80)]
    out = qs.hard_negatives(spark.createDataFrame(docs, "doc_id long, field string, topics array<string>"), 6).collect()
    for i, f, t in docs:
        want = sorted(((3 * (f == g) + len(set(t) & set(u)), -j) for j, g, u in docs if j != i), reverse=True)
        want = [(s, -j) for s, j in want if s > 0][:6]
        assert [(r.score, r.negative_id) for r in sorted(out, key=lambda r: r.nth) if r.doc_id == i] == want


def test_group_negatives(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else "b") for i in range(8)], "doc_id long, k string")
    out = {}
    for r in qs.group_negatives(df, ["k"]).orderBy("doc_id", "nth").collect():
        out.setdefault(r.doc_id, []).append(r.negative_id)
    assert out[0] == [1, 2, 3] and out[5] == [0, 1, 2] and out[6] == [7]


def test_stratified_and_subset(spark):
    df = spark.createDataFrame([(i, f"type{i % 2}") for i in range(6)], "doc_id long, t string")
    assert [r.t for r in qs.round_robin(df, "t", [F.col("doc_id")], 4).collect()] == ["type0", "type1", "type0", "type1"]
    docs = spark.createDataFrame([("neg_1", "n1"), ("neg_2", "n2"), ("z_gold", "g")], "doc_id string, parent_id string")
    out = qs.eval_subset(docs, spark.createDataFrame([("g",)], "doc_id string"), 2).collect()
    assert [r.doc_id for r in out] == ["z_gold", "neg_1"]


def test_selection(spark):
    assert qs.targets(10) == {"summary": 2, "purpose": 2, "method": 2, "result": 2, "conclusion": 1, "section": 1} and sum(qs.targets(13).values()) == 13
    kinds = list(qs.QUOTAS)
    cands = spark.createDataFrame([(d, kinds[k], kinds[k], k, 10 * d + k) for d in range(40) for k in range(6)], "doc_id long, question_type string, gold_section string, section_priority long, pos long")
    out = qs.select_quota(cands, 20).collect()
    assert len(out) == 20 == len({r.doc_id for r in out})
    for kind, goal in qs.targets(20).items():
        assert sum(r.question_type == kind for r in out) == goal
    few = qs.select_quota(cands.where("doc_id < 5"), 20).collect()
    assert len(few) == 5 == len({r.doc_id for r in few})
    even = qs.select_balanced(cands, 12, "gold_section", kinds).collect()
    assert len(even) == 12 == len({r.doc_id for r in even}) and {sum(r.gold_section == k for r in even) for k in kinds} == {2}


def test_summaries(spark):
    rows = spark.createDataFrame([row(1, overlap=0.1), row(2, overlap=0.6, negatives=1)], ROW).withColumns({"difficulty": F.lit("hard"), "review_status": F.lit("rejected")})
    s = qs.qaset_summary(rows).collect()[0]
    assert (s.questions, s.mean_overlap, s.low_overlap_ratio, s.high_overlap_ratio, s.min_negatives, s.rejected_ratio) == (2, 0.35, 0.5, 0.5, 1, 1.0)
    d = qs.discrimination(spark.createDataFrame([("bm25", "overall", 0.75, 0.5), ("vector", "overall", 0.25, 0.5), ("bm25", "x", 0.9, 0.9)], "method string, grp string, recall_at_10 double, mrr double")).collect()[0]
    assert d.spread == 0.5 and d.bm25_vector_gap == 0.5


@pytest.mark.parametrize("name", ["hard_negative", "low_overlap", "late_evidence", "section_balanced", "balanced"])
def test_protocol_orders_exist(spark, name):
    df = spark.createDataFrame([(1, 2, 0.5, 0.5, "abstract")], "doc_id long, n_negatives int, lexical_overlap double, page_position_ratio double, gold_section string")
    assert df.orderBy(*qs.protocol_order(name)).count() == 1
