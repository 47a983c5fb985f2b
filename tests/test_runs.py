"""Cases that are run, declared retrievers and lineage: pinned facts."""

import json

import pytest
from pyspark.sql import functions as F

from gleanmill.operators import builders as bd
from gleanmill.plans import cases, run


@pytest.fixture(scope="module")
def corpus(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    docs = [(i, " ".join(f"{words[i % 6]} filler{i} text{k % 7}." for k in range(40)) + f"\nThe {words[i % 6]} answer{i} is here.") for i in range(12)]
    asked = [(q, f"answer{q} filler{q}", "fact", "hard" if q % 2 else "", [q], f"The {words[q % 6]} answer{q}") for q in range(4)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string, question_type string, difficulty string, gold_doc_ids array<long>, evidence_text string")


@pytest.mark.parametrize("case_id", ["hybrid_weighted", "granularity_sentence", "graph_1hop_section_rerank", "adaptive_k_score_tail", "hierarchical_sentence_passage_section"])
def test_cases_run(spark, corpus, tmp_path, case_id):
    case = next(c for c in cases.default_cases() if c.case_id == case_id)
    rows = {r.grp: r for r in run.execute(spark, case, *corpus, str(tmp_path), k=3).collect()}
    assert rows["overall"].questions == 4 and rows["difficulty:hard"].questions == 2 and rows["overall"].case_id == case_id
    if case_id != "hierarchical_sentence_passage_section":  # hashed words alone are a weak model
        assert rows["overall"].recall_at_10 >= 0.5 and rows["overall"].p50_latency_ms > 0
    steps = json.loads(spark.read.text(f"{tmp_path}/{case_id}/manifest").first()[0])["steps"]
    assert [s["step_id"] for s in steps] == ["01_chunking", "02_indexing", "03_retrieval", "04_reranking", "05_evaluation"]
    disabled = next(c for c in cases.default_cases() if not c.enabled)
    with pytest.raises(ValueError):
        run.execute(spark, disabled, *corpus, str(tmp_path))


def test_declared_retrievers(spark):
    ranking = spark.createDataFrame([(1, "s1", "p1", "d1", 3.0, 1), (1, "s2", "p1", "d1", 1.0, 2), (1, "s3", "p2", "d1", 0.5, 3), (1, "s4", "p3", "d2", 3.2, 4)], "query_id long, doc_id string, passage string, doc string, score double, rank long")
    got = [(r.doc, r.score) for r in bd.hierarchical(ranking, ["doc_id", "passage", "doc"], "sum").orderBy("rank").collect()]
    assert got == [("d1", 4.5), ("d2", 3.2)] and bd.hierarchical(ranking, ["doc_id", "passage", "doc"]).orderBy("rank").first().doc == "d2"
    parents = spark.createDataFrame([("d1", "text one")], "parent_id string, content string")
    given = {r.parent_id: (r["rank"], r.content) for r in bd.with_parents(ranking.withColumn("parent_id", F.col("doc")), parents).collect()}
    assert given == {"d1": (1, "text one"), "d2": (2, None)}
    gold = spark.createDataFrame([(1, "d2")], "query_id long, parent_id string")
    grid = {r.point: r.mrr for r in bd.parameter_grid({"wide": ranking.select("query_id", F.col("doc").alias("parent_id"), "rank", F.lit(2.0).alias("latency_ms"))}, gold).collect()}
    assert grid == {"wide": 0.25}


def test_retry(spark):
    contents = spark.createDataFrame([("a", "known words here"), ("b", "unrelated matter entirely")], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "known words"), (2, "strange thing"), (3, "nothing found")], "query_id long, text string")
    calls = []

    def search(q):
        calls.append(sorted(r.text for r in q.collect()))
        return q.where("query_id < 3").select("query_id", F.when(F.col("query_id") == 1, "a").otherwise("b").alias("doc_id"), F.lit(1.0).alias("score"), F.lit(1).cast("long").alias("rank"))

    rows = {r.query_id: r.retried for r in bd.retried(asked, search, contents).collect()}
    assert rows == {1: False, 2: True} and calls[1] == ["strange thing unrelated matter entirely"]


def test_lineage(spark):
    asked = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["z"])], "query_id long, gold_doc_ids array<string>")
    pages = spark.createDataFrame([("a", i, i) for i in (4, 1, 3, 2)], "doc_id string, id int, pos int")
    rows = {r.query_id: (r.doc_id, r.pages) for r in bd.lineage(asked, {"pages": pages}).collect()}
    assert rows == {1: ("a", ["1", "2", "3"]), 2: (None, []), 3: ("z", [])}
