"""Running a case's plan (PLAN-02): its steps as DataFrame stages, each written to the case's folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import builders as bd
from ..operators import chunking as ck
from ..operators import metrics as mt
from ..operators import retrieval as rt
from . import cases as cs

#: Chunks that a page or section is cut into where a profile does not say otherwise.
BUDGET, OVERLAP = 512, 64


def chunk(case: cs.Case, docs: DataFrame) -> DataFrame:
    """``parent_id, chunk_index, content`` by the case's chunking profile; skipped profiles take fixed windows."""
    how, parameters = cs.profile("chunking", case.chunking)
    size, overlap = parameters.get("token_budget", parameters.get("max_tokens", parameters.get("child_tokens", BUDGET))), parameters.get("overlap", OVERLAP)
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line")).withColumn("page_num", F.lit(1))
    if how in ("sentence_pack", "paragraph_pack", "multi_granularity_tree", "child_passage_parent_section"):
        out = ck.packed_units(docs.select("doc_id", "text"), size, "sentence" if how == "sentence_pack" else "passage")
    elif how in ("paper_section_pack", "section_edge_builder"):
        out = ck.section_chunks(ck.sections(lines), docs, size, overlap)
    else:
        out = ck.fixed_chunks(docs, size, overlap)
    return out.select(F.col("doc_id").alias("parent_id"), "chunk_index", "content")


def retrieve(case: cs.Case, chunks: DataFrame, index: DataFrame, vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """``query_id, doc_id, score, rank`` by the case's retriever profile, k for each question. ``questions``: query_id, text, embedding."""
    how, parameters = cs.profile("retriever", case.retriever)
    wide = max(parameters.get("candidate_k", 0), k)
    if how in ("dense_vector", "dense_child_then_parent_aggregate", "dense_child_parent_context", "ann_parameter_grid"):
        return rt.vector_topk(questions, vectors, k)
    lexical = rt.bm25(questions.select("query_id", "text"), index, wide)
    near = rt.vector_topk(questions, vectors, wide)
    weights = {"bm25": parameters["bm25_weight"], "vector": parameters["vector_weight"]} if how == "bm25_dense_weighted" else None
    fused = rt.fuse({"bm25": lexical, "vector": near}, wide, parameters.get("rrf_k", rt.RRF_K), weights).drop("source_scores")
    if how == "score_tail_adaptive_k":
        return bd.adaptive_k(fused, parameters["min_k"], parameters["max_k"])
    return fused.where(F.col("rank") <= k)


def rerank(case: cs.Case, ranking: DataFrame) -> DataFrame:
    """The ranking by the case's reranker profile: chunks of a parent share its score, or neighbours lift each other."""
    how, _ = cs.profile("reranker", case.reranker)
    if how == "parent_score_aggregation":
        scores = bd.parent_scores(ranking).select("query_id", "parent_id", F.col("score").alias("_score"))
        return rt.ranked(ranking.drop("rank").join(scores, ["query_id", "parent_id"]).withColumn("score", F.col("_score")).drop("_score"))
    if how == "one_hop_graph_rerank":
        node = ranking.select("doc_id", "parent_id", "chunk_index").distinct()
        after = node.select(F.col("doc_id").alias("dst"), "parent_id", (F.col("chunk_index") - 1).alias("chunk_index"))
        return bd.graph_rerank(ranking, node.join(after, ["parent_id", "chunk_index"]).select(F.col("doc_id").alias("src"), "dst"))
    return ranking


def execute(spark: SparkSession, case: cs.Case, docs: DataFrame, questions: DataFrame, folder: str, encode: rt.Encoder | None = None, k: int = 10) -> DataFrame:
    """PLAN-02: run a case and give its summary (AGG-02); chunks, index, details, summary and manifest are in ``folder``.

    ``docs``: doc_id, text; ``questions``: query_id, text, question_type, difficulty, gold_doc_ids, evidence_text. Five
    times k chunks are fetched, as parents come once each. ``encode`` is a model; without one hashed words stand in.
    """
    if not case.enabled:
        raise ValueError(f"{case.case_id}: {case.reason}")
    encode = encode or rt.hashed_words()
    steps = cs.plan(case, folder)
    at = f"{folder}/{case.case_id}"
    named = F.concat_ws("__", "parent_id", F.lpad(F.col("chunk_index").cast("string"), 6, "0"))
    chunk(case, docs).withColumn("doc_id", named).write.mode("overwrite").parquet(f"{at}/chunks")
    chunks = spark.read.parquet(f"{at}/chunks")
    rt.postings(chunks.withColumnRenamed("content", "text"), dedupe=False).write.mode("overwrite").parquet(f"{at}/postings")
    rt.encoded(chunks.select("doc_id", "content"), "content", encode, "document").select("doc_id", "embedding").write.mode("overwrite").parquet(f"{at}/vectors")
    index, vectors = (spark.read.parquet(f"{at}/{name}") for name in ("postings", "vectors"))
    asked = rt.encoded(questions.select("query_id", "text"), "text", encode, "query")
    found = mt.timed(lambda q: retrieve(case, chunks, index, vectors, q, 5 * k), asked)
    ranking = found.join(chunks, "doc_id").withColumns({"chunk_id": F.col("doc_id"), "page_start": F.lit(1), "page_end": F.lit(1), "section_id": F.lit("")})
    latency = found.groupBy("query_id").agg(F.max("latency_ms").alias("latency_ms"))
    details = mt.evaluate_case(questions, rerank(case, ranking), k).join(latency, "query_id", "left").withColumns({"case_id": F.lit(case.case_id), "method": F.lit(case.retriever)})
    details.write.mode("overwrite").parquet(f"{at}/details")
    mt.case_summary(spark.read.parquet(f"{at}/details")).write.mode("overwrite").parquet(f"{at}/summary")
    manifest = {"case_id": case.case_id, "registry": cs.registry_hash(cs.default_cases()), "namespace": case.namespace, "steps": [{"step_id": s.step_id, "profile": s.profile, "implementation": s.implementation, "parameters": s.parameters, "status": "skipped" if s.status == "skipped" else "done"} for s in steps]}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/manifest")
    return spark.read.parquet(f"{at}/summary")
