"""Experiment profiles, cases and their plans (PLAN-01..03, AGG-21, AGG-22, CAT)."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Profiles by kind: name, implementation, parameters.
PROFILES: dict[str, dict[str, tuple[str, dict]]] = {
    "chunking": {
        "fixed_512_overlap_64": ("token_window", {"token_budget": 512, "overlap": 64}),
        "page_then_tokenizer_subchunk": ("page_with_token_subchunks", {"token_budget": 512, "overlap": 64}),
        "paper_section_max_480_e5_tokens": ("paper_section_pack", {"max_tokens": 480}),
        "e5_tokenizer_512_overlap_64": ("token_window", {"token_budget": 512, "overlap": 64}),
        "audit_only": ("token_length_distribution", {}),
        "sentence_96_192_e5_tokens": ("sentence_pack", {"min_tokens": 96, "max_tokens": 192}),
        "passage_320_384_e5_tokens": ("paragraph_pack", {"min_tokens": 320, "max_tokens": 384}),
        "sentence_passage_section_tree": ("multi_granularity_tree", {"levels": ["sentence", "passage", "section"]}),
        "child_passage_parent_section": ("child_passage_parent_section", {"child_tokens": 384}),
        "section_graph_edges": ("section_edge_builder", {"edge_types": ["parent", "adjacent", "section_transition", "citation_or_keyword_related", "same_topic_related"]}),
        "best_available_from_smoke": ("selected_smoke_winner", {}),
        "best_pilot": ("selected_pilot_winner", {}),
        "not_applicable": ("no_chunking", {}),
    },
    "retriever": {
        "dense_vector": ("dense_vector", {}),
        "none": ("no_retrieval", {}),
        "hierarchical_dense": ("dense_child_then_parent_aggregate", {}),
        "child_dense_parent_context": ("dense_child_parent_context", {}),
        "rrf_seed_candidates": ("bm25_dense_rrf", {"candidate_k": 100}),
        "bm25_dense_rrf": ("bm25_dense_rrf", {"candidate_k": 100, "rrf_k": 60}),
        "bm25_dense_weighted": ("bm25_dense_weighted", {"bm25_weight": 2.0, "vector_weight": 1.0}),
        "rrf_top_100": ("bm25_dense_rrf", {"candidate_k": 100}),
        "adaptive_k_score_tail": ("score_tail_adaptive_k", {"min_k": 3, "max_k": 20}),
        "topic_keyword_soft_boost": ("metadata_soft_boost", {"fields": ["research_field", "paper_topic", "keyword", "publication_year"]}),
        "retry_on_low_evidence_sufficiency": ("single_retry_query_expansion", {}),
        "hnsw_parameter_grid": ("ann_parameter_grid", {}),
        "best_pilot": ("selected_pilot_winner", {}),
        "trainable_dense_retriever": ("trainable_dense_retriever", {}),
        "compressed_embedding_index": ("compressed_embedding_index", {}),
        "multimodal": ("multimodal_retrieval", {}),
    },
    "reranker": {
        "none": ("no_reranker", {}),
        "parent_score_aggregation": ("parent_score_aggregation", {}),
        "one_hop_section_graph": ("one_hop_graph_rerank", {}),
        "cpu_cross_encoder_top_50": ("cross_encoder", {"top_k": 50}),
        "optional_best_pilot": ("optional_selected_pilot_winner", {}),
        "late_interaction_top_50_subset": ("late_interaction_subset", {"top_k": 50}),
        "best_pilot": ("selected_pilot_winner", {}),
        "multimodal": ("multimodal_reranker", {}),
    },
    "evaluation": {
        "retrieval_core": ("core_retrieval_metrics", {"metrics": ["recall_at_5", "recall_at_10", "mrr", "ndcg_at_10", "latency_p50_p95"]}),
        "truncation_and_retrieval": ("tokenizer_length_plus_retrieval", {}),
        "tokenizer_length_distribution": ("token_length_distribution", {}),
        "retrieval_context_efficiency": ("context_efficiency_metrics", {}),
        "reranker_cost_quality": ("quality_latency_cost_curve", {}),
        "context_efficiency": ("context_efficiency_metrics", {}),
        "hard_negative_rejection": ("hard_negative_rejection_metrics", {}),
        "rag_retrieval_recovery": ("corrective_retrieval_recovery", {}),
        "quality_latency": ("quality_latency_tradeoff", {}),
        "rag_reliability": ("clean_misleading_mixed_reliability", {}),
        "deferred": ("not_scheduled", {}),
    },
}
# The cases' ids, groups and profiles (chunking, retriever, reranker, evaluation); the reasons of disabled
# ones, namespaces and paths of artifacts are this engine's own.
CASES = [
    ("baseline_fixed_512", "baseline", "fixed_512_overlap_64", "dense_vector", "none", "retrieval_core", ""),
    ("baseline_page_subchunk", "baseline", "page_then_tokenizer_subchunk", "dense_vector", "none", "retrieval_core", ""),
    ("baseline_section", "baseline", "paper_section_max_480_e5_tokens", "dense_vector", "none", "retrieval_core", ""),
    ("tokenizer_aware_fixed_512", "tokenizer", "e5_tokenizer_512_overlap_64", "dense_vector", "none", "truncation_and_retrieval", ""),
    ("truncation_audit_e5", "tokenizer", "audit_only", "none", "none", "tokenizer_length_distribution", ""),
    ("granularity_sentence", "granularity", "sentence_96_192_e5_tokens", "dense_vector", "none", "retrieval_core", ""),
    ("granularity_passage", "granularity", "passage_320_384_e5_tokens", "dense_vector", "none", "retrieval_core", ""),
    ("granularity_section", "granularity", "paper_section_max_480_e5_tokens", "dense_vector", "none", "retrieval_core", ""),
    ("hierarchical_sentence_passage_section", "granularity", "sentence_passage_section_tree", "hierarchical_dense", "parent_score_aggregation", "retrieval_context_efficiency", ""),
    ("parent_child_child_search_section_context", "parent_child", "child_passage_parent_section", "child_dense_parent_context", "parent_score_aggregation", "retrieval_context_efficiency", ""),
    ("graph_1hop_section_rerank", "graph", "section_graph_edges", "rrf_seed_candidates", "one_hop_section_graph", "retrieval_core", ""),
    ("hybrid_rrf", "hybrid_rerank", "best_available_from_smoke", "bm25_dense_rrf", "none", "retrieval_core", ""),
    ("hybrid_weighted", "hybrid_rerank", "best_available_from_smoke", "bm25_dense_weighted", "none", "retrieval_core", ""),
    ("cross_encoder_rerank_top50", "hybrid_rerank", "best_available_from_smoke", "rrf_top_100", "cpu_cross_encoder_top_50", "reranker_cost_quality", ""),
    ("adaptive_k_score_tail", "adaptive", "best_available_from_smoke", "adaptive_k_score_tail", "optional_best_pilot", "context_efficiency", ""),
    ("topic_keyword_soft_boost", "domain_scope", "best_available_from_smoke", "topic_keyword_soft_boost", "none", "hard_negative_rejection", ""),
    ("late_interaction_top50_subset", "late_interaction", "best_available_from_smoke", "rrf_top_100", "late_interaction_top_50_subset", "reranker_cost_quality", ""),
    ("corrective_rag_single_retry", "corrective", "best_pilot", "retry_on_low_evidence_sufficiency", "best_pilot", "rag_retrieval_recovery", ""),
    ("ann_hnsw_quality_latency", "ann", "best_pilot", "hnsw_parameter_grid", "none", "quality_latency", ""),
    ("clean_misleading_mixed_evidence", "robustness", "best_pilot", "best_pilot", "best_pilot", "rag_reliability", ""),
    ("deferred_dream_retriever_training", "deferred", "not_applicable", "trainable_dense_retriever", "none", "deferred", "needs training resources outside the first scope"),
    ("deferred_embedding_compression_pq", "deferred", "best_pilot", "compressed_embedding_index", "none", "deferred", "after the retrieval baseline is stable"),
    ("deferred_multimodal_reranker", "deferred", "not_applicable", "multimodal", "multimodal", "deferred", "figures and tables are a separate project"),
]
SKIPPED = {"chunking": {"no_chunking", "selected_smoke_winner", "selected_pilot_winner"}, "retriever": {"no_retrieval"}, "reranker": {"no_reranker"}, "evaluation": {"not_scheduled"}}
NAMESPACE = "papers_v3_"


@dataclass(frozen=True)
class Case:
    case_id: str
    group: str
    chunking: str
    retriever: str
    reranker: str
    evaluation: str
    reason: str = ""
    enabled: bool = True
    namespace: str = ""
    artifacts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Step:
    step_id: str
    kind: str
    profile: str
    implementation: str
    parameters: dict = field(default_factory=dict)
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    status: str = "planned"


def default_cases() -> list[Case]:
    """PLAN-01b: 23 cases, 20 of them enabled, in 13 groups."""
    return [Case(*c, enabled=not c[-1], namespace=NAMESPACE + c[0], artifacts=(f"processed/chunks/{c[0]}.jsonl",)) for c in CASES]


def profile(kind: str, name: str) -> tuple[str, dict]:
    """PLAN-03."""
    if name not in PROFILES[kind]:
        raise KeyError(f"unknown {kind} profile: {name}")
    return PROFILES[kind][name]


def validate(cases: list[Case], groups: set[str] | None = None, namespace: str = NAMESPACE) -> list[Case]:
    """PLAN-01: unique ids, known groups, the namespace's prefix, a reason for what is disabled, profiles that exist."""
    groups = groups or {c[1] for c in CASES}
    seen: set[str] = set()
    for c in cases:
        if c.case_id in seen:
            raise ValueError(f"duplicate case: {c.case_id}")
        seen.add(c.case_id)
        if c.group not in groups:
            raise ValueError(f"{c.case_id}: unknown group {c.group}")
        if not c.namespace.startswith(namespace):
            raise ValueError(f"{c.case_id}: the namespace must begin with {namespace}")
        if not c.enabled and not c.reason:
            raise ValueError(f"{c.case_id}: disabled without a reason")
        for kind in PROFILES:
            try:
                profile(kind, getattr(c, kind))
            except KeyError as e:
                raise ValueError(f"{c.case_id}: {e}") from e
    return cases


def registry_hash(cases: list[Case]) -> str:
    return hashlib.sha256(json.dumps([asdict(c) for c in cases], sort_keys=True).encode()).hexdigest()[:12]


def plan(case: Case, root: str = "data") -> list[Step]:
    """PLAN-02: the five steps of a case; steps without work of their own are skipped."""
    summary, details = f"{root}/eval/cases/{case.case_id}_summary.csv", f"{root}/eval/cases/{case.case_id}_details.jsonl"
    chunks = tuple(f"{root}/{a}" for a in case.artifacts)

    def step(n: str, kind: str, inputs: tuple[str, ...], outputs: tuple[str, ...]) -> Step:
        name = getattr(case, kind)
        implementation, parameters = profile(kind, name)
        return Step(n, kind, name, implementation, parameters, inputs, outputs, "skipped" if implementation in SKIPPED[kind] else "planned")

    return [
        step("01_chunking", "chunking", (f"{root}/processed/documents_normalized.jsonl",), chunks),
        Step("02_indexing", "indexing", case.namespace, "postings_and_vectors", {"index": case.namespace}, chunks, (case.namespace,)),
        step("03_retrieval", "retriever", (f"{root}/eval/golden_questions.jsonl", case.namespace), (details,)),
        step("04_reranking", "reranker", (details,), (details,)),
        step("05_evaluation", "evaluation", (details,), (summary,)),
    ]


def plans(spark: SparkSession, cases: list[Case] | None = None) -> DataFrame:
    """The steps of all cases as a table."""
    rows = [(c.case_id, c.enabled, s.step_id, s.kind, s.profile, s.implementation, json.dumps(s.parameters, sort_keys=True), s.status) for c in validate(cases or default_cases()) for s in plan(c)]
    return spark.createDataFrame(rows, "case_id string, enabled boolean, step_id string, kind string, profile string, implementation string, parameters string, status string")


def summarize(cases: DataFrame, summaries: DataFrame) -> DataFrame:
    """AGG-21: each case with its ``overall`` summary row, else its first (by ``pos``)."""
    w = Window.partitionBy("case_id").orderBy(F.col("grp") != "overall", "pos")
    best = summaries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "pos")
    return cases.join(best, "case_id", "left")


def registry_counts(cases: DataFrame) -> DataFrame:
    """AGG-22."""
    return cases.agg(F.count(F.lit(1)).alias("cases"), F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("disabled"), F.count_distinct("group").alias("groups"))
