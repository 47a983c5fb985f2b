"""Queries on plans and the catalog."""

from __future__ import annotations

import json

from ..plans import cases
from .base import query

_SKIPPED = sorted({i for names in cases.SKIPPED.values() for i in names})
_VALUES = ", ".join(f"('{c.case_id}', '{c.group}', {str(c.enabled).lower()})" for c in cases.default_cases())


@query(f"SELECT count(*) AS cases, count_if(enabled)::BIGINT AS enabled, count_if(NOT enabled)::BIGINT AS disabled, count(DISTINCT grp) AS groups FROM (VALUES {_VALUES}) t(case_id, grp, enabled)")
def case_registry(spark, sf):
    """PLAN-01, PLAN-01b, AGG-22."""
    rows = [(c.case_id, c.group, c.enabled) for c in cases.validate(cases.default_cases())]
    return cases.registry_counts(spark.createDataFrame(rows, "case_id string, `group` string, enabled boolean"))


_STEPS = ", ".join(
    "(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in (c.case_id, c.enabled, *step)) + ")"
    for c in cases.default_cases()
    for step in (
        ("01_chunking", "chunking", c.chunking, *cases.profile("chunking", c.chunking)),
        ("02_indexing", "indexing", c.namespace, "postings_and_vectors", {"index": c.namespace}),
        ("03_retrieval", "retriever", c.retriever, *cases.profile("retriever", c.retriever)),
        ("04_reranking", "reranker", c.reranker, *cases.profile("reranker", c.reranker)),
        ("05_evaluation", "evaluation", c.evaluation, *cases.profile("evaluation", c.evaluation)),
    )
    for step in [(*step[:4], json.dumps(step[4], sort_keys=True), "skipped" if step[3] in cases.SKIPPED.get(step[1], ()) else "planned")]
)


@query(f"SELECT * FROM (VALUES {_STEPS}) t(case_id, enabled, step_id, kind, profile, implementation, parameters, status)")
def case_plans(spark, sf):
    """PLAN-02, PLAN-03."""
    return cases.plans(spark)
