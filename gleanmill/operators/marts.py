"""Marts and data-quality checks (MART, DQ, SET-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dim_document(manifest: DataFrame) -> DataFrame:
    """MART-01."""
    return manifest.select("doc_id", "split", "document_type", "source_archive", "source_member", "file_size")


def fact_parse_quality(documents: DataFrame) -> DataFrame:
    """MART-02: content length and (untrimmed) emptiness; metadata fields of a struct ``metadata``."""
    n = F.length(F.coalesce("content", F.lit(""))).cast("long")
    return documents.select("doc_id", "title", n.alias("content_chars"), (n == 0).alias("is_empty"), "metadata.page_count", "metadata.text_layer_pages", "metadata.parse_error")


def fact_chunk_quality(*corpora: DataFrame) -> DataFrame:
    """MART-03, SET-01: all corpora, missing columns null."""
    out = corpora[0]
    for c in corpora[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    cols = ["doc_id", "parent_doc_id", "chunking_strategy", "page_start", "page_end"]
    return out.select(*cols, F.length(F.coalesce("content", F.lit(""))).cast("long").alias("content_chars"))


def fact_indexing_result(spark, rows: list[tuple[str, str, int]]) -> DataFrame:
    """MART-04: (strategy, index, count) rows of a driver-side result."""
    return spark.createDataFrame(rows, "chunking_strategy string, index_name string, indexed_count long")


def fact_eval(summary_csv: DataFrame, metrics: list[str]) -> DataFrame:
    """MART-05, SNK-08: summary rows read as strings, metrics as doubles."""
    return summary_csv.select(*[F.col(c).cast("double").alias(c) if c in metrics else F.col(c) for c in summary_csv.columns])


def _check(name: str, df: DataFrame, observed, expected: str, bad: str) -> DataFrame:
    """A row (name, status, observed, expected) from one aggregate."""
    rows = df.agg(observed.cast("string").alias("observed"))
    status = F.when(F.col("observed") == expected, "PASS").otherwise(bad)
    return rows.select(F.lit(name).alias("name"), status.alias("status"), "observed", F.lit(expected).alias("expected"))


def same_count(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """DQ-01, DQ-04: equal row counts."""
    a, b = left.agg(F.count(F.lit(1)).alias("a")), right.agg(F.count(F.lit(1)).alias("b"))
    both = a.crossJoin(F.broadcast(b))  # one row each
    return both.select(F.lit(name).alias("name"), F.when(F.col("a") == F.col("b"), "PASS").otherwise("FAIL").alias("status"), F.col("a").cast("string").alias("observed"), F.col("b").cast("string").alias("expected"))


def empty_content(name: str, documents: DataFrame, column: str = "content") -> DataFrame:
    """DQ-02: trimmed-empty contents are a warning."""
    return _check(name, documents, F.count_if(F.trim(F.coalesce(F.col(column), F.lit(""))) == ""), "0", "WARN")


def duplicates(name: str, rows: DataFrame, key: list[str]) -> DataFrame:
    """DQ-03, WIN-04: rows beyond the distinct keys; counted by key first, so a hot key is combined early."""
    return _check(name, rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)), "0", "FAIL")


def orphans(name: str, children: DataFrame, parents: DataFrame, on: str) -> DataFrame:
    """DQ-03, JN-05: children without a parent."""
    return _check(name, children.join(parents.select(on).distinct(), on, "left_anti"), F.count(F.lit(1)), "0", "FAIL")


def without(rows: DataFrame, others: DataFrame, on: str) -> DataFrame:
    """SET-06: distinct keys of ``rows`` that ``others`` lacks."""
    return rows.select(on).distinct().join(others.select(on), on, "left_anti")


def inverted_pages(name: str, chunks: DataFrame, start: str = "page_start", end: str = "page_end") -> DataFrame:
    """DQ-03: intervals that end before they start."""
    return _check(name, chunks, F.count_if(F.col(start) > F.col(end)), "0", "FAIL")


def roll_up(checks: DataFrame) -> DataFrame:
    """DQ-05: checks by status."""
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("checks"))


def exit_code(checks: DataFrame) -> int:
    """DQ-05: 1 if any check failed."""
    return int(not checks.where("status = 'FAIL'").isEmpty())


#: Rows that a report shows of a table.
REPORT_ROWS = 500


def _rows(df: DataFrame) -> list[str]:
    found = df.limit(REPORT_ROWS).collect()
    told = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    return [f"| {' | '.join(df.columns)} |", f"|{' --- |' * len(df.columns)}", *[f"| {' | '.join(map(told, r))} |" for r in found]]


def report(title: str, facts: dict, tables: dict[str, DataFrame]) -> str:
    """SNK-06: a Markdown report: facts as a list, then tables (summaries of some rows) under their headings."""
    lines = [f"# {title}", "", *[f"- {k}: {v:,}" if isinstance(v, int) else f"- {k}: {v}" for k, v in facts.items()], ""]
    for heading, df in tables.items():
        lines += [f"## {heading}", "", *_rows(df), ""]
    return "\n".join(lines)


def _counted(rows: DataFrame, column: str, array: bool = False) -> DataFrame:
    values = F.explode(column) if array else F.col(column)
    return rows.select(values.alias(column)).groupBy(column).agg(F.count(F.lit(1)).alias("questions")).orderBy(F.desc("questions"), column)


def review_report(reviewed: DataFrame, title: str = "Review of questions") -> str:
    """SNK-06, AGG-08: a reviewed question set: statuses, reasons of rejection and flags by their counts."""
    tables = {"Status": _counted(reviewed, "review_status"), "Rejections": _counted(reviewed, "auto_reject_reasons", True), "Flags": _counted(reviewed, "review_flags", True)}
    return report(title, {"Questions": reviewed.count()}, tables | ({"Difficulty": _counted(reviewed, "difficulty")} if "difficulty" in reviewed.columns else {}))


def protocol_report(quality: DataFrame) -> str:
    """SNK-06: quality figures of question sets by protocol (AGG-09)."""
    return report("Quality of question sets", {"Sets": quality.count()}, {"Quality": quality.orderBy(quality.columns[0])})


def retrieval_report(summary: DataFrame, spread: DataFrame | None = None, title: str = "Retrieval") -> str:
    """SNK-06: retrieval summaries by group, and how far methods differ (AGG-10)."""
    keys = [c for c in ("case_id", "method", "grp") if c in summary.columns]
    return report(title, {"Groups": summary.count()}, {"Summary": summary.orderBy(*keys)} | ({"Spread": spread} if spread is not None else {}))


def parsing_report(summary: DataFrame) -> str:
    """SNK-06, AGG-15."""
    return report("Quality of parsed pages", {k: v if isinstance(v, int) else f"{v:.4f}" for k, v in summary.first().asDict().items()}, {})


def answer_report(summary: DataFrame) -> str:
    """SNK-06, AGG-16."""
    return report("Answers", {k: v if isinstance(v, int) else f"{v:.4f}" for k, v in summary.first().asDict().items()}, {})


def markdown(checks: DataFrame) -> str:
    """SNK-06: the report of a handful of checks."""
    rows = checks.orderBy("name").collect()
    return "\n".join(["| check | status | observed | expected |", "| --- | --- | --- | --- |", *[f"| {r['name']} | {r['status']} | {r['observed']} | {r['expected']} |" for r in rows]]) + "\n"
