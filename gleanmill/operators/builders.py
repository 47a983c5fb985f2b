"""Builders of question sets and of evaluation rows (QA-01, QA-03..06, QA-09, FN-36, CHK-08, AGG-13..16, RET-11)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as tx
from . import metrics as mt
from . import questions as qs
from . import retrieval as rt
from .documents import validation_query

# Question templates by type.
FALLBACK_QUESTIONS = {
    "fact": "이 문서에서 설명하는 주요 사실은 무엇인가요?",
    "procedure": "이 문서가 제시하는 처리 절차나 방법은 무엇인가요?",
    "comparison": "이 문서에서 비교하거나 구분하는 핵심 내용은 무엇인가요?",
    "numeric": "이 문서에 제시된 주요 수치와 그 의미는 무엇인가요?",
    "condition": "이 문서에서 제시하는 적용 조건이나 요건은 무엇인가요?",
    "summary": "이 문서의 핵심 내용을 요약하면 무엇인가요?",
}
TOPIC_QUESTIONS = {
    "summary": "what problem, method, and finding does the paper summarize?",
    "purpose": "what research purpose or background does the paper describe?",
    "method": "what method, model, data, or procedure does the paper use?",
    "result": "what experiment, condition, measurement, or result is reported?",
    "conclusion": "what conclusion, implication, or limitation does the paper present?",
    "section": "what key point is explained in this section of the paper?",
}
LOW_OVERLAP_QUESTIONS = {
    "summary": "What overall research issue and contribution are supported by the cited evidence?",
    "purpose": "What motivation or background claim is supported by the cited evidence?",
    "method": "What approach, data, model, or procedure is supported by the cited evidence?",
    "result": "What measurement, experiment, condition, or finding is supported by the cited evidence?",
    "conclusion": "What implication, limitation, or final claim is supported by the cited evidence?",
    "section": "What specific point is supported by the cited evidence?",
}
PROTOCOLS = ("balanced", "section_balanced", "hard_negative", "low_overlap", "late_evidence")


def by_kind(key: Column, values: dict[str, str], default: str) -> Column:
    """FN-36: the template of a kind."""
    out = F.lit(values[default])
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def validation_set(docs: DataFrame, tickets: int = 400, logs: int = 40, seed: int = 42) -> DataFrame:
    """QA-09, TOP-09: questions from a fixed sample of tickets and logs; their documents are the gold."""
    some = lambda kind, n: docs.where(F.col("source_type") == kind).orderBy(qs.hash_order("doc_id", seed)).limit(n)
    rows = some("ticket", tickets).unionByName(some("log", logs))
    return rows.select(validation_query(F.col("title"), F.col("content")).alias("question"), F.array("doc_id").alias("gold_doc_ids"), "source_type")


def golden_candidates(docs: DataFrame, pages: DataFrame, limit: int = 300, seed: int = 42) -> DataFrame:
    """QA-01: from strata of document types in turn, the longest page's best segment as evidence, types in rotation.

    ``docs``: doc_id, document_type, publisher; ``pages``: doc_id, page_num, content.
    """
    longest = pages.groupBy("doc_id").agg(F.max_by(F.struct("page_num", "content"), F.struct(F.length("content"), -F.col("page_num"))).alias("p"))
    chosen = qs.round_robin(docs.join(longest, "doc_id"), "document_type", [qs.hash_order("doc_id", seed)], limit)
    # at most ``limit`` rows are numbered in one task
    rows = chosen.withColumn("i", F.row_number().over(Window.orderBy("nth", "document_type")) - 1)
    kinds = F.array(*[F.lit(k) for k in FALLBACK_QUESTIONS])
    rows = rows.withColumn("question_type", F.element_at(kinds, (F.col("i") % 6 + 1).cast("int"))).withColumn("evidence_text", tx.evidence_segment(F.trim("p.content")))
    rows = rows.withColumn("question", by_kind(F.col("question_type"), FALLBACK_QUESTIONS, "summary"))
    negatives = qs.group_negatives(docs, ["document_type", "publisher"]).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "negative_id"))), lambda x: x["negative_id"].cast("string")).alias("hard_negative_doc_ids"))
    return rows.join(negatives, "doc_id", "left").select(
        F.format_string("office_q_%04d", F.col("i") + 1).alias("question_id"),
        "question",
        F.trim(F.substring("evidence_text", 1, 500)).alias("reference_answer"),
        F.array(F.col("doc_id").cast("string")).alias("gold_doc_ids"),
        F.array(F.col("p.page_num").cast("int")).alias("gold_pages"),
        "evidence_text",
        "question_type",
        F.round(tx.overlap_office(F.col("question"), F.col("evidence_text")), 6).alias("lexical_overlap"),
        F.coalesce("hard_negative_doc_ids", F.array().cast("array<string>")).alias("hard_negative_doc_ids"),
        F.lit("pending").alias("review_status"),
    )


def _flags(q: Column, e: Column, n: Column, section: Column) -> Column:
    overlap = tx.overlap_spaces(q, e)
    named = [(overlap < 0.15, "low_lexical_overlap"), (overlap > 0.55, "high_lexical_overlap"), (n < 5, "few_hard_negatives"), (section == "abstract", "abstract_based")]
    return F.array_compact(F.array(*[F.when(c, F.lit(f)) for c, f in named]))


def refreshed(rows: DataFrame) -> DataFrame:
    """QA-06: overlap, difficulty and flags of a row by what it says now."""
    n = F.size("hard_negative_doc_ids")
    rows = rows.withColumn("lexical_overlap", F.round(tx.overlap_spaces(F.col("question"), F.col("evidence_text")), 6))
    return rows.withColumn("difficulty", tx.difficulty(F.col("lexical_overlap"), n)).withColumn("review_flags", _flags(F.col("question"), F.col("evidence_text"), n, F.col("gold_section")))


def section_rows(docs: DataFrame, sections: DataFrame, least: int = 240, negatives: int = 10) -> DataFrame:
    """QA-03: a candidate for each section with enough evidence: question, negatives, difficulty, flags.

    ``docs``: doc_id, title, page_count, field, topics (array); ``sections``: doc_id, section_index, section_type,
    page_start, page_end, text.
    """
    found = sections.where(~F.col("section_type").isin("references", "unknown")).withColumn("evidence_text", tx.clean_evidence(F.col("text"))).where(F.length("evidence_text") >= least)
    mined = qs.hard_negatives(docs, negatives).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "negative_id"))), lambda x: x["negative_id"].cast("string")).alias("hard_negative_doc_ids"))
    kind = F.coalesce(*[F.when(F.col("section_type") == s, F.lit(t)) for s, t in qs.QUESTION_TYPES.items()], F.lit("section"))
    hint = tx.topic_words(F.col("evidence_text"), 3)
    topic = F.when(F.size(hint) > 0, F.array_join(hint, " ")).otherwise(tx.blank(F.col("title")))
    priority = F.coalesce(*[F.when(F.col("section_type") == s, F.lit(i)) for i, s in enumerate(qs.SECTION_PRIORITY)], F.lit(99))
    rows = found.join(docs.select("doc_id", "title", "page_count"), "doc_id").join(mined, "doc_id", "left").withColumn("question_type", kind)
    rows = rows.select(
        "doc_id",
        F.concat(F.lit("For "), topic, F.lit(", "), by_kind(F.col("question_type"), TOPIC_QUESTIONS, "section")).alias("question"),
        F.substring("evidence_text", 1, 360).alias("reference_answer"),
        F.array(F.col("doc_id").cast("string")).alias("gold_doc_ids"),
        F.sequence(F.col("page_start").cast("int"), F.greatest("page_start", "page_end").cast("int")).alias("gold_pages"),
        F.col("section_type").alias("gold_section"),
        "evidence_text",
        "section_index",
        "question_type",
        F.coalesce("hard_negative_doc_ids", F.array().cast("array<string>")).alias("hard_negative_doc_ids"),
        priority.cast("long").alias("section_priority"),
        F.round(tx.position_ratio(F.col("page_start"), F.col("page_count")), 6).alias("page_position_ratio"),
        F.lit("candidate").alias("review_status"),
    )
    return refreshed(rows)


def paper_questions(candidates: DataFrame, limit: int = 120, prefix: str = "v3_balanced") -> DataFrame:
    """QA-04: quota selection of section candidates, numbered."""
    chosen = qs.select_quota(candidates, limit)
    order = Window.orderBy("question_type", "doc_id")  # at most ``limit`` rows
    return chosen.withColumn("question_id", F.format_string(f"{prefix}_%04d", F.row_number().over(order)))


def one_section_each(candidates: DataFrame, limit: int = 50) -> DataFrame:
    """QA-05: of each document the section that comes first in the order of preference."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_priority", "section_index"))
    return candidates.withColumn("_n", nth).where("_n = 1").drop("_n").orderBy("doc_id").limit(limit)


def protocol(candidates: DataFrame, name: str, limit: int = 120) -> DataFrame:
    """QA-06: one of five protocols: order, balanced take, numbering, quality afresh."""
    if name not in PROTOCOLS:
        raise ValueError(f"unknown protocol: {name}")
    rows = candidates.withColumn("n_negatives", F.size("hard_negative_doc_ids"))
    order = qs.protocol_order(name)
    by, kinds = ("gold_section", qs.SECTION_ORDER) if name == "section_balanced" else ("question_type", list(qs.QUOTAS))
    # of each document and kind the first candidate, of each kind so many as can be taken: only these are numbered in one task
    first = F.row_number().over(Window.partitionBy(by, "doc_id").orderBy(*order, "section_index"))
    few = F.row_number().over(Window.partitionBy(by).orderBy(*order, "section_index"))
    rows = rows.withColumn("_n", first).where("_n = 1").withColumn("_n", few).where(F.col("_n") <= 2 * limit).drop("_n")
    placed = rows.withColumn("pos", F.row_number().over(Window.orderBy(*order, "section_index")).cast("long"))
    chosen = qs.select_balanced(placed, limit, by, kinds)
    numbered = chosen.withColumn("n", F.row_number().over(Window.orderBy("pos"))).withColumn("question_id", F.format_string(f"{name}_%04d", "n")).withColumn("qaset_protocol", F.lit(name))
    if name == "low_overlap":
        pages = F.format_string(" Use pages %d-%d. Item %d.", F.array_min("gold_pages"), F.array_max("gold_pages"), F.col("n"))
        numbered = numbered.withColumn("question", F.concat(by_kind(F.col("question_type"), LOW_OVERLAP_QUESTIONS, "section"), pages))
    return refreshed(numbered).drop("pos", "n", "n_negatives")


# ---- chunk and answer evaluation


def chunk_evaluation(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """AGG-14: one row: containment, page coverage, fragmentation, empty rate, mean tokens.

    ``chunks``: parent_id, content, page_start, page_end; ``questions``: query_id, gold_doc_ids, gold_pages, evidence_text.
    """
    asked = questions.withColumn("e", tx.for_matching(F.col("evidence_text"))).where("e <> ''")
    pairs = asked.withColumn("parent_id", F.explode("gold_doc_ids")).join(chunks.withColumn("t", tx.for_matching(F.col("content"))), "parent_id")
    hit = ((F.col("t") != "") & F.contains("e", F.col("t"))) | F.contains("t", F.col("e"))
    half = F.contains("t", F.col("e").substr(F.lit(1), F.greatest(F.floor(F.length("e") / 2), F.lit(1)).cast("int")))
    page = F.exists("gold_pages", lambda p: (p >= F.col("page_start")) & (p <= F.col("page_end")))
    per = pairs.groupBy("query_id").agg(F.bool_or(hit).alias("hit"), F.bool_or(half).alias("half"), F.bool_or(page).alias("page"))
    of = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6)
    asked = asked.select("query_id").join(per, "query_id", "left").agg(
        F.count(F.lit(1)).alias("questions"), of(F.col("hit")).alias("gold_containment_rate"), of(F.col("page")).alias("gold_page_coverage"), of(~F.col("hit") & F.col("half")).alias("fragmentation_proxy")
    )
    n = tx.token_count(F.col("content"))
    sizes = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg((n == 0).cast("int")), 6).alias("empty_chunk_rate"), F.round(F.avg(n), 6).alias("mean_chunk_tokens"))
    return asked.crossJoin(F.broadcast(sizes))  # one row each


def parsing_evaluation(oracle: DataFrame, parsed: DataFrame) -> DataFrame:
    """JN-03, AGG-15: ``doc_id, page_num`` with both normalised texts; a page that was not parsed has an empty one."""
    rows = oracle.select("doc_id", "page_num", tx.for_matching(F.col("text")).alias("oracle"))
    return rows.join(parsed.select("doc_id", "page_num", tx.for_matching(F.col("text")).alias("parsed")), ["doc_id", "page_num"], "left").withColumn("parsed", F.coalesce("parsed", F.lit("")))


def parsing_scores(oracle: DataFrame, parsed: DataFrame) -> DataFrame:
    """AGG-15: a row for each oracle page with text: character scores, duplicate ratio and whether anything was extracted."""
    rows = parsing_evaluation(oracle, parsed).where("oracle <> ''")
    rows = rows.withColumn("m", mt.char_similarity(F.col("parsed"), F.col("oracle"))).withColumn("d", mt.duplicate_ngrams(F.col("parsed")))
    figures = {"parsed_chars": F.length("parsed"), "gold_chars": F.length("oracle"), "character_precision": F.col("m.precision"), "character_recall": F.col("m.recall"), "normalized_edit_similarity": F.col("m.similarity")}
    return rows.select("doc_id", "page_num", *[c.alias(n) for n, c in figures.items()], F.col("d").alias("duplicate_ratio"), (F.trim("parsed") != "").cast("double").alias("page_extracted"))


def parsing_summary(oracle: DataFrame, parsed: DataFrame) -> DataFrame:
    """AGG-15: one row: oracle pages, skipped ones (without text), documents, and the means of the pages' scores."""
    skipped = oracle.agg(F.count_if(tx.for_matching(F.col("text")) == "").alias("skipped_pages"))
    names = ["character_precision", "character_recall", "normalized_edit_similarity", "duplicate_ratio", "page_extracted"]
    means = [F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(c) for c in names]
    return parsing_scores(oracle, parsed).agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("doc_id").alias("documents"), *means).crossJoin(F.broadcast(skipped))  # one row each


def reconstruction_summary(rows: DataFrame) -> DataFrame:
    """AGG-12: by profile: rows, mean noise and sentence breaks before and after, preserved elements in all.

    ``rows``: profile, noise_score_before, noise_score_after, sentence_boundary_break_before, sentence_boundary_break_after,
    preserved_element_count; missing figures count as 0.
    """
    mean = lambda c: F.round(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), 6)
    return rows.groupBy("profile").agg(
        F.count(F.lit(1)).alias("rows"),
        mean("noise_score_before").alias("avg_noise_before"),
        mean("noise_score_after").alias("avg_noise_after"),
        mean("sentence_boundary_break_before").alias("avg_sentence_break_before"),
        mean("sentence_boundary_break_after").alias("avg_sentence_break_after"),
        F.coalesce(F.sum(F.col("preserved_element_count").cast("long")), F.lit(0)).alias("preserved_elements"),
    )


def answer_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """AGG-16: means of answer metrics and latency percentiles; zeros for no rows."""
    return rows.agg(F.count(F.lit(1)).alias("questions"), *[F.coalesce(F.round(F.avg(m), 6), F.lit(0.0)).alias(m) for m in metrics], *[F.coalesce(F.percentile("latency_ms", F.lit(p)), F.lit(0.0)).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"))])


def length_audit(units: DataFrame, most: int = 512) -> DataFrame:
    """AGG-13: token lengths by ``unit`` of ``unit, text``; percentiles are values picked by index (AGG-05, AGG-06)."""
    n = units.select("unit", tx.token_count(F.col("text")).cast("long").alias("n"))
    over = F.count_if(F.col("n") > most)
    figures = n.groupBy("unit").agg(
        F.count(F.lit(1)).alias("rows"), F.min("n").alias("min"), F.round(F.avg("n"), 3).alias("mean"), F.max("n").alias("max"), over.alias("over"), F.round(over / F.count(F.lit(1)), 6).alias("over_ratio")
    )
    return figures.join(mt.pick_by_index(n, "unit", "n", {"p50": "half", "p95": "floor"}), "unit")


# ---- windows of a model's tokenizer


def _fitting(decode, count, ids: list[int], budget: int) -> str:
    """The text of the longest beginning of ``ids`` that takes no more than ``budget`` ids when it is encoded again.

    Almost always that is all of ``ids``. Else the end is found by halving, and by single steps beside it, as a text's
    number of ids can fall by one where it is cut.
    """
    text = decode(ids).strip()
    if count(text) <= budget:
        return text
    fits, over = 0, len(ids)
    while over - fits > 1:
        middle = (fits + over) // 2
        fits, over = (middle, over) if count(decode(ids[:middle]).strip()) <= budget else (fits, middle)
    for more in range(min(fits + 4, len(ids) - 1), fits, -1):
        if count(text := decode(ids[:more]).strip()) <= budget:
            return text
    return decode(ids[:fits]).strip()


def model_windows(docs: DataFrame, tokenizer_json: str, budget: int = 512, overlap: int = 64) -> DataFrame:
    """CHK-08, CHK-09: windows of a tokenizer's ids, decoded; a window whose text takes more ids than the budget is shortened.

    ``tokenizer_json``: content of a tokenizer file (1 to 3 MB), which is sent with the code. Windows lie at multiples of
    ``budget - overlap``; the last one ends with the text. Windows without text are left out.
    """
    step = max(budget - overlap, 1)

    def spans(n: int) -> list[tuple[int, int]]:
        last = max(0, -(-(n - budget) // step))
        return [(k * step, min(k * step + budget, n)) for k in range(last + 1)] if n else []

    schema = "doc_id long, chunk_index long, token_start long, token_end long, content string"
    kinds = shared.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        encoded = lambda t: tokenizer.encode(t, add_special_tokens=False).ids

        def windows() -> Iterator[tuple]:
            for doc, text in shared.rows_of(batches):
                ids = encoded(text or "")
                told = ((*span, _fitting(tokenizer.decode, lambda t: len(encoded(t)), ids[slice(*span)], budget)) for span in spans(len(ids)))
                yield from ((doc, k, *window) for k, window in enumerate(w for w in told if w[2]))

        yield from shared.batches_of(windows(), kinds)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ---- declared retrievers that window expressions give


def adaptive_k(ranking: DataFrame, least: int = 3, most: int = 20, share: float = 0.5) -> DataFrame:
    """RET-11: of each query the ranks up to ``least``, and further ones while the score is at least a share of the best."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return ranking.withColumn("_best", best).where((F.col("rank") <= least) | ((F.col("rank") <= most) & (F.col("score") >= F.lit(share) * F.col("_best")))).drop("_best")


def parent_scores(ranking: DataFrame, how: str = "max") -> DataFrame:
    """RET-11: chunks' scores brought together by parent (max, sum or mean), ranked."""
    agg = {"max": F.max, "sum": F.sum, "mean": F.avg}[how]("score")
    rows = ranking.groupBy("query_id", "parent_id").agg(F.round(agg, 6).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "parent_id")).cast("long"))


def soft_boost(ranking: DataFrame, matches: DataFrame, boost: float = 0.1) -> DataFrame:
    """RET-11: scores raised by a share for each matching metadata field (``query_id, doc_id, n_fields``), ranked anew."""
    rows = ranking.drop("rank").join(matches, ["query_id", "doc_id"], "left").withColumn("score", F.round(F.col("score") * (1 + F.lit(boost) * F.coalesce("n_fields", F.lit(0))), 6)).drop("n_fields")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).cast("long"))


def section_edges(sections: DataFrame) -> DataFrame:
    """RET-11: ``src, dst, edge_type`` of neighbouring sections of a document and of sections with their document."""
    node = F.concat_ws("_", "doc_id", "section_index")
    w = Window.partitionBy("doc_id").orderBy("section_index")
    rows = sections.select("doc_id", node.alias("src"), F.lead(node).over(w).alias("next"), "section_type", F.lead("section_type").over(w).alias("next_type"))
    near = rows.where("next is not null").select("src", F.col("next").alias("dst"), F.when(F.col("section_type") == F.col("next_type"), "adjacent").otherwise("section_transition").alias("edge_type"))
    return near.unionByName(rows.select("src", F.col("doc_id").cast("string").alias("dst"), F.lit("parent").alias("edge_type")))


def graph_rerank(ranking: DataFrame, edges: DataFrame, weight: float = 0.5) -> DataFrame:
    """RET-11: scores plus a share of the best one-hop neighbour's."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = ranking.select("query_id", F.col("doc_id").alias("src"), F.col("score").alias("s")).join(both, "src").groupBy("query_id", F.col("dst").alias("doc_id")).agg(F.max("s").alias("near"))
    rows = ranking.drop("rank").join(near, ["query_id", "doc_id"], "left").withColumn("score", F.round(F.col("score") + F.lit(weight) * F.coalesce("near", F.lit(0.0)), 6)).drop("near")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).cast("long"))


def hierarchical(ranking: DataFrame, levels: list[str], how: str = "max") -> DataFrame:
    """RET-11: scores of the smallest units brought up level by level, from ``levels[0]`` to ``levels[-1]``: ``query_id, <last level>, score, rank``.

    ``ranking`` has a column for each level. A unit of the first level has its best score, one of a higher level the best (or sum, or mean) of its parts'.
    """
    rows = ranking.groupBy("query_id", *levels).agg(F.max("score").alias("score"))
    for i in range(1, len(levels)):
        rows = rows.groupBy("query_id", *levels[i:]).agg(F.round({"max": F.max, "sum": F.sum, "mean": F.avg}[how]("score"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), levels[-1])
    return rows.withColumn("rank", F.row_number().over(order).cast("long"))


def with_parents(ranking: DataFrame, parents: DataFrame, k: int = 10) -> DataFrame:
    """RET-11: children are searched, their parents given: the best k parents (``parent_id, content``) once each, by their best child."""
    return rt.dedupe_parents(ranking, k).join(parents.select("parent_id", "content"), "parent_id", "left")


def retried(questions: DataFrame, search, contents: DataFrame, least: float = 0.5, words: int = 3) -> DataFrame:
    """RET-11: one more search for questions whose best result has too small a share of their words, with words of that result.

    ``search(query_id, text)`` ranks ``query_id, doc_id, score, rank``; ``contents``: doc_id, text. The second ranking stands
    where there was one (``retried``).
    """
    first = search(questions.select("query_id", "text"))
    best = first.where("rank = 1").join(contents.withColumnRenamed("text", "_body"), "doc_id").select("query_id", "_body")
    judged = questions.select("query_id", "text").join(best, "query_id", "left").withColumn("_share", mt.evidence_coverage(F.col("text"), F.col("_body")))
    weak = judged.where((F.col("_share") < least) & F.col("_body").isNotNull())
    more = weak.select("query_id", F.concat_ws(" ", "text", F.array_join(tx.topic_words(F.col("_body"), words), " ")).alias("text"))
    again = weak.select("query_id").withColumn("_again", F.lit(True))
    marked = first.join(again, "query_id", "left").withColumn("retried", F.coalesce("_again", F.lit(False))).drop("_again")
    return marked.where("not retried").unionByName(search(more).withColumn("retried", F.lit(True)))


def parameter_grid(searches: dict[str, DataFrame], gold: DataFrame, k: int = 10) -> DataFrame:
    """RET-11: quality of rankings (``query_id, parent_id, rank, latency_ms``) that differ by a parameter: ``point, recall, mrr, latency``."""
    out = None
    for point, ranking in searches.items():
        per = mt.per_question(mt.judged(ranking.where(F.col("rank") <= k), gold))
        took = ranking.agg(F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"))
        row = per.agg(F.round(F.avg("recall_at_10"), 6).alias("recall_at_10"), F.round(F.avg("mrr"), 6).alias("mrr")).crossJoin(F.broadcast(took)).withColumn("point", F.lit(point))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def lineage(questions: DataFrame, datasets: dict[str, DataFrame], each: int = 3) -> DataFrame:
    """JN-13: ``query_id, doc_id`` of a question's first gold document, and by dataset up to ``each`` ids of its rows, in their order.

    ``questions``: query_id, gold_doc_ids (array); datasets: doc_id, id, pos. A question without gold has a null document.
    """
    rows = questions.select("query_id", F.get("gold_doc_ids", 0).alias("doc_id"))
    for name, df in datasets.items():
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
        first = df.select("doc_id", "id", "pos", nth.alias("_n")).where(F.col("_n") <= each)
        ids = first.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.col("id").cast("string").alias("id")))), lambda x: x["id"]).alias(name))
        rows = rows.join(ids, "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return rows
