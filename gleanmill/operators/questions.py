"""Question sets: construction, negatives, review, selection (QA, JN-07, JN-08, TOP-04..09, WIN-03, AGG-08..10)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Review thresholds, quotas, priorities.
OFFICE_LIMITS = {"evidence": 80, "answer": 2, "overlap": 0.05}
PAPER_LIMITS = {"evidence": 240, "low": 0.15, "high": 0.55, "negatives": 5, "mojibake": 0.08}
QUOTAS = {"summary": 0.2, "purpose": 0.2, "method": 0.2, "result": 0.2, "conclusion": 0.1, "section": 0.1}
QUESTION_TYPES = {"abstract": "summary", "introduction": "purpose", "method": "method", "experiment": "result", "result": "result", "conclusion": "conclusion"}
SECTION_PRIORITY = ["method", "result", "experiment", "introduction", "conclusion", "body", "abstract"]
SECTION_ORDER = ["introduction", "method", "experiment", "result", "conclusion", "body", "abstract"]


def _flags(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))


def _is_repeat(pos: str = "pos") -> Column:
    """WIN-03: whether an earlier row has the same non-empty key; rejected rows claim their key too."""
    return (F.col("_key") != "") & (F.row_number().over(Window.partitionBy("_key").orderBy(pos)) > 1)


def _missing() -> list[tuple[Column, str]]:
    trimmed = lambda c: F.trim(tx.blank(F.col(c)))
    return [
        (trimmed("question") == "", "missing_question"),
        (trimmed("reference_answer") == "", "missing_reference_answer"),
        (trimmed("evidence_text") == "", "missing_evidence"),
        (F.coalesce(F.size("gold_doc_ids"), F.lit(0)) <= 0, "missing_gold_doc_ids"),
        (F.coalesce(F.size("gold_pages"), F.lit(0)) <= 0, "missing_gold_pages"),
    ]


def review_office(rows: DataFrame, fallback_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """QA-02: ``auto_reject_reasons, review_flags, review_status`` of rows ordered by ``pos``."""
    q, a, e = (F.trim(tx.blank(F.col(c))) for c in ("question", "reference_answer", "evidence_text"))
    overlap = F.coalesce(F.col("lexical_overlap"), F.lit(0.0))
    fallback = F.lit(False)
    for p in fallback_prefixes:
        fallback = fallback | q.startswith(p)
    keyed = rows.withColumn("_key", tx.question_key(F.col("question"))).withColumn("_repeat", _is_repeat())
    reasons = _flags(*_missing(), (F.col("_repeat"), "duplicate_question"), (fallback, "fallback_question_template"), ((e != "") & (F.length(e) < OFFICE_LIMITS["evidence"]), "too_short_evidence"))
    flags = _flags(((a != "") & (F.length(a) < OFFICE_LIMITS["answer"]), "very_short_answer"), ((q != "") & ~q.rlike("[?？]$"), "question_mark_missing"), (overlap < OFFICE_LIMITS["overlap"], "low_lexical_overlap"))
    out = keyed.withColumn("auto_reject_reasons", reasons).withColumn("review_flags", flags).drop("_key", "_repeat")
    return out.withColumn("review_status", F.when(F.size("auto_reject_reasons") > 0, "rejected").otherwise("approved"))


def review_papers(rows: DataFrame) -> DataFrame:
    """QA-07: the same for paper questions, with three outcomes; flags are a sorted set joined with those the row has."""
    e = F.trim(tx.blank(F.col("evidence_text")))
    overlap = F.coalesce(F.col("lexical_overlap"), F.lit(0.0))
    noisy = (tx.mojibake_score(F.col("question")) > PAPER_LIMITS["mojibake"]) | (tx.mojibake_score(F.col("evidence_text")) > PAPER_LIMITS["mojibake"])
    keyed = rows.withColumn("_key", tx.question_key(F.col("question"))).withColumn("_repeat", _is_repeat())
    missing = _missing()
    reasons = _flags(missing[0], missing[2], missing[1], *missing[3:], ((e != "") & (F.length(e) < PAPER_LIMITS["evidence"]), "too_short_evidence"), (F.col("_repeat"), "duplicate_question"))
    own = _flags(
        (overlap < PAPER_LIMITS["low"], "low_lexical_overlap"),
        (overlap > PAPER_LIMITS["high"], "high_lexical_overlap"),
        (F.coalesce(F.size("hard_negative_doc_ids"), F.lit(0)) < PAPER_LIMITS["negatives"], "few_hard_negatives"),
        (noisy, "encoding_noise"),
        (F.coalesce(F.col("gold_section") == "abstract", F.lit(False)), "abstract_based"),
    )
    given = F.coalesce(F.col("review_flags"), F.array().cast("array<string>")) if "review_flags" in rows.columns else F.array().cast("array<string>")
    out = keyed.withColumn("auto_reject_reasons", reasons).withColumn("review_flags", F.array_sort(F.array_distinct(F.concat(given, own)))).drop("_key", "_repeat")
    return out.withColumn("review_status", F.when(F.size("auto_reject_reasons") > 0, "rejected").when(F.size("review_flags") > 0, "manual_review").otherwise("approved_auto_review"))


def promote(rows: DataFrame) -> DataFrame:
    """QA-08: without rejected rows; manual ones become provisional and need a human."""
    manual = F.col("review_status") == "manual_review"
    out = rows.where(F.col("review_status") != "rejected").withColumn("requires_human_review", manual)
    return out.withColumn("review_status", F.when(F.col("requires_human_review"), "approved_provisional_review").otherwise(F.col("review_status")))


def hard_negatives(docs: DataFrame, k: int = 10) -> DataFrame:
    """JN-07: ``doc_id, negative_id, score, nth``: 3 for an equal field and 1 for each common topic word, best k.

    Documents with the same field and topics form a class, and only classes look for negatives. A negative y of a class
    with the common topics C is among the first k + 1 documents, by id, of those with at least the topics C (and the
    class's field, if y has it): each earlier one has no smaller score and a smaller id. So each set of topics keeps
    k + 1 documents, sorted out before the shuffle, and a class looks at the lists of the subsets of its few topics:
    no pairs of documents are made, however common a topic is.
    """
    topics = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("topics", F.array().cast("array<string>")))))
    rows = docs.select("doc_id", "field", topics.alias("topics"))
    subsets = F.expr("transform(sequence(0, cast(shiftleft(1, size(topics)) as int) - 1), m -> filter(topics, (t, i) -> (shiftright(m, i) & 1) = 1))")
    scopes = F.array(F.struct(F.col("field").isNotNull().alias("own"), F.coalesce("field", F.lit("")).alias("scope")), F.struct(F.lit(False).alias("own"), F.lit("").alias("scope")))

    def spread(of: DataFrame) -> DataFrame:
        out = of.withColumn("subset", F.explode(subsets)).withColumn("in", F.explode(scopes)).select("*", "in.*").drop("in")
        return out.where(F.col("own") | (F.size("subset") > 0)).withColumn("list", F.xxhash64("subset", "own", "scope")).drop("subset", "own", "scope")

    first = F.row_number().over(Window.partitionBy("list").orderBy("doc_id"))
    lists = spread(rows).withColumn("_n", first).where(F.col("_n") <= k + 1).select("list", F.col("doc_id").alias("negative_id"), F.col("field").alias("other"), F.col("topics").alias("others"))
    classes = rows.select("field", "topics").distinct()
    # lists are named by hashes: if two had the same name, scores would still be right
    score = (F.when(F.coalesce(F.col("field") == F.col("other"), F.lit(False)), 3).otherwise(0) + F.size(F.array_intersect("topics", "others"))).cast("long")
    met = spread(classes).join(lists, "list").select("field", "topics", "negative_id", score.alias("score")).where("score > 0").distinct()
    nth = F.row_number().over(Window.partitionBy("field", "topics").orderBy(F.desc("score"), "negative_id"))
    best = met.withColumn("_n", nth).where(F.col("_n") <= k + 1).groupBy("field", "topics").agg(F.sort_array(F.collect_list(F.struct("_n", "negative_id", "score"))).alias("best"))
    best = best.select(F.col("field").alias("_field"), F.col("topics").alias("_topics"), "best")
    own = rows.join(best, F.col("field").eqNullSafe(F.col("_field")) & (F.col("topics") == F.col("_topics")))
    others = F.slice(F.filter("best", lambda x: x["negative_id"] != F.col("doc_id")), 1, k)
    return own.select("doc_id", F.posexplode(others).alias("at", "x")).select("doc_id", "x.negative_id", "x.score", (F.col("at") + 1).cast("long").alias("nth"))


def unanswered(questions: DataFrame, done: DataFrame, on: str = "query_id") -> DataFrame:
    """JN-15: questions that are not in the output of an earlier run."""
    return questions.join(done.select(on), on, "left_anti")


def group_negatives(docs: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """JN-08: the first k other documents of the same group, by id: only a group's first k + 1 can be anyone's."""
    first = docs.select(*keys, F.col("doc_id").alias("negative_id")).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("negative_id"))).where(F.col("_n") <= k + 1)
    pairs = docs.select("doc_id", *keys).join(first.drop("_n"), keys).where(F.col("doc_id") != F.col("negative_id"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("negative_id")).cast("long")
    return pairs.withColumn("nth", nth).where(F.col("nth") <= k).select("doc_id", "negative_id", "nth")


def round_robin(rows: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    """TOP-04: n rows, one of each stratum in turn."""
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return rows.withColumn("nth", nth.cast("long")).where(F.col("nth") <= n).orderBy("nth", stratum).limit(n)


def hash_order(id_col: str, seed: int = 42) -> Column:
    """TOP-05: a fixed order that no column decides."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


def eval_subset(docs: DataFrame, gold: DataFrame, most: int = 10_000) -> DataFrame:
    """TOP-11, JN-14: all documents of gold parents, then others by id while there are fewer than ``most`` in all."""
    parents = gold.select(F.col("doc_id").alias("parent_id")).distinct().withColumn("is_gold", F.lit(True))
    mark = docs.join(parents, "parent_id", "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))
    known = mark.where("is_gold")
    room = known.agg((F.lit(most) - F.count(F.lit(1))).alias("_room"))
    first = mark.where("not is_gold").orderBy("doc_id").limit(most).withColumn("_nth", F.row_number().over(Window.orderBy("doc_id")))
    return known.unionByName(first.crossJoin(F.broadcast(room)).where("_nth <= _room").drop("_nth", "_room"))


def targets(limit: int, quotas: dict[str, float] = QUOTAS) -> dict[str, int]:
    """TOP-06: whole targets by type: shares rounded down, what is left over one by one."""
    out = {t: int(limit * q) for t, q in quotas.items()}
    for t in list(out) * limit:
        if sum(out.values()) >= limit:
            break
        out[t] += 1
    return out


def _greedy(candidates: DataFrame, limit: int, by: str, goals: dict[str, int], order: list[Column], fill_by_kind: bool) -> DataFrame:
    """Rows kind by kind in the order of ``goals``, each up to its goal, then filled up to ``limit``; each document once.

    ``order`` is the candidates' order; filling goes through it kind by kind or as a whole. A greedy choice is a sequence,
    so it is made in one task. That task gets 2 * limit candidates of a kind at most: the first of each document, and no
    later one can be taken, as at most ``limit`` documents are used before and ``limit`` rows picked. Rows without a
    document are not taken.
    """
    rows = candidates.where("doc_id is not null")
    first = F.row_number().over(Window.partitionBy(by, "doc_id").orderBy(*order))
    rows = rows.withColumn("_first", first).where("_first = 1").drop("_first")
    rows = rows.withColumn("_few", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_few") <= 2 * limit).drop("_few")
    rows = rows.withColumn("_nth", F.row_number().over(Window.orderBy(*order)))

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_nth", kind="stable").reset_index(drop=True)
        docs, used, picked = g["doc_id"].tolist(), set(), []
        lanes: dict[str | None, list[int]] = {k: [] for k in goals}
        for i, kind in enumerate(g[by]):
            lanes.setdefault(kind if isinstance(kind, str) else None, []).append(i)

        def take(lane: list[int], goal: int) -> None:
            for i in lane:
                if goal == 0 or len(picked) == limit:
                    return
                if docs[i] not in used:
                    used.add(docs[i])
                    picked.append(i)
                    goal -= 1

        for kind, goal in goals.items():
            take(lanes[kind], goal)
        for lane in lanes.values() if fill_by_kind else [range(len(g))]:
            take(lane, limit)
        return g.loc[picked].drop(columns=["_g", "_nth"])

    return rows.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(choose, candidates.schema)


def select_quota(candidates: DataFrame, limit: int, quotas: dict[str, float] = QUOTAS) -> DataFrame:
    """TOP-06: rows by type quota, each document once, then filled up type by type. Needs ``doc_id, question_type, section_priority``."""
    return _greedy(candidates, limit, "question_type", targets(limit, quotas), [hash_order("doc_id"), F.col("section_priority"), F.col("doc_id")], True)


def select_balanced(candidates: DataFrame, limit: int, by: str, kinds: list[str]) -> DataFrame:
    """TOP-07: up to max(limit / kinds, 1) rows of each of ``kinds`` in turn, each document once, filled up in candidate order ``pos``."""
    return _greedy(candidates, limit, by, dict.fromkeys(kinds, max(limit // len(kinds), 1)), [F.col("pos")], False)


def protocol_order(name: str) -> list[Column]:
    """TOP-08: the orders of the five protocols."""
    return {
        "hard_negative": [F.desc("n_negatives"), F.col("lexical_overlap"), F.col("doc_id")],
        "low_overlap": [F.col("lexical_overlap"), F.desc("n_negatives"), F.col("doc_id")],
        "late_evidence": [F.desc("page_position_ratio"), F.col("lexical_overlap"), F.col("doc_id")],
        "section_balanced": [F.col("gold_section") == "abstract", hash_order("doc_id")],
        "balanced": [hash_order("doc_id")],
    }[name]


def qaset_summary(rows: DataFrame) -> DataFrame:
    """AGG-09: one row of quality figures."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    n = F.size("hard_negative_doc_ids")
    return rows.agg(
        F.count(F.lit(1)).alias("questions"),
        F.round(F.avg("lexical_overlap"), 6).alias("mean_overlap"),
        F.round(F.percentile("lexical_overlap", F.lit(0.5)), 6).alias("median_overlap"),
        share(F.col("lexical_overlap") < 0.2).alias("low_overlap_ratio"),
        share(F.col("lexical_overlap") >= 0.55).alias("high_overlap_ratio"),
        F.round(F.avg(n), 6).alias("mean_negatives"),
        F.min(n).cast("long").alias("min_negatives"),
        share(F.col("difficulty").isin("hard", "adversarial")).alias("hard_ratio"),
        share(F.col("review_status") == "manual_review").alias("manual_ratio"),
        share(F.col("review_status") == "rejected").alias("rejected_ratio"),
    )


def discrimination(rows: DataFrame) -> DataFrame:
    """AGG-10: spread of recall over the overall rows, and the gap between bm25 and vector."""
    of = lambda m: F.avg(F.when(F.col("method") == m, F.col("recall_at_10")))
    return rows.where("grp = 'overall'").agg(
        F.round(F.max("recall_at_10"), 6).alias("max_recall"),
        F.round(F.min("recall_at_10"), 6).alias("min_recall"),
        F.round(F.max("recall_at_10") - F.min("recall_at_10"), 6).alias("spread"),
        F.round(F.avg("recall_at_10"), 6).alias("mean_recall"),
        F.round(F.avg("mrr"), 6).alias("mean_mrr"),
        F.round(of("bm25") - of("vector"), 6).alias("bm25_vector_gap"),
    )


def grids() -> Iterator[float]:
    """RET-07: default bm25 weights."""
    yield from (0.6, 0.7, 0.8, 0.9)
