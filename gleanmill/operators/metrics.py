"""Evaluation metrics and their summaries (MET, AGG)."""

from __future__ import annotations

import difflib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as tx
from . import retrieval as rt

# Answers that admit missing grounds.
UNSUPPORTED = ["확인할 수 없습니다", "확인할 수는 없습니다", "근거가 부족"]


def judged(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """JN-11: adds ``relevant`` and ``n_gold``: whether (query_id, parent_id) is gold and, where gold has pages, the pages meet.

    ``gold``: query_id, parent_id[, gold_pages array].
    """
    sizes = gold.groupBy("query_id").agg(F.count_distinct("parent_id").alias("n_gold"))
    pages = F.coalesce(F.col("gold_pages"), F.array().cast("array<int>")) if "gold_pages" in gold.columns else F.array().cast("array<int>")
    marks = gold.select("query_id", "parent_id", pages.alias("_pages"), F.lit(True).alias("_gold")).dropDuplicates(["query_id", "parent_id"])
    rows = ranking.join(marks, ["query_id", "parent_id"], "left").join(sizes, "query_id", "left")
    met = tx.page_overlap(F.col("_pages"), F.col("page_start"), F.col("page_end")) if "page_start" in ranking.columns else F.lit(True)
    return rows.withColumn("relevant", F.coalesce(F.col("_gold") & met, F.lit(False))).withColumn("n_gold", F.coalesce("n_gold", F.lit(0))).drop("_gold", "_pages")


def ideal_dcg(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))


def per_question(rows: DataFrame, k: int = 10, hit: bool = False) -> DataFrame:
    """MET-01..03, MET-05, MET-06, WIN-07: one row a query of judged rankings. ``hit``: recall is a flag."""
    rel = F.col("relevant").cast("int")
    within = lambda n: F.when((F.col("rank") <= n) & F.col("relevant"), 1).otherwise(0)
    gains = F.sum(F.when(F.col("rank") <= k, rel / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0))
    out = rows.groupBy("query_id").agg(
        F.first("n_gold").alias("n_gold"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.sum(within(5)).alias("h5"),
        F.sum(within(k)).alias("hk"),
        gains.alias("dcg"),
        F.count(F.when(F.col("rank") <= k, 1)).alias("n"),
    )
    recall = lambda c: F.when(F.col("n_gold") == 0, 0.0).otherwise(F.least(F.col(c), F.lit(1)) if hit else F.col(c) / F.col("n_gold"))
    return out.select(
        "query_id",
        F.coalesce("first", F.lit(0)).cast("long").alias("rank"),
        recall("h5").cast("double").alias("recall_at_5"),
        recall("hk").cast("double").alias("recall_at_10"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.round(F.when(F.col("n_gold") == 0, 0.0).otherwise(F.col("dcg") / ideal_dcg(F.least(F.col("n_gold"), F.lit(k)))), 6).alias("ndcg_at_10"),
        F.round(F.col("hk") / F.greatest(F.col("n"), F.lit(1)), 6).alias("context_precision_at_10"),
        (F.col("hk") > 0).cast("double").alias("context_recall"),
    )


def summary(rows: DataFrame, dims: list[str], metrics: list[str]) -> DataFrame:
    """AGG-01, AGG-02: means by method over all rows and by each of ``dims``, as GROUPING SETS; ``grp`` names the group."""
    rows = rows.select("method", *dims, *metrics)
    sets = [[F.col("method")], *[[F.col("method"), F.col(d)] for d in dims]]
    means = [F.round(F.avg(m), 6).alias(m) for m in metrics]
    out = rows.groupingSets(sets, "method", *dims).agg(F.count(F.lit(1)).alias("questions"), *means, *[F.grouping(d).alias(f"_{d}") for d in dims])
    label = F.lit("overall")
    for i, d in enumerate(dims):
        label = F.when(F.col(f"_{d}") == 0, F.col(d) if i == 0 else F.concat(F.lit(f"{d}:"), F.col(d))).otherwise(label)
    return out.select("method", label.alias("grp"), "questions", *metrics)


_PICKED = {"half": "floor(n / 2)", "round": "least(bround(n * 0.95), n - 1)", "floor": "floor((n - 1) * 0.95)"}


def pick_by_index(rows: DataFrame, group: str, value: str, picks: dict[str, str]) -> DataFrame:
    """AGG-05, AGG-06: for each group values of its sorted list by index, as columns named by ``picks``.

    ``half`` is n / 2, ``round`` 0.95 n (rounded), ``floor`` 0.95 (n - 1). Nulls are no values. Equal values are counted
    before the shuffle; ranges of (group, value) total their counts, so places in the sorted list are known without
    gathering a group.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = shared.cut(counted.repartitionByRange(parts, "g", "v").withColumn("part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("g", "part").agg(F.sum("c").alias("t"))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("g").alias("_g"), F.col("part").alias("_part"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("offset"), F.sum("t").over(Window.partitionBy("g")).alias("n"))
    upto = F.sum("c").over(Window.partitionBy("part", "g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("upto", upto).join(offsets, F.col("g").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_part")))
    end = F.col("offset") + F.col("upto")
    at = {name: F.expr(_PICKED[how]) for name, how in picks.items()}
    return placed.groupBy(F.col("g").alias(group)).agg(*[F.max(F.when((end > i) & (end - F.col("c") <= i), F.col("v"))).alias(name) for name, i in at.items()])


def bootstrap(rows: DataFrame, group: str, value: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """AGG-07: ``grp, mean, low, high``: the mean with the 25th and 975th of 1000 sorted resampled means.

    A resample gives each row a Poisson weight of mean 1, which is what drawing n of n rows with replacement tends to, and
    which rows can draw where they are: equal values together, from a hash of group and value, so that results don't
    depend on partitions. Each task keeps ``resamples`` sums for a group. Resamples without a row (of tiny groups) have no mean. Nulls are no values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).cast("string").alias("grp"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counted = counted.withColumn("key", F.xxhash64(F.coalesce("grp", F.lit("")), "v", F.lit(seed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        for b in batches:
            for grp, v, c, key in zip(*(x.to_pylist() for x in b.columns), strict=True):
                drawn = np.random.Generator(np.random.Philox(key=key & (2**64 - 1))).poisson(c, resamples)
                both = sums.setdefault(grp, np.zeros((2, resamples)))
                both[0] += drawn
                both[1] += drawn * v
        for grp, both in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([grp] * resamples, pa.string()), pa.array(range(resamples), pa.int32()), pa.array(both[0]), pa.array(both[1])], names=["grp", "resample", "w", "x"])

    drawn = counted.mapInArrow(run, "grp string, resample int, w double, x double").groupBy("grp", "resample").agg(F.try_divide(F.sum("x"), F.sum("w")).alias("m"))
    means = drawn.groupBy("grp").agg(F.sort_array(F.collect_list(F.col("m"))).alias("m"))  # one a resample
    whole = counted.groupBy(F.col("grp").alias("_grp")).agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    pick = lambda share: F.get("m", (F.size("m") * F.lit(share)).cast("int"))
    return whole.join(means, F.col("_grp").eqNullSafe(F.col("grp"))).select("grp", "mean", pick(0.025).alias("low"), pick(0.975).alias("high"))


def timed(search: Callable[[DataFrame], DataFrame], questions: DataFrame, folder: str = "timed") -> DataFrame:
    """MET-14: a ranking with ``latency_ms``: the search's wall clock time over the number of its questions.

    Spark answers questions together, so each has the mean of the batch.
    """
    began = time.perf_counter()
    out = shared.cut(search(questions), folder)
    each = (time.perf_counter() - began) * 1000 / max(questions.count(), 1)
    return out.withColumn("latency_ms", F.lit(each))


# ---- evaluation loops


def evaluate_answers(ranking: DataFrame, gold: DataFrame, k: int = 10, match_parent: bool = False) -> DataFrame:
    """MET-04: one row: mean recall, reciprocal rank and nDCG of all questions, interpolated latency percentiles.

    ``ranking``: query_id, doc_id, score, rank, latency_ms[, parent_id], fetched 5 times over where parents are matched;
    parents are then taken once each. Questions are those of ``gold`` (query_id, parent_id); ``questions`` is 1 at least.
    """
    rows = ranking if match_parent else ranking.withColumn("parent_id", F.col("doc_id"))
    rows = rt.dedupe_parents(rows, 5 * k) if match_parent else rows
    per = per_question(judged(rows.where(F.col("rank") <= k), gold))
    asked = gold.select("query_id").distinct().join(per, "query_id", "left").join(ranking.groupBy("query_id").agg(F.max("latency_ms").alias("latency_ms")), "query_id", "left")
    means = [F.coalesce(F.round(F.avg(F.coalesce(F.col(m), F.lit(0.0))), 6), F.lit(0.0)).alias(m) for m in ("recall_at_5", "recall_at_10", "mrr", "ndcg_at_10")]
    return asked.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double").alias("questions"), *means, F.percentile("latency_ms", F.lit(0.5)).alias("p50_latency_ms"), F.percentile("latency_ms", F.lit(0.95)).alias("p95_latency_ms"))


def evaluate_case(questions: DataFrame, ranking: DataFrame, k: int = 10) -> DataFrame:
    """MET-07: a row for each question: metrics by parent, share of the evidence's words found, and what was retrieved.

    ``questions``: query_id, question_type, difficulty, gold_doc_ids (array), evidence_text; ``ranking``: query_id, rank,
    parent_id, chunk_id, page_start, page_end, section_id, content, over-fetched 5 times. Questions without results have
    zeros and empty strings. At most k rows of a question are gathered.
    """
    best = rt.dedupe_parents(ranking, k)
    gold = questions.select("query_id", F.explode("gold_doc_ids").alias("parent_id")).distinct()
    text = lambda c: tx.blank(F.col(c).cast("string"))
    page = F.when((F.col("page_start") == F.col("page_end")) | F.col("page_end").isNull(), text("page_start")).otherwise(F.concat_ws("-", "page_start", "page_end"))
    told = F.struct("rank", text("parent_id").alias("doc"), text("chunk_id").alias("chunk"), page.alias("page"), text("section_id").alias("section"), text("content").alias("content"))
    got = best.groupBy("query_id").agg(F.sort_array(F.collect_list(told)).alias("got"))
    joined = lambda field, sep="|": F.coalesce(F.array_join(F.transform("got", lambda r: r[field]), sep), F.lit(""))
    snippets = F.coalesce(F.array_join(F.transform("got", lambda r: F.substring(tx.collapse(r["content"]), 1, 180)), " || "), F.lit(""))
    metrics = ["rank", "recall_at_5", "recall_at_10", "mrr", "ndcg_at_10", "context_precision_at_10"]
    per = per_question(judged(best, gold), k, hit=True).select("query_id", *metrics)
    rows = questions.join(per, "query_id", "left").join(got, "query_id", "left")
    return rows.select(
        "query_id",
        "question_type",
        "difficulty",
        F.coalesce("rank", F.lit(0)).alias("rank"),
        *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in metrics[1:]],
        evidence_coverage(F.col("evidence_text"), joined("content", " ")).alias("gold_evidence_in_retrieved_context"),
        joined("doc").alias("retrieved_doc_ids"),
        joined("chunk").alias("retrieved_chunk_ids"),
        joined("page").alias("retrieved_pages"),
        joined("section").alias("retrieved_section_ids"),
        snippets.alias("retrieved_snippets"),
    )


def _in_groups(rows: DataFrame, keys: list[str], labels: Column) -> DataFrame:
    """Each row once for every group it is in, with the group's name and a key of all."""
    return rows.withColumn("grp", F.explode(labels)).withColumn("_group", F.concat_ws("\u0001", *keys, "grp"))


def _summaries(rows: DataFrame, keys: list[str], labels: Column, metrics: list[str], interval: str | None) -> DataFrame:
    grouped = _in_groups(rows, keys, labels)
    out = grouped.groupBy(*keys, "grp", "_group").agg(F.count(F.lit(1)).alias("questions"), *[F.round(F.avg(F.col(m).cast("double")), 6).alias(m) for m in metrics])
    out = out.join(pick_by_index(grouped, "_group", "latency_ms", {"p50_latency_ms": "half", "p95_latency_ms": "round"}), "_group", "left")
    if interval:
        ci = bootstrap(grouped, "_group", interval).select(F.col("grp").alias("_group"), F.round("low", 6).alias(f"{interval}_ci_low"), F.round("high", 6).alias(f"{interval}_ci_high"))
        out = out.join(ci, "_group", "left")
    return out.drop("_group")


OFFICE_METRICS = ["recall_at_5", "recall_at_10", "mrr", "ndcg_at_10", "context_precision_at_10", "context_recall"]
CASE_METRICS = ["recall_at_5", "recall_at_10", "mrr", "ndcg_at_10", "context_precision_at_10", "gold_evidence_in_retrieved_context"]


def office_summary(rows: DataFrame) -> DataFrame:
    """AGG-01: by method over all questions (``overall``) and by type: six means, the interval of recall, latency by index.

    ``rows``: method, question_type, the metrics, latency_ms.
    """
    return _summaries(rows, ["method"], F.array(F.lit("overall"), F.coalesce("question_type", F.lit("unknown"))), OFFICE_METRICS, "recall_at_10")


def case_summary(rows: DataFrame) -> DataFrame:
    """AGG-02: by case and method over all questions, by type, and by difficulty where there is one."""
    hard = F.when(F.col("difficulty") != "", F.concat(F.lit("difficulty:"), "difficulty"))
    labels = F.array_compact(F.array(F.lit("overall"), F.coalesce("question_type", F.lit("unknown")), hard))
    return _summaries(rows, ["case_id", "method"], labels, CASE_METRICS, None)


def rank_summary(rows: DataFrame, dims: list[str], methods: tuple[str, ...] = ("bm25", "vector", "hybrid")) -> DataFrame:
    """AGG-03: for each value of each of ``dims``: questions, recall at 10 and reciprocal rank by method, vector misses, median length.

    ``rows``: the dims, ``<method>_rank`` (null: not found) and gold_content_len. All dims are grouped in one pass.
    """
    columns = [F.struct(F.lit(d).alias("group_key"), F.col(d).cast("string").alias("grp")) for d in dims]
    grouped = rows.withColumn("_d", F.explode(F.array(*columns))).select("_d.*", *[c for c in rows.columns if c not in ("group_key", "grp")])
    rank = lambda m: F.col(f"{m}_rank")
    figures = [f for m in methods for f in (F.round(F.avg(F.when(rank(m) <= 10, 1.0).otherwise(0.0)), 6).alias(f"{m}_recall_at_10"), F.round(F.avg(F.coalesce(1 / rank(m), F.lit(0.0))), 6).alias(f"{m}_mrr"))]
    miss = F.count_if(F.coalesce(rank("vector") > 10, F.lit(True)))
    return grouped.groupBy("group_key", "grp").agg(F.count(F.lit(1)).alias("questions"), F.median("gold_content_len").alias("median_gold_content_len"), *figures, miss.alias("vector_miss_at_10"))


def from_ranks(rank: Column) -> dict[str, Column]:
    """MET-13: recall at 10 and reciprocal rank from a nullable rank."""
    return {"recall_at_10": F.avg(F.when(rank <= 10, 1.0).otherwise(0.0)), "mrr": F.avg(F.coalesce(1 / rank, F.lit(0.0)))}


def evidence_coverage(evidence: Column, context: Column) -> Column:
    """MET-08: share of the evidence's distinct lower-case words (over one character) that the context contains."""
    terms = F.array_distinct(F.filter(F.split(F.lower(tx.collapse(evidence)), " "), lambda x: F.length(x) > 1))
    low = F.lower(tx.blank(context))
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.round(F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.size(terms), 6))


def metric_tokens(c: Column) -> Column:
    """MET-09: lower-case words; Hangul words of two or more as pairs of characters."""
    words = F.regexp_extract_all(F.lower(tx.blank(c)), F.lit(tx.WORDS), F.lit(0))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike("^[가-힣]{2,}$"), pairs(w)).otherwise(F.array(w))))


def token_f1(pairs: DataFrame) -> DataFrame:
    """MET-09, SET-05: ``pair_id, token_f1`` of ``pair_id, answer, reference``: multiset overlap by grouped counts."""
    counted = lambda c, n: pairs.select("pair_id", F.explode(metric_tokens(F.col(c))).alias("token")).groupBy("pair_id", "token").agg(F.count(F.lit(1)).alias(n))
    both = counted("answer", "a").join(counted("reference", "r"), ["pair_id", "token"], "full")
    sums = both.groupBy("pair_id").agg(F.sum(F.least(F.coalesce("a", F.lit(0)), F.coalesce("r", F.lit(0)))).alias("c"), F.sum("a").alias("a"), F.sum("r").alias("r"))
    f1 = F.when((F.col("c") > 0), 2 * (F.col("c") / F.col("a")) * (F.col("c") / F.col("r")) / (F.col("c") / F.col("a") + F.col("c") / F.col("r"))).otherwise(0.0)
    return pairs.select("pair_id").join(sums, "pair_id", "left").select("pair_id", F.round(F.coalesce(f1, F.lit(0.0)), 6).alias("token_f1"))


def unsupported(answer: Column, error: Column | None = None) -> Column:
    """MET-10: whether an answer admits missing grounds, or was not given because of an error."""
    out = F.coalesce(error != "", F.lit(False)) if error is not None else F.lit(False)
    for marker in UNSUPPORTED:
        out = out | F.contains(answer, F.lit(marker))
    return out.cast("double")


def grounded(answer: Column, parent_ids: Column, gold_ids: Column | None = None, gold_in_context: Column | None = None, error: Column | None = None) -> dict[str, Column]:
    """MET-10, MET-12: flags of an answer: it cites a context, the first gold document, admits missing grounds, has text; its length.

    ``gold_in_context``: from ``context_has_gold``; without it, whether a gold id is among the contexts' parents.
    """
    names = F.transform(parent_ids, lambda p: p.cast("string"))
    out = {"cites_context": F.exists(names, lambda p: F.contains(answer, p)).cast("double"), "unsupported_answer": unsupported(answer, error), "non_empty": (F.trim(answer) != "").cast("double")}
    if gold_ids is not None:
        golds = F.transform(gold_ids, lambda g: g.cast("string"))
        first = F.coalesce(F.get(golds, 0), F.lit(""))
        out["gold_in_context"] = gold_in_context if gold_in_context is not None else F.arrays_overlap(names, golds).cast("double")
        out["cites_gold"] = ((first != "") & F.contains(answer, first)).cast("double")
        out["answer_chars"] = F.length(answer).cast("long")
    return out


def context_has_gold(contexts: DataFrame, gold: DataFrame) -> DataFrame:
    """MET-10: ``query_id, gold_in_context``: whether a context is of a gold parent and, where gold has pages, of one of these."""
    return judged(contexts, gold).groupBy("query_id").agg(F.max(F.col("relevant").cast("double")).alias("gold_in_context"))


def _matching(parsed: pd.Series, oracle: pd.Series) -> pd.DataFrame:
    out = []
    for a, b in zip(parsed.fillna(""), oracle.fillna(""), strict=True):
        m = difflib.SequenceMatcher(None, a, b, autojunk=False)
        same = sum(x.size for x in m.get_matching_blocks())
        out.append((same / len(a) if a else float(not b), same / len(b) if b else 1.0, m.ratio()))
    return pd.DataFrame(out, columns=["precision", "recall", "similarity"])


def char_similarity(parsed: Column, oracle: Column) -> Column:
    """MET-11: precision, recall and similarity by the matching blocks of two normalised texts, without the popularity heuristic."""
    return F.pandas_udf(_matching, "precision double, recall double, similarity double")(parsed, oracle)


def _window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n characters, from those of half as many: the work doesn't grow with n."""
    base = 0x9E3779B97F4A7C15
    step, size, out, done = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 1, None, 0
    while True:
        if n & size:
            out = step if out is None else out[: len(step) - done] * np.uint64(pow(base, size, 1 << 64)) + step[done:]
            done += size
            if done == n:
                return out
        step = step[: len(step) - size] * np.uint64(pow(base, size, 1 << 64)) + step[size:]
        size *= 2


def duplicate_ngrams(c: Column, n: int = 20) -> Column:
    """AGG-20: share of n-character windows that repeat an earlier one; 0 for shorter texts."""

    def share(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(codes) >= n:
                hashes = _window_hashes(codes, n)
                hashes.sort()
                out[i] = 1 - (1 + np.count_nonzero(hashes[1:] != hashes[:-1])) / len(hashes)
        return pd.Series(out)

    return F.pandas_udf(share, "double")(tx.blank(c))
