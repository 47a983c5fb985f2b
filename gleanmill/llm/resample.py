"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample.

Tokens are runs of letters and digits, or of signs. Both models are multinomials over hashed token 1-grams and 2-grams:
the raw one counts every text, the target one a bounded sample of texts labelled good. A text's log importance weight is
the mean of log(target / raw) over its n-grams times ``SCALE``: that of a text of so many n-grams with the same mix. (Sums
over all n-grams grow with the text; of long texts the noise would not move any, and the sample would be a threshold.)
Adding Gumbel noise, drawn from a hash of the id, and keeping the k largest sums is a sample without replacement in
proportion to the weights. The sample's size is a share of the rows: given, or as many as the labels say are good.

A null or empty text has weight 1 (log 0). A null id draws its noise from the text. Rows with equal id and text are
kept or left together, and so are all rows that tie at the cut (more than k rows then stay). An empty table gives an
empty result; without good labels all weights are 1. Only the id and the text are read for scores; other
names cannot clash, and ``sample_documents`` gives back the columns it got.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing, runtime
from .hashing import U64, mix

BUCKETS = 1 << 16
#: N-grams of the text that a log weight is stated for.
SCALE = 100.0
_KIND = np.full(256, 2, np.uint8)  # signs
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def ngram_buckets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all 1-grams with each text's first, and of all 2-grams with each text's first."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if not n:
        empty = np.zeros(len(bounds), np.int64)
        return none, empty, none, empty
    kind = _KIND[data]
    change = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[bounds] = True
    starts = np.flatnonzero(change[:-1])
    ends = np.append(starts[1:], n)
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    h = hashing.span_hashes(data, starts, ends, fold=False)
    firsts = np.searchsorted(starts, bounds)
    two = mix(h[:-1] * U64(0xD6E8FEB86659FD93) + h[1:]) if len(h) > 1 else np.zeros(0, U64)
    inside = np.ones(len(two), bool)
    joints = firsts[(firsts > 0) & (firsts < len(h))] - 1
    inside[joints] = False
    before = np.concatenate(([0], np.cumsum(inside)))
    mask = U64(BUCKETS - 1)
    return (h & mask).astype(np.int64), firsts, (two[inside] & mask).astype(np.int64), before[np.minimum(firsts, len(two))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (good, text) to (bucket, raw, target): one row a bucket and task."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column(0).fill_null(False).to_numpy(zero_copy_only=False)
        for first, end, data, bounds in hashing.blocks(batch.column(1)):
            for buckets, firsts in zip(*[iter(ngram_buckets(data, bounds))] * 2, strict=True):
                raw += np.bincount(buckets, minlength=BUCKETS)
                for i in np.flatnonzero(good[first:end]).tolist():
                    np.add.at(target, buckets[firsts[i] : firsts[i + 1]], 1)
    at = np.flatnonzero(raw)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, most_good: int = 20_000, smoothing: float = 1.0) -> np.ndarray:
    """log(target / raw) by bucket. Raw counts cover all of ``docs``; target texts are at most ``most_good``, by a hash of the id.

    What is broadcast are the chosen ids, what reaches the driver is one row a bucket.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = good.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most_good).withColumn("good", F.lit(True))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id", "left")
    counts = texts.select("good", "text").mapInArrow(_count, "bucket long, raw long, target long")
    found = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.full(BUCKETS, smoothing), np.full(BUCKETS, smoothing)
    at = found.column(0).to_numpy()
    raw[at] += found.column(1).to_numpy()
    target[at] += found.column(2).to_numpy()
    if target.sum() == smoothing * BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weights(column: pa.Array, ratio: np.ndarray, scale: float = SCALE) -> np.ndarray:
    out = []
    for _, _, data, bounds in hashing.blocks(column):
        one, firsts, two, second = ngram_buckets(data, bounds)
        total = np.zeros(len(bounds) - 1)
        for buckets, at in ((one, firsts), (two, second)):
            for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                if hi > lo:
                    total[i] += ratio[buckets[lo:hi]].sum()
        grams = np.diff(firsts) + np.diff(second)
        out.append(np.round(total * scale / np.maximum(grams, 1), 6) + 0.0)
    return np.concatenate(out) if out else np.zeros(0)


def gumbel(doc_id: Column, text: Column, seed: int | Column) -> Column:
    """Standard Gumbel noise from a hash of the id (or of the text, without one)."""
    h = F.xxhash64(F.coalesce(doc_id.cast("long"), F.xxhash64(text)), F.lit(seed))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def _weigh(ratio, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        weights = log_weights(batch.column(1), ratio.value)
        keys = weights + batch.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights), pa.array(keys)], names=["doc_id", "log_weight", "key"])


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = 1) -> DataFrame:
    """``doc_id, log_weight, key`` (the weight plus noise) of every row. The ratios (0.5 MB) are broadcast."""
    spark = docs.sparkSession
    runtime.ship(spark)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), gumbel(F.col("doc_id"), F.coalesce(text, F.lit("")), seed).alias("noise"))
    return rows.mapInArrow(partial(_weigh, spark.sparkContext.broadcast(ratio)), "doc_id long, log_weight double, key double")


def cut_of_top(keyed: DataFrame, k: int, bins: int = 4096, few: int = 20_000) -> float:
    """The k-th largest ``key``, by counting in ever finer bins; only counts and at most ``few`` keys reach the driver."""
    lo, hi, n = keyed.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k >= n or n == 0:
        return -math.inf
    if k <= 0:
        return math.inf
    above, inside = 0, n  # rows above hi, rows in [lo, hi]
    while inside > few and lo < hi:
        step = (hi - lo) / bins
        if not step > 0 or lo + step == lo:
            break
        part = keyed.where((F.col("key") >= lo) & (F.col("key") <= hi))
        bin_of = F.least(F.floor((F.col("key") - lo) / step).cast("int"), F.lit(bins - 1))
        counts = part.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                lo, hi, inside = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]
    if lo == hi:
        return lo
    keys = keyed.where((F.col("key") >= lo) & (F.col("key") <= hi)).select("key").orderBy(F.desc("key")).limit(k - above).agg(F.min("key")).first()
    return keys[0]


def good_share(docs: DataFrame, labels: DataFrame) -> tuple[float, float]:
    """The share of good texts among the labelled ones, and the same plus two standard errors (1 where nothing is labelled)."""
    found = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    mean, n = found.agg(F.avg(F.col("quality").cast("double")), F.count(F.lit(1))).first()
    return (mean, min(1.0, mean + 2 * math.sqrt(mean * (1 - mean) / n))) if n else (1.0, 1.0)


def _fitted(docs: DataFrame, labels: DataFrame, share: float | None, seed: int) -> tuple[np.ndarray, DataFrame, float]:
    ratio = fit(docs, labels)
    keyed = runtime.cut(weigh(docs, ratio, seed), "weights")
    k = math.ceil((good_share(docs, labels)[1] if share is None else share) * keyed.count())
    return ratio, keyed, cut_of_top(keyed, k)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 1) -> DataFrame:
    """``doc_id, log_weight, key, selected`` of every row; ``share`` of the rows are selected (None: the upper bound of ``good_share``)."""
    _, keyed, cut = _fitted(docs, labels, share, seed)
    return keyed.withColumn("selected", F.col("key") >= cut)


def _filter(ratio, cut: float, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, noise) to the rows whose key reaches the cut."""
    for batch in batches:
        rows = batch.column(0)
        keys = log_weights(rows.field(at).cast(pa.string()), ratio.value) + batch.column(1).to_numpy()
        kept = rows.filter(pa.array(keys >= cut))
        yield pa.RecordBatch.from_arrays([kept.field(i) for i in range(kept.type.num_fields)], names=[kept.type.field(i).name for i in range(kept.type.num_fields)])


def sample_documents(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 1) -> DataFrame:
    """The selected rows with their columns. Rows are weighed again rather than joined, so no text is shuffled."""
    ratio, keyed, cut = _fitted(docs, labels, share, seed)
    runtime.drop(keyed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    noisy = docs.select(row, gumbel(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")), seed).alias("noise"))
    return noisy.mapInArrow(partial(_filter, docs.sparkSession.sparkContext.broadcast(ratio), cut, docs.columns.index("text")), docs.schema)
