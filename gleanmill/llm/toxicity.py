"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words and beginnings of words (insults are inflected) is trained from confirmed toxic texts and
unlabelled text, with the non-negative risk estimator: risk = prior * P[loss(+)] + max(0, U[loss(-)] - prior * P[loss(-)]),
where P and U are means over the confirmed and the unlabelled texts; when the second part falls below zero, its gradient is
turned round. The class prior is the share of toxic among the labels that may be learnt from.

The confirmed texts are all that the labels give, the unlabelled ones are all documents: one pass counts in how many texts
each word bucket is, which decides the features; another reduces each text to the features that it has and counts equal
patterns, from which all means and gradients follow. These are sums of whole numbers, so that neither the order of the
patterns nor the place where they are summed changes a bit of them: up to ``PATTERNS`` distinct patterns the driver sums,
beyond that the tasks that hold the patterns do, in one short round a step, and the model is the same.

A null or empty text has no words and gets the score of the intercept alone. Ids, languages, sources and labels are no inputs of a
score, so equal texts have equal scores. Null ids are not held out and can't be confirmed; repeated rows count as often as
they are there and repeat their result; an empty table gives an empty result. Without confirmed toxic texts every score is
the prior (or 0). Only the id, the text and the two label columns are read; other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing, runtime

#: Hash buckets of words.
BUCKETS = 1 << 18
#: Distinct patterns of features that one process sums (some MB): the driver, or a task each where there are more.
PATTERNS = 200_000
#: Confirmed ids that are sent to all executors (about 10 MB); more become a bitmap, and the rows that it hits are joined.
BROADCAST_IDS = 200_000
#: Losses are summed in whole parts of one, sigmoids in parts of these as well; below so many texts the sums stay below 2**63.
PARTS, TEXTS = 1 << 20, 1 << 33
#: Bytes of a word's beginning that are features beside the word.
BEGINNINGS = (4, 5, 6)
#: Everything but ASCII letters and bytes of other scripts separates words.
_SEPARATES = np.ones(256, bool)
_SEPARATES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_buckets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of texts: each text's distinct word buckets, one after the other, and where they begin."""
    for first, end, data, bounds in hashing.blocks(column):
        starts, ends = hashing.word_spans(data, bounds, _SEPARATES)
        hashes = hashing.span_hashes(data, starts, [ends, *(np.minimum(starts + n, ends) for n in BEGINNINGS)])
        row = np.repeat(np.arange(end - first), np.diff(np.searchsorted(starts, bounds))).astype(np.int64) * BUCKETS
        both = np.unique(np.concatenate([row + (h & hashing.U64(BUCKETS - 1)).astype(np.int64) for h in hashes]))
        yield both % BUCKETS, np.searchsorted(both, np.arange(end - first + 1) * BUCKETS)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for buckets, firsts in word_buckets(column):
            total = np.concatenate(([0.0], np.cumsum(self.weights[buckets])))
            # rounded, so that a text's score does not depend on the texts before it
            f = np.round(self.intercept + total[firsts[1:]] - total[firsts[:-1]], 9)
            out.append(1 / (1 + np.exp(-np.clip(f, -40, 40))))
        return np.concatenate(out) if out else np.zeros(0)


def choose(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int, features: int = 512) -> np.ndarray:
    """Buckets whose share among the confirmed texts is most surely above that among all: of ``p`` and ``u`` texts of ``n_p`` and ``n_u``."""
    pooled = (p + u + 1) / (n_p + n_u + 2)
    z = (p / max(n_p, 1) - u / max(n_u, 1)) / np.sqrt(pooled * (1 - pooled).clip(1e-9) * (1 / max(n_p, 1) + 1 / max(n_u, 1)))
    best = np.argsort(-z, kind="stable")[:features]
    return np.sort(best[(z[best] > 4) & (p[best] + u[best] >= 5)])


def _flat(patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all patterns, one after the other, and the pattern of each."""
    at = np.concatenate([*patterns, np.zeros(0, np.int64)]).astype(np.int64)
    return at, np.repeat(np.arange(len(patterns)), [len(x) for x in patterns])


def _having(at: np.ndarray, of: np.ndarray, p: np.ndarray, features: int) -> np.ndarray:
    """Confirmed texts with each feature; the last number is of all."""
    return np.append(np.bincount(at, p[of], minlength=features), p.sum())


def sums(w: np.ndarray, at: np.ndarray, of: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Totals over ``p`` texts of each pattern, and over ``u``: the losses as other text, then the sigmoids by feature, at last of all texts.

    The first half is in ``PARTS`` of one, the second has what the sigmoids have beyond that, in as many parts again.
    """
    f = np.clip(w[-1] + np.bincount(of, w[at], minlength=len(p)), -500, 500)
    loss = np.rint(PARTS * np.logaddexp(0, f)).astype(np.int64)
    sigmoid = np.rint(PARTS**2 / (1 + np.exp(-np.clip(f, -40, 40)))).astype(np.int64)
    out = np.zeros((2, 2, len(w) + 1), np.int64)
    for half, part in zip(out, np.divmod(sigmoid, PARTS), strict=True):
        for total, n in zip(half, (p, u), strict=True):
            slope = n * part
            total[-1] = slope.sum()
            np.add.at(total[1:-1], at, slope[of])
    out[0, :, 0] = (p * loss).sum(), (u * loss).sum()
    return out


def _parts(w: np.ndarray, totals: np.ndarray, having: np.ndarray, n_u: int, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    n = np.array([[max(having[-1], 1)], [max(n_u, 1)]])
    (loss_p, *slope_p), (loss_u, *slope_u) = (totals[0] / PARTS + totals[1] / PARTS**2) / n
    slope_p, slope_u, share = np.array(slope_p), np.array(slope_u), having / n[0]
    return prior * (loss_p - share @ w), loss_u - prior * loss_p, prior * (slope_p - share), slope_u - prior * slope_p


def risk(w: np.ndarray, patterns: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Both parts of the risk and their gradients; the last weight is the intercept. ``p`` and ``u`` count the texts of the patterns."""
    at, of = _flat(patterns)
    p, u = p.astype(np.int64), u.astype(np.int64)
    return _parts(w, sums(w, at, of, p, u), _having(at, of, p, len(w) - 1), int(u.sum()), prior)


def train(chosen: np.ndarray, patterns: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float, **how: float) -> Model:
    """Fit a model on patterns (places in ``chosen``) of ``p`` confirmed and ``u`` unlabelled texts."""
    at, of = _flat(patterns)
    p, u = p.astype(np.int64), u.astype(np.int64)
    return descend(chosen, partial(sums, at=at, of=of, p=p, u=u), _having(at, of, p, len(chosen)), int(u.sum()), prior, **how)


def descend(chosen: np.ndarray, totals: Callable[[np.ndarray], np.ndarray], having: np.ndarray, n_u: int, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 0.15) -> Model:
    """Fit a model by the ``totals`` that weights have (see ``sums``); ``decay`` over the number of confirmed texts shrinks weights."""
    weights = np.zeros(BUCKETS)
    if not having[-1] or not n_u or prior <= 0:
        return Model(weights, float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))
    w = np.zeros(len(chosen) + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    penalty = np.full(len(w), decay / having[-1])
    penalty[-1] = 0
    for step in range(1, steps + 1):
        _, other, g_toxic, g_other = _parts(w, totals(w), having, n_u, prior)
        g = (g_toxic + g_other if other >= 0 else -g_other) + penalty * w
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights[chosen] = w[:-1]
    return Model(weights, float(w[-1]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (positive, text) to (bucket, p, u): texts with a bucket, one row a bucket and task; bucket -1 has all texts."""
    p, u, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), np.zeros(2, np.int64)
    for batch in batches:
        positive = batch.column(0).fill_null(False).to_numpy(zero_copy_only=False)
        row = 0
        for buckets, firsts in word_buckets(batch.column(1)):
            own = positive[row : row + len(firsts) - 1]
            row += len(own)
            u += np.bincount(buckets, minlength=BUCKETS)
            for i in np.flatnonzero(own).tolist():
                p[buckets[firsts[i] : firsts[i + 1]]] += 1
            n += (own.sum(), len(own))
    if n[1]:
        at = np.flatnonzero(u)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(p[at], n[0])), pa.array(np.append(u[at], n[1]))], names=["bucket", "p", "u"])


def _patterns(place, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (positive, text) to (pattern, p, u): the features of a text, as bytes, with the texts that have just these."""
    found: dict[bytes, list[int]] = {}

    def out() -> pa.RecordBatch:
        columns = [pa.array(list(found), pa.binary()), *(pa.array([v[k] for v in found.values()], pa.int64()) for k in (0, 1))]
        found.clear()
        return pa.RecordBatch.from_arrays(columns, names=["pattern", "p", "u"])

    for batch in batches:
        positive = batch.column(0).fill_null(False).to_pylist()
        row = 0
        for buckets, firsts in word_buckets(batch.column(1)):
            at = place.value[buckets]
            known = np.concatenate(([0], np.cumsum(at >= 0)))[firsts]
            at = at[at >= 0].astype("<i2")
            for lo, hi in zip(known[:-1].tolist(), known[1:].tolist(), strict=True):
                counts = found.setdefault(at[lo:hi].tobytes(), [0, 0])
                counts[0] += positive[row]
                counts[1] += 1
                row += 1
        if len(found) > 50_000:
            yield out()
    if found:
        yield out()


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (pattern, p, u) as ``sums`` takes them."""
    sizes = pc.binary_length(batch.column(0)).to_numpy() // 2
    at = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i2").astype(np.int64)
    return at, np.repeat(np.arange(len(sizes)), sizes), batch.column(1).to_numpy(), batch.column(2).to_numpy()


def _sums(w: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pattern, p, u) to one row a task: what ``sums`` gives for them, as bytes."""
    total = np.zeros((2, 2, len(w) + 1), np.int64)
    for batch in batches:
        total += sums(w, *_unpacked(batch))
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["total"])


def _gathered(patterns: DataFrame, w: np.ndarray) -> np.ndarray:
    """``sums`` of all patterns, made where they are; some KB of each task reach the driver."""
    parts = patterns.mapInArrow(partial(_sums, w), "total binary").toArrow().column(0).to_pylist()
    return np.sum([np.frombuffer(x, np.int64) for x in parts], axis=0).reshape(2, 2, -1)


def _score(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(batch.column(1)), pa.float64())], names=["doc_id", "score"])


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _marked(docs: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``positive, text`` of every row; positive is true for confirmed ids, else null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = confirmed.withColumn("positive", F.lit(True))
    if confirmed.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(marks), "doc_id", "left").select("positive", "text")
    told = runtime.hits(confirmed, rows, F.col("doc_id"))
    hit = told.where("hit").select("row.*").join(marks, "doc_id", "left").select("positive", "text")
    return hit.unionByName(told.where("not hit").select(F.lit(None).cast("boolean").alias("positive"), "row.text"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on all documents as unlabelled and on all confirmed toxic ids.

    Broadcast are the ids (or a bitmap of them); the driver gets one row a bucket and one a pattern (or one a task and step).
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    may = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    may = may.where(~is_held_out(F.col("doc_id")))
    prior = float(may.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0)
    texts = _marked(docs, may.where("toxic = 1").select("doc_id").distinct())
    counts = texts.mapInArrow(_count, "bucket long, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()
    at, *both = (c.to_numpy() for c in counts.columns)
    p, u = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for total, part in zip((p, u), both, strict=True):
        total[at[at >= 0]] = part[at >= 0]
    n_p, n_u = (int(part[at < 0].sum()) for part in both)
    if n_u >= TEXTS:
        raise ValueError(f"sums over {n_u} texts could exceed 64 bits")
    if not n_p or prior <= 0:
        return train(np.zeros(0, np.int64), [], np.zeros(0), np.zeros(0), prior)
    chosen = choose(p, u, n_p, n_u)
    place = np.full(BUCKETS, -1, np.int16)
    place[chosen] = np.arange(len(chosen))
    found = texts.mapInArrow(partial(_patterns, spark.sparkContext.broadcast(place)), "pattern binary, p long, u long").groupBy("pattern").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    found = runtime.cut(found, "patterns")
    tasks = -(-found.count() // PATTERNS)
    if tasks > 1:
        whole, found = found, runtime.cut(found.repartition(tasks, "pattern"), "patterns")
        runtime.drop(whole)
        totals = partial(_gathered, found)
    else:
        (rows,) = found.toArrow().combine_chunks().to_batches()
        totals = partial(sums, **dict(zip(("at", "of", "p", "u"), _unpacked(rows), strict=True)))
    model = descend(chosen, totals, np.append(p[chosen], n_p), n_u, prior)
    runtime.drop(found)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row's whole text. The model (2 MB) is broadcast."""
    spark = docs.sparkSession
    runtime.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(partial(_score, shared), "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
