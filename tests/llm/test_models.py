"""The two learners: toxicity and importance resampling."""

import math
import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanmill.llm import hashing, resample, toxicity

L, S = T.LongType(), T.StringType()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


EDGE = [(1, None, "x"), (2, "", "x"), (None, "no id", "x"), (3, "a b", "x"), (3, "a b", "x"), (4, "long " * 50000, "x"), (5, "!!! ??? 123", "x")]
SCHEMA = T.StructType([T.StructField("doc_id", L), T.StructField("text", S), T.StructField("score", S)])


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    pairs = [(a > b) + (a == b) / 2 for a, x in held for b, y in held if x == 1 and y == 0]
    assert np.mean(pairs) > 0.95  # of these labels some 7 % mark texts without any insult
    assert sum(a >= 0.7 for a, x in held if x == 0) < 0.02 * len(held)
    by_text = {}
    for d, r in zip(sorted(docs.collect(), key=lambda d: d.doc_id), sorted(rows, key=lambda r: r.doc_id), strict=True):
        assert by_text.setdefault(d.text, r.score) == r.score


def test_toxicity_edge_rows(spark, tables):
    df = spark.createDataFrame(EDGE, SCHEMA)
    rows = toxicity.score_documents(df, tables[1]).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], T.StructType([T.StructField("doc_id", L), T.StructField("toxic", L)]))
    assert toxicity.score_documents(df, none).count() == len(EDGE)
    assert toxicity.score_documents(df.limit(0), tables[1]).count() == 0


def plain_risk(w, texts, prior):
    """Texts (features, confirmed) one by one: the parts of the risk."""
    loss = lambda f: math.log1p(math.exp(-abs(f))) + max(-f, 0)
    f = [w[-1] + sum(w[j] for j in t) for t, _ in texts]
    confirmed = [x for x, (_, c) in zip(f, texts, strict=True) if c]
    return prior * np.mean([loss(x) for x in confirmed]), np.mean([loss(-x) for x in f]) - prior * np.mean([loss(-x) for x in confirmed])


def test_risk_and_gradient_equal_plain_version():
    rng = np.random.default_rng(3)
    texts = [(sorted(set(rng.integers(0, 6, rng.integers(0, 5)).tolist())), bool(rng.random() < 0.3)) for _ in range(200)]
    counts = Counter((tuple(t), c) for t, c in texts)
    patterns = sorted({t for t, _ in counts})
    p = np.array([counts[t, True] for t in patterns], float)
    u = np.array([counts[t, True] + counts[t, False] for t in patterns], float)
    arrays = [np.array(t, np.int64) for t in patterns]
    w = rng.normal(size=7)
    toxic, other, g_toxic, g_other = toxicity.risk(w, arrays, p, u, 0.2)
    assert np.allclose((toxic, other), plain_risk(w, texts, 0.2))
    for j in range(7):
        step = np.zeros(7)
        step[j] = 1e-6
        up, down = plain_risk(w + step, texts, 0.2), plain_risk(w - step, texts, 0.2)
        assert np.allclose([g_toxic[j], g_other[j]], [(a - b) / 2e-6 for a, b in zip(up, down, strict=True)], atol=1e-6)


def test_counts_and_patterns_equal_plain_version(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["bad", "worse", "good", "fine", "word", "x1y"], rng.integers(0, 7))) for _ in range(300)] + [None, ""]
    rows = [(i % 3 == 0 or None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "positive boolean, text string").repartition(3)
    own = {}
    for t in set(texts):
        (buckets, _), = toxicity.word_buckets(pa.array([t], pa.string()))
        own[t] = buckets.tolist()
    got = Counter()
    for b in df.mapInArrow(toxicity._count, "bucket long, p long, u long").collect():
        got.update({(b.bucket, "p"): b.p, (b.bucket, "u"): b.u})
    want = Counter()
    for positive, t in rows:
        for bucket in [*own[t], -1]:
            want.update({(bucket, "p"): bool(positive), (bucket, "u"): 1})
    assert +got == +want
    chosen = sorted({b for t in ("bad", "worse") for b in own.get(t) or toxicity.word_buckets(pa.array([t])).__next__()[0].tolist()})
    place = np.full(toxicity.BUCKETS, -1, np.int16)
    place[chosen] = np.arange(len(chosen))
    found = Counter()
    for r in df.mapInArrow(partial(toxicity._patterns, spark.sparkContext.broadcast(place)), "pattern binary, p long, u long").collect():
        found.update({(bytes(r.pattern), "p"): r.p, (bytes(r.pattern), "u"): r.u})
    plain = Counter()
    for positive, t in rows:
        pattern = np.array([chosen.index(b) for b in own[t] if b in chosen], "<i2").tobytes()
        plain.update({(pattern, "p"): bool(positive), (pattern, "u"): 1})
    assert +found == +plain


def test_patterns_beyond_the_bound_stand_for_all(spark, tables, monkeypatch):
    docs, labels = tables
    whole = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "PATTERNS", 40)
    part = toxicity.fit(docs, labels)
    column = pa.array([r.text for r in docs.collect()])
    a, b = whole.scores(column) >= 0.7, part.scores(column) >= 0.7
    assert a.sum() > 0 and (a != b).mean() < 0.05


def test_toxicity_model_is_the_same_wherever_it_is_summed(spark, tables, monkeypatch):
    docs, labels = tables
    whole = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "PATTERNS", 40)  # of 109
    monkeypatch.setattr(toxicity, "BROADCAST_IDS", 10, raising=False)
    spread = toxicity.fit(docs, labels)
    assert (whole.weights != 0).any()
    assert np.array_equal(whole.weights, spread.weights) and whole.intercept == spread.intercept


def test_toxicity_is_fitted_on_all_confirmed_texts(spark):
    texts = [f"the {'bad' if i % 2 and i % 10 != 3 else 'fine'} {'worse ' * (i % 7 == 1)}word{i % 5}" for i in range(14_000)]
    ids = spark.range(len(texts), numPartitions=3)
    docs = ids.select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, texts[:70])), (F.col("id") % 70 + 1).cast("int")).alias("text"))
    model = toxicity.fit(docs, ids.select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic")))
    learnt = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 != 1]
    p, u = Counter(texts[i] for i in learnt if i % 2), Counter(texts)
    assert p.total() > 4000
    own = {t: next(toxicity.word_buckets(pa.array([t])))[0] for t in u}
    by_bucket = [np.bincount(np.concatenate([own[t] for t in c]), np.repeat([c[t] for t in c], [len(own[t]) for t in c]), toxicity.BUCKETS).astype(int) for c in (p, u)]
    chosen = toxicity.choose(*by_bucket, p.total(), u.total())
    patterns = [np.flatnonzero(np.isin(chosen, own[t])) for t in u]
    plain = toxicity.train(chosen, patterns, np.array([p[t] for t in u]), np.array([u[t] for t in u]), np.mean([i % 2 for i in learnt]))
    assert (model.weights != 0).any()
    assert np.array_equal(model.weights, plain.weights) and model.intercept == plain.intercept


def test_confirmed_rows_are_marked_by_both_joins(spark, monkeypatch):
    docs = spark.createDataFrame([*[(i, f"t{i}") for i in range(60)], (7, "again"), (None, "no id"), (9, None)], "doc_id long, text string")
    confirmed = spark.createDataFrame([(i,) for i in [7, 9, 11, 500]], "doc_id long")
    want = Counter((True if r.doc_id in (7, 9, 11) else None, r.text) for r in docs.collect())
    for most in (4, 3):
        monkeypatch.setattr(toxicity, "BROADCAST_IDS", most)
        assert Counter(map(tuple, toxicity._marked(docs, confirmed).collect())) == want


def test_sums_do_not_depend_on_a_split():
    rng = np.random.default_rng(5)
    patterns = [np.sort(rng.choice(30, rng.integers(0, 9), replace=False)) for _ in range(400)]
    u = rng.integers(1, 1 << 24, 400)
    p = u // 50
    w = rng.normal(0, 4, 31)
    whole = toxicity.sums(w, *toxicity._flat(patterns), p, u)
    order = rng.permutation(400)
    parts = [toxicity.sums(w, *toxicity._flat([patterns[i] for i in o]), p[o], u[o]) for o in np.array_split(order, 7)]
    assert np.array_equal(whole, sum(parts))
    f = [w[-1] + w[t].sum() for t in patterns]
    for line, n in enumerate((p, u)):
        texts = n.tolist()
        assert whole[0, line, 0] / toxicity.PARTS == pytest.approx(sum(k * math.log1p(math.exp(x)) for k, x in zip(texts, f, strict=True)))
        for j in range(31):
            has = [(k, x) for k, x, t in zip(texts, f, patterns, strict=True) if j == 30 or j in t]
            assert whole[0, line, j + 1] / toxicity.PARTS + whole[1, line, j + 1] / toxicity.PARTS**2 == pytest.approx(sum(k / (1 + math.exp(-x)) for k, x in has))


def test_unlabelled_toxic_text_is_not_learnt_as_clean():
    rng = np.random.default_rng(1)
    text = lambda bad: np.unique(np.concatenate([rng.integers(100, 5000, 60), [1, 2, 3] if bad else []]).astype(int))
    positive = [text(True) for _ in range(150)]
    unlabelled = [text(rng.random() < 0.2) for _ in range(1500)]
    p, u = (np.bincount(np.concatenate(x), minlength=toxicity.BUCKETS) for x in (positive, positive + unlabelled))
    chosen = toxicity.choose(p, u, len(positive), len(positive) + len(unlabelled))
    patterns = [np.flatnonzero(np.isin(chosen, t)) for t in positive + unlabelled]
    model = toxicity.train(chosen, patterns, np.repeat([1.0, 0.0], [len(positive), len(unlabelled)]), np.ones(len(patterns)), 0.25)
    f = lambda t: model.weights[t].sum() + model.intercept
    assert np.mean([f(text(True)) > 0 for _ in range(100)]) > 0.97
    assert np.mean([f(text(False)) < 0 for _ in range(100)]) > 0.97


def plain_tokens(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+", (text or "").encode(), re.A)


def test_ngrams_equal_plain_version():
    texts = ["a b!! c", "", None, "é-x  y", "!!", " lead", "tail ", "a b!! c", "one", "x\ny"]
    column = pa.array(texts)
    single = {}
    for (_, _, data, bounds) in hashing.blocks(column):
        one, f1, two, f2 = resample.ngram_buckets(data, bounds)
        for i, t in enumerate(texts):
            tokens = plain_tokens(t)
            assert f1[i + 1] - f1[i] == len(tokens) and f2[i + 1] - f2[i] == max(len(tokens) - 1, 0)
            for gram, bucket in [*zip(tokens, one[f1[i] : f1[i + 1]]), *zip(zip(tokens, tokens[1:]), two[f2[i] : f2[i + 1]])]:
                assert single.setdefault(gram, bucket) == bucket
    assert len(set(single.values())) == len(single)


def test_resampling_equals_plain_version(spark, tables):
    docs, labels = tables
    rows, good = docs.collect(), {r.doc_id for r in labels.collect() if r.quality == 1}
    bucket = {}
    for _, _, data, bounds in hashing.blocks(pa.array([r.text for r in rows]), 1 << 30):
        one, f1, two, f2 = resample.ngram_buckets(data, bounds)
        for i, r in enumerate(rows):
            bucket[r.doc_id] = [*one[f1[i] : f1[i + 1]].tolist(), *two[f2[i] : f2[i + 1]].tolist()]
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(bucket[r.doc_id])
        if r.doc_id in good:
            target.update(bucket[r.doc_id])
    n, m = sum(raw.values()) + resample.BUCKETS, sum(target.values()) + resample.BUCKETS
    got = resample.resample(docs, labels, share=0.6).collect()
    assert len(got) == len(rows)
    for r in got:
        want = sum(math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in bucket[r.doc_id])
        assert abs(r.log_weight - want * resample.SCALE / max(len(bucket[r.doc_id]), 1)) < 1e-5
    chosen = sorted(got, key=lambda r: -r.key)[: math.ceil(0.6 * len(rows))]
    assert {r.doc_id for r in got if r.selected} == {r.doc_id for r in chosen}
    kept = resample.sample_documents(docs, labels, share=0.6)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in chosen)
    # by default, what the labels call good stays and junk goes
    bad = {r.doc_id for r in labels.collect() if r.quality == 0}
    stays = {r.doc_id for r in resample.resample(docs, labels).collect() if r.selected}
    assert len(good & stays) > 0.99 * len(good) and len(bad & stays) < 0.4 * len(bad)  # two standard errors of 400 labels


def test_noise_is_gumbel(spark):
    g = [r[0] for r in spark.range(4000).select(resample.gumbel(F.col("id"), F.col("id"), 3)).collect()]
    assert abs(np.mean(g) - 0.5772) < 0.08 and abs(np.var(g) - math.pi**2 / 6) < 0.25


def test_cut_of_top(spark):
    rng = np.random.default_rng(0)
    keys = [float(x) for x in np.concatenate([rng.normal(0, 1000, 3000), np.full(500, 7.25), rng.normal(7.25, 1e-9, 500)])]
    df = spark.createDataFrame([(k,) for k in keys], "key double")
    for k in (1, 2, 700, 1999, 2200, 3999):
        assert resample.cut_of_top(df, k, bins=16, few=5) == sorted(keys, reverse=True)[k - 1]
    assert resample.cut_of_top(df, 4000) == -math.inf and resample.cut_of_top(df, 0) == math.inf


def test_resampling_edge_rows(spark, tables):
    df = spark.createDataFrame(EDGE, SCHEMA)
    out = resample.resample(df, tables[1], share=0.5).collect()
    assert len(out) == len(EDGE) and sum(r.selected for r in out) >= 4
    assert sum(r.selected for r in out if r.doc_id == 3) in (0, 2)
    assert resample.sample_documents(df, tables[1]).columns == df.columns
    assert resample.resample(df.limit(0), tables[1]).count() == 0


def test_inclusion_follows_the_weights(spark):
    """Of 4 rows the first of each sample is row i in proportion to exp(weight); the second follows without replacement."""
    weights = [0.0, 0.7, -1.0, 1.5]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "doc_id long, w double").crossJoin(spark.range(4000).withColumnRenamed("id", "seed"))
    keyed = rows.select("doc_id", "seed", (F.col("w") + resample.gumbel(F.col("doc_id"), F.lit(""), F.col("seed"))).alias("key"))
    order = keyed.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct((-F.col("key")).alias("k"), "doc_id"))).alias("o")).select(*[F.col("o")[k]["doc_id"].alias(f"d{k}") for k in (0, 1)]).collect()
    share = np.exp(weights) / np.exp(weights).sum()
    first, pair = Counter(r.d0 for r in order), Counter((r.d0, r.d1) for r in order)
    for i in range(4):
        assert abs(first[i] / 4000 - share[i]) < 0.03
        for j in range(4):
            if i != j:
                assert abs(pair[i, j] / 4000 - share[i] * share[j] / (1 - share[i])) < 0.03
