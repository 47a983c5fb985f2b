"""The Jaccard join against a brute-force version, its candidate guarantee, and the component search."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanmill.llm import graph, hashing, jaccard, runtime
from gleanmill.llm.jaccard import Rule

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("region", T.StringType()), T.StructField("n", T.StringType())])


def plain_set(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_components(rows, rule):
    sets = [plain_set(t, rule.words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in holders[g] if j < i)
        for j, c in common.items():
            if rule.den * c >= rule.num * (len(s) + len(sets[j]) - c):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    best = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            best[root(i)] = min(best.get(root(i), doc), doc)
    return sorted(((doc, len(sets[i]), best.get(root(i))) for i, (doc, _) in enumerate(rows)), key=str)


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(w))
            kind = rng.randrange(3)
            if kind == 0:
                w[at] = f"new{rng.randrange(10**6)}"
            elif kind == 1 and len(w) > 2:
                del w[at]
            else:
                w.insert(at, f"ins{rng.randrange(10**6)}")
        out.append(w)
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = []
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for size in (1, 2, 3, 5, 8, 11, 12, 20, 35, 60, 100, 180, 400):
        for _ in range(3):
            base = [rng.choice(vocabulary) for _ in range(size)]
            texts += family(rng, base, 6, max(1, size // 30))
            texts.append(passage + base[: max(1, size // 4)])
    big = [rng.choice(vocabulary) for _ in range(150)]
    texts += family(rng, big, 120, 5)  # a dense cluster, linked only in part directly
    out = [(i, rng.choice([" ", "\n", "\t "]).join(w).upper() if i % 7 == 0 else " ".join(w)) for i, w in enumerate(texts)]
    rng.shuffle(out)
    n = len(out)
    return out + [(n, None), (n + 1, ""), (n + 2, " \n\x0b"), (n + 3, "É x y z"), (n + 4, "é x y z"), (None, out[0][1]), (None, "only nulls here now"), (None, "only nulls here now"), out[1], out[1], (n + 5, "w " * 30000)]


@pytest.mark.parametrize("rule", [Rule(3, 90, 100), Rule()])
@pytest.mark.parametrize("spread", [False, True])
def test_components_equal_brute_force(spark, monkeypatch, rule, spread):
    if spread:
        monkeypatch.setattr(jaccard, "REGION", 3000)
        monkeypatch.setattr(jaccard, "PIVOTS", 2000)
        monkeypatch.setattr(jaccard, "REGION_SETS", 20)
        monkeypatch.setattr(jaccard, "FEW", 3)
        monkeypatch.setattr(jaccard, "BROADCAST_KEYS", 0)
        monkeypatch.setattr(graph, "LAST", 50)
    rows = corpus(5)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in jaccard.join_documents(df, rule).collect()), key=str)
    assert got == plain_components(rows, rule)


def test_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    rule = Rule()
    want = plain_components(rows, rule)
    assert sorted((tuple(r) for r in jaccard.join_documents(df, rule).collect()), key=str) == want
    kept = jaccard.one_of_each(df, rule)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, n, c in want if n} | {d for d, n, _ in want if not n})
    assert jaccard.join_documents(df.limit(0), rule).count() == 0


@pytest.mark.parametrize("rule", [Rule(3, 90, 100), Rule()])
def test_linked_sets_share_a_signature(rule):
    rng = np.random.default_rng(11)
    tried = 0
    for n in [*range(1, 70), 100, 127, 128, 129, 255, 256, 300, 1000, 5000]:
        for _ in range(12):
            s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(hashing.U64) * hashing.U64(2))
            changes = rule.most_changes(len(s))
            drop = rng.integers(0, changes + 1)
            add = rng.integers(0, changes - drop + 1)
            t = np.union1d(rng.permutation(s)[drop:], rng.integers(0, 1 << 63, add, dtype=np.int64).astype(hashing.U64) * hashing.U64(2))
            common = len(np.intersect1d(s, t))
            if len(t) and rule.den * common >= rule.num * (len(s) + len(t) - common) and not np.array_equal(s, t):
                tried += 1
                assert len(np.intersect1d(jaccard.signatures(s, rule), jaccard.signatures(t, rule)))
                a, b = (jaccard.sketch(x, rule) for x in (s, t))
                a, b = (np.frombuffer(x, hashing.U64) for x in (a, b))
                least = min(len(a), len(b))
                assert np.bitwise_count(jaccard.fold(a, least) ^ jaccard.fold(b, least)).sum() <= len(s) + len(t) - 2 * common
    assert tried > 200


def test_cells_find_what_a_sweep_finds():
    rng = np.random.default_rng(2)
    rule = Rule(3, 90, 100)
    sets = []
    for c in range(30):
        base = np.unique(rng.integers(c * 100, c * 100 + 140, 60)).astype(hashing.U64)
        for _ in range(12):
            keep = base[rng.random(len(base)) > 0.05]
            sets.append(np.union1d(keep, rng.integers(0, 10**6, rng.integers(0, 3)).astype(hashing.U64)))
    region = jaccard.Region(sets, rule)
    plain = jaccard.Region(sets, rule)
    plain.sweep(np.arange(len(sets)))
    assert region.labels() == [plain.root(i) for i in range(len(sets))]
    assert len(set(region.labels())) < len(sets)


@pytest.mark.parametrize("last", [graph.LAST, 30, 0])
def test_graph_components(spark, monkeypatch, last):
    monkeypatch.setattr(graph, "LAST", last)
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(40)] + [(300, x) for x in range(301, 360)] + [(5, 4), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("few", [True, False])
def test_one_of_each_keeps_columns_and_rows_of_their_own(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(jaccard, "BROADCAST_KEYS", 0)
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = a.replace("a59", "other")
    rows = [(1, a), (2, a), (3, near), (5, b), (5, c), (5, a), (6, c), (None, b), (None, "alone"), (7, None), (8, ""), (9, "one"), (9, "one"), (10, "few words"), (10, "few words")]
    names = ["doc_id", "text", "_id", "_no_id", "id", "no_id", "row", "hit", "text_hash", "first", "region", "bucket"]
    df = spark.createDataFrame([(*r, f"mongo-{k}", "x", "x", "x", "x", "x", "x", "x", "x", "x") for k, r in enumerate(rows)], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names)).repartition(3)
    out = jaccard.one_of_each(df)
    assert out.columns == names
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    # b is of 5 and of a null id, c of 5 and of 6: each goes with the smallest id; of equal rows one stays
    assert got == sorted([(1, a), (5, b), (5, c), (None, "alone"), (7, None), (8, ""), (9, "one"), (10, "few words")], key=str)
    assert all(r._id.startswith("mongo-") for r in out.collect())
    assert jaccard.one_of_each(df.limit(0)).columns == names and jaccard.one_of_each(df.limit(0)).count() == 0


def test_filter_hits_all_keys_and_few_others(spark):
    keys = spark.range(0, 30000, 3).select((F.col("id") * 7919 - 50000).alias("key"))
    rows = spark.range(30000).select((F.col("id") * 7919 - 50000).alias("k"), F.lit("x").alias("bucket")).unionByName(spark.createDataFrame([(None, "x")], "k long, bucket string"))
    out = runtime.hits(keys, rows, F.col("k")).select("row.*", "hit").collect()
    assert len(out) == 30001 and not next(r for r in out if r.k is None).hit
    known = [r.hit for r in out if r.k is not None and (r.k + 50000) // 7919 % 3 == 0]
    other = [r.hit for r in out if r.k is not None and (r.k + 50000) // 7919 % 3]
    assert len(known) == 10000 and all(known) and sum(other) < 0.15 * len(other)
    assert not any(r.hit for r in runtime.hits(keys.limit(0), rows, F.col("k")).collect())


def test_equal_groups_become_one():
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["signature", "node"])
    rows = sorted([(s, n) for s in range(20) for n in (5, 9, 11)] + [(30, 4), (31, 4), (31, 4)] + [(40, n) for n in range(200)] + [(41, 1), (41, 2)])
    for size in (1, 7, 64, 1000):
        got = [tuple(r.values()) for b in jaccard._shared(iter([batch(rows[i : i + size]) for i in range(0, len(rows), size)])) for r in b.to_pylist()]
        groups = defaultdict(set)
        for met, node in got:
            groups[met].add(node)
        assert sorted(map(sorted, groups.values())) == [list(range(200)), [1, 2], [5, 9, 11]]
        assert sum(node == 4 for met, node in got if met != 40) == 0 and sum(met == 40 for met, _ in got) == 200


def test_leaders_compare_sketches_of_all_sizes():
    rng = np.random.default_rng(5)
    rule, leaders, plain = Rule(), jaccard._Leaders(), []
    for i, n in enumerate([30, 60, 200, 900, 40, 2000, 35, 210] * 6):
        s = np.unique(rng.integers(0, 1 << 62, n)).astype(hashing.U64)
        bits = np.frombuffer(jaccard.sketch(s, rule), hashing.U64)
        found = {node: int(d) for nodes, apart in leaders.distances(bits) for node, d in zip(nodes, apart, strict=True)}
        for node, other in plain:
            least = min(len(bits), len(other))
            assert found[node] == int(np.bitwise_count(jaccard.fold(bits, least) ^ jaccard.fold(other, least)).sum())
        assert len(found) == len(plain)
        leaders.add(i, bits)
        plain.append((i, bits))
