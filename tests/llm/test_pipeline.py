"""The pipeline's stages one by one against plain versions, and the whole run."""

import math
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from gleanmill.llm import jaccard, resample, runtime  # noqa: E402

from .test_jaccard import plain_components  # noqa: E402
from .test_native import plain_quality  # noqa: E402
from .test_tokens import check_packing  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    (_, rules), (_, classifier), (_, duplicates), (_, packing) = corpus_pipeline.STAGES

    left = runtime.cut(rules(spark, docs, SF), "rules")
    want = {r[0] for r in plain_quality([(r.doc_id, r.text, r.source) for r in docs.collect()], 20, 0, 0.5) if r[-1]}
    assert left.columns == columns and {r.doc_id for r in left.collect()} == want
    assert all(r.n_chars == len(r.text) for r in left.collect())

    chosen = runtime.cut(classifier(spark, left, SF), "classifier")
    weighed = resample.weigh(left, resample.fit(left, labels)).collect()
    k = math.ceil(resample.good_share(left, labels)[1] * len(weighed))
    keep = sorted(weighed, key=lambda r: -r.key)[:k]
    assert chosen.columns == columns and sorted(r.doc_id for r in chosen.collect()) == sorted(r.doc_id for r in keep)

    single = runtime.cut(duplicates(spark, chosen, SF), "duplicates")
    rows = [(r.doc_id, r.text) for r in chosen.collect()]
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in plain_components(rows, jaccard.Rule())})

    check_packing(single, 2048)
    assert packing(spark, single, SF).columns[0] == "doc_id"


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SF).collect()
    windows, tokens = defaultdict(int), Counter()
    for r in pieces:
        windows[r.sequence_id] += r.length
        tokens[r.doc_id] += r.length
    assert max(windows.values()) <= 2048
    assert all(tokens[r.doc_id] == r.doc_tokens for r in pieces)


LONG = " ".join(f"w{i}" for i in range(90))
EDGES = [(1, LONG), (1, LONG), (2, LONG), (None, LONG + " more"), (None, None), (3, None), (4, ""), (5, " \n\t"), (6, "short"), (7, "very long " + " ".join(f"x{i}" for i in range(60_000))), (8, "é " * 40 + LONG), (8, LONG.upper() + " end")]
CLASHES = ["row", "noise", "key", "_noise", "_id", "_no_id", "host", "hashes", "clean_text", "kept", "n", "id", "region", "hit", "good"]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_edge_rows(spark, name):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names, an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "host", None if t is None else len(t), *["clash"] * len(CLASHES)) for k, (i, t) in enumerate(EDGES)]
    docs = spark.createDataFrame(rows, schema).repartition(2)
    out = stage(spark, docs, SF)
    got = out.collect()
    if name == "packing":
        assert sum(r.length for r in got if r.start == 0 and r.doc_id == 3) == 1 and sum(r.start == 0 for r in got) == len(EDGES)
    else:
        assert out.columns == docs.columns and all(r[c] == "clash" for r in got for c in CLASHES)
        texts = sorted(((r.doc_id, r.text) for r in got), key=str)
        if name == "quality_rules":
            assert texts == sorted([e for e in EDGES if len((e[1] or "").split()) >= 50], key=str)
        elif name == "quality_classifier":
            assert set(texts) <= set(EDGES) and texts.count((1, LONG)) in (0, 2)
        else:
            # both texts of id 8 have over 0.8 of their five-word shingles in common with those of id 1
            assert texts == sorted([EDGES[0], *EDGES[4:10]], key=str)
    assert stage(spark, docs.limit(0), SF).count() == 0
