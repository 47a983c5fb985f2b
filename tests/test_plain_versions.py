"""Folds and greedy choices against plain versions that walk through everything step by step."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gleanmill.functions import lines as ln
from gleanmill.functions import noise
from gleanmill.operators import builders as bd
from gleanmill.operators import chunking as ck
from gleanmill.operators import questions as qs
from gleanmill.operators import retrieval as rt

TOKEN = re.compile(r"\w+|[^\w\s]")


def plain_packing(units, budget, least, overlap=1):
    """CHK-12 unit by unit."""
    n = lambda t: len(TOKEN.findall(t))
    out, at = [], 0
    while at < len(units):
        if n(units[at]) > budget:
            spans = [m.span() for m in TOKEN.finditer(units[at])]
            for k in range(0, len(spans), budget):
                part = spans[k : k + budget]
                out.append((units[at][part[0][0] : part[-1][1]], k, k + len(part), len(part)))
            at += 1
            continue
        taken = []
        for unit in units[at:]:
            if n("\n".join([*taken, unit])) > budget or (taken and n("\n".join(taken)) >= least):
                break
            taken.append(unit)
        out.append(("\n".join(taken), at, at + len(taken), n("\n".join(taken))))
        if at + len(taken) == len(units):
            return out
        at = max(at + 1, at + len(taken) - overlap)
    return out


def test_packing_equals_plain_version():
    rng = random.Random(7)
    for _ in range(400):
        units = [" ".join(rng.choice(["word", "x,", "end.", "- -"]) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 30]))) for _ in range(rng.randint(0, 12))]
        budget, overlap = rng.choice([4, 10, 25]), rng.choice([0, 1, 2])
        least = rng.choice([1, budget // 2, budget])
        assert ck.pack_units(units, budget, least, overlap) == plain_packing(units, budget, least, overlap)


def plain_class(line):
    """FN-25 for lines without links."""
    x = re.sub(r"[ \t]{2,}", " ", line.strip())
    low = x.lower()
    if not x:
        return "empty"
    if re.fullmatch(r"(?i)(page\s*)?\d{1,4}", x):
        return "page_number"
    if any(re.search(p.replace("(?i)", ""), x, re.I) for p in (noise.PROVIDER, noise.URL, noise.DOI)):
        return "provider_or_link"
    for kind, needles in ln.KEYWORDS:
        if any(n in low for n in needles):
            return kind
    if any(n in low for n in ln.META_HINTS):
        return "metadata_anchor"
    if len(x) <= 80 and any(n in x for n in ("*", "대학교", "저자")):
        return "author_affiliation"
    if len(x) <= 120 and re.match(r"\d+(\.\d+)*\s+", x):
        return "section_heading"
    return "body"


def plain_fold(lines):
    """FN-27: each line against all that has been joined before it."""
    out = []
    for line in lines:
        before = out[-1] if out else ""
        goes_on = (
            out
            and plain_class(before) == "body"
            and plain_class(line) == "body"
            and not before.rstrip().endswith(tuple(ln.SENTENCE_ENDINGS))
            and len(before.rstrip()) >= 12
            and len(line.lstrip()) >= 2
            and re.search("[가-힣A-Za-z0-9]$", before)
            and re.match("[가-힣a-z0-9]", line)
        )
        if goes_on:
            out[-1] = before + " " + line
        else:
            out.append(line)
    return out


def test_joined_lines_equal_plain_version(spark):
    rng = random.Random(3)
    parts = ["short", "a line of more than twelve", "this ends.", "그리고 이어지는 본문의 한 줄", "세부 내용은 다음의 표", "그림", "table of things", "12345", "123456789012345", "Upper case begins here", "x", "yes", "see www.x.org", "1.2 heading here", "저자 김", "a * in a line that is much longer than eighty characters so that it stays a body line for sure", "77", "다음 줄", "go on", "download"]
    texts = [[rng.choice(parts) for _ in range(rng.randint(0, 14))] for _ in range(1500)] + [[p, q, r] for p in parts for q in parts for r in ("go on", "다음 줄", "short")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, lines array<string>").repartition(4)
    got = {r.i: r.out for r in df.select("i", ln.pack(F.col("lines")).alias("out")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_fold(t), t


def plain_choice(rows, limit, by, goals, fill_by_kind):
    """Rows (doc_id, kind) in order: kind by kind, then the rest, each document once."""
    used, out = set(), []

    def take(pool, goal):
        for r in pool:
            if len(out) < limit and goal > 0 and r[0] not in used:
                used.add(r[0])
                out.append(r)
                goal -= 1

    for kind, goal in goals.items():
        take([r for r in rows if r[1] == kind], goal)
    pools = [[r for r in rows if r[1] == k] for k in [*goals, *sorted({r[1] for r in rows} - set(goals))]] if fill_by_kind else [rows]
    for pool in pools:
        take(pool, limit)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_choices_equal_plain_version(spark, seed):
    rng = random.Random(seed)
    kinds = list(qs.QUOTAS)
    rows = [(rng.randrange(40), rng.choice(kinds[: rng.randint(2, 6)] if rng.random() < 0.8 else kinds), pos) for pos in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, question_type string, pos long").repartition(3)
    got = [(r.doc_id, r.question_type, r.pos) for r in qs.select_balanced(df, 30, "question_type", kinds).collect()]
    assert got == plain_choice(rows, 30, 1, dict.fromkeys(kinds, 5), False)
    ranked = df.select("doc_id", "question_type", F.col("pos").alias("section_priority"))
    order = ranked.orderBy(qs.hash_order("doc_id"), "section_priority", "doc_id").collect()
    got = [(r.doc_id, r.question_type, r.section_priority) for r in qs.select_quota(ranked, 24).collect()]
    assert got == plain_choice([tuple(r) for r in order], 24, 1, qs.targets(24), True)


def test_balanced_takes_kinds_in_their_order(spark):
    """A document that is a candidate of two kinds goes to the kind that comes first, not to the candidate that comes first."""
    rows = [(1, "result", 1), (1, "summary", 2), (2, "result", 3), (3, "other", 4)]
    got = qs.select_balanced(spark.createDataFrame(rows, "doc_id long, question_type string, pos long"), 6, "question_type", list(qs.QUOTAS)).collect()
    assert [(r.doc_id, r.question_type) for r in got] == [(1, "summary"), (2, "result"), (3, "other")]


def test_shortened_windows():
    """Decoding and encoding again that takes two ids a word where the id was one: the longest beginning that fits."""
    decode = lambda ids: " ".join(f"w{i}" for i in ids)
    for budget in (1, 2, 5, 10, 11):
        for n in range(1, 14):
            for each in (1, 2, 3):
                count = lambda t, each=each: each * len(t.split())
                want = max((k for k in range(n + 1) if each * k <= budget), default=0)
                assert bd._fitting(decode, count, list(range(n)), budget) == decode(list(range(want)))


def test_containing_equals_plain_version(spark, monkeypatch):
    docs = [(1, "alpha betaextraordinarily gamma"), (2, "the inner word stands here. And more"), (3, "!!! ???"), (4, None), (5, "ΑΒ ΟΔΟΣ' x"), (6, "İstanbul ve inner word"), (7, "")]
    passages = [(1, "extraordinarily gam"), (2, "nner word stan"), (3, "! ?"), (4, "here. And"), (5, ""), (6, None), (7, "ΟΔΟΣ'"), (8, "x"), (9, "no such thing here"), (10, "inner word"), (10, "gamma")]
    want = sorted({(q, d) for q, p in passages for d, t in docs if p is not None and t is not None and p in t})
    p = spark.createDataFrame(passages, "query_id long, passage string")
    d = spark.createDataFrame(docs, "parent_id long, body string").repartition(3)
    for keys, block in ((5000, 500), (0, 2), (2, 1)):
        monkeypatch.setattr(rt, "FEW_KEYS", keys)
        monkeypatch.setattr(rt, "FEW_PASSAGES", block)
        assert sorted((r.query_id, r.parent_id) for r in rt.containing(p, d).collect()) == want
    assert rt.containing(p.limit(0), d).count() == 0 and rt.containing(p, d.limit(0)).count() == 0
