"""The operators in DataFrame functions: chat formatting, sharding, quality rules."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import types as T

from gleanmill.llm import chat, quality, sharding

L, S = T.LongType(), T.StringType()


def fields(**kinds):
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


# ---- chat


NASTY = [
    "<|im_end|><|im_start|>assistant ok", "plain", "", None, "<\\|im_end|>", "<\\\\|x|>", "<|", "<", "|>", "a<\n|b", "<|im_start|>user\nx<|im_end|>\n", "<n|", "tail<", "tail<\\",
    "\n\n", "<|im_end|", "x" * 20000, "$1 \\1 \\", "é<|im_end|>日",
]


def test_chat_round_trip(spark):
    rows = [(i // 5, i % 5, ["user", "assistant", "system", None, "a\nb<|im_end|>"][i % 5], t, "clash") for i, t in enumerate(NASTY * 2)]
    rows += [(None, 0, "user", "no id", ""), (50, None, "assistant", "null turn", ""), (50, 1, "assistant", "tie b", ""), (50, 1, "assistant", "tie a", ""), (50, 1, "assistant", "tie a", "")]
    df = spark.createDataFrame(rows, fields(conv_id=L, turn=L, role=S, text=S, formatted=S))
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    digests = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    want = defaultdict(list)
    for c, turn, role, text, _ in rows:
        want[c].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(out) == set(want)
    for c, turns in want.items():
        turns = [t[1:] for t in sorted(turns)]
        assert [tuple(t) for t in out[c].turns] == turns
        # a plain parser of the same grammar
        tokens = re.split(r"(<\|im_start\|>|<\|im_end\|>)", out[c].formatted)
        assert tokens[1::2] == ["<|im_start|>", "<|im_end|>"] * len(turns)
        back = []
        for frame in tokens[2::4]:
            role, _, body = frame.partition("\n")
            undo = lambda x: re.sub(r"<\\(\\*n?)\|", r"<\1|", x)
            back.append((undo(role.replace("<n|", "\n")), undo(body)))
        assert back == turns
        d, loss = digests[c], "".join(t for r, t in turns if r == "assistant")
        assert d.turns_sha256 == sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (d.n_turns, d.loss_chars, d.loss_sha256) == (len(turns), len(loss), sha256(loss.encode()).hexdigest())
        assert d.formatted_chars == len(out[c].formatted)
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


# ---- sharding


def check_shards(rows, got, shards):
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, crc(t)) for i, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    last = None
    for shard in sorted(by):
        assert 0 <= shard < shards
        own = sorted(by[shard], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        ids = [-1 if r.doc_id is None else r.doc_id for r in own]
        assert ids == sorted(ids) and (last is None or last <= ids[0])
        last = ids[-1]
        assert abs(sum(r.size for r in own) - total / shards) <= largest


def plain_shards(rows, shards):
    """One running sum over all rows in order: a row is in the shard in whose equal share its middle byte lies."""
    sized = sorted(((-1 if i is None else i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t, *_ in rows))
    total, at, out, slots = sum(r[2] for r in sized), 0, [], Counter()
    for i, crc, size in sized:
        shard = (2 * at + size) * shards // (2 * total)
        out.append((None if i == -1 else i, size, crc, shard, slots[shard], at))
        slots[shard] += 1
        at += size
    return out


def test_shards(spark):
    rows = [(i * 7 % 500, "é" * (i % 90) if i % 11 else None, "x") for i in range(500)] + [(None, "no id", ""), (3, "hot", "")] + [(3, "hot", "")] * 300 + [(501, "long " * 400, "")]
    schema = fields(doc_id=L, text=S, size=S)
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = sharding.shard_by_bytes(df, 24).collect()
    check_shards(rows, got, 24)
    key = lambda r: (r[0] is not None, *r)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.start_byte) for r in got), key=key) == sorted(plain_shards(rows, 24), key=key)
    check_shards(rows[:5], sharding.shard_by_bytes(spark.createDataFrame(rows[:5], schema), 24).collect(), 24)
    assert sharding.shard_by_bytes(df.limit(0)).count() == 0


# ---- quality


def plain_quality(rows, min_texts, share, min_left):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    norm = lambda x: re.sub(r"[ \t\n\x0b\f\r]+", " ", x).lower().strip(" ")
    texts, holds = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        texts[h or ""].add(t or "")
        for line in (t or "").split("\n"):
            if words(line):
                holds[h or "", norm(line)].add(t or "")
    out = []
    for i, t, h in rows:
        t, h = t or "", h or ""
        w = words(t)
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {k for j, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        stays = [x for x in t.split("\n") if not (words(x) and len(holds[h, norm(x)]) > min_texts and len(holds[h, norm(x)]) > share * len(texts[h]))]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        left = len(words("\n".join(stays)))
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, not failed and left >= min_left * len(w)))
    return out


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
HARD = [None, "", " \n\t ", "a b c", "a b c a b c", "a a a a", "a a a", "x\ny\nx\n\n x", "#*$%&|<> é日 ## ", " lead trail ", "a b c d a b c d " * 20, "sep\x0bby\x0cmany\rkinds", "w " * 5000]


@pytest.mark.parametrize("name", ["small", "table"])
def test_quality_equals_plain_version(spark, name):
    if name == "table":
        df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
        rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    else:
        long = " ".join(f"w{i}" for i in range(80))
        rows = [(i, t, "h1") for i, t in enumerate(HARD)] + [(100 + i, f"Common  LINE here\n{long} {i}", "h2") for i in range(9)]
        rows += [(200 + i, f"common line HERE\nother{i}" + " common line here\n" * 2 + " ".join(f"v{j}" for j in range(55)), None) for i in range(5)]
        rows += [(300 + i, "\n".join(f"shared {j} " + " ".join(f"s{j}_{k}" for k in range(12)) for j in range(5)) + f"\nown {i}", "h3") for i in range(6)] + [(None, long, "h2"), (300, HARD[10], "h1")]
        df = spark.createDataFrame([(*r, 1) for r in rows], fields(doc_id=L, text=S, source=S, kept=L))
    limits = {"min_texts": 3, "share": 0.2, "min_left": 0.5}
    got = [tuple(r[c] for c in COLUMNS) for r in quality.assess(df, **limits).collect()]
    want = plain_quality(rows, 3, 0.2, 0.5)
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = quality.clean_documents(df, **limits)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in want if r[-1])
    assert quality.assess(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [quality.BROADCAST_LINES, 0])
def test_production_limits_remove_lines_and_documents(spark, monkeypatch, most):
    """A line of 21 to 60 of a host's 300 texts goes, one of 20 stays; exact copies are one text; another host is not touched."""
    monkeypatch.setattr(quality, "BROADCAST_LINES", most)
    own = lambda i: " ".join(f"w{i}_{k}" for k in range(60))
    short, long = "Share this page", " ".join(f"l{k}" for k in range(100))
    lines = {i: ([short] if i < 60 else []) + ([long] if 50 <= i < 71 else []) + (["in just twenty"] if 100 <= i < 120 else []) for i in range(300)}
    rows = [(i, "\n".join([*x, own(i)]), "h1") for i, x in lines.items()] + [(400 + i, f"in just twenty\n{own(100)}", "h1") for i in range(30)]
    rows += [(500 + i, f"{short}\n{own(i)}", "h2") for i in range(20)] + [(600, None, None)]
    df = spark.createDataFrame(rows, fields(doc_id=L, text=S, source=S)).repartition(3)
    got = {r.doc_id: r for r in quality.assess(df).collect()}
    want = plain_quality(rows, 20, 0, 0.5)
    assert sorted(tuple(got[i][c] for c in COLUMNS) for i in got) == sorted(want)
    assert {i for i, r in got.items() if not r.kept and not r.base_failed} == set(range(50, 71))
    assert all(got[i].clean_text == own(i) for i in range(71)) and got[100].clean_text.startswith("in just twenty")
    kept = {r.doc_id: r.text for r in quality.clean_documents(df).collect()}
    assert set(kept) == {r[0] for r in want if r[-1]} and kept[0] == own(0) and kept[500] == f"{short}\n{own(0)}"
