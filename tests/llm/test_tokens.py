"""Token counting, piece coding and packing against the libraries and simple versions of the search."""

import zlib
from collections import defaultdict
from itertools import pairwise
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from gleanmill.llm import packing, pieces, tokencount

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", None, " ", "   ", "a", "Hello world", " leading", "trailing ", "two  spaces   three", "tab\tand\nlines\r\n\x0b\x0c", "<s></s><unk><0x41> x",
    "▁mark ▁▁ in", "日本語テキスト 𐍈𐍈", "don't can't 'tis we'll 's'", "ABC abc É É", "a" * 5000, "%%%*** ,,, ... !!!", "<|endoftext|> x<|startoftext|>y", "0123456789 12 3",
    "​ nbsp em", "word " * 3000, "mixed,punct.here;and-there", "İstanbul ǅ ß", "é" * 70,
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType()), T.StructField("length", T.StringType())])


def rows(texts=TEXTS):
    return [(i if i != 3 else None, t, "clash", None) for i, t in enumerate(texts)] + [(5, texts[5], "repeated", None)] * 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_counts_equal_the_library(spark, docs, documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for df in (docs, documents):
        want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in df.collect())
        got = tokencount.count_tokens(df, MODEL, limit=40).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 40) for r in got)
    assert tokencount.count_tokens(docs.limit(0), MODEL).count() == 0


def plain_viterbi(text, table):
    found, unknown = table["pieces"], min(s for _, s in table["pieces"].values()) - 10
    best, back, longest = [0.0], [(0, -1)], max(map(len, found))
    for end in range(1, len(text) + 1):
        options = [(best[end - n] + found[p][1], n, found[p][0]) for n in range(1, min(longest, end) + 1) if (p := text[end - n : end]) in found]
        total, n, i = max(options, default=(best[end - 1] + unknown, 1, -1))
        best.append(total)
        back.append((n, i))
    ids, end = [], len(text)
    while end:
        n, i = back[end]
        ids = ([table["bytes"][b] for b in text[end - 1].encode()] if i < 0 else [i]) + ids
        end -= n
    return ids


def test_pieces_equal_plain_search_and_decode(docs, documents):
    table = pieces.piece_table(MODEL)
    for df in (docs, documents.limit(40)):
        source = {(r.doc_id, r.text or "") for r in df.collect()}
        want = defaultdict(set)
        for doc_id, text in source:
            ids = plain_viterbi("▁" + text.replace(" ", "▁"), table) if text else []
            want[doc_id].add((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        got = pieces.encode_decode(df, MODEL).collect()
        assert len(got) == df.count()
        for r in got:
            assert (r.n_pieces, r.ids_crc32) in want[r.doc_id]
            assert r.round_trip
    assert pieces.encode_decode(docs.limit(0), MODEL).count() == 0


def check_packing(df, width, end_id=1):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(WORDS)
    want = defaultdict(list)
    for r in df.collect():
        want[r.doc_id].append(np.array([*tk.encode(r.text or "", add_special_tokens=False).ids, end_id], "<u4"))
    got = packing.pack_documents(df, WORDS, width, end_id).collect()
    windows, covered = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length > 0
        windows[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= width
    assert set(covered) == set(want)
    for doc_id, parts in covered.items():
        texts = {(len(x), x.tobytes()) for x in want[doc_id]}
        assert sum(p[1] for p in parts) == sum(map(len, want[doc_id]))
        for start, length, crc, total in parts:
            assert any(n == total and zlib.crc32(ids[4 * start : 4 * (start + length)]) == crc for n, ids in texts)
    return windows


def test_packing_covers_every_id_once(spark, docs, documents):
    for width in (64, 2048):
        check_packing(docs, width)
    windows = check_packing(documents, 2048)
    full = sum(sum(n for _, n in w) == 2048 for w in windows.values())
    assert len(windows) - full <= documents.rdd.getNumPartitions()
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


ODD = [
    "<|ENDOFTEXT|> <|endoftext|>x word<|endoftext|>, <|EndOfText|>.", "J\u030c j\u030c \u01f0 \u212b K\u0301 A\u030a, \u1e9e\u0331", "ΣΑΣ Σίσυφος. İ, I\u0307 İİ ıI ŉ",
    "it's IT'S x,'s 's, don't. a.'", "one\r\ntwo\u2028three\u00a0four \x1c five\x0b", " \n \n", "\n", "end\n", "", None, "No5 5no a1, 1,a (x) x( -- --x x--y", "x\u0338= =\u0338 a=\u0338 \u0958, \ufb2a. aİ, İ.",
    "日本語、テキスト。 각각 \u1100\u1161\u11a8 ﬁ ﬀ, ª º", "Word WORD, word. wORD!? word; {word} word|word", "é É, É É. ÉÉ\n", "z" * 3000 + ", " + "Z" * 3000,
]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("most", [3, 1000])
def test_pieces_have_the_library_ids(monkeypatch, most, kind):
    from tokenizers import Tokenizer

    with open(WORDS, encoding="utf-8") as f:
        content = f.read()
    plain, encoder, texts = Tokenizer.from_str(content), packing.WordIds(content, most), [*ODD, *TEXTS, *ODD]
    for size in (1, 60, 1 << 20):
        monkeypatch.setattr(packing, "BYTES", size)
        for column in (texts, texts[5:9], [None, ""], ["", "a"], []):
            got = []
            for part in packing._parts(pa.array(["cut off", *column, "cut off"], kind).slice(1, len(column))):
                ids, bounds = encoder.texts(part)
                got += [ids[a:b].tolist() for a, b in pairwise(bounds)]
            assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in column]


def test_a_word_is_encoded_once_for_all_its_spellings(monkeypatch):
    """The cost of packing is that of words not met before: case and signs after a word must not make new ones."""
    given = []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def __getattr__(self, name):
            return getattr(self.tokenizer, name)

        def encode_batch_fast(self, texts, **more):
            given.extend(w for t in texts for w in t.split())
            return self.tokenizer.encode_batch_fast(texts, **more)

    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    with open(WORDS, encoding="utf-8") as f:
        encoder = packing.WordIds(f.read())
    encoder.tokenizer = Counted(encoder.tokenizer)
    monkeypatch.setattr(packing, "_encoders", {-1: encoder})
    spelled = [w + sign for w in ("Storm", "storm", "STORM", "Über", "ber") for sign in ("", ",", ".", "!", "...")]
    batch = pa.record_batch([pa.array([1, 2], pa.int64()), pa.array([" ".join(spelled), "\n".join(spelled)])], names=["doc_id", "text"])
    shared = SimpleNamespace(value={"id": -1, "json": "", "memo": 1000})
    assert sum(b.num_rows for b in packing._pack_batches(shared, 2048, 1, iter([batch, batch]))) == 4
    assert sorted(w for w in given if w.isalpha()) == ["ber", "storm", "Über"]


def test_level_choice_minimises_the_sum_of_squares():
    rng = np.random.default_rng(7)
    width, levels, counts = 20, packing.Levels(20), [0] * 20
    for size in rng.integers(1, 20, 500).tolist():
        def cost(h):
            after = counts.copy()
            if h:
                after[h] -= 1
            if h + size < width:
                after[h + size] += 1
            return sum(c * c for c in after)

        choices = [h for h in range(width - size + 1) if h == 0 or counts[h]]
        want = min(choices, key=lambda h: (cost(h), -h))
        assert levels.best(size) == want
        levels.take(want)
        if want:
            counts[want] -= 1
        if want + size < width:
            levels.put(want + size, [])
            counts[want + size] += 1


def test_many_open_windows_are_joined(monkeypatch):
    monkeypatch.setattr(packing, "OPEN", 6)
    out = []
    packer = packing.Packer(100, out.append)
    sizes = [int(x) for x in np.random.default_rng(3).integers(1, 260, 400)]
    for i, n in enumerate(sizes):
        packer.add(i, np.full(n, i, "<u4").tobytes())
    packer.join()
    fills = [sum(len(ids) // 4 for _, _, ids, _ in w) for w in out]
    assert sum(fills) == sum(sizes) and sum(f != 100 for f in fills) <= 1
    back = defaultdict(list)
    for w in out:
        for i, start, ids, total in w:
            assert total == sizes[i] and set(np.frombuffer(ids, "<u4").tolist()) == {i}
            back[i].append((start, len(ids) // 4))
    for i, n in enumerate(sizes):
        at = 0
        for start, length in sorted(back[i]):
            assert start == at
            at += length
        assert at == n
