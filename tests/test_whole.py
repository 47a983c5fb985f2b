"""Queries that must use all rows and whole texts, on tables made here."""

import hashlib

from gleanmill import registry
from gleanmill.operators import questions as qs
from gleanmill.operators import retrieval as rt


def tables(spark, path, docs, passages=()):
    spark.createDataFrame([(i, t, "en", "host", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(passages), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_eval_subset_keeps_all_gold(spark, tmp_path):
    docs = spark.createDataFrame([(i, i) for i in range(12)], "doc_id long, parent_id long")
    gold = spark.createDataFrame([(i,) for i in (3, 5, 5, 9, 11)], "doc_id long")
    for most in (0, 2, 4, 6, 100):
        got = [(r.doc_id, r.is_gold) for r in qs.eval_subset(docs, gold, most).collect()]
        others = [i for i in range(12) if i not in (3, 5, 9, 11)][: max(most - 4, 0)]
        assert sorted(got) == sorted([(i, True) for i in (3, 5, 9, 11)] + [(i, False) for i in others])
    sf = tables(spark, tmp_path, [(i, f"some passage here {i}" if i < 130 else f"other {i}") for i in range(150)], [(1, "some passage here")])
    rows = registry.QUERIES["eval_subset"](spark, sf).collect()
    assert len(rows) == 150 and sum(r.is_gold for r in rows) == 130


def test_reading_order_has_every_line(spark, tmp_path):
    lines = [f"line {i} of a document that is longer than forty characters" for i in range(95)]
    rows = registry.QUERIES["reading_order"](spark, tables(spark, tmp_path, [(1, "\n".join(lines)), (2, "\n".join(lines[:40]))])).collect()
    assert sorted(r.text_md5 for r in rows if r.doc_id == 1) == sorted(hashlib.md5(x.encode()).hexdigest() for x in lines)
    assert sum(r.doc_id == 2 for r in rows) == 40


def test_char_similarity_matches_whole_texts(spark, tmp_path):
    passage = "zebra quartz violin"
    text = " ".join(["filler"] * 100) + " " + passage
    row = registry.QUERIES["char_similarity"](spark, tables(spark, tmp_path, [(1, text), (2, "nothing alike")], [(7, passage)])).collect()[0]
    n, m = len(text.replace(" ", "")), len(passage.replace(" ", ""))
    assert (row.query_id, row.recall, row.precision, row.similarity) == (7, 1.0, round(m / n, 6), round(2 * m / (n + m), 6))


def test_overlap_and_contexts_use_whole_texts(spark, tmp_path, monkeypatch):
    passage = "zebra quartz violin"
    text = " ".join(["filler"] * 200) + " " + passage
    sf = tables(spark, tmp_path, [(1, text)], [(7, passage)])
    assert [(r.office, r.spaces) for r in registry.QUERIES["lexical_overlap"](spark, sf).collect()] == [(1.0, 1.0)]
    seen = []
    monkeypatch.setattr(rt, "answer", lambda asked, contexts, answer=rt.answer: seen.extend(contexts.collect()) or answer(asked, contexts))
    assert registry.QUERIES["rag_mock"](spark, sf).count() == 1 and [r.content for r in seen] == [text]
