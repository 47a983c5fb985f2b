"""Chunkers and layout against pinned facts and plain versions."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from gleanmill import shared
from gleanmill.operators import chunking as ck
from gleanmill.operators import documents as dc
from gleanmill.operators import layout

TICKET = [("1842", "sample", "Login fails", "It breaks", "Reset: done", ["a", "nan"], "high", "incident", "it", "", "open")]
COLUMNS = "ticket_id string, source_dataset string, subject string, description string, resolution string, tags array<string>, priority string, ticket_type string, queue string, business_type string, status string"


def test_ticket_documents_and_fields(spark):
    docs = dc.ticket_documents(spark.createDataFrame(TICKET, COLUMNS))
    d = docs.collect()[0]
    assert d.doc_id == "ticket_sample_1842" and d.content == "Subject: Login fails Description: It breaks Resolution: Reset: done Tags: a"
    assert "ticket subject: Login fails" in d.embedding_text and "priority: high" in d.embedding_text and "nan" not in d.embedding_text
    chunks = ck.field_chunks(docs).orderBy("chunk_index").collect()
    assert [(c.doc_id, c.content) for c in chunks][0] == ("ticket_sample_1842__chunk_00_subject", "subject: Login fails")
    assert [c.chunk_field for c in chunks] == ["subject", "description", "resolution", "tags"]
    context = ck.contextual_chunks(docs).orderBy("chunk_index").first()
    assert context.content.startswith("Ticket context: title: Login fails priority: high") and "Current field: subject. Field text: Login fails" in context.content


def test_logs_stay_one_chunk(spark):
    logs = spark.createDataFrame([("abc", "loghub", "hdfs", "error", "", "Block lost", "raw")], "log_id string, source_dataset string, system string, severity string, component string, message string, raw_log string")
    docs = dc.log_documents(logs)
    d = docs.collect()[0]
    assert d.doc_id == "log_loghub_abc" and d.title == "HDFS error log" and "log message: Block lost" in d.embedding_text
    c = ck.field_chunks(docs).collect()
    assert [(x.doc_id, x.chunk_field) for x in c] == [(d.doc_id, "message")]
    both = dc.all_documents(spark.createDataFrame(TICKET, COLUMNS), logs)
    assert both.count() == 2


def test_fixed_chunks(spark):
    text = " ".join(f"word{i}" for i in range(20))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "one")], "doc_id long, text string")
    rows = ck.fixed_chunks(df, 8, 2).orderBy("doc_id", "chunk_index").collect()
    mine = [r for r in rows if r.doc_id == 1]
    assert [(r.token_start, r.token_end) for r in mine] == [(0, 8), (6, 14), (12, 20)]
    assert "word6" in mine[0].content and "word6" in mine[1].content and mine[2].content.endswith("word19")
    assert [(r.token_start, r.token_end) for r in ck.fixed_chunks(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), 4, 1).collect()] == [(0, 4), (3, 6)]
    assert [r.doc_id for r in rows if r.doc_id != 1] == [4]


def test_units():
    assert [p[1:] for p in ck.pack_units(["a b c d e", "f g", "h"], 4, 2, 0)] == [(0, 4, 4), (4, 5, 1), (1, 2, 2), (2, 3, 1)]
    nine = " ".join(f"w{i}" for i in range(9))
    assert [p[3] for p in ck.pack_units([" ".join(f"x{i}" for i in range(14))], 5, 2)] == [5, 5, 4]
    assert [p[1:3] for p in ck.pack_units([nine, nine], 20, 10)] == [(0, 2)]


def test_sentences_and_passages(spark):
    df = spark.createDataFrame([("One. Two! Three?\nFour", "a\n\nb\n \nc", "Only. One")], "s string, p string, q string")
    r = df.select(ck.sentences(F.col("s")).alias("s"), ck.passages(F.col("p")).alias("p"), ck.passages(F.col("q")).alias("q")).collect()[0]
    assert r.s == ["One.", "Two!", "Three?", "Four"] and r.p == ["a", "b", "c"] and r.q == ["Only.", "One"]


def test_sentences_keep_their_digits(spark):
    text = "0 first. 1 second. 22 third 2. 3"
    assert spark.createDataFrame([(text,)], "s string").select(ck.sentences(F.col("s")).alias("s")).first().s == ["0 first.", "1 second.", "22 third 2.", "3"]


def test_passages_keep_their_digits(spark):
    text = "0 first\n\nsecond 1\n \n 2 third "
    assert spark.createDataFrame([(text,)], "p string").select(ck.passages(F.col("p")).alias("p")).first().p == ["0 first", "second 1", "2 third"]


def test_structure_packing(spark):
    word = lambda n: " ".join(["w"] * n)
    out = ck.pack_blocks([(1, "Head one", True), (1, word(5), False), (2, "Head two", True), (2, word(5), False)], 4, 100)
    assert len(out) == 2 and out[0][0].startswith("Head one") and out[0][1] == "Head one" and out[1][2:] == (2, 2)
    merged = ck.pack_blocks([(1, "A", True), (1, word(2), False), (3, "B", True), (3, word(2), False)], 50, 100)
    assert [(m[1], m[2], m[3]) for m in merged] == [("A > B", 1, 3)]
    blocks = spark.createDataFrame([("d", 1, 0, "Head", True), ("d", 1, 1, "text", False), ("d", 1, 2, " ", False)], "doc_id string, page_num int, reading_order int, text string, is_heading boolean")
    rows = ck.structure_chunks(blocks.withColumn("doc_id", F.lit(7).cast("long")), 1, 50).collect()
    assert [(r.doc_id, r.content) for r in rows] == [(7, "Head\n\ntext")]
    c = ck.with_context(spark.createDataFrame([("T", "law", "P", "S", "body")], "title string, document_type string, publisher string, section_path string, content string")).collect()[0].content
    assert len(c.split("\n")) == 6 and c.endswith("\n\nbody")


def test_pages_and_sections(spark):
    pages = spark.createDataFrame([(1, 1, "abcd"), (1, 2, " "), (1, 3, "efgh")], "doc_id long, page_num int, text string")
    assert [(r.page_num, r.chunk_index) for r in ck.page_chunks(pages).orderBy("page_num").collect()] == [(1, 0), (3, 2)]
    ranges = ck.page_ranges(pages)
    assert [(r.char_start, r.char_end) for r in ranges.orderBy("page_num").collect()] == [(0, 4), (6, 7), (9, 13)]
    chunks = spark.createDataFrame([(1, 0, 0, 7), (1, 1, 7, 9), (1, 2, 10, 12)], "doc_id long, chunk_index long, start long, end long")
    got = {r.chunk_index: (r.page_start, r.page_end) for r in ck.pages_of_chunks(chunks, ranges).collect()}
    assert got == {0: (1, 2), 1: (0, 0), 2: (3, 3)}
    lines = spark.createDataFrame([(1, 1, 0, "front"), (1, 1, 1, "Abstract"), (1, 1, 2, "text"), (1, 2, 3, "1. Introduction"), (1, 3, 4, "more")], "doc_id long, page_num int, line_no int, line string")
    s = ck.sections(lines).orderBy("section_index").collect()
    assert [(x.section_type, x.section_title, x.page_start, x.page_end) for x in s] == [("body", "body", 1, 1), ("abstract", "Abstract", 1, 1), ("introduction", "1. Introduction", 2, 3)]
    known = spark.createDataFrame([(1,)], "doc_id long")
    cut = ck.section_chunks(ck.sections(lines), known, 2, 0).orderBy("chunk_index").collect()
    assert [c.chunk_index for c in cut] == list(range(len(cut)))
    assert ck.section_chunks(ck.sections(lines), known.where("doc_id = 2")).count() == 0


def test_layout(spark):
    rows = []
    for page in (1, 2):
        rows += [
            ("d", page, 0, "Running head", 40.0, 40.0, 560.0, 60.0, 600.0, 800.0, 10.0),
            ("d", page, 0, "Title of it" if page == 1 else "Second", 40.0, 100.0, 560.0, 130.0, 600.0, 800.0, 18.0 if page == 1 else 10.0),
            ("d", page, 0, "left one", 40.0, 200.0, 280.0, 300.0, 600.0, 800.0, 10.0),
            ("d", page, 0, "right one", 320.0, 200.0, 560.0, 300.0, 600.0, 800.0, 10.0),
            ("d", page, 0, "left two", 40.0, 310.0, 280.0, 400.0, 600.0, 800.0, 10.0),
            ("d", page, 0, f"- {page} -", 290.0, 770.0, 310.0, 790.0, 600.0, 800.0, 10.0),
        ]
    df = spark.createDataFrame(rows, "doc_id string, page_num int, reading_order int, text string, x0 double, y0 double, x1 double, y1 double, width double, height double, font_size double")
    out = layout.clean_blocks(layout.reading_order(df)).orderBy("page_num", "reading_order").collect()
    assert [r.text for r in out if r.page_num == 1] == ["Title of it", "left one", "left two", "right one"]
    assert [r.is_heading for r in out if r.page_num == 1] == [True, False, False, False]
    assert layout.page_title(df).collect()[0].title == "Title of it"


def test_regex_tokens_match_python(spark):
    text = "Ünïcode, don't — 3.5% 가나다_x\n\ttab"
    n = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert ck.fixed_chunks(n).collect()[0].token_end == len(re.findall(r"\w+|[^\w\s]", text))


def test_rows_are_taken_and_given_in_slices():
    taken = []
    batch = pa.RecordBatch.from_pydict({"i": list(range(3000)), "t": ["x" * 20_000] * 3000})

    def longer():
        for i, t in shared.rows_of(iter([batch])):
            taken.append(i)
            yield i, t

    first = next(shared.batches_of(longer(), shared.arrow_schema("i long, t string")))
    assert len(taken) == first.num_rows == 210  # 4 MB of characters, not the 3000 rows that came
    whole = list(shared.batches_of(shared.rows_of(iter([batch, batch.slice(0, 0)])), shared.arrow_schema("i long, t string")))
    assert pa.Table.from_batches(whole).column("i").to_pylist() == list(range(3000))


def test_units_are_packed_without_pandas(spark):
    rows = spark.createDataFrame([(1, "One two. Three four."), (2, None), (3, "")], "doc_id long, text string")
    out = ck.packed_units(rows, 4)
    assert [(r.doc_id, r.content) for r in out.collect()] == [(1, c[0]) for c in ck.pack_units(["One two.", "Three four."], 4, 2)]
    assert "MapInArrow" in out._jdf.queryExecution().toString()
