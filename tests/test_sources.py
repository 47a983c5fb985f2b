"""Sources, sinks, marts, plans, catalog and streams."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from gleanmill import shared
from gleanmill.operators import layout
from gleanmill.operators import marts as mr
from gleanmill.plans import cases, catalog
from gleanmill.sources import archives, readers, schemas, sinks
from gleanmill.streaming import events


def test_tickets(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write('id,subject,body,answer,priority,tag_1,tag_2\n1,"Login, please",It <b>breaks</b>,Reset,High,a,\n,Second,x,,odd,,\n')
    out = readers.tickets(spark, path, "multilingual_customer_support").orderBy("subject").collect()
    assert (out[0].ticket_id, out[0].subject, out[0].priority, out[0].tags, out[0].description) == ("1", "Login, please", "high", ["a"], "It breaks")
    assert out[1].ticket_id.startswith("multilingual_customer_support_") and out[1].priority == "unknown" and out[1].created_at is None
    assert readers.tickets(spark, path, "multilingual_customer_support", limit=1).count() == 1


def test_logs(spark, tmp_path):
    path = str(tmp_path / "x.log")
    with open(path, "w") as f:
        f.write("1 ALERT disk\n\nINFO fine\nwarn low\n")
    out = {r.raw_log: r for r in readers.logs(spark, path, "d", "hdfs").collect()}
    assert out["1 ALERT disk"].is_anomaly and out["1 ALERT disk"].severity == "alert" and out["INFO fine"].is_anomaly is None and out["warn low"].severity == "warning"
    assert readers.logs(spark, path, "d", limit=2).count() == 1 and readers.logs(spark, path, "d", limit=0).count() == 3


def test_archives(spark, tmp_path):
    for kind in ("type0", "type1"):
        folder = tmp_path / "Training" / "src"
        os.makedirs(folder, exist_ok=True)
        with zipfile.ZipFile(folder / f"TS_01.{kind}_02.zip", "w") as z:
            for i in range(3):
                z.writestr(f"OC2_1_{kind.upper()}_000{i}.pdf", b"%PDF")
            z.writestr("note.txt", b"x")
    rows = readers.office_inventory(spark, str(tmp_path), stratified=True, limit=4).collect()
    assert [r.document_type for r in rows] == ["type0", "type1", "type0", "type1"] and rows[0].doc_id == "OC2_1_TYPE0_0000" and rows[0].split == "training"
    assert readers.office_inventory(spark, str(tmp_path)).count() == 6


def test_papers(spark, tmp_path):
    os.makedirs(tmp_path / "field")
    (tmp_path / "field" / "paper_2024.pdf").write_bytes(b"page one\x0cpage two")
    (tmp_path / "field" / "slides_2023.pptx").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ST_0001_2025.pdf", b"inside")
    m = readers.papers(spark, str(tmp_path))
    got = {r.file_name: r for r in m.collect()}
    assert (got["paper_2024.pdf"].research_field, got["paper_2024.pdf"].publication_year) == ("field", "2024")
    assert got["slides_2023.pptx"].parse_status == "unsupported_pptx" and got["ST_0001_2025.pdf"].research_field == "science_technology" and got["ST_0001_2025.pdf"].zip_entry

    def extract(content):
        if content.startswith(b"inside"):
            raise ValueError("broken")
        return content.decode().split("\x0c")

    pages = readers.paper_pages(spark, m.where("file_type = 'pdf'"), extract)
    rows = {(r.raw_text, r.parse_status) for r in pages.collect()}
    assert rows == {("page one", "parsed"), ("page two", "parsed"), ("", "failed")}
    report = {r.parse_status: (r.documents, r.pages) for r in readers.parse_report(pages).collect()}
    assert report == {"parsed": (1, 2), "failed": (1, 0)}


def test_oracle_pages(spark):
    rows = [("d", 1, "T", 5.0, "plain", "", ""), ("d", 1, "D01", 9.0, "no", "seen", "described"), ("d", 1, "D01", 1.0, "", "", "")]
    rows += [("e", 1, "D01", 1.0, "", "", " [&]a.json [&]b.json"), ("e", 1, "T", 3.0, "second", "", ""), ("e", 1, "T", 2.0, "first", "", "")]
    rows += [("f", 1, "T", 1.0, "", "a view", ""), ("f", 2, "T", None, None, None, None)]
    df = spark.createDataFrame([(*r[:3], 0.0, *r[3:]) for r in rows], "doc_id string, page_num int, class_name string, x double, y double, plain_text string, visual_description string, document_description string")
    out = {(r.doc_id, r.page_num): (r.content, r.parsing_reference_text, r.oracle_text_type) for r in readers.oracle_pages(df).collect()}
    assert out["d", 1] == ("described", "described", "document_description") and out["e", 1] == ("first\nsecond", "first\nsecond", "plain_text")
    assert out["f", 1] == ("a view", "", "visual_description") and out["f", 2] == ("", "", "empty")
    assert readers.oracle_pages(df, df.where("doc_id = 'e'")).count() == 1 and readers.oracle_pages(df, limit=1).count() == 1


def test_label_archives(spark, tmp_path):
    os.makedirs(tmp_path / "Validation")

    def record(doc, page, kind, text, box=(0, 0, 1, 1), title=""):
        return json.dumps({"raw_data_info": {"doc_name": title, "publisher": "P"}, "source_data_info": {"source_data_name_pdf": doc + ".pdf"}, "learning_data_info": {"page_num": page, "class_name": kind, "bounding_box": box, "plain_text": text}})

    with zipfile.ZipFile(tmp_path / "Validation" / "VL_01.report_json.zip", "w") as z:
        z.writestr("1.json", "\ufeff" + record("OC2_1_A_1", 1, "T", "below", [0, 9, 1, 1], "A title"))
        z.writestr("2.json", record("OC2_1_A_1", 1, "T", "above", [0, 1, 1, 1], "A title"))
        z.writestr("3.json", record("OC2_1_A_1", 2, "T", "next page", None, "A title"))
        z.writestr("4.json", record("OC2_1_B_2", 1, "T", "other"))
        z.writestr("note.txt", "x")
    e = readers.labelled_elements(spark, str(tmp_path))
    docs = {r.doc_id: r for r in readers.oracle_documents(e, readers.oracle_pages(e)).collect()}
    assert docs["OC2_1_A_1"].content == "above\nbelow\n\nnext page" and docs["OC2_1_A_1"].title == "A title" and docs["OC2_1_A_1"].page_count == 2
    assert (docs["OC2_1_B_2"].title, docs["OC2_1_B_2"].split, docs["OC2_1_B_2"].document_type) == ("OC2_1_B_2", "validation", "report")
    assert readers.labelled_elements(spark, str(tmp_path), limit=1).select("doc_id").distinct().count() == 1
    assert readers.labelled_elements(spark, str(tmp_path), spark.createDataFrame([("OC2_1_B_2",)], "doc_id string")).count() == 1


def test_blocks(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"ok")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def layouts(content):
        if content == b"bad":
            raise ValueError("no pdf")
        spans = lambda *x: [{"spans": [{"text": t, "size": s} for t, s in x]}]
        yield 600, 800, {"blocks": [{"type": 1, "bbox": (0, 0, 1, 1)}, {"type": 0, "bbox": (0, 0, 9, 9), "lines": spans(("A ", 9), ("title", 20)) + spans((" ", 99))}, {"type": 0, "bbox": (0, 20, 9, 29), "lines": spans((" ", 5))}]}
        yield 600, 800, {"blocks": [{"type": 0, "bbox": (0, 0, 9, 9), "lines": spans(("Second", 20))}]}

    m = spark.createDataFrame([("a", str(tmp_path / "a.pdf"), None), ("b", f"file:{tmp_path}/b.pdf", None), ("c", str(tmp_path / "none.pdf"), None)], "doc_id string, source_path string, zip_entry string")
    rows = readers.pdf_blocks(m, layouts)
    got = sorted((r.doc_id, r.page_num, r.text, r.font_size, r.parse_status) for r in rows.where("parse_status = 'parsed'").collect())
    assert got == [("a", 1, "A title", 20.0, "parsed"), ("a", 2, "Second", 20.0, "parsed")]
    assert {r.doc_id: r.error.split(":")[0] for r in rows.where("parse_status = 'failed'").collect()} == {"b": "ValueError", "c": "FileNotFoundError"}
    assert layout.page_title(rows).collect()[0].title == "A title"


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    for name, lines in (("b", 5000), ("a", 3), ("c", 0), ("d", 700)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(lines)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "4096"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = readers.numbered(spark.read.text(str(tmp_path))).orderBy("_n").collect()
            assert [r._n for r in rows] == list(range(5703)) and [r.value for r in rows] == [f"{n}{i}" for n, k in (("a", 3), ("b", 5000), ("d", 700)) for i in range(k)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write("id,subject\n" + "".join(f'{i if i % 2 else ""},"s {i}\nmore"\n' for i in range(9)))
    out = readers.tickets(spark, path, "x", {"ticket_id": "id", "subject": "subject"}, limit=5)
    assert sorted((r.ticket_id, r.subject) for r in out.collect()) == sorted((str(i) if i % 2 else f"x_{i}", f"s {i} more") for i in range(5))


def test_settings(tmp_path):
    path = str(tmp_path / "c.yaml")
    with open(path, "w") as f:
        f.write("embedding:\n  model_name: m\n  batch_size: 8\nretrieval:\n  top_k: 3\nother: 1\n")
    s = readers.load_settings(path, {"DATA_ROOT": "/d", "EMBEDDING_MODEL": "n", "LLM_PROVIDER": "p"})
    assert (s.data_root, s.model_name, s.batch_size, s.top_k, s.provider, s.extra) == ("/d", "n", 8, 3, "p", {"other": 1})
    assert readers.load_settings(str(tmp_path / "none.yaml"), {}).top_k == 10


def test_report_tables(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    df = spark.createDataFrame([("a", ["x", "y"], None)], "n string, xs array<string>, v double")
    assert sinks.write_table(df, path) == 1 and sinks.write_table(df, path, append=True) == 1
    with open(path, "rb") as f:
        assert f.read() == b"\xef\xbb\xbfn,xs,v\r\na,x;y,\r\na,x;y,\r\n"
    with pytest.raises(ValueError):
        sinks.write_table(df.unionByName(df), path, most=1)


def test_json_lines_and_lake(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    with open(path, "w") as f:
        f.write('{"doc_id": "1", "content": "x"}\n\n{"doc_id": "2", "content": "é"}\n')
    assert readers.jsonl(spark, path, schemas.fields(doc_id=schemas.S, content=schemas.S)).count() == 2
    counts = sinks.to_lake(spark, {"sample": path, "absent": str(tmp_path / "no.jsonl")}, str(tmp_path / "lake"))
    assert counts == {"sample": 2, "absent": -1} and spark.read.parquet(str(tmp_path / "lake" / "sample")).count() == 2
    assert sinks.write_jsonl(spark.read.parquet(str(tmp_path / "lake" / "sample")), str(tmp_path / "out")) == 2
    assert readers.sample(readers.jsonl(spark, path))["row_count"] == 2
    with pytest.raises(Exception, match="doc_id is missing"):
        readers.validated_jsonl(spark, path, schemas.fields(doc_id=schemas.S), ()).select(F.lit(1)).count()
        with open(path, "a") as f:
            f.write('{"content": "y"}\n')
        readers.validated_jsonl(spark, path, schemas.fields(doc_id=schemas.S), ("doc_id",)).collect()
    sinks.write_csv(spark.createDataFrame([(1, ["a", "b"])], "i int, xs array<string>"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()[0].xs == "a;b"
    assert readers.manifest_slice(spark.range(10), "id", 3, 2).collect()[0].id == 3
    assert readers.lake_sources("/d", ["pages=/x"])["pages"] == "/x" and len(readers.lake_sources("/d")) == 7
    assert readers.load_settings({"data_root": "a", "top_k": 3}, {"DATA_ROOT": "b"}).data_root == "a" and readers.load_settings({}, {"DATA_ROOT": "b"}).data_root == "b"


def test_indexes(spark, tmp_path):
    df = spark.createDataFrame([("a", "page", [1.0], 2), ("a", "page", [2.0], 1), ("b", "fixed", [3.0], 1)], "doc_id string, chunking_strategy string, embedding array<float>, at int")
    sinks.write_vectors(df, str(tmp_path / "v"), order="at")
    assert {r.doc_id: r.embedding for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {"a": [1.0], "b": [3.0]} and os.path.isdir(tmp_path / "v" / "chunking_strategy=page")
    sinks.write_vectors(df.coalesce(1), str(tmp_path / "w"))  # without an order the one that arrives last
    assert {r.doc_id: r.embedding for r in spark.read.parquet(str(tmp_path / "w")).collect()} == {"a": [2.0], "b": [3.0]}


def test_run_records(tmp_path):
    with sinks.RunRecorder("parse", str(tmp_path), run_id="r1") as r:
        r.event("custom_event", n=1)
        r.records = 5
    m = json.load(open(r.manifest_path))
    assert m["status"] == "succeeded" and m["record_count"] == 5
    assert [json.loads(x)["event"] for x in open(r.events_path)] == ["stage_started", "custom_event", "stage_finished"]
    with pytest.raises(ValueError), sinks.RunRecorder("parse", str(tmp_path), run_id="r2") as r:
        raise ValueError("no")
    assert json.load(open(r.manifest_path))["status"] == "failed"
    source = str(tmp_path / "in")
    open(source, "w").write("x")
    sinks.checkpoint(str(tmp_path / "cp"), "c", "conf", source, 7)
    assert sinks.resume(str(tmp_path / "cp"), "c", "conf", source) == 7 and sinks.resume(str(tmp_path / "none"), "c", "conf", source) == 0
    with pytest.raises(ValueError):
        sinks.resume(str(tmp_path / "cp"), "other", "conf", source)


def test_marts_and_checks(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", " ")], "doc_id string, content string")
    chunks = spark.createDataFrame([("c1", "a", 1, 2), ("c1", "missing", 3, 1)], "chunk_id string, doc_id string, page_start int, page_end int")
    got = {}
    for c in (mr.same_count("n", docs, docs), mr.empty_content("e", docs), mr.duplicates("d", chunks, ["chunk_id"]), mr.orphans("o", chunks, docs, "doc_id"), mr.inverted_pages("p", chunks)):
        r = c.collect()[0]
        got[r.name] = (r.status, r.observed)
    assert got == {"n": ("PASS", "2"), "e": ("WARN", "1"), "d": ("FAIL", "1"), "o": ("FAIL", "1"), "p": ("FAIL", "1")}
    assert mr.exit_code(mr.orphans("o", chunks, docs, "doc_id")) == 1 and "| e | WARN | 1 | 0 |" in mr.markdown(mr.empty_content("e", docs))
    assert mr.duplicates("d", chunks.limit(0), ["chunk_id"]).collect()[0].status == "PASS"
    facts = mr.fact_eval(spark.createDataFrame([("m", "0.5")], "method string, mrr string"), ["mrr"])
    assert facts.dtypes == [("method", "string"), ("mrr", "double")] and mr.fact_indexing_result(spark, [("p", "i", 2)]).count() == 1


def test_cases(spark):
    found = cases.validate(cases.default_cases())
    assert (len(found), sum(c.enabled for c in found), len({c.group for c in found})) == (23, 20, 13)
    assert {k: len(v) for k, v in cases.PROFILES.items()} == {"chunking": 13, "retriever": 16, "reranker": 8, "evaluation": 11}
    steps = {s.step_id: s.status for s in cases.plan(found[0])}
    assert list(steps) == ["01_chunking", "02_indexing", "03_retrieval", "04_reranking", "05_evaluation"] and steps["04_reranking"] == "skipped"
    with pytest.raises(ValueError, match="duplicate"):
        cases.validate([found[0], found[0]])
    bad = {"group": "no", "namespace": "x", "enabled": False, "chunking": "no"}
    for k, v in bad.items():
        with pytest.raises(ValueError):
            cases.validate([cases.Case(**(found[0].__dict__ | {k: v}))])
    assert cases.plans(spark).count() == 115 and len(cases.registry_hash(found)) == 12
    s = spark.createDataFrame([("c", "x", 1, 0.1), ("c", "overall", 2, 0.2)], "case_id string, grp string, pos int, mrr double")
    assert cases.summarize(spark.createDataFrame([("c",), ("d",)], "case_id string"), s).orderBy("case_id").collect()[0].mrr == 0.2


def test_catalog(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"x": 1}\n')
    values = [{"project_id": "p", "version": "1", "label": "P", "data_root": str(tmp_path), "datasets": [{"name": "d", "path": "d.jsonl"}, {"name": "e", "path": "e.jsonl"}]}]
    projects = catalog.load(values)
    rows = catalog.catalog(spark, projects)
    assert [(r.entries, r.missing) for r in catalog.counters(rows).collect()] == [(2, 1)]
    assert catalog.register(spark, projects) == ["p_d"] and spark.table("p_d").count() == 1
    found = catalog.model(spark, projects, {"p": [{"question": "q</script>"}]})
    assert [(a["exists"], a["records"], a["fields"], a["samples"]) for a in found["datasets"]] == [(True, 1, ["x"], [{"x": 1}]), (False, 0, [], [])]
    assert found["summary"]["artifacts_by_scope"] == {"datasets": 2}
    page = catalog.dashboard(found, "A <b>")
    assert "d.jsonl" in page and "A &lt;b&gt;" in page and "q</script>" not in page
    with pytest.raises(ValueError):
        catalog.load(values * 2)


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(f"2024-01-01 0{h}:10:00", "ERROR x" if h % 2 else "INFO y", float(h), h) for h in range(6)]
    df = spark.createDataFrame(rows, "t string, raw string, value double, user_id int").select(F.to_timestamp("t").alias("ts"), "raw", "value", "user_id")
    df.write.parquet(src)
    stream = events.severity_windows(events.read_events(spark, src, df.schema), late="0 seconds")
    events.run(stream, out, str(tmp_path / "cp")).awaitTermination()
    first = spark.read.parquet(out).count()
    assert first > 0
    events.run(stream, out, str(tmp_path / "cp")).awaitTermination()  # nothing new: goes on from the checkpoint
    assert spark.read.parquet(out).count() == first
    seen = []
    q = spark.createDataFrame([("2024-01-01", "Why ?"), ("2024-01-01", "why ?"), ("2024-01-01", " ")], "t string, question string").select(F.to_timestamp("t").alias("ts"), "question")
    q.write.parquet(str(tmp_path / "q"))
    events.upsert_batches(events.first_questions(events.read_events(spark, str(tmp_path / "q"), q.schema)), lambda b, i: seen.append(b.count()), str(tmp_path / "cq")).awaitTermination()
    assert sum(seen) == 1


def test_directories_as_zipfile_has_them(tmp_path):
    path = tmp_path / "a.zip"
    with open(path, "wb") as out:
        out.write(b"something before the archive")
        with zipfile.ZipFile(out, "w") as z:
            z.comment = b"a comment"
            z.mkdir("folder")
            for i, (name, how) in enumerate([("a.txt", zipfile.ZIP_STORED), ("folder/한글.txt", zipfile.ZIP_DEFLATED), ("b.txt", zipfile.ZIP_BZIP2), ("empty", zipfile.ZIP_DEFLATED)]):
                z.writestr(name, "x" * 1000 * (3 - i), how)
    with zipfile.ZipFile(path) as z, open(path, "rb") as f:
        listed = [(i.filename, i.file_size, i.compress_size, i.CRC) for i in z.infolist() if not i.is_dir()]
        found = list(archives.directory(f))
        assert [(n, size, packed, crc) for n, size, packed, _, crc in found] == listed
        assert all(archives.member(f, n, at, packed, crc) == z.read(n) for n, _, packed, at, crc in found)
        n, _, packed, at, crc = found[0]
        with pytest.raises(zipfile.BadZipFile):
            archives.member(f, n, at, packed, crc + 1)


def test_written_archives_are_whole(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 2).cast("string").alias("folder"), F.lit("a.zip").alias("archive"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("member"), F.repeat(F.lit("가"), (F.col("id") % 7).cast("int")).alias("content"))
    archives.write(rows.repartition(4), str(tmp_path))
    for k in range(2):
        with zipfile.ZipFile(tmp_path / str(k) / "a.zip") as z, open(tmp_path / str(k) / "a.zip", "rb") as f:
            assert z.testzip() is None and sorted(z.namelist()) == sorted(f"m{i}" for i in range(k, 3000, 2))
            assert z.read(f"m{k + 2}").decode() == "가" * (k + 2) and [x[0] for x in archives.directory(f)] == z.namelist()
    assert not list((tmp_path / "_parts").glob("*.members"))


def test_label_members_are_read_where_they_lie(spark, tmp_path, monkeypatch):
    label = lambda i: json.dumps({"raw_data_info": {}, "source_data_info": {"source_data_name_pdf": f"OC2_1_A_{i}.pdf"}, "learning_data_info": {"page_num": 1, "class_name": "T01", "plain_text": f"t{i}"}})
    with zipfile.ZipFile(tmp_path / "TL_01.x_json.zip", "w") as z:
        for i in range(50):
            z.writestr(f"{i}.json", label(i))
    listed = shared.cut(readers.zip_members(spark, str(tmp_path), "*json.zip", (".json",)), "listed")
    with open(tmp_path / "TL_01.x_json.zip", "r+b") as f:  # no reading looks at the directory again
        f.truncate(max(r.zip_place.at + r.zip_place.packed + 30 + len(r.member) for r in listed.collect()))
    monkeypatch.setattr(readers, "zip_members", lambda *_: listed)
    assert sorted(r.plain_text for r in readers.labelled_elements(spark, str(tmp_path)).collect()) == sorted(f"t{i}" for i in range(50))


def test_pdf_members_are_read_where_they_lie(spark, tmp_path):
    rows = spark.range(40).select(F.lit("all").alias("folder"), F.lit("a.zip").alias("archive"), F.concat(F.col("id").cast("string"), F.lit(".pdf")).alias("member"), F.lit("text").alias("content"))
    archives.write(rows, str(tmp_path))
    listed = shared.cut(readers.zip_members(spark, str(tmp_path)).select(F.col("member").alias("doc_id"), F.col("archive").alias("source_path"), F.col("member").alias("zip_entry"), "zip_place"), "listed")
    with open(tmp_path / "all" / "a.zip", "r+b") as f:  # no reading looks at the directory again
        f.truncate(max(r.zip_place.at + r.zip_place.packed + 30 + len(r.zip_entry) for r in listed.collect()))
    pages = lambda content: [(1.0, 1.0, {"blocks": [{"type": 0, "bbox": (0, 0, 1, 1), "lines": [{"spans": [{"text": content.decode(), "size": 1.0}]}]}]})]
    got = readers.pdf_blocks(listed, pages).collect()
    assert len(got) == 40 and {(r.text, r.parse_status) for r in got} == {("text", "parsed")}
