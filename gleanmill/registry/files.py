"""Queries that write tables as the formats of sources and sinks and read them back, with the SQL over the tables."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import functions as F

from .. import shared
from ..functions import text as tx
from ..operators import layout
from ..operators import marts as mr
from ..operators import retrieval as rt
from ..plans import catalog
from ..sources import archives, readers, schemas, sinks
from .base import query, table
from .ranking import _bm25, questions
from .texts import clean_sql, tickets


@query("SELECT doc_id, md5(text) AS text_md5, lang FROM documents")
def json_lines(spark, sf):
    """SRC-01, SRC-02, SRC-12, SNK-01."""
    path = shared.shared_path(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    rows = readers.validated_jsonl(spark, path, schemas.fields(doc_id=schemas.L, text=schemas.S, lang=schemas.S), ("doc_id",))
    return rows.select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query(
    f"""WITH t AS (SELECT conv_id, arg_min(substr(text, 1, 60), turn) AS subject, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'user'), '') AS description FROM conversations GROUP BY conv_id),
n AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS n FROM t)
SELECT CASE WHEN conv_id % 4 = 0 THEN 'chat_' || n ELSE conv_id::VARCHAR END AS ticket_id, md5({clean_sql('subject')}) AS subject_md5, md5({clean_sql('description')}) AS description_md5, 'chat;nan;p' || (conv_id % 4) AS tags, ['low', 'medium', 'high', 'critical', 'unknown'][conv_id % 5 + 1] AS priority FROM n WHERE n < 100"""
)
def ticket_csv(spark, sf):
    """SRC-03, SNK-03: the first 100 rows (the limit is the source's); every fourth ticket has no id of its own."""
    path = shared.shared_path(spark, "csv")
    rows = tickets(spark, sf).withColumn("conv", F.col("ticket_id").cast("long")).withColumn("ticket_id", F.when(F.col("conv") % 4 != 0, F.col("ticket_id")))
    sinks.write_csv(rows.orderBy("conv"), path)
    same = {c: c for c in ("ticket_id", "priority", "subject", "description", "resolution", "tags", "queue", "status")}
    out = readers.tickets(spark, path, "chat", same, 100)
    return out.select("ticket_id", F.md5("subject").alias("subject_md5"), F.md5("description").alias("description_md5"), F.array_join("tags", ";").alias("tags"), "priority")


@query(
    r"""WITH l AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN '' ELSE CASE event_id % 3 WHEN 0 THEN '1 ERROR ' WHEN 1 THEN 'warn ' ELSE 'note ' END || event_type || ' ' || event_id END AS raw FROM events ORDER BY event_id LIMIT 5000)
SELECT raw AS raw_log, substr(sha1('web:' || raw), 1, 16) AS log_id, CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE CASE WHEN event_type = 'error' THEN 'error' ELSE 'unknown' END END AS severity, CASE WHEN event_id % 3 = 0 THEN true END AS is_anomaly FROM l JOIN events USING (event_id) WHERE trim(raw) <> ''"""
)
def log_lines(spark, sf):
    """SRC-04, FN-05, FN-06, FN-07: the first 5,000 lines (the limit is the source's), blank ones among them."""
    path = shared.shared_path(spark, "log")
    i = F.col("event_id")
    raw = F.when(i % 13 == 0, "").otherwise(F.concat(F.when(i % 3 == 0, "1 ERROR ").when(i % 3 == 1, "warn ").otherwise("note "), "event_type", F.lit(" "), i.cast("string")))
    table(spark, sf, "events").orderBy("event_id").select(raw.alias("value")).write.text(path)
    return readers.logs(spark, path, "web", limit=5000).select("raw_log", "log_id", "severity", "is_anomaly")


def _archives(spark, rows, what: str) -> str:
    """Members ``folder, archive, member, content`` as ZIP archives below a new path."""
    path = shared.shared_path(spark, what)
    archives.write(rows, path)
    return path


def _office_archives(spark, sf) -> str:
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("TS_01."), "lang", F.lit("_"), "source", F.lit(".zip"))
    member = F.concat(F.lit("x/OC2_1_"), F.upper("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    note = d.where("doc_id % 50 = 0").select(F.lit("Training").alias("folder"), name.alias("archive"), F.concat(F.lit("note"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("member"), F.lit("x").alias("content"))
    return _archives(spark, d.select(F.when(F.col("lang") == "en", "Validation").otherwise("Training").alias("folder"), name.alias("archive"), member.alias("member"), F.col("text").alias("content")).unionByName(note), "office")


@query("SELECT 'OC2_1_' || upper(lang) || '_' || doc_id AS doc_id, CASE WHEN lang = 'en' THEN 'validation' ELSE 'training' END AS split, lang AS document_type, 'x/OC2_1_' || upper(lang) || '_' || doc_id || '.pdf' AS source_member, strlen(text) AS file_size FROM documents")
def office_archives(spark, sf):
    """SRC-05, FN-10: the inventory of archives, with members that are no documents."""
    return readers.office_inventory(spark, _office_archives(spark, sf)).drop("source_archive")


@query(
    "SELECT doc_id, document_type FROM (SELECT 'OC2_1_' || upper(lang) || '_' || doc_id AS doc_id, lang AS document_type, row_number() OVER (PARTITION BY lang ORDER BY source, 'x/OC2_1_' || upper(lang) || '_' || doc_id || '.pdf') AS n FROM documents WHERE lang <> 'en') ORDER BY n, document_type LIMIT 40 OFFSET 20"
)
def inventory_slice(spark, sf):
    """SRC-05, SRC-06, TOP-04: types in turn, then a slice of that manifest (both are the features)."""
    rows = readers.office_inventory(spark, _office_archives(spark, sf), split="training", stratified=True, limit=60)
    numbered = rows.coalesce(1).withColumn("at", F.monotonically_increasing_id())  # 60 rows in order
    return readers.manifest_slice(numbered, "at", 20, 40).select("doc_id", "document_type")


@query(
    """WITH p AS (SELECT 'paper_ST_' || doc_id || '_2020' AS doc_id, 'ST_' || doc_id || '_2020.pdf' AS file_name, doc_id AS id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id % 9 <> 8)
SELECT doc_id, file_name, 'science_technology' AS research_field, '2020' AS publication_year, CASE WHEN id % 9 = 7 THEN 'failed' ELSE 'parsed' END AS parse_status, CASE WHEN id % 9 = 7 THEN 1 ELSE len(l) END::BIGINT AS pages, md5(CASE WHEN id % 9 = 7 THEN '' ELSE array_to_string(l, chr(12)) END) AS text_md5 FROM p"""
)
def paper_archives(spark, sf):
    """SRC-08, SRC-09, FN-14, FN-15: papers in archives; every ninth is broken, some are slides."""
    i = F.col("doc_id")
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("ST_"), i.cast("string"), F.lit("_2020"), F.when(i % 9 == 8, ".pptx").otherwise(".pdf"))
    content = F.concat(F.when(i % 9 == 7, "broken").otherwise(""), F.replace("text", F.lit("\n"), F.lit("\f")))
    path = _archives(spark, d.select(F.lit("all").alias("folder"), F.concat("source", F.lit(".zip")).alias("archive"), name.alias("member"), content.alias("content")), "papers")

    def extract(content: bytes) -> list[str]:
        if content.startswith(b"broken"):
            raise ValueError("broken")
        return content.decode().split("\f")

    found = shared.cut(readers.papers(spark, path).where("parse_status = 'pending'"), "manifest")
    pages = readers.paper_pages(spark, found, extract)
    texts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.min("parse_status").alias("parse_status"), F.sort_array(F.collect_list(F.struct("page_num", "raw_text"))).alias("t"))
    rows = found.drop("parse_status").join(texts, "doc_id")
    tail = F.concat(F.lit("paper_"), F.regexp_extract("doc_id", r"(ST_\d+_2020)$", 1))
    return rows.select(tail.alias("doc_id"), "file_name", "research_field", "publication_year", "parse_status", "pages", F.md5(F.array_join(F.transform("t", lambda p: p["raw_text"]), "\f")).alias("text_md5"))


@query("SELECT CASE WHEN doc_id % 9 = 7 THEN 'failed' ELSE 'parsed' END AS parse_status, count(*) AS documents, sum(CASE WHEN doc_id % 9 = 7 THEN 0 ELSE len(string_split(text, chr(10))) END)::BIGINT AS pages, sum(CASE WHEN doc_id % 9 = 7 THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') = '')) END)::BIGINT AS empty_pages FROM documents GROUP BY 1")
def paper_report(spark, sf):
    """AGG-17: pages by status; a failed paper has no page."""
    i = F.col("doc_id")
    lines = table(spark, sf, "documents").select(i.cast("string").alias("doc_id"), (i % 9 == 7).alias("bad"), F.posexplode(F.when(i % 9 == 7, F.array(F.lit(""))).otherwise(F.split("text", "\n", -1))).alias("at", "raw_text"))
    return readers.parse_report(lines.select("doc_id", F.when(F.col("bad"), 0).otherwise(F.col("at") + 1).alias("page_num"), "raw_text", F.when(F.col("bad"), "failed").otherwise("parsed").alias("parse_status")))


@query(
    """WITH l AS (SELECT doc_id, l[i] AS line, i - 1 AS i FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
b AS (SELECT doc_id, i, trim(regexp_replace(line, '\\s+', ' ', 'g'), ' ') AS text, (10 + i % 4)::DOUBLE AS font, (i // 10 + 1) AS page FROM l),
t AS (SELECT doc_id, arg_max(text, struct_pack(f := font, p := -page, t := text)) AS title FROM b WHERE text <> '' AND page <= 2 AND length(text) <= 200 GROUP BY doc_id)
SELECT b.doc_id::VARCHAR AS doc_id, count(*) AS blocks, count(DISTINCT page) AS pages, md5(string_agg(text, chr(10) ORDER BY i)) AS text_md5, max(font) AS largest, coalesce(any_value(title), '') AS title FROM b LEFT JOIN t USING (doc_id) WHERE text <> '' GROUP BY b.doc_id"""
)
def pdf_layout(spark, sf):
    """SRC-07: blocks with fonts and titles, from layouts as the PDF library gives them (ten lines a page, one image each)."""
    d = table(spark, sf, "documents")
    path = _archives(spark, d.select(F.lit("all").alias("folder"), F.concat("source", F.lit(".zip")).alias("archive"), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("member"), F.col("text").alias("content")), "layouts")

    def layouts(content: bytes) -> Iterator[tuple[float, float, dict]]:
        lines = content.decode().split("\n")
        for first in range(0, len(lines), 10):
            blocks = [{"type": 1, "bbox": (0, 0, 1, 1)}]
            for k, line in enumerate(lines[first : first + 10], first):
                spans = [{"text": line[: len(line) // 2], "size": 9.0}, {"text": line[len(line) // 2 :], "size": 10.0 + k % 4}]
                blocks.append({"type": 0, "bbox": (0, k % 10 * 10, 100, k % 10 * 10 + 9), "lines": [{"spans": spans}]})
            yield 600.0, 800.0, {"blocks": blocks}

    members = readers.zip_members(spark, path).select(F.regexp_extract("member", r"^(\d+)\.", 1).alias("doc_id"), F.col("archive").alias("source_path"), F.col("member").alias("zip_entry"), "zip_place")
    blocks = shared.cut(readers.pdf_blocks(members, layouts).where("parse_status = 'parsed'"), "blocks")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_num", "y0", "text"))), lambda b: b["text"]), "\n")
    rows = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_distinct("page_num").alias("pages"), F.md5(text).alias("text_md5"), F.max("font_size").alias("largest"))
    return rows.join(layout.page_title(blocks), "doc_id", "left").withColumn("title", F.coalesce("title", F.lit("")))


@query(
    """WITH e AS (SELECT doc_id, l[i] AS line, i - 1 AS i FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id % 2 = 0))),
p AS (SELECT doc_id, i // 10 + 1 AS page, arg_min(line, i) FILTER (WHERE i % 10 = 3 AND doc_id % 3 = 0 AND line <> '') AS d, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE doc_id % 5 <> 0 AND line <> '' AND i % 10 <> 3), '') AS plain, coalesce(string_agg('see ' || i, chr(10) ORDER BY i) FILTER (WHERE i % 10 = 4), '') AS visual FROM e GROUP BY ALL),
k AS (SELECT *, CASE WHEN d IS NOT NULL THEN 'document_description' WHEN plain <> '' THEN 'plain_text' WHEN visual <> '' THEN 'visual_description' ELSE 'empty' END AS kind FROM p)
SELECT 'OC2_1_AB_' || doc_id AS doc_id, page::INT AS page_num, kind AS oracle_text_type, md5(CASE kind WHEN 'document_description' THEN d WHEN 'plain_text' THEN plain WHEN 'visual_description' THEN visual ELSE '' END) AS content_md5, md5(CASE kind WHEN 'document_description' THEN d WHEN 'plain_text' THEN plain ELSE '' END) AS reference_md5 FROM k"""
)
def label_archives(spark, sf):
    """SRC-10, FN-41, JN-06: labels in archives, for the documents of a manifest; some descriptions only point elsewhere."""
    d = table(spark, sf, "documents")
    rows = d.select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    i, doc = F.col("i"), F.col("doc_id")
    described = F.when((i % 10 == 3) & (doc % 3 == 0), F.col("line")).when((i % 10 == 3) & (doc % 3 == 1), "[&]other.json [&]more.json").otherwise("")
    label = F.struct(
        (F.floor(i / 10) + 1).cast("int").alias("page_num"),
        F.when(i % 10 == 3, "D01").otherwise("T01").alias("class_name"),
        F.array(F.lit(1.0), i.cast("double")).alias("bounding_box"),
        F.when(doc % 5 != 0, F.col("line")).otherwise("").alias("plain_text"),
        F.when(i % 10 == 4, F.concat(F.lit("see "), i.cast("string"))).otherwise("").alias("visual_description"),
        described.alias("document_description"),
    )
    name = F.concat(F.lit("OC2_1_AB_"), doc.cast("string"))
    record = F.struct(F.struct(F.lit("").alias("doc_name")).alias("raw_data_info"), F.struct(F.concat(name, F.lit(".pdf")).alias("source_data_name_pdf")).alias("source_data_info"), label.alias("learning_data_info"))
    members = rows.select(F.lit("Training").alias("folder"), F.concat(F.lit("TL_01."), "lang", F.lit("_json.zip")).alias("archive"), F.concat(name, F.lit("_"), i.cast("string"), F.lit(".json")).alias("member"), F.to_json(record).alias("content"))
    known = d.where("doc_id % 2 = 0").select(F.concat(F.lit("OC2_1_AB_"), doc.cast("string")).alias("doc_id"))
    pages = readers.oracle_pages(readers.labelled_elements(spark, _archives(spark, members, "labels"), known))
    return pages.select("doc_id", "page_num", "oracle_text_type", F.md5("content").alias("content_md5"), F.md5("parsing_reference_text").alias("reference_md5"))


@query("SELECT 'documents' AS name, count(*) AS rows, 3::BIGINT AS fields FROM documents UNION ALL SELECT 'pages', count(*), 2 FROM pages UNION ALL SELECT 'blocks', -1, 0")
def lake_tables(spark, sf):
    """SNK-02, SRC-13, SRC-14, SRC-15: JSON lines as a Parquet lake; one source is missing."""
    root, lake = shared.shared_path(spark, "raw"), shared.shared_path(spark, "lake")
    sources = {k: v for k, v in readers.lake_sources(root, [f"pages={root}/elsewhere"]).items() if k in ("documents", "pages", "blocks")}
    sinks.write_jsonl(table(spark, sf, "documents").select("doc_id", "lang", "source"), sources["documents"])
    sinks.write_jsonl(table(spark, sf, "pages").select("page_id", "url"), sources["pages"])
    counts = sinks.to_lake(spark, sources, lake)
    told = {n: readers.sample(spark.read.parquet(f"{lake}/{n}")) if c >= 0 else {"row_count": c, "fields": []} for n, c in counts.items()}
    return spark.createDataFrame([(n, t["row_count"], len(t["fields"])) for n, t in told.items()], "name string, rows long, fields long")


@query(
    """WITH w AS (SELECT doc_id, 0 AS nth, lang FROM documents UNION ALL SELECT doc_id, doc_id % 3 + 1, 'again ' || lang FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 9, 'last' FROM documents WHERE doc_id % 8 = 0)
SELECT doc_id, arg_max(lang, nth) AS embedding_text, 16::BIGINT AS dimensions FROM w GROUP BY doc_id"""
)
def vector_table(spark, sf):
    """SNK-04, RET-03, RET-04: of several writes of an id the last stays, and is encoded."""
    d = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("at"), F.col("lang").alias("embedding_text"), F.lit("page").alias("chunking_strategy"))
    again = d.where("doc_id % 4 = 0").withColumns({"at": (F.col("doc_id") % 3 + 1).cast("int"), "embedding_text": F.concat(F.lit("again "), "embedding_text")})
    last = d.where("doc_id % 8 = 0").withColumns({"at": F.lit(9), "embedding_text": F.lit("last")})
    path = shared.shared_path(spark, "vectors")
    sinks.write_vectors(last.unionByName(d).unionByName(again), path, order="at", encode=rt.hashed_words(16))
    return spark.read.parquet(path).select("doc_id", "embedding_text", F.size("embedding").cast("long").alias("dimensions"))


@query(f"WITH {_bm25('documents', 'b', 5)} SELECT * FROM b")
def standing_index(spark, sf):
    """SNK-05, RET-01: an index of all words, written once, and searched; ids were written twice."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.lit(1).alias("at"))
    older = d.where("doc_id % 5 = 0").withColumns({"text": F.lit("an older text"), "at": F.lit(0)})
    path = shared.shared_path(spark, "index")
    sinks.write_postings(rt.postings(d.unionByName(older), order="at"), path)
    return rt.bm25(questions(spark, sf), spark.read.parquet(f"{path}/postings"), 5)


@query(
    """SELECT 1::BIGINT AS line, 'method,mrr,tags' AS text UNION ALL SELECT 2, 'bm25,0.5,a;b' UNION ALL SELECT 3, '"say ""x"", y",0.25,' UNION ALL SELECT 4, 'hybrid,1.0,c'"""
)
def report_table(spark, sf):
    """SNK-03: a report table with byte order mark; rows are appended under one header."""
    path = os.path.join(tempfile.mkdtemp(prefix="gleanmill-"), "report.csv")
    schema = "method string, mrr double, tags array<string>"
    sinks.write_table(spark.createDataFrame([("bm25", 0.5, ["a", "b"]), ('say "x", y', 0.25, [])], schema), path)
    sinks.write_table(spark.createDataFrame([("hybrid", 1.0, ["c"])], schema), path, append=True)
    with open(path, "rb") as f:
        content = f.read()
    os.remove(path)
    lines = content.decode("utf-8-sig").splitlines() if content.startswith(b"\xef\xbb\xbf") else []
    return spark.createDataFrame(list(enumerate(lines, 1)), "line long, text string")


@query("SELECT lang AS method, round(avg(n_chars), 3)::DOUBLE AS mrr, count(*) AS questions FROM documents GROUP BY lang")
def eval_facts(spark, sf):
    """SNK-08, MART-05: a CSV summary staged as JSON lines, then a fact table."""
    summary, staged, fact = (shared.shared_path(spark, x) for x in ("summary", "staged", "fact"))
    rows = table(spark, sf, "documents").groupBy(F.col("lang").alias("method")).agg(F.round(F.avg("n_chars"), 3).alias("mrr"), F.count(F.lit(1)).alias("questions"))
    sinks.write_csv(rows, summary)
    sinks.write_jsonl(spark.read.option("header", True).csv(summary), staged)
    mr.fact_eval(readers.jsonl(spark, staged, schemas.fields(method=schemas.S, mrr=schemas.S, questions=schemas.S)), ["mrr"]).write.parquet(fact)
    return spark.read.parquet(fact).withColumn("questions", F.col("questions").cast("long"))


@query("SELECT * FROM (VALUES (1::BIGINT, 'stage_started', 'running', 0::BIGINT), (2, 'custom', 'running', 0), (3, 'stage_finished', 'succeeded', 7), (4, 'stage_failed', 'failed', 0), (5, 'resumed', 'at', 42)) t(nth, event, status, records)")
def run_records(spark, sf):
    """SNK-09, SNK-10: events and manifests of a good and a broken run, and where an index build went on."""
    folder = tempfile.mkdtemp(prefix="gleanmill-")
    with sinks.RunRecorder("parse", folder, run_id="good") as run:
        run.event("custom")
        run.records = 7
    try:
        with sinks.RunRecorder("parse", folder, run_id="bad") as broken:
            raise ValueError("broken")
    except ValueError:
        pass
    events = [json.loads(x)["event"] for r in (run, broken) for x in open(r.events_path, encoding="utf-8")]
    ends = [json.load(open(r.manifest_path, encoding="utf-8")) for r in (run, broken)]
    sinks.checkpoint(f"{folder}/at.json", "c", "config", run.events_path, 42)
    done = sinks.resume(f"{folder}/at.json", "c", "config", run.events_path)
    found = [(1, events[0], "running", 0), (2, events[1], "running", 0), (3, events[2], ends[0]["status"], ends[0]["record_count"]), (4, events[4], ends[1]["status"], ends[1]["record_count"]), (5, "resumed", "at", done)]
    return spark.createDataFrame(found, "nth long, event string, status string, records long")


_LINES = [("| check | status | observed | expected |"), ("| --- | --- | --- | --- |")]


@query(
    """SELECT 1::BIGINT AS line, '| check | status | observed | expected |' AS text UNION ALL SELECT 2, '| --- | --- | --- | --- |' UNION ALL SELECT 3, '| empty | ' || CASE WHEN n = 0 THEN 'PASS' ELSE 'WARN' END || ' | ' || n || ' | 0 |' FROM (SELECT count(*) AS n FROM documents WHERE trim(coalesce(text, '')) = '')
UNION ALL SELECT 4, '| ids | ' || CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END || ' | ' || n || ' | 0 |' FROM (SELECT count(*) - count(DISTINCT doc_id) AS n FROM documents)"""
)
def check_report(spark, sf):
    """SNK-06: the report of the checks."""
    d = table(spark, sf, "documents")
    text = mr.markdown(mr.empty_content("empty", d, "text").unionByName(mr.duplicates("ids", d, ["doc_id"])))
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"), 1)), "line long, text string")


@query("SELECT 'p' AS project_id, 'datasets' AS scope, 2::BIGINT AS entries, 1::BIGINT AS missing, (SELECT count(*) FROM documents) AS records UNION ALL SELECT 'p', 'reports', 1, 1, 0")
def catalog_counts(spark, sf):
    """CAT-01, CAT-02, AGG-18, SNK-07: the registry's entries, and the records of those that are there."""
    projects = catalog.load([{"project_id": "p", "version": "1", "label": "P", "data_root": sf, "datasets": [{"name": "documents", "path": "documents.parquet", "kind": "parquet", "stage": "raw"}, {"name": "none", "path": "none.jsonl", "stage": "raw"}], "reports": [{"name": "r", "path": "r.md", "kind": "text"}]}])
    model = catalog.model(spark, projects)
    if json.dumps(model["summary"]["artifacts_by_stage"]) not in catalog.dashboard(model):
        raise ValueError("the page lacks the model")
    rows = [(p, s, len(x), sum(not e["exists"] for e in x), sum(max(e["records"], 0) for e in x)) for (p, s), x in model["by_scope"].items()]
    return spark.createDataFrame(rows, "project_id string, scope string, entries long, missing long, records long")
