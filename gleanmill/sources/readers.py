"""Scans (SRC-01..15)."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared
from ..functions import text as tx
from . import archives


def jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """SRC-01, SRC-12: one row a line; blank lines are no rows. Without a schema Spark infers one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def validated_jsonl(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """SRC-02: a malformed line, or one without a required field, fails the scan."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for c in required:
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing"))).otherwise(F.col(c)))
    return rows


# Columns of ticket tables by dataset.
TICKET_COLUMNS: dict[str, dict[str, str | list[str]]] = {
    "default": {"ticket_id": "ticket_id", "created_at": "created_at", "ticket_type": "type", "priority": "priority", "queue": "queue", "business_type": "business_type", "subject": "subject", "description": "body", "resolution": "answer", "tags": "tags", "status": "status"},
    "multilingual_customer_support": {"ticket_id": "id", "created_at": "created_at", "ticket_type": "type", "priority": "priority", "queue": "queue", "business_type": "business_type", "subject": "subject", "description": "body", "resolution": "answer", "tags": [f"tag_{k}" for k in range(1, 9)], "status": "status"},
}


def numbered(rows: DataFrame, name: str = "_n") -> DataFrame:
    """Rows of a file scan with their place, from 0, in the order of file names and lines.

    Rows of a split of a file follow each other in its task, so a row's place is its distance from the split's first row
    plus the rows of earlier splits; only one count a split is shuffled.
    """
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    placed = rows.select("*", *split, F.monotonically_increasing_id().alias("_id"))
    splits = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first"))
    before = F.sum("_rows").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("_file", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_offset"))  # one row a split
    return placed.join(offsets, ["_file", "_block"]).withColumn(name, F.col("_offset") + F.col("_id") - F.col("_first")).drop("_file", "_block", "_id", "_first", "_offset")


def tickets(spark: SparkSession, path: str, source_dataset: str, mapping: dict[str, str | list[str]] | None = None, limit: int | None = None) -> DataFrame:
    """SRC-03: a CSV with header through a column mapping; ids default to ``<dataset>_<row>``. ``limit`` keeps the first rows."""
    mapping = mapping or TICKET_COLUMNS.get(source_dataset, TICKET_COLUMNS["default"])
    raw = numbered(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))
    if limit:
        raw = raw.where(F.col("_n") < limit)

    def of(key: str) -> Column:
        c = mapping.get(key, "")
        return F.col(f"`{c}`") if isinstance(c, str) and c in raw.columns else F.lit(None).cast("string")

    names = mapping.get("tags", "")
    if isinstance(names, list):
        found = F.array(*[tx.clean_text(F.col(f"`{c}`")) for c in names if c in raw.columns])
        tags = F.filter(found, lambda x: x != "")
    else:
        tags = tx.split_tags(of("tags"))
    text = {k: tx.clean_text(of(k)) for k in ("subject", "description", "resolution", "queue", "business_type")}
    row_id = tx.clean_text(of("ticket_id"))
    return raw.select(
        F.when(row_id != "", row_id).otherwise(F.concat(F.lit(f"{source_dataset}_"), F.col("_n").cast("string"))).alias("ticket_id"),
        F.lit(source_dataset).alias("source_dataset"),
        tx.lenient_timestamp(of("created_at")).alias("created_at"),
        tx.normalize_choice(of("ticket_type"), tx.TICKET_TYPES).alias("ticket_type"),
        tx.normalize_choice(of("priority"), tx.PRIORITIES).alias("priority"),
        *[c.alias(k) for k, c in text.items()],
        tags.alias("tags"),
        tx.normalize_choice(of("status"), tx.STATUSES).alias("status"),
        F.concat_ws(" ", *[F.when(text[k] != "", text[k]) for k in ("subject", "description", "resolution")]).alias("raw_text"),
    )


def logs(spark: SparkSession, path: str, source_dataset: str, system: str = "unknown", limit: int | None = None) -> DataFrame:
    """SRC-04: lines of a log; blank ones count towards ``limit`` (0 or None: none) and are skipped afterwards."""
    lines = spark.read.text(path)
    if limit:
        lines = numbered(lines).where(F.col("_n") < limit)
    raw = F.regexp_replace("value", r"[\r\n]+$", "")
    rows = lines.select(raw.alias("raw")).where(F.trim("raw") != "")
    return rows.select(
        tx.short_sha1(F.concat(F.lit(f"{source_dataset}:"), F.col("raw"))).alias("log_id"),
        F.lit(source_dataset).alias("source_dataset"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit(system).alias("system"),
        tx.severity(F.col("raw")).alias("severity"),
        F.lit("").alias("component"),
        tx.clean_text(F.col("raw")).alias("message"),
        tx.is_anomaly(F.col("raw")).alias("is_anomaly"),
        F.lit("").alias("template"),
        F.col("raw").alias("raw_log"),
    )


_PLACE = "struct<at:long,packed:long,crc:long>"
#: ``zip_place``: where a member lies in its archive, so that it can be read without the archive's directory.
_MEMBERS = f"archive string, member string, file_size long, compressed_size long, zip_place {_PLACE}"


def _dealt(members: DataFrame, archive: str) -> DataFrame:
    """Members on all cores, neighbours together and in order: many tasks read an archive, and each opens it once."""
    tasks = 4 * members.sparkSession.sparkContext.defaultParallelism
    return members.repartition(tasks, F.col(archive), F.shiftright("zip_place.at", 20)).sortWithinPartitions(archive, "zip_place.at")


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Path and size of files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")


def zip_members(spark: SparkSession, path: str, glob: str = "*.zip", suffixes: tuple[str, ...] = (".pdf",)) -> DataFrame:
    """SRC-05, SRC-08: members of all archives below a folder. Of an archive only its directory, at the end, is read."""

    kinds = shared.arrow_schema(_MEMBERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name,) in shared.rows_of(batches):
            with archives.open_file(name) as f:
                found = ((name, m, size, packed, {"at": at, "packed": packed, "crc": crc}) for m, size, packed, at, crc in archives.directory(f) if m.lower().endswith(suffixes))
                yield from shared.batches_of(found, kinds)

    return _files(spark, path, glob).select("path").mapInArrow(run, _MEMBERS)


def _base(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]+)$", 1)


def _split(archive: Column) -> Column:
    return F.when(archive.contains("Validation"), "validation").otherwise("training")


def _kind(archive: Column) -> Column:
    kind = F.regexp_extract(_base(archive), r"\.([^._]+)_", 1)
    return F.when(kind != "", kind).otherwise("unknown")


def office_inventory(spark: SparkSession, path: str, split: str | None = None, stratified: bool = False, limit: int | None = None, glob: str = "*.zip") -> DataFrame:
    """SRC-05, FN-10, TOP-04: documents of the archives; ``stratified`` takes types in turn."""
    m = zip_members(spark, path, glob)
    stem = F.regexp_replace(_base(F.col("member")), r"\.[^.]*$", "")
    rows = m.select(
        tx.document_id(stem).alias("doc_id"),
        _split(F.col("archive")).alias("split"),
        _kind(F.col("archive")).alias("document_type"),
        F.col("archive").alias("source_archive"),
        F.col("member").alias("source_member"),
        "file_size",
    )
    if split:
        rows = rows.where(F.col("split") == split)
    order = [F.col("source_archive"), F.col("source_member")]
    if stratified:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("document_type").orderBy(*order)))
        order = [F.col("_n"), F.col("document_type")]
    rows = rows.orderBy(*order).drop("_n") if limit is None else rows.orderBy(*order).limit(limit).drop("_n")
    return rows


def manifest_slice(rows: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """SRC-06: a slice of an ordered manifest."""
    return rows.orderBy(order).offset(offset).limit(limit)


def papers(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08, FN-14, FN-15: PDF and PPTX files below a folder, also inside archives; PPTX is not parsed."""
    files = _files(spark, path, "*").select(F.col("path").alias("source_path"), F.lit(None).cast("string").alias("zip_entry"), F.col("length").alias("size_bytes"), F.lit(None).cast(_PLACE).alias("zip_place"))
    plain = files.where(F.lower("source_path").rlike(r"\.(pdf|pptx)$"))
    packed = zip_members(spark, path, "*.zip", (".pdf", ".pptx")).select(F.col("archive").alias("source_path"), F.col("member").alias("zip_entry"), F.col("file_size").alias("size_bytes"), "zip_place")
    rows = plain.unionByName(packed)
    name = _base(F.coalesce("zip_entry", "source_path"))
    root = path.rstrip("/").removeprefix("file:").replace("//", "/")
    inside = F.regexp_replace(F.regexp_replace("source_path", "^file:/*", "/"), "^\\Q" + root + "\\E/?", "")
    first = F.split_part(inside, F.lit("/"), F.lit(1))
    code = F.substring(name, 1, 2)
    research = F.when(code == "ST", "science_technology").when(code == "SS", "social_science").when(code == "HA", "humanities_arts").when(F.contains(inside, F.lit("/")), first).otherwise("unknown")
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return rows.select(
        tx.stable_doc_id(F.regexp_replace(F.concat_ws("_", inside, "zip_entry"), r"\.[^.]*$", "")).alias("doc_id"),
        "source_path",
        "zip_entry",
        inside.alias("relative_path"),
        name.alias("file_name"),
        kind.alias("file_type"),
        "size_bytes",
        research.alias("research_field"),
        F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[_-]+", " ").alias("paper_topic"),
        tx.publication_year(name).alias("publication_year"),
        F.when(kind == "pptx", "unsupported_pptx").otherwise("pending").alias("parse_status"),
        "zip_place",
    )


_PAGES = "doc_id string, page_num int, raw_text string, parse_status string, error string"


def _content(opened: archives.Opened, path: str, entry: str | None, place: dict | None) -> bytes:
    """A file, or one member of an archive, whose other members are not read."""
    if not entry:
        with archives.open_file(path) as f:
            return f.read()
    f = opened(path)
    if place is None:
        found = [x for x in archives.directory(f) if x[0] == entry]
        if not found:
            raise KeyError(f"There is no item named {entry!r} in the archive")
        place = dict(zip(("packed", "at", "crc"), found[-1][2:], strict=True))
    return archives.member(f, entry, place["at"], place["packed"], place["crc"])


def _extracted(manifest: DataFrame, extract, schema: str) -> DataFrame:
    """``extract(bytes) -> rows``, after the doc_id and before status and error; a failure is one row with status ``failed``.

    With ``zip_place`` members are dealt to all tasks and read where they lie; without it their archive's directory is
    searched for each.
    """
    empty = (None,) * (len(schema.split(", ")) - 3)
    kinds = shared.arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch], opened: archives.Opened) -> Iterator[tuple]:
        for doc, path, entry, place in shared.rows_of(batches):
            try:
                yield from [(doc, *row, "parsed", "") for row in extract(_content(opened, path, entry, place))]
            except Exception as e:  # noqa: BLE001  a broken file must not end the job
                opened.close()
                yield (doc, *empty, "failed", f"{type(e).__name__}: {e}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = archives.Opened()
        yield from shared.batches_of(rows(batches, opened), kinds)
        opened.close()

    placed = "zip_place" in manifest.columns
    files = manifest.select("doc_id", "source_path", "zip_entry", F.col("zip_place") if placed else F.lit(None).cast(_PLACE).alias("zip_place"))
    return (_dealt(files, "source_path") if placed else files).mapInArrow(run, schema)


def paper_pages(spark: SparkSession, manifest: DataFrame, extract=None) -> DataFrame:
    """SRC-09: page texts of ``doc_id, source_path, zip_entry``; a failure is a row with status ``failed`` and page 0.

    ``extract(bytes) -> list of page texts`` defaults to PyMuPDF where that is installed.
    """
    pages = _extracted(manifest, lambda content: list(enumerate((extract or _pymupdf)(content), 1)), _PAGES)
    return pages.withColumns({"page_num": F.coalesce("page_num", F.lit(0)), "raw_text": F.coalesce("raw_text", F.lit(""))})


def _pymupdf(content: bytes) -> list[str]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as pdf:
        return [page.get_text() for page in pdf]


_BLOCKS = "doc_id string, page_num int, width double, height double, x0 double, y0 double, x1 double, y1 double, text string, font_size double, parse_status string, error string"


def pdf_blocks(manifest: DataFrame, pages=None) -> DataFrame:
    """SRC-07: text blocks with their place and largest font; ``layout`` orders and cleans them and finds titles.

    ``pages(bytes)`` gives (width, height, layout) of each page, the layout as PyMuPDF's ``dict`` mode has it (the default).
    """

    def blocks(content: bytes) -> Iterator[tuple]:
        for number, (width, height, layout) in enumerate((pages or _layouts)(content), 1):
            for block in layout.get("blocks", []):
                spans = [[(str(x.get("text", "")), float(x.get("size", 0.0))) for x in line.get("spans", [])] for line in block.get("lines", [])]
                text = "\n".join(t for t in (" ".join("".join(t for t, _ in line).split()) for line in spans) if t)
                if block.get("type") == 0 and text:
                    yield (number, float(width), float(height), *map(float, block["bbox"]), text, max((size for line in spans for t, size in line if t.strip()), default=0.0))

    return _extracted(manifest, blocks, _BLOCKS)


def _layouts(content: bytes) -> Iterator[tuple[float, float, dict]]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as pdf:
        for page in pdf:
            yield page.rect.width, page.rect.height, page.get_text("dict")


def parse_report(pages: DataFrame) -> DataFrame:
    """AGG-17: statuses, pages and empty pages."""
    return pages.groupBy("parse_status").agg(F.count_distinct("doc_id").alias("documents"), F.count_if(F.col("page_num") > 0).alias("pages"), F.count_if((F.col("page_num") > 0) & (F.trim("raw_text") == "")).alias("empty_pages"))


_LABELS = "doc_id string, split string, document_type string, title string, publisher string, organ_type string, source_pdf string, page_num int, class_name string, x double, y double, plain_text string, visual_description string, document_description string"


def labelled_elements(spark: SparkSession, path: str, manifest: DataFrame | None = None, limit: int | None = None, glob: str = "*json.zip") -> DataFrame:
    """SRC-10, JN-06: labelled elements of all JSON members of archives below a folder, of known documents where a manifest is given.

    ``limit`` counts documents, the first by id.
    """
    members = zip_members(spark, path, glob, (".json",)).select("archive", "member", "zip_place")
    schema = "archive string, source_pdf string, doc_name string, publisher string, organ_type string, page_num int, class_name string, x double, y double, plain_text string, visual_description string, document_description string"
    kinds = shared.arrow_schema(schema)
    said = lambda x, k: str(x.get(k) or "")

    def labels(batches: Iterator[pa.RecordBatch], opened: archives.Opened) -> Iterator[tuple]:
        for archive, name, place in shared.rows_of(batches):
            record = json.loads(archives.member(opened(archive), name, place["at"], place["packed"], place["crc"]).decode("utf-8-sig"))
            raw, source, label = (record[k] for k in ("raw_data_info", "source_data_info", "learning_data_info"))
            x, y = [*(label.get("bounding_box") or []), 0, 0][:2] if len(label.get("bounding_box") or []) != 1 else (label["bounding_box"][0], 0)
            told = [said(label, k) for k in ("plain_text", "visual_description", "document_description")]
            yield (archive, source["source_data_name_pdf"], said(raw, "doc_name"), said(raw, "publisher"), said(raw, "organ_type"), int(label["page_num"]), said(label, "class_name"), float(x), float(y), *told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = archives.Opened()
        yield from shared.batches_of(labels(batches, opened), kinds)
        opened.close()

    read = _dealt(members, "archive").mapInArrow(run, schema)
    doc = tx.document_id(F.regexp_replace(_base(F.col("source_pdf")), r"\.[^.]*$", ""))
    rows = read.withColumn("doc_id", doc).withColumns({"split": _split(F.col("archive")), "document_type": _kind(F.col("archive")), "title": F.when(F.col("doc_name") != "", F.col("doc_name")).otherwise(F.col("doc_id"))})
    rows = _of_documents(rows, manifest, limit)
    return rows.select(*[c.split()[0] for c in _LABELS.split(", ")])


def _of_documents(rows: DataFrame, manifest: DataFrame | None, limit: int | None) -> DataFrame:
    if manifest is not None:
        rows = rows.join(manifest.select("doc_id").distinct(), "doc_id", "left_semi")
    if limit:
        rows = rows.join(rows.select("doc_id").distinct().orderBy("doc_id").limit(limit), "doc_id", "left_semi")
    return rows


# A description that only points at other files.
REFERENCE_ONLY = r"^(?:\s*\[&\][^\s]+\s*)+$"


def oracle_pages(elements: DataFrame, manifest: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """SRC-10, FN-41, JN-06: page texts from labelled elements in the order of (y, x); ``limit`` counts documents.

    The first document description (class D01) is the page's text, unless it only points at other files; else the plain
    texts of the other classes are; else the visual descriptions, which are no reference for parsing. ``elements``:
    doc_id, page_num, class_name, x, y, plain_text, visual_description, document_description.
    """
    text = lambda c: tx.blank(F.col(c))
    place = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("y", "x")]
    told = F.struct(place[0].alias("y"), place[1].alias("x"), text("class_name").alias("kind"), text("plain_text").alias("plain"), text("visual_description").alias("visual"), text("document_description").alias("described"))
    pages = _of_documents(elements, manifest, limit).groupBy("doc_id", "page_num").agg(F.sort_array(F.collect_list(told)).alias("e"))  # a page's elements
    first = F.coalesce(F.get(F.filter("e", lambda x: (x["kind"] == "D01") & (x["described"] != "")), 0)["described"], F.lit(""))
    joined = lambda keep, field: F.array_join(F.transform(F.filter("e", keep), lambda x: x[field]), "\n")
    plain, visual = joined(lambda x: (x["plain"] != "") & (x["kind"] != "D01"), "plain"), joined(lambda x: x["visual"] != "", "visual")
    described = (first != "") & ~F.trim(first).rlike(REFERENCE_ONLY)
    kind = F.when(described, "document_description").when(plain != "", "plain_text").when(visual != "", "visual_description").otherwise("empty")
    rows = pages.select("doc_id", "page_num", first.alias("d"), plain.alias("p"), visual.alias("v"), kind.alias("oracle_text_type"))
    by = lambda of_visual: F.when(F.col("oracle_text_type") == "document_description", F.col("d")).when(F.col("oracle_text_type") == "plain_text", F.col("p")).otherwise(of_visual)
    return rows.select("doc_id", "page_num", by(F.col("v")).alias("content"), by(F.lit("")).alias("parsing_reference_text"), "oracle_text_type")


def oracle_documents(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """SRC-10: a row for each document: its title and metadata, and the texts of its pages in order."""
    text = F.array_join(F.transform(F.filter(F.sort_array(F.collect_list(F.struct("page_num", "content"))), lambda p: p["content"] != ""), lambda p: p["content"]), "\n\n")
    bodies = pages.groupBy("doc_id").agg(text.alias("content"), F.count(F.lit(1)).alias("page_count"))
    named = ["title", "split", "document_type", "publisher", "organ_type", "source_pdf"]
    return elements.groupBy("doc_id").agg(F.min(F.struct(*named)).alias("m")).select("doc_id", "m.*").join(bodies, "doc_id")


@dataclass
class Settings:
    """SRC-11: settings of a run."""

    data_root: str = ""
    top_k: int = 10
    candidate_k: int = 50
    rrf_k: int = 60
    model_name: str = ""
    batch_size: int = 64
    document_prefix: str = ""
    query_prefix: str = ""
    search_field: str = "content"
    provider: str = "mock"
    extra: dict = field(default_factory=dict)


# Environment variables that beat a file's values.
ENVIRONMENT = {"model_name": "EMBEDDING_MODEL", "batch_size": "EMBEDDING_BATCH_SIZE", "document_prefix": "EMBEDDING_DOCUMENT_PREFIX", "query_prefix": "EMBEDDING_QUERY_PREFIX", "provider": "LLM_PROVIDER"}


def load_settings(values: dict | str | None = None, env: dict[str, str] | None = None) -> Settings:
    """SRC-11: settings from a YAML file (a missing one is empty) or plain values, in sections or not.

    The environment beats them, but for an explicit ``data_root``. What is not a setting is kept in ``extra``.
    """
    if isinstance(values, str):
        values = _yaml(values)
    env = os.environ if env is None else env
    flat = {k: v for key, value in (values or {}).items() for k, v in (value.items() if isinstance(value, dict) else [(key, value)])}
    out = Settings(str(flat.pop("data_root", "") or env.get("DATA_ROOT", "")))
    for name, kind in Settings.__annotations__.items():
        if name not in ("data_root", "extra"):
            value = env.get(ENVIRONMENT.get(name, name.upper())) or flat.pop(name, getattr(out, name))
            flat.pop(name, None)
            setattr(out, name, int(value) if kind == "int" else str(value))
    out.extra = flat
    return out


def _yaml(path: str) -> dict:
    import yaml

    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def sample(df: DataFrame, rows: int = 5) -> dict:
    """SRC-13: row count, field names and first rows."""
    return {"row_count": df.count(), "fields": df.columns, "rows": [r.asDict(recursive=True) for r in df.limit(rows).collect()]}


# Tables of the lake and where they lie below the data root.
LAKE = {
    "manifest": "manifests/manifest.jsonl",
    "documents": "processed/documents.jsonl",
    "pages": "processed/pages.jsonl",
    "blocks": "processed/blocks.jsonl",
    "page_chunks": "processed/page_chunks.jsonl",
    "structure_chunks": "processed/structure_chunks.jsonl",
    "golden_questions": "eval/golden_questions.jsonl",
}


def lake_sources(data_root: str, extra: list[str] = ()) -> dict[str, str]:
    """SRC-14, SRC-15: the seven tables, with ``table=path`` overrides."""
    out = {t: f"{data_root.rstrip('/')}/{p}" for t, p in LAKE.items()}
    for item in extra:
        name, eq, path = item.partition("=")
        if not (eq and name and path):
            raise ValueError(f"expected table=path, got {item!r}")
        out[name] = path
    return out
