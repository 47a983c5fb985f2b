"""The data catalog: projects, datasets, reports (CAT-01, CAT-02, AGG-18, SNK-07)."""

from __future__ import annotations

import html
import json
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Entry:
    name: str
    path: str
    kind: str = "jsonl"
    stage: str = ""


@dataclass
class Project:
    project_id: str
    version: str
    label: str
    data_root: str
    datasets: list[Entry] = field(default_factory=list)
    reports: list[Entry] = field(default_factory=list)
    cases: list[str] = field(default_factory=list)


def load(values: list[dict]) -> list[Project]:
    """CAT-01: projects from plain values; ids must be unique, within a project names too."""
    out = [Project(**v | {k: [Entry(**e) for e in v.get(k, [])] for k in ("datasets", "reports")}) for v in values]
    ids = [p.project_id for p in out]
    if len(set(ids)) < len(ids):
        raise ValueError("duplicate project_id")
    for p in out:
        names = [e.name for e in p.datasets]
        if len(set(names)) < len(names):
            raise ValueError(f"{p.project_id}: duplicate dataset")
    return out


def _found(spark: SparkSession, path: str) -> tuple[bool, int]:
    """Whether a path is there, in any store that Spark reads, and its bytes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return (True, int(fs.getContentSummary(at).getLength())) if fs.exists(at) else (False, 0)


def _readers(spark: SparkSession) -> dict:
    return {"jsonl": spark.read.json, "parquet": spark.read.parquet, "csv": spark.read.option("header", True).csv, "text": spark.read.text}


def _entries(projects: list[Project]) -> list[tuple[Project, str, Entry, str]]:
    return [(p, scope, e, f"{p.data_root.rstrip('/')}/{e.path}") for p in projects for scope in ("datasets", "reports") for e in getattr(p, scope)]


def catalog(spark: SparkSession, projects: list[Project]) -> DataFrame:
    """CAT-02: one row a dataset or report, with whether its path is there."""
    rows = [(p.project_id, p.version, scope, e.name, e.kind, e.stage, path, _found(spark, path)[0]) for p, scope, e, path in _entries(projects)]
    return spark.createDataFrame(rows, "project_id string, version string, scope string, name string, kind string, stage string, path string, present boolean")


def register(spark: SparkSession, projects: list[Project]) -> list[str]:
    """Temp views ``<project>_<dataset>`` of the datasets that are there."""
    names = []
    for p, scope, e, path in _entries(projects):
        if scope == "datasets" and e.kind in _readers(spark) and _found(spark, path)[0]:
            _readers(spark)[e.kind](path).createOrReplaceTempView(f"{p.project_id}_{e.name}")
            names.append(f"{p.project_id}_{e.name}")
    return names


def _artifact(spark: SparkSession, project: Project, scope: str, entry: Entry, path: str, samples: int) -> dict:
    exists, size = _found(spark, path)
    told = {"artifact_type": "report" if scope == "reports" else "data", "project_id": project.project_id, "project_version": project.version, "project_label": project.label, "scope": scope, "name": entry.name, "stage": entry.stage or ("report" if scope == "reports" else ""), "format": entry.kind, "path": path, "exists": exists, "bytes": size, "records": 0, "fields": [], "samples": [], "error": ""}
    if exists and entry.kind in _readers(spark):
        try:
            df = _readers(spark)[entry.kind](path)
            told |= {"records": df.count(), "fields": df.columns, "samples": [json.loads(x) for x in df.limit(samples).toJSON().collect()]}
        except Exception as e:  # noqa: BLE001  a broken artifact is shown as such
            told["error"] = str(e)[:300]
    return told


def model(spark: SparkSession, projects: list[Project], links: dict[str, list[dict]] | None = None, samples: int = 3) -> dict:
    """CAT-02: what a dashboard shows: projects, artifacts with sizes, fields and samples, counts, and links of questions.

    ``links``: by project, rows of ``lineage`` (JN-13) as dictionaries.
    """
    entries = _entries(projects)
    artifacts = [_artifact(spark, p, scope, e, path, samples) for p, scope, e, path in entries]
    count = lambda key, rows: dict(sorted(Counter(r[key] for r in rows).items()))
    datasets, reports = ([a for a in artifacts if a["artifact_type"] == t] for t in ("data", "report"))
    by_scope: dict[tuple[str, str], list[dict]] = {}
    for a in artifacts:
        by_scope.setdefault((a["project_id"], a["scope"]), []).append(a)
    summary = {"projects": len(projects), "datasets": len(datasets), "reports": len(reports), "artifacts": len(artifacts), "stages": sorted({a["stage"] for a in artifacts}), "scopes": sorted({a["scope"] for a in artifacts})}
    summary |= {f"artifacts_by_{name}": count(key, artifacts) for name, key in (("stage", "stage"), ("scope", "scope"), ("type", "artifact_type"))} | {f"datasets_by_{key}": count(key, datasets) for key in ("stage", "scope")}
    told = [{"project_id": p.project_id, "version": p.version, "label": p.label, "data_root": p.data_root, "cases": p.cases} for p in projects]
    return {"projects": told, "datasets": datasets, "reports": reports, "artifacts": artifacts, "qaset_links": links or {}, "summary": summary, "by_scope": by_scope}


_PAGE = """<!doctype html><html lang=en><meta charset=utf-8><title>{title}</title>
<style>body{{font:14px sans-serif;margin:2em}}table{{border-collapse:collapse;width:100%}}td,th{{border-bottom:1px solid #ccc;padding:4px;text-align:left}}.missing{{color:#a00}}select,input{{margin-right:1em}}</style>
<h1>{title}</h1><p id=summary></p><input id=text placeholder=filter><select id=stage></select><select id=scope></select>
<table><thead><tr><th>project<th>name<th>stage<th>format<th>records<th>bytes<th>fields</tr></thead><tbody id=rows></tbody></table><pre id=detail></pre>
<script type=application/json id=model>{data}</script>
<script>
const m=JSON.parse(document.getElementById('model').textContent),$=i=>document.getElementById(i);
$('summary').textContent=['projects','datasets','reports','artifacts'].map(k=>k+': '+m.summary[k]).join(', ');
for(const k of ['stage','scope'])$(k).append(...['',...m.summary[k+'s']].map(v=>new Option(v||'every '+k,v)));
const show=()=>{{$('rows').replaceChildren(...m.artifacts.filter(a=>(!$('stage').value||a.stage===$('stage').value)&&(!$('scope').value||a.scope===$('scope').value)&&JSON.stringify(a).includes($('text').value)).map(a=>{{
const r=document.createElement('tr');r.className=a.exists?'':'missing';for(const v of [a.project_id,a.name,a.stage,a.format,a.records,a.bytes,a.fields.join(', ')])r.insertCell().textContent=v;
r.onclick=()=>$('detail').textContent=JSON.stringify({{samples:a.samples,error:a.error,links:m.qaset_links[a.project_id]||[]}},null,1);return r}}))}};
for(const i of ['text','stage','scope'])$(i).oninput=show;show();
</script>"""


def dashboard(found: dict, title: str = "Experiments") -> str:
    """SNK-07: a static page with the model as embedded JSON, filters by text, stage and scope, and an artifact's samples."""
    data = json.dumps({k: v for k, v in found.items() if k != "by_scope"}, ensure_ascii=False, default=str).replace("<", "\\u003c")
    return _PAGE.format(title=html.escape(title), data=data)


def counters(rows: DataFrame) -> DataFrame:
    """AGG-18, AGG-22: entries and missing ones by project and scope."""
    return rows.groupBy("project_id", "scope").agg(F.count(F.lit(1)).alias("entries"), F.count_if(~F.col("present")).alias("missing"))
