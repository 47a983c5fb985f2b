"""Queries on scalar text functions, noise and cleaning, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lines as ln
from ..functions import noise
from ..functions import text as tx
from ..operators import documents as dc
from .base import query, table

# the character references that are in the tables, one after the other; the ampersand last, with or without its semicolon
_UNESCAPED = "coalesce({0}, '')"
for _name, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&copy;", "©"), ("&middot;", "·")):
    _UNESCAPED = f"replace({_UNESCAPED}, '{_name}', '{_char}')"
_CLEAN = rf"trim(regexp_replace(regexp_replace(regexp_replace({_UNESCAPED}, '&amp;?', '&', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ')"


def clean_sql(c: str) -> str:
    return _CLEAN.format(c)


@query(f"SELECT page_id, {clean_sql('html')} AS clean FROM pages")
def clean_text_pages(spark, sf):
    """FN-01."""
    return table(spark, sf, "pages").select("page_id", tx.clean_text(F.col("html")).alias("clean"))


_RAW = "CAST(event_id AS VARCHAR) || CASE WHEN event_id % 3 = 0 THEN ' ERROR ' WHEN event_id % 3 = 1 THEN ' warn ' ELSE ' note ' END || event_type || ' ' || coalesce(props, '')"


@query(
    f"""
WITH r AS (SELECT event_id, {_RAW} AS raw FROM events),
w AS (SELECT *, lower(regexp_extract(raw, '(?i)\\b(INFO|WARN|WARNING|ERROR|ERR|FATAL|ALERT)\\b', 1)) AS word FROM r)
SELECT event_id, substr(sha1(raw), 1, 16) AS log_id,
       CASE WHEN word = '' THEN 'unknown' WHEN word IN ('warn', 'warning') THEN 'warning' WHEN word IN ('err', 'error', 'fatal') THEN 'error' ELSE word END AS severity,
       CASE WHEN starts_with(raw, '1 ') OR starts_with(raw, 'ALERT') THEN true END AS is_anomaly
FROM w"""
)
def severity_logs(spark, sf):
    """SRC-04, FN-05..07."""
    word = F.when(F.col("event_id") % 3 == 0, " ERROR ").when(F.col("event_id") % 3 == 1, " warn ").otherwise(" note ")
    raw = F.concat(F.col("event_id").cast("string"), word, F.col("event_type"), F.lit(" "), F.coalesce("props", F.lit("")))
    return table(spark, sf, "events").select("event_id", raw.alias("raw")).select("event_id", tx.short_sha1(F.col("raw")).alias("log_id"), tx.severity(F.col("raw")).alias("severity"), tx.is_anomaly(F.col("raw")).alias("is_anomaly"))


def tickets(spark, sf):
    """Conversations as tickets: the first user turn is the subject, users describe, assistants resolve."""
    c = table(spark, sf, "conversations")
    said = lambda role: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), " ")
    rows = c.groupBy("conv_id").agg(F.min_by(F.substring("text", 1, 60), "turn").alias("subject"), said("user").alias("description"), said("assistant").alias("resolution"))
    tags = F.split(F.concat(F.lit("chat;nan;p"), (F.col("conv_id") % 4).cast("string")), ";")
    return rows.select(
        F.col("conv_id").cast("string").alias("ticket_id"),
        F.lit("chat").alias("source_dataset"),
        "subject",
        "description",
        "resolution",
        tags.alias("tags"),
        F.element_at(F.array(*[F.lit(p) for p in [*tx.PRIORITIES, "unknown"]]), (F.col("conv_id") % 5 + 1).cast("int")).alias("priority"),
        F.lit("request").alias("ticket_type"),
        F.lit("desk").alias("queue"),
        F.lit("").alias("business_type"),
        F.lit("open").alias("status"),
    )


def logs(spark, sf):
    """Events as log lines; every eleventh has no message of its own, every thirteenth nothing at all."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    word = F.when(i % 3 == 0, " ERROR ").when(i % 3 == 1, " warn ").otherwise(" note ")
    raw = F.when(i % 13 == 0, " ").otherwise(F.concat(i.cast("string"), word, F.col("event_type")))
    return e.select(
        i.cast("string").alias("log_id"), F.lit("ev").alias("source_dataset"), F.lit("web").alias("system"), tx.severity(raw).alias("severity"), F.when(i % 5 == 0, "ui").otherwise("").alias("component"), F.when(i % 11 == 0, "").otherwise(F.concat(raw, F.lit(" <b>x</b>"))).alias("message"), raw.alias("raw_log")
    )


_TICKETS = f"""
t AS (SELECT conv_id, arg_min(substr(text, 1, 60), turn) AS subject, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'user'), '') AS description,
             coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS resolution,
             ['low', 'medium', 'high', 'critical', 'unknown'][any_value(conv_id % 5 + 1)] AS priority, 'chat, p' || any_value(conv_id % 4) AS tags
      FROM conversations GROUP BY conv_id),
d AS (SELECT 'ticket_chat_' || conv_id AS doc_id, subject AS title, priority,
             {clean_sql("'Subject: ' || subject || chr(10) || 'Description: ' || description || chr(10) || 'Resolution: ' || resolution || chr(10) || 'Tags: ' || tags")} AS content,
             {clean_sql("concat_ws(' ', CASE WHEN subject <> '' THEN 'ticket subject: ' || subject END, CASE WHEN description <> '' THEN 'issue description: ' || description END, CASE WHEN resolution <> '' THEN 'known resolution: ' || resolution END, CASE WHEN priority <> 'unknown' THEN 'priority: ' || priority END, 'ticket type: request', 'support queue: desk', 'tags: ' || tags)")} AS embedding_text
      FROM t)"""


@query(f"WITH {_TICKETS} SELECT doc_id, title, md5(content) AS content_md5, md5(embedding_text) AS embedding_md5 FROM d")
def ticket_documents(spark, sf):
    """FN-02, FN-08."""
    d = dc.ticket_documents(tickets(spark, sf))
    return d.select("doc_id", "title", F.md5("content").alias("content_md5"), F.md5("embedding_text").alias("embedding_md5"))


_LABELLED = r"""
s AS (SELECT *, string_split(regexp_replace(content, '\b(Subject|Description|Resolution|Tags):', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p FROM d),
f AS (SELECT doc_id, title, priority, k, lower(p[2 * k]) AS field, """ + clean_sql("p[2 * k + 1]") + r""" AS text FROM (SELECT *, unnest(range(1, (len(p) - 1) // 2 + 1)) AS k FROM s)),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM f WHERE text <> '')"""


@query(f"WITH {_TICKETS}, {_LABELLED} SELECT doc_id || '__chunk_' || lpad(i::VARCHAR, 2, '0') || '_' || field AS doc_id, doc_id AS parent_doc_id, trim(title || ' [' || field || ']') AS title, md5(field || ': ' || text) AS content_md5, field AS chunk_field, i::BIGINT AS chunk_index FROM c")
def field_chunks(spark, sf):
    """CHK-01."""
    from ..operators.chunking import field_chunks as chunks

    return chunks(dc.ticket_documents(tickets(spark, sf))).select("doc_id", "parent_doc_id", "title", F.md5("content").alias("content_md5"), "chunk_field", "chunk_index")


_CONTEXT = clean_sql("concat_ws(' ', CASE WHEN title <> '' THEN 'title: ' || title END, 'priority: ' || priority, 'ticket type: request', 'queue: desk', 'status: open')")
_SAID = clean_sql(f"'Ticket context: ' || ({_CONTEXT}) || ' Current field: ' || field || '. Field text: ' || text")


@query(f"WITH {_TICKETS}, {_LABELLED} SELECT doc_id || '__ctx_' || lpad(i::VARCHAR, 2, '0') || '_' || field AS doc_id, doc_id AS parent_doc_id, md5({_SAID}) AS content_md5, i::BIGINT AS chunk_index FROM c")
def contextual_chunks(spark, sf):
    """CHK-02."""
    from ..operators.chunking import contextual_chunks as chunks

    return chunks(dc.ticket_documents(tickets(spark, sf))).select("doc_id", "parent_doc_id", F.md5("content").alias("content_md5"), "chunk_index")


@query(
    r"""
WITH n AS (SELECT lang, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n FROM documents),
g AS (SELECT lang, list_sort(list(n)) AS l, count(*) AS c FROM n GROUP BY lang)
SELECT lang AS unit, c AS rows, l[1]::BIGINT AS min, round(list_avg(l), 3)::DOUBLE AS mean, l[c]::BIGINT AS max, len(list_filter(l, lambda x: x > 512))::BIGINT AS over,
       round(len(list_filter(l, lambda x: x > 512)) / c, 6)::DOUBLE AS over_ratio, l[c // 2 + 1]::BIGINT AS p50, l[floor((c - 1) * 0.95)::BIGINT + 1]::BIGINT AS p95 FROM g"""
)
def token_stats(spark, sf):
    """FN-13, AGG-13: percentiles are picked by index."""
    from ..operators.builders import length_audit

    return length_audit(table(spark, sf, "documents").select(F.col("lang").alias("unit"), "text"))


_NOISE = {k: v for k, v in noise.PATTERNS.items()}
_COUNT = "len(regexp_extract_all(coalesce(text, ''), '{}'))::BIGINT"


def _re2(p: str) -> str:
    return p.replace("'", "''")


@query(
    "WITH n AS (SELECT doc_id, text, " + ", ".join(f"{_COUNT.format(_re2(p))} AS {k}" for k, p in _NOISE.items()) + r"""
FROM documents),
s AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM n)
SELECT doc_id, """ + ", ".join(_NOISE) + ", round((" + " + ".join(_NOISE) + r""") / greatest(words, 1), 6) AS noise_score,
round(CASE WHEN len(l) = 0 THEN 0.0 ELSE len(list_filter(l, lambda x: length(x) >= 30 AND NOT regexp_matches(x, '[.!?]$'))) / len(l) END, 6)::DOUBLE AS break_ratio FROM s"""
)
def noise_profile(spark, sf):
    """FN-17..19."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", *[c.alias(k) for k, c in noise.counts(t).items()], noise.score(t).alias("noise_score"), F.round(noise.break_ratio(t), 6).alias("break_ratio"))


@query("SELECT sum(url)::BIGINT AS url, sum(provider)::BIGINT AS provider, sum(n)::BIGINT AS chars, round(avg(n), 6) AS mean_chars FROM (SELECT " + _COUNT.format(_re2(noise.URL)) + " AS url, " + _COUNT.format(_re2(noise.PROVIDER)) + " AS provider, length(text) AS n FROM documents)")
def noise_summary(spark, sf):
    """AGG-11."""
    c = noise.counts(F.col("text"))
    rows = table(spark, sf, "documents").select(c["url"].alias("url"), c["provider"].alias("provider"), F.length("text").alias("n"))
    return rows.agg(F.sum("url").alias("url"), F.sum("provider").alias("provider"), F.sum("n").cast("long").alias("chars"), F.round(F.avg("n"), 6).alias("mean_chars"))


_LINES = r"list_filter(list_transform(string_split(coalesce({0}, ''), chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query(f"SELECT line, count(*) AS pages FROM (SELECT doc_id, unnest(list_distinct({_LINES.format('text')})) AS line FROM documents) WHERE length(line) BETWEEN 5 AND 180 GROUP BY line HAVING count(*) >= 3")
def repeated_lines(spark, sf):
    """AGG-19."""
    return noise.repeated_lines(table(spark, sf, "documents"))


def _clean_query(profile: str) -> str:
    l = _LINES.format("text")
    x = "x"
    for p in (noise.URL, noise.DOI, noise.EMAIL, noise.HTML_TAG, noise.BRACKET_MARKER):
        x = f"regexp_replace({x}, '{_re2(p)}', ' ', 'g')"
    if profile == "embedding":
        for p in (r"\[[\d,\s-]{1,30}\]", r"\((?:19|20)\d{2}[a-z]?(?:[;,]\s*(?:19|20)\d{2}[a-z]?)*\)"):
            x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    strip = rf"regexp_replace(regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"
    drop = f"regexp_matches(x, '{_re2(noise.PAGE_NUMBER)}') OR regexp_matches(x, '{_re2(noise.PROVIDER)}')"
    head = "l"
    if profile != "light":
        drop += f" OR (regexp_matches(x, '{_re2(noise.TABLE_FIGURE)}') AND length(x) < 180)"
        at = f"list_position(list_transform(l, lambda x: regexp_matches(x, '{_re2(noise.REFERENCE_HEADING)}')), true)"
        head = f"CASE WHEN {at} > 0 THEN l[:{at} - 1] ELSE l END"
    end, sep = "y", "chr(10)"
    if profile == "embedding":
        drop += r" OR length(x) < 8 OR regexp_matches(x, '^\s*\[[\d,\s-]{1,30}\]') OR length(x) - length(replace(x, '|', '')) >= 3"
        end, sep = "CASE WHEN length(y) >= 30 AND NOT regexp_matches(y, '[.!?]$') THEN y || '.' ELSE y END", "' '"
    return f"WITH a AS (SELECT doc_id, {l} AS l FROM documents), b AS (SELECT doc_id, {head} AS l FROM a) SELECT doc_id, md5(array_to_string(list_filter(list_transform(list_transform(list_filter(l, lambda x: NOT ({drop})), lambda x: {strip}), lambda y: {end}), lambda z: z <> ''), {sep})) AS clean_md5 FROM b"


def _clean(profile):
    def run(spark, sf):
        return table(spark, sf, "documents").select("doc_id", F.md5(noise.clean(F.col("text"), profile)).alias("clean_md5"))

    run.__name__, run.__doc__ = f"clean_{profile}", "FN-20..24."
    return query(_clean_query(profile))(run)


for _p in noise.PROFILES:
    _clean(_p)


_KIND = (
    r"CASE WHEN x = '' THEN 'empty' WHEN regexp_matches(x, '^(?i:page\s*)?\d{1,4}$') THEN 'page_number' WHEN "
    + " OR ".join(f"regexp_matches(x, '{_re2(p)}')" for p in (noise.PROVIDER, noise.URL, noise.DOI))
    + " THEN 'provider_or_link' "
    + " ".join(f"WHEN {' OR '.join(f'contains(lower(x), {chr(39)}{n}{chr(39)})' for n in ns)} THEN '{k}'" for k, ns in ln.KEYWORDS)
    + f" WHEN {' OR '.join(f'contains(lower(x), {chr(39)}{n}{chr(39)})' for n in ln.META_HINTS)} THEN 'metadata_anchor'"
    + r" WHEN length(x) <= 80 AND (contains(x, '*') OR contains(x, '대학교') OR contains(x, '저자')) THEN 'author_affiliation' WHEN length(x) <= 120 AND regexp_matches(x, '^\d+(?:\.\d+)*\s+') THEN 'section_heading' ELSE 'body' END"
)
_KINDS = rf"SELECT doc_id, i, {_KIND} AS kind, length(x) AS n FROM (SELECT doc_id, i, regexp_replace(regexp_replace(l[i], '^\s+|\s+$', '', 'g'), '[ \t]{{2,}}', ' ', 'g') AS x FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))"


@query(f"SELECT doc_id, kind, count(*) AS lines, sum(n)::BIGINT AS chars FROM ({_KINDS}) GROUP BY doc_id, kind")
def case_types(spark, sf):
    """FN-25."""
    rows = table(spark, sf, "documents").select("doc_id", F.explode(tx.lines(F.col("text"))).alias("line"))
    return rows.select("doc_id", ln.case_type(F.col("line")).alias("kind"), F.length(ln.normalized(F.col("line"))).alias("n")).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("chars"))


@query(f"SELECT doc_id, (i - 1)::BIGINT AS raw_line_index, kind FROM ({_KINDS}) WHERE kind IN ({', '.join(repr(k) for k in ln.PRESERVED)}) ORDER BY doc_id, i LIMIT 500")
def preserved_inventory(spark, sf):
    """FN-25, TOP-12."""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("i", "line"))
    found = rows.select("doc_id", F.col("i").cast("long").alias("raw_line_index"), ln.case_type(F.col("line")).alias("kind")).where(F.col("kind").isin(*ln.PRESERVED))
    return found.orderBy("doc_id", "raw_line_index").limit(500)


@query(None)
def reconstructed(spark, sf):
    """FN-26, FN-27: the packed profile."""
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.array(ln.parsed(F.col("text")))).alias("rows"))
    r = ln.reconstruct(F.col("rows"), "packed")
    return rows.select("doc_id", F.md5(r["content"]).alias("content_md5"), r["embedding_text"].alias("embedding_text"), F.md5(r["display_text"]).alias("display_md5"), F.size(r["preserved_elements"]).cast("long").alias("preserved"), F.size(r["removed"]).cast("long").alias("removed"))


@query(r"SELECT doc_id, CASE WHEN length(text) < 20 THEN 0.0 ELSE round(1 - len(list_distinct(g)) / len(g), 6) END::DOUBLE AS dup_ratio FROM (SELECT doc_id, text, list_transform(range(1, greatest(length(text) - 18, 2)), lambda i: substr(text, i, 20)) AS g FROM documents)")
def dup_ngram_ratio(spark, sf):
    """AGG-20."""
    from ..operators.metrics import duplicate_ngrams

    return table(spark, sf, "documents").select("doc_id", F.round(duplicate_ngrams(F.col("text")), 6).alias("dup_ratio"))


# RE2's \b knows ASCII only, so the SQL spells the word boundaries out; an entity's last character decides which it needs
_EDGES = [r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"]
_SPELLED = {k: p.replace(r"\b", _EDGES[0], 1).replace(r"\b", _EDGES[1]) for k, p in tx.QUERY_PATTERNS.items()}
_SPELLED["entity"] = _EDGES[0] + r"([A-Z][A-Za-z0-9+.-]+([A-Za-z0-9]($|[^\p{L}\p{N}_])|[+.-][\p{L}\p{N}_])|[A-Za-z]+\d{2,4}($|[^\p{L}\p{N}_]))"
_FLAGS = {k: f"regexp_matches(text, '{p}')" for k, p in _SPELLED.items()}


@query(
    f"""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'log_pattern_severity' WHEN contains(text, 'Resolution:') OR {_FLAGS['resolution']} THEN 'resolution_action'
WHEN contains(text, 'Description:') OR {_FLAGS['symptom']} THEN 'issue_symptom' WHEN {_FLAGS['metadata']} THEN 'metadata_like' WHEN {_FLAGS['entity']} THEN 'exact_entity_product' ELSE 'general_semantic' END AS primary_type FROM conversations"""
)
def query_types(spark, sf):
    """FN-33."""
    source = F.when(F.col("role") == "system", "log").otherwise("ticket")
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.query_type(F.col("text"), source).alias("primary_type"))


@query("SELECT CASE WHEN n < 250 THEN '<250' WHEN n < 500 THEN '250-499' WHEN n < 1000 THEN '500-999' WHEN n < 2000 THEN '1000-1999' ELSE '>=2000' END AS bucket, count(*) AS texts, round(avg(coalesce(quality, 0)), 6) AS quality, median(n)::DOUBLE AS median_length FROM (SELECT doc_id, length(text) AS n FROM documents) LEFT JOIN labels USING (doc_id) GROUP BY bucket")
def summary_by_bucket(spark, sf):
    """FN-34, AGG-03."""
    rows = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n")).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy(tx.length_bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("texts"), F.round(F.avg(F.coalesce("quality", F.lit(0))), 6).alias("quality"), F.median("n").alias("median_length"))
