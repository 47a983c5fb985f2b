"""Scalar text functions as Column expressions (FN-01..16, FN-20, FN-28..44)."""

from __future__ import annotations

from functools import reduce
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enumerations of tickets and logs.
PRIORITIES = ["low", "medium", "high", "critical"]
TICKET_TYPES = ["incident", "request", "problem", "question"]
STATUSES = ["open", "closed", "resolved"]
SEVERITY_WORDS = r"(?i)\b(INFO|WARN|WARNING|ERROR|ERR|FATAL|ALERT)\b"
# Section headings in order of precedence.
SECTION_PATTERNS = [
    ("abstract", r"^(abstract|초록|요약)\b"),
    ("introduction", r"^(\d+\.?\s*)?(서론|introduction)\b"),
    ("related_work", r"^(\d+\.?\s*)?(관련\s*연구|related\s*work)\b"),
    ("method", r"^(\d+\.?\s*)?(방법|방법론|제안\s*방법|method|methodology|approach)\b"),
    ("experiment", r"^(\d+\.?\s*)?(실험|experiment|evaluation)\b"),
    ("result", r"^(\d+\.?\s*)?(결과|result|discussion)\b"),
    ("conclusion", r"^(\d+\.?\s*)?(결론|conclusion)\b"),
    ("references", r"^(참고문헌|references)\b"),
]
# Query classes.
QUERY_PATTERNS = {
    "metadata": r"(?i)\b(low|medium|high|critical|incident|request|problem|question)\b",
    "resolution": r"(?i)\b(resolution|resolve|resolved|fix|repair|assist|support)\b",
    "symptom": r"(?i)\b(issue|problem|error|failed|failure|crash|halted|timeout|loss|leakage|inaccuracies)\b",
    "entity": r"\b([A-Z][A-Za-z0-9+.-]{2,}(?:\s+[A-Z][A-Za-z0-9+.-]{2,}){0,3}|[A-Za-z]+\d{2,4})\b",
}
# Signs of broken text, and the patterns of tokens and words.
MOJIBAKE = ["�", "媛", "쒕", "뿉", "???"]
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORDS = r"[0-9A-Za-z가-힣]+"


def blank(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse(c: Column) -> Column:
    """FN-11: runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(blank(c), r"\s+", " "))


#: Names of HTML 4 with their characters; a no-break space is a space here.
_NAMES = {f"{name};": chr(code) if code != 160 else " " for name, code in name2codepoint.items()} | {"apos;": "'"}
#: Names that also stand without a semicolon.
_LOOSE = {name: c for name, c in ((n, html5[n]) for n in html5 if not n.endswith(";"))} | {"nbsp": " "}
_CHARACTER = r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};?)|[^&]+|&"


def _map(values: dict[str, str]) -> Column:
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in values.items())), F.lit("\x01"), F.lit("\x02"))


def unescape(c: Column) -> Column:
    """Character references as characters: names of HTML 4 (the old ones without a semicolon, too) and numbers.

    Only texts with an ampersand are looked at.
    """
    names, loose = _map(_NAMES), _map(_LOOSE)

    def number(x: Column) -> Column:
        digits = F.regexp_replace(x, "[^0-9A-Fa-f]", "")
        n = F.when(F.lower(F.substring(x, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        bad = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        return F.when(bad, "\ufffd").when(n == 160, " ").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def one(x: Column) -> Column:
        name = F.substring(x, 2, 40)
        prefixes = [F.concat(F.try_element_at(loose, F.substring(name, 1, n)), F.substring(name, n + 1, 40)) for n in range(6, 1, -1)]
        return F.when(~x.startswith("&") | (F.length(x) < 3), x).when(x.startswith("&#"), number(x)).otherwise(F.coalesce(F.try_element_at(names, name), *prefixes, x))

    text = blank(c)
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_CHARACTER), F.lit(0)), one), "")).otherwise(text)


def clean_text(c: Column) -> Column:
    """FN-01: unescape first, then drop tags, then collapse white space."""
    return collapse(F.regexp_replace(unescape(c), r"<[^>]+>", " "))


def split_tags(c: Column) -> Column:
    """FN-02: tags of a string separated by comma, semicolon or pipe."""
    return F.filter(F.transform(F.split(blank(c), r"[,;|]"), clean_text), lambda x: x != "")


def normalize_choice(c: Column, allowed: list[str]) -> Column:
    """FN-03: lower case with underscores if allowed, else ``unknown``."""
    x = F.translate(F.lower(clean_text(c)), "- ", "__")
    return F.when(x.isin(*allowed), x).otherwise("unknown")


def lenient_timestamp(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm")) -> Column:
    """FN-04: the first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def severity(raw: Column) -> Column:
    """FN-05: info, warning, error, alert or unknown by the first level word."""
    word = F.lower(F.regexp_extract(blank(raw), SEVERITY_WORDS, 1))
    return F.when(word == "", "unknown").when(word.isin("warn", "warning"), "warning").when(word.isin("err", "error", "fatal"), "error").otherwise(word)


def short_sha1(c: Column) -> Column:
    """FN-06: stable id."""
    return F.substring(F.sha1(blank(c)), 1, 16)


def short_sha256(c: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(blank(c), 256), 1, length)


def is_anomaly(raw: Column) -> Column:
    """FN-07: true or null, never false."""
    return F.when(raw.startswith("1 ") | raw.startswith("ALERT"), F.lit(True))


def document_id(stem: Column) -> Column:
    """FN-10."""
    found = F.regexp_extract(stem, r"OC2_\d+_[A-Z0-9-]+_\d+", 0)
    return F.when(found != "", found).otherwise(stem)


def for_matching(c: Column) -> Column:
    """FN-12: letters, digits and Hangul only, lower case."""
    return F.lower(F.regexp_replace(blank(c), "[^0-9A-Za-z가-힣]", ""))


def tokens(c: Column) -> Column:
    """FN-13: words and single signs."""
    return F.regexp_extract_all(blank(c), F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    return F.regexp_count(blank(c), F.lit(TOKEN)).cast("long")


def stable_doc_id(c: Column) -> Column:
    """FN-14."""
    x = F.regexp_replace(blank(c), "[^0-9A-Za-z가-힣]+", "_")
    return F.concat(F.lit("paper_"), F.substring(F.regexp_replace(x, "^_+|_+$", ""), 1, 140))


def publication_year(c: Column) -> Column:
    """FN-15: the first year of 19xx or 20xx as a string, else empty."""
    return F.regexp_extract(blank(c), r"((19|20)\d{2})", 1)


def section_type(line: Column) -> Column:
    """FN-16: type of a heading line, null for other lines."""
    x = F.trim(blank(line))
    return F.coalesce(*[F.when(x.rlike("(?iU)" + p), F.lit(t)) for t, p in SECTION_PATTERNS])


def lines(c: Column) -> Column:
    return F.split(blank(c), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]", -1)


def normalize_spaces(c: Column) -> Column:
    """FN-20: per line collapse blanks and tabs and trim; blank lines go."""
    return F.array_join(clean_lines(lines(c)), "\n")


def clean_lines(array: Column) -> Column:
    one = lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]{2,}", " "), r"^\s+|\s+$", "")
    return F.filter(F.transform(array, one), lambda x: x != "")


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(blank(c)), F.lit(WORDS), F.lit(0)))


def overlap_office(question: Column, evidence: Column) -> Column:
    """FN-28: share of the question's words that the evidence has."""
    q = word_set(question)
    return F.size(F.array_intersect(q, word_set(evidence))) / F.greatest(F.size(q), F.lit(1))


def overlap_spaces(question: Column, evidence: Column) -> Column:
    """FN-29: the same over white-space words of two characters or more, case kept."""
    words = lambda c: F.array_distinct(F.filter(F.split(blank(c), r"\s+"), lambda x: F.length(x) > 1))
    q, e = words(question), words(evidence)
    return F.when((F.size(q) == 0) | (F.size(e) == 0), 0.0).otherwise(F.size(F.array_intersect(q, e)) / F.size(q))


def topic_words(c: Column, n: int = 6, stopwords: tuple[str, ...] = ()) -> Column:
    """FN-30: the first n words of four characters or more, distinct whatever their case, in their first casing."""
    found = F.regexp_extract_all(blank(c), F.lit(r"[\p{L}\p{N}_-]{4,}"), F.lit(0))
    low = lambda x: F.lower(x)
    kept = F.filter(found, lambda x: ~low(x).isin(*stopwords)) if stopwords else found
    first = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((F.size(acc) >= n) | F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return first


def clean_evidence(c: Column, limit: int = 800) -> Column:
    """FN-31: without blank, link and download lines, joined, cut."""
    stays = F.filter(clean_lines(lines(c)), lambda x: ~F.lower(x).rlike(r"^(www\.|http|\[provider:|download by ip)"))
    return F.substring(F.array_join(stays, " "), 1, limit)


def difficulty(overlap: Column, negatives: Column) -> Column:
    """FN-32."""
    return F.when((overlap < 0.2) & (negatives >= 5), "adversarial").when((overlap < 0.35) | (negatives >= 8), "hard").when(overlap < 0.55, "medium").otherwise("easy")


def query_flags(text: Column) -> dict[str, Column]:
    """FN-33: the four flags."""
    t = blank(text)
    return {
        "has_metadata_terms": t.rlike(QUERY_PATTERNS["metadata"]),
        "has_resolution_terms": t.contains("Resolution:") | t.rlike(QUERY_PATTERNS["resolution"]),
        "has_symptom_terms": t.contains("Description:") | t.rlike(QUERY_PATTERNS["symptom"]),
        "has_entity_terms": t.rlike(QUERY_PATTERNS["entity"]),
    }


def query_type(text: Column, source_type: Column) -> Column:
    """FN-33: the first class that holds."""
    f = query_flags(text)
    return (
        F.when(source_type == "log", "log_pattern_severity")
        .when(f["has_resolution_terms"], "resolution_action")
        .when(f["has_symptom_terms"], "issue_symptom")
        .when(f["has_metadata_terms"], "metadata_like")
        .when(f["has_entity_terms"], "exact_entity_product")
        .otherwise("general_semantic")
    )


def length_bucket(n: Column) -> Column:
    """FN-34."""
    return F.when(n < 250, "<250").when(n < 500, "250-499").when(n < 1000, "500-999").when(n < 2000, "1000-1999").otherwise(">=2000")


def evidence_segment(page: Column) -> Column:
    """FN-35: the longest segment of 80 to 900 characters, else the start of the longest, else of the page."""
    parts = F.filter(F.transform(F.split(blank(page), r"\n+|\[#\]"), collapse), lambda x: F.length(x) >= 80)
    ranked = lambda xs: F.array_max(F.transform(xs, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
    fits = F.filter(parts, lambda x: F.length(x) <= 900)
    return F.when(F.size(fits) > 0, ranked(fits)).when(F.size(parts) > 0, F.substring(ranked(parts), 1, 900)).otherwise(F.substring(collapse(page), 1, 900))


def question_key(c: Column) -> Column:
    """FN-37."""
    return F.lower(collapse(c))


def mojibake_score(c: Column) -> Column:
    """FN-38: share of suspicious strings and question marks."""
    t = blank(c)
    hits = reduce(lambda a, b: a + b, [F.regexp_count(t, F.lit("\\Q" + s + "\\E")) for s in [*MOJIBAKE, "?"]])
    return F.when(F.length(t) == 0, 0.0).otherwise(F.least(hits / F.length(t), F.lit(1.0)))


def page_overlap(gold_pages: Column, start: Column, end: Column) -> Column:
    """FN-39: no gold pages, or one within the interval."""
    return (F.size(gold_pages) == 0) | F.exists(gold_pages, lambda p: (p >= start) & (p <= end))


def clip(c: Column, n: int) -> Column:
    """FN-42."""
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 3)), F.lit("..."))).otherwise(c)


def preferred(*columns: Column) -> Column:
    """FN-43: the first column that is not blank, else empty."""
    return F.coalesce(*[F.when(F.trim(blank(c)) != "", c) for c in columns], F.lit(""))


def position_ratio(page_start: Column, page_count: Column) -> Column:
    """FN-44: clamped to 0..1; 1 where a number is missing."""
    ratio = page_start.try_cast("double") / F.greatest(page_count.try_cast("double"), F.lit(1.0))
    return F.when(ratio.isNull(), 1.0).otherwise(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)))
