"""Noise counters and cleaning profiles (FN-17..24, AGG-11, AGG-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank, clean_lines, lines

# Noise patterns.
URL = r"(?i)https?://\S+|www\.\S+"
DOI = r"(?i)\bdoi\s*:?\s*10\.\d{4,9}/\S+|10\.\d{4,9}/\S+"
EMAIL = r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
HTML_TAG = r"</?[A-Za-z][^>]{0,80}>"
BRACKET_MARKER = r"(?i)\[(?:provider|download|table|figure|fig\.?|표|그림)[^\]]*\]"
TABLE_FIGURE = r"(?im)^\s*(table|figure|fig\.?|표|그림)\s*[\dIVXivx.-]*\s*[:.]?"
REFERENCE_HEADING = r"(?im)^\s*(references|bibliography|참고문헌|인용문헌)\s*$"
PAGE_NUMBER = r"(?im)^\s*(?:page\s*)?\d{1,4}\s*$"
PROVIDER = r"(?i)earticle\.net|download by ip|\[provider:|provider"
PATTERNS = {
    "url": URL,
    "doi": DOI,
    "email": EMAIL,
    "html_tag": HTML_TAG,
    "bracket_marker": BRACKET_MARKER,
    "table_figure": TABLE_FIGURE,
    "reference_heading": REFERENCE_HEADING,
    "page_number": PAGE_NUMBER,
    "provider": PROVIDER,
}
PROFILES = ("light", "structural", "embedding")


def counts(text: Column) -> dict[str, Column]:
    """FN-17: occurrences of each noise pattern."""
    return {name: F.regexp_count(blank(text), F.lit(p)).cast("long") for name, p in PATTERNS.items()}


def score(text: Column) -> Column:
    """FN-18: noise per white-space token, 6 digits."""
    words = F.size(F.filter(F.split(blank(text), r"\s+"), lambda x: x != ""))
    total = sum(counts(text).values(), F.lit(0))
    return F.when(blank(text) == "", 0.0).otherwise(F.round(total / F.greatest(words, F.lit(1)), 6))


def break_ratio(text: Column) -> Column:
    """FN-19: share of the non-empty lines that are long and do not end a sentence."""
    full = F.filter(F.transform(lines(text), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    open_ = F.filter(full, lambda x: (F.length(x) >= 30) & ~x.rlike(r"[.!?]$"))
    return F.when(F.size(full) == 0, 0.0).otherwise(F.size(open_) / F.size(full))


def strip_inline(line: Column, citations: bool) -> Column:
    """FN-21: links, addresses, tags and markers become spaces."""
    # The patterns of citations.
    for pattern in (URL, DOI, EMAIL, HTML_TAG, BRACKET_MARKER):
        line = F.regexp_replace(line, pattern, " ")
    if citations:
        line = F.regexp_replace(line, r"\[[\d,\s-]{1,30}\]", " ")
        line = F.regexp_replace(line, r"\((?:19|20)\d{2}[a-z]?(?:[;,]\s*(?:19|20)\d{2}[a-z]?)*\)", " ")
    return F.regexp_replace(F.regexp_replace(line, r"[ \t]{2,}", " "), r"^\s+|\s+$", "")


def dropped(line: Column, profile: str, repeated: Column | None = None) -> Column:
    """FN-22: whether a normalised, non-empty line goes under a profile."""
    out = line.rlike(PAGE_NUMBER) | line.rlike(PROVIDER)
    if profile != "light":
        if repeated is not None:
            out = out | F.array_contains(repeated, line)
        out = out | (line.rlike(TABLE_FIGURE) & (F.length(line) < 180))
    if profile == "embedding":
        out = out | (F.length(line) < 8) | line.rlike(r"^\s*\[[\d,\s-]{1,30}\]") | (F.regexp_count(line, F.lit(r"\|")) >= 3)
    return out


def clean(text: Column, profile: str, repeated: Column | None = None, section: Column | None = None) -> Column:
    """FN-23: cleaned text. Under the stricter profiles nothing after a references heading stays."""
    found = clean_lines(lines(text))
    if profile != "light":
        heads = F.transform(found, lambda x: x.rlike(REFERENCE_HEADING))
        at = F.array_position(heads, F.lit(True)).cast("int")
        if section is not None:
            at = F.when(section == "references", 1).otherwise(at)
        found = F.when(at > 0, F.slice(found, F.lit(1), at - 1)).otherwise(found)
    kept = F.filter(found, lambda x: ~dropped(x, profile, repeated))
    cleaned = F.transform(kept, lambda x: strip_inline(x, profile == "embedding"))
    if profile == "embedding":
        cleaned = F.transform(cleaned, lambda x: F.when((F.length(x) >= 30) & ~x.rlike(r"[.!?]$"), F.concat(x, F.lit("."))).otherwise(x))
    cleaned = F.filter(cleaned, lambda x: x != "")
    return F.array_join(cleaned, " " if profile == "embedding" else "\n")


def clean_row(text: Column, profile: str, repeated: Column | None = None, section: Column | None = None) -> dict[str, Column]:
    """FN-24: content is never cleaned harder than ``structural``; the embedding text uses the profile."""
    return {"content": clean(text, "structural" if profile == "embedding" else profile, repeated, section), "embedding_text": clean(text, profile, repeated, section)}


def repeated_lines(pages: DataFrame, text_col: str = "text", least: int = 3) -> DataFrame:
    """AGG-19: ``line, pages``: lines of 5 to 180 characters on three pages or more, counted once a page."""
    found = pages.select(F.explode(F.array_distinct(clean_lines(lines(F.col(text_col))))).alias("line"))
    return found.where(F.length("line").between(5, 180)).groupBy("line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)
