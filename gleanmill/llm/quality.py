"""Quality rules: per-document counts, and lines that too many documents of a host share. DataFrame functions only.

Base rules look at one text. The method's verdict compares documents: every distinct normalised line of a distinct text
is hashed and the distinct texts of a host that hold it are counted; lines in more texts than the limit are removed, and
a document left with too small a share of its words is rejected as depleted. A share of the host's texts can be given as
a second limit; by default the number decides alone, as a share spares more of a line's copies the larger a host is.
Exact copies count as one text, so copying a document does not make its lines boilerplate.

A null text has no words (and fails the base rules); a null host is a host of its own; null ids stay null; repeated
rows repeat their result; an empty table gives an empty result. Ties cannot arise. Only id, text and host are read, so
other names cannot clash (``clean_documents`` keeps all columns and adds none). Whole texts are used whatever their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

_SPACES = r"[ \t\n\x0B\f\r]+"
_SPACE_CHARS = " \t\n\x0b\f\r"
_SIGNS = "#*$%&|<>"
#: Up to so many frequent lines are sent to all executors, by host; beyond, each text gets its own by joins that shuffle.
BROADCAST_LINES = 5_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _SPACES, -1), lambda w: w != "")


def _without(text: Column, chars: str) -> Column:
    """Code points of ``text`` other than the given characters."""
    return F.length(F.translate(text, chars, "")).cast("long")


def _is_filled(line: Column) -> Column:
    return F.translate(line, _SPACE_CHARS, "") != ""


def _line_hash(line: Column) -> Column:
    """Lines are alike whatever their case and white space."""
    return F.xxhash64(F.trim(F.lower(F.regexp_replace(line, _SPACES, " "))))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where the optimiser moves or copies the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(windows: Column) -> Column:
    """Words covered by windows that occur twice or more; only such texts sort their windows, so that equals meet."""

    def covered(by_hash: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(by_hash, j)["h"] == x["h"], F.lit(False))
        found = F.filter(F.transform(by_hash, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])), lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2)))))

    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(by_hash, covered)).otherwise(F.lit(0))


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) to rows with a non-null ``text``."""
    text = F.col("text")

    def of_words(w: Column) -> Column:
        windows = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        repeated = F.when(F.size(w) > 3, _let(windows, _repeated_words)).otherwise(F.lit(0))
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated.cast("long").alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.size(x) - F.size(F.array_distinct(x))

    out = docs.withColumns(
        {
            "word_chars": _without(text, _SPACE_CHARS),
            "n_symbols": F.length(text).cast("long") - _without(text, _SIGNS),
            "n_dup_lines": _let(F.filter(F.split(text, "\n", -1), _is_filled), of_lines).cast("long"),
            "_of_words": _let(F.transform(words_of(text), lambda w: F.xxhash64(w)), of_words),
        }
    )
    return out.withColumns({c: F.col("_of_words")[c] for c in ("n_words", "n_repeat_words")}).drop("_of_words")


def _lines(rows: DataFrame) -> DataFrame:
    """``host, of, line``: the hashes of each row's text and of its distinct lines."""
    hashes = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), _is_filled), _line_hash))
    return rows.select("host", F.xxhash64("text").alias("of"), F.explode(hashes).alias("line"))


def common_lines(docs: DataFrame, min_texts: int, share: float) -> DataFrame:
    """``host, line``: hashes of lines that more than ``min_texts`` and more than ``share`` of a host's texts hold.

    Counting is combined before each shuffle, by (host, line, text) and then by (host, line), so a hot host or line is
    never gathered in one task.
    """
    counts = _lines(docs).groupBy("host", "line").agg(F.count_distinct("of").alias("n")).where(F.col("n") > min_texts)
    if share > 0:
        hosts = docs.groupBy("host").agg(F.count_distinct(F.xxhash64("text")).alias("texts"))
        counts = counts.join(hosts, "host").where(F.col("n") > F.lit(share) * F.col("texts"))
    return counts.select("host", "line")


def _with_hashes(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds ``hashes``: the frequent lines of the row's host or, where these are many, of its text only; null if none."""
    if hot.count() <= BROADCAST_LINES:
        return rows.join(F.broadcast(hot.groupBy("host").agg(F.collect_list("line").alias("hashes"))), "host", "left")
    own = _lines(rows).join(hot, ["host", "line"]).groupBy("host", "of").agg(F.collect_set("line").alias("hashes"))
    return rows.withColumn("of", F.xxhash64("text")).join(own, ["host", "of"], "left").drop("of")


def assess(
    docs: DataFrame,
    min_texts: int = 20,
    share: float = 0.0,
    min_left: float = 0.5,
    min_words: int = 50,
    max_repeat: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """All rows with ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    Also ``left_words`` and ``clean_text``: the words and the text without the lines above the limits. A document is kept
    if it passes the base rules and at least ``min_left`` of its words stay.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")
    )
    return _judge(rows, min_texts, share, min_left, min_words, max_repeat).drop("text", "host")


def _judge(rows: DataFrame, min_texts: int, share: float, min_left: float, min_words: int, max_repeat: float) -> DataFrame:
    counted = base_counts(_with_hashes(rows, runtime.cut(common_lines(rows, min_texts, share), "lines")))
    stays = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains("hashes", _line_hash(x)))
    clean = F.when(F.col("hashes").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    out = counted.withColumn("clean_text", clean).drop("hashes")
    out = out.withColumn("left_words", F.when(F.length("clean_text") == F.length("text"), F.col("n_words")).otherwise(F.size(words_of(F.col("clean_text"))).cast("long")))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.lit(max_repeat) * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("left_words") >= F.lit(min_left) * F.col("n_words")))


def clean_documents(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents that are kept, with their columns; lines above the limits are gone from ``text``, ``n_chars`` follows."""
    settings = {"min_texts": 20, "share": 0.0, "min_left": 0.5, "min_words": 50, "max_repeat": 0.5} | limits
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"))
    # the arrival number keeps the filter above the counts, which are then computed once
    judged = _judge(rows, **settings).withColumn("at", F.monotonically_increasing_id())
    kept = judged.where((F.col("at") >= 0) & F.col("kept"))
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])
