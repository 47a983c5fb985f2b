"""Pinned facts of the scalar functions, cleaning and reconstruction."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gleanmill.functions import lines as ln
from gleanmill.functions import noise
from gleanmill.functions import text as tx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or ("",)], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint'}" for k, v in values.items()) or "x string")
    return df.select(column.alias("out")).collect()[0][0]


@pytest.mark.parametrize(
    "raw, want",
    [("<p>Hello&nbsp; world</p>\n\nagain", "Hello world again"), (None, ""), ("&lt;b&gt;x&lt;/b&gt;", "x"), ("a &amp;lt; b", "a &lt; b"), ("  ", "")],
)
def test_clean_text(spark, raw, want):
    assert one(spark, tx.clean_text(F.col("t")), t=raw) == want


def test_small_functions(spark):
    assert one(spark, tx.split_tags(F.col("t")), t="payment, api; timeout|db") == ["payment", "api", "timeout", "db"]
    assert one(spark, tx.normalize_choice(F.col("t"), ["in_progress"]), t=" In-Progress ") == "in_progress"
    assert one(spark, tx.normalize_choice(F.col("t"), ["open"]), t="other") == "unknown"
    assert one(spark, tx.severity(F.col("t")), t="12 FATAL disk") == "error"
    assert one(spark, tx.severity(F.col("t")), t="nothing") == "unknown"
    assert one(spark, tx.short_sha1(F.col("t")), t="é") == hashlib.sha1("é".encode()).hexdigest()[:16]
    assert one(spark, tx.is_anomaly(F.col("t")), t="1 x") is True and one(spark, tx.is_anomaly(F.col("t")), t="0 x") is None
    assert one(spark, tx.document_id(F.col("t")), t="x_OC2_12_AB-C_34_y") == "OC2_12_AB-C_34"
    assert one(spark, tx.for_matching(F.col("t")), t="A-b 가! é") == "ab가"
    assert one(spark, tx.token_count(F.col("t")), t="don't stop_it 가나, 3.5") == 9
    assert one(spark, tx.stable_doc_id(F.col("t")), t="__a b/c__" + "x" * 200) == "paper_" + ("a_b_c_" + "x" * 200)[:140]
    assert one(spark, tx.publication_year(F.col("t")), t="paper_2024_v1") == "2024" and one(spark, tx.publication_year(F.col("t")), t="v1") == ""
    assert one(spark, tx.question_key(F.col("t")), t="  What  IS\tthis? ") == "what is this?"
    assert one(spark, tx.lenient_timestamp(F.col("t")), t="2024-03-01 10:00:00").year == 2024 and one(spark, tx.lenient_timestamp(F.col("t")), t="soon") is None
    assert one(spark, tx.clip(F.col("t"), 8), t="abcdefghijk") == "abcde..." and one(spark, tx.clip(F.col("t"), 8), t="abc") == "abc"
    assert one(spark, tx.preferred(F.col("t"), F.lit("b")), t="  ") == "b"
    assert one(spark, tx.topic_words(F.col("t"), 3, ("this",)), t="This Deep deep Learning of NEURAL nets models") == ["Deep", "Learning", "NEURAL"]
    assert one(spark, tx.mojibake_score(F.col("t")), t="a?b?") == 0.5
    assert one(spark, tx.clean_evidence(F.col("t")), t="www.x.y\nkeep this\n\n[Provider:x]\nand this") == "keep this and this"


@pytest.mark.parametrize("heading, want", [("Abstract", "abstract"), ("1. Introduction", "introduction"), ("2. Methodology", "method"), ("References", "references"), ("Plain line", None), ("초록", "abstract")])
def test_section_types(spark, heading, want):
    assert one(spark, tx.section_type(F.col("t")), t=heading) == want


@pytest.mark.parametrize("overlap, negatives, want", [(0.1, 5, "adversarial"), (0.1, 1, "hard"), (0.5, 8, "hard"), (0.5, 1, "medium"), (0.6, 1, "easy")])
def test_difficulty(spark, overlap, negatives, want):
    assert one(spark, tx.difficulty(F.col("o"), F.col("n")), o=overlap, n=negatives) == want


def test_position_ratio(spark):
    assert one(spark, tx.position_ratio(F.col("p"), F.col("n")), p="3", n="4") == 0.75
    assert one(spark, tx.position_ratio(F.col("p"), F.col("n")), p="x", n="4") == 1.0


def test_evidence_segment(spark):
    long, longer = "a" * 100, "b" * 1000
    assert one(spark, tx.evidence_segment(F.col("t")), t=f"short\n{long}\n{longer}") == long
    assert one(spark, tx.evidence_segment(F.col("t")), t=longer) == "b" * 900
    assert one(spark, tx.evidence_segment(F.col("t")), t="short") == "short"


RAW = "Title line of the paper here\nhttps://x.y/z\nDownload by IP 1.2.3.4\n12\nTable 1: results\nA sentence with a citation [1,2] and (2020a; 2021) that is long enough\nshort\nReferences\n[1] A. Author"


def test_cleaning_profiles(spark):
    light = one(spark, noise.clean(F.col("t"), "light"), t=RAW)
    assert "https" not in light and "Download" not in light and "Table 1" in light and "References" in light and "\n12\n" not in light
    structural = one(spark, noise.clean(F.col("t"), "structural"), t=RAW)
    assert "Table 1" not in structural and "Author" not in structural and "short" in structural
    embedding = one(spark, noise.clean(F.col("t"), "embedding"), t=RAW)
    assert "[1,2]" not in embedding and "2020a" not in embedding and "short" not in embedding.split() and embedding.endswith(".")
    assert one(spark, noise.clean(F.col("t"), "structural", section=F.lit("references")), t=RAW) == ""
    assert one(spark, noise.clean(F.col("t"), "structural", F.array(F.lit("short"))), t=RAW).endswith("long enough")


def test_noise_scores(spark):
    assert one(spark, noise.score(F.col("t")), t="see www.a.b or x@y.com") == round(2 / 4, 6)
    assert one(spark, noise.score(F.col("t")), t="") == 0.0
    assert one(spark, noise.break_ratio(F.col("t")), t="x" * 30 + "\nshort\n" + "y" * 30 + ".") == pytest.approx(1 / 3)


def test_repeated_lines(spark):
    df = spark.createDataFrame([(i, f"Running head\nown {i}\nRunning head") for i in range(3)], "id int, text string")
    assert [tuple(r) for r in noise.repeated_lines(df).collect()] == [("Running head", 3)]


@pytest.mark.parametrize(
    "line, want",
    [("Table 2: Results", "table"), ("a stable system", "table"), ("Figure 1. A", "figure"), ("data source", "caption"), ("References", "reference"), ("x = y", "formula"), ("page 12", "page_number"), ("see www.x.y", "provider_or_link"), ("Keywords: a", "metadata_anchor"), ("저자 김", "author_affiliation"), ("2.1 Methods here", "section_heading"), ("A plain sentence", "body"), ("   ", "empty")],
)
def test_case_types(spark, line, want):
    assert one(spark, ln.case_type(F.col("t")), t=line) == want


def test_reconstruction(spark):
    text = "이것은 연구의 본문이며 계속\n다음 줄로 이어진다.\nTable 2: Results\n저자 김철수\nsee www.x.y\n7\nNew sentence starts here"
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(F.array(ln.parsed(F.col("t")))).alias("rows"))
    r = df.select(*[c.alias(k) for k, c in ln.reconstruct(F.col("rows"), "fielded").items()]).collect()[0]
    assert "이것은 연구의 본문이며 계속 다음 줄로 이어진다." in r.embedding_text.split("\n")
    assert "저자 김철수" not in r.embedding_text and "저자 김철수" in r.content
    assert "7" not in r.display_text.split("\n") and "www.x.y" in r.display_text and "www" not in r.content
    assert [e.kind for e in r.preserved_elements] == ["table", "author_affiliation"]
    assert sorted(r.removed) == ["page_number", "provider_or_link"] and len(r.alignment_map) == 5
    light = df.select(ln.reconstruct(F.col("rows"), "light")["embedding_text"].alias("t")).collect()[0].t
    assert "저자 김철수" in light and "계속\n다음" in light
