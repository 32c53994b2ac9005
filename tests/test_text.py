import pytest
from pyspark.sql import functions as F

from quire.functions import patterns, text
from quire.operators import blocks


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


CASES = [
    (text.clean_text, "  a  b\n", "a b"),
    (text.clean_text, None, ""),
    (text.slugify, "Author's  Note!", "authors-note"),
    (text.slugify, "***", "section"),
    (text.title_key, "The Idiot [*] (A Novel)", "the idiot"),
    (text.title_key, "A Tale a play, a story_line", "a story line"),
    (text.word_count, "it's a well-known -- fact", 4),
    (text.author_name, "Tolstoy, Leo, graf", "Leo Tolstoy"),
    (text.author_name, "Sir Walter Scott", "Walter Scott"),
    (text.author_name, "", ""),
    (text.toc_title, "WAR AND PEACE [*]", "War And Peace"),
    (text.toc_title, "One--Two", "One - Two"),
    (text.file_title, "/x/my_great-book.epub", "my great book"),
    (text.html_escape, "<a&'\">", "&lt;a&amp;&#x27;&quot;&gt;"),
    (text.typography, "wait...  so--called", "wait… so—called"),
    (text.css_points, "1in", 72.0),
    (text.css_points, "x", None),
]


@pytest.mark.parametrize("f,value,expected", CASES, ids=lambda x: getattr(x, "__name__", repr(x))[:20])
def test_scalars(spark, f, value, expected):
    assert one(spark, f, value) == expected


def test_idempotent(spark):
    rows = [("  A  [**] b'c -- d",), ("ÉÀ ñ",), (None,), ("",)]
    df = spark.createDataFrame(rows, "x string")
    for f in (text.clean_text, text.slugify, text.title_key, text.display_title):
        r = df.select(f(F.col("x")).alias("a")).select("a", f(F.col("a")).alias("b")).collect()
        assert all(x.a == x.b for x in r)


def test_trim_and_budget(spark):
    s = one(spark, text.trim_size, "A5 landscape")
    assert (round(s.width, 2), round(s.height, 2), s.label) == (595.28, 419.53, "A5 landscape")
    assert one(spark, text.sample_budget, 50, "int") == 35000
    assert one(spark, text.sample_budget, 1, "int") == 6000
    assert one(spark, text.sample_budget, 0, "int") == 0


def test_patterns_and_packs(spark):
    r = patterns.Registry()
    assert r.apply({"backmatter_patterns": "afterword", "nonsense": ["x"]}) == ["backmatter_patterns"]
    assert r.apply({"backmatter_patterns": "afterword"}) == []
    df = spark.createDataFrame([("An afterword here",), ("Notes",), (None,)], "x string")
    assert [x.y for x in df.select(r.test(F.col("x"), "backmatter").alias("y")).collect()] == [True, True, False]
    assert [x.y for x in df.select(r.test(F.col("x"), "backmatter", "match").alias("y")).collect()] == [False, True, False]
    with pytest.raises(patterns.InvalidRule):
        r.apply({"promo_patterns": ["("]})


def test_line_predicates(spark):
    assert one(spark, blocks.authored_opener, "The Trial by Franz Kafka").author == "Franz Kafka"
    assert one(spark, blocks.authored_opener, "Works translated by Franz Kafka") is None
    assert one(spark, blocks.prose_or_dialogue, '"Go," said he') is True
    assert one(spark, blocks.short_caption, "The old mill") is True
    assert one(spark, blocks.supplemental_description, "The author left this unfinished fragment after his arrest and exile.") is True
    assert one(spark, blocks.reference_entry, "Essays, translated by T. Saunders, 1890") is True
    assert one(spark, blocks.author_note, "AUTHOR'S NOTE") is True
    assert one(spark, lambda c: blocks.report_issues(c, "visual_issue"), "Header: FAIL crowded\nAll fine, no issues\nNothing") == ["Header: FAIL crowded"]
