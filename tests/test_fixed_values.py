"""Scalar functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import blocks, feedback, openers
from quire.plans import paths, settings

CASES = {
    "author": (text.author_name, [("Tolstoy, Leo, graf", "Leo Tolstoy"), ("Sir Walter Scott", "Walter Scott"), ("  Jane   Austen ", "Jane Austen"), ("", ""), ("Byron, George, Lord, Baron", "George Byron"), ("Count", "Count"), ("Lady, Dame", "Lady"), ("Doyle, Arthur Conan, Esq", "Arthur Conan Esq Doyle")]),
    "typography": (text.typography, [("wait...  so--called", "wait… so—called"), ("a--b--c", "a—b—c"), ("end --  then", "end — then"), ("x y\tz", "x y z"), ("no change", "no change")]),
    "small caps": (text.small_caps, [("at 5 A.M. sharp", 'at 5 <span class="small-caps">A.M</span>. sharp'), ("in 44 BC, he", 'in 44 <span class="small-caps">BC</span>, he'), ("BCE", "BCE"), ("PS: nb. amid", '<span class="small-caps">PS</span>: <span class="small-caps">nb</span>. amid'), ("plain text", "plain text")]),
    "color": (lambda c: F.array(*(F.round(text.hex_color(c)[k], 6) for k in "rgb")), [("#222", [0.133333] * 3), ("#ff8000", [1.0, 0.501961, 0.0]), ("abc", [0.666667, 0.733333, 0.8]), ("#12", [0.0] * 3), ("#gggggg", [0.0] * 3), ("", [0.0] * 3)]),
    "dimension": (openers.image_dimension, [("120px", 120.0), (" 3.5em", 3.5), ("auto", None), (None, None), ("", None)]),
    "alt": (openers.clear_generic_alt, [("IMG_12.JPG", ""), ("A map of Rome", "A map of Rome"), (None, "")]),
    "stem": (paths.stem, [("a/b.c.pdf", "b.c"), ("plain", "plain"), (".hidden", ".hidden")]),
    "categories": (feedback.categories, [("the running head is crowded", ["header"]), ("ragged paragraph and a cropped portrait", ["body", "image"]), ("fine", []), (None, [])]),
}


@pytest.mark.parametrize("name", CASES)
def test_values(spark, name):
    function, rows = CASES[name]
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(rows)], "k int, x string")
    assert [r.y for r in df.select("k", function(F.col("x")).alias("y")).orderBy("k").collect()] == [y for _, y in rows]


def test_spills(spark):
    rows = [(0, ["« ", "T", "he"], ["« T", "he"]), (1, ["word", "s"], ["word", "s"]), (2, [], []), (3, None, None), (4, ["a", "—", "b", "(", "c"], ["a", "—", "b", "(c"]), (5, ["a—", " b "], ["a—b"])]
    df = spark.createDataFrame([r[:2] for r in rows], "k int, p array<string>")
    assert [r.y for r in df.select("k", openers.merge_letter_spills(F.col("p")).alias("y")).orderBy("k").collect()] == [r[2] for r in rows]


def test_bumps_and_pictures(spark):
    bumps = [(7.0, 2.0, 14.0, 9.0), (13.0, 2.0, 14.0, 14.0), (14.0, 2.0, 14.0, 14.0), (1.23, 0.025, 1.32, 1.255), (1.31, 0.025, 1.32, 1.32)]
    df = spark.createDataFrame(bumps, "old double, step double, most double, new double")
    assert all(abs(r.got - r.new) < 1e-9 for r in df.select("new", settings.bump(F.col("old"), F.col("step"), F.col("most")).alias("got")).collect())
    images = [("functional", "map1.png", "", "the map", None, None, True, None, None, True), ("functional", "x9.png", "", "a dog", None, None, False, None, None, False), ("keep-all", "cover.jpg", "", "", None, None, True, None, None, True), ("remove-all", "map.png", "", "map", None, None, False, None, None, False), ("functional", "img_12.jpg", "", "", 100.0, 50.0, True, True, 0.9, False), ("functional", "photo.jpg", "", "portrait of a man", None, None, False, True, 0.9, False), ("functional", "x9.png", "", "a dog", None, None, False, True, 0.9, True), ("functional", "x9.png", "", "a dog", None, None, False, True, 0.6, False)]
    df = spark.createDataFrame(images, "policy string, src string, alt string, context string, width double, height double, standalone boolean, decision boolean, confidence double, keep boolean")
    assert all(r.keep == r.got for r in df.select("keep", blocks.keep_image(*(F.col(n) for n in df.columns[:-1])).alias("got")).collect())
