from quire.operators import preflight
from quire.plans import settings


def lines(spark, rows):
    return spark.createDataFrame(rows, "book long, page long, line_no long, text string, y double, size double, font string")


def test_openers_titles_and_bodies(spark):
    df = lines(spark, [
        (1, 1, 1, "The Sea", 300.0, 30.0, "Roman"), (1, 2, 1, "The Sea", 300.0, 22.0, "Roman"), (1, 3, 1, "Contents", 100.0, 19.0, "Roman"), (1, 3, 2, "One ..... 1", 140.0, 11.0, "Roman"),
        (1, 4, 1, "PART ONE", 300.0, 24.0, "Roman"), (1, 5, 1, "The Sea", 40.0, 9.4, "Roman"), (1, 5, 2, "It began on a long and windy morning of the early spring.", 100.0, 11.6, "Roman"), (1, 5, 3, "1", 780.0, 10.0, "Roman"),
        (1, 7, 1, "PART TWO", 300.0, 24.0, "Roman"), (1, 7, 2, "9", 780.0, 10.0, "Roman"),
    ])
    titles = spark.createDataFrame([(1, "The Sea")], "book long, title string")
    assert preflight.first_body(df).collect()[0].first_page == 5
    assert preflight.duplicate_title_pages(df, titles).first().detail == "1, 2"
    openers = {(r.page, r.detail) for r in preflight.opener_pages(df).collect()}
    assert {(4, "no blank page before"), (4, "no blank page after"), (7, "carries a page number")} <= openers
    assert [r.page for r in preflight.running_heads(df, 9.4).collect()] == [5]
    rules = preflight.runner_rules(df, preflight.first_body(df), settings.DEFAULTS, 595.276).collect()
    assert [(r.page, round(r.x0, 2), round(r.x1, 2), round(r.r, 3)) for r in rules] == [(5, 62.36, 532.91, 0.133)]
    assert preflight.runner_rules(df, preflight.first_body(df), settings.DEFAULTS | {"runner_layout": "x"}, 595.0) is None
    assert preflight.missing_leaders(df).count() == 0 and preflight.first_folio(df).count() == 0
    assert [r.page for r in preflight.contents_window(df).select("page").distinct().orderBy("page").collect()] == [3, 4, 5]


def test_styles_fonts_and_pages(spark):
    text = "The novel was first published in 1870 and deals with a family of sailors."
    df = lines(spark, [(1, 1, 1, text, 100.0, 10.6, "Garamond-Italic"), (1, 2, 1, text, 100.0, 11.6, "Garamond-Italic"), (1, 3, 1, text, 100.0, 10.6, "Garamond"), (1, 4, 1, text, 500.0, 12.0, "Garamond")])
    assert sorted(r.page for r in preflight.description_style(df, 11.6, -1.0).collect()) == [2, 3]
    fonts = df.select("book", "font")
    assert preflight.missing_font(fonts, "EB Garamond").count() == 1 and preflight.missing_font(fonts, "Gara mond").count() == 0
    pages = spark.createDataFrame([(1, 1, "", 2, 0), (1, 2, " ", 0, 0), (1, 3, "x", 1, 1)], "book long, page long, text string, drawings long, images long")
    assert [r.page for r in preflight.blank_artifacts(pages).collect()] == [1]
    grey = spark.createDataFrame([(1, 1, 10.0), (1, 1, 60.0), (1, 2, 200.0)], "book long, page long, grey double")
    assert [r.page for r in preflight.dark_pages(grey).collect()] == [1]


def test_stylesheet(spark):
    from quire.operators import stylesheet

    s = settings.DEFAULTS | {"title": 'A "B"', "justify_prose": False}
    out = stylesheet.css(s)
    assert "margin-top: 31.0mm" in out and "text-align: left" in out and 'content: "A \\"B\\""' in out
    assert ".work-description { font-style: italic; font-size: 10.6pt" in out
    assert stylesheet.rules(spark, s).count() == len(stylesheet.RULES)
