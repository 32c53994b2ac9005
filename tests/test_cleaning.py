from quire.operators import cleaning, compose
from quire.plans import build
from quire.sources import html

PAGE = """<html><head><title>t</title><style>x</style></head><body><h1>The Sea</h1>
<h2>Contents</h2><ul><li><a href='#a'>Chapter 1</a></li><li><a href='#b'>Chapter 2</a></li></ul>
<p>Chapter 1</p><p>It was a long and quiet morning by the sea, and nobody in the village had yet gone out.</p>
<p class='poem'>Roses are red,<br>violets are blue,<br>and so are you</p>
<p>[1] A note.</p><p>[2] Another note...</p><p>[Exit all.]</p>
<p>Please subscribe to our newsletter</p><p></p><h3>Dramatis Personae</h3><p>JOHN, a sailor</p><p>a crowd of people</p>
<pre>one line
two line</pre><img src='x9.png'></body></html>"""


def rows_of(df):
    return {r.text.split("\n")[0]: r for r in df.collect()}


def test_parse():
    rows = html.parse("<div>a<p>b <b>c</b><p>d<br>e</div><ul><li>x<li>y</ul><script>no</script>tail")
    assert [(r["tag"], r["text"]) for r in rows] == [("div", "a"), ("p", "b c"), ("p", "d\ne"), ("li", "x"), ("li", "y"), ("body", "tail")]
    assert html.parse(None) == html.parse("") == []


def test_chain(spark):
    docs = spark.createDataFrame([(1, 0, PAGE), (1, 1, None)], "book long, doc_index long, html string")
    rows, audit = cleaning.clean(html.blocks(docs))
    got = rows_of(rows)
    reasons = {r["sample"]: r.reason for r in audit.collect()}
    assert reasons["Please subscribe to our newsletter"] == "Removed promotional line"
    assert reasons["Contents"] == reasons["Chapter 2"] == "Removed local mini-contents"
    assert got["Chapter 1"].tag == "h2" and "subdivision" in got["Chapter 1"].classes
    assert "verse-block" in got["Roses are red,"].classes and "pre-verse-block" in got["one line"].classes
    assert got["A note."].ident == "fn-1" and got["Another note…"].classes == "footnote"
    assert got["[Exit all.]"].classes == "stage-direction"
    assert got["JOHN, a sailor"].classes == "cast-list cast-entry" and got["a crowd of people"].classes == "cast-list"


def test_images(spark):
    docs = spark.createDataFrame([(1, 0, "<p>See the map below</p><p><img src='map1.png'></p><p>A dog runs home through the rain and finds nobody there to let him in at all.</p><p><img src='x9.png'></p>")], "book long, doc_index long, html string")
    sources = spark.createDataFrame([(1, "text/map1.png", "assets/map1.png"), (1, "text/x9.png", "assets/x9.png")], "book long, path string, asset string")
    names = spark.createDataFrame([(1, 0, "text/a.html")], "book long, doc_index long, name string")
    blocks = html.blocks(docs).selectExpr("*", "cast(null as string) as removed")
    out = {r.block_no: r for r in cleaning.images(blocks, sources, names).collect()}
    assert out[1].src == "assets/map1.png" and out[1].removed is None
    assert out[3].removed == "Removed image"


def test_build(spark):
    body = "A quiet morning on the shore, when nobody in the village had yet gone out to the boats or the fields."
    pages = spark.createDataFrame([(k, f"u{k}", f"<h1>Work {'ABCDEFGH'[k]}</h1><p>{body}</p><h2>Chapter {k}</h2><p>{body}</p>") for k in range(4)] + [(4, "u4", "<h1>Contents</h1><p>x</p>")], "page_id long, url string, html string")
    out = build.build(pages)
    book = out["books"].first().html
    assert book.count("<section class=\"epub-doc doc-major_work starts-major-work\"") == 4
    assert 'class="toc-level-1 toc-kind-work"><a href="#work-a">Work A</a>' in book and "Contents</h1><p>x" not in book
    assert '<span class="drop-cap">A</span> quiet' in book, book
    assert book.count("true-blank") == 8, book


def test_build_follows_settings(spark):
    body = "A quiet morning... on the shore, when at 6 A.M. nobody in the village had yet gone out to the boats or the fields."
    pages = spark.createDataFrame([(k, f"u{k}", f"<h1>Work {'ABCDEFGH'[k]}</h1><p>{body}</p><h2>Chapter {k}</h2><p>{body}</p>") for k in range(3)], "page_id long, url string, html string")
    book = lambda **values: build.build(pages, values=values)["books"].first().html
    plain = book()
    assert "Book 0</h1></section>" in plain and "toc-hierarchical" in plain and "half-title-page" not in plain and "back-toc-page" not in plain and "source-page" not in plain
    assert "morning…" in plain and '<span class="drop-cap">' in plain and "small-caps" in plain
    other = book(title="Sea & Land", smart_punctuation=False, drop_caps=False, small_caps=False, toc_mode="simple", back_toc_mode="hierarchical", include_half_title_page=True, title_page_subtitle="a <book>", include_source_note=True, source_note_text="From a scan.")
    assert "morning..." in other and "drop-cap" not in other and "small-caps" not in other
    assert '<section class="frontmatter half-title-page"><h1>Sea &amp; Land</h1></section>' in other and '<div class="subtitle">a &lt;book&gt;</div></section>' in other
    assert '<p class="no-indent">From a scan.</p>' in other
    first, second = other.index('class="toc-list toc-simple'), other.index('class="toc-list toc-hierarchical')
    assert first < other.index("<main") < second < other.index("</main>")
    none = spark.createDataFrame([], "book long, seq long, html string")
    bare = compose.compose(none, spark.createDataFrame([(0, "T")], "book long, title string"), none, {"include_title_page": False}).first().html
    assert "title-page" not in bare and "<title>T</title>" in bare and "Contents" not in bare
