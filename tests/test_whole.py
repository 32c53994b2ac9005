"""Work that goes over whole inputs: what lies beyond an old cut counts."""

import duckdb

from quire.operators import spine
from quire.plans import catalog


def test_verse_anywhere(spark):
    prose = "<p>" + "word " * 20 + "end.</p>"
    broken = "one<br>two<br/>three."
    pages = [
        prose * 250 + f"<p>{broken}</p>" * 2,
        f"<div>{broken}</div><div class='a'>{broken}</div>",
        f"<div><div>{broken}</div>some more</div>",
        f"<div><p>{broken}</p></div>",
        f"<div>{broken}</div>" + prose * 40,
        f"<div>{broken}{'word ' * 400}</div>" * 2,
        "<p>plain</p><p CLASS=Stanza1>a.</p>",
        "<i>x</i>" * 500 + "<p class='verse'>a.</p>",
        prose * 199 + "<p>short</p>" * 6,
        "<p>short</p>" * 6,
        "<p class='x'>verse by the line</p>",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "'u' as url", "html")
    got = {r.doc_index: r for r in spine.classify(spine.probe(df, 100)).collect()}
    assert [got[k].poetry for k in range(len(pages))] == [True, True, True, True, False, False, True, False, False, True, False]
    assert [got[k].kind for k in (0, 1, 6)] == ["poetry"] * 3
    twin = duckdb.connect()
    twin.execute("create table pages (page_id bigint, url varchar, html varchar)")
    twin.executemany("insert into pages values (?, 'u', ?)", list(enumerate([*pages, None, "", "</div><br><br><DIV>a<br>b<BR/>c<div>d<br>e<br>f</DIV>"])))
    there = dict(twin.execute(f"select book * 10 + doc_index, poetry from {catalog.DUCK_PROBE}").fetchall())
    assert [there[k] for k in range(len(pages) + 3)] == [got[k].poetry for k in range(len(pages))] + [False, False, True]
    assert spine.div_breaks("</div><br><br><DIV>a<br>b<BR/>c<div>d<br>e<br>f</DIV>") == 2
    assert spine.div_breaks("<div>a<br>b<br>c") == 1 and spine.div_breaks("</div><br><br>") == 0


def test_title_key_of_whole_text(spark, tmp_path):
    opening = "The same long opening of words that two different texts share, "
    rows = [(1, "en", opening + "one"), (2, "en", opening + "two"), (3, "en", opening.upper() + "One!"), (4, "en", " ")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.q_title_key_dedup(spark, str(tmp_path)).collect()
    assert sorted((r.first_doc, r.n) for r in got) == [(1, 2), (2, 1)]


def test_whole_part_names(spark, tmp_path):
    rows = [(20, "a long name of one"), (40, "a long name of two")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    assert {r.ident for r in catalog.q_unique_ids(spark, str(tmp_path)).collect()} == {"a-long-name-of-one", "a-long-name-of-two"}
    assert {r.output for r in catalog.q_batch_names(spark, str(tmp_path)).collect()} == {"a-long-name-of-one.pdf", "a-long-name-of-two.pdf"}


def test_heading_list(spark, tmp_path):
    pages = [(0, "u", "<h1>One</h1><p>x</p><H2 class='a'>Two &amp; <i>more</i></H2><h3> </h3>"), (1, "u", None), (2, "u", "<h4>x</h4>" * 50)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.doc_index: r.headings for r in catalog.QUERIES["q_heading_list"](spark, str(tmp_path)).collect()}
    assert got == {0: "H1: One | H2: Two & more", 1: "", 2: " | ".join(["H4: x"] * 50)}
