import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import blocks, headings, identity, quality, spine, toc
from quire.plans import dag, jobs, settings
from quire.plans.plugins import Plugins
from quire.sources import decisions, epub, rules


def test_kind_ladder(spark):
    pad = "word " * 90
    rows = [
        (0, "a", f"<h1>Preface</h1><p>subscribe {pad}</p>"),
        (1, "b", "<h1>Contents</h1><p>" + "line " * 600 + "</p>"),
        (2, "c", f"<h1>The Sea</h1><p>{pad}</p>"),
        (3, "d", None),
        (4, "e", "<h1>Dramatis Personae</h1><p>kindle</p>"),
        (5, "f", f"<h2>x</h2><p>Delphi Classics newsletter {pad}</p>"),
    ]
    out = {r.doc_index: r for r in spine.classify(spine.probe(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert (out[0].kind, out[0].remove) == ("frontmatter", True)
    assert (out[1].kind, out[1].remove, out[1].confidence) == ("local_toc", True, 0.9)
    assert (out[2].kind, out[2].remove, out[2].major_title) == ("major_work", False, "The Sea")
    assert out[3].kind == "chapter"
    assert (out[4].kind, out[4].remove) == ("play", False)
    assert (out[5].kind, out[5].rule) == ("promo", "publisher")


def _orphans(docs):
    seen = after = False
    out = []
    for d in docs:
        kind, remove = d["kind"], d["remove"]
        if not remove and kind == "major_work":
            seen, after = True, False
        elif not seen and after and d["doc_index"] <= 25 and d["images"] and not d["n_headings"] and d["n_chars"] < 350:
            kind, remove = "promo", True
        else:
            after = remove and d["rule"] == "gallery"
        out.append((kind, remove))
    return out


def test_windows_equal_folds(spark):
    rng = random.Random(4)
    rows = []
    for book in range(120):
        for i in range(rng.randint(1, 12)):
            remove = rng.random() < 0.4
            rows.append({"book": book, "doc_index": i, "kind": rng.choice(["frontmatter", "major_work", "chapter", "promo", "play"]), "remove": remove, "rule": "gallery" if remove and rng.random() < 0.7 else None, "n_chars": rng.choice([10, 400]), "n_headings": rng.choice([0, 0, 1]), "images": rng.choice([0, 1, 1])})
    df = spark.createDataFrame(rows, "book long, doc_index long, kind string, remove boolean, rule string, n_chars long, n_headings long, images long")
    got = {(r.book, r.doc_index): (r.kind, r.remove) for r in spine.drop_orphan_media(df).collect()}
    late = {(r.book, r.doc_index): r.kind for r in spine.demote_late_frontmatter(df).collect()}
    for book in range(120):
        docs = [r for r in rows if r["book"] == book]
        for d, expected in zip(docs, _orphans(docs), strict=True):
            assert got[book, d["doc_index"]] == expected
        seen = False
        for d in docs:
            if not d["remove"] and d["kind"] in ("major_work", "play"):
                seen = True
            demoted = seen and not d["remove"] and d["kind"] == "frontmatter"
            assert late[book, d["doc_index"]] == ("chapter" if demoted else d["kind"])


def test_unique_ids(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "a 2"), (2, 0, "a")], "book long, seq long, title string")
    assert [r.ident for r in identity.unique_ids(rows).orderBy("book", "seq").collect()] == ["a", "a-2", "a-2-2", "a"]


def test_batch_names(spark):
    rows = spark.createDataFrame([("b/x", "X"), ("a/x", "x"), ("c/y", "y")], "path string, stem string")
    assert {r.path: r.output for r in identity.batch_names(rows).collect()} == {"a/x": "x.pdf", "b/x": "x-2.pdf", "c/y": "y.pdf"}


def test_verse_and_notes(spark):
    lines = ["Roses are red,", "violets blue,", "sugar is sweet", "and so on", "", "one more", "[1] first note", "[2] second note", "A long sentence that ends here."]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "book long, line_no long, text string")
    runs = blocks.verse_runs(df.where("line_no < 6")).collect()
    assert [(r.first_line, r.n) for r in runs] == [(0, 4)]
    notes = blocks.footnote_clusters(df).orderBy("number").collect()
    assert [(r.note_id, r.note) for r in notes] == [("fn-1", "first note"), ("fn-2", "second note")]


def test_usable_toc_and_pages(spark):
    entries = spark.createDataFrame([(1, 0, 1, "One", "a", "work", 0), (1, 1, 1, "ONE", "b", "work", 0), (1, 2, 2, "Two", "c", "work", 0), (2, 0, 1, "One", "a", "work", 0), (2, 1, 1, "one", "b", "work", 0)], "book long, seq long, level long, title string, target_id string, kind string, source_level long")
    assert [(r.book, r.target_id) for r in toc.usable(entries).orderBy("seq").collect()] == [(1, "a"), (1, "c")]
    assert toc.usable(entries, simple=True).count() == 0
    assert "toc-level-2" in toc.markup(toc.usable(entries)).first().html


def test_heading_fold(spark):
    base = {"doc_index": 0, "id": None, "kind": "chapter", "major_title": None, "division": None, "section": False, "source_top": False}
    hs = [(1, 1, "The Novels"), (2, 1, "The Sea"), (3, 2, "Chapter 1"), (4, 1, "The Sea"), (5, 2, "The Mill by Ann Lee"), (6, 2, "Introduction"), (7, 3, ""), (8, 1, "Notes")]
    rows = [base | {"book": 1, "block_no": n, "level": lv, "text": t} for n, lv, t in hs]
    df = spark.createDataFrame(rows, "book long, doc_index long, block_no long, level long, text string, id string, kind string, major_title string, division string, section boolean, source_top boolean")
    out = {r.block_no: r for r in headings.fold(df).collect()}
    assert out[1].role == "division" and out[1].toc_level == 1
    assert out[2].current_division == "The Novels" and out[2].role == "work" and out[2].toc_level == 2
    assert out[3].role == "subdivision" and out[3].toc_kind == "chapter" and out[3].toc_level == 3
    assert out[4].ident == "the-sea-2"
    assert out[5].role == "authored" and out[5].current_work == "The Mill" and out[5].toc_title == "The Mill by Ann Lee"
    assert out[6].role == "front-section" and 7 not in out and out[8].role == "backmatter"


def test_quality(spark):
    rows = [(1, 12, i, t) for i, t in enumerate(["short line here", "b", "xvi", "Chapter 3"])] + [(1, 13, 0, "see img_12.jpg and fig-3.png")]
    df = spark.createDataFrame(rows, "book long, page long, line_no long, text string")
    assert [r.detail for r in quality.line_spills(df).collect()] == ["b"]
    assert [r.detail for r in quality.stranded_headings(df).collect()] == ["Chapter 3"]
    assert [r.detail for r in quality.image_names(df).collect()] == ["fig-3.png img_12.jpg"]
    v = quality.verdict(quality.line_spills(df).unionByName(quality.image_names(df))).first()
    assert (v.findings, v.blockers, v.blocked) == (2, 2, True)
    widths = spark.createDataFrame([(1, 1, 100.0, float(w)) for w in (100, 200, 300, 400)], "book long, page long, y double, width double")
    assert quality.narrow_columns(widths).count() == 0  # the upper median is 300


def test_settings():
    out, unknown = settings.resolve({"justify_prose": "yes", "body_size_pt": "12", "zzz": 1, "line_height": "x"}, {"title": "T", "author": None})
    assert out["justify_prose"] is True and out["body_size_pt"] == 12.0 and out["line_height"] == "x" and out["title"] == "T" and unknown == ["zzz"]
    fixed, moved = settings.auto_fix(dict(settings.DEFAULTS) | {"runner_body_clearance_mm": 13.0}, {"header_collisions"}, "")
    assert fixed["runner_body_clearance_mm"] == 14.0 and moved == ["runner_body_clearance_mm"]
    assert settings.auto_fix(fixed, {"header_collisions"}, "")[1] == []
    seen = []
    _, builds = settings.fix_until_still(dict(settings.DEFAULTS), lambda s: seen.append(s) or ({"header_collisions"}, ""), passes=10)
    assert builds == 5 and seen[-1]["runner_body_clearance_mm"] == 14.0  # 7, 9, 11, 13, 14


def test_plan_and_cache(spark, tmp_path):
    ran = []
    plan = dag.Plan()
    plan.add(dag.Stage("b", lambda o: ran.append("b") or {"b": o["a"].selectExpr("x + 1 as x")}, ("a",)))
    plan.add(dag.Stage("a", lambda o: ran.append("a") or {"a": spark.range(3).selectExpr("id as x")}, key=lambda o: dag.hash_text("v1")))
    assert plan.order() == ["a", "b"]
    cache = dag.TableCache(spark, str(tmp_path))
    plan.run({}, cache)
    out = plan.run({}, cache)
    assert ran == ["a", "b", "b"] and sorted(r.x for r in out["b"].collect()) == [1, 2, 3]
    cache.invalidate("a")
    assert not cache.has("a", dag.hash_text("v1"))
    with pytest.raises(dag.PlanError):
        plan.add(dag.Stage("a", lambda o: {}))
    with pytest.raises(dag.PlanError):
        dag.Plan().add(dag.Stage("x", lambda o: {}, ("y",))).order()
    with pytest.raises(dag.PlanError):
        dag.Plan().add(dag.Stage("x", lambda o: {}, ("y",))).add(dag.Stage("y", lambda o: {}, ("x",))).order()


def test_job_state_and_stream(spark, tmp_path):
    from quire.streaming import progress

    rows = [(1, 0, "[ 6/12] x..."), (1, 1, ""), (1, 2, "[ 2/12] again..."), (2, 0, "[12/12] last…"), (2, 1, "Wrote PDF: a.pdf"), (3, 0, "hello")]
    log = spark.createDataFrame(rows, "job_id long, seq long, line string")
    out = {r.job_id: r for r in jobs.state(log).collect()}
    assert (round(out[1].progress, 4), out[1].stage, out[1].lines) == (0.1667, "again", 2)
    assert (out[2].progress, out[2].stage) == (1.0, "Complete")
    assert (out[3].progress, out[3].stage) == (0.0, None)
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    running = progress.start(progress.job_states(stream), "states", mode="complete")
    running.processAllAvailable()
    running.stop()
    assert spark.table("states").where("job_id = 2").first().stage == "Complete"


def _book() -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        z.writestr("OEBPS/p.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Sea</dc:title><dc:creator>Lee, Ann</dc:creator></metadata><manifest><item id="b" href="b%20x.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="n" href="n.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("OEBPS/a.xhtml", "<html><body><h1>Sea</h1></body></html>")
        z.writestr("OEBPS/b x.xhtml", "<html><body><h1>Two</h1></body></html>")
        z.writestr("OEBPS/n.ncx", '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>Sea</text></navLabel><content src="a.xhtml"/></navPoint></navMap></ncx>')
    return buffer.getvalue()


def test_epub_source(spark, tmp_path):
    (tmp_path / "s.epub").write_bytes(_book())
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    rows = epub.spine(spark, str(tmp_path)).orderBy("doc_index").collect()
    assert [(r.doc_index, r.item_id, r.name) for r in rows] == [(0, "a", "OEBPS/a.xhtml"), (1, "b", "OEBPS/b x.xhtml")]
    meta = epub.metadata(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.kind, r.title) for r in meta] == [("title", "Sea"), ("creator", "Lee, Ann"), ("nav", "Sea")]
    kinds = spine.classify(spine.probe(epub.pages(epub.spine(spark, str(tmp_path))))).select("kind").distinct().collect()
    assert [r.kind for r in kinds] == ["major_work"]


def test_rules_and_decisions(spark, tmp_path):
    (tmp_path / "one.yaml").write_text("promo_patterns:\n  - free sample\n")
    assert rules.pack_names(" one.yaml; two ,") == ["one.yaml", "two"]
    assert "free sample" in rules.load("one.yaml", str(tmp_path)).get("promo")
    assert rules.suggestions("x\n```yaml\nrule_suggestions:\n  promo_patterns: ['a+', '(']\n  zzz: [b]\n```\n") == {"promo_patterns": ["a+"]}
    assert decisions.first_json('```json\n{"a": 1}\n```') == {"a": 1}
    assert decisions.first_json('so {x {"a": 2} y') == {"a": 2}
    asked = decisions.ask(spark.createDataFrame([(1, 0, "r")], "book long, batch long, request string"), lambda r: 'ok {"documents":[{"index":3,"kind":"promo","remove_document":true,"confidence":0.8}]}')
    made = decisions.read(asked)
    docs = spark.createDataFrame([(1, 3, "chapter", False), (1, 4, "chapter", True)], "book long, doc_index long, kind string, remove boolean")
    assert {r.doc_index: (r.kind, r.remove) for r in spine.override(docs, made).collect()} == {3: ("promo", False), 4: ("chapter", True)}


def test_plugins(spark):
    p = Plugins()
    p.register("cleaners", lambda df: df.withColumn("x", F.col("x") + 1))
    p.register("cleaners", lambda df: 1 / 0)
    assert p.apply("cleaners", spark.range(1).selectExpr("id as x")).first().x == 1 and len(p.failures) == 1
    p.register_rules("promo_patterns", ["zzz"])
    assert "zzz" in p.registry().get("promo")
