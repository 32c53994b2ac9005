"""The job registry and its requests, cache entries, stage states and path checks."""

import json
from datetime import datetime
from pathlib import Path

import pytest

from quire.plans import dag, paths, service


@pytest.fixture
def registry(spark, tmp_path):
    project = tmp_path / "project"
    project.mkdir()
    for name in ("A5.yaml", "A4.yaml", ".hidden.yaml", "x.txt"):
        (project / name).write_text("a: 1")
    return service.Jobs(spark, str(tmp_path / "service"), str(project))


def test_jobs(registry, tmp_path):
    assert registry.list() == [] and registry.get("0") is None
    path = registry.save_upload("../My book (1).EPUB", b"zip")
    assert Path(path).read_bytes() == b"zip" and path.endswith("_My_book_1_.EPUB")
    with pytest.raises(ValueError):
        registry.save_upload("a.epub", b"")
    one = registry.create(path, {"title": " T ", "strict": "YES", "sample_pages": "-3", "out_name": "x/y.v1.pdf", "nonsense": 1})
    said = json.loads(one["options"])
    assert (one["title"], one["out_name"], one["status"], said["strict"], said["sample_pages"], said["config"]) == ("T", "y.v1.pdf", "queued", True, 0, "A4.yaml") and "nonsense" not in said
    out, art = tmp_path / "out.pdf", tmp_path / "art"

    def build(row, say):
        for line in ("[1/4] read...", "", "[2/4] scan and classify..."):
            say(line)
        (art / "qa").mkdir(parents=True)
        for n in ("review_2.png", "page_10.png", "page_02.png", "other.png"):
            (art / "qa" / n).write_bytes(b"")
        (art / "build_summary.json").write_text(json.dumps({"settings": {"a": 1}}))
        out.write_text("pdf")
        return str(out), str(art)

    done = registry.run(one["job_id"], build)
    assert (done["status"], done["progress"], done["stage"], done["lines"]) == ("done", 0.5, "scan and classify", 2)
    assert done["qa_images"] == ["page_02.png", "page_10.png", "review_2.png"] and done["has_pdf"] and not done["has_qa_report"] and done["effective_settings"] == {"a": 1}
    two = registry.create("b.epub", {})
    assert two["out_name"] == "b.pdf"

    def breaks(row, say):
        raise RuntimeError("no such font")

    assert registry.run(two["job_id"], breaks)["error"] == "no such font"
    three = registry.create("c.epub", {})
    assert registry.run(three["job_id"], lambda row, say: (str(tmp_path / "none.pdf"), ""))["status"] == "failed"
    assert [r["job_id"] for r in registry.list()] == [three["job_id"], two["job_id"], one["job_id"]]
    with pytest.raises(KeyError):
        registry.run("nobody", build)
    get = lambda path: service.respond(registry, "GET", path)
    assert get(f"/api/jobs/{one['job_id']}/pdf") == (200, str(out)) and get(f"/api/jobs/{one['job_id']}/image/page_02.png")[0] == 200
    assert get(f"/api/jobs/{one['job_id']}/image/other.png")[0] == 404 and get(f"/api/jobs/{two['job_id']}/report")[0] == 404
    assert get(f"/api/jobs/{one['job_id']}")[1]["status"] == "done" and get("/api/jobs/abc")[0] == 404 and len(get("/api/jobs")[1]["jobs"]) == 3


def test_requests(registry):
    assert service.respond(registry, "GET", "/api/health") == (200, {"status": "ok"})
    assert [x["name"] for x in service.respond(registry, "GET", "/api/configs")[1]["configs"]] == ["A4.yaml", "A5.yaml"]
    assert service.respond(registry, "POST", "/api/jobs")[0] == 400 and service.respond(registry, "POST", "/api/jobs", {}, ("a.epub", b""))[0] == 400
    assert service.respond(registry, "POST", "/api/jobs", {"title": "x"}, ("a.epub", b"z"))[1]["title"] == "x"
    assert service.respond(registry, "GET", "/nowhere")[0] == 404
    assert registry.config_path("A5.yaml").endswith("A5.yaml") and registry.config_path("").endswith("A4.yaml")
    with pytest.raises(PermissionError):
        registry.config_path("../x.yaml")
    with pytest.raises(FileNotFoundError):
        registry.config_path("none.yaml")


def test_cache_entries(spark, tmp_path):
    cache = dag.TableCache(spark, str(tmp_path / "cache"))
    assert cache.load_text("a", "k1") is None and cache.load_json("a", "k1") is None
    cache.store_json("a", "k1", {"b": [1, "é"]})
    assert cache.load_json("a", "k1") == {"b": [1, "é"]} and cache.load_text("a", "k1") == '{"b": [1, "é"]}'
    cache.store_text("a", "k2", "{not json")
    assert cache.load_json("a", "k2") is None and cache.has_text("a", "k2")
    cache.invalidate_all()
    assert not cache.has_text("a", "k2")
    (tmp_path / "f").write_bytes(b"x")
    assert dag.hash_files(spark, str(tmp_path / "f")).first().hash == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


def test_stage_states(spark, tmp_path):
    cache = dag.TableCache(spark, str(tmp_path / "cache"))
    make = lambda: dag.Plan().add(dag.Stage("one", lambda o: {"one": spark.range(3)}, key=lambda o: "k")).add(dag.Stage("two", lambda o: {"two": 1 // o["by"]}, ("one",)))
    first = make()
    first.run({"by": 1}, cache)
    assert first.status == {"one": "completed", "two": "completed"}
    second = make()
    with pytest.raises(dag.PlanError):
        second.run({"by": 0}, cache)
    assert second.status == {"one": "cached", "two": "failed"} and set(second.status.values()) <= set(dag.STATUSES)


def test_paths(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "here.yaml").write_text("")
    assert paths.project_path("here.yaml", "/root") == str(tmp_path / "here.yaml") and paths.project_path("gone.yaml", "/srv") == "/srv/gone.yaml" and paths.project_path("/a/b") == "/a/b"
    assert paths.batch_folder("out", "books", out_said=True) == str(tmp_path / "books") and paths.batch_folder("out", "x.pdf", True, True) == str(tmp_path / "out")
    with pytest.raises(ValueError):
        paths.batch_folder("out", "x.pdf", out_said=True)
    assert paths.report_path("/r", datetime(2024, 1, 2, 3, 4, 5)) == "/r/batch_report_20240102_030405.json"
    paths.writable(str(tmp_path / "new" / "x.pdf"))
    (tmp_path / "new" / "x.pdf").write_text("old")
    paths.writable(str(tmp_path / "new" / "x.pdf"))
    assert (tmp_path / "new" / "x.pdf").read_text() == "old"
    paths.write_suggestions(str(tmp_path / "s.yaml"), {"chapter_headings": ["^stave"], "unknown": ["x"]}, "a/report.txt")
    text = (tmp_path / "s.yaml").read_text()
    assert '  - "^stave"' in text and "unknown" not in text and "report.txt" in text
    assert paths.options_of({"a": 1, "batch": "x"}, "n.pdf", "o", None) == {"a": 1, "batch": None, "out": "n.pdf", "output_dir": "o", "title": None}
