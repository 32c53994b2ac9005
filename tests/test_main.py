import json

from quire import __main__ as cli

from test_engine import _book


def test_builds_epubs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a", "b"):
        (tmp_path / "in" / f"{n}.epub").write_bytes(_book())
    (tmp_path / "c.json").write_text('{"title": "X", "zzz": 1}')
    args = cli.parse([str(tmp_path / "in"), str(tmp_path / "out"), "--config", str(tmp_path / "c.json"), "--body-size-pt", "12", "--no-drop-caps"])
    assert args.body_size_pt == 12.0 and args.drop_caps is False and args.hyphenate is None
    summary = cli.run(spark, args)
    assert summary["books"] == 2 and summary["unknown_settings"] == ["zzz"]
    assert json.loads((tmp_path / "out" / "summary.json").read_text()) == summary
    books = spark.read.text(str(tmp_path / "out" / "books"), wholetext=True).collect()
    assert len(books) == 2 and all("Sea" in b.value and "Two" in b.value for b in books)
