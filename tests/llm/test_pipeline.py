"""The pipeline, stage by stage against brute force, and its registration."""

import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows = [(i, text(40), "en", f"s{i % 3}") for i in range(240)]
    for i in range(0, 120, 3):
        w = rows[i][1].split(" ")
        for _ in range(3):
            w[rng.randrange(40)] = "moron"
        rows[i] = (i, " ".join(w), "en", rows[i][3])
    rows += [(1000 + i, rows[i][1].upper(), "en", None) for i in (200, 201, 202)]
    near = rows[203][1].split(" ")
    near[39] = "zz"
    rows += [(2000, " ".join(near), "en", "s0"), (2001, None, "en", "s0"), (None, "", None, None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0 and i < 120)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = [n for n, _ in corpus_pipeline.STAGES], {}
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert not any(i is not None and i < 120 and i % 3 == 0 for i in seen["toxicity"]) and 1 in seen["toxicity"]
    assert not {200, 201, 202} & set(seen["exact_dedup"]) and 1200 in seen["exact_dedup"]
    assert 203 in seen["near_dedup"] and 2000 not in seen["near_dedup"]
    assert max(seen["mixing"].values()) <= 3 and seen["mixing"] == seen["bpe"]


def test_run(spark, sf):
    import __spark_entry__ as entry

    out = entry.queries()["pipeline"](spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
