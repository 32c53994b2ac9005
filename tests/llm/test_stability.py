"""Results that depend on the stored rows alone: no core count, no algebra of hashes, no size."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import common, components, exact_dedup, mixing, near_dedup, suffix_dedup, topk, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(4)
    base = [text(rng, 45) for _ in range(150)]
    rows = [(i, base[i % 150] if i < 300 else base[i % 150] + " end", "en", f"s{i % 4}", 9) for i in range(400)]
    folder = str(tmp_path_factory.mktemp("sf"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    df.write.option("parquet.block.size", 20_000).parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def deal(spark, few: bool):
    """How a scan is dealt to tasks, as other core counts would deal it."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m" if few else "3k")
    spark.conf.set("spark.sql.files.minPartitionNum", 1 if few else 40)


STEPS = {
    "suffix": lambda d, lab: suffix_dedup.digest(d),
    "exact": lambda d, lab: exact_dedup.dedup(d),
    "exact keep": lambda d, lab: exact_dedup.keep(d),
    "near": lambda d, lab: near_dedup.digest(d),
    "near keep": lambda d, lab: near_dedup.keep(d),
    "mix": lambda d, lab: mixing.mix(d),
    "emit": lambda d, lab: mixing.emit(d),
    "clean": lambda d, lab: toxicity.keep(d, lab),
}


@pytest.mark.parametrize("step", STEPS)
def test_same_rows_however_the_scan_is_dealt(spark, sf, step):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    try:
        deal(spark, True)
        want = Counter(map(tuple, STEPS[step](docs, labels).collect()))
        out = STEPS[step](docs, labels)
        deal(spark, False)
        assert docs.rdd.getNumPartitions() > 7
        assert Counter(map(tuple, out.collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_stages_survive_a_change_of_cores(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    try:
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            deal(spark, k % 2 == 0)
            out = stage(spark, docs, sf)
            deal(spark, k % 2 == 1)
            out.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
            if k == 1:
                assert docs.count() == docs.select("text").distinct().count() == 250
            if k == 2:
                assert docs.count() == 150
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_row_ids(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = common.with_rid(docs).select("rid", "doc_id").collect()
    assert len({r.rid for r in rows}) == 400
    part = common.with_rid(docs.where("doc_id < 9").select("doc_id")).collect()
    assert {(r.rid, r.doc_id) for r in part} <= {(r.rid, r.doc_id) for r in rows}
    for other in (docs.unionByName(docs), docs.limit(3), docs.sample(0.5), docs.withColumn("x", F.rand()), spark.range(4).withColumnRenamed("id", "doc_id")):
        assert common.stored(other) is not other
    assert common.stored(docs.where("doc_id > 4").select("doc_id")).columns == ["doc_id"]
    # the driver's hash of a path is Spark's
    name = "file:/tmp/a b%20é/part-1.parquet#3"
    assert spark.range(1).select(F.xxhash64(F.lit(name))).first()[0] % 2**64 == xxhash.xxh64_intdigest(name.encode(), 42)
    odd = str(tmp_path / "a b%20é")
    docs.write.parquet(odd)
    assert common.with_rid(spark.read.parquet(odd)).select("rid").distinct().count() == 400


def test_no_folder_of_a_machines_own_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError):
        common.shared_folder(Session)
    Session.sparkContext.master = "local-cluster[3,2,1024]"
    with pytest.raises(RuntimeError):
        common.shared_folder(Session)


def test_operators_delete_their_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    common.clear(spark)
    for step in ("suffix", "exact", "near", "mix"):
        STEPS[step](docs, None).count()
    there = spark._jvm.org.apache.hadoop.fs.Path(common._own_folder(spark))
    left = [str(x.getPath().getName()) for x in there.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(there)]
    assert sorted(x.rsplit("-", 1)[0] for x in left) == ["identities", "mix-rows", "near-duplicates", "repeated"]


def test_join_groups(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k long, v long")
    groups = common.materialise(rows.groupBy("k").agg(F.count("*").alias("c"), F.min("v").alias("low")), "groups")
    got = common.join_groups(rows, groups, ["k"], "c")
    assert got.exceptAll(rows.join(groups, "k")).count() == 0 and got.count() == 300
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_complementary_words_are_different(spark):
    rows = [(10 * k + i, t) for k, n in enumerate((1024, 2048, 4096)) for i, t in enumerate(thue_morse(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.component_id == r.doc_id and r.kept for r in near_dedup.near_duplicates(df).collect())


def brute(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(hashlib.sha256(bytes(b for b, x in zip(t, gone, strict=True) if not x)).hexdigest())
    return out


def test_repeats_of_hostile_texts(spark):
    rng = random.Random(6)
    a, b = thue_morse(4096)
    noise = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    texts = [a, b, a[:1024] + "x" + b[:1024], " " * 5000, noise(150) + " " * 800 + noise(150), "ab" * 400, "x" + "ab" * 100, noise(90) + "-" * 260 + noise(90), "-" * 200, "-" * 199]
    texts += ["".join(rng.choice("ab") for _ in range(p)) * (900 // p) for p in (3, 7, 31, 32, 33, 40, 64, 170, 201)]
    texts += [noise(70) + "".join(rng.choice("xy") for _ in range(5)) * 60 + noise(70) for _ in range(4)]
    texts += [noise(40) + "=" * k + noise(40) for k in range(196, 206)] + ["=" * 100 + "-" * 300 + "=" * 220]
    got = suffix_dedup.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = brute([t.encode() for t in texts])
    assert {r.doc_id: r.kept_sha256 for r in got} == dict(enumerate(want))


@pytest.mark.parametrize("near", [False, True])
def test_a_passage_in_very_many_documents_makes_few_rows(spark, monkeypatch, near):
    """More segments of one anchor than a shard takes: the right bytes, from rows in proportion to the segments, not to their windows."""
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghijklm ") for _ in range(n))
    passage, made = noise(260), Counter()
    texts = [noise(rng.randint(120, 200)) + passage + noise(rng.randint(120, 200)) for _ in range(300)]
    if near:  # a long passage with some letters changed
        passage = list(noise(700))
        for k in range(300):
            t = passage.copy()
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice("XYZ")
            texts[k] = "".join(t)

    class Counted(suffix_dedup.Scratch):
        def __call__(self, df, label):
            out = super().__call__(df, label)
            made[label] += out.count()
            return out

    monkeypatch.setattr(suffix_dedup, "Scratch", Counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: hashlib.sha256(r.kept).hexdigest() for r in suffix_dedup.remove(docs, shard_segments=16).collect()}
    assert got == dict(enumerate(brute([t.encode() for t in texts])))
    assert max(made[x] for x in ("pieces", "judged", "cut")) < 12 * made["segments"], made


def test_megabytes_of_blanks(spark):
    rows = [(1, " " * 20_000_000), (2, "x" * 300 + " " * 200), (3, "y" * 150)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (20_000_000, 1), 2: (500, 1), 3: (0, 0)}


def test_scores_of_large_components(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.integers(200_000, 300_000, 64)]) for k in range(120)]
    rows += [(1000 + k, [*rows[0][1][:-1], rows[0][1][-1] + k / 1024]) for k in range(3)]
    ints = {i: [int(x * 1024) for x in e] for i, e in rows}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.topk(df).collect()]
    want = []
    for q in (i for i in ints if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], e, strict=True)), i) for i, e in ints.items() if i != q)[:10]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want) and max(w[3] for w in want) > 2**53


def test_components_of_a_star(spark):
    links = [(i, 500) for i in range(500)] + [(700 + i, 700 + i + 1) for i in range(30)] + [(730, 0)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert set(got.values()) == {0} and len(got) == 501 + 31


def test_driver_lets_go_of_finished_jobs(spark, monkeypatch):
    """What nothing names any more goes as tables are written, not when the driver's heap is full."""
    monkeypatch.setattr(common, "TASKS", 8, raising=False)
    done = spark.range(9)
    weak = spark._jvm.java.lang.ref.WeakReference(done._jdf)
    assert weak.get() is not None
    del done
    for _ in range(4):
        common.discard(common.materialise(spark.range(9), "held"))
    assert weak.get() is None
