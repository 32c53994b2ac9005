"""Each operator against brute force on small tables, with nulls, empties, ties and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import bpe, components, exact_dedup, html_extract, licenses, mixing, near_dedup, pii, shingles, suffix_array, suffix_dedup, topk, toxicity
from quire.llm.dom import blocks

DOC = "doc_id long, text string, rid long, source string"


def words(rng, n, letters="abcdé"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, odd values; (doc_id, text) with a repeated and a null id."""
    rng = random.Random(3)
    texts = [words(rng, rng.randint(1, 200)) for _ in range(60)]
    passages = [words(rng, 45) for _ in range(4)]
    for _ in range(50):
        a, p = rng.choice(texts[:60]), rng.choice(passages)
        k = rng.randint(0, len(a))
        texts.append(a[:k] + p + a[k:])
    for _ in range(30):
        w = rng.choice(texts[:60]).split(" ")
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "zz"
        texts.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    texts += [None, "", " \n\t ", "x" * 500, "x" * 200, "ab" * 300, texts[0], "one two", "ONE two", "漢字 é b"]
    rows = list(enumerate(texts))
    return [*rows, (7, texts[7]), (7, "another text under seven"), (None, texts[8])]


@pytest.fixture(scope="module")
def docs(spark, corpus, tmp_path_factory):
    """The corpus as a stored table with a column that clashes with the operators' own."""
    path = str(tmp_path_factory.mktemp("docs") / "documents")
    spark.createDataFrame([(i, t, 99, "s") for i, t in corpus], DOC).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for trial in range(150):
        k = int(rng.integers(1, 5))
        t = rng.integers(1, k + 1, int(rng.integers(1, 80)))
        t = np.append(np.tile(t[: len(t) // 3 + 1], 4) if trial % 3 == 0 else t, 0)
        s = bytes(t.astype(np.uint8).tolist())
        assert suffix_array.suffix_array(t, k + 2).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        out.append((len(t), sum(gone), sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [4096, 2])
def test_suffix_dedup(docs, corpus, shard):
    expected = Counter((i, *e) for (i, _), e in zip(corpus, brute_repeats([(t or "").encode() for _, t in corpus]), strict=True))
    got = suffix_dedup.remove(docs, shard_segments=shard).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == expected


def test_suffix_dedup_long_document(spark):
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    t = a + a[:5000]
    got = suffix_dedup.remove(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert (got.n_removed, got.n_spans) == (10_000, 2)


def test_exact_dedup(docs, corpus):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for i, t in corpus:
        groups[lower(t)].append(i)
    best = lambda ids: max((i for i in ids if i is not None), default=None)
    expected = Counter((i, best(groups[lower(t)]), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in corpus)
    for block in (8192, 16):
        got = exact_dedup.dedup(docs, block).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
        assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.keep(docs).count() == len(groups) and exact_dedup.keep(docs).columns == docs.columns


def sets_of(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(corpus):
    sets = [sets_of(t) for _, t in corpus]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(corpus):
        if i is not None:
            low[find(k)].append(i)
    return Counter((i, len(sets[k]), min(low[find(k)], default=None)) for k, (i, _) in enumerate(corpus))


def test_near_dedup(docs, corpus):
    got = near_dedup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(corpus)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got if r.n_shingles)
    assert near_dedup.keep(docs).columns == docs.columns
    assert near_dedup.keep(docs).count() == len({r.component for r in got})


def test_near_dedup_crowded_bucket(spark, monkeypatch):
    """A group of near copies most of which are linked to few others only, in blocks of three."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 150)
    rng = random.Random(8)
    base = words(rng, 60).split(" ")
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(60)] = f"q{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    common, errors = rng.integers(0, 2**63, 800, dtype=np.uint64), []
    for share in (0.6, 0.75, 0.9):
        n = int(800 / share - 800) // 2
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, n, dtype=np.uint64)])) for _ in range(2))
        s = near_dedup.odd_sketches(near_dedup.minhashes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])))
        errors.append(near_dedup.estimate(np.bitwise_count(s[0] ^ s[1]).sum()) - share)
    assert max(map(abs, errors)) < 0.15


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (100, 101), (5, 5), (200, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99, 101: 99}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shingles(corpus):
    import pyarrow as pa

    hashes, offsets = shingles.shingle_sets(pa.array([t for _, t in corpus], pa.string()))
    assert np.diff(offsets).tolist() == [len(sets_of(t)) for _, t in corpus]


def test_mixing(spark, docs, corpus):
    rng = random.Random(5)
    rows = [(k, words(rng, rng.randint(0, 30)), rng.choice(["a", "b", "b", "b", "c", None, "tiny"] if k > 3 else ["tiny"])) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    size = defaultdict(int)
    taken, target = defaultdict(int), {}
    source = {k: s for k, _, s in rows}
    for r in got:
        assert r.size == len((rows[r.doc_id][1]).split()) and 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    weights, free, left, want = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}, set(size), sum(size.values()), {}
    while over := {s for s in free if left * weights[s] / sum(weights[x] for x in free) > 3 * size[s]}:
        want |= {s: 3 * size[s] for s in over}
        free -= over
        left = sum(size.values()) - sum(want.values())
    want |= {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 30
    assert sorted(map(tuple, mixing.mix(df.repartition(5)).drop("rid").collect())) == sorted(map(tuple, mixing.mix(df).drop("rid").collect()))
    assert mixing.mix(docs).count() == len(corpus)
    out = mixing.emit(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)


def test_license_scan(spark, docs, corpus):
    extra = ["All Rights-Reserved. cc  BY cc-by 4.0", "GNU General Public License version 2 or later", "licensed under the Apache License, Version 2.0", "x" * 10 + " mit license", "the accc by y"]
    rows = [(i, t) for i, t in corpus] + [(1000 + k, t) for k, t in enumerate(extra)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = []
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        expected.append((i, len(w), len(at), min(at, default=(None,))[0], max(at, default=(None,))[0], ",".join(sorted({x for _, x in at}))))
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter(expected)
    by = {r.doc_id: r for r in got if r.doc_id and r.doc_id >= 1000}
    assert by[1000].labels == "cc-by,cc-by-4.0,reserved" and by[1001].labels == "gpl,gpl-2-or-later" and "apache-2" in by[1002].labels
    assert by[1003].labels == "mit" and by[1003].base_labels == "" and by[1004].n_base == 0
    assert all(0 <= r.score <= 1 for r in got) and len(licenses.rules()) > 200


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        w = words(rng, rng.randint(20, 60), "abcdefgh").split(" ")
        toxic = k % 4 == 0
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(["moron", "scumbag", "idiotic"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic), 9))
    rows += [(None, None), (5000, ""), (5001, "a moron said")]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.score(df, lab).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[k].predicted == y for k, y, _ in labels) and by[5000].predicted == 0 and by[None].predicted == 0
    assert [(s.start, s.end) for s in by[5001].spans] == [(2, 7)]
    again = {r.doc_id: r.score for r in toxicity.digest(df, lab).collect()}
    assert again == {r.doc_id: r.score for r in got}
    assert toxicity.keep(df, lab).count() == sum(r.predicted == 0 for r in got)
    assert toxicity.score(df, lab.where("toxic = 0")).where("predicted = 1").count() == 0


def brute_spans(t):
    out = []
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    for k, (name, p) in enumerate(patterns):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if name == "ip" else True, "card": 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if n % 2 else int(c) for n, c in enumerate(d[::-1])) % 10 == 0, "phone": 10 <= len(d) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end(), name))
    return ",".join(f"{n}:{a}:{e}" for a, k, e, n in sorted(out))


def test_pii(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab@.+-() 0123456789@..") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["é mail a.b@c-d.e.f@g.h", "4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "+1 (456) 555-2186.", "300.1.1.1", "007.1.1.1", "9" * 5000, None, "", "a" * 100_000 + "@"]
    got = pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        s = brute_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(s.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(re.findall(k + ":", s)) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, s.split(","))) <= set(r.spans.split(","))
    more = pii.spans("IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789; 987-65-4321")[1]
    assert [pii.KINDS[x[1]] for x in more] == ["iban", "ssn"]
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.normal(size=20).astype(np.float32)]) for k in range(700)]
    rows += [(5, rows[100][1]), (None, rows[200][1]), (900, None), (901, [1.0, None]), (902, [float("nan")] * 20), (903, [float("inf")] * 20), (1000, [2.0] * 7), (200, rows[200][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, np.floor(np.array(e, np.float32).astype(float) * 1024)) for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    expected = Counter()
    for k, (i, e) in enumerate(good):
        if i is not None and i % 100 == 0:
            s = []
            for j, (other, f) in enumerate(good):
                n = min(len(e), len(f))
                if j != k:
                    s.append((-int(e[:n] @ f[:n]), other is None, other or 0, other))
            for rank, (score, _, _, other) in enumerate(sorted(s, key=lambda x: x[:3])[:10], 1):
                expected[i, rank, other, -score] += 1
    for block in (20_000, 3):
        got = topk.topk(df.repartition(3), query_block=block).collect()
        assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == expected
    assert topk.topk(df.where("vec_id = 1")).count() == 0
    large = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 3.0]), (2, [-1e9, 0.5])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk.topk(large).orderBy("rank").collect()] == [1, 2]


def test_bpe(spark, docs, corpus):
    tok = bpe.load(bpe.read(bpe.default_path()))
    odd = ["a<|startoftext|>B <|endoftext|>", "Ünïcödé İstanbul ΣΑΣ é x\x1cy\x85z", "漢字 १२३ ²½ 'S it's don't'll", "<|startoftext|", "ℌello ﬁ K", "\0abc", "a‍b 😀😀"]
    rows = [*corpus, *((2000 + k, t) for k, t in enumerate(odd))]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        expected[i, tuple(ids), tok.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == expected
    digest = bpe.digest(docs).where("doc_id = 0").first()
    ids = tok.encode(corpus[0][1], add_special_tokens=False).ids
    assert digest.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    back = bpe.decode(spark.createDataFrame([(1, ids), (2, []), (3, None)], "rid long, ids array<int>"))
    assert {r.rid: r.decoded for r in back.collect()} == {1: tok.decode(ids, skip_special_tokens=False), 2: "", 3: ""}


def test_bpe_packing():
    a = np.array([0, 127, 128, 16383, 16384, 2**20, 5])
    assert bpe.unpack(bpe.pack(a)).tolist() == a.tolist() and len(bpe.unpack(bpe.pack(a[:0]))) == 0


def test_dom():
    page = "<title>t</title><div class='Ad x'>one<b>two</b><script>var x='</p>';</script><p>three<br>four &amp; 5 < 6<p>last <!-- no --><ul><li>a<li>b</ul><p hidden>gone</p><form><option>x</option></form>"
    assert [(b.text, b.tag) for b in blocks(page)] == [("onetwo", "div"), ("three four & 5 < 6", "p"), ("last", "p"), ("a", "li"), ("b", "li"), ("gone", "p")]
    assert blocks(None) == blocks("") == blocks("<p></p>") == []


def test_html_extract(spark):
    held, model, wrong, total = html_extract.labelled_pages(150, 77), html_extract.train(), 0, 0
    for page, labels in held:
        got = blocks(page)
        at = 0
        for b, y in zip(got, html_extract.decode([got], model)[0], strict=True):
            k = next((k for k in range(at, len(labels)) if " ".join(labels[k][0].split()) == b.text), None)
            wrong += y != (labels[k][1] if k is not None else 0)
            total += 1
            at = k + 1 if k is not None else at
    assert wrong / total < 0.03
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title</h1><p>Some  text\nof it, and more.</p></article><footer>&copy; 2024 x</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page, "z"), (2, None, None, "z"), (None, "u", "", "z"), (1, "u", page, "z")], "page_id long, url string, html string, text string")
    got = html_extract.extract(rows).collect()
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in got) == Counter([(1, "u", "Title\n\nSome text of it, and more.", 33)] * 2 + [(2, None, "", 0), (None, "u", "", 0)])


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    out = [suffix_dedup.digest(empty), exact_dedup.dedup(empty), near_dedup.digest(empty), html_extract.extract(pages), mixing.mix(empty), licenses.scan(empty), toxicity.digest(empty, labels), pii.digest(empty), topk.topk(vectors), bpe.digest(empty)]
    assert [x.count() for x in out] == [0] * 10


def test_no_columns_beyond_the_contract_clash(docs):
    assert docs.where(F.col("rid") == 99).count() == docs.count()
