"""Line dedup, MinHash near-dedup, embedding operators: brute force."""

import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectionspark.llm import ann, line_dedup, minhash, pivot_dedup
from sectionspark.llm.components import components


def components_by_hand(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    real = [x for x in links if x[0] != x[1]]
    assert got == components_by_hand({n for x in real for n in x}, real)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_lines(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    lines = []
    for i, t, *_ in sorted(odd_rows, key=lambda r: -(1 << 63) if r[0] is None else r[0]):
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            lines.append((-1 if i is None else i, p, frozenset(w for w in re.split(r"[ \t\n\x0b\f\r]+", line.lower()) if w)))
    gone = set()
    for n, (i, p, s) in enumerate(lines):
        if s and any(e and (j, q) < (i, p) and len(s & e) / len(s | e) >= 0.8 for j, q, e in lines[:n]):
            gone.add((i, p))
    assert len(gone) > 20
    for r in out.collect():
        i = -1 if r["doc_id"] is None else r["doc_id"]
        text = next(t for j, t, *_ in odd_rows if j == r["doc_id"])
        if text is None:
            assert (r["text"], r["n_lines"], r["n_removed"]) == (None, 0, 0)
            continue
        kept = [x for p, x in enumerate(text.split("\n")) if (i, p) not in gone]
        assert r["text"] == "\n".join(kept) and r["n_lines"] == text.count("\n") + 1 and r["n_removed"] == r["n_lines"] - len(kept)


def test_lines_by_shuffle(make_docs, odd_rows, monkeypatch):
    want = sorted(map(str, line_dedup.dedup_lines(make_docs(odd_rows)).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted(map(str, line_dedup.dedup_lines(make_docs(odd_rows)).collect())) == want


def test_minhash_against_all_pairs(make_docs, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in minhash.near_duplicates(make_docs(odd_rows)).collect()}
    texts = {i: t for i, t, *_ in rows}
    assert set(got) == set(texts)
    folded = make_docs(odd_rows).select(F.lower("text").alias("text"))
    counts, n = minhash.document_frequencies(folded)
    import pyarrow as pa

    sets, links = {}, []
    for i, t in texts.items():
        c = next(minhash.chunks(pa.array([(t or "").lower()])))
        _, keys, tf, _ = minhash.shingles(c)
        sets[i] = (keys, minhash.idf_weights(keys, tf, counts, n))
    for a, b in combinations(sets, 2):
        if len(sets[a][0]) and len(sets[b][0]) and minhash.weighted_jaccard(*sets[a], *sets[b]) >= 0.8:
            links.append((a, b))
    want = components_by_hand(texts, links)
    assert len(links) > 20 and {i: c for i, (c, _) in got.items()} == want and all(k == (i == c) for i, (c, k) in got.items())


def test_minhash_turns_lose_nothing(spark, monkeypatch):
    """Buckets of documents that mostly don't match their first member."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    base = [words[i] for i in rng.integers(0, 300, 120)]
    rows = []
    for i in range(80):
        text = list(base)
        for p in rng.integers(0, 120, 3 + i % 4):
            text[p] = words[rng.integers(0, 300)]
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r[0]: r[1] for r in minhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(minhash, "PAIRS_A_TURN", 0)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    assert {r[0]: r[1] for r in minhash.near_duplicates(docs).collect()} == want


def test_similar_pairs_in_blocks():
    rng = np.random.default_rng(9)
    k = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(50)] + [np.array([3], np.uint64)]
    w = [(rng.integers(1, 3, len(x)) * (0.5 + x % 7)).astype("<f4") for x in k]
    k.append(k[0]), w.append(w[0])
    got = minhash.similar_pairs(k, w, 0.5)
    for a in range(len(k)):
        for b in range(len(k)):
            assert got[a, b] == (minhash.weighted_jaccard(k[a], w[a], k[b], w[b]) >= 0.5)


def test_consistent_samples_estimate_similarity():
    rng = np.random.default_rng(7)
    keys = np.sort(rng.choice(1 << 44, 400, replace=False)).astype(np.uint64)
    w = rng.random(400) + 0.1
    v = np.where(np.arange(400) % 4 == 0, w * 2.5, w)
    true, hits, n = float(np.minimum(w, v).sum() / np.maximum(w, v).sum()), 0, 60
    s = minhash.Sampler()
    minhash_rows, minhash.ROWS = minhash.ROWS, 1
    try:
        for k in range(n):  # other shingles, the same weights
            moved = (keys * np.uint64(2 * k + 3)) & np.uint64((1 << 44) - 1)
            hits += (s.bands(np.zeros(400, int), moved, w, 1) == s.bands(np.zeros(400, int), moved, v, 1)).sum()
    finally:
        minhash.ROWS = minhash_rows
    assert abs(hits / n / minhash.BANDS - true) < 0.08


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16))
    x[200:300] = x[5] + 0.05 * rng.standard_normal((100, 16))
    x[300:340] = x[6] + 0.3 * rng.standard_normal((40, 16))
    x[340] = x[341]
    label = [int(v) if v < 4 else None for v in rng.integers(0, 5, 900)]
    label[200:340] = [1] * 140
    rows = [(i, [float(v) for v in r], g, "q", 1) for i, (r, g) in enumerate(zip(x, label))]
    odd = [(1000, None, 1, "q", 1), (1100, [0.0] * 16, 1, "q", 1), (1200, [float("nan")] * 16, 1, "q", 1), (1300, [1.0] * 15 + [None], 1, "q", 1), (1400, [float("inf")] + [1.0] * 15, 1, "q", 1), rows[200]]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, pivot string, id int"), x, label


def test_nearest(spark, vectors):
    table, x, _ = vectors
    got: dict = {}
    for r in ann.nearest(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 900, 100))
    found = 0
    for q, rows in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = sorted(range(900), key=lambda i: (d[i], i))[:10]
        found += len({i for i, _ in rows} & set(want))
        assert len(rows) == 10 and all(s == pytest.approx(d[i], abs=1e-12) for i, s in rows) and rows == sorted(rows, key=lambda r: (r[1], r[0]))
    assert found >= 0.95 * 90
    few = table.where("vec_id in (0, 3, 100)")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(few, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()].__len__() == 4
    assert ann.nearest(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_anisotropic_codes_lose_less_along_the_vector():
    x = np.random.default_rng(2).standard_normal((2000, 16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)

    def along(weight):
        old, ann.PARALLEL = ann.PARALLEL, weight
        try:
            book = ann.fit(x)
            r = x - book.decode(book.encode(x))
            packed = book.scan(x[:5], book.packed(x))
            assert np.allclose(packed, x[:5] @ book.decode(book.encode(x)).T, atol=1e-3)
        finally:
            ann.PARALLEL = old
        return ((r * u).sum(1) ** 2).mean()

    assert along(4.0) < 0.8 * along(1.0)


@pytest.mark.parametrize("block", [1024, 40])
def test_pivot_links(vectors, monkeypatch, block):
    monkeypatch.setattr(pivot_dedup, "BLOCK", block)
    table, x, label = vectors
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivot_dedup.near_duplicates(table).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(a, b) for a, b in combinations(range(900), 2) if label[a] is not None and label[a] == label[b] and u[a] @ u[b] >= 0.93]
    want = components_by_hand(got, links)
    degree = np.bincount(np.array(links).ravel(), minlength=900)
    assert len(links) > 3000 and len(got) == 905
    assert sum(v[0] for v in got.values()) >= 0.99 * degree.sum() and all(got[i][0] <= degree[i] for i in range(900))
    assert sum(got[i][1] == want[i] for i in got) >= 0.99 * len(got) and all(v[2] == (i == v[1]) for i, v in got.items())
    assert all(got[i] == (0, i, True) for i in range(1000, 1500, 100))
    assert pivot_dedup.near_duplicates(table.limit(0)).count() == 0


def test_empty_documents(make_docs):
    assert line_dedup.dedup_lines(make_docs([])).count() == 0
    assert minhash.near_duplicates(make_docs([])).count() == 0


def test_clashing_names(spark):
    """Extra columns with names that the operators use inside come out as they went in."""
    from sectionspark.llm import histogram_sort

    rows = [(1, "a b c d e\nx y", "i1", "g1", 7, True, 1, 2, 3), (2, "a b c d e\nz", "i2", "g2", 8, False, 4, 5, 6), (2, "q", "i3", "g3", 9, None, 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _i string, _g string, _gone int, _shared boolean, _K1 int, _k2 int, _cell int")
    extra = [c for c in docs.columns if c != "text"]
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert sorted(map(str, out.select(extra).collect())) == sorted(map(str, docs.select(extra).collect()))
    assert {r["_i"]: r["text"] for r in out.collect()} == {"i1": "a b c d e\nx y", "i2": "z", "i3": "q"}
    out = histogram_sort.shard_documents(docs, 2)
    assert sorted(map(str, out.select(docs.columns).collect())) == sorted(map(str, docs.collect()))


def test_two_texts_of_one_id(spark):
    """Each text of an id is a document: what links is the text that is similar, not the id."""
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, want = [], []
    for i in range(12):
        base = [word() for _ in range(120)]
        near, far = list(base), [word() for _ in range(120)]
        near[60] = word()
        rows += [(1000 + i, " ".join(base)), (i, " ".join(near)), (i, " ".join(far))]
        want.append((" ".join(near), " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.text_classes(docs)
    from pyspark.sql import functions as F

    classes = {}
    for row in docs.select("doc_id", "text", F.xxhash64("text").alias("text_digest")).join(got, ["doc_id", "text_digest"]).collect():
        classes[row["text"]] = (row["class_id"], row["kept"])
    assert len(classes) == 36 and all(classes[a][0] == classes[b][0] for a, b in want)
    assert sum(kept for _, kept in classes.values()) == 24  # a pair is one class, each far text another
