"""Different texts under null and repeated ids: by brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sectionspark.llm import line_dedup, minhash

SCHEMA = "doc_id long, text string, n int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    line = lambda: " ".join(f"w{r.randint(0, 900)}" for _ in range(12))
    common = [line() for _ in range(3)]
    texts = ["\n".join([line(), r.choice([line(), *common]), line(), *([common[0]] if k % 4 == 0 else [])]) for k in range(48)]
    texts += [texts[k].replace(" ", " x ", 1) for k in range(0, 48, 5)]  # near copies
    ids = [None, 5, 5, 9, None, 100 + len(texts)]
    return [(ids[k % 6] if k % 6 < 5 else 100 + k, t, k) for k, t in enumerate(texts)] + [(5, texts[1], 999), (None, None, 1000), (5, None, 1001)]


@pytest.mark.parametrize("most", [line_dedup.BROADCAST_LINES, 0])
def test_lines_of_shared_ids(spark, rows, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
    docs = spark.createDataFrame(rows, SCHEMA)
    digest = {r[0]: r[1] for r in docs.select("n", F.xxhash64("doc_id", "text")).collect()}
    lines = {((i is not None, i or 0, digest[n]), p): frozenset(x.split()) for i, t, n in rows for p, x in enumerate((t or "").split("\n"))}
    gone = {k for k, s in lines.items() if s and any(e and j < k and len(s & e) / len(s | e) >= 0.8 for j, e in lines.items())}
    assert len(gone) > 20
    got = {r["n"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    want = {n: t and "\n".join(x for p, x in enumerate(t.split("\n")) if ((i is not None, i or 0, digest[n]), p) not in gone) for i, t, n in rows}
    assert got == want


def test_near_duplicates_of_shared_ids(spark):
    r = random.Random(12)
    words = lambda n: " ".join(f"w{r.randint(0, 900)}" for _ in range(n))
    a, b, c, d = (words(150) for _ in range(4))
    near = lambda t: t + " end"
    # a: null, 7 and 8; b: 1 and 7; c: 7 only, twice; d: null twice, in different texts
    rows = [(None, a, 0), (7, near(a), 1), (8, a, 2), (1, b, 3), (7, near(b), 4), (7, c, 5), (7, c, 6), (None, d, 7), (None, near(d), 8), (None, None, 9), (8, None, 10)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {x["n"] for x in P.dedup_documents(spark, docs, "").collect()}
    assert kept - {7, 8} == {0, 3, 5, 6, 9, 10} and len(kept & {7, 8}) == 1
    got = sorted((x["doc_id"], x["class_id"], x["kept"]) for x in minhash.near_duplicates(docs).collect())
    # without the null ids, a's class begins with 7
    assert got == [(1, 1, True), (7, 1, False), (7, 7, True), (7, 7, True), (8, 7, False), (8, 8, True)]
