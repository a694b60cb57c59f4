"""Language identification and quality: exact code lengths, held-out accuracy."""

import math
import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sectionspark.llm import language_id, quality, queries

DATA = "/root/testdata/sf0.01"


def ppm_by_hand(texts):
    """Counts of contexts as in a plain tree; cost(text) walks it byte by byte."""
    counts = defaultdict(Counter)
    for t in texts:
        data = [None] * 3 + list(t.encode())
        for i in range(3, len(data)):
            for k in range(4):
                counts[tuple(data[i - k : i])][data[i]] += 1

    def probability(context, symbol):
        c = counts[context]
        if c[symbol]:
            return c[symbol] / (sum(c.values()) + len(c))
        lower = probability(context[1:], symbol) if context else 1 / 256
        return lower * (len(c) / (sum(c.values()) + len(c)) if c else 1)

    def cost(text):
        data = [None] * 3 + list(text.encode())
        return -sum(math.log2(probability(tuple(data[i - 3 : i]), data[i])) for i in range(3, len(data)))

    return cost


def test_exact_code_lengths(spark, monkeypatch):
    from pyspark.sql import functions as F

    # all bytes, contexts met once, and two languages that know different contexts
    texts = {"en": ["the cat sat on the mat " * 3, "the dog and the cat, and the mat", "once"], "xx": ["".join(map(chr, range(1, 256))), "ça va, là-bas"]}
    docs = spark.createDataFrame([(i * 3, t, lang) for lang in texts for i, t in enumerate(texts[lang])], "doc_id long, text string, lang string")
    model = language_id.train(docs, usable=F.lit(True))
    asked = ["the cat", "a zebra!", "", "tttt the", "ü", None, "once upon the mat\x00 là " * 40]
    want = [[cost(t or "") for cost in map(ppm_by_hand, texts.values())] for t in asked]
    assert language_id.code_lengths(model, pa.array(asked)) == pytest.approx(np.array(want), rel=1e-5)
    monkeypatch.setattr(language_id, "AT_ONCE", 50)  # long texts are cut, and cost the same
    assert language_id.code_lengths(model, pa.array(asked)) == pytest.approx(np.array(want), rel=1e-5)


def test_odd_texts(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = language_id.identify(docs, language_id.train(docs))
    assert out.columns == [*docs.columns, "lang_pred", "lang_score", "lang_bits"]
    for r in out.collect():
        known = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] in ("en", "de")) == known and (known or (r["lang_pred"], r["lang_score"]) == ("und", 0.0)) and 0 <= r["lang_score"] <= 1
    empty = make_docs([])
    assert language_id.identify(empty, language_id.train(empty)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.train(empty)).collect()} == {"und"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = queries.op9_language_id(spark, DATA).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.fit(x[:2000], y[:2000])

    def walk(row):
        total = trees.base
        for i in trees.roots:
            while trees.left[i] != i:
                i = trees.left[i] + int(row[trees.feature[i]] > trees.threshold[i])
            total += trees.value[i]
        return 1 / (1 + math.exp(-total))

    got = trees.score(x[2000:])
    assert got[:50] == pytest.approx([walk(r) for r in x[2000:2050]]) and ((got > 0.5) == y[2000:]).mean() > 0.95
    assert quality.fit(x[:9], np.ones(9)).score(x)[0] > 0.9


def test_statistics():
    text = "Ab ab, x1!\nAb ab, x1!\n\n??"
    row = dict(zip(quality.FEATURES, quality._table(pa.array([text, None, ""]))[0]))
    assert math.isclose(row["log_words"], math.log1p(7)) and math.isclose(row["distinct_words"], 4 / 7) and math.isclose(row["top_word"], 2 / 7)
    assert math.isclose(row["distinct_lines"], 2 / 3) and math.isclose(row["upper"], 2 / len(text)) and math.isclose(row["letterless_words"], 1 / 7)
    assert not quality._table(pa.array([None, ""])).any()


def test_quality_of_odd_texts(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(70)] + [(None, 1, 0), (71, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs, quality.train(docs, labels))
    scores = [r["quality_score"] for r in out.collect()]
    assert len(scores) == len(odd_rows) and all(0 <= s <= 1 for s in scores) and out.columns == [*docs.columns, "quality_score"]
    none = quality.train(docs, labels.limit(0))
    assert {r["quality_score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), none).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = queries.op8_quality(spark, DATA).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in rows]) > 0.95
