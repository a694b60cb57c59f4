"""Exact search in cells, vectors encoded once, an index that changes in part."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectionspark.operators import search as V
from sectionspark.operators.answer import answer_batch
from sectionspark.operators.corpus import build_index, index_records, update_index
from sectionspark.operators.vector_store import encode_once
from sectionspark.sources.tables import CHUNKS

FIELDS = [n.split(" ")[0] for n in CHUNKS.replace("`", "").split(", ")]


def clustered(seed=0):
    """Clusters, copies of one vector in a third of the rows, short, zero, null and odd vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 6)) * 4
    x = centres[rng.integers(0, 12, 600)] + 0.2 * rng.standard_normal((600, 6))
    rows = [(i, [float(v) for v in (x[0] if i % 3 == 0 else x[i])], ["a", "b", "c", None][i % 4]) for i in range(600)]
    rows += [(600, [0.0] * 6, "a"), (601, None, "a"), (602, [1.0, None], "a"), (603, [float("nan")] * 6, "b"), (604, [], "b"), (605, [1.0, 2.0], "rare"), (606, [float(v) for v in x[1]] + [0.0, 0.0], "b")]
    return rows


def nearest(rows, asked, k):
    ok = {i: (np.array(v + [0.0] * (8 - len(v))), s) for i, v, s in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = []
    for q, w in asked:
        v = ok[q][0]
        d = {i: 1 - (x * v).sum() / (np.sqrt((x * x).sum()) * np.sqrt((v * v).sum())) for i, (x, s) in ok.items() if w is None or s == w}
        out += [(q, n + 1, i) for n, i in enumerate(sorted(d, key=lambda i: (round(d[i], 12), i))[:k])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_cells_and_slices_lose_nothing(spark, monkeypatch, small):
    if small:  # many cells, cut into slices
        monkeypatch.setattr(V, "LEAST_CELL", 8)
        monkeypatch.setattr(V, "ROWS", 32)
    rows = clustered()
    asked = [(i, [None, "a", "b", "rare", "none"][i % 5]) for i in [*range(0, 600, 7), 605, 606]]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, source string")
    q = df.join(spark.createDataFrame(asked, "query_id long, source_filter string"), F.col("chunk_id") == F.col("query_id")).select("query_id", "source_filter", "embedding")
    want = nearest(rows, asked, 5)
    for parts in (1, 5, 32):
        got = V.cosine_topk(q.repartition(parts), df.repartition(parts), 5).select("query_id", "rank", "chunk_id").collect()
        assert sorted(map(tuple, got)) == want
    assert V.cosine_topk(q, df.limit(0)).count() == 0 and V.cosine_topk(q.limit(0), df).count() == 0


def test_cells_are_skipped():
    """Questions near one cluster visit few of the cells."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16)) * 9
    x = np.repeat(centres, 50, 0) + 0.1 * rng.standard_normal((2000, 16))
    order = rng.permutation(2000)
    cells = V._Cells(x[order[:1000]], [None] * 1000, 60)
    at, chord = cells.assign(x)
    for c in range(60):
        cells.rows[c], cells.radius[c] = (at == c).sum(), chord[at == c].max(initial=0)
    visits = cells.visits(x[:50], [None] * 50, np.zeros(50, np.int64), 10)
    assert visits.sum(1).max() < 20 and visits[np.arange(50), at[:50]].all()


@pytest.fixture()
def counted(tmp_path):
    """An encoder that notes the texts it is given."""
    log = str(tmp_path / "log")
    os.makedirs(log)

    def factory():
        encode, number = V.hashed_encoder(8), [0]

        def run(texts):
            number[0] += 1
            with open(f"{log}/{os.getpid()}-{id(number)}-{number[0]}", "w") as f:
                f.write("\0".join(texts))
            return encode(texts)

        return run

    def seen():
        out = [line for name in os.listdir(log) for line in open(f"{log}/{name}").read().split("\0")]
        for name in os.listdir(log):
            os.remove(f"{log}/{name}")
        return sorted(out)

    return factory, seen


def test_each_text_is_encoded_once(spark, tmp_path, counted):
    factory, seen = counted
    store = str(tmp_path / "vectors")
    rows = spark.createDataFrame([(i, ["one", "two", "three", "", None][i % 5]) for i in range(500)], "chunk_id long, document string")
    got = encode_once(rows, store, factory, "v1")
    assert got.count() == 500 and got.groupBy("embedding").count().count() == 4
    assert seen() == ["", "one", "three", "two"]
    more = encode_once(rows.union(spark.createDataFrame([(900, "four")], rows.schema)), store, factory, "v1")
    assert more.count() == 501 and seen() == ["four"]
    assert encode_once(rows, store, factory, "v2").count() == 500 and len(seen()) == 4  # another version
    assert encode_once(rows.limit(0), store, factory, "v1").count() == 0 and seen() == []


def chunks(spark, rows):
    return spark.createDataFrame([tuple(c.get(f) for f in FIELDS) for c in rows], CHUNKS)


def test_a_job_encodes_each_question_once(spark, tmp_path, counted):
    factory, seen = counted
    rows = [{"chunk_id": i, "source_pdf": "BNS", "section_number": 100 + i, "section_title": f"T{i}", "content": f"text of {i}"} for i in range(8)]
    records = index_records(chunks(spark, rows))
    index = encode_once(records, str(tmp_path / "v"), factory)
    assert len(seen()) == 8
    asked = spark.createDataFrame([(i, f"question {i % 20}", None if i % 2 else "none") for i in range(100)] + [(5, "question 5", None)], "query_id long, question string, source_filter string")
    plain = answer_batch(asked, index, encode=lambda q: V.embed_batches(q, factory=factory))
    assert plain.count() == 100
    assert len(seen()) == 20  # by question and filter, before any action of the caller
    assert plain.where("size(citations) = 0 and size(chunks_used) = 0").count() == 50
    assert seen() == []
    stored = lambda q: encode_once(q, str(tmp_path / "v"), factory)
    assert answer_batch(asked, index, encode=stored).count() == 100 and len(seen()) == 20
    assert answer_batch(asked, index, encode=stored).count() == 100 and seen() == []


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_index_changes_in_part(spark, tmp_path, counted):
    factory, seen = counted
    path, store = str(tmp_path / "index"), str(tmp_path / "v")
    encode = lambda r: encode_once(r, store, factory)
    rows = [{"chunk_id": i, "source_pdf": ["BNS", "BNSS"][i % 2], "section_number": i, "section_title": "T", "content": f"text of {i}"} for i in range(1, 9)]
    rows += [{"chunk_id": 20, "source_pdf": "BNSS", "schedule": "Second Schedule", "form_number": 7, "form_title": "Bond", "content": "bond"}, {"chunk_id": 30, "source_pdf": "BNSS", "table": "Table II", "rule": "If punishable"}]
    assert build_index(chunks(spark, rows), path, encode) == 10
    assert len(seen()) == 10
    before = files(path)
    assert update_index(chunks(spark, rows), path, encode) == [] and files(path) == before
    rows[1]["content"] = "amended"
    assert update_index(chunks(spark, rows), path, encode) == [("BNS", "section")]
    kept = {f for f in before if "source_pdf=BNS/" not in f}
    assert kept < files(path) and not (before - kept) & files(path)
    assert len(seen()) == 1  # the others' vectors were in the store
    rows = [r for r in rows if r["chunk_id"] not in (20, 3)] + [{"chunk_id": 40, "source_pdf": "New", "section_number": 1, "content": "a new source"}]
    assert update_index(chunks(spark, rows), path, encode) == [("BNSS", "form"), ("BNSS", "section"), ("New", "section")]
    now = spark.read.parquet(path)
    want = {(r["chunk_id"], r["document"], len(r["embedding"])) for r in V.embed_batches(index_records(chunks(spark, rows)), factory=factory).collect()}
    assert {(r["chunk_id"], r["document"], len(r["embedding"])) for r in now.collect()} == want
    assert not os.path.isdir(f"{path}/source_pdf=BNSS/chunk_type=form")
