"""The registered queries, with their parameters, against plain walks over the given tables."""

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sectionspark.llm import queries

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def documents(spark, path=SMALL):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{path}/documents.parquet").collect()}


def test_op1(spark):
    docs = documents(spark)
    lines = [(i, p, line, frozenset(line.lower().split())) for i, r in docs.items() for p, line in enumerate((r["text"] or "").split("\n"))]
    lines.sort(key=lambda x: x[:2])
    kept, seen = defaultdict(list), []
    for i, p, line, words in lines:
        if not any(words and len(words & other) * 180 >= (len(words) + len(other)) * 80 for other in seen):
            kept[i].append(line)
        seen.append(words)
    for r in queries.op1_line_dedup(spark, SMALL).collect():
        text = docs[r["doc_id"]]["text"]
        assert r["text"] == (None if text is None else "\n".join(kept[r["doc_id"]]))
        assert r["n_lines"] - r["n_removed"] == len(kept[r["doc_id"]]) or text is None


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"create view {table} as select * from '{LARGER}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, LARGER)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, (tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())))


def vectors(spark):
    rows = spark.read.parquet(f"{LARGER}/embeddings.parquet").collect()
    return {r["vec_id"]: (np.array(r["embedding"], float), r["label"]) for r in rows if r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])}


def test_op2(spark):
    good = vectors(spark)
    ids = np.array(sorted(good))
    x = np.stack([good[i][0] for i in ids])
    got = defaultdict(list)
    for r in queries.op2_nearest_neighbours(spark, LARGER).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids if i % 100 == 0}
    found = 0
    for q, rows in got.items():
        d = np.sqrt(((x - good[q][0]) ** 2).sum(1))
        best = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert [r[0] for r in rows] == list(range(1, 11)) and all(s == pytest.approx(d[np.searchsorted(ids, v)], rel=1e-12) for _, v, s in rows)
        found += len({v for _, v, _ in rows} & set(ids[best].tolist()))
    assert found >= 0.9 * 10 * len(got)


def test_op3(spark):
    docs = documents(spark, LARGER)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in docs.items()}
    of = defaultdict(int)
    for i, r in docs.items():
        of[r["source"]] += size[i]
    order = sorted(of, key=lambda s: (s is None, s or ""))
    weight, target, left, open_ = dict(zip(order, (5, 2, 1) * len(order))), {}, sum(of.values()), set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > 3 * of[s]}
        target |= {s: 3 * of[s] if over else weight[s] * unit for s in over or open_}
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    taken = defaultdict(int)
    for r in queries.op3_mixing(spark, LARGER).collect():
        s = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], of[s]) and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 1 for s in order)


def test_op4(spark):
    docs, shards = documents(spark, LARGER), defaultdict(list)
    for r in queries.op4_histogram_sort(spark, LARGER).collect():
        raw = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        shards[r["shard"]].append((r["slot"], r["size"], r["text_crc32"]))
    assert set(shards) == set(range(24)) and all([s for s, *_ in sorted(v)] == list(range(len(v))) for v in shards.values())
    bytes_ = [sum(n for _, n, _ in v) for v in shards.values()]
    biggest = max(n for v in shards.values() for _, n, _ in v)
    assert max(bytes_) - min(bytes_) <= 0.03 * np.mean(bytes_) + biggest


def test_op5_rows(spark):
    docs = documents(spark, LARGER)
    rows = queries.op5_minhash_dedup(spark, LARGER).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(docs.keys())
    classes = defaultdict(set)
    for r in rows:
        classes[r["class_id"]].add(r["doc_id"])
        assert r["kept"] == (r["doc_id"] == r["class_id"])
    assert all(c == min(members) for c, members in classes.items())
    words, of = defaultdict(set), {r["doc_id"]: r["class_id"] for r in rows}
    for i, r in docs.items():
        words[" ".join(re.findall(r"\w+", (r["text"] or "").lower()))].add(of[i])
    assert all(len(c) == 1 for text, c in words.items() if text)  # copies share a class


def test_op6(spark):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = documents(spark)
    rows = queries.op6_token_counts(spark, SMALL).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(docs.keys())
    for r in rows:
        text = docs[r["doc_id"]]["text"] or ""
        n = len(library.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_op7(spark):
    good, every = vectors(spark), [r[0] for r in spark.read.parquet(f"{LARGER}/embeddings.parquet").select("vec_id").collect()]
    ids = [i for i in sorted(good) if good[i][1] is not None]
    x = np.stack([good[i][0] / np.linalg.norm(good[i][0]) for i in ids])
    label = np.array([good[i][1] for i in ids])
    close = (x @ x.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(ids), dtype=bool)
    rows = {r["vec_id"]: r for r in queries.op7_pivot_dedup(spark, LARGER).collect()}
    assert set(rows) == set(every)
    want = dict(zip(ids, close.sum(1).tolist()))
    assert all(r["n_links"] <= want.get(i, 0) and r["kept"] == (r["component_id"] == i) for i, r in rows.items())
    assert sum(r["n_links"] for r in rows.values()) >= 0.9 * close.sum()


def test_op10(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library, docs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), documents(spark)
    ids = {i: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for i, r in docs.items()}
    at, held = defaultdict(int), defaultdict(list)
    for r in sorted(queries.op10_hilbert_packing(spark, SMALL).collect(), key=lambda r: (r["doc_id"], r["start"])):
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids[r["doc_id"]]) and zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
        at[r["doc_id"]] += r["length"]
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert at == {i: len(v) for i, v in ids.items()}
    for s, pieces in held.items():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]] and (sum(n for _, n in pieces) == 2048 or s == max(held))
