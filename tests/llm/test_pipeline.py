"""The pipeline's stages against what each should keep."""

from collections import Counter

import corpus_pipeline as P
from sectionspark.llm import language_id, line_dedup, minhash, mixing, queries
from pyspark.sql import functions as F


def test_stages(spark, make_docs, odd_rows, tmp_path):
    rows = [r for r in odd_rows if r[0] != 87]
    docs, columns, kept = make_docs(rows), make_docs([]).columns, []
    kept.append(docs)
    for n, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path / str(n))
        stage(spark, kept[-1], "").write.parquet(path)
        kept.append(spark.read.parquet(path))
    assert all(d.columns == columns for d in kept[:-1])
    ids = [Counter(r[0] for r in d.select("doc_id").collect()) for d in kept]
    # language: only null texts, texts without a letter and texts of no learned language go
    bits = {r["doc_id"]: r["lang_bits"] for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert ids[1] == Counter(i for i, t, *_ in rows if any(map(str.isalpha, t or "")) and bits[i] <= P.MOST_BITS)
    assert set(ids[0]) - set(ids[1]) == {80, 81, 82, 84, 85} and bits[84] > P.MOST_BITS  # 84: letters that no other text has
    # lines: all documents stay, with the operator's texts and their lengths
    assert ids[2] == ids[1]
    want = {(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(kept[1]).collect()}
    assert {(r["doc_id"], r["text"]) for r in kept[2].collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept[2].collect())
    # near-duplicates: one of each class, and rows without an id
    classes = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(kept[2]).collect()}
    assert set(ids[3]) - {None} == {i for i, c in classes.items() if i == c} and ids[3][None] == ids[2][None]
    # mixing: each row as often as the mix takes it
    times = {r["doc_id"]: r["repeats"] for r in mixing.mix(kept[3], F.array("source"), queries.weights_5_2_1).collect()}
    assert ids[4] == Counter({i: n * times[i] for i, n in ids[3].items() if times[i]})
    # packing: each row's tokens once
    tokens = {r["doc_id"]: r["doc_tokens"] for r in kept[5].collect()}
    packed = Counter()
    for r in kept[5].collect():
        packed[r["doc_id"]] += r["length"]
    assert packed == Counter({i: n * tokens[i] for i, n in ids[4].items()})


def test_empty_table(spark, make_docs, tmp_path):
    docs = make_docs([])
    for n, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
    assert docs.count() == 0
