"""Search, pins, ranking, records and evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectionspark.operators import evaluate as E
from sectionspark.operators import rank as R
from sectionspark.operators.retrieve import merge_candidates, pins, with_intent
from sectionspark.operators.search import cosine_topk, embed_batches, no_hit_answers, similarity_percent

INDEX = "chunk_id long, source_pdf string, chunk_type string, section_number int, form_number int, bns_section string"


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        (1, "BNS", "section", 103, -1, ""), (2, "BNS", "section", 103, -1, ""), (3, "BNS", "section", 302, -1, ""), (4, "BNSS", "section", 302, -1, ""), (5, "BNS", "form", -1, 7, ""),
        (6, "BNSS", "table1", -1, -1, "302(1)"), (7, "BNSS", "table1", -1, -1, "3021"), (8, "BNSS", "table2", -1, -1, ""), (9, "BNSS", "table1", -1, -1, "302"),
    ]
    return spark.createDataFrame(rows, INDEX)


def test_pins_and_merge(spark, index):
    asked = [(1, "form 7"), (2, "form 99 of section 302"), (3, "Is section 302 bailable?"), (4, "BNS 103"), (5, "no hits section 302"), (6, "weather"), (7, "Is form 7 about bail?")]
    asked = with_intent(spark.createDataFrame(asked, "query_id long, question string"))
    hits = spark.createDataFrame([(q, c, 0.1 * c) for q in (1, 2, 3, 4, 6, 7) for c in (4, 2)], "query_id long, chunk_id long, distance double")
    pinned = pins(asked, index, hits)
    got = sorted((r["query_id"], r["chunk_id"], r["pin"]) for r in pinned.collect())
    assert got == [(1, 5, "primary"), (2, 1, "primary"), (2, 3, "secondary"), (3, 1, "primary"), (3, 3, "secondary"), (3, 6, "secondary"), (3, 8, "table2"), (3, 9, "secondary"), (4, 1, "primary"), (7, 5, "primary"), (7, 8, "table2")]
    merged = merge_candidates(hits, pinned).where("query_id = 3").orderBy("pos").collect()
    assert [r["chunk_id"] for r in merged] == [1, 2, 4, 8, 3, 6, 9] and [r["secondary_no"] for r in merged] == [None, None, None, None, 1, 2, 3]


def scored(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "query_id long, chunk_id long, pos int, rerank_score double, is_primary boolean, secondary_no int")


@pytest.mark.parametrize(("primary", "secondary", "k", "want"), [
    (None, (), 3, [1, 2, 3]), (2, (), 3, [1, 2, 3]), (6, (), 3, [6, 1, 2]), (6, (5, 4), 3, [5, 6, 1]), (1, (5, 4), 3, [5, 1, 2]), (1, (5, 2), 3, [1, 2, 3]), (6, (5,), 1, [5]), (6, (), 1, [6]), (None, (), 9, [1, 2, 3, 4, 5, 6]),
])
def test_guarantees(spark, primary, secondary, k, want):
    rows = [(c, c, 1.0 - c // 2 * 0.1, c == primary, secondary.index(c) + 1 if c in secondary else None) for c in range(1, 7)]
    got = R.guaranteed_top(scored(spark, rows), k).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == want and [r["rank"] for r in got] == list(range(1, len(want) + 1))


def test_topk_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)).round(1)
    x[7], x[8], x[9] = x[3], 0, x[3]
    source = [str(i % 3) for i in range(300)]
    df = spark.createDataFrame([(i, [float(v) for v in r], s) for i, (r, s) in enumerate(zip(x, source))] + [(999, None, "0")], "chunk_id long, embedding array<double>, source string")
    asked = df.where("chunk_id % 10 = 3").select(F.col("chunk_id").alias("query_id"), "embedding", F.when(F.col("chunk_id") % 20 == 3, F.lit("1")).alias("source_filter"))
    got: dict = {}
    for r in cosine_topk(asked, df, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    n = np.linalg.norm(x, axis=1)
    for q, ids in got.items():
        d = 1 - x @ x[q] / np.where(n == 0, np.nan, n) / n[q]
        ok = [i for i in range(300) if n[i] > 0 and (q % 20 != 3 or source[i] == "1")]
        assert ids == sorted(ok, key=lambda i: (round(d[i], 12), i))[:5]
    # a form with built-in functions only
    built_in = asked.crossJoin(df.where("chunk_id < 300")).count()
    assert built_in == 30 * 300


def test_encoder_scores_and_records(spark):
    docs = spark.createDataFrame([(1, "murder and theft"), (2, ""), (3, None)], "chunk_id long, document string")
    got = embed_batches(docs).collect()
    assert len(got[0]["embedding"]) == 384 and sum(got[2]["embedding"]) == sum(got[1]["embedding"])
    rows = spark.createDataFrame([(1, 1, "q of murder", "q of murder", "murder", "section", "BNS", 103, "Murder", "", 0, "", 0.0, 1), (1, 2, "q of murder", "q of murder", "x", "section", "BNS", 103, "Murder", "", 0, "", 0.0, 2)],
        "query_id long, chunk_id long, question string, query_used string, document string, chunk_type string, source_pdf string, section_number int, section_title string, bns_section string, form_number int, form_title string, distance double, rank int")
    assert [round(r["rerank_score"], 3) for r in R.score_pairs(rows).orderBy("chunk_id").collect()] == [0.333, 0.0]
    custom = R.score_pairs(rows, lambda: lambda a, b: [len(y) for y in b])
    assert {r["rerank_score"] for r in custom.collect()} == {6.0, 1.0}
    record = R.answer_records(custom, generate=lambda: lambda prompts: [str(len(p)) for p in prompts]).first()
    assert record["citations"] == ["BNS Section 103 — Murder"] and len(record["chunks_used"]) == 2 and int(record["answer"]) > 500
    assert "[1] BNS Section 103 — Murder\nmurder\n\n---\n\n[2]" in R.prompts(rows).first()["context"]
    none = no_hit_answers(spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, query_used string"), rows)
    assert [r["query_id"] for r in none.collect()] == [2]
    assert [r[0] for r in spark.createDataFrame([(0.20005,), (0.75,)], "d double").select(similarity_percent(F.col("d"))).collect()] == [80.0, 25.0]


def test_answer_checks(spark):
    rows = [(1, "Could Not Generate it at all", ["x"]), (2, "short", []), (3, "The punishment is DEATH or more", ["death"]), (4, "a long enough answer here", ["murder", "103"]), (5, None, ["x"])]
    got = {r["case_id"]: r["reason"] for r in E.check_answers(spark.createDataFrame(rows, "case_id long, answer string, keywords array<string>")).collect()}
    assert got == {1: "blocked", 2: "too short", 3: "", 4: "missing: murder, 103", 5: "too short"}
    scores = E.score_by(spark.createDataFrame([("a", True), ("a", False), ("b", True)], "c string, passed boolean"), "c").collect()
    assert {(r["c"], r["percent"], r["band"]) for r in scores} == {("a", 50, "poor"), ("b", 100, "good"), (None, 66, "fair")}


def test_stream_of_questions(spark, tmp_path):
    from sectionspark.operators.answer import answer_batch
    from sectionspark.operators.corpus import index_records
    from sectionspark.sources.tables import CHUNKS
    from sectionspark.streaming.answers import answer_stream

    empty = spark.createDataFrame([], CHUNKS)
    chunk = spark.createDataFrame([(1, "BNS", 103, "Murder", "whoever commits murder")], "chunk_id long, source_pdf string, section_number int, section_title string, content string")
    index = embed_batches(index_records(empty.unionByName(chunk, allowMissingColumns=True)))
    spark.createDataFrame([(1, "IPC 302"), (2, "x")], "query_id long, question string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, question string").parquet(str(tmp_path / "in"))
    answer_stream(stream, lambda b: answer_batch(b, index), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = {r["query_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {1, 2} and got[1]["query_used"].startswith("IPC 302 BNS Section 103 murder") and got[1]["citations"] == ["BNS Section 103 — Murder"]


def test_batch_answers_by_hand(spark):
    """The whole job against a plain walk over its steps, with a filter, pins and a miss."""
    from sectionspark.operators.answer import answer_batch
    from sectionspark.operators.corpus import index_records
    from sectionspark.sources.tables import CHUNKS

    names = CHUNKS.replace("`", "").split(", ")
    fields = [n.split(" ")[0] for n in names]
    chunks = [
        {"chunk_id": 1, "source_pdf": "BNS", "section_number": 103, "section_title": "Murder", "content": "whoever commits murder"}, {"chunk_id": 2, "source_pdf": "BNS", "section_number": 303, "section_title": "Theft", "content": "whoever commits theft"},
        {"chunk_id": 3, "source_pdf": "BNSS", "section_number": 173, "section_title": "Information", "content": "information report to the police station"}, {"chunk_id": 4, "source_pdf": "BNSS", "table": "Table II", "rule": "If punishable with death"},
        {"chunk_id": 5, "source_pdf": "BNSS", "schedule": "Second Schedule", "form_number": 7, "form_title": "Bond", "content": "bond"},
    ]
    rows = index_records(spark.createDataFrame([tuple(c.get(f) for f in fields) for c in chunks], CHUNKS))
    index = embed_batches(rows).cache()
    asked = [(1, "What replaced IPC Section 302?", None), (2, "theft", "BNSS"), (3, "Is section 302 bailable?", None), (4, "form 7", "BNS"), (5, "anything", "no such source"), (6, "theft", None)]
    out = {r["query_id"]: r for r in answer_batch(spark.createDataFrame(asked, "query_id long, question string, source_filter string"), index, fetch_k=2, keep_k=3, generate=lambda: lambda prompts: [p[-80:] for p in prompts], model="m").collect()}
    assert set(out) == {1, 2, 3, 4, 5, 6} and {r["model_used"] for r in out.values()} == {"m"}
    assert out[1]["query_used"] == "What replaced IPC Section 302? BNS Section 103 murder Indian Penal Code" and out[1]["citations"][0] == "BNS Section 103 — Murder"
    assert {c["chunk_id"] for c in out[2]["chunks_used"]} <= {3, 4, 5} and "BNSS Section 173 — Information" in " ".join(out[2]["citations"]) or len(out[2]["chunks_used"]) == 2
    assert 1 in {c["chunk_id"] for c in out[3]["chunks_used"]} and len(out[3]["chunks_used"]) == 3  # the famous section
    assert 5 in {c["chunk_id"] for c in out[4]["chunks_used"]}  # a look-up ignores the filter
    assert out[5]["answer"].startswith("No relevant legal sections") and out[5]["chunks_used"] == [] and out[5]["citations"] == []
    assert out[6]["chunks_used"][0]["chunk_id"] == 2 and out[6]["answer"].endswith("Cite section numbers.")
