"""Equal questions with one filter are answered once."""

from uuid import uuid4

from sectionspark.operators.answer import answer_batch
from sectionspark.operators.corpus import index_records
from sectionspark.operators.search import embed_batches
from sectionspark.sources.tables import CHUNKS


def test_equal_questions_share_an_answer(spark):
    chunk = spark.createDataFrame([(1, "BNS", 103, "Murder", "whoever commits murder")], "chunk_id long, source_pdf string, section_number int, section_title string, content string")
    index = embed_batches(index_records(spark.createDataFrame([], CHUNKS).unionByName(chunk, allowMissingColumns=True)))
    asked = [(q, "IPC 302", None) for q in range(5)] + [(q, "IPC 302", "BNS") for q in (5, 6)] + [(7, None, None), (8, None, None), (9, "IPC 302", "none such")]
    rows = spark.createDataFrame(asked, "query_id long, question string, source_filter string")
    out = {r["query_id"]: r for r in answer_batch(rows, index, generate=lambda: lambda prompts: [uuid4().hex for _ in prompts]).collect()}
    assert set(out) == set(range(10))
    assert len({out[q]["answer"] for q in range(5)}) == 1 and len({out[q]["answer"] for q in range(7)}) == 2
    assert all(out[q]["citations"] == ["BNS Section 103 — Murder"] for q in range(7))
    assert out[7][1:] == out[8][1:]
    assert out[9]["answer"].startswith("No relevant legal sections") and out[9]["chunks_used"] == []
