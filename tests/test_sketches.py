"""Sketches beside the corpus: merged on append, replaced by part, exact for few keys."""

from pyspark.sql import functions as F

from sectionspark.operators import sketches as H

SCHEMA = "chunk_id long, source_pdf string, chunk_type string, section_number int, definition_term string, compounding_section string, bns_section string, content string, part string"


def chunks(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def section(i, number, source="BNS", content=None):
    return (i, source, "section", number, None, None, None, content, "clashing")


def counted(spark, path):
    return {(r["path"], r["source_pdf"]): r["estimate"] for r in H.sketched_counts(H.read_sketches(spark, path)).collect()}


def test_loads_are_merged_and_counted_once(spark, tmp_path):
    path = str(tmp_path / "sketches")
    first = chunks(spark, [section(1, 5), section(2, 5), section(3, 6), section(4, None, content="x"), section(5, 7, None)])
    second = chunks(spark, [section(6, 6), section(7, 8), (8, "BNS", "table1", None, None, None, "103(1)", "", "p"), (9, "BNS", "table1", None, None, None, "Attempt", None, "p")])
    for _ in range(2):
        H.write_sketches(first, path, F.lit("a"))
    assert counted(spark, path) == {("any section", "BNS"): 2, ("section", "BNS"): 2, ("content", "BNS"): 1, ("any section", None): 1, ("section", None): 1}
    H.write_sketches(second, path, F.lit("b"))
    got = counted(spark, path)
    assert got[("any section", "BNS")] == 3 and got[("table1", "BNS")] == 1 and ("definition", "BNS") not in got
    compared = H.counts_compared(first.union(second), H.read_sketches(spark, path)).collect()
    assert len(compared) == len(got) and all(r["within"] for r in compared)


def test_a_part_that_lost_chunks(spark, tmp_path):
    path = str(tmp_path / "sketches")
    folder = F.concat_ws("/", "source_pdf", "chunk_type")
    H.write_sketches(chunks(spark, [section(i, i) for i in range(1, 9)] + [section(9, 9, "BNSS")]), path, folder)
    H.write_sketches(chunks(spark, [section(1, 1)]), path, folder)
    assert counted(spark, path) == {("any section", "BNS"): 1, ("section", "BNS"): 1, ("any section", "BNSS"): 1, ("section", "BNSS"): 1}


def test_many_keys_stay_within_the_error(spark, tmp_path):
    path = str(tmp_path / "sketches")
    many = spark.range(60_000).select(F.col("id").alias("chunk_id"), F.lit("BNS").alias("source_pdf"), F.lit("form").alias("chunk_type"), *[F.lit(None).cast(t).alias(n) for n, t in (("section_number", "int"), ("definition_term", "string"), ("compounding_section", "string"), ("bns_section", "string"))], F.concat(F.lit("text "), F.col("id") % 30_000).alias("content"))
    H.write_sketches(many, path, F.concat(F.lit("load-"), F.col("chunk_id") % 7))
    assert abs(counted(spark, path)[("content", "BNS")] - 30_000) <= H.relative_error() * 30_000
    few = H.counts_compared(many, H.read_sketches(spark, path).where("part = 'load-0'")).collect()
    assert [(r["exact"], r["within"]) for r in few] == [(30_000, False)]


def test_nothing(spark, tmp_path):
    path = str(tmp_path / "sketches")
    H.write_sketches(chunks(spark, []), path, F.lit("a"))
    assert H.sketched_counts(H.read_sketches(spark, path)).count() == 0
