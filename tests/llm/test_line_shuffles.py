"""Small tables aren't dealt out into a file for each task and partition; codes sort as numbers."""

import pytest
from pyspark.sql import functions as F
from sectionspark.llm import line_dedup

NAME = "spark.sql.shuffle.partitions"


@pytest.mark.parametrize(("own", "inside"), [("200", {"256"}), ("4", {"4"})])
def test_partitions(spark, make_docs, monkeypatch, own, inside):
    seen, stored = set(), line_dedup.stored

    def noted(df, *args, **options):
        seen.add(spark.conf.get(NAME))
        return stored(df, *args, **options)

    monkeypatch.setattr(line_dedup, "stored", noted)
    before = spark.conf.get(NAME)
    try:
        spark.conf.set(NAME, own)
        out = line_dedup.dedup_lines(make_docs([(1, "a b c\nd e", "en", "s"), (2, "c b a\nf", "en", "s")]))
        assert seen == inside and spark.conf.get(NAME) == own
        assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "a b c\nd e"), (2, "f")]
    finally:
        spark.conf.set(NAME, before)


def test_partitions_after_an_error(spark, make_docs):
    before = spark.conf.get(NAME)
    try:
        spark.conf.set(NAME, "200")
        with pytest.raises(Exception, match="absent"):
            line_dedup.dedup_lines(make_docs([(1, "a", "en", "s")]), text_col="absent")
        assert spark.conf.get(NAME) == "200"
    finally:
        spark.conf.set(NAME, before)


def test_codes_are_never_null(spark):
    ranks = ",".join(["7"] * line_dedup.COUNTERS)
    codes = spark.createDataFrame([("b a",)], "line string").select(line_dedup._codes(F.col("line"), ranks).alias("c"))
    assert not codes.schema["c"].dataType.containsNull
    assert [c >> 56 for c in codes.first().c] == [7, 7]
