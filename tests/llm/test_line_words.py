"""Texts are split into words once; bitmaps of line numbers; bitmaps of a line's words."""

from pyspark.sql import functions as F
from sectionspark.llm import line_dedup


def test_words_are_split_once(make_docs, odd_rows, monkeypatch):
    plans, stored = {}, line_dedup.stored

    def planned(df, name, *args, **options):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stored(df, name, *args, **options)

    monkeypatch.setattr(line_dedup, "stored", planned)
    line_dedup.dedup_lines(make_docs(odd_rows))
    assert [name for name, plan in plans.items() if "lower(" in plan] == ["lines"]
    # a row for a word doesn't compute the line's bitmap again
    above = plans["candidates"].split("Generate")[0]
    assert "Generate" in plans["candidates"] and "aggregate(" not in above


def test_among(spark, monkeypatch):
    numbers = [0, 1, 7, 8, 32_767, 32_768, 32_769, (5 << 33), (5 << 33) + 40_000]
    lines = spark.createDataFrame([(u, "x") for u in numbers], "u long, t string")
    ids = lines.where(F.col("u").isin(numbers[1::2])).select("u")
    for most in (line_dedup.BROADCAST_LINES, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
        assert sorted(r.u for r in line_dedup._among(lines, ids).collect()) == numbers[1::2]
        assert sorted(r.u for r in line_dedup._among(lines, ids, within=False).collect()) == numbers[::2]
        assert line_dedup._among(lines, ids.limit(0), within=False).count() == len(numbers)
