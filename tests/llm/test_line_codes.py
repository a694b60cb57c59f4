"""Repeated and empty words fall away above the lambdas, where code is compiled."""

from pyspark.sql import functions as F
from sectionspark.llm import line_dedup


def test_codes(spark):
    ranks = ",".join(["0"] * line_dedup.COUNTERS)
    df = spark.createDataFrame([("a b  a ",), ("b a",), (" ",)], "line string")
    codes = df.select(line_dedup._codes(F.col("line"), ranks).alias("c"))
    a, b, none = (r.c for r in codes.collect())
    assert a == b and len(a) == 2 and none == []
    plan = codes._jdf.queryExecution().analyzed().toString()
    assert plan.index("array_distinct(") < plan.index("transform(")
