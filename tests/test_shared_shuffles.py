"""Scans over lines and ids of the corpus shuffle their rows as seldom as they can."""

import re

from pyspark.sql import functions as F

from sectionspark.operators import chunking as C
from sectionspark.operators.corpus import stamp_ids, union_corpus
from sectionspark.sources import tables as S


def exchanges(df):
    return len(re.findall("Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def no_broadcast(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return was


def test_scans_share_a_shuffle(spark):
    was = no_broadcast(spark)
    try:
        rows = [(d, "BNS", 1, n, f"x{n}") for d in (1, None) for n in range(9)]
        lines = spark.createDataFrame(rows, S.LINES)
        mark = F.when(F.col("line_no") % 4 == 1, F.col("raw"))
        one = C.so_far(lines, {"a": mark}, before=True)
        two = C.so_far(one, {"b": F.col("a")}, {"n": F.lit(1)})
        assert exchanges(one) <= 4 and exchanges(two) <= 10
        got = {(r["doc_id"], r["line_no"]): (r["a"], r["b"], r["n"]) for r in two.collect()}
        last = lambda n: None if n < 1 else f"x{(n - 1) // 4 * 4 + 1}"
        assert got == {(d, n): (last(n - 1), last(n - 1), n + 1) for d in (1, None) for n in range(9)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_ids_share_a_shuffle(spark):
    was = no_broadcast(spark)
    try:
        rows = spark.createDataFrame([(d, p, f"text {p}") for d in (3, 1, None) for p in range(3)], "doc_id long, pos int, content string")
        out = stamp_ids(union_corpus([rows, rows]), ["pos"])
        assert [(r["part_ord"], r["doc_id"], r["pos"]) for r in out.orderBy("chunk_id").collect()] == [(o, d, p) for o in (0, 1) for d in (None, 1, 3) for p in range(3)]
        assert sorted(r["chunk_id"] for r in out.collect()) == list(range(1, 19))
        assert exchanges(out) <= 16
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
