"""Every registered query with SQL gives what DuckDB gives, on the smallest tables; queries that
rest on ties of distances or costs on larger ones too."""

import os

import duckdb
import pytest

from sectionspark.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return int(value) if isinstance(value, bool) else value


LARGER = DATA.replace("0.001", "0.01")


def same(spark, data, name):
    duck = duckdb.connect()
    for file in os.listdir(data):
        duck.sql(f"create view {file.split('.')[0]} as select * from '{data}/{file}'")
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_same_as_duckdb(spark, name):
    same(spark, DATA, name)


@pytest.mark.parametrize("name", ["batch_answers", "cosine_top20", "cosine_top10_filtered", "written_index"])
def test_same_on_larger_tables(spark, name):
    same(spark, LARGER, name)


@pytest.mark.parametrize("partitions", ["1", "64"])
def test_answers_for_any_number_of_partitions(spark, partitions):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        same(spark, DATA, "batch_answers")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_others_run(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, DATA).count() > 0
    assert registry.entry(spark, DATA).count() > 0
