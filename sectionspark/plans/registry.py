"""The registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sectionspark.plans import corpus_queries, evaluation_queries, question_queries

_MODULES = (question_queries, corpus_queries, evaluation_queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question_queries.section_answers(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in _MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
