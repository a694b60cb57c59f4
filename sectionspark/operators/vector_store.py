"""Vectors of texts that are encoded once: a table keyed by the text's digest and the encoder's
version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectionspark.operators.search import embed_batches, hashed_encoder

STORE = "digest binary, embedding array<float>, version string"


def text_digest(text: Column) -> Column:
    """SHA-256; a null text counts as empty, as it does for the encoder."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def encode_once(rows: DataFrame, path: str, factory: Callable = hashed_encoder, version: str = "hashed-trigrams-384", text_col: str = "document") -> DataFrame:
    """V1: rows with ``embedding``. Texts that the store at ``path`` (Parquet folders by version)
    lacks are encoded, each distinct one once, and appended before this returns; what reads the
    result reads vectors and never encodes. ``version`` must change with whatever changes a
    vector. Other versions' vectors stay. A text appended by two jobs at once counts once."""
    spark = rows.sparkSession
    spark.createDataFrame([], STORE).write.mode("append").parquet(path)  # so that there is a store
    known = lambda: spark.read.schema(STORE).parquet(path).where(F.col("version") == version)
    keyed = rows.withColumn("_digest", text_digest(F.col(text_col)))
    texts = keyed.groupBy(F.col("_digest").alias("digest")).agg(F.coalesce(F.min(text_col), F.lit("")).alias("text"))
    missing = texts.join(known().select("digest"), "digest", "left_anti")
    encoded = embed_batches(missing, "text", factory).select("digest", "embedding", F.lit(version).alias("version"))
    encoded.write.mode("append").partitionBy("version").parquet(path)
    vectors = known().groupBy("digest").agg(F.first("embedding").alias("embedding"))
    return keyed.join(vectors.withColumnRenamed("digest", "_digest"), "_digest").drop("_digest")
