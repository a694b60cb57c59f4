"""Distinct counts kept beside a corpus: small mergeable sketches, so that appended or replaced
chunks don't mean another pass over all of it."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Logarithm of the registers of a sketch: 4096, so 4 KB for each part, source and path.
REGISTERS = 12


def relative_error(registers: int = REGISTERS, sigmas: int = 3) -> float:
    """The relative error that a merged sketch's count stays within (three standard errors of
    HyperLogLog: for 99.7 % of counts)."""
    return sigmas * 1.03896 / sqrt(2**registers)


def counted_keys(chunks: DataFrame) -> DataFrame:
    """What is counted: path, source_pdf, key and part, a row for each chunk and path it is on:
    sections (E6), what tests should cover (E12: plain sections, table rows and definitions)
    and contents. chunks: rows with chunk_type and part."""
    c = F.col
    plain = (c("chunk_type") == "section") & (F.coalesce("definition_term", F.lit("")) == "") & (F.coalesce("compounding_section", F.lit("")) == "")
    base = F.substring_index("bns_section", "(", 1)
    number = c("section_number").cast("string")
    keys = {
        "any section": number, "section": F.when(plain, number),
        "table1": F.when((c("chunk_type") == "table1") & base.rlike("^[0-9]+$"), base),
        "definition": F.nullif("definition_term", F.lit("")), "content": F.nullif("content", F.lit("")),
    }
    on = F.explode(F.array(*[F.struct(F.lit(path).alias("path"), key.alias("key")) for path, key in keys.items()]))
    return chunks.select("part", "source_pdf", on.alias("on")).select("part", "source_pdf", "on.*").where("key is not null")


def write_sketches(chunks: DataFrame, path: str, part: Column, registers: int = REGISTERS) -> None:
    """Adds to the table of sketches at ``path`` a sketch for each part, source and path.

    ``part`` names what is replaced together: the load that brought the chunks, or the folder of
    the index that they lie in. Parts that occur in ``chunks`` are written anew and all others
    stay, so a load that is run again, as after a lost driver, counts once, and a folder that lost
    chunks is right again. Chunks without a key add nothing, and a part whose chunks all have
    none keeps the sketches it had. Tasks send sketches, not keys, to the shuffle.
    """
    made = counted_keys(chunks.withColumn("part", part)).groupBy("part", "source_pdf", "path").agg(F.hll_sketch_agg("key", registers).alias("sketch"))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("source_pdf string, path string, sketch binary, part string").parquet(path)


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """path, source_pdf and estimate, over all parts; a null source is a source of its own."""
    return sketches.groupBy("path", "source_pdf").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def exact_counts(chunks: DataFrame) -> DataFrame:
    """path, source_pdf and exact: the same counts by a shuffle of all keys."""
    keys = counted_keys(chunks.withColumn("part", F.lit(None).cast("string")))
    return keys.groupBy("path", "source_pdf").agg(F.countDistinct("key").alias("exact"))


def counts_compared(chunks: DataFrame, sketches: DataFrame, registers: int = REGISTERS) -> DataFrame:
    """path, source_pdf, exact, and whether the sketches' estimate is within ``relative_error``."""
    both = exact_counts(chunks).withColumn("estimate", F.lit(None).cast("bigint")).unionByName(sketched_counts(sketches).withColumn("exact", F.lit(None).cast("bigint")))
    counts = both.groupBy("path", "source_pdf").agg(F.coalesce(F.max("exact"), F.lit(0)).alias("exact"), F.coalesce(F.max("estimate"), F.lit(0)).alias("estimate"))
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.lit(relative_error(registers)) * F.col("exact")
    return counts.select("path", "source_pdf", "exact", near.alias("within"))
