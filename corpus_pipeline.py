"""Five stages that make packed training sequences of the documents table.

A stage deletes what earlier stages left in the shared folder, so write each stage's rows
before the next stage begins, as ``run`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectionspark.llm import language_id, line_dedup, minhash, mixing, packing, queries, scratch

#: Kept or dropped ids up to so many are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


#: Bits a byte above which a text is of no learned language: half as many again as raw bytes
#: take. Texts of a learned language take about 3, bytes that no training text held about 25.
MOST_BITS = 12


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: null texts, texts without a letter, and texts of none of
    the learned languages, whose code length is over MOST_BITS a byte under all of them (where
    nothing was learned, texts with a letter stay). Rows are judged one by one, whatever their ids;
    an empty table gives an empty result."""
    scratch.release(spark)
    columns = docs.columns
    model = language_id.train(docs)
    found = language_id.identify(docs, model, keep=columns)
    kept = F.col("text").rlike(r"\p{L}") & (F.coalesce("lang_bits", F.lit(0.0)) <= MOST_BITS)
    return found.where(kept).select(*columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that match an earlier line; every document stays, with what is left, and
    n_chars follows the text. Nulls, long texts, ties, repeated rows and extra columns are met
    as ``line_dedup.dedup_lines`` states; an empty table gives an empty result."""
    scratch.release(spark)
    columns = docs.columns
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in columns:
        n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n_chars)
    return out.select(*columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest id; rows
    without an id come first. Rows that share an id and differ in their texts are different
    documents, rows equal in both are one and stay or go together. Texts without words are
    classes of their own; an empty table gives an empty result."""
    scratch.release(spark)
    classes = scratch.stored(minhash.text_classes(docs), "classes")
    gone = classes.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), "text_digest")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    same = F.col("d.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("d.text") == F.col("text_digest"))
    return docs.alias("d").join(gone, same, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: not at all, once or repeatedly. Rows that
    share an id are taken as the one of them that is taken most; documents without words are
    not taken; a null source is a source of its own; an empty table gives an empty result."""
    scratch.release(spark)
    taken = mixing.mix(docs, F.array("source"), queries.weights_5_2_1).select("doc_id", F.col("repeats").alias("_repeats"))
    taken = scratch.stored(taken.where("_repeats > 0").groupBy("doc_id").agg(F.max("_repeats").alias("_repeats")), "taken")
    if taken.count() <= BROADCAST_IDS:
        taken = F.broadcast(taken)
    out = docs.alias("d").join(taken.withColumnRenamed("doc_id", "_id"), F.col("d.doc_id").eqNullSafe(F.col("_id")))
    return out.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_repeats")))).select(*(F.col(f"d.{c}") for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents, repeated rows as often as they come; returns a row for each piece of
    a sequence. A null text is its end id alone; an empty table gives an empty result."""
    scratch.release(spark)
    import public_tokenizers

    return queries.packed_digest(packing.pack(docs, packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))))


STAGES = [
    ("language id", identify_language),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: SQL can express neither language identification nor the flow or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read by the next one."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stored = scratch.stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}", keep=True)
        if last is not None:
            scratch.dropped(last)
        docs = last = stored
    scratch.release(spark)
    return docs
