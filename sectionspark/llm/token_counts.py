"""Operator 6, token counts behind a cache of content digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionspark.llm.scratch import bound_batches, new_path, stored

CACHE_SCHEMA = "digest binary, version string, n_tokens bigint"
#: Up to so many misses (8 bytes each) their ids are broadcast; more are joined by a shuffle.
BROADCAST_MISSES = 2_000_000


class SentencePieceCounter:
    """Counts the ids of whole texts; the model is loaded once in each worker."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model_file = model_file
        with open(model_file, "rb") as f:
            self.version = hashlib.sha256(f.read() + sentencepiece.__version__.encode()).hexdigest()[:32]

    def __call__(self, texts: list[str]) -> list[int]:
        if not hasattr(self, "_model"):
            import sentencepiece

            self._model = sentencepiece.SentencePieceProcessor(model_file=self.model_file)
        encode = self._model.encode
        return [len(encode(t)) for t in texts]

    def __getstate__(self):
        return {"model_file": self.model_file, "version": self.version}


def token_counts(docs: DataFrame, counter: Callable, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows (id column) with n_bytes, n_tokens and the content digest.

    counter: counts a list of whole texts and has a ``version`` that changes with whatever
    can change a count. Content is normalised only as far as no count can change: null
    becomes the empty text. Its SHA-256 digest is joined with the version to the cache at
    ``cache_path`` (a Parquet folder; by default a new one in the shared folder); each digest
    that is missing there is encoded once and appended. A rerun after a failure finds what
    was appended; a digest appended twice by two runs at once counts once. Equal texts share
    one encoding. Repeated and null ids are rows like others, each with its own counts; a very
    long text is encoded whole by one task. An empty table gives an empty result; other columns
    of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = cache_path or new_path(spark, "token-cache")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col), F.octet_length(text).cast("bigint").alias("n_bytes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    empty = spark.createDataFrame([], CACHE_SCHEMA)
    empty.write.mode("append").parquet(path)
    cache = lambda: spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("version") == counter.version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    # one row of the table stands for each missing digest; ids may repeat or be null
    spot = F.struct(F.xxhash64(F.col(id_col), F.col("digest")).alias("spot"))
    # grouped before the join, so a digest of many rows is one row there
    misses = keyed.groupBy("digest").agg(F.min(spot)["spot"].alias("spot")).join(cache(), "digest", "left_anti")
    misses = stored(misses.select("spot"), "token-misses")
    if misses.count() <= BROADCAST_MISSES:
        misses = F.broadcast(misses)
    todo = keyed.withColumn("spot", F.xxhash64(F.col(id_col), F.col("digest"))).join(misses, "spot", "left_semi").select("digest", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # rows equal in id and text meet here or, at worst, are encoded twice
        for batch in batches:
            digests, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            new = {d: t for d, t in zip(digests, texts) if d not in seen}
            seen = seen | new.keys() if len(seen) < 100_000 else set(new)
            counts = counter(list(new.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array([counter.version] * len(new), pa.string()), pa.array(counts, pa.int64())], names=["digest", "version", "n_tokens"])

    todo.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(path)
    return keyed.drop("text").join(cache(), "digest").select(id_col, "n_bytes", "n_tokens", "digest")
