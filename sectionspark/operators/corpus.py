"""The corpus: all kinds of chunks built from lines and words, with sequential ids; records
and vectors of the index."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectionspark.functions.labels import embed_text, flat_metadata
from sectionspark.operators.chunking import BNS, BNSS, form_chunks, rule_rows, section_chunks
from sectionspark.operators.search import embed_batches
from sectionspark.operators.split import apply_splitters, compounding_chunks
from sectionspark.operators.wordtable import table_rows
from sectionspark.sources.tables import write_index
from sectionspark.sources.workspace import deleted, stored

#: Buckets of documents inside which ids are counted up by one task each.
BUCKETS = 200
# Where the rows of the first table come from.
TABLE1 = {"source_pdf": "BNSS", "schedule": "First Schedule", "table": "Table I — Offences Under the Bharatiya Nyaya Sanhita"}


def union_corpus(parts: list[DataFrame]) -> DataFrame:
    """Parts in order; adds part_ord."""
    marked = [p.withColumn("part_ord", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def stamp_ids(corpus: DataFrame, order: list[str]) -> DataFrame:
    """chunk_id from 1 in the order (part_ord, doc_id, *order), null ids first. Rows are
    numbered inside (part_ord, doc_id); the small table of counts gives each group its offset,
    over documents inside a bucket and then over buckets. Buckets end at quantiles of the ids,
    so they hold like numbers of documents however the ids lie, and no window holds more. The
    corpus is written once, so what makes it doesn't run for the counts and again."""
    corpus = stored(corpus, "corpus")
    group = ["part_ord", "doc_id"]
    counts = corpus.groupBy(*group).agg(F.count("*").alias("n"))
    ends = counts.agg(F.percentile_approx("doc_id", [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS).alias("ends")).withColumn("one", F.lit(1))
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(F.coalesce(F.size(F.filter("ends", lambda e: e <= F.col("doc_id"))), F.lit(0)))
    counts = counts.withColumn("one", F.lit(1)).join(F.broadcast(ends), "one").select(*group, "n", bucket.alias("b"))
    by_bucket = counts.groupBy("part_ord", "b").agg(F.sum("n").alias("n"))  # at most BUCKETS + 1 rows a part
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = by_bucket.select("part_ord", "b", so_far(Window.orderBy("part_ord", "b")).alias("before"))
    inside = counts.withColumn("inside", so_far(Window.partitionBy("part_ord", "b").orderBy("doc_id")))
    offsets = inside.join(F.broadcast(before), ["part_ord", "b"]).select(F.struct(*group).alias("_of"), (F.col("before") + F.col("inside")).alias("_offset"))
    # the group in one column, null ids too: the window and the join share one shuffle of the rows
    numbered = corpus.withColumn("_group", F.struct(*group)).withColumn("_n", F.row_number().over(Window.partitionBy("_group").orderBy(*order)))
    return numbered.join(offsets, F.col("_group") == F.col("_of")).withColumn("chunk_id", F.col("_offset") + F.col("_n")).drop("_n", "_offset", "_group", "_of")


def build_corpus(lines: DataFrame, words: DataFrame | None = None, rule_pages: DataFrame | None = None, form_lines: DataFrame | None = None) -> DataFrame:
    """All chunks with part_ord and chunk_id, in the order BNS sections, BNSS sections,
    compounding rows, first table, second table, forms.

    lines: LINES, optionally with the repaired line as ``fixed``; words: WORDS of the first
    table's pages; rule_pages: doc_id, source, page, text of the second table's pages;
    form_lines: LINES of the forms. Sections go through the splitters; compounding rows take
    their offences from the first table. Nulls and empty texts give no chunk.
    """
    # written, as splitters read them several times
    bns, bnss = (apply_splitters(stored(section_chunks(lines.where(F.col("source") == name), rules), "sections")) for name, rules in (("BNS", BNS), ("BNSS", BNSS)))
    parts = [bns, bnss]
    if words is not None:
        table1 = table_rows(words).withColumns({k: F.lit(v) for k, v in TABLE1.items()}).drop("row")
        at = table1.withColumn("pos", F.struct("doc_id", "pos"))
        parts += [compounding_chunks(bnss.where("section_number = 359"), at), table1]
    parts += [rule_rows(rule_pages)] if rule_pages is not None else []
    parts += [form_chunks(form_lines)] if form_lines is not None else []
    corpus = union_corpus(parts)
    return stamp_ids(corpus, [c for c in ("pos", "part_no", "row_no") if c in corpus.columns])


def index_records(chunks: DataFrame) -> DataFrame:
    """Document and flat metadata of each chunk; vectors come from embed_batches."""
    meta = flat_metadata()
    return chunks.select(*(c.alias(n) for n, c in meta.items()), embed_text().alias("document"))


def _digested(chunks: DataFrame) -> DataFrame:
    """Records with the digest that tells whether one has changed."""
    records = index_records(chunks)
    return records.withColumn("digest", F.sha2(F.to_json(F.struct(*records.columns)), 256))


def build_index(chunks: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame] = embed_batches) -> int:
    """Records of all chunks with their vectors, written over the index at ``path``; returns
    how many were written, counted by the writing tasks. ``encode`` adds embedding to records;
    ``vector_store.encode_once`` serves where most texts were seen before."""
    return write_index(encode(_digested(chunks)), path)


#: What the folders of an index are made of.
FOLDER = ("source_pdf", "chunk_type")


def update_index(chunks: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame] = embed_batches) -> list[tuple[str, str]]:
    """S5 for a corpus that changed in part: brings the index of ``build_index`` at ``path`` to the
    records of ``chunks`` and returns the folders (source_pdf, chunk_type) that changed. Records
    are compared by id and digest. Folders that hold a new, changed or lost record are written
    anew, those that hold none any more are deleted, all others keep their files, so jobs that
    read them go on. Only records of changed folders are encoded."""
    spark = chunks.sparkSession
    named = lambda df: [F.coalesce(df[c], F.lit("")).alias(c) for c in FOLDER]  # noqa: E731  an empty name is read as null
    records = stored(_digested(chunks), "records")
    old = spark.read.parquet(path)
    keys = lambda df, sign: df.select(*named(df), "chunk_id", "digest", F.lit(sign).alias("n"))
    unlike = keys(records, 1).unionAll(keys(old, -1)).groupBy(*FOLDER, "chunk_id", "digest").agg(F.sum("n").alias("n")).where("n <> 0")
    changed = unlike.select(*FOLDER).distinct()
    live = records.select(*named(records)).distinct().withColumn("live", F.lit(True))
    folders = changed.join(live, list(FOLDER), "left").collect()  # a row for each changed folder
    names = [(f["source_pdf"], f["chunk_type"]) for f in folders]
    gone = [n for n, f in zip(names, folders) if not f["live"]]
    lost = []
    if gone:  # where their files lie, before any file is replaced
        files = old.select(*named(old), F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1).alias("folder"))
        lost = files.join(F.broadcast(spark.createDataFrame(gone, ", ".join(f"{c} string" for c in FOLDER))), list(FOLDER), "left_semi").select("folder").distinct().collect()
    if len(gone) < len(names):
        fresh = spark.createDataFrame([n for n in names if n not in gone], "_source string, _type string")
        same = (F.coalesce("source_pdf", F.lit("")) == F.col("_source")) & (F.coalesce("chunk_type", F.lit("")) == F.col("_type"))
        write_index(encode(records.join(F.broadcast(fresh), same, "left_semi")), path, only_given=True)
    for row in lost:
        deleted(spark, row["folder"])
    return sorted(names)
