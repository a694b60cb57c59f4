"""Scores, the guaranteed top, citations, prompts and answer records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectionspark.functions.labels import citation, context_entry

# Number lists of the prompt.
IPC_PAIRS = (
    ("302", 103), ("304", 106), ("304B", 80), ("306", 108), ("307", 109), ("308", 110), ("354", 74), ("376", 64), ("379", 303), ("392", 309),
    ("395", 310), ("406", 316), ("420", 318), ("427", 324), ("498A", 85), ("499", 356), ("120B", 61), ("124A", 152), ("153A", 196),
)
CRPC_PAIRS = (("41", 35), ("154", 173), ("156", 175), ("161", 180), ("164", 183), ("167", 187), ("173", 193), ("320", 359), ("437", 480), ("438", 482), ("482", 528))
#: The answer that stands for "not in the excerpts"; a fixed value.
NOT_ENOUGH = "The provided sections do not contain sufficient information"
INSTRUCTIONS = (
    "You answer questions on the BNS and the BNSS, which replaced the IPC and the CrPC in 2024, from the excerpts below.",
    "Sections that replaced others (use only these):",
    "; ".join(f"IPC {a} is BNS {b}" for a, b in IPC_PAIRS),
    "; ".join(f"CrPC {a} is BNSS {b}" for a, b in CRPC_PAIRS),
    "Rules:",
    "1. Take the answer from the excerpts and cite act, section number and section title each time.",
    "2. Asked what replaced a section of the IPC or the CrPC, take the new number from the list above, then describe that section by the excerpts. Never guess a section number.",
    "3. Where the excerpts set out a procedure, explain it in plain English; that no definition is given is no reason to refuse.",
    f'4. Say "{NOT_ENOUGH}" only if the excerpts have nothing to do with the question.',
    "5. Be concise and exact, in plain English, with no more legal terms than needed.",
    "6. With a punishment, tell whether the offence is cognizable or not and bailable or not, where the excerpts say so.",
)


def tokens(c: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+")), "")


def overlap_score(asked: Column, has: Column) -> Column:
    """The default score: the share of the question's words that the document has."""
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, has)) / F.size(asked)).otherwise(0.0)


def score_pairs(candidates: DataFrame, scorer: Callable | None = None) -> DataFrame:
    """Adds rerank_score of (query_used, document). ``scorer``: makes, once in each task, a
    function of two lists of texts; the default uses built-in functions, on the words of _asked
    and _has where a join has brought them."""
    if scorer is None:
        made = {n: tokens(F.col(c)) for n, c in (("_asked", "query_used"), ("_has", "document")) if n not in candidates.columns}
        words = candidates.withColumns(made) if made else candidates
        return words.withColumn("rerank_score", overlap_score(F.col("_asked"), F.col("_has"))).drop("_asked", "_has")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for b in batches:
            yield b.assign(rerank_score=list(map(float, score(b["query_used"].tolist(), b["document"].tolist()))))

    return candidates.mapInPandas(run, candidates.withColumn("rerank_score", F.lit(0.0)).schema)


def guaranteed_top(scored: DataFrame, keep_k: int = 5) -> DataFrame:
    """The keep_k best by (score, pos), with ``rank`` from 1. An absent primary pin is put
    first; then, if no secondary pin is in, the first secondary one is put first, so with
    keep_k = 1 the primary pin is lost."""
    w = Window.partitionBy("query_id")
    out = scored.withColumn("r", F.row_number().over(w.orderBy(F.desc("rerank_score"), "pos")))
    for pinned, first in ((F.col("is_primary"), F.col("is_primary")), (F.col("secondary_no").isNotNull(), F.col("secondary_no") == 1)):
        inside = F.coalesce(F.max(pinned & (F.col("r") <= keep_k)).over(w), F.lit(False))
        force = F.max(F.coalesce(pinned, F.lit(False))).over(w) & ~inside
        pushed = F.when(F.coalesce(first, F.lit(False)), 1).when(F.col("r") <= keep_k - 1, F.col("r") + 1).otherwise(F.lit(2**30))
        out = out.withColumn("_f", force).withColumn("r", F.when(F.col("_f"), pushed).otherwise(F.col("r"))).drop("_f")
    return out.where(F.col("r") <= keep_k).withColumnRenamed("r", "rank")


def _in_order(value: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("r"), value.alias("x")))), lambda s: s["x"])


def citations(top: DataFrame) -> DataFrame:
    """The distinct citations of each question, in rank order."""
    return top.groupBy("query_id").agg(F.array_distinct(_in_order(citation())).alias("citations"))


def _context() -> Column:
    return F.array_join(_in_order(context_entry(F.col("rank"))), "\n\n---\n\n")


# What stands before the context, the question and the end of a prompt.
FRAME = ("\n".join(INSTRUCTIONS) + "\n\nCONTEXT (retrieved legal sections):\n", "\n\nQUESTION: ", "\n\nAnswer based strictly on the context above. Cite section numbers.")


def _prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit(FRAME[0]), context, F.lit(FRAME[1]), question, F.lit(FRAME[2]))


def prompts(top: DataFrame) -> DataFrame:
    """query_id, context and prompt, with the question as it was asked."""
    blocks = top.groupBy("query_id", "question").agg(_context().alias("context"))
    return blocks.select("query_id", "context", _prompt(F.col("context"), F.col("question")).alias("prompt"))


def answer_records(top: DataFrame, model: str = "none", generate: Callable | None = None) -> DataFrame:
    """query_id, answer, citations, chunks_used, model_used, query_used. ``generate``: makes,
    once in each task, a function of a list of prompts; without one the answer is null."""
    used = _in_order(F.struct("chunk_id", "document", "distance", "rerank_score"))
    parts = [F.array_distinct(_in_order(citation())).alias("citations"), used.alias("chunks_used")]
    if generate is not None:  # one grouping gives the prompt too
        parts.append(_context().alias("context"))
    records = top.groupBy("query_id", "query_used", "question").agg(*parts)
    if generate is None:
        records = records.withColumn("answer", F.lit(None).cast("string"))
    else:
        records = records.withColumn("prompt", _prompt(F.col("context"), F.col("question"))).drop("context")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            answer = generate()
            for b in batches:
                got = answer(b.column(b.schema.get_field_index("prompt")).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, "answer"])

        records = records.mapInArrow(run, records.withColumn("answer", F.lit("")).schema)
    return records.select("query_id", "answer", "citations", "chunks_used", F.lit(model).alias("model_used"), "query_used")
