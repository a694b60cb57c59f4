"""Operator 7, embedding near-duplicates through a pivot-permutation index.

A vector is described by its nearest reference points (pivots), in order of nearness. Pairs
that share enough of them are retrieved through inverted lists of the pivots and verified by
their exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionspark.llm.components import components
from sectionspark.llm.scratch import stored
from sectionspark.llm.vectors import matrix, one_per_id, unit, usable

#: Pivots: PIVOT_RATE times the root of the row count, within these bounds; the upper one is
#: reached at 10**9 rows and keeps what is broadcast below 64 MB at 128 dimensions.
PIVOT_RATE, LEAST_PIVOTS, MOST_PIVOTS = 2.0, 16, 1 << 16
#: Pivots that describe a vector, and those that a pair must share to be verified.
NEAREST, SHARED = 8, 2
#: Rows of a list that meet in one block; longer lists are dealt to pairs of blocks. Pairs
#: that are verified at once.
BLOCK, AT_ONCE = 1024, 1 << 16
#: Products of rows and pivots that a task holds at once (32 MB).
PRODUCTS = 1 << 22


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k nearest pivots of each row, in no order; ties to the smaller number. Rows are taken
    so few at once that PRODUCTS products are held."""
    out = np.zeros((len(x), k), np.int64)
    width, step = min(x.shape[1], pivots.shape[1]), max(1, PRODUCTS // max(1, len(pivots)))
    for lo in range(0, len(x) if k else 0, step):
        s = unit(x[lo : lo + step])[:, :width] @ pivots[:, :width].T
        near = s >= np.partition(s, -k, axis=1)[:, -k, None]
        tied = near.sum(1) > k
        out[lo : lo + step][~tied] = np.nonzero(near[~tied])[1].reshape(-1, k)
        out[lo : lo + step][tied] = np.argsort(-s[tied], axis=1, kind="stable")[:, :k]
    return out


def near_duplicates(table: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """One row for each id: id, n_links, component_id, kept. Rows without an id are left out, as
    they have none to report; an empty table gives an empty result, and other columns of
    ``table`` are not looked at.

    Two vectors link if their groups are equal and not null and their cosine is at least the
    threshold, in double precision. Vectors that are null, zero or hold null or non-finite
    components link with nothing and are components of their own; repeated ids count as one
    vector. n_links counts links found; a pair is found if its descriptions share SHARED of
    NEAREST pivots, and is verified where its rarest shared pivot is listed, so it counts
    once. Tasks return a count and the smallest local relative for each row, never the pairs.
    """
    spark = table.sparkSession
    rows = one_per_id(table.select(id_col, group_col, vector_col).where(F.col(id_col).isNotNull()), id_col, [group_col, vector_col])
    rows = stored(rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(group_col).alias("g"), F.col(vector_col).alias("x"), (usable(F.col(vector_col)) & F.col(group_col).isNotNull()).alias("ok")), "vectors")
    good = rows.where("ok").drop("ok")
    total = good.count()
    size = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, PIVOT_RATE * total**0.5)))
    picked = good.select("id", "x").orderBy(F.xxhash64(F.lit("pivot"), "id"), "id").limit(size).toArrow()
    pivots = spark.sparkContext.broadcast(unit(matrix(picked["x"])) if len(picked) else np.zeros((0, 0)))  # MOST_PIVOTS rows

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = nearest_pivots(matrix(batch.column(2)), pivots.value, min(NEAREST, len(pivots.value)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], names=["id", "g", "x", "near"])

    schema = good.withColumn("near", F.array(F.lit(0))).schema
    described = stored(good.mapInArrow(describe, schema), "described")
    # number the pivots anew, rarest first; at most MOST_PIVOTS counts reach the driver
    counts = {r[0]: r[1] for r in described.select(F.explode("near").alias("p")).groupBy("p").count().collect()}
    rank = [0] * max(1, len(picked))
    for i, p in enumerate(sorted(range(len(picked)), key=lambda p: (counts.get(p, 0), p))):
        rank[p] = i
    ranks = F.from_json(F.lit(str(rank)), "array<int>")
    sets = F.array_sort(F.transform("near", lambda p: F.element_at(ranks, p + 1)))
    shared = min(SHARED, len(picked))
    listed = described.withColumn("near", sets).withColumn("pivot", F.explode(F.slice("near", 1, max(1, min(NEAREST, len(picked)) - shared + 1))))
    blocks = listed.groupBy("g", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("blocks")).cast("int")
    dealt = listed.join(blocks, ["g", "pivot"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"b0": F.least("mine", "other"), "b1": F.greatest("mine", "other")}).select("pivot", "g", "b0", "b1", "mine", "id", "x", "near")

    def verify(group: pa.Table) -> pa.Table:
        ids, mine = group["id"].to_numpy(), group["mine"].to_numpy()
        b0, b1, pivot = (group[c][0].as_py() for c in ("b0", "b1", "pivot"))
        order = np.lexsort((ids, mine))
        ids, mine = ids[order], mine[order]
        x, near = unit(matrix(group["x"]))[order], matrix(group["near"]).astype(np.int64)[order]
        a = np.flatnonzero(mine == b0)
        b = a if b0 == b1 else np.flatnonzero(mine == b1)
        used, index = np.unique(near, return_inverse=True)
        holds = np.zeros((len(ids), len(used)), np.float32)
        np.put_along_axis(holds, index.reshape(near.shape), 1, axis=1)
        earlier = holds[:, used < pivot]
        links = (holds[a] @ holds[b].T >= shared) & (earlier[a] @ earlier[b].T == 0)
        if b0 == b1:
            np.fill_diagonal(links, False)
        # only pairs that share enough pivots are verified
        i, j = np.nonzero(links)
        for lo in range(0, len(i), AT_ONCE):
            p, q = i[lo : lo + AT_ONCE], j[lo : lo + AT_ONCE]
            links[p, q] = (x[a[p]] * x[b[q]]).sum(1) >= threshold
        n = np.zeros(len(ids), np.int64)
        n[a] += links.sum(1)
        if b0 != b1:
            n[b] += links.sum(0)
        root = np.arange(len(ids))
        while True:  # smallest relative within the block
            after = root.copy()
            np.minimum.at(after, a, np.where(links, root[b][None, :], len(ids)).min(1, initial=len(ids)))
            np.minimum.at(after, b, np.where(links, root[a][:, None], len(ids)).min(0, initial=len(ids)))
            after = after[after]
            if (after == root).all():
                break
            root = after
        # positions aren't in order of ids over two blocks: take each root's smallest id
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        some = n > 0
        return pa.table({"id": ids[some], "n": n[some], "root": least[root][some]})

    found = stored(dealt.groupBy("g", "pivot", "b0", "b1").applyInArrow(verify, "id bigint, n bigint, root bigint"), "pivot-links")
    degree = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    member = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    out = rows.select("id").join(degree, "id", "left").join(member, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
