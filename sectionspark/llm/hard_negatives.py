"""Operator 13, hard negatives by slot-decomposed selection.

Every positive of an anchor opens a window of scores below it. The windows overlap, so they
are not searched one by one: their upper limits cut the scores into disjoint slots, each row
falls into one slot at most, and a block of rows returns the best few of each slot. The answer
of a window is the best few of its own slot and of all slots below, joined in falling order.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectionspark.llm.scratch import stored
from sectionspark.llm.textbatch import tidy
from sectionspark.llm.vectors import matrix, one_per_id

#: Anchors that one task holds (their vectors and best rows), and those compared at once.
ANCHORS, TILE = 32_768, 1024
#: Rows of a block at least; blocks grow with the root of the table, so that what the blocks of
#: one anchor return does too.
LEAST_ROWS = 8192
#: Range of scores; EMPTY is below, and its negation still a long.
LOWEST, HIGHEST, EMPTY = -(2**63) + 2, 2**63 - 1, -(2**63) + 1
FOUND = "anchor_id bigint, slot int, vec_id bigint, score bigint"


class _Best:
    """The best ``k`` rows in each slot of a block of anchors, ties to the smaller id. Rows
    must come with rising ids: a later one never wins a tie."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, limits: np.ndarray, k: int, same: bool):
        self.ids, self.labels, self.x, self.k, self.same = ids, labels, x, k, same
        self.upper = limits  # falling along a row; slot j holds scores in (limits[j + 1], limits[j]]
        self.lower = np.concatenate([limits[:, 1:], np.full((len(ids), 1), EMPTY)], axis=1)
        self.score = np.full((len(ids), limits.shape[1], k), EMPTY, np.int64)
        self.id = np.full(self.score.shape, HIGHEST, np.int64)
        self.norm = float(np.sqrt((x * x).sum(1).max(initial=0.0)))

    def scores(self, lo: int, x: np.ndarray) -> np.ndarray:
        mine = self.x[lo : lo + TILE]
        if self.norm * float(np.sqrt((x * x).sum(1).max(initial=0.0))) < 2.0**53:
            return mine @ x.T  # whole numbers below 2^53: exact in double precision
        exact = mine.astype(object)
        wide = np.array([[int(v) for v in r] for r in exact], object).reshape(exact.shape) @ np.array([[int(v) for v in r] for r in x], object).reshape(x.shape).T
        return np.clip(wide, LOWEST, HIGHEST).astype(np.int64)

    def add(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        width = max(x.shape[1], self.x.shape[1])
        x, self.x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, self.x))
        for lo in range(0, len(self.ids), TILE):
            at = slice(lo, lo + TILE)
            s = self.scores(lo, x)
            alike = self.labels[at, None] == labels[None, :]
            fits = alike & (self.ids[at, None] != ids[None, :]) if self.same else ~alike
            for slot in range(self.upper.shape[1]):
                floor = np.maximum(self.lower[at, slot], self.score[at, slot, -1])
                new = fits & (s <= self.upper[at, slot, None]) & (s > floor[:, None])
                if self.k < s.shape[1] and np.count_nonzero(new) > 8 * self.k * len(s):  # a first look
                    kth = np.partition(np.where(new, s, EMPTY), s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
                    new &= s >= kth[:, None]
                a, b = np.nonzero(new)
                if len(a):
                    self._merge(lo, slot, a, ids[b], s[a, b].astype(np.int64))

    def _merge(self, lo: int, slot: int, a: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows = np.unique(a)
        a = np.concatenate([a, np.repeat(rows, self.k)])
        ids = np.concatenate([ids, self.id[lo + rows, slot].ravel()])
        scores = np.concatenate([scores, self.score[lo + rows, slot].ravel()])
        order = np.lexsort((ids, -scores, a))
        a, ids, scores = a[order], ids[order], scores[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        top = place < self.k
        self.id[lo + a[top], slot, place[top]] = ids[top]
        self.score[lo + a[top], slot, place[top]] = scores[top]

    def found(self) -> pa.RecordBatch:
        a, slot, place = np.nonzero(self.score >= LOWEST)
        cols = [self.ids[a], slot.astype(np.int32), self.id[a, slot, place], self.score[a, slot, place]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor_id", "slot", "vec_id", "score"])


def _selector(k: int, same: bool, scale: int):
    """A function over sorted batches (cell: k, i, j; row: anchors first; id, label, v, limits)
    that gives each cell's best rows. It holds the anchors of one cell and one batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best = None, [], None

        def begun() -> _Best:
            ids, labels, xs, limits = (list(p) for p in zip(*held))
            width, slots = max(x.shape[1] for x in xs), max(u.shape[1] for u in limits)
            x = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in xs])
            # an anchor with fewer positives has empty slots at the end
            u = np.concatenate([np.pad(m, ((0, 0), (0, slots - m.shape[1])), constant_values=EMPTY) for m in limits])
            return _Best(np.concatenate(ids), np.concatenate(labels), x, u, k, same)

        for batch in batches:
            cells = np.column_stack([batch.column(c).to_numpy() for c in "kij"])
            is_row = batch.column("row").to_numpy(zero_copy_only=False)
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            x = np.floor(scale * matrix(batch.column("v")))
            cuts = np.flatnonzero((np.diff(cells, axis=0) != 0).any(1) | (np.diff(is_row.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(cells)]):
                if lo == hi:
                    continue
                if tuple(cells[lo]) != cell:
                    if best is not None:
                        yield best.found()
                    cell, held, best = tuple(cells[lo]), [], None
                if not is_row[lo]:
                    held.append((ids[lo:hi], labels[lo:hi], x[lo:hi], _limits(batch.column("limits").slice(lo, hi - lo))))
                elif held or best is not None:
                    if best is None:
                        best, held = begun(), []
                    best.add(ids[lo:hi], labels[lo:hi], x[lo:hi])
        if best is not None:
            yield best.found()

    return tidy(run)


def _limits(column: pa.ListArray) -> np.ndarray:
    rows = column.to_pylist()
    out = np.full((len(rows), max(map(len, rows))), EMPTY, np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _best(anchors: DataFrame, rows: DataFrame, key: str, k: int, same: bool, scale: int) -> DataFrame:
    """FOUND: the best k rows of each anchor and slot. anchors: id, label, v, limits, g; rows:
    id, label, v, g; key: what rows and anchors must share, g (a number). A group that is larger
    than a block is cut into blocks of anchors and of rows, which meet pairwise in cells."""
    spark = rows.sparkSession
    n = rows.count()
    block = max(LEAST_ROWS, 32 * isqrt(n))
    sizes = anchors.groupBy(key).agg(F.count("*").alias("a")).join(rows.groupBy(key).agg(F.count("*").alias("r")), key)
    cut = lambda c, by: F.ceil(F.col(c) / by).cast("int").alias(f"n_{c}")
    # groups over a block: n / block of them at most, so this is broadcast
    large = sizes.where((F.col("a") > ANCHORS) | (F.col("r") > block)).select(key, cut("a", ANCHORS), cut("r", block))
    large = F.broadcast(stored(large, "large-groups"))
    one = lambda c: F.coalesce(c, F.lit(1))
    deal = lambda c: F.pmod(F.xxhash64("id"), one(F.col(c))).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), one(F.col(c)) - 1))
    none = F.lit(None).cast("array<bigint>")
    a = anchors.join(large, key, "left").withColumn("i", deal("n_a")).withColumn("j", every("n_r"))
    r = rows.join(large, key, "left").withColumn("j", deal("n_r")).withColumn("i", every("n_a")).withColumn("limits", none)
    cell = (F.col(key).cast("bigint").alias("k"), F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"))
    both = a.select(*cell, F.lit(False).alias("row"), "id", "label", "v", "limits").unionByName(r.select(*cell, F.lit(True).alias("row"), "id", "label", "v", "limits"))
    dealt = both.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "row", "id")
    top = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    found = dealt.mapInArrow(_selector(k, same, scale), FOUND)
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)


def _percent(score: Column, percent: int) -> Column:
    return F.floor(score.cast("decimal(19,0)") * percent / 100).cast("bigint")


def hard_negatives(
    table: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
    scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x), a score is the inner product of these whole
    numbers. An anchor's positives are the best n_positives other rows of its label; each has
    the best n_negatives rows of other labels whose score lies between ``low`` and ``high``
    percent of the positive's, both included; ties go to the smaller id. Positives may be
    fewer, and a positive without such a row gives none.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part;
    zero and empty vectors do, shorter vectors count as filled with zeros. Rows of one id are
    one vector, the smallest (label, vector). Scores beyond a long stay at its ends. An empty
    table gives an empty result; other columns are not looked at. Groups of any size, and
    copies of one vector, are cut into blocks.
    """
    named = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    wide = F.col("v").cast("array<double>")
    sound = ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = one_per_id(named.where("id is not null and label is not null and v is not null").where(sound), "id", ["label", "v", "is_anchor"])
    rows = stored(rows, "vectors")
    anchors = rows.where("is_anchor").drop("is_anchor")
    rows = rows.drop("is_anchor")
    any_score = F.array(F.lit(HIGHEST).cast("bigint"))
    positives = _best(anchors.withColumn("limits", any_score), rows, "label", n_positives, True, scale)
    positives = stored(positives.select("anchor_id", F.col("rank").alias("n"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # of like positives the last one's slot takes the rows; windows of the others reach it too
    limits = positives.groupBy("anchor_id").agg(F.transform(F.sort_array(F.collect_list("positive_score"), False), lambda s: _percent(s, high)).alias("limits"))
    asked = anchors.join(limits, F.col("id") == F.col("anchor_id")).select("id", "label", "v", "limits", F.lit(0).alias("g"))
    slots = _best(asked, rows.withColumn("g", F.lit(0)), "g", n_negatives, False, scale)
    falling = F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("s"), "vec_id")))
    below = slots.groupBy("anchor_id").agg(falling.alias("all"))  # a handful in each slot
    own = F.slice(F.filter("all", lambda x: x["slot"] >= F.col("n") - 1), 1, n_negatives)
    out = positives.join(below, "anchor_id").select("anchor_id", "positive_id", "positive_score", F.posexplode(own).alias("at", "x"))
    out = out.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", (-F.col("x.s")).alias("negative_score"))
    decimal = lambda c: F.col(c).cast("decimal(19,0)")
    return out.where(decimal("negative_score") * 100 >= decimal("positive_score") * low)
