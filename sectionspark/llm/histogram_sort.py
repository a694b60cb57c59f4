"""Operator 4, sharding by histogram sort, with DataFrame functions only.

Splitters of a total order are found without sorting: each round counts the exact bytes
below a set of candidate boundaries in one small aggregation over all partitions and keeps,
for each splitter, only the interval that still holds it. When all splitters are within
tolerance the rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectionspark.llm.scratch import stored, unused

#: Cells into which one exchange deals at most; each is sorted by one task, with spill. At
#: 100 TB that makes cells of 1.5 GB.
MAX_CELLS = 1 << 16
#: Bounds up to which a row's cell is found by branches.
MOST_BRANCHES = 256
#: Candidate boundaries that a round counts, about.
MOST_BINS = 1 << 18


@dataclass
class Splitters:
    """``bounds[i]`` is the first (k1, k2) of cell i + 1; ``starts[i]`` the bytes below it."""

    bounds: list[tuple[int, int]]
    starts: list[int]
    total: int


def numbers(values: list[int]) -> Column:
    """A constant array, given as one string so that the plan has one node for it."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def _tree(k1: Column, k2: Column, bounds: list[tuple[int, int]], lo: int, hi: int) -> Column:
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    b1, b2 = map(F.lit, bounds[mid])
    below = (k1 < b1) | ((k1 == b1) & (k2 < b2))
    return F.when(below, _tree(k1, k2, bounds, lo, mid)).otherwise(_tree(k1, k2, bounds, mid + 1, hi))


def cell_of(k1: Column, k2: Column, bounds: list[tuple[int, int]]) -> Column:
    """The number of bounds at or below a key: a tree of comparisons for a few, which is
    compiled, and a binary search in their sorted list for many."""
    if len(bounds) < MOST_BRANCHES:
        return _tree(k1, k2, bounds, 0, len(bounds))
    steps = [1 << i for i in range(len(bounds).bit_length())][::-1]
    # filled up to a power of two, less one, by bounds above every key
    filled = [*bounds, *[((1 << 63) - 1, (1 << 63) - 1)] * (2 * steps[0] - 1 - len(bounds))]
    b1, b2 = (numbers([b[i] for b in filled]) for i in (0, 1))

    def advance(at: Column, step: Column) -> Column:
        own = F.get(b1, at + step - 1)
        below = (own < k1) | ((own == k1) & (F.get(b2, at + step - 1) <= k2))
        return F.when(below, at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), advance)


#: k2 of a boundary that lies before every row with its k1.
LOWEST = -(1 << 63)


def find_splitters(keys: DataFrame, targets: list[float], tolerances: list[float], bins: int = 64) -> Splitters:
    """Boundaries of the order (k1, k2) such that about ``targets[i]`` bytes lie below each.

    keys: columns k1 (BIGINT within +-2**61, not null), k2 (BIGINT, not null), size (BIGINT).
    A boundary is taken as soon as its exact byte count is within its tolerance; boundaries
    fall between different k1 where that suffices and inside one k1 only if that one key
    holds more bytes than the tolerance. The driver sees at most one row for each candidate.
    Equal targets or very large rows give equal boundaries (empty cells), never lost rows.
    """
    first = keys.agg(F.min("k1"), F.max("k1"), F.sum("size")).first()
    if first[2] is None:
        return Splitters([(0, LOWEST)] * len(targets), [0] * len(targets), 0)
    found: dict[int, tuple[tuple[int, int], int]] = {}
    # an interval: (k1 if inside one key else None, lowest, highest, bytes below it) -> targets
    active = {(None, first[0], first[1], 0): list(range(len(targets)))}
    while active:
        spans = list(active)
        per = max(4, min(bins, MOST_BINS // len(spans))) if len(spans) > 1 else max(4096, 4 * len(targets))
        counted = _count(keys, spans, per)
        nexts: dict[tuple, list[int]] = {}
        for s, span in enumerate(spans):
            fixed, lo, hi, base = span
            step = -(-(hi - lo + 1) // per)
            rows, mine = counted.get(s, []), sorted(active[span], key=lambda i: targets[i])
            edge = lambda v: (v, LOWEST) if fixed is None else (fixed, v)
            at, below = 0, base
            for i in mine:
                while at < len(rows) and below + rows[at][1] < targets[i]:
                    below += rows[at][1]
                    at += 1
                if at == len(rows):
                    found[i] = (edge(hi + 1), below)
                    continue
                b, size, low, high = rows[at]
                left, right = targets[i] - below, below + size - targets[i]
                whole = low == high and fixed is not None  # nothing finer than one key
                if min(left, right) <= tolerances[i] or whole:
                    found[i] = (edge(low), below) if left <= right else (edge(high + 1), below + size)
                elif low == high:
                    nexts.setdefault((low, None, None, below), []).append(i)
                else:
                    nexts.setdefault((fixed, low, high, below), []).append(i)
        active = _ranges(keys, nexts)
    picked = [found[i] for i in range(len(targets))]
    return Splitters([p[0] for p in picked], [p[1] for p in picked], first[2])


def _count(keys: DataFrame, spans: list[tuple], per: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each span its bins that hold rows: (bin, bytes, lowest key, highest key)."""
    out: dict[int, list] = {}
    for inside in (False, True):
        own = [(s, *span) for s, span in enumerate(spans) if (span[0] is not None) == inside]
        if not own:
            continue
        own.sort(key=lambda x: (x[1] or 0, x[2]))
        key = F.col("k2") if inside else F.col("k1")
        starts = [(x[1], x[2]) if inside else (x[2], LOWEST) for x in own]
        at = cell_of(F.col("k1"), F.col("k2"), starts) - 1
        of = lambda values: F.get(numbers(values), F.col("at")).cast("decimal(38,0)")
        rows = keys.withColumn("at", at).where("at >= 0")
        if inside:
            rows = rows.where(of([x[1] for x in own]) == F.col("k1"))
        wide, width = key.cast("decimal(38,0)"), [-(-(x[3] - x[2] + 1) // per) for x in own]
        rows = rows.where(wide <= of([x[3] for x in own])).withColumn("bin", F.floor((wide - of([x[2] for x in own])) / of(width)).cast("int"))
        for r in rows.groupBy("at", "bin").agg(F.sum("size"), F.min(key), F.max(key)).collect():
            out.setdefault(own[r[0]][0], []).append(tuple(r)[1:])
    return {s: sorted(rows) for s, rows in out.items()}


def _ranges(keys: DataFrame, spans: dict[tuple, list[int]]) -> dict[tuple, list[int]]:
    """Fills in the range of k2 of the keys that must be cut inside."""
    cut = [s for s in spans if s[1] is None]
    if not cut:
        return spans
    got = {r[0]: r for r in keys.where(F.col("k1").isin([s[0] for s in cut])).groupBy("k1").agg(F.min("k2"), F.max("k2")).collect()}
    return {s if s[1] is not None else (s[0], got[s[0]][1], got[s[0]][2], s[3]): v for s, v in spans.items()}


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.005, cell_bytes: int = 256 << 20) -> DataFrame:
    """All rows and columns of ``docs`` plus ``_size``, ``_shard`` and ``_slot`` (columns of
    these names are replaced; no other name clashes).

    Law: near equal bytes. A row weighs its UTF-8 bytes plus 8 (null text: 8). Rows are
    ordered by (hash of the text, id), so equal texts stand together and share a shard,
    unless a splitter must fall inside a group that is larger than the tolerance (a share of
    a shard's bytes). ``_slot`` counts from 0 without gaps inside each shard, in that order.
    Null ids sort first; rows equal in text and id take neighbouring slots in any order.
    A very long text is one row that may make its shard the larger. An empty table gives an
    empty result.

    Each shard is dealt out as several cells of about ``cell_bytes`` (at most MAX_CELLS in
    all), so no task sorts a whole shard; slots of a cell start at the exact row count of
    the cells before it.
    """
    docs = docs.drop("_size", "_shard", "_slot")
    k1 = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 2)
    k2 = F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOWEST + 1))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint") + 8
    keys = stored(docs.select(k1.alias("k1"), k2.alias("k2"), size.alias("size")), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per = max(1, min(MAX_CELLS // shards, -(-total // (shards * cell_bytes))))
    part = total / (shards * per)
    tolerances = [min(tolerance * per, 0.4) * part if i % per == 0 else 0.1 * part for i in range(1, shards * per)]
    cut = find_splitters(keys, [part * i for i in range(1, shards * per)], tolerances)
    _k1, _k2, _cell = (unused(docs, c) for c in ("_k1", "_k2", "_cell"))
    counts = {r[0]: r[1] for r in keys.groupBy(cell_of(F.col("k1"), F.col("k2"), cut.bounds).alias("c")).count().collect()}
    before, base = [], 0
    for c in range(shards * per):
        base = 0 if c % per == 0 else base
        before.append(base)
        base += counts.get(c, 0)
    order = Window.partitionBy(_cell).orderBy(_k1, _k2)
    out = docs.withColumns({_k1: k1, _k2: k2, "_size": size}).withColumn(_cell, cell_of(F.col(_k1), F.col(_k2), cut.bounds))
    out = out.withColumn("_slot", F.row_number().over(order) - 1 + F.get(numbers(before), F.col(_cell)))
    return out.withColumn("_shard", F.floor(F.col(_cell) / per).cast("int")).drop(_k1, _k2, _cell)
