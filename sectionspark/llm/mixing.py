"""Operator 3, mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that can count them);
a flow routes the words of each pattern to the quotas of its sources, with a cost for each
repetition that rises from one repetition to the next; the flow through a pattern then says
how many whole passes it makes and how large a seeded part of it is taken once more.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectionspark.llm.scratch import stored

#: Costs of the first, second, third ... pass over the same words: convex, so that no words
#: are repeated while fresh ones could fill a quota.
PASS_COSTS = (0, 1, 3, 6, 10, 15, 21, 28)
#: Turns that fill what the first cut of a pattern leaves with smaller documents.
FILLS = 3
#: Patterns that the driver takes at most, as the flow is solved there; more are refused. Tables of
#: so many rows of patterns are broadcast; larger ones are joined as Spark sees fit.
MAX_PATTERNS, BROADCAST_PATTERNS = 1_000_000, 100_000


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    runs = F.size(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+"))
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), runs).otherwise(0).cast("bigint")


def capped_targets(sizes: dict, weights: dict, total: float, cap: float) -> dict:
    """Shares ``total`` by weight; a target stops at cap x size, the excess is shared again."""
    out, open_ = {}, {s for s in sizes if sizes[s] > 0}
    out = {s: 0.0 for s in sizes}
    left = float(total)
    while open_ and left > 0:
        unit = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * unit > cap * sizes[s]}
        if not over:
            out |= {s: weights[s] * unit for s in open_}
            break
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def min_cost_flow(patterns: dict[tuple, int], targets: dict, passes: int, sources: dict[tuple, tuple] | None = None, extra: dict[tuple, float] | None = None) -> dict[tuple, int]:
    """Words to take from each pattern, by a flow start -> pattern (an arc for each pass) ->
    source -> end that takes the most words and, of such flows, costs least.

    patterns: words of each; sources: the sources of each (by default the pattern is the tuple
    of them); extra: what each pass over a pattern costs beyond PASS_COSTS. Sources that no
    pattern joins are solved apart. Arcs that cost something all leave the start, so the cheapest
    way to the end costs what its first arc does: arcs are opened in order of cost, and at each
    cost all words are pushed that find a way, by levels and blocking flows.
    """
    of = {p: [s for s in (sources[p] if sources else p) if s in targets] for p in patterns}
    root = {s: s for s in targets}

    def find(s):
        while root[s] != s:
            root[s] = s = root[root[s]]
        return s

    for some in of.values():
        for s in some[1:]:
            root[find(some[0])] = find(s)
    parts: dict = {}
    for p in sorted((p for p in patterns if of[p] and patterns[p] > 0), key=repr):
        parts.setdefault(find(of[p][0]), []).append(p)
    flow = dict.fromkeys(patterns, 0)
    for some in parts.values():
        flow |= _part_flow({p: patterns[p] for p in some}, of, targets, passes, extra or {})
    return flow


def _part_flow(patterns: dict[tuple, int], of: dict, targets: dict, passes: int, extra: dict) -> dict[tuple, int]:
    """min_cost_flow of one connected part. Nodes: 0 the end, then patterns, then sources; what
    the start has sent to a pattern is ``sent``, and the open arcs from it are ``room``."""
    names = {p: i for i, p in enumerate(patterns, 1)}
    at = {s: len(names) + i for i, s in enumerate(sorted({s for p in patterns for s in of[p]}, key=repr), 1)}
    graph: list[list[int]] = [[] for _ in range(len(names) + len(at) + 1)]
    to, left = [], []

    def arc(a: int, b: int, capacity: int) -> None:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            graph[x].append(len(to))
            to.append(y)
            left.append(c)

    for p, i in names.items():
        for s in of[p]:
            arc(i, at[s], passes * patterns[p])
    for s, i in at.items():
        arc(i, 0, round(targets[s]))
    sent, room = dict.fromkeys(names.values(), 0), dict.fromkeys(names.values(), 0)
    prices: dict[float, list[int]] = {}
    for p, i in names.items():
        for k in range(passes):
            prices.setdefault(PASS_COSTS[k] + extra.get(p, 0), []).append(i)
    words = {i: patterns[p] for p, i in names.items()}

    def pushed(i: int, level: list[int], tried: list[int]) -> int:
        """Sends what the start can give to pattern i down the levels, along one way."""
        path, node = [], i
        while node:
            while tried[node] < len(graph[node]):
                e = graph[node][tried[node]]
                if left[e] > 0 and level[to[e]] == level[node] - 1:
                    break
                tried[node] += 1
            else:
                if not path:
                    return 0
                e = path.pop()
                node = to[e ^ 1]
                tried[node] += 1
                continue
            path.append(e)
            node = to[e]
        n = min(room[i], *(left[e] for e in path))
        for e in path:
            left[e] -= n
            left[e ^ 1] += n
        return n

    for price in sorted(prices):
        for i in prices[price]:
            room[i] += words[i]
        while True:
            level, queue = [-1] * len(graph), deque([0])  # arcs to the end
            level[0] = 0
            while queue:
                a = queue.popleft()
                for e in graph[a]:
                    if left[e ^ 1] > 0 and level[to[e]] < 0:
                        level[to[e]] = level[a] + 1
                        queue.append(to[e])
            tried, moved = [0] * len(graph), 0
            for i in names.values():
                while room[i] and level[i] > 0 and (n := pushed(i, level, tried)):
                    room[i] -= n
                    sent[i] += n
                    moved += n
            if not moved:
                break
    return {p: sent[i] for p, i in names.items()}


def mix(docs: DataFrame, members: Column, weights, size: Column | None = None, total_share: float = 1.0, max_passes: int = 3, seed: int = 17, id_col: str = "doc_id", kind: Column | None = None, kind_costs: tuple[float, ...] = (0,)) -> DataFrame:
    """All rows of ``docs`` (id column only) with what the mix takes of them.

    members: ARRAY of the sources that may count a document (null elements are a source of
    their own; several sources overlap in the document). weights: function from the sorted
    list of sources (by code point, null last) to their weights. Targets share
    ``total_share`` of all words by weight; none exceeds ``max_passes`` times its source's
    size. Returns id, size, source_size and target (of the first source), taken.

    kind: splits the documents of each set of sources into patterns by a number from 0;
    each pass over a document of kind k costs kind_costs[k] more, so that the flow takes and
    repeats cheap kinds first wherever quotas leave it a choice; a cost below 1 comes between a
    pass over all documents and the next.

    Takes whole documents only: each is taken floor or ceil of (flow / size of its pattern)
    times, the ones taken once more being first in a seeded hash order of (id, size) up to
    the word count that the flow leaves; FILLS more turns fill the rest with documents of at
    most half its size. The order is cut by two exact histograms, never by a sort of a whole
    source, so a source with a third of all rows is no special case.
    Documents without words take nothing. Rows equal in id and size (null ids too) are taken
    alike; very long texts are documents like others; an empty table gives an empty result.
    max_passes is at most len(PASS_COSTS). All patterns go through the flow, a null kind as 0.
    """
    if not 1 <= max_passes <= len(PASS_COSTS):
        raise ValueError(f"max_passes is 1 to {len(PASS_COSTS)}")
    spark = docs.sparkSession
    words = word_count(F.col("text")) if size is None else size
    mark = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col("size")), 24)  # 40 bits
    table = docs.select(F.col(id_col), F.array_sort(F.array_distinct(members)).alias("members"), words.alias("size"), F.coalesce(F.lit(0) if kind is None else kind, F.lit(0)).cast("int").alias("kind"))
    table = stored(table.withColumn("mark", mark), "mix-sizes")
    high, low = F.floor(F.col("mark") / (1 << 28)).cast("int"), F.floor(F.col("mark") / (1 << 16)).cast("bigint")
    patterns: dict[tuple, int] = {}
    if len(rows := table.groupBy("members", "kind").agg(F.sum("size")).limit(MAX_PATTERNS + 1).collect()) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    for members_, k, n in rows:
        patterns[tuple(members_ or ()), k] = patterns.get((tuple(members_ or ()), k), 0) + (n or 0)
    sizes: dict = {}
    for (p, _), n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = capped_targets(sizes, dict(zip(order, weights(order))), total_share * sum(patterns.values()), max_passes)
    flow = min_cost_flow(patterns, targets, max_passes, {p: p[0] for p in patterns}, {p: kind_costs[p[1]] for p in patterns})

    # how many whole passes each pattern makes, and below which mark it is taken once more
    plan = {p: (flow.get(p, 0) // n, flow.get(p, 0) % n) if n else (0, 0) for p, n in patterns.items()}
    index = {p: i for i, p in enumerate(sorted(patterns, key=repr))}
    spec = "struct<at:int,m:array<string>,k:int,passes:bigint,source_size:bigint,target:double>"
    rows = [(i, list(p), k, plan[p, k][0], sizes.get(p[0]) if p else 0, targets.get(p[0], 0.0) if p else 0.0) for (p, k), i in index.items()]
    same = F.coalesce("members", F.array().cast("array<string>")).eqNullSafe(F.col("m")) & (F.col("kind") == F.col("k"))
    table = table.join(_small(spark.createDataFrame(rows, spec), len(rows)), same, "left").drop("m", "k")
    rest = {index[p]: plan[p][1] for p in plan if plan[p][1]}
    extra = F.lit(False)
    for turn in range(FILLS + 1):
        # the first turn may take any document; later ones only such as leave a finer rest
        fits = F.lit(True) if turn == 0 else F.col("size") <= F.col("limit")
        limits = _pairs(spark, {i: n if turn == 0 else n // 2 for i, n in rest.items()}, "limit")
        open_ = table.where(~extra).join(limits, "at").where(fits)
        coarse, below = _boundary(open_, high, rest, {})
        fine, below = _boundary(open_.join(_pairs(spark, coarse, "edge"), "at").where(high == F.col("edge")), low, rest, below)
        # a pattern whose documents all fit has no edge: all of them are taken
        ends = {i: fine[i] << 16 if i in fine else (coarse[i] + 1) << 28 if i in coarse else 1 << 40 for i in rest}
        cut = _pairs(spark, ends, f"cut{turn}")
        if turn:
            cut = cut.join(limits.withColumnRenamed("limit", f"limit{turn}"), "at")
        table = table.join(cut, "at", "left")
        more = F.col("mark") < F.col(f"cut{turn}")
        more = more & (F.col("size") <= F.col(f"limit{turn}")) if turn else more
        extra = extra | F.coalesce(more, F.lit(False))
        rest = {i: left for i, n in rest.items() if (left := n - below.get(i, 0)) > 0}
    repeats = F.col("passes") + F.when(extra, 1).otherwise(0)
    return table.select(id_col, "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.cast("int").alias("repeats"))


def _pairs(spark, values: dict[int, int], name: str) -> DataFrame:
    """A row for each pattern."""
    return _small(spark.createDataFrame(sorted(values.items()), f"at int, {name} bigint"), len(values))


def _small(table: DataFrame, n: int) -> DataFrame:
    return F.broadcast(table) if n <= BROADCAST_PATTERNS else table


def _boundary(table: DataFrame, bucket: Column, rest: dict[int, int], below: dict[int, int]) -> tuple[dict, dict]:
    """For each pattern of rest the bucket in which the sizes, added up in order of the mark, reach
    what is left to take, and the sum before that bucket; only histograms leave the tasks."""
    if not rest:
        return {}, {}
    out, sums = {}, dict(below)
    left = table.sparkSession.createDataFrame([(at, n - sums.get(at, 0)) for at, n in sorted(rest.items())], "at int, left bigint")
    sizes = table.join(_small(left, len(rest)), "at").groupBy("at", "left", bucket.alias("b")).agg(F.sum("size").alias("n"))
    # at most 4096 buckets of a pattern meet in its window; one row of it leaves
    upto = F.sum("n").over(Window.partitionBy("at").orderBy("b"))
    over = F.when(F.col("upto") > F.col("left"), F.struct("b", (F.col("upto") - F.col("n")).alias("before")))
    for at, total, edge in sizes.withColumn("upto", upto).groupBy("at").agg(F.sum("n"), F.min(over)).collect():
        sums[at] = sums.get(at, 0) + (total if edge is None else edge["before"])
        if edge is not None:
            out[at] = edge["b"]
    return out, sums
