"""Operator 11, conversations brought back to ``(s?(ua)+)?`` by the cheapest edits.

A conversation's rows and the states of that grammar span a lattice whose edges are edits. A
bidirectional Dijkstra finds the least cost through it and, of all ways of that cost, the one
whose letters come first. Long conversations are cut into blocks: a block is solved from each
state to each state, and the blocks' answers are joined from left to right.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionspark.llm.scratch import bound_batches, stored
from sectionspark.llm.textbatch import tidy

# Costs of the edits, white space, ends of sentences.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
INK, ENDS = r"[^\x20\x09-\x0D]", r"[.!?]"
#: Bits of a block's size in rows: what is searched at once.
BLOCK_BITS = 10

#: States: nothing yet, after a system turn, a user turn, an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (EMPTY, ASSISTANT)
#: The state that a new or re-roled turn leads to, and those that a kept initial does.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Ways into a state: of inserted and re-roled turns, and of kept initials.
BEFORE = tuple(tuple(p for p in range(4) if NEXT[p] == s) for s in range(4))
KEPT_BEFORE = {(s, c): tuple(p for p in range(4) if KEPT.get((p, c)) == s) for s in range(4) for c in "sua"}


def _edges(codes: list[str], i: int, state: int) -> Iterator[tuple[str, int, tuple[int, int]]]:
    """Edits that leave a node: letter, cost, node. A node is (rows read, state); a row's code
    is its initial and its fault (b, d: must go; t: costs more if it stays)."""
    if i < len(codes):
        initial, fault = codes[i]
        yield "D", DELETE, (i + 1, state)
        if fault not in "bd":
            more = TRUNCATED if fault == "t" else 0
            if (state, initial) in KEPT:
                yield "K", more, (i + 1, KEPT[state, initial])
            yield "R", REROLE + more, (i + 1, NEXT[state])
    yield "I", INSERT, (i, NEXT[state])


def _edges_back(codes: list[str], i: int, state: int) -> Iterator[tuple[str, int, tuple[int, int]]]:
    """Edits that enter a node."""
    if i:
        initial, fault = codes[i - 1]
        yield "D", DELETE, (i - 1, state)
        if fault not in "bd":
            more = TRUNCATED if fault == "t" else 0
            for p in KEPT_BEFORE.get((state, initial), ()):
                yield "K", more, (i - 1, p)
            for p in BEFORE[state]:
                yield "R", REROLE + more, (i - 1, p)
    for p in BEFORE[state]:
        yield "I", INSERT, (i, p)


def cheapest(codes: list[str], start: int = EMPTY, ends: Iterable[int] = ACCEPTED) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits that lead from state ``start`` to one of ``ends``;
    of equally cheap ones the least audit. None if no edits do.

    Both heaps give nodes by (cost, rows read from their side, audit): an edit of no cost reads
    a row, so a node comes up after all that lead to it, with its least audit. No way to a node
    begins another of the same cost, so least parts make the least whole. The searches go on
    until no further way can be as cheap; then each cheapest way has an edge, or an end, between
    a node settled by one side and a node settled by the other, and all of these are looked at.
    """
    n, best = len(codes), float("inf")
    done: tuple[dict, dict] = ({}, {})  # node -> (cost, audit), of the forward and the reverse side
    heaps: tuple[list, list] = ([(0, 0, "", start)], [(0, 0, "", end) for end in sorted(ends)])

    def settle(side: int) -> None:
        nonlocal best
        cost, read, audit, state = heappop(heaps[side])
        node = (n - read if side else read, state)
        if node in done[side]:
            return
        done[side][node] = (cost, audit)
        if node in done[1 - side]:
            best = min(best, cost + done[1 - side][node][0])
        for letter, price, (i, s) in (_edges_back if side else _edges)(codes, *node):
            if (i, s) in done[1 - side]:
                best = min(best, cost + price + done[1 - side][i, s][0])
            if (i, s) not in done[side]:
                heappush(heaps[side], (cost + price, n - i if side else i, letter + audit if side else audit + letter, s))

    settle(0)
    for _ in heaps[1][:]:  # all ends, before anything that leads to them
        if heaps[1][0][:2] == (0, 0):
            settle(1)
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        settle(0 if (heaps[0][0][0], len(heaps[0])) <= (heaps[1][0][0], len(heaps[1])) else 1)
    least = None
    for node, (cost, audit) in done[0].items():
        ways = [("", 0, node), *_edges(codes, *node)]
        for letter, price, other in ways:
            rest = done[1].get(other)
            if rest is not None and cost + price + rest[0] == best:
                whole = audit + letter + rest[1]
                least = whole if least is None or whole < least else least
    return None if least is None else (int(best), least)


def _coded(turns: DataFrame) -> DataFrame:
    """conv_id, turn, seq, code of all rows, stored. seq numbers the rows by conversation and
    in its order; a conversation may reach over many partitions."""
    order = ["conv_id", "turn", "role", "digest"]
    ink = F.regexp_extract("text", rf"(?s)({INK})[\x20\x09-\x0D]*\z", 1)
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise(".")
    fault = F.when(ink == "", "b").when(~ink.rlike(ENDS), "t").otherwise("-")
    rows = turns.select("conv_id", "turn", "role", "digest", initial.alias("initial"), fault.alias("fault"))
    # equal rows are dealt by their place in the input, so many of them are many ranges
    ordered = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order, "place").sortWithinPartitions(*order, "place")
    rows = stored(ordered.withColumn("seq", F.monotonically_increasing_id()).drop("place"), "turns")
    firsts = rows.where("fault <> 'b'").groupBy("conv_id", "role", "digest").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("is_first"))
    known = rows.join(firsts, "seq", "left")
    seen = F.when((F.col("fault") != "b") & F.col("is_first").isNull(), "d").otherwise(F.col("fault"))
    return known.select("conv_id", "turn", "seq", F.concat("initial", seen).alias("code"))


_PATHS = "paths array<struct<from_state:int,to_state:int,cost:bigint,audit:string>>"
_STATS = "turns bigint, first_turn bigint, last_turn bigint, blank bigint, `duplicate` bigint, truncated bigint, illegal bigint, first string, last string"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (conv_id, block, first and last of the conversation, rows) to their figures and
    cheapest paths. Only states that can stand at the block's ends are tried."""
    names = ["conv_id", "block", "turns", "first_turn", "last_turn", "blank", "duplicate", "truncated", "illegal", "first", "last", "paths"]
    path = pa.list_(pa.struct([("from_state", pa.int32()), ("to_state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    for batch in batches:
        out = []
        for block in batch.select(["block", "begins", "ends", "rows"]).to_pylist():
            codes = [r["code"] for r in block["rows"]]
            turns = [r["turn"] for r in block["rows"] if r["turn"] is not None]
            pairs = list(zip(codes, codes[1:]))
            illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in pairs)
            paths = []
            for start in (EMPTY,) if block["begins"] else range(4):
                for ends in (ACCEPTED,) if block["ends"] else ((s,) for s in range(4)):
                    if (found := cheapest(codes, start, ends)) is not None:
                        paths.append({"from_state": start, "to_state": ends[0], "cost": found[0], "audit": found[1]})
            faults = [sum(c[1] == f for c in codes) for f in "bdt"]
            out.append((block["block"], len(set(turns)), turns[0] if turns else None, turns[-1] if turns else None, *faults, illegal, codes[0], codes[-1], paths))
        cols = list(zip(*out))
        kinds = [pa.int64()] * 8 + [pa.string()] * 2 + [path]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations (conv_id, blocks in order) to their report."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    for batch in batches:
        out = []
        for blocks in batch.column("blocks").to_pylist():
            ways, distinct, low, high, illegal = {EMPTY: (0, "")}, 0, None, None, 0
            last = None
            for b in blocks:
                new: dict[int, tuple[int, str]] = {}
                for p in b["paths"]:
                    if p["from_state"] in ways:
                        cost, audit = ways[p["from_state"]]
                        way = (cost + p["cost"], audit + p["audit"])
                        new[p["to_state"]] = min(new.get(p["to_state"], way), way)
                ways = new
                illegal += b["illegal"] + (last is not None and last[0] + b["first"][0] not in ("su", "ua", "au"))
                last = b["last"]
                if b["turns"]:
                    distinct += b["turns"] - (high == b["first_turn"])
                    low, high = b["first_turn"] if low is None else low, b["last_turn"]
            cost, audit = min(ways[s] for s in ACCEPTED if s in ways)
            faults = [sum(b[f] for b in blocks) for f in ("blank", "duplicate", "truncated")]
            out.append((high - low + 1 - distinct if distinct else 0, *faults, illegal, cost, audit))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, pa.string() if i == 6 else pa.int64()) for i, c in enumerate(zip(*out)))], names=names)


def _cleaned(turns: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def repair_report(turns: DataFrame) -> DataFrame:
    """For each conversation of turns (conv_id, turn, role, text): gaps, blank, duplicate,
    truncated, illegal, cost, audit, as ``repair_conversations`` states."""
    bound_batches(turns.sparkSession)
    rows = _cleaned(turns)
    kind = rows.schema["conv_id"].dataType.simpleString()
    coded = _coded(rows).withColumn("block", F.shiftright("seq", BLOCK_BITS))
    blocks = coded.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("seq", "turn", "code"))).alias("rows"))
    blocks = stored(blocks, "turn-blocks")
    # conversations of several blocks: at most one for each partition's edge and full block
    many = blocks.groupBy("conv_id").agg(F.min("block").alias("least"), F.max("block").alias("most")).where("least < most").withColumnRenamed("conv_id", "_conv")
    blocks = blocks.join(many, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    begins, ends = (F.coalesce(F.col("block") == F.col(c), F.lit(True)).alias(n) for c, n in (("least", "begins"), ("most", "ends")))
    solved = blocks.select("conv_id", "block", begins, ends, "rows").mapInArrow(tidy(_solve), f"conv_id {kind}, block bigint, {_STATS}, {_PATHS}")
    columns = [c for c in solved.columns if c != "conv_id"]
    whole = solved.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("blocks"))
    return whole.mapInArrow(tidy(_joined), f"conv_id {kind}, gaps bigint, blank bigint, `duplicate` bigint, truncated bigint, illegal bigint, cost bigint, audit string")


def repaired_turns(turns: DataFrame, report: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, at (from 0), edit (K, R, I), turn (null if inserted),
    role, text. A conversation's turns stand together and in order in one partition; they
    stream through a task, which holds the audit and a batch of texts."""
    rows = _cleaned(turns)
    kind = rows.schema["conv_id"].dataType.simpleString()
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    heads = report.select("conv_id", F.lit(0).alias("is_turn"), none("turn", "bigint"), none("role", "string"), F.col("audit").alias("text"), none("digest", "binary"))
    both = rows.select("conv_id", F.lit(1).alias("is_turn"), "turn", "role", "text", "digest").unionByName(heads)
    order = ["conv_id", "is_turn", "turn", "role", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, p, state, at = None, "", 0, EMPTY, 0
        for batch in batches:
            out: list[tuple] = []

            def inserted() -> None:
                nonlocal p, state, at
                while audit[p : p + 1] == "I":
                    state = NEXT[state]
                    out.append((conv, at, "I", None, ROLE[state], ""))
                    p, at = p + 1, at + 1

            for c, is_turn, turn, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "is_turn", "turn", "role", "text"))):
                if not is_turn:
                    conv, audit, p, state, at = c, text, 0, EMPTY, 0
                    inserted()  # those before the first turn
                    continue
                edit = audit[p]
                if edit != "D":
                    state = KEPT[state, role[:1]] if edit == "K" else NEXT[state]
                    out.append((c, at, edit, turn, role if edit == "K" else ROLE[state], text))
                    at += 1
                p += 1
                inserted()
            names = batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, names)], names=["conv_id", "at", "edit", "turn", "role", "text"])

    # a conversation may hold a third of all rows and its digest needs them one after another
    dealt = both.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select(*order[:-1], "text").mapInArrow(tidy(run), f"conv_id {kind}, at bigint, edit string, turn bigint, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its turns as ``role:text`` with line feeds between, of the
    rows of ``repaired_turns`` as they stand."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now = None, None
        for batch in batches:
            out = []
            for c, at, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "at", "role", "text"))):
                if at == 0:
                    if now is not None:
                        out.append((conv, now.hexdigest()))
                    conv, now = c, sha256()
                now.update(f"{chr(10) if at else ''}{role}:{text}".encode())
            cols = list(zip(*out)) or [(), ()]
            kept = batch.schema.field("conv_id").type
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], kept), pa.array(cols[1], pa.string())], names=["conv_id", "repaired_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kept), pa.array([now.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return repaired.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired turns) of conversations.

    turns: conv_id, turn, role, text; other columns are not looked at. Rows stand in the order
    of turn (null first), then role and digest of the text. A null role or text is one space,
    rows without a conv_id are one conversation. A row is blank without a character other than
    ASCII white space, else duplicate if a row before it has its role and text, else truncated if
    its last such character is none of ``.!?``. Edits: Keep costs nothing, Rerole to user or
    assistant 3, Delete 4, Insert an empty user or assistant turn 3; blank and duplicate rows
    must go, truncated ones that stay cost 3 more. The cheapest edits whose initials match
    ``(s?(ua)+)?`` are applied, the least audit of equally cheap ones; roles of other initials,
    and empty ones, are never kept.

    Report: conv_id, gaps (missing turn numbers), blank, duplicate, truncated (rows),
    illegal (neighbours whose initials aren't su, ua, au), cost, audit. Repeated rows are
    duplicates. An empty table gives empty results. Texts stream; a conversation's audit (a
    letter for each edit) and its blocks' audits are held by one task.
    """
    report = stored(repair_report(turns), "repairs")
    return report, repaired_turns(turns, report)
