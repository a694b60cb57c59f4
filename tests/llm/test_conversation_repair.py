import hashlib
import random
import re
import zlib
from functools import lru_cache

from pyspark.sql import functions as F

from sectionspark.llm import conversation_repair as C
from sectionspark.llm import queries as Q

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def best_edits(codes, start="", ends=("", "a")):
    """By trying all edits at each place, remembering what followed."""

    @lru_cache(None)
    def after(i, state, inserts):
        ways = [(0, "")] if i == len(codes) and state in ends else []
        steps = []
        if i < len(codes):
            initial, fault = codes[i]
            steps.append((4, "D", i + 1, state, 3))
            if fault not in "bd":
                more = 3 * (fault == "t")
                if state in {"s": [""], "u": ["", "s", "a"], "a": ["u"]}.get(initial, []):
                    steps.append((more, "K", i + 1, initial, 3))
                steps.append((3 + more, "R", i + 1, NEXT[state], 3))
        if inserts:
            steps.append((3, "I", i, NEXT[state], inserts - 1))
        for cost, edit, j, s, left in steps:
            if (rest := after(j, s, left)) is not None:
                ways.append((cost + rest[0], edit + rest[1]))
        return min(ways, default=None)

    return after(0, start, 3)


def damaged(rows):
    text = lambda v: " " if v is None else str(v)
    for c, t, r, x in rows:
        kind, r, x = zlib.crc32(f"{text(c)}:{text(t)}".encode()) % 20, text(r), text(x)
        x = {1: "", 2: re.sub("[.!?]", "", x)}.get(kind, x)
        yield from [(c, t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)


def report(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, codes = set(), []
    for _, _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0d]", text)
        fault = "b" if not ink else "d" if (role, text) in seen else "-" if ink[-1] in ".!?" else "t"
        seen.add((role, text))
        codes.append((role[:1] if role[:1] in ("s", "u", "a") else ".", fault))
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
    cost, audit = best_edits(tuple(codes))
    out, state, i = [], "", 0
    for edit in audit:
        row = None if edit == "I" else rows[i]
        i += edit != "I"
        if edit == "K":
            state = row[2][:1]
            out.append(f"{row[2]}:{row[3]}")
        elif edit != "D":
            state = NEXT[state]
            out.append(f"{ {'u': 'user', 'a': 'assistant'}[state] }:{row[3] if row else ''}")
    return (gaps, *(sum(f == c for _, f in codes) for c in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def expected(rows):
    by = {r[0]: [] for r in rows}
    for r in damaged(rows):
        by[r[0]].append(r)
    return {c: report(rs) for c, rs in by.items()}


def got(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({"seq": F.lit("x"), "code": F.lit(1), "block": F.lit(2), "digest": F.lit("d"), "id": F.lit(9), "audit": F.lit("z")})
    path = str(tmp_path / "conversations.parquet")
    df.write.mode("overwrite").parquet(path)
    return {r[0]: tuple(r)[1:] for r in Q.op11_conversation_repair(spark, str(tmp_path)).collect()}


def conversations(seed=1, convs=60, most=9):
    r = random.Random(seed)
    rows = []
    for c in [*range(convs), None]:
        for t in range(r.randint(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "User"])
            text = r.choice(["Yes.", "No!", "why", "", " \t\n", None, "é?", "ok\n", "a b. ", f"{t}."])
            rows.append((c, r.choice([t, t, t, 2 * t, None]), role, text))
    return rows + [(1000, 0, "user", "x" * 200_000), (1001, -5, "system", "s."), (1001, 2**40, "user", "u.")] + rows[:3] * 2


def test_search_is_exact():
    r = random.Random(0)
    names = ["", "s", "u", "a"]
    for _ in range(400):
        codes = tuple((r.choice("suua.a"), r.choice("----tbd")) for _ in range(r.randint(0, 9)))
        assert C.cheapest(list(codes)) == best_edits(codes)
        start, end = r.randrange(4), r.randrange(4)
        assert C.cheapest(list(codes), start, (end,)) == best_edits(codes, names[start], (names[end],))


def test_same_as_brute_force(spark, tmp_path):
    rows = conversations()
    assert got(spark, rows, tmp_path) == expected(rows)


def test_conversations_over_many_blocks(spark, tmp_path, monkeypatch):
    """Blocks of four rows, one conversation in many partitions."""
    monkeypatch.setattr(C, "BLOCK_BITS", 2)
    rows = conversations(2, 8, 60)
    assert got(spark, rows, tmp_path) == expected(rows)


def test_one_large_conversation(spark, tmp_path):
    """Real blocks: the searches hold 1024 rows each."""
    r = random.Random(5)
    rows = [(7, t, ["user", "assistant"][t % 2] if r.random() < 0.9 else "tool", f"{r.randrange(2000)}{'.' if r.random() < 0.9 else ''}") for t in range(5000)] + conversations(3, 5)
    out = got(spark, rows, tmp_path)
    small = [r for r in rows if r[0] != 7]
    assert {c: v for c, v in out.items() if c != 7} == expected(small)
    codes, seen = [], set()
    for _, _, role, text in damaged([r for r in rows if r[0] == 7]):
        ink = text.strip()
        codes.append((role[0] if role[0] in "sua" else ".", "b" if not ink else "d" if (role, text) in seen else "-" if ink[-1] in ".!?" else "t"))
        seen.add((role, text))
    assert out[7][5] == least_cost(codes)
    assert out[7][1:4] == tuple(sum(f == c for _, f in codes) for c in "bdt")


def least_cost(codes):
    """The least cost by a pass over the rows."""
    far = 10**9

    def settled(cost):
        for _ in range(3):
            for s, n in NEXT.items():
                cost[n] = min(cost[n], cost[s] + 3)
        return cost

    cost = settled({"": 0, "s": far, "u": far, "a": far})
    for initial, fault in codes:
        new = {s: c + 4 for s, c in cost.items()}
        if fault not in "bd":
            for s, n in NEXT.items():
                more = 3 * (fault == "t")
                new[n] = min(new[n], cost[s] + 3 + more)
                if s in {"s": [""], "u": ["", "s", "a"], "a": ["u"]}.get(initial, []):
                    new[initial] = min(new[initial], cost[s] + more)
        cost = settled(new)
    return min(cost[""], cost["a"])


def test_all_rows_dropped_and_empty_table(spark, tmp_path):
    lost = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    rows = [(c, 0, "user", "Hm.") for c in lost]
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(spark, rows, tmp_path) == {c: nothing for c in lost}
    assert got(spark, [], tmp_path) == {}


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi"), (1, 1, "user", "Hi"), (2, 0, "system", "Be brief."), (2, 3, "user", "Why?")]
    report, turns = C.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {(r.conv_id, r.audit, r.cost, r.gaps) for r in report.collect()} == {(1, "IKDD", 11, 0), (2, "KKI", 3, 2)}
    assert sorted(tuple(r) for r in turns.collect()) == [(1, 0, "I", None, "user", ""), (1, 1, "K", 0, "assistant", "Hello."), (2, 0, "K", 0, "system", "Be brief."), (2, 1, "K", 3, "user", "Why?"), (2, 2, "I", None, "assistant", "")]
