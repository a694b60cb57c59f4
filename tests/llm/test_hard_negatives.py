import math
import random

from pyspark.sql import functions as F

from sectionspark.llm import hard_negatives as H


def brute(rows, n_pos=5, n_neg=3):
    """rows: id, label, vector; anchors are even ids."""
    ok = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = min(ok[i], (label, v)) if i in ok else (label, v)
    q = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in ok.items()}
    score = lambda a, b: sum(x * y for x, y in zip(q[a][1], q[b][1]))
    out = []
    for a in (i for i in q if i % 2 == 0):
        order = lambda same: sorted((i for i in q if i != a and (q[i][0] == q[a][0]) == same), key=lambda i: (-score(a, i), i))
        for p in order(True)[:n_pos]:
            ps = score(a, p)
            near = [i for i in order(False) if 50 * ps <= 100 * score(a, i) <= 95 * ps][:n_neg]
            out += [(a, p, k + 1, i, ps, score(a, i)) for k, i in enumerate(near)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"limits": F.lit("x"), "row": F.lit(1), "id": F.lit(2), "g": F.lit(3), "slot": F.lit(4)})
    got = H.hard_negatives(df, F.col("vec_id") % 2 == 0, **kw)
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def odd():
    r = random.Random(3)
    base = [[round(r.gauss(0, 1), 1) for _ in range(4)] for _ in range(40)]
    rows = [(i, r.choice([0, 0, 0, 1, 2]), base[r.randrange(40)]) for i in range(200)]  # copies: tied scores
    rows += [(200, None, base[0]), (201, 1, None), (202, 1, [1.0, None, 0.0, 0.0]), (203, 1, [float("nan")] * 4), (204, 2, [float("inf")] * 4), (None, 1, base[1])]
    rows += [(206, 1, [0.0] * 4), (208, 7, base[3]), (210, 1, [0.5, 0.25]), (212, 1, []), (10, 2, base[5]), (12, rows[12][1], rows[12][2])]
    return rows


def test_same_as_brute_force(spark):
    assert mined(spark, odd()) == brute(odd())


def test_blocks_of_anchors_and_rows(spark, monkeypatch):
    """A label of more rows and more anchors than a block holds, met in many cells."""
    monkeypatch.setattr(H, "LEAST_ROWS", 16)
    monkeypatch.setattr(H, "ANCHORS", 9)
    monkeypatch.setattr(H, "isqrt", lambda n: 0)
    assert mined(spark, odd()) == brute(odd())
    monkeypatch.setattr(H, "TILE", 4)
    assert mined(spark, odd(), n_positives=2, n_negatives=1) == brute(odd(), 2, 1)


def test_large_components_stay_exact(spark):
    """Sums over 2^53 are whole numbers still."""
    r = random.Random(4)
    rows = [(i, i % 3, [float(r.randrange(1, 2**20)), float(r.randrange(1, 9))]) for i in range(30)]
    rows = [(i, label, [float(x) for x in v]) for i, label, v in rows]
    assert mined(spark, rows) == brute(rows)


def test_empty_and_alone(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(2, 1, [1.0]), (3, 2, [1.0])]) == []
