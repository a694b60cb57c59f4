"""Nearest neighbours where more copies than RERANK stand in a block."""

import numpy as np
from pyspark.sql import functions as F

from sectionspark.llm import ann


def test_copies_beyond_the_reranked(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2400, 8))
    places = rng.permutation(2400)
    x[places[:900]] = x[places[0]]  # copies
    x[places[900:905]] = x[places[0]] + 1e-3 * rng.standard_normal((5, 8))
    ids = rng.permutation(2400)
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x)]
    queries = {int(ids[places[k]]) for k in (0, 1, 900, 901, 2000)}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(table, F.col("vec_id").isin(list(queries))).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == queries
    for q in queries - {int(ids[places[2000]])}:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        assert got[q] == [int(ids[j]) for j in np.lexsort((ids, d))[:10]]


def test_pivots_in_bounded_memory():
    """20,000 pivots, copies among them: a few rows at once, and the same as a full sort."""
    import tracemalloc

    import numpy as np

    from sectionspark.llm.pivot_dedup import nearest_pivots
    from sectionspark.llm.vectors import unit

    r = np.random.default_rng(1)
    pivots = unit(r.standard_normal((20_000, 16)))
    pivots[100:200] = pivots[50]
    x = np.concatenate([r.standard_normal((1500, 16)), pivots[[50, 50]] * 3])
    tracemalloc.start()
    got = nearest_pivots(x, pivots, 8)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20  # a full sort holds over 450 MB
    tracemalloc.stop()
    for i in [*range(0, 1500, 50), 1500, 1501]:
        s = unit(x[i : i + 1]) @ pivots.T
        assert set(got[i]) == set(np.argsort(-s[0], kind="stable")[:8])
    assert nearest_pivots(x[:3], pivots[:0], 0).shape == (3, 0)
