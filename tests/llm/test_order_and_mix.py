"""Sharding, mixing, token counts, packing: round trips and brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectionspark.llm import histogram_sort, mixing, packing, queries, token_counts

P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize(("shards", "cell"), [(4, 1 << 30), (5, 20_000)])
def test_shards(make_docs, odd_rows, shards, cell):
    docs = make_docs(odd_rows)
    out = histogram_sort.shard_documents(docs, shards, cell_bytes=cell)
    assert out.columns == [*docs.columns, "_size", "_slot", "_shard"]
    rows = out.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in odd_rows)
    assert all(r["_size"] == len((r["text"] or "").encode()) + 8 for r in rows)
    held = defaultdict(list)
    for r in rows:
        held[r["_shard"]].append(r["_slot"])
    assert all(sorted(v) == list(range(len(v))) for v in held.values()) and set(held) <= set(range(shards))


def test_shards_are_near_equal(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 40)) for i in range(6000)]
    out = histogram_sort.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 24)
    sizes = [r[1] for r in out.groupBy("_shard").agg(F.sum("_size")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 0.03 * np.mean(sizes)
    # only a group larger than the tolerance is cut, and then over neighbours
    cut = out.groupBy("text").agg(F.countDistinct("_shard").alias("n"), F.max("_shard") - F.min("_shard")).where("n > 1").collect()
    assert all(r[0] == "same text" and r[1] == r[2] + 1 for r in cut)


def test_splitters_are_exact(spark):
    keys = [(v * v % 977, v % 50, v % 7 + 1) for v in range(3000)] + [(400, i, 5) for i in range(2000)]
    table = spark.createDataFrame(keys, "k1 long, k2 long, size long").cache()
    total = sum(k[2] for k in keys)
    got = histogram_sort.find_splitters(table, [total * i / 10 for i in range(1, 10)], [0.0] * 9, bins=8)
    for i, (bound, below) in enumerate(zip(got.bounds, got.starts)):
        assert below == sum(k[2] for k in keys if k[:2] < bound)
        at_bound = [k[2] for k in keys if k[:2] == min((x[:2] for x in keys if x[:2] >= bound), default=None)]
        assert abs(below - total * (i + 1) / 10) <= max(7 * 60, sum(at_bound))


def test_mix(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    rows = mixing.mix(docs, F.array("source"), queries.weights_5_2_1).collect()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in odd_rows}
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in odd_rows) and all(r["size"] == words[r["doc_id"]] for r in rows)
    total, source = sum(words[i] for i, *_ in odd_rows), {i: s for i, _, _, s in odd_rows}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["repeats"]
    assert all(r["source_size"] == size[source[r["doc_id"]]] for r in rows)
    assert sum(target.values()) == pytest.approx(min(total, sum(3 * n for n in size.values()))) and all(target[s] <= 3 * size[s] + 1e-6 for s in size)
    assert [tuple(r) for r in mixing.mix(docs, F.array("source"), queries.weights_5_2_1).orderBy("doc_id", "taken").collect()] == sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[4]))


def test_many_bounds(spark):
    """More cells than one expression tree could hold."""
    from bisect import bisect_right

    bounds = sorted({(v * v % 100_003, v % 7 - 3) for v in range(6000)})
    keys = [(v * 7 % 100_003, v % 9 - 4) for v in range(0, 90_000, 45)] + bounds[:50] + [(-1, 0), (1 << 60, 0)]
    table = spark.createDataFrame(keys, "k1 long, k2 long")
    got = table.select("k1", "k2", histogram_sort.cell_of(F.col("k1"), F.col("k2"), bounds).alias("c")).collect()
    assert all(r["c"] == bisect_right(bounds, (r["k1"], r["k2"])) for r in got) and len(got) == len(keys)


def test_many_sources(spark):
    """Every source is a part of the flow of its own."""
    n = 20_500
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), "id").alias("source"))
    rows = mixing.mix(docs, F.array("source"), lambda sources: [1] * len(sources)).agg(F.count("*"), F.sum("taken"), F.min("taken"), F.max("target")).first()
    assert tuple(rows) == (n, 3 * n, 3, 3.0)
    with pytest.raises(ValueError):
        mixing.mix(docs, F.array("source"), lambda sources: [1] * len(sources), max_passes=9)


def test_large_flow():
    """A connected part of many arcs; all quotas that can be met are."""
    r = random.Random(8)
    sources = [f"s{i}" for i in range(400)]
    patterns = {tuple(sorted(r.sample(sources, r.randint(1, 4)))): r.randint(1, 1000) for _ in range(30_000)}
    total = sum(patterns.values())
    targets = {s: total / 400 for s in sources}
    flow = mixing.min_cost_flow(patterns, targets, 3)
    assert sum(flow.values()) == sum(round(t) for t in targets.values()) and all(0 <= flow[p] <= 3 * n for p, n in patterns.items())


def test_kinds_are_taken_in_order_of_cost(spark):
    """Half of the words: the long documents alone; one and a half times: all, and long ones again."""
    rows = [(i, "w " * (40 if i % 2 else 4), "s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    short = (F.length("text") < 40).cast("int")
    for share, want in ((0.5, (0, 440)), (1.5, (80, 1240))):
        got = mixing.mix(docs, F.array("source"), lambda s: [1], total_share=share, kind=short, kind_costs=(0, 0.5)).collect()
        short_words, all_words = sum(r["taken"] for r in got if r["doc_id"] % 2 == 0), sum(r["taken"] for r in got)
        assert short_words == want[0] and abs(all_words - 880 * share) <= 40
        flat = mixing.mix(docs, F.array("source"), lambda s: [1], total_share=share).collect()
        assert {(r["doc_id"], r["taken"]) for r in flat} != {(r["doc_id"], r["taken"]) for r in got}


def test_targets_by_hand():
    got = mixing.capped_targets({"a": 10, "b": 100, None: 90, "e": 0}, {"a": 5, "b": 2, None: 1, "e": 5}, 200, 3)
    assert got == {"a": 30.0, "b": pytest.approx(170 * 2 / 3), None: pytest.approx(170 / 3), "e": 0.0}


@pytest.mark.parametrize("extra", [{}, {("a", "b"): 0.5}, {("a",): 2, ("b",): 0.5}])
def test_flow_against_brute_force(extra):
    """Overlapping sources: the flow's cost is the least of all integer routings."""
    patterns, targets = {("a",): 3, ("a", "b"): 4, ("b",): 2}, {"a": 8, "b": 7}
    flow = mixing.min_cost_flow(patterns, targets, 3, extra=extra)
    assert sum(flow.values()) == 15

    def cost(p, n):
        return sum((mixing.PASS_COSTS[k] + extra.get(p, 0)) * min(patterns[p], max(0, n - k * patterns[p])) for k in range(3))

    best = min(cost(("a",), x) + cost(("a", "b"), y) + cost(("b",), 15 - x - y) for x in range(10) for y in range(13) if 0 <= 15 - x - y <= 6 and x <= 8 and 15 - x - y <= 7 and x + y >= 8 and y + 15 - x - y >= 7)
    assert sum(cost(p, n) for p, n in flow.items()) == best


def test_token_counts(spark, make_docs, odd_rows, tmp_path):
    counter = token_counts.SentencePieceCounter(P.path("piece_bpe_32k.model"))
    rows = [r for r in odd_rows if r[0] != 87]  # one word of 200,000 letters takes long
    docs, cache = make_docs(rows), str(tmp_path / "cache")
    text = {i: t or "" for i, t, *_ in rows}
    for _ in range(2):  # the second time all are hits
        got = token_counts.token_counts(docs, counter, cache).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in rows)
        assert all((r["n_bytes"], r["n_tokens"]) == (len(text[r["doc_id"]].encode()), counter([text[r["doc_id"]]])[0]) for r in got)
    stored = spark.read.parquet(cache)
    assert stored.count() == len(set(text.values())) and {r[0] for r in stored.select("version").collect()} == {counter.version}
    extra = docs.limit(1).withColumn("text", F.lit("a new text"))
    token_counts.token_counts(extra, counter, cache).collect()
    assert spark.read.parquet(cache).count() == len(set(text.values())) + 1


def test_packing(make_docs, odd_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [r for r in odd_rows if r[0] not in (86, 87)]
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    got = queries.packed_digest(packing.pack(make_docs(rows), packing.WordTokenizer(P.path("word_bpe_49k.json")))).collect()
    at, sequences = defaultdict(int), defaultdict(list)
    for r in sorted(got, key=lambda r: (r["doc_id"] or -1, r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(own)
        at[r["doc_id"]] += r["length"]
        assert zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert dict(at) == {i: len(v) for i, v in ids.items()}
    for s, pieces in sequences.items():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces[:-1]]))
        assert sum(n for _, n in pieces) == 2048 or s == max(sequences)
    twice = packing.pack(make_docs([r for r in odd_rows if r[0] == 86]), packing.WordTokenizer(P.path("word_bpe_49k.json"))).collect()
    assert [r["offset"] for r in sorted(twice, key=lambda r: r["offset"])] == [0, len(twice[0]["ids"]) // 4]


def test_pieces_are_whole_texts():
    """Encoding piece by piece is encoding the text."""
    import random

    from tokenizers import Tokenizer

    library, own, r = Tokenizer.from_file(P.path("word_bpe_49k.json")), packing.WordTokenizer(P.path("word_bpe_49k.json")), random.Random(2)
    pool = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xC0, 0x180)]] + ["'s", "'LL", "<|endoftext|>", "İ", "ΣΑΣ", "é", "\x85", "\xa0", "½", "٣", "你", "ŉ", "\x1c", "🙂"]
    for n in range(3000):
        text = "".join(r.choice(pool[: -14 if n % 2 else None]) for _ in range(r.choice([2, 6, 30])))
        assert own([text], 1)[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], text


def test_hilbert_curve():
    """Each cell once, neighbours along the curve next to each other, in any dimension."""
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), -1).reshape(-1, n)
        order = cells[np.argsort(packing.hilbert_keys(cells, bits))]
        assert sorted(packing.hilbert_keys(cells, bits)) == list(range(len(cells)))
        assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_empty_tables(make_docs):
    docs = make_docs([])
    assert histogram_sort.shard_documents(docs).count() == 0
    assert mixing.mix(docs, F.array("source"), queries.weights_5_2_1).count() == 0
    assert token_counts.token_counts(docs, token_counts.SentencePieceCounter(P.path("piece_bpe_32k.model"))).count() == 0
    assert packing.pack(docs, packing.WordTokenizer(P.path("word_bpe_49k.json"))).count() == 0
