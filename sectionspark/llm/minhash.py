"""Operator 5, MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

Each document is a weighted set of word shingles. Consistent weighted samples (Ioffe,
"Improved Consistent Sampling, Weighted Minhash and L1 Sketching", 2010) agree with a
probability equal to the weighted Jaccard similarity; documents that agree in all samples of
a band are candidates, and candidates are verified by their weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionspark.llm.components import components
from sectionspark.llm.scratch import bound_batches, stored
from sectionspark.llm.textbatch import Chunk, chunks, mix64, run_hashes, runs, segment_sums, tidy

#: Words in a shingle; a text with fewer words is one shingle.
WORDS = 5
#: Document frequencies are kept for hashed shingles, in so many counters (8 bytes each).
COUNTERS, SLICES = 1 << 20, 64
#: Bands and samples in a band: a pair at 0.8 is missed with 0.3 %, one at 0.9 with 3 in 10**5.
BANDS, ROWS = 8, 3
#: Up to so many candidate documents (8 bytes each) their ids are broadcast to fetch texts.
BROADCAST_IDS = 2_000_000
#: Rows in a block when all pairs of a bucket are verified, and pairs for each candidate
#: document, on average, above which turns of single comparisons come first. Both ways verify
#: pairs that share a bucket, and end when none of different classes is left: the classes
#: don't depend on where one way ends and the other begins.
BLOCK, PAIRS_A_TURN = 128, 2000

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingles(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) with their counts, sorted by row and shingle, and two digests of
    each row's words. Words are runs of letters, digits and _ without regard to case."""
    n = c.hi - c.lo
    b, e, rows = runs(_WORD[c.data], c.starts)
    with np.errstate(over="ignore"):
        h = run_hashes(_FOLD[c.data], b, e)
        first = np.searchsorted(rows, np.arange(n + 1))
        place = (np.arange(len(h)) - first[rows]).astype(np.uint64)
        digests = np.stack([_wrapped_sums(mix64(h + (place + np.uint64(s)) * np.uint64(0x9E3779B97F4A7C15 + 2 * s)), first) for s in (1, 2)], 1)
        sums = np.zeros(len(h), np.uint64)
        for k in range(WORDS):
            odd = np.uint64(2 * k * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15 & (1 << 64) - 1) | np.uint64(1)
            last = first[1:][rows] - 1  # a short text ends early: its one shingle is all of it
            at = np.arange(len(h)) + k
            sums += np.where(at <= last, h[np.minimum(at, max(0, len(h) - 1))] * odd, 0)
        whole = (place == 0) | (np.arange(len(h)) + WORDS <= first[1:][rows])
        keys = (rows[whole].astype(np.uint64) << np.uint64(44)) | (mix64(sums[whole]) >> np.uint64(20))
    keys.sort()
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    tf = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    return (keys >> np.uint64(44)).astype(np.int64), keys & np.uint64((1 << 44) - 1), tf, digests


def _wrapped_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1, np.uint64)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[full])
    return out


def _gamma_quantiles(n: int) -> np.ndarray:
    """n quantiles of the Gamma(2, 1) distribution."""
    x = np.geomspace(1e-5, 40, 200_000)
    return np.interp((np.arange(n) + 0.5) / n, 1 - (1 + x) * np.exp(-x), x)


class Sampler:
    """Samples of weighted sets. The random numbers of a (shingle, sample) come from a hash."""

    def __init__(self):
        self.r = _gamma_quantiles(4096).astype(np.float32)
        self.inverse_r = (1 / self.r).astype(np.float32)
        self.log_c = np.log(_gamma_quantiles(65536)).astype(np.float32)

    def bands(self, rows: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """(n, BANDS) band keys; rows without shingles get keys that mean nothing."""
        out = np.zeros((n, BANDS), np.uint64)
        starts = np.flatnonzero(np.diff(rows, prepend=-1)) if len(rows) else np.zeros(0, np.int64)
        if not len(starts):
            return out
        own, log_w = rows[starts], np.log(weights).astype(np.float32)
        with np.errstate(over="ignore"):
            for s in range(BANDS * ROWS):
                x = (keys ^ np.uint64(0x517CC1B727220A95 * (s + 1) & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
                at = (x >> np.uint64(52)).astype(np.int64)
                beta = ((x >> np.uint64(40)) & np.uint64(4095)).astype(np.float32) * np.float32(1 / 4096) + np.float32(1 / 8192)
                t = np.floor(log_w * self.inverse_r[at] + beta)
                log_a = self.log_c[((x >> np.uint64(20)) & np.uint64(65535)).astype(np.int64)] - self.r[at] * (t - beta + 1)
                # the smallest log a is a function of the sampled shingle and its t alone
                least = np.minimum.reduceat(log_a, starts).view(np.uint32).astype(np.uint64)
                band = s // ROWS
                out[own, band] = mix64(out[own, band] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(band + 1))
        return out


def idf_weights(keys: np.ndarray, tf: np.ndarray, counts: np.ndarray, n_docs: int) -> np.ndarray:
    """tf x smoothed idf, from the counter of each shingle; always positive."""
    df = counts[(keys & np.uint64(COUNTERS - 1)).astype(np.int64)]
    return tf * (np.log((1 + n_docs) / (1 + np.minimum(df, n_docs))) + 0.1)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents of all the table for each counter, and the number of documents. Counters are
    added up slice by slice; COUNTERS numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            seen += batch.num_rows
            for c in chunks(batch.column(0)):
                _, keys, _, _ = shingles(c)
                counts += np.bincount((keys & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        if seen:
            parts = [p.astype("<i8").tobytes() for p in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([seen] * SLICES), pa.array(parts, pa.binary())], names=["slice", "n", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for k, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                own = sums.setdefault(k, [0, np.zeros(COUNTERS // SLICES, np.int64)])
                own[0] += n
                own[1] += np.frombuffer(raw, "<i8")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v[0] for v in sums.values()]), pa.array([v[1].tobytes() for v in sums.values()], pa.binary())], names=["slice", "n", "counts"])

    schema = "slice int, n bigint, counts binary"
    got = docs.select(text_col).mapInArrow(tidy(count), schema).repartition(SLICES, "slice").mapInArrow(tidy(add), schema).collect()
    out, n = np.zeros((SLICES, COUNTERS // SLICES), np.int64), 0
    for k, seen, raw in got:
        out[k], n = np.frombuffer(raw, "<i8"), seen
    return out.ravel(), n


def weighted_jaccard(a_keys: np.ndarray, a_w: np.ndarray, b_keys: np.ndarray, b_w: np.ndarray) -> float:
    at = np.minimum(np.searchsorted(a_keys, b_keys), len(a_keys) - 1)
    same = a_keys[at] == b_keys
    both = np.minimum(a_w[at[same]], b_w[same]).sum()
    return float(both / (a_w.sum() + b_w.sum() - both))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each id and text: id, class_id (smallest id of its class), kept (the row of
    that id; of several texts with that id, the first by digest). Rows with a null id are left
    out; ``text_classes`` has them.
    """
    out = text_classes(docs, threshold, id_col, text_col, null_ids=False)
    return out.select(id_col, "class_id", "kept")


def text_classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", null_ids: bool = True) -> DataFrame:
    """One row for each id and text: id, text_digest (xxhash64 of the text), class_id, kept.
    One row of a class is kept: the first by (id, digest), null ids first.

    Classes are the components of the links between different texts whose weighted Jaccard
    similarity over shingles of WORDS words is at least the threshold; texts with the same
    words are one text. Texts without words (null, empty) are classes of their own. Rows
    that share an id (or have none) and differ in their texts are different documents; rows
    equal in both are one.

    Members of a band's bucket meet its first member. While very many pairs of different
    classes are left in the buckets, a turn pairs each member outside its bucket's largest
    class with one member of that and one of another class; the pairs that are left in a bucket
    then are verified whole, block by block, so no candidate link is lost and none is found
    that shares no bucket. A very long text is one set of more shingles, held whole by a task.
    An empty table gives an empty result; other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folded = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("t"), F.lower(text_col).alias("text"))
    counts, n_docs = document_frequencies(folded)
    model = spark.sparkContext.broadcast((counts, n_docs))  # COUNTERS x 8 bytes

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n_docs = model.value
        sampler = Sampler()
        for batch in batches:
            for c in chunks(batch.column(2)):
                rows, keys, tf, digests = shingles(c)
                n = c.hi - c.lo
                bands = sampler.bands(rows, keys, idf_weights(keys, tf, counts, n_docs), n)
                size = np.bincount(rows, minlength=n)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                columns = [batch.column(0).slice(c.lo, n), batch.column(1).slice(c.lo, n), *(pa.array(digests[:, k].copy().view(np.int64)) for k in (0, 1)), pa.array(size), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "t", "d1", "d2", "size", "bands"])

    folded = folded if null_ids else folded.where("id is not null")
    signed = folded.mapInArrow(tidy(sign), "id bigint, t bigint, d1 bigint, d2 bigint, size bigint, bands array<bigint>")
    signed = signed.groupBy("id", "t").agg(F.min(F.struct("d1", "d2", "size", "bands")).alias("s"), (F.count("*") > 1).alias("repeated")).select("id", "t", "repeated", "s.*")
    signed = stored(signed, "signatures")
    worded = signed.where("size > 0")
    same = worded.groupBy("d1", "d2").agg(F.min(F.struct("id", "t", "repeated")).alias("rep"), F.first("bands").alias("bands"))
    # one row for each different text, with a number that stands for it in links
    texts = stored(same.withColumn("node", F.monotonically_increasing_id()), "texts")
    buckets = texts.select(F.col("node").alias("id"), F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("id").alias("lead")).where("n > 1")
    members = stored(buckets.join(shared, ["band", "key"]), "buckets")
    found = _classes(folded, texts.select("node", "rep.*"), members, threshold, model)
    # the first document of each class
    heads = texts.select(F.col("node").alias("id"), F.struct("rep.id", "rep.t").alias("head"))
    firsts = found.join(heads, "id").groupBy("component").agg(F.min("head").alias("first"))
    firsts = found.join(firsts, "component").select("id", "first")
    firsts = texts.select("d1", "d2", F.col("node").alias("id")).join(heads, "id").join(firsts, "id", "left").select("d1", "d2", F.coalesce("first", "head").alias("first"))
    out = signed.join(firsts, ["d1", "d2"], "left").withColumn("own", F.struct("id", "t"))
    out = out.withColumn("first", F.when(F.col("size") > 0, F.coalesce("first", "own")).otherwise(F.col("own")))
    return out.select(F.col("id").alias(id_col), F.col("t").alias("text_digest"), F.col("first.id").alias("class_id"), (F.col("own") == F.col("first")).alias("kept"))


def _classes(folded: DataFrame, texts: DataFrame, members: DataFrame, threshold: float, model) -> DataFrame:
    """(id, component) of all verified links that the buckets can give; ids are nodes of texts."""
    spark = members.sparkSession
    ids = members.select("id").distinct()
    n_ids = ids.count()
    wanted = texts.join(ids.withColumnRenamed("id", "node"), "node", "left_semi")
    repeated = wanted.where("repeated").limit(1).count() > 0
    wanted = F.broadcast(wanted) if 4 * n_ids <= BROADCAST_IDS else wanted  # 32 bytes each

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                rows, keys, tf, _ = shingles(c)
                weights = idf_weights(keys, tf, *model.value).astype("<f4")
                cut = np.searchsorted(rows, np.arange(c.hi - c.lo + 1))
                raw = [(keys[a:b].astype("<u8").tobytes(), weights[a:b].tobytes()) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.hi - c.lo), pa.array([r[0] for r in raw], pa.binary()), pa.array([r[1] for r in raw], pa.binary())], names=["id", "k", "w"])

    own = folded.alias("a").join(wanted.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.t") == F.col("b.t"))).select(F.col("b.node").alias("id"), "a.text", "b.repeated")
    texts = own.select("id", "text")
    if repeated:  # of rows equal in id and text, one
        once = own.where("repeated").groupBy("id").agg(F.first("text").alias("text"))
        texts = own.where("not repeated").select("id", "text").union(once)
    sets = texts.mapInArrow(tidy(weigh), "id bigint, k binary, w binary")
    sets = stored(sets, "weighted-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, ku, wu, kv, wv = (c.to_pylist() for c in batch.columns)
            out = []
            for i in range(len(u)):
                got = weighted_jaccard(np.frombuffer(ku[i], "<u8"), np.frombuffer(wu[i], "<f4"), np.frombuffer(kv[i], "<u8"), np.frombuffer(wv[i], "<f4"))
                out.append(got)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["u", "v", "similarity"])

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sets.select(F.col("id").alias("v"), F.col("k").alias("kv"), F.col("w").alias("wv")), "v")
        both = left.join(sets.select(F.col("id").alias("u"), F.col("k").alias("ku"), F.col("w").alias("wu")), "u")
        return stored(both.select("u", "v", "ku", "wu", "kv", "wv").mapInArrow(tidy(compare), "u bigint, v bigint, similarity double"), "similarities")

    pair = (F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    pairs = members.where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).select(*pair).distinct()
    done = verified(pairs)
    linked = lambda df: df.where(F.col("similarity") >= threshold).select("u", "v")
    found = stored(components(linked(done)), "classes")
    turn, news = 0, 1
    while True:
        turn += 1
        # what is left to compare: members of buckets that hold several classes; of two members
        # the pair is already verified
        now = members.where("n > 2").select("band", "key", "id", "lead").join(found, "id", "left").select("band", "key", "id", "lead", F.coalesce("component", "id").alias("c"))
        by_class = now.groupBy("band", "key", "c").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), "id")).alias("spokesman"))
        several = by_class.groupBy("band", "key").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("s"), F.max(F.struct("n", "c", "spokesman")).alias("main"), F.count("*").alias("classes")).where("classes > 1")
        rest = now.join(several.select("band", "key", "m", "s", F.col("main.c").alias("main"), F.col("main.spokesman.id").alias("speaks")), ["band", "key"])
        rest = stored(rest, "open-buckets")
        open_pairs = rest.agg(F.sum((F.col("m") * F.col("m") - F.col("s")) / 2 / F.col("m"))).first()[0] or 0
        if not open_pairs:
            return found
        if open_pairs <= PAIRS_A_TURN * n_ids or not news:
            break
        # members outside a bucket's largest class meet another of its members each turn, and
        # one of the other classes
        outside = rest.where("c <> main")
        heads = outside.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), "id", "c")).alias("head"))
        both = outside.join(heads, ["band", "key"])
        pairs = both.select(F.col("id").alias("a"), F.explode(F.array(F.col("speaks"), F.when(F.col("c") != F.col("head.c"), F.col("head.id")))).alias("b")).where("b is not null")
        fresh = verified(pairs.select(*pair).distinct().join(done.select("u", "v"), ["u", "v"], "left_anti"))
        news = linked(fresh).count()
        if news:
            found = _merged(found, linked(fresh))
        done = done.union(fresh)
    return _merged(found, _block_links(rest, sets, threshold))


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    return stored(components(links.union(found.select(F.col("id").alias("u"), F.col("component").alias("v")))), "classes")


def _block_links(rest: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links that connect what all pairs of different classes inside each bucket would. rest:
    band, key, id, its class c and the bucket's largest class, main. A bucket is dealt to blocks
    of about BLOCK rows, those of the largest class apart from the others, as they need not
    meet each other; each pair of blocks is verified by one task with matrix products, which
    returns each row's smallest relative there, never the pairs."""
    bucket, outside = ["band", "key"], F.col("c") != F.col("main")
    blocks = lambda rows: F.ceil(F.count_if(rows) / BLOCK).cast("int")
    sizes = rest.groupBy(bucket).agg(blocks(outside).alias("mixed"), blocks(~outside).alias("pure"))
    deal = lambda n: F.pmod(F.xxhash64(F.lit("block"), "id"), n).cast("int")
    mine = F.when(outside, deal(F.col("mixed"))).otherwise(F.col("mixed") + deal(F.col("pure")))
    last = F.col("mixed") - 1 + F.when(outside, F.col("pure")).otherwise(0)
    rows = rest.join(sizes, bucket).select(*bucket, "id", mine.alias("mine"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    rows = rows.join(sets, "id").select(*bucket, F.least("mine", "other").alias("b0"), F.greatest("mine", "other").alias("b1"), "mine", "id", "k", "w")

    def verify(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, mine = group["id"].to_numpy(), group["mine"].to_numpy()
        k = [np.frombuffer(b, "<u8") for b in group["k"].to_pylist()]
        w = [np.frombuffer(b, "<f4") for b in group["w"].to_pylist()]
        b0, b1 = group["b0"][0].as_py(), group["b1"][0].as_py()
        close = similar_pairs(k, w, threshold)
        # a pair of one block is verified where the block meets itself
        close &= (mine[:, None] != mine[None, :]) if b0 != b1 else ~np.eye(len(ids), dtype=bool)
        root = np.arange(len(ids))
        while True:
            after = np.minimum(root, np.where(close, root[None, :], len(ids)).min(1))
            after = after[after]
            if (after == root).all():
                break
            root = after
        some = root != np.arange(len(ids))
        return pa.table({"u": ids[some], "v": ids[root][some]})

    return rows.groupBy(*bucket, "b0", "b1").applyInArrow(verify, "u bigint, v bigint")


def similar_pairs(k: list[np.ndarray], w: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of all pairs of weighted sets reach the threshold. The sum of minima is an inner
    product once each shingle is cut at the weights that occur; pairs too close to call in
    single precision are computed one by one."""
    n = len(k)
    rows, keys, weights = np.repeat(np.arange(n), [len(x) for x in k]), np.concatenate(k), np.concatenate(w)
    order = np.lexsort((weights, keys))
    rows, keys, weights = rows[order], keys[order], weights[order]
    new_key = np.concatenate([[True], keys[1:] != keys[:-1]])
    new_level = new_key | np.concatenate([[True], weights[1:] != weights[:-1]])
    level = np.cumsum(new_level) - 1
    first = np.flatnonzero(new_level)
    gain = np.where(new_key[first], weights[first], weights[first] - weights[np.maximum(first - 1, 0)])
    bottom = np.maximum.accumulate(np.where(new_key[first], np.arange(len(first)), 0))[level]  # lowest level of the key
    times = level - bottom + 1
    at = np.repeat(bottom, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    who = np.repeat(rows, times)
    several = np.bincount(at, minlength=len(first)) > 1
    number = np.cumsum(several) - 1
    keep = several[at]
    at, who = number[at[keep]], who[keep]
    scale = np.sqrt(gain[several]).astype(np.float32)
    both = np.zeros((n, n), np.float64)
    by_feature = np.argsort(at, kind="stable")
    at, who = at[by_feature], who[by_feature]
    for lo in range(0, len(scale), 4096):
        a, b = np.searchsorted(at, (lo, lo + 4096))
        m = np.zeros((n, min(4096, len(scale) - lo)), np.float32)
        m[who[a:b], at[a:b] - lo] = scale[at[a:b]]
        both += m @ m.T
    total = np.array([x.sum(dtype=np.float64) for x in w])
    similarity = both / (total[:, None] + total[None, :] - both)
    close = similarity >= threshold
    for i, j in np.argwhere(np.triu(np.abs(similarity - threshold) < 1e-4, 1)):
        close[i, j] = close[j, i] = weighted_jaccard(k[i], w[i], k[j], w[j]) >= threshold
    return close
