"""Encoding of texts and exact cosine top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectionspark.sources.workspace import stored

#: Index rows that a task holds, rows of a cell at least (about), bytes of the probes at most.
ROWS, LEAST_CELL, PROBE_BYTES = 16_384, 256, 64 << 20
NO_HIT = "No relevant legal sections found for your query. Try rephrasing or removing the source filter."


def hashed_encoder(dimensions: int = 384) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder for where no model is at hand: hashed character trigrams, all
    texts of a batch at once."""

    def encode(texts: list[str]) -> np.ndarray:
        padded = [f"  {(text or '').lower()} " for text in texts]
        c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        rows = np.repeat(np.arange(len(padded)), [len(p) for p in padded])
        inside = rows[2:] == rows[:-2]  # no trigram crosses texts
        with np.errstate(over="ignore"):
            h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + c[2:]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        at = rows[2:][inside] * dimensions + ((h[inside] >> np.uint64(8)) % np.uint64(dimensions)).astype(np.int64)
        sign = 1 - 2 * (h[inside] >> np.uint64(63)).astype(np.float64)
        out = np.bincount(at, sign, len(padded) * dimensions).reshape(len(padded), dimensions).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return encode


def embed_batches(rows: DataFrame, text_col: str = "document", factory: Callable = hashed_encoder, batch: int = 64) -> DataFrame:
    """V1: adds embedding. ``factory`` makes the encoder, once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = factory()
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            vectors = [v for lo in range(0, len(texts), batch) for v in encode(texts[lo : lo + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    return rows.mapInArrow(run, rows.withColumn("embedding", F.array(F.lit(0.0).cast("float"))).schema)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows in double precision, shorter ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1, keepdims=True))


#: Distances that the matrix product gives are this exact, and lengths of chords.
NEAR, CHORD = 1e-9, 1e-6


class _Cells:
    """The coarse partition that all tasks know: unit vectors of a sample of the index (probes,
    with their sources), the first of which are centres, and what each centre's cell holds:
    rows, the longest chord from the centre to one of them, a mask of their sources."""

    def __init__(self, probes: np.ndarray, sources: list[str | None], n_centres: int):
        self.probes, self.sources = probes / _norms(probes), np.array(sources, object)
        self.centres = self.probes[:n_centres]
        self.rows, self.radius, self.mask = np.zeros(n_centres, np.int64), np.zeros(n_centres), np.zeros(n_centres, np.int64)

    def chords(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        width = max(x.shape[1], to.shape[1])
        x, to = _widened(x / _norms(x), width), _widened(to, width)
        return np.sqrt(np.maximum(2 - 2 * (x @ to.T), 0))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each row, and the chord to it."""
        d = self.chords(x, self.centres)
        at = d.argmin(1)
        return at, d[np.arange(len(d)), at]

    def visits(self, x: np.ndarray, wanted: list[str | None], bits: np.ndarray, k: int) -> np.ndarray:
        """Which cells may hold one of the k nearest of each question: by the triangle rule, no
        row of a cell is nearer than the chord to its centre less its radius, and k probes show
        how far the k nearest are at most."""
        d = self.chords(x, self.probes)
        fits = np.array([[w is None] for w in wanted]) | (np.array(wanted, object)[:, None] == self.sources[None, :])
        far = np.full(len(x), np.inf)
        if d.shape[1] >= k:
            far = np.partition(np.where(fits, d, np.inf), k - 1, axis=1)[:, k - 1]
        near = d[:, : len(self.centres)] - self.radius <= far[:, None] + CHORD
        return near & (self.rows > 0) & ((bits[:, None] == 0) | (bits[:, None] & self.mask != 0))


def _nearest(k: int) -> Callable:
    """A function over sorted batches (cell, slice; asks: index rows first; id, g, v) that gives
    the k nearest rows of each question in each slice of a cell. It holds the rows of one
    slice; questions stream past them."""

    def answers(held: list, ids: np.ndarray, wanted: list, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        row_ids, g, x, norm = held
        width = max(x.shape[1], v.shape[1])
        x, v = _widened(x, width), _widened(v, width)
        of = _norms(v)
        for lo in range(0, len(ids), 256):
            near = (v[lo : lo + 256] / of[lo : lo + 256]) @ (x / norm).T
            for i, w in enumerate(wanted[lo : lo + 256]):
                if w is not None:
                    near[i, g != w] = -np.inf
            least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -2.0)
            out = []
            for i, n in enumerate(near):
                at = np.flatnonzero(n >= max(least[i] - NEAR, -2))
                # of the two vectors alone, so equal vectors tie wherever they stand
                d = 1 - (x[at] * v[lo + i]).sum(1) / (norm[at, 0] * of[lo + i, 0])
                best = np.lexsort((row_ids[at], d))[:k]
                out.append((np.full(len(best), ids[lo + i]), row_ids[at][best], d[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "chunk_id", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, held = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("cell", "slice")])
            asks, ids, g = batch.column("asks").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(), batch.column("g").to_pylist()
            x = matrix(batch.column("v"))
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                if lo == hi:
                    continue
                if tuple(keys[lo]) != cell:
                    cell, parts, held = tuple(keys[lo]), [], None
                if not asks[lo]:
                    parts.append((ids[lo:hi], np.array(g[lo:hi], object), x[lo:hi]))
                    continue
                if parts:
                    width = max(p[2].shape[1] for p in parts)
                    rows = np.concatenate([_widened(p[2], width) for p in parts])
                    held, parts = [np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), rows, _norms(rows)], []
                if held:
                    yield from answers(held, ids[lo:hi], g[lo:hi], x[lo:hi])

    return run


HITS = "query_id bigint, chunk_id bigint, distance double"


def cosine_topk(questions: DataFrame, index: DataFrame, k: int = 20) -> DataFrame:
    """V2, V3: query_id, chunk_id, distance (1 - cosine, in double precision), rank; ties to
    the smaller chunk_id, for any number of partitions. questions: query_id, embedding,
    optionally source_filter (null: all); index: chunk_id, embedding, optionally source.
    Vectors that are null, zero or hold null or non-finite components take no part, shorter
    vectors count as filled with zeros; questions of one id are answered together.

    Both tables are evaluated once and written. Index rows go to the nearest of about a root of
    their number of centres, and are shuffled once: a cell goes, in slices of ROWS, to tasks
    that hold a slice each, and questions go to the cells that may hold one of their k
    nearest, so the result is exact (``_Cells``). What all tasks know is the sample of probes, of
    PROBE_BYTES at most.
    """
    spark = index.sparkSession

    def table(df: DataFrame, id_col: str, group: str) -> DataFrame:
        given = F.col(group).cast("string") if group in df.columns else F.lit(None).cast("string")
        wide = F.col("v").cast("array<double>")
        sound = F.exists(wide, lambda x: x != 0) & ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        bit = F.when(F.col("g").isNull(), 0).otherwise(F.expr("shiftleft(1L, cast(pmod(xxhash64(g), 63) as int))"))
        return df.select(F.col(id_col).cast("bigint").alias("id"), F.col("embedding").alias("v"), given.alias("g")).where(sound).withColumn("bit", bit.cast("bigint"))

    asked, rows = stored(table(questions, "query_id", "source_filter"), "asked"), stored(table(index, "chunk_id", "source"), "vectors")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or asked.isEmpty():
        return spark.createDataFrame([], f"{HITS}, rank int")
    most = max(1, PROBE_BYTES // (8 * width))
    n_centres = min(most, -(-n // LEAST_CELL), isqrt(n) + 1)
    probes = rows.orderBy(F.xxhash64("id"), "id").limit(min(most, max(n_centres, 50 * k))).select("v", "g").toArrow()
    known = spark.sparkContext.broadcast(_Cells(matrix(probes.column("v")), probes.column("g").to_pylist(), n_centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, chord = known.value.assign(matrix(b.column("v"))) if b.num_rows else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64()), pa.array(chord, pa.float64())], names=[*b.schema.names, "cell", "chord"])

    vector = rows.schema["v"].dataType.simpleString()
    rows = stored(rows.mapInArrow(assign, f"id bigint, v {vector}, g string, bit bigint, cell bigint, chord double"), "cells")
    figures = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("chord").alias("r"), F.bit_or("bit").alias("m")).collect()  # a row for each centre
    cells = known.value
    for f in figures:
        cells.rows[f["cell"]], cells.radius[f["cell"]], cells.mask[f["cell"]] = f["n"], f["r"], f["m"]
    known = spark.sparkContext.broadcast(cells)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                at, cell = np.nonzero(known.value.visits(matrix(part.column("v")), part.column("g").to_pylist(), part.column("bit").to_numpy(), k))
                slices = -(-known.value.rows[cell] // ROWS)
                at, cell = np.repeat(at, slices), np.repeat(cell, slices)
                place = np.arange(len(at)) - np.repeat(np.cumsum(slices) - slices, slices)
                for to in range(0, len(at), 4096):
                    some = slice(to, to + 4096)
                    taken = [part.column(c).take(pa.array(at[some])) for c in ("id", "v", "g")]
                    yield pa.RecordBatch.from_arrays([*taken, pa.array(cell[some], pa.int64()), pa.array(place[some], pa.int64())], names=["id", "v", "g", "cell", "slice"])

    asked_vector = asked.schema["v"].dataType.simpleString()
    asked = asked.mapInArrow(visit, f"id bigint, v {asked_vector}, g string, cell bigint, slice bigint")
    large = {f["cell"]: -(-f["n"] // ROWS) for f in figures if f["n"] > ROWS}  # n / ROWS of them at most
    cut = F.create_map(*(F.lit(x).cast("bigint") for pair in large.items() for x in pair))[F.col("cell")] if large else F.lit(1)
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("id"), F.coalesce(cut, F.lit(1)).cast("bigint")))
    doubles = F.col("v").cast("array<double>").alias("v") if vector != asked_vector else F.col("v")
    both = rows.select("cell", "slice", F.lit(False).alias("asks"), "id", "g", doubles).unionByName(asked.select("cell", "slice", F.lit(True).alias("asks"), "id", "g", doubles))
    local = both.repartition("cell", "slice").sortWithinPartitions("cell", "slice", "asks").mapInArrow(_nearest(k), HITS)
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similarity_percent(distance: Column) -> Column:
    """V4."""
    return F.bround((1 - distance) * 100, 1)


def no_hit_answers(questions: DataFrame, hits: DataFrame, model: str = "none") -> DataFrame:
    """V5: the fixed answer for questions without vector hits, with empty arrays. questions:
    query_id, query_used."""
    none = questions.join(hits, "query_id", "left_anti")
    used = F.array().cast("array<struct<chunk_id:bigint,document:string,distance:double,rerank_score:double>>")
    return none.select("query_id", F.lit(NO_HIT).alias("answer"), F.array().cast("array<string>").alias("citations"), used.alias("chunks_used"), F.lit(model).alias("model_used"), "query_used")
