"""Operator 2, nearest neighbours by score-aware (anisotropic) product quantisation.

Vectors are coded with four bits for each pair of dimensions. The codebooks minimise a loss
that weighs the part of the residual parallel to the vector more than the part across it,
since that part changes large inner products most. A scan of per-query tables over the codes
gives candidates, which are reranked by the exact measure.

Euclidean distance is turned into maximum inner product: the nearest x has the largest
q.x - |x|^2 / 2, of which only q.x is taken from the codes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectionspark.llm.scratch import stored
from sectionspark.llm.vectors import matrix, one_per_id, unit, usable

#: Rows that the codebooks are fitted on, at most; every row is coded and scanned.
MAX_FIT = 8192
#: Weight of the parallel residual; across it weighs 1.
PARALLEL = 4.0
CENTRES, WIDTH, TURNS = 16, 2, 6
#: Rows and queries that meet in one task, and candidates of a query reranked there, at least:
#: different vectors, and all whose approximate score equals that of the last.
ROWS, QUERIES, RERANK = 8192, 1024, 512


@dataclass
class Codebook:
    centres: np.ndarray  # (subspaces, CENTRES, WIDTH)

    def padded(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.centres) * WIDTH))
        width = min(x.shape[1], out.shape[1])
        out[:, :width] = x[:, :width]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.centres[np.arange(len(self.centres)), codes].reshape(len(codes), -1)

    def encode(self, x: np.ndarray, turns: int = 2) -> np.ndarray:
        """Coordinate descent on the anisotropic loss, from the plain nearest centres."""
        x = self.padded(x)
        parts = x.reshape(len(x), -1, WIDTH)
        direction = unit(x).reshape(parts.shape)
        codes = np.stack([((parts[:, j, None] - c) ** 2).sum(2).argmin(1) for j, c in enumerate(self.centres)], 1)
        along = ((x - self.decode(codes)) * direction.reshape(x.shape)).sum(1)
        rows = np.arange(len(x))
        for _ in range(turns):
            for j, c in enumerate(self.centres):
                residual = parts[:, j, None] - c  # (rows, CENTRES, WIDTH)
                mine = (residual * direction[:, j, None]).sum(2)
                rest = along - mine[rows, codes[:, j]]
                loss = (residual**2).sum(2) + (PARALLEL - 1) * (rest[:, None] + mine) ** 2
                codes[:, j] = loss.argmin(1)
                along = rest + mine[rows, codes[:, j]]
        return codes

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Two four-bit codes in a byte."""
        codes = self.encode(x).astype(np.uint8)
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries, rows) by tables of 256 sums of two codes."""
        q = self.padded(queries).reshape(len(queries), -1, WIDTH)
        tables = np.einsum("qjw,jcw->jqc", q, self.centres).astype(np.float32)
        if len(tables) % 2:
            tables = np.concatenate([tables, np.zeros_like(tables[:1])])
        out = np.zeros((len(queries), len(packed)), np.float32)
        for b in range(packed.shape[1]):
            both = (tables[2 * b][:, :, None] + tables[2 * b + 1][:, None, :]).reshape(len(queries), -1)
            out += both[:, packed[:, b]]
        return out


def fold(ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different rows of x by place of one of each, and the places of the ``most`` smallest
    ids of each as a flat array with its cuts."""
    rows = np.ascontiguousarray(x + 0.0)  # no negative zeros
    _, group = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    kept = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order)))) < most
    return order[starts], order[kept], np.concatenate([[0], np.cumsum(np.minimum(np.diff(np.append(starts, len(order))), most))])


def fit(x: np.ndarray, seed: int = 5) -> Codebook:
    """Alternates codes and centres; for fixed codes the best centres of all subspaces solve
    one linear system, as the parallel residual couples them."""
    rng = np.random.default_rng(seed)
    subspaces = -(-x.shape[1] // WIDTH)
    book = Codebook(np.zeros((subspaces, CENTRES, WIDTH)))
    x = book.padded(x)
    parts = x.reshape(len(x), subspaces, WIDTH)
    for j in range(subspaces):
        c = parts[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), j].copy()
        for _ in range(8):
            near = ((parts[:, j, None] - c) ** 2).sum(2).argmin(1)
            for k in range(CENTRES):
                if (near == k).any():
                    c[k] = parts[near == k, j].mean(0)
        book.centres[j] = c
    u = unit(x)
    for _ in range(TURNS):
        codes = book.encode(x, 1)
        columns = ((np.arange(subspaces) * CENTRES + codes)[:, :, None] * WIDTH + np.arange(WIDTH)).reshape(len(x), -1)
        n = subspaces * CENTRES * WIDTH
        z = np.zeros((len(x), n), np.float32)
        np.put_along_axis(z, columns, u.astype(np.float32), axis=1)
        left = (PARALLEL - 1) * (z.T @ z).astype(np.float64) + np.diag(np.bincount(columns.ravel(), minlength=n) + 1e-3)
        right = PARALLEL * np.bincount(columns.ravel(), x.ravel(), n) + 1e-3 * book.centres.ravel()
        book.centres = np.linalg.solve(left, right).reshape(book.centres.shape)
    return book


def nearest(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id, score: the k nearest rows found for each query, by
    Euclidean distance in double precision, ties to the smaller id.

    Rows whose vector is null, zero or holds null or non-finite components take no part, nor do
    rows without an id; repeated ids count as one vector (the smallest); a query never finds its
    own id; of unequal lengths, the shorter vector counts as filled with zeros. Other columns of
    ``table`` are not looked at; an empty table gives an empty result. The codebooks are
    fitted on at most MAX_FIT rows, chosen by a hash of the id; every row is coded. All rows
    meet all queries in blocks of about ROWS x QUERIES; a block folds equal vectors, scans the
    codes and reranks RERANK different vectors for each query, and those that the scan cannot
    tell from the last of them, so memory is bounded at any size and copies crowd nothing out.
    """
    spark = table.sparkSession
    good = table.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    good = one_per_id(good.select(F.col(id_col).cast("bigint").alias(id_col), F.col(vector_col).cast("array<double>").alias(vector_col), is_query.alias("_q")), id_col, [vector_col, "_q"])
    rows = stored(good.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"), F.col("_q").alias("q")), "ann-rows")
    total, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    sample = rows.select("id", "x").orderBy(F.xxhash64(F.lit("fit"), "id"), "id").limit(MAX_FIT).toArrow()
    out = "query_id bigint, id bigint, score double"
    if not len(sample):
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    book = spark.sparkContext.broadcast(fit(matrix(sample["x"])))  # CENTRES x dimensions

    def encode(batches):
        for batch in batches:
            codes = book.value.packed(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "x", "codes"])

    shards, blocks = -(-total // ROWS), max(1, -(-asked // QUERIES))
    index = rows.select("id", "x").mapInArrow(encode, "id bigint, x array<double>, codes binary")
    spread = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("s", spread("shard", shards)).withColumn("b", every(blocks))
    right = rows.where("q").select("id", "x").withColumn("b", spread("query", blocks)).withColumn("s", every(shards))

    def search(data: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not data.num_rows or not queries.num_rows:
            return empty
        ids, x = data["id"].to_numpy(), matrix(data["x"])
        codes = np.frombuffer(b"".join(data["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
        ones, copies, cuts = fold(ids, x, k + 1)  # a query is no neighbour of its own
        x, codes = x[ones], codes[ones]
        half = (x**2).sum(1).astype(np.float32) / 2
        q_ids, q = queries["id"].to_numpy(), matrix(queries["x"])
        x, q = (np.pad(m, ((0, 0), (0, max(x.shape[1], q.shape[1]) - m.shape[1]))) for m in (x, q))
        got = []
        for lo in range(0, len(q), 64):
            approx = book.value.scan(q[lo : lo + 64], codes) - half
            for i in range(len(approx)):
                own = approx[i]
                near = np.flatnonzero(own >= np.partition(own, -RERANK)[-RERANK]) if len(own) > RERANK else np.arange(len(own))
                d = np.sqrt(((x[near] - q[lo + i]) ** 2).sum(1))
                # each different vector stands for its copies by their smallest ids
                first = np.lexsort((ids[ones[near]], d))[: k + 1]
                rows_ = np.concatenate([copies[cuts[v] : cuts[v + 1]] for v in near[first]])
                d = np.repeat(d[first], (cuts[1:] - cuts[:-1])[near[first]])
                other = ids[rows_] != q_ids[lo + i]
                rows_, d = rows_[other], d[other]
                best = np.lexsort((ids[rows_], d))[:k]
                got.append((np.full(len(best), q_ids[lo + i]), ids[rows_[best]], d[best]))
        columns = [np.concatenate(c) for c in zip(*got)]
        return pa.table(dict(zip(("query_id", "id", "score"), columns)))

    local = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(search, out)
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
