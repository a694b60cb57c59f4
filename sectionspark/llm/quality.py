"""Operator 8, quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectionspark.llm.scratch import bound_batches
from sectionspark.llm.textbatch import IS_SPACE, CHUNK_BYTES, Chunk, chunks, runs, run_hashes, segment_sums, words

#: Labelled rows that the trees are fitted on, at most about, chosen by a hash of the id.
MAX_LABELLED = 30_000
BINS, TREES, DEPTH, RATE, L2, LEAST = 64, 80, 4, 0.15, 1.0, 10

FEATURES = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_length_spread", "longest_word", "words_per_line",
    "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "stops_per_word", "commas_per_word",
    "upper", "digit", "punctuation", "bangs", "marks", "symbols", "non_ascii", "space", "letterless_words",
)

_CLASS = np.zeros((256, 9), np.uint8)
for _k, _in in enumerate((range(65, 91), range(48, 58), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], b"!", b"?", b"#$%&*+/<=>@[\\]^_`{|}~", range(128, 256), b"\t\n\v\f\r ", [*range(65, 91), *range(97, 123), *range(128, 256)])):
    _CLASS[list(_in), _k] = 1


def _most(groups: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each group the number of distinct keys and the count of its most frequent one."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(groups):
        order = np.lexsort((keys, groups))
        g, k = groups[order], keys[order]
        first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])]))
        size = np.diff(np.append(first, len(g)))
        distinct += np.bincount(g[first], minlength=n)
        np.maximum.at(top, g[first], size)
    return distinct, top


def statistics(c: Chunk) -> np.ndarray:
    """One row of FEATURES for each text; all of it is read, and an empty text gives zeros."""
    n, size = c.hi - c.lo, c.lengths.astype(float)
    counts = segment_sums(_CLASS[c.data], c.starts).astype(float)
    hashes, rows, b, e = words(c)
    length = (e - b).astype(float)
    n_words = np.bincount(rows, minlength=n).astype(float)
    safe, per_byte = np.maximum(n_words, 1), np.maximum(size, 1)
    mean = np.bincount(rows, length, n) / safe
    spread = np.sqrt(np.maximum(np.bincount(rows, length**2, n) / safe - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, rows, length)
    distinct, top = _most(rows, hashes, n)
    same = rows[1:] == rows[:-1] if len(rows) else np.zeros(0, bool)
    with np.errstate(over="ignore"):
        pairs = (hashes[:-1] * np.uint64(3) + hashes[1:])[same] if len(rows) else hashes
    d_pairs, _ = _most(rows[1:][same] if len(rows) else rows, pairs, n)
    lb, le, lrows = runs(c.data != 10, c.starts)
    n_lines = np.bincount(lrows, minlength=n).astype(float)
    d_lines, _ = _most(lrows, run_hashes(c.data, lb, le), n)
    total = np.concatenate([[0], np.cumsum(_CLASS[c.data, 8])]) if len(c.data) else np.zeros(1)
    bare = np.bincount(rows, (total[e] == total[b]).astype(float), n) if len(rows) else np.zeros(n)
    stops, commas = (segment_sums((c.data == v).astype(np.uint8), c.starts) for v in (46, 44))
    columns = [
        np.log1p(size), np.log1p(n_words), np.log1p(n_lines), mean, spread, longest, n_words / np.maximum(n_lines, 1),
        distinct / safe, top / safe, d_pairs / np.maximum(n_words - 1, 1), d_lines / np.maximum(n_lines, 1), stops / safe, commas / safe,
        *(counts[:, k] / per_byte for k in range(8)), bare / safe,
    ]
    return np.stack(columns, 1)


def _table(texts: pa.Array) -> np.ndarray:
    out = np.zeros((len(texts), len(FEATURES)))
    for c in chunks(texts, CHUNK_BYTES):
        out[c.lo : c.hi] = statistics(c)
    return out


@dataclass
class Trees:
    """All trees end to end: children of node i are at left[i] and left[i] + 1; leaves point
    to themselves with an infinite threshold."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """All rows go down all trees together, a level at a time."""
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = self.left[at] + (x[rows, self.feature[at]] > self.threshold[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, second order, equal-frequency bins; rows are few (MAX_LABELLED)."""
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else 4.0 if y[0] else -4.0
        return Trees(base, np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, np.inf), np.zeros(1, np.int64), np.zeros(1))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(x.shape[1])], 1)
    flat = binned + np.arange(x.shape[1]) * BINS
    rate = y.mean()
    base = float(np.log(rate / (1 - rate)))
    margin = np.full(len(y), base)
    feature, threshold, left, value, roots = [], [], [], [], []

    def node() -> int:
        i = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(i), value.append(0.0)
        return i

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(node())
        level = [(roots[-1], np.arange(len(y)))]
        for depth in range(DEPTH + 1):
            following = []
            for i, rows in level:
                G, H = g[rows].sum(), h[rows].sum()
                best = (1e-6, None)
                if depth < DEPTH and len(rows) >= 2 * LEAST:
                    index = flat[rows].ravel()
                    size = x.shape[1] * BINS
                    hg, hh, hn = (np.bincount(index, np.repeat(w, x.shape[1]), size).reshape(-1, BINS).cumsum(1) for w in (g[rows], h[rows], np.ones(len(rows))))
                    gain = hg**2 / (hh + L2) + (G - hg) ** 2 / (H - hh + L2) - G**2 / (H + L2)
                    gain[(hn < LEAST) | (len(rows) - hn < LEAST)] = -1
                    f, b = divmod(int(gain.argmax()), BINS)
                    if gain[f, b] > best[0] and b < len(edges[f]):
                        best = (gain[f, b], (f, b))
                if best[1] is None:
                    value[i] = float(-RATE * G / (H + L2))
                    margin[rows] += value[i]
                    continue
                f, b = best[1]
                feature[i], threshold[i], left[i] = f, float(edges[f][b]), node()
                node()
                goes = binned[rows, f] > b
                following += [(left[i], rows[~goes]), (left[i] + 1, rows[goes])]
            level = following
    return Trees(base, *(np.array(v) for v in (roots, feature, threshold, left, value)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, usable: Column | None = None) -> Trees:
    """Fits on at most about ``max_labelled`` labelled rows out of those that ``usable``
    admits (default: not held out). Null labels and ids take no part; with labels of one kind
    only, or none (an empty table), the score is constant. Repeated rows and several labels of
    one id count as often as the join brings them; of ``docs`` and ``labels`` only the named
    columns are read."""
    bound_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull())
    known = known.where(~held_out("id") if usable is None else usable)
    total = known.count()
    if not total:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    known = known.where(F.pmod(F.xxhash64(F.lit("quality"), F.col("id")), F.lit(1_000_000)) < -(-1_000_000 * max_labelled // total))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("y", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _table(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.mapInArrow(measure, "y double, x array<double>").toArrow()
    y = got["y"].to_numpy()
    x = np.array(got["x"].to_pylist(), float).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))  # the same trees in whatever order the rows came
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, trees: Trees, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The ``keep`` columns (default: all) plus quality_score (0 to 1); a null text counts as
    empty. A column of that name is replaced. Rows are scored one by one, whatever their ids
    and however often they come; a very long text is measured whole by one task. An empty table
    gives an empty result."""
    docs = docs.drop("quality_score")
    bound_batches(docs.sparkSession)
    kept = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # TREES * 2 ** (DEPTH + 1) nodes
    schema = docs.select(*kept, F.lit(0.0).alias("quality_score")).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(_table(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(scores)], names=schema.names)

    return docs.select(*kept, F.col(text_col).alias("_text")).mapInArrow(predict, schema)
