"""Operator 10, packing along a space-filling curve.

Documents are tokenised once; hashed document vectors are projected to a few dimensions, the
rows are range-sorted by their Hilbert key and packed one after another along the curve, so
that a sequence holds neighbouring documents.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from math import erf
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionspark.llm.histogram_sort import LOWEST, MAX_CELLS, cell_of, find_splitters
from sectionspark.llm.known_words import KnownWords, PieceEncoder, cuts, list_sums
from sectionspark.llm.scratch import bound_batches, stored
from sectionspark.llm.textbatch import forget, tidy

#: Hash buckets of a document vector, dimensions after projection, bits for each of them.
BUCKETS, DIMENSIONS, BITS = 1024, 4, 15
#: Pieces that a worker remembers at most, about.
MAX_WORDS = 400_000
#: Tokens that one sorted cell holds, about.
CELL_TOKENS = 1 << 20


# The split pattern of the tokenizer file; the class of letters is that of the
# texts that SAFE admits.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017e]+|[0-9]|[^\sa-z\u00df-\u00f6\u00f8-\u017e0-9]+")
#: Texts with other characters are cut at white space only. What is admitted has one form
#: under NFC, one lower case and the class (letter, digit, other) that PIECES gives it.
UNSAFE = re.compile(r"[^\t\n\v\f\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]|<\|")
#: A text that a tokenizer of another split or case gives other ids.
PROBE = "It's  WE'LL x9 12,345 (a-b)\n\nÉtude naïve: ßtraße!? they'd--go"
_loaded: dict[str, _Vocabulary] = {}


class _Vocabulary:
    """What one worker knows of a tokenizer: ids and hash buckets of the pieces met so far."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(file)
        self.encode = PieceEncoder(library, UNSAFE)
        if library.encode(PROBE, add_special_tokens=False).ids != self.encode(PIECES.findall(PROBE.lower()))[0][0].tolist():
            raise ValueError(f"{file} doesn't cut texts as PIECES does")
        self.axes = np.random.default_rng(3).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)
        self.pieces = KnownWords(self._learn, 2)

    def _learn(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        buckets = np.fromiter((crc32(p.encode()) % BUCKETS for p in pieces), np.int64, len(pieces))
        return [*self.encode(pieces), (buckets, np.ones(len(pieces), np.int64))]

    def cut(self, text: str) -> list[str]:
        if not UNSAFE.search(text):
            return PIECES.findall(text.lower())
        words = (w.decode() for w in text.encode().split())
        return [p for w in words for p in ([w] if UNSAFE.search(w) else PIECES.findall(w.lower()))]


class WordTokenizer:
    """Ids of whole texts by a ``tokenizers`` file that folds case and whose pieces are those
    of PIECES and never cross white space.

    Such a text's ids are those of its pieces, end to end. They are looked up among those that
    the worker remembers; new ones go to the library.
    """

    def __init__(self, file: str):
        self.file = file

    def __call__(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each text followed by end_id; ids in each text;
        projected document vectors (zeros for a text without words)."""
        if self.file not in _loaded:
            _loaded[self.file] = _Vocabulary(self.file)
        v = _loaded[self.file]
        at, n = v.pieces.numbers([v.cut(t) for t in texts], MAX_WORDS)
        ids, sizes = v.pieces.lists[0].take(at)
        n_ids = list_sums(sizes, n)
        out = np.insert(ids, np.cumsum(n_ids), end_id)
        row = np.repeat(np.arange(len(texts)) * BUCKETS, n)
        bag = np.bincount(row + v.pieces.lists[1].flat[at], minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
        bag = np.log1p(bag).astype(np.float32)
        return out, n_ids + 1, (bag / np.maximum(np.linalg.norm(bag, axis=1, keepdims=True), 1e-9)) @ v.axes


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys along the Hilbert curve of points with coordinates 0 .. 2**bits - 1 (Skilling,
    "Programming the Hilbert curve", 2004), for all rows at once."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """A projected unit vector has about normal coordinates; the normal distribution spreads
    them over the grid in the same way at every size of the corpus."""
    grid = np.linspace(-5, 5, 4001)
    share = np.interp(vectors, grid, [(1 + erf(g / 2**0.5)) / 2 for g in grid])
    return hilbert_keys(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def pack(docs: DataFrame, tokenizer: WordTokenizer, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents: id, start, length, doc_tokens, sequence_id, offset and the piece's
    ids as little-endian unsigned 32-bit numbers.

    Every document is its ids and end_id (a null text is empty). Along the order (Hilbert
    key, id) all ids are laid end to end and cut every ``length``, so only the last sequence
    is padded. A very long text is tokenised whole by one task and cut like others. Rows equal
    in key and id (null ids come first) follow each other in any order; repeated rows are
    packed as often as they come. Cells of the order are found by exact histograms of the
    token counts and each is sorted and packed by one task that knows where it starts; so a
    large group of copies is dealt to many tasks. An empty table gives no pieces; other columns
    of ``docs`` are not looked at.
    """
    bound_batches(docs.sparkSession)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in cuts(texts):
                ids, n, vectors = tokenizer(texts[lo:hi], end_id)
                raw = ids.astype("<u2").tobytes() if len(ids) and ids.max() < 1 << 16 else ids.astype("<u4").tobytes()
                wide = len(raw) // max(1, len(ids))
                offsets = np.concatenate([[0], np.cumsum(n)]) * wide
                packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(curve_keys(vectors)), pa.array(n), packed.cast(pa.binary())], names=["id", "k1", "size", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(tokenise), "id bigint, k1 bigint, size bigint, ids binary")
    rows = stored(rows, "token-ids").withColumn("k2", F.coalesce("id", F.lit(LOWEST + 1)))
    total = rows.agg(F.sum("size")).first()[0] or 0
    cells = max(1, min(MAX_CELLS, -(-total // CELL_TOKENS)))
    cut = find_splitters(rows.select("k1", "k2", "size"), [total * i / cells for i in range(1, cells)], [0.1 * total / cells] * (cells - 1))
    first = [0, *cut.starts]  # MAX_CELLS numbers
    dealt = rows.withColumn("cell", cell_of(F.col("k1"), F.col("k2"), cut.bounds)).repartition("cell").sortWithinPartitions("cell", "k1", "k2")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(_loaded)  # what this worker learned of the tokenizer, which no later step needs
        cell, at = None, 0
        for batch in batches:
            got: list[tuple] = []
            columns = [batch.column(c) for c in ("id", "size", "cell", "ids")]
            for doc, n, own, raw in zip(*(c.to_pylist() for c in columns)):
                if own != cell:
                    cell, at = own, first[own]
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                start = 0
                while start < n:
                    size = min(n - start, length - (at + start) % length)
                    got.append((doc, start, size, n, (at + start) // length, (at + start) % length, ids[4 * start : 4 * (start + size)]))
                    start += size
                at += n
                if len(got) >= 2000:
                    yield _pieces(got)
                    got = []
            if got:
                yield _pieces(got)

    return dealt.select("id", "size", "cell", "ids").mapInArrow(tidy(lay), "id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary").withColumnRenamed("id", id_col)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 6 + [pa.binary()]
    names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
