"""Operator 12, token ids in binary files of directly addressable codes.

An id is cut into bytes, lowest first. Level 0 holds the first byte of every id; a bitmap marks
the ids that go on, and level 1 holds the next byte of those alone, and so on. A count of marks
before each 512 of them (the rank directory) leads from an id's place in one level to its place
in the next, so any id is read by a few bytes of each level and nothing is decoded.

Files are written and read by Spark alone, so they may lie in any store that it knows, and a
lost executor costs the tasks that it ran.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sectionspark.llm.known_words import KnownWords, PieceEncoder, cuts, list_sums
from sectionspark.llm.scratch import bound_batches
from sectionspark.llm.textbatch import forget, tidy

#: Bytes of text that a file takes, about; tokens of a segment, if its last document ends there.
FILE_BYTES, SEGMENT_TOKENS = 32 << 20, 1 << 18
#: Pieces that a worker remembers at most, about.
MAX_WORDS = 600_000
#: Marks that an entry of the rank directory counts.
RANK = 512
MAGIC = b"DACTOK01"

# The tokenizer's own split pattern, for texts whose letters and digits are those
# named here; what else is in a text goes to the library in words between spaces.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ſ0-9]+|\s+(?!\S)|\s+")
OTHER = re.compile(r"[^\t\n\v\f\r -~À-ſ]|<\|")
#: A text that a tokenizer of another split gives other ids.
PROBE = "It's  we'LL x9 12,345 (a-b)\n\n Étude  naïve: ßtraße!? they'd--go \n end  "
#: A space that another white space follows: such texts are cut with more care.
_WIDE = re.compile(r" \s")
_CUT = re.compile(r" (?=\S)")


def space_words(text: str) -> list[str]:
    """The parts of a text between spaces that stand before other characters. The pattern takes
    such a space with what follows and never over it, so ids of a text are those of its parts,
    each but the first with its space."""
    return _CUT.split(text) if _WIDE.search(text) else text.split(" ")


class _Vocabulary:
    """What one worker knows of a tokenizer."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(file)
        self.encode = PieceEncoder(library, OTHER)
        self.pieces = KnownWords(self.encode, 1)
        if library.encode(PROBE, add_special_tokens=False).ids != self.encode(PIECES.findall(PROBE))[0][0].tolist():
            raise ValueError(f"{file} doesn't cut texts as PIECES does")

    def cut(self, text: str) -> list[str]:
        if not OTHER.search(text):
            return PIECES.findall(text)
        first, *words = space_words(text)  # each but the first with its space
        words = [first, *(f" {w}" for w in words)]
        return [p for w in words for p in ([w] if OTHER.search(w) else PIECES.findall(w))]

    @property
    def words(self) -> set[str]:
        """The pieces remembered, without the space before them."""
        return {p.removeprefix(" ") for p in self.pieces}

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at, n = self.pieces.numbers([self.cut(t) for t in texts], MAX_WORDS)
        flat, sizes = self.pieces.lists[0].take(at)
        return flat, list_sums(sizes, n)


_loaded: dict[str, _Vocabulary] = {}


class ByteTokenizer:
    """Ids of whole texts by a byte-level BPE file of the ``tokenizers`` library, as it gives
    them without special tokens added.

    Texts are cut into pieces of the split pattern, which are looked up among those that the
    worker remembers; new ones go to the library. Texts with other characters than the pattern
    knows are cut at spaces first, and their words with such characters are pieces of their own.
    """

    def __init__(self, file: str):
        self.file = file

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        if self.file not in _loaded:
            _loaded[self.file] = _Vocabulary(self.file)
        return _loaded[self.file].ids(texts)


# ---- the format: segments one after another, each followed by a line feed ----
#
# MAGIC; unsigned 32-bit: file number, segment number, documents, tokens, levels, ids in each
# level; for each document its id (signed 64-bit), whether it has one (a byte) and its tokens
# (unsigned 32-bit); for each level its bytes and, but for the last level, the bitmap (lowest bit
# first) and the rank directory (unsigned 32-bit: marks before each 512 ids). Little-endian.


def encode_segment(file_no: int, segment_no: int, doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    levels, parts = [], []
    left = ids.astype(np.uint32)
    while True:
        levels.append(len(left))
        parts.append((left & 255).astype(np.uint8).tobytes())
        goes_on = left > 255
        if not goes_on.any():
            break
        parts.append(np.packbits(goes_on, bitorder="little").tobytes())
        counts = np.add.reduceat(goes_on, np.arange(0, len(left), RANK), dtype=np.int64)
        parts.append((np.cumsum(counts) - counts).astype("<u4").tobytes())
        left = left[goes_on] >> 8
    head = np.array([file_no, segment_no, len(doc_ids), len(ids), len(levels), *levels], "<u4").tobytes()
    docs = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(), np.asarray(sizes).astype("<u4").tobytes()]
    return b"".join([MAGIC, head, *docs, *parts])


@dataclass
class Segment:
    """A segment that begins at ``at`` in a buffer (bytes, or a memory-mapped file). Opening one
    reads its head alone."""

    buffer: object
    at: int = 0

    def __post_init__(self):
        at, size = self.at, len(MAGIC)
        if bytes(self.buffer[at : at + size]) != MAGIC:
            raise ValueError(f"no segment at {at}")
        self.file_no, self.segment_no, self.n_docs, self.n_tokens, n = (int(v) for v in self._numbers(at + size, 5, "<u4"))
        self.levels = [int(v) for v in self._numbers(at + size + 20, n, "<u4")]
        self.docs_at = at = at + size + 20 + 4 * n
        self.places = []  # of each level: its bytes, bitmap, rank directory
        at += 13 * self.n_docs
        for k, count in enumerate(self.levels):
            last = k == n - 1
            bits_at = at + count
            ranks_at = bits_at + (0 if last else -(-count // 8))
            self.places.append((at, bits_at, ranks_at))
            at = ranks_at + (0 if last else 4 * -(-count // RANK))
        self.end = at

    def _numbers(self, at: int, n: int, kind: str) -> np.ndarray:
        return np.frombuffer(bytes(self.buffer[at : at + n * np.dtype(kind).itemsize]), kind)

    def token(self, i: int) -> int:
        """The i-th id; reads a byte, a few words of the bitmap and a count in each level."""
        value, last = 0, len(self.levels) - 1
        for k, (bytes_at, bits_at, ranks_at) in enumerate(self.places):
            value |= int(self.buffer[bytes_at + i]) << (8 * k)
            if k == last:
                break
            block = i // RANK * (RANK // 8)
            bits = int.from_bytes(bytes(self.buffer[bits_at + block : bits_at + i // 8 + 1]), "little")
            inside = i % RANK
            if not bits >> inside & 1:
                break
            i = int(self._numbers(ranks_at + 4 * (i // RANK), 1, "<u4")[0]) + (bits & ((1 << inside) - 1)).bit_count()
        return value

    def tokens(self) -> np.ndarray:
        """All ids."""
        out = self._numbers(self.places[0][0], self.n_tokens, np.uint8).astype(np.uint32)
        at = np.arange(self.n_tokens)
        for k in range(1, len(self.levels)):
            marks = np.unpackbits(self._numbers(self.places[k - 1][1], -(-self.levels[k - 1] // 8), np.uint8), count=self.levels[k - 1], bitorder="little")
            at = at[marks.view(bool)]
            out[at] |= self._numbers(self.places[k][0], self.levels[k], np.uint8).astype(np.uint32) << np.uint32(8 * k)
        return out

    def documents(self) -> tuple[list, np.ndarray]:
        """Ids of the documents (None for those without) and their numbers of tokens."""
        n, at = self.n_docs, self.docs_at
        has_id = self._numbers(at + 8 * n, n, np.uint8)
        ids = [d if h else None for d, h in zip(self._numbers(at, n, "<i8").tolist(), has_id)]
        return ids, self._numbers(at + 9 * n, n, "<u4").astype(np.int64)


def segments(buffer: object) -> Iterator[Segment]:
    at = 0
    while at < len(buffer):
        yield (segment := Segment(buffer, at))
        at = segment.end + 1


def write_token_files(docs: DataFrame, tokenizer: Callable, path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all whole texts, in ascending order of the document's id, to
    ``path``/tokens, and a row for each file (file_no, file, start: tokens before it, n_tokens,
    n_docs) to ``path``/manifest, over what stood there. ``end_id`` follows each document.

    tokenizer: gives the ids of a list of texts end to end, and how many each has. A null text
    is empty. Rows without an id come first; rows of one id stand by a digest of their texts,
    equal rows in any order. An empty table gives empty files. One text is held whole by one
    task, with its ids.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("bigint") + 8)).first()[0] or 0
    order = ("id", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.select("id", "text", *order[1:]).repartitionByRange(-(-max(1, total) // FILE_BYTES), "id", "digest", "place").sortWithinPartitions("id", "digest", "place")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no, n, held, ids, sizes, got = TaskContext.get().partitionId(), 0, 0, [], [], []

        def segment() -> pa.RecordBatch:
            blob = encode_segment(file_no, n, ids, np.array(sizes), np.concatenate(got))
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["segment"])

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last in cuts(texts):
                flat, counts = tokenizer(texts[first:last])
                ends = np.cumsum(counts)
                for doc_id, lo, hi in zip(doc_ids[first:last], ends - counts, ends):
                    got.append(flat[lo:hi])
                    if end_id is not None:
                        got.append(np.array([end_id], np.uint32))
                    ids.append(doc_id)
                    sizes.append(int(hi - lo) + (end_id is not None))
                    held += sizes[-1]
                    if held >= SEGMENT_TOKENS:
                        yield segment()
                        n, held, ids, sizes, got = n + 1, 0, [], [], []
        if ids:
            yield segment()

    blobs = dealt.select("id", "text").mapInArrow(tidy(encode), "segment binary")
    # the text writer puts the bytes of a string as they are
    blobs.select(F.col("segment").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(f"{path}/tokens")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(_loaded)  # what this worker learned of the tokenizer, which no later step needs
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                found = [(s.file_no, s.n_tokens, s.n_docs) for s in segments(memoryview(content.as_buffer()).cast("B"))]
                if found:
                    row = ([found[0][0]], [file.as_py()], [sum(f[1] for f in found)], [sum(f[2] for f in found)])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=["file_no", "file", "n_tokens", "n_docs"])

    files = _files(spark, path).mapInArrow(tidy(heads), "file_no bigint, file string, n_tokens bigint, n_docs bigint")
    before = F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    files.withColumn("start", F.coalesce(before, F.lit(0))).write.mode("overwrite").parquet(f"{path}/manifest")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/tokens").select("path", "content")


MANIFEST = "file_no bigint, file string, n_tokens bigint, n_docs bigint, start bigint"


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The documents of ``write_token_files``: id, start (tokens before it in all files),
    n_tokens, ids (unsigned 32-bit, little-endian, end to end)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(_loaded)
        for batch in batches:
            for content in batch.column("content"):
                start = 0
                for s in segments(memoryview(content.as_buffer()).cast("B")):
                    ids, sizes = s.documents()
                    data, ends = s.tokens().astype("<u4").tobytes(), np.cumsum(sizes)
                    cut = [data[4 * lo : 4 * hi] for lo, hi in zip(ends - sizes, ends)]
                    cols = [pa.array([s.file_no] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(cut, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["file_no", "id", "inside", "n_tokens", "ids"])
                    start += s.n_tokens

    rows = _files(spark, path).mapInArrow(tidy(decode), "file_no bigint, id bigint, inside bigint, n_tokens bigint, ids binary")
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("file_no", "start")
    return rows.join(files, "file_no").select(F.col("id").alias(id_col), (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids")


def tokens_at(positions: DataFrame, path: str, column: str = "position") -> DataFrame:
    """``column`` and token, for positions in all files' tokens; others are left out. Files that
    hold none of the positions are not read, and of the others each token's own bytes."""
    spark = positions.sparkSession
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    grid = max(1, files.agg(F.max("n_tokens")).first()[0] or 1)  # a file meets two cells at most
    cells = files.where("n_tokens > 0").select("file", F.col("start").alias("lo"), (F.col("start") + F.col("n_tokens")).alias("hi"))
    cells = cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / grid), F.floor((F.col("hi") - 1) / grid))))
    asked = positions.select(F.col(column).cast("bigint").alias("p")).where("p >= 0").distinct().withColumn("cell", F.floor(F.col("p") / grid))
    asked = asked.join(cells, "cell").where("p >= lo and p < hi").select("file", (F.col("p") - F.col("lo")).alias("inside"), "p")
    wanted = asked.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("inside", "p"))).alias("wanted"))  # no more than a file holds

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, asked in zip(batch.column("content"), batch.column("wanted").to_pylist()):
                found, parts, begin = [], segments(memoryview(content.as_buffer()).cast("B")), 0
                s = next(parts)
                for a in asked:
                    while a["inside"] >= begin + s.n_tokens:
                        begin, s = begin + s.n_tokens, next(parts)
                    found.append(s.token(a["inside"] - begin))
                yield pa.RecordBatch.from_arrays([pa.array([a["p"] for a in asked], pa.int64()), pa.array(found, pa.int64())], names=[column, "token"])

    read = _files(spark, path).join(wanted, F.col("path") == F.col("file")).select("content", "wanted")
    return read.mapInArrow(tidy(look), f"`{column}` bigint, token bigint")
