"""Operator 9, language identification by prediction by partial matching (PPM).

For each language a variable-order tree of byte contexts with escape probabilities gives the
exact code length of a text under statistics that are frozen after training. The language
with the shortest code is predicted. The trees of all languages are kept as sorted windows,
so a batch of texts is coded by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectionspark.llm.scratch import bound_batches
from sectionspark.llm.textbatch import chunks, segment_sums, tidy

#: Longest context in bytes.
ORDER = 3
#: Training documents for each language, about, chosen by a hash of the id. They bound the
#: trees, which hold every context of these documents.
MAX_DOCUMENTS = 2000
#: Bytes that a task codes at once; a longer text is cut, with its contexts carried over.
AT_ONCE = 1 << 18
UNKNOWN = "und"


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class PpmModel:
    """For each order k: the windows of k + 1 bytes seen (base 257, 0 before the text) with
    their code lengths under each language, and the contexts with their escapes' lengths."""

    languages: list[str]
    windows: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]


def _windows(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The window of ORDER + 1 codes that ends at each position; none reaches over the start of
    a text."""
    out = codes.copy()
    begin = starts[:-1]
    for k in range(1, ORDER + 1):
        before = np.zeros(len(codes), np.int64)
        before[k:] = codes[:-k] if len(codes) > k else 0
        for j in range(k):
            at = begin + j
            before[at[at < len(codes)]] = 0
        out += before * 257**k
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_documents: int = MAX_DOCUMENTS, usable: Column | None = None) -> PpmModel:
    """Learns from at most about ``max_documents`` rows of each label (null labels and texts
    take no part), out of those that ``usable`` admits (default: not held out). Rows equal in
    all columns count as often as they come; of an empty table nothing is learned."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    rows = rows.where((~held_out("id") if usable is None else usable) & F.col("label").isNotNull() & F.col("text").isNotNull())
    totals = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    languages = sorted(totals)
    if not languages:
        return PpmModel([], [], [], [], [])
    chance = F.lit(0)
    for name, n in totals.items():
        chance = F.when(F.col("label") == name, min(1_000_000, -(-1_000_000 * max_documents // n))).otherwise(chance)
    sample = rows.where(F.pmod(F.xxhash64(F.lit("ppm"), F.col("id")), F.lit(1_000_000)) < chance).select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), str)
            for c in chunks(batch.column(0)):
                grams = _windows(c.data.astype(np.int64) + 1, c.starts)
                names, of = np.unique(labels[c.lo : c.hi], return_inverse=True)
                of = np.repeat(of, c.lengths)
                for i, name in enumerate(names):
                    keys, n = np.unique(grams[of == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["label", "gram", "n"])

    grams = sample.mapInArrow(tidy(count), "label string, gram bigint, n bigint").groupBy("label", "gram").agg(F.sum("n").alias("n")).toArrow()
    return fit(languages, np.array(grams["label"].to_pylist(), object), grams["gram"].to_numpy(), grams["n"].to_numpy())


def fit(languages: list[str], labels: np.ndarray, grams: np.ndarray, n: np.ndarray) -> PpmModel:
    """labels, grams, n: counts of windows. PPM with escape method C, without exclusions:
    a byte seen after a context of total count T with D distinct bytes costs count / (T + D),
    another one the escape D / (T + D) and its cost after the next shorter context; below the
    empty context all bytes cost 8 bits. Contexts that a language never met cost no escape."""
    lang = np.searchsorted(languages, labels.astype(str)) if len(labels) else np.zeros(0, np.int64)
    model = PpmModel(list(languages), [], [], [], [])
    lower = None
    for k in range(ORDER + 1):
        windows, index = np.unique(grams % 257 ** (k + 1), return_inverse=True)
        counts = np.zeros((len(windows), len(languages)))
        np.add.at(counts, (index, lang), n)
        contexts, of = np.unique(windows // 257, return_inverse=True)
        total, distinct = (np.zeros((len(contexts), len(languages))) for _ in range(2))
        np.add.at(total, of, counts)
        np.add.at(distinct, of, counts > 0)
        norm = np.maximum(total + distinct, 1)
        escape = np.where(total > 0, distinct / norm, 1.0)
        shorter = 1 / 256 if lower is None else lower[1][np.searchsorted(lower[0], windows % 257**k)]
        chance = np.where(counts > 0, counts / norm[of], escape[of] * shorter)
        lower = windows, chance
        model.windows.append(windows)
        model.bits.append(-np.log2(chance).astype(np.float32))
        model.contexts.append(contexts)
        model.escapes.append(-np.log2(escape).astype(np.float32))
    return model


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(0, len(sorted_keys) - 1))
    return at, sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool)


def _costs(model: PpmModel, windows: np.ndarray, k: int = ORDER) -> np.ndarray:
    """Bits of the last byte of each window under each language."""
    if k < 0:
        return np.full((len(windows), len(model.languages)), 8, np.float32)
    at, seen = _find(model.windows[k], windows)
    out = model.bits[k][at] if len(model.windows[k]) else np.zeros((len(windows), len(model.languages)), np.float32)
    new = np.flatnonzero(~seen)
    if len(new):
        out[new] = _costs(model, windows[new] % 257**k, k - 1)
        at, known = _find(model.contexts[k], windows[new] // 257)
        out[new[known]] += model.escapes[k][at[known]]
    return out


def code_lengths(model: PpmModel, texts: pa.Array) -> np.ndarray:
    """Bits of each text under each language."""
    out = np.zeros((len(texts), len(model.languages)))
    for c in chunks(texts, AT_ONCE):
        windows = None if len(c.data) > AT_ONCE else _windows(c.data.astype(np.int64) + 1, c.starts)
        if windows is not None:
            out[c.lo : c.hi] = segment_sums(_costs(model, windows), c.starts)
            continue
        for lo in range(0, len(c.data), AT_ONCE):  # one long text
            first = max(0, lo - ORDER)
            part = c.data[first : lo + AT_ONCE].astype(np.int64) + 1
            windows = _windows(part, np.array([0, len(part)]))[lo - first :]
            out[c.lo] += _costs(model, windows).sum(0, dtype=np.float64)
    return out


def identify(docs: DataFrame, model: PpmModel, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The ``keep`` columns (default: all) plus lang_pred, lang_score and lang_bits.

    Texts that are null or hold no letter get ``und`` and score 0, and so does every text if
    nothing was learned. The score is the posterior of the predicted language under equal
    priors; equal code lengths go to the first language by name. lang_bits is the code length
    under it in bits for each byte (null where there is none): 8 is what raw bytes take.
    Columns of ``docs`` named lang_pred, lang_score or lang_bits are replaced. Each row is
    scored by itself, so repeated rows and ties of ids are no case; a very long text is coded
    piece by piece, as a whole. An empty table gives an empty result.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_bits")
    bound_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep)]
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    source = docs.select(*kept, lettered.alias("_letters"), F.col(text_col).alias("_text"))
    # the trees of at most MAX_DOCUMENTS texts a language
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(0.0).cast("double").alias("lang_bits")).schema
    for name in ("lang_pred", "lang_score", "lang_bits"):
        schema[name].nullable = True

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts, n = batch.column(batch.num_columns - 1), batch.num_rows
            letters = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False).astype(bool) & bool(m.languages)
            best, score, bits = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            if m.languages:
                lengths = code_lengths(m, texts)
                best = lengths.argmin(1)
                score = 1 / np.exp2(np.maximum(lengths.min(1)[:, None] - lengths, -1000)).sum(1)
                bits = lengths.min(1) / np.maximum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 1)
            names = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
            columns = [batch.column(i) for i in range(batch.num_columns - 2)]
            found = [pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(bits, pa.float64(), mask=~letters)]
            yield pa.RecordBatch.from_arrays([*columns, *found], names=schema.names)

    return source.mapInArrow(tidy(predict), schema)
