import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sectionspark.llm import queries as Q
from sectionspark.llm import token_files as T

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def whole(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_whole_texts(library, monkeypatch):
    r = random.Random(1)
    alphabet = list("ab éß'sx  \n\t.,;<|>9٣日本x  \x1c\x85İſ×") + ["'ll", "<|endoftext|>", " \n", "   ", "😀", "é"]
    texts = ["", " ", "  ", T.PROBE] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 40))) for _ in range(5000)]
    encode = T.ByteTokenizer(FILE)
    for limit in (T.MAX_WORDS, 50):  # a worker that forgets often
        monkeypatch.setattr(T, "MAX_WORDS", limit)
        for lo in range(0, len(texts), 500):
            part = texts[lo : lo + 500]
            flat, sizes = encode(part)
            assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [whole(library, t) for t in part]


class Counted(bytes):
    """Counts the bytes that are read."""

    read = 0

    def __getitem__(self, at):
        got = super().__getitem__(at)
        Counted.read += 1 if isinstance(at, int) else len(got)
        return got


@pytest.mark.parametrize("top", [1, 2, 256, 257, 50_257, 2**24, 2**32])
def test_any_id_without_decoding(top):
    ids = np.random.default_rng(top % 97).integers(0, top, 5000, dtype=np.uint64).astype(np.uint32)
    blob = T.encode_segment(3, 4, [1, None], np.array([1000, 4000]), ids)
    two = Counted(blob + b"\n" + blob + b"\n")
    s = list(T.segments(two))[1]
    assert (s.file_no, s.segment_no, s.n_tokens) == (3, 4, 5000)
    assert s.tokens().tolist() == ids.tolist()
    assert s.documents()[0] == [1, None] and s.documents()[1].tolist() == [1000, 4000]
    for i in [0, 1, 511, 512, 513, 4999, *range(0, 5000, 77)]:
        Counted.read = 0
        assert s.token(i) == ids[i]
        assert Counted.read <= 4 * (1 + 64 + 4)


def test_empty_segment():
    s = T.Segment(T.encode_segment(0, 0, [5], np.array([0]), np.zeros(0, np.uint32)))
    assert s.tokens().tolist() == [] and s.documents()[0] == [5]


def table(make_docs, rows):
    return make_docs(rows).withColumns({"start": F.lit("s"), "ids": F.lit(1), "place": F.lit(0), "digest": F.lit(0)})


def test_round_trip(spark, make_docs, odd_rows, library, tmp_path, monkeypatch):
    """Many files and segments; nulls, long texts, repeated rows and ids, clashing names."""
    monkeypatch.setattr(T, "FILE_BYTES", 40_000)
    monkeypatch.setattr(T, "SEGMENT_TOKENS", 700)
    path = str(tmp_path / "out")
    for _ in range(2):  # over what stood there
        T.write_token_files(table(make_docs, odd_rows), T.ByteTokenizer(FILE), path, end_id=2)
    got = sorted(T.read_documents(spark, path).collect(), key=lambda d: d.start)
    ids = [np.frombuffer(d.ids, "<u4").tolist() for d in got]
    assert sorted((-1 if d.doc_id is None else d.doc_id, i) for d, i in zip(got, ids)) == sorted((-1 if r[0] is None else r[0], [*whole(library, r[1]), 2]) for r in odd_rows)
    assert [d.doc_id for d in got] == sorted((r[0] for r in odd_rows), key=lambda i: (i is not None, i or 0))
    assert [d.start for d in got] == [0, *np.cumsum([d.n_tokens for d in got])[:-1].tolist()]
    every = np.concatenate(ids)
    files = spark.read.parquet(f"{path}/manifest").orderBy("file_no").collect()
    assert len(files) > 3 and sum(f.n_tokens for f in files) == len(every) and sum(f.n_docs for f in files) == len(got)
    asked = [*range(0, len(every), 997), len(every) - 1, len(every), -1]
    found = T.tokens_at(spark.createDataFrame([(p,) for p in asked], "at long"), path, "at").collect()
    assert sorted(map(tuple, found)) == sorted((p, int(every[p])) for p in asked if 0 <= p < len(every))
    parts = sorted(Path(path, "tokens").glob("part-*"))
    assert all(p.read_bytes()[:8] == T.MAGIC for p in parts if p.stat().st_size)


def test_registered_query(spark, make_docs, odd_rows, library, tmp_path):
    rows = [r for r in odd_rows if r[0] is not None]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    want, at = [], 0
    for i, text in sorted((r[0], r[1]) for r in rows if r[1] is not None or r[0] == 80):
        ids = np.array([*whole(library, text), 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, Q.op12_token_files(spark, str(tmp_path)).collect())) == want


def test_empty_table(spark, make_docs, tmp_path):
    path = str(tmp_path / "none")
    T.write_token_files(table(make_docs, []), T.ByteTokenizer(FILE), path)
    assert T.read_documents(spark, path).count() == 0
    assert T.tokens_at(spark.range(3).withColumnRenamed("id", "position"), path).count() == 0
