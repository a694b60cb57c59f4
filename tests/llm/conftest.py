import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, repeats string, cell int, k1 string, id string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents with extra columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", None, 7, "k", "i") for i, t, lang, s in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, copies and repeated rows."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(400)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = line(12)
    rows = []
    for i in range(60):
        text = "\n".join([line(r.randint(1, 30)) for _ in range(r.randint(1, 4))] + [shared] * (i % 3 == 0))
        rows.append((i, text, ["en", "de", None][i % 3], ["s0", "s1", "s0", None][i % 4]))
    base = rows[5][1].split(" ")
    for i in range(60, 75):  # near copies, exact copies
        copy = list(base)
        copy[i % len(copy)] = f"w{i}"
        rows.append((i, " ".join(copy) if i % 2 else rows[7][1], "en", "s0"))
    rows += [(80, None, "en", "s1"), (81, "", None, None), (82, "\n\n \t", "en", "s2"), (83, line(30_000), "en", "s0"), (84, "É é ß !!! 123", "de", "s1"), (85, "12 34 --", None, "s1")]
    rows += [(86, "one two", "en", "s1")] * 2 + [(None, "no id here", "en", None), (87, "x" * 200_000, "en", "s2")]
    return rows
