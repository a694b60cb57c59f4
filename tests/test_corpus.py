"""Cleaning, chunking, tables, splits and ids on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sectionspark.functions import text as T
from sectionspark.functions.labels import embed_text, flat_metadata
from sectionspark.operators import chunking as C
from sectionspark.operators import split as X
from sectionspark.operators.corpus import build_corpus, build_index, index_records, stamp_ids, union_corpus
from sectionspark.operators.segmentation import UNITS, split_joined_words, split_runs, word_costs
from sectionspark.operators.wordtable import column_of, table_rows, with_lines
from sectionspark.sources import tables as S


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")
    return [r[1] for r in rows.select("i", make(F.col("c"))).orderBy("i").collect()]


def lines(spark, rows, source="BNS"):
    return spark.createDataFrame([(1, source, page, n, raw) for n, (page, raw) in enumerate(rows)], S.LINES)


def test_scrub(spark):
    got = column(spark, ["  a b\t", " x ", "42", "1234", "________", "The Gazette of India Extraordinary", "LAÑ MHÑ", "", None], T.scrub)
    assert got == ["a b", "x", "", "1234", "", "", "", "", None]


def test_spacing_and_runs(spark):
    assert column(spark, ["NavyorAirForce", "act,whoever;or)Whoever 12a", "––Who"], T.boundary_spacing) == ["Navyor Air Force", "act, whoever; or) Whoever 12 a", "–– Who"]
    assert column(spark, ["a" * 20, "a" * 19, None], T.joined_run) == [True, False, None]


def test_find_section_and_title(spark):
    heads = ["Punishment 103.(1) Whoever", "359. A", "in 2023. The", "x" * 91 + " 5. A", "7. a", "400. A 12. B", "", None]
    assert column(spark, heads, lambda c: T.find_section(c, 358)) == [103, None, None, None, None, 12, None, None]
    rows = spark.createDataFrame([("Punishment.. 103.(1) Who", 103), ("ab 5. A", 5), ("1103. x", 103), (None, 3)], "l string, n int")
    assert [r[0] for r in rows.select(T.extract_title(F.col("l"), F.col("n"))).collect()] == ["Punishment", None, None, None]


@pytest.mark.parametrize("most", [358, 531, 120, 199, 300])
def test_number_range(most):
    import re

    for n in range(1000):
        assert bool(re.fullmatch(T.number_range(most), str(n))) == (1 <= n <= most)


def test_bns_state_machine(spark):
    rows = [
        (1, "text before any section"), (1, "CHAPTERVIII"), (1, "CHAPTER IX"), (1, "OFFENCES AGAINST"), (1, "lost line between heading and section"), (1, "Of theft"),
        (1, "Punishment 103.(1) Whoever commits"), (1, "42"), (2, "imprisonment for life"), (2, "Of kidnapping, abduction"), (2, "359. Not a section here"), (2, "104. Short"),
        (2, "105. Another one that is long enough"), (3, "CHAPTER X"), (3, "Last title"), (3, "106. A section after the chapter"),
    ]
    got = C.section_chunks(lines(spark, rows), C.BNS).orderBy("section_number").collect()
    assert [(r["section_number"], r["chapter_number"], r["chapter_title"], r["sub_part"]) for r in got] == [(103, "IX", "Offences Against", "Of theft"), (105, "IX", "Offences Against", "Of theft"), (106, "X", "Last title", None)]
    assert got[0]["content"] == "Punishment 103.(1) Whoever commits imprisonment for life Of kidnapping, abduction 359. Not a section here"
    assert got[0]["section_title"] == "Punishment" and got[2]["page"] == 3


def test_bnss_sub_parts_and_empty(spark):
    rows = [(1, "CHAPTER XXIX before the court"), (1, "Title"), (1, "A.—Summons"), (1, "531. Summons to be served at once")]
    got = C.section_chunks(lines(spark, rows, "BNSS"), C.BNSS).collect()
    assert [(r["chapter_number"], r["sub_part"], r["section_number"]) for r in got] == [("XXIX", "A — Summons", 531)]
    assert C.section_chunks(lines(spark, [], "BNSS"), C.BNSS).count() == 0


def test_forms_and_rules(spark):
    got = C.form_chunks(lines(spark, [(190, "before"), (190, "FORM No. 7"), (190, "To the"), (191, "court"), (191, "form no 8")])).collect()
    assert [(r["form_number"], r["content"], r["form_title"]) for r in got] == [(7, "To the court", "FORM No. 7")]
    page = f"x\n{C.RULE_MARK}\nOffence\nearly\nIf punishable with death\nno bail\n1 2 3 4\nIf punishable less"
    pages = spark.createDataFrame([(1, "BNSS", 189, page), (2, "BNSS", 189, f"{C.RULE_MARK}\nnothing"), (3, "BNSS", 1, "no mark"), (4, "BNSS", 1, None)], "doc_id long, source string, page int, text string")
    odd = spark.createDataFrame([(1, "BNSS", 1, C.RULE_MARK + "\fIf punishable with death\x0bOffence\x85no bail\u2028If punishable less\r\nfine")], "doc_id long, source string, page int, text string")
    assert [r["rule"] for r in C.rule_rows(odd).orderBy("pos").collect()] == ["If punishable with death no bail", "If punishable less fine"]
    assert [r["rule"] for r in C.rule_rows(pages).orderBy("doc_id", "pos").collect()] == ["If punishable with death no bail", "If punishable less", f"{C.RULE_MARK}\nnothing"]


def test_word_table(spark):
    words = [
        ("103(1)", 50, 90), ("Murder", 93, 90), ("death", 192, 91), ("next", 100, 97), ("Section", 50, 120), ("zz", 95, 121),
        ("104", 92, 150), ("hurt", 100, 150), ("Court", 453, 150), ("head", 50, 60), ("foot", 50, 752),
    ]
    df = spark.createDataFrame([(1, 5, 792.0, t, float(x), float(y)) for t, x, y in words], S.WORDS)
    got = table_rows(df).orderBy("pos").collect()
    assert [(r["bns_section"], r["offence"], r["punishment"], r["court"]) for r in got] == [("103(1)", "Murder next", "death", ""), ("104", "hurt", "", "Court")]
    assert column(spark, [92.9, 93.0, 191.0, 192.0, 453.0], column_of, "double") == [0, 1, 1, 2, 5]


def test_anchored_lines(spark):
    tops = [60.0 * 1, 66.0, 72.0, 78.0, 15.0]  # y = 10, 11, 12, 13 and 2 (2.5 to even)
    df = spark.createDataFrame([(1, 1, 792.0, "w", 1.0, t) for t in tops], S.WORDS)
    assert {r["y"]: r["line"] for r in with_lines(df).collect()} == {10: 10, 11: 10, 12: 12, 13: 12, 2: 2}


def test_anchored_lines_against_a_walk(spark):
    """Random pages, words repeated, rows without a document, page or height left out."""
    rng = random.Random(5)
    rows = [(d, p, 792.0, rng.choice("ab"), float(rng.randrange(3)), float(rng.randrange(60, 60 + spread))) for d in range(1, 7) for p, spread in ((1, 60), (2, 200), (3, 700)) for _ in range(60)]
    holes = [(None, 1, 792.0, "a", 1.0, 70.0), (1, None, 792.0, "a", 1.0, 70.0), (1, 1, 792.0, "a", 1.0, None)]
    got = with_lines(spark.createDataFrame(rows + rows[:9] + holes, S.WORDS)).collect()
    assert len(got) == len(rows) + 9
    want = {}
    for key in {(r["doc_id"], r["page"]) for r in got}:
        anchor = None
        for y in sorted({r["y"] for r in got if (r["doc_id"], r["page"]) == key}):
            anchor = y if anchor is None or y - anchor > 1 else anchor
            want[*key, y] = anchor
    assert all(r["line"] == want[r["doc_id"], r["page"], r["y"]] for r in got)
    plan = table_rows(spark.createDataFrame(rows, S.WORDS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


BASE = "chunk_id long, source_pdf string, section_number int, section_title string, content string"


def test_definitions_and_anchors(spark):
    rows = [
        (1, "BNS", 2, "t", 'In this ( 1)"act" denotes x; (2) "animal" means y'), (2, "BNSS", 2, "t", '(a) "audio" is a (za) "zone" is b'),
        (3, "BNS", 2, "t", "nothing"), (4, "BNSS", 359, "t", "one (2) The offences punishable two (3) When an offence is compoundable three"), (5, "BNSS", 359, "t", "no anchors"), (6, "BNS", 359, "t", "x"), (7, None, None, None, None),
    ]
    got = X.apply_splitters(spark.createDataFrame(rows, BASE)).orderBy("chunk_id", "part_no").collect()
    assert [(r["chunk_id"], r["definition_term"]) for r in got if r["chunk_id"] < 4] == [(1, "act"), (1, "animal"), (2, "audio"), (2, "zone"), (3, None)]
    assert [r["section_title"] for r in got if r["chunk_id"] == 4] == list(X.PARTS) and len([r for r in got if r["chunk_id"] > 4]) == 3


def test_compounding(spark):
    parts = spark.createDataFrame([(1, "BNSS", 359, X.PARTS[0], "Section 303(2) The owner of the property stolen. 115(2), 117(1) The person hurt"), (2, "BNSS", 359, X.PARTS[2], "318 The x")], BASE)
    table = spark.createDataFrame([("303", "Base", 1), ("303(2)", "Theft", 2), ("115(1)", "Hurt", 3), ("115(9)", "Later", 4)], "bns_section string, offence string, p int").withColumn("pos", F.struct("p"))
    got = X.compounding_chunks(parts, table).orderBy("row_no").collect()
    assert [r["content"] for r in got] == [
        "BNS Section 303(2) (Theft) can be compounded without court permission. Compounded by: The owner of the property stolen.",
        "BNS Section 115(2), 117(1) (Hurt) can be compounded without court permission. Compounded by: The person hurt",
    ]


def test_union_and_ids(spark):
    a = spark.createDataFrame([(2, 1, "b"), (1, 1, "a"), (30_000, 1, "c")], "doc_id long, p int, content string")
    b = spark.createDataFrame([(1, 2, "r2"), (1, 1, "r1")], "doc_id long, p int, rule string")
    got = stamp_ids(union_corpus([a, b]), ["p"]).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["content"] or r["rule"]) for r in got] == [(1, "a"), (2, "b"), (3, "c"), (4, "r1"), (5, "r2")]


def test_records_and_round_trips(spark, tmp_path):
    rows = [
        {"chunk_id": 1, "source_pdf": "BNS", "section_number": 103, "section_title": "Murder", "content": "c"}, {"chunk_id": 2, "source_pdf": "BNSS", "table": "Table II — x", "schedule": "First Schedule", "rule": "r"},
        {"chunk_id": 3, "source_pdf": "BNSS", "table": "Table I — x", "schedule": "First Schedule", "bns_section": "103(1)"}, {"chunk_id": 4, "source_pdf": "BNSS", "schedule": "Second Schedule", "form_number": 7, "form_title": "F", "content": "c"}, {"chunk_id": 5},
    ]
    chunks = spark.createDataFrame([], S.CHUNKS)
    chunks = spark.createDataFrame([tuple(r.get(c) for c in chunks.columns) for r in rows], S.CHUNKS)
    records = index_records(chunks)
    got = records.orderBy("chunk_id").collect()
    assert [r["chunk_type"] for r in got] == ["section", "table2", "table1", "form", "unknown"]
    assert got[0]["document"] == "[BNS] Chapter  — \nSection 103 — Murder\nc" and got[1]["page"] == -1 and got[2]["table"] == "Table I"
    S.write_chunks(chunks, str(tmp_path / "j"), "json")
    assert sorted(S.read_chunks(spark, str(tmp_path / "j"), "json").collect(), key=str) == sorted(chunks.collect(), key=str)
    (tmp_path / "a.json").write_text('[{"chunk_id": 1, "section_number": 2}, {"chunk_id": 2}]')
    assert S.read_chunks(spark, str(tmp_path / "a.json"), one_array=True).count() == 2
    for _ in range(2):
        S.write_index(records, str(tmp_path / "i"))
    assert S.index_count(spark.read.parquet(str(tmp_path / "i"))) == 5
    S.write_report(records.select("chunk_id"), str(tmp_path / "r"))
    assert embed_text() is not None and "chunk_type" in flat_metadata()


def cheapest(run, costs, unknown):
    """The cheapest split by a plain walk: ties to the earlier begin, then to the unknown letter."""
    best = [(0, 0, True)]
    for end in range(1, len(run) + 1):
        ways = [(best[end - 1][0] + unknown, end - 1, False)]
        best.append(min(ways + [(best[s][0] + costs[run[s:end]], s, True) for s in range(end) if run[s:end] in costs]))
    out, end = [], len(run)
    while end:
        _, start, known = best[end]
        while not known and start and not best[start][2]:
            start = best[start][1]
        out.append(run[start:end])
        end = start
    return out[::-1]


def test_runs_are_split_at_least_cost(spark):
    """Ties, unknown letters, words longer than a window, runs over many blocks of the fold."""
    r = random.Random(2)
    words = list(dict.fromkeys("".join(r.choice("abcd") for _ in range(r.choice([1, 2, 2, 3, 4, 5]))) for _ in range(80))) + ["abcd" * 20, "é" * 3]
    costs = {w: r.choice([1.0, 2.0, 2.5, 3.0]) for w in words}
    runs = list(dict.fromkeys("".join(r.choice("aabbccddxéz") for _ in range(n)) for n in [1, 2, 3, 5, 8, 13, 30, 64, 65, 66, 255, 256, 257, 700] * 3))
    runs += ["abcd" * 45, "x" * 3000, "q"]
    got = {x["run"]: x["words"] for x in split_runs(spark.createDataFrame([(x,) for x in runs], "run string"), spark.createDataFrame(list(costs.items()), "word string, cost double")).collect()}
    unknown = round((3.0 + math.log(len(costs) + 2) * 3) * UNITS)
    priced = {w: round(c * UNITS) for w, c in costs.items()}
    assert got == {x: cheapest(x, priced, unknown) for x in runs}


def test_segmentation(spark):
    texts = spark.createDataFrame([("in the imprisonment for life shall be it " * 5,), (None,)], "text string")
    costs = word_costs(texts)
    rows = spark.createDataFrame([(1, "inthe imprisonmentforlife"), (2, "Sanhita,unless Itshall"), (3, None), (4, "FORLIFESHALL")], "i int, raw string")
    got = [r[0] for r in split_joined_words(rows, costs).orderBy("i").select("fixed").collect()]
    assert got[0] == "in the imprisonment for life" and got[1].startswith("Sanhita, ") and got[1].endswith("It shall") and got[2] is None and got[3] == "For Life Shall"
    odd = spark.createDataFrame([(1, ""), (2, "  "), (3, "(a) x-y, \t don't"), (4, "(a) x-y, \t don't"), (5, "zzz" * 30)], "i int, raw string")
    got = [r[0] for r in split_joined_words(odd, costs).orderBy("i").select("fixed").collect()]
    assert got == ["", "", "( a) x- y, don' t", "( a) x- y, don' t", "zzz" * 30]
    assert split_joined_words(odd.limit(0), costs).count() == 0 and word_costs(texts.limit(0)).count() == 0


def test_word_costs_rank_all_words(spark):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    texts = spark.createDataFrame([(" ".join([w] * (i % 5 + 1)),) for i, w in enumerate(words)], "text string")
    want = sorted(words, key=lambda w: (-(words.index(w) % 5 + 1), w))
    assert [r["word"] for r in word_costs(texts).orderBy("rank").collect()] == want


def test_line_ends(spark):
    rows = [(1, "BNS", 1, "a\r\nb\fc\x85d\u2028e\x0b\n"), (2, "BNS", 1, ""), (3, "BNS", 1, None), (4, "BNS", 1, "\n\nx")]
    got = S.read_lines(spark.createDataFrame(rows, "doc_id long, source string, page int, text string")).orderBy("doc_id", "line_no").collect()
    want = [(i, n, line) for i, _, _, t in rows for n, line in enumerate((t or "").splitlines())]
    assert [(r["doc_id"], r["line_no"], r["raw"]) for r in got] == want


def test_ids_of_sparse_documents(spark):
    rows = [(p, None if d == 0 else d * 10**15 % 7919 * 10**11, n) for p in (0, 1) for d in range(40) for n in range(3)]
    out = stamp_ids(spark.createDataFrame(rows, "part_ord int, doc_id long, pos int"), ["pos"]).collect()
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    assert [tuple(r)[:3] for r in sorted(out, key=lambda r: r["chunk_id"])] == want and sorted(r["chunk_id"] for r in out) == list(range(1, len(rows) + 1))


def test_corpus_and_index_from_end_to_end(spark, tmp_path):
    bns = lines(spark, [(1, "CHAPTER I"), (1, "PRELIMINARY"), (1, '2. Definitions (1) "act" denotes a series of acts; (2) "court" means a court of law'), (1, "Punishment 103.(1) Whoever commits murder shall be punished")])
    text = "Compounding 359.(1) The offences 115(2) The person hurt (2) The offences punishable below 303(2) The owner of it (3) When an offence is compoundable"
    bnss = lines(spark, [(1, "CHAPTER II"), (1, "COURTS"), (1, text)], "BNSS").withColumn("doc_id", F.lit(2).cast("bigint"))
    words = spark.createDataFrame([(3, 1, 792.0, t, x, 100.0) for t, x in (("303(2)", 50.0), ("Theft", 100.0), ("Fine", 200.0), ("Cognizable", 290.0), ("Bailable", 380.0), ("Magistrate", 460.0))], S.WORDS)
    pages = spark.createDataFrame([(4, "BNSS", 9, C.RULE_MARK + "\nIf punishable with death")], "doc_id long, source string, page int, text string")
    forms = lines(spark, [(1, "FORM No. 7"), (1, "Bond of a person")], "BNSS").withColumn("doc_id", F.lit(5).cast("bigint"))
    corpus = build_corpus(bns.union(bnss), words, pages, forms)
    rows = corpus.orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == list(range(1, len(rows) + 1))
    got = [(r["part_ord"], r["section_number"], r["definition_term"], r["compounding_section"], r["bns_section"], r["form_number"]) for r in rows]
    assert got == [(0, 2, "act", None, None, None), (0, 2, "court", None, None, None), (0, 103, None, None, None, None), (1, 359, None, None, None, None), (1, 359, None, None, None, None), (1, 359, None, None, None, None),
        (2, 359, None, "115(2)", None, None), (2, 359, None, "303(2)", None, None), (3, None, None, None, "303(2)", None), (4, None, None, None, None, None), (5, None, None, None, None, 7)]
    assert [r["compounding_offence"] for r in rows if r["part_ord"] == 2] == ["offence", "Theft"] and rows[9]["rule"] == "If punishable with death"
    S.write_chunks(corpus.drop("pos"), str(tmp_path / "chunks"))
    for _ in range(2):  # a second build replaces the first
        assert build_index(S.read_chunks(spark, str(tmp_path / "chunks")), str(tmp_path / "index")) == len(rows)
    index = spark.read.parquet(str(tmp_path / "index"))
    assert {(r["chunk_type"], r["n"]) for r in index.groupBy("chunk_type").agg(F.count("*").alias("n")).collect()} == {("section", 8), ("table1", 1), ("table2", 1), ("form", 1)}
    assert {len(r["embedding"]) for r in index.select("embedding").collect()} == {384}


def walked(rows):
    """Sections of one BNSS document by a plain walk over its lines."""
    out, chapter, title, sub, now, after = [], None, None, None, None, False
    for page, n, line in rows:
        if line.startswith("CHAPTER "):
            chapter, title, sub, now, after = line[8:], None, None, None, True
        elif after:
            title, after = (line.title() if line.isupper() else line), False
        elif line.startswith("A.—"):
            sub, now = "A — " + line[3:], None
        elif line.startswith("Note "):
            now = [chapter, title, sub, int(line[5:].split(".")[0]), page, n, [line]]
            out.append(now)
        elif now:
            now[-1].append(line)
    return [(*s[:-1], " ".join(s[-1])) for s in out if len(" ".join(s[-1])) > 20]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_one_long_document(spark, monkeypatch, block):
    """Chapters, titles and sections that reach over blocks and pages of one document."""
    monkeypatch.setattr(C, "BLOCK_LINES", block)
    r = random.Random(block)
    kinds = ["CHAPTER IV", "CHAPTER X", "A.—Summons of " + "x" * 4, "OF COURTS"] + ["Note {}. (1) A thing"] * 3 + ["plain words of a law"] * 9
    rows = [(page, n, r.choice(kinds).format(r.randint(1, 500))) for page in range(1, 41) for n in range(25 if page % 9 else 120)]
    df = spark.createDataFrame([(7, "BNSS", *x) for x in rows], S.LINES).repartition(4)
    got = C.section_chunks(df, C.BNSS).orderBy("pos").collect()
    assert [(g["chapter_number"], g["chapter_title"], g["sub_part"], g["section_number"], g["page"], g["pos"]["line_no"], g["content"]) for g in got] == walked(rows)
    scanned = C.so_far(df, {"last": F.when(F.col("raw").startswith("Note"), F.col("raw"))}, {"n": F.lit(1)}).orderBy("n").collect()
    assert [x["n"] for x in scanned] == list(range(1, len(rows) + 1)) and [(x["page"], x["line_no"]) for x in scanned] == [x[:2] for x in rows]
    forms = [(1, "BNSS", p, n, f"FORM No. {p}" if n == 3 and p % 2 else "a line") for p in range(1, 9) for n in range(6)]
    got = C.form_chunks(spark.createDataFrame(forms, S.LINES)).orderBy("pos").collect()
    assert [(g["form_number"], g["content"].count("a line")) for g in got] == [(1, 11), (3, 11), (5, 11), (7, 8)]
