"""Expansion and intent: question and expected pairs."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sectionspark.functions import questions as Q
from sectionspark.functions.rules import RULES, phrase_rules, spelled
from sectionspark.operators.retrieve import with_intent

EXPANDED = [
    ("What replaced IPC Section 302?", "BNS Section 103 murder"), ("IPC Section 498A cruelty", "BNS Section 85 cruelty husband wife"),
    ("302 of IPC", "BNS Section 103 murder"), ("Section 304B IPC", "BNS Section 80 dowry death"), ("booked under 302", "BNS Section 103 murder"),
    ("420 case", "BNS Section 318 cheating"), ("u/s 376", "BNS Section 64 rape"), ("CrPC 438 anticipatory bail", "BNSS Section 482 anticipatory bail"),
    ("161 of CrPC", "BNSS Section 180 examination witnesses police"), ("Submit eFIR online", "Section 173 BNSS electronic"),
    ("What is S.103 of BNS?", "Section 103"), ("sec 75 punishment", "Section 75"), ("dhara 302 kya hai?", "BNS Section 103 murder IPC 302"),
    ("charge-sheet filing", "Section 193 BNSS report"), ("hit and run", "Section 106 BNS"), ("what is a challan", "Section 193 BNSS"),
]


@pytest.fixture(scope="module")
def expand(spark):
    def run(questions):
        rows = spark.createDataFrame(list(enumerate(questions)), "i int, q string")
        return [r[1] for r in rows.select("i", Q.expand(F.col("q"))).orderBy("i").collect()]

    return run


def test_expected_words(expand):
    for (question, words), got in zip(EXPANDED, expand([q for q, _ in EXPANDED])):
        assert got.startswith(question) and words in got, (question, got)


def test_unchanged(expand):
    assert expand(["What is the weather today?", "", None]) == ["What is the weather today?", "", None]


def test_once_and_in_order(expand):
    got = expand(["IPC 302 and IPC Section 302", "What is a zero FIR?"])
    assert got[0].count("BNS Section 103 murder") == 1
    assert got[1].index("any police station") < got[1].index("First Information Report")


def test_back_references_for_each_match(expand):
    assert expand(["sec 75 and sec 76 and sec 75"])[0].endswith("Section 75 Section 76")


def _plain(question):
    out = []
    for pattern, words in RULES:
        found = re.finditer(pattern, question, re.IGNORECASE)
        out += [words.replace("{1}", m.group(1)) if "{1}" in words else words for m in found]
    return " ".join([question, *dict.fromkeys(out)]) if out else question


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["IPC", "302", "CrPC", "154", "of", "Section", "sec.", "u/s", "murder", "FIR", "zero", "dhara", "498A", "bail", "x", "३०२", "75"]), max_size=7), min_size=1, max_size=20))
def test_same_as_a_plain_loop(expand, many):
    asked = [" ".join(w) for w in many]
    assert expand(asked) == [_plain(q) for q in asked]


WORDS = ["charge", "sheet", "chargesheet", "ſheet", "gang", "rape", "hit", "and", "run", "non", "cognizable", "u", "s", "us302", "302", "booked", "under", "section", "accused", "of", "498a", "420", "case", "zero", "e", "fir", "eFIR", "false", "promise", "to", "marry", "organised", "organızed", "crime", "terrorist", "proclaimed", "offender", "BNS", "bnss", "dhara", "IPC", "S", "_", "é", "144"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from([" ", " ", "  ", "-", "/", " / ", "\n", "\t \u00a0", ". ", "", ", "])), max_size=9), min_size=20, max_size=60))
def test_phrases_same_as_a_plain_loop(expand, many):
    asked = ["".join(w + gap for w, gap in one) for one in many]
    assert expand(asked) == [_plain(q) for q in asked]


def test_every_phrase_of_a_rule_is_found_by_its_pattern(expand):
    rules = phrase_rules()
    asked = [p for rule in rules for p in rule.phrases]
    assert len(rules) > 50 and expand(asked) == [_plain(q) for q in asked]
    assert expand([f"x{p}x" for p in asked]) == [_plain(f"x{p}x") for p in asked]


def test_patterns_that_are_no_few_phrases():
    assert spelled(r"\bsec\.?\s+(\d+)\b") is None and spelled(r"\b(?:a|b[^\n]*)\b") is None
    assert spelled(r"\b(?:ab|c\s+(?:d\s+)?e)\b") == ("ab", "c e", "c d e", "c d  e", "c  e", "c  d e", "c  d  e")


def test_intents(spark):
    asked = ["What is BNS 103?", "What is BNSS 173?", "What is section 302?", "What is section 498A?", "What is BNSS sec 173?", "SECTION 302", "form 7", "Is BNS Section 103 cognizable and bailable?", "Is murder bailable under BNS?", "section 304B", None]
    rows = with_intent(spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")).orderBy("query_id").collect()
    assert [(r["section_source"], r["section_number"]) for r in rows] == [("BNS", 103), ("BNSS", 173), (None, 302), (None, 498), ("BNSS", 173), (None, None), (None, None), ("BNS", 103), (None, None), (None, 304), (None, None)]
    assert [r["famous"] for r in rows] == [None, None, 103, 85, None, None, None, None, None, 106, None]
    assert rows[6]["form_number"] == 7 and [r["bail"] for r in rows][7:9] == [True, True]
    assert rows[2]["sources"] == ["BNS", "BNSS"] and rows[0]["sources"] == ["BNS"]
