"""Question expansion and intent, as expressions on a question column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sectionspark.functions import rules as R

# How a section with its source, a bare section, a form and bail are named.
SECTION_WITH_SOURCE = r"(?i)\b(BNS|BNSS)\s+(?:(?:section|sec\.?)\s+)?(\d{1,3}[A-Za-z]?)\b"
BARE_SECTION = r"\b(?:[Ss]ection|[Ss]ec\.?)\s+(\d+[A-Za-z]?)\b"
FORM = r"(?i)\bform\s+(?:no\.?\s*)?(\d+)\b"
BAIL = r"(?i)\b(cognizable|bailable|bail|non-bailable|non bailable)\b"


def _unicode(pattern: str) -> str:
    """The pattern with Unicode digits, white space and word ends."""
    return "(?U)" + pattern


#: A question as the phrases see it: letters of any case that Java folds to ASCII, one blank for a
#: white space and two for a run of them.
FOLDED = ("ſıİK", "siik")
PIECES = r"(?U)\w+|\W+"


def phrases(q: Column) -> Column:
    """The phrases of the rules that stand in a question between ends of words. Words that begin a
    phrase are found first; only what follows them is joined and looked up."""
    known, firsts = R.phrase_rules(), _first_words()
    lengths = sorted({len(re.findall(r"\w+|\W+", p)) for rule in known for p in rule.phrases})
    text = F.regexp_replace(F.regexp_replace(F.lower(F.translate(q, *FOLDED)), r"(?U)\s", " "), "  +", "  ")
    pieces = F.regexp_extract_all(text, F.lit(PIECES), 0)
    return F.aggregate(F.array(pieces), F.array().cast("array<string>"), lambda _, ps: F.array_intersect(_grams(ps, firsts, lengths), _words(p for rule in known for p in rule.phrases)))


def _first_words() -> list[str]:
    return sorted({re.match(r"\w+", p)[0] for rule in R.phrase_rules() for p in rule.phrases})


def _grams(pieces: Column, firsts: list[str], lengths: list[int]) -> Column:
    """Joined runs of pieces that begin with one of the words."""
    at = F.filter(F.transform(pieces, lambda p, i: F.when(p.isin(firsts), i + 1)), lambda i: i.isNotNull())
    return F.flatten(F.transform(at, lambda i: F.array(*[F.array_join(F.slice(pieces, i, n), "") for n in lengths])))


def _words(values) -> Column:
    return F.array(*map(F.lit, sorted(set(values))))


def expansions(q: Column) -> Column:
    """Q1-Q5: the distinct additions in rule order; a back-reference rule adds one for each
    match. White space, digits and word ends are those of Unicode. Rules whose patterns stand for
    a few phrases are a table that the question's phrases are looked up in; patterns are left for
    numbers only, and tried where the question has a digit. A question with neither a digit nor a
    word that begins a phrase is left as it is by one test."""
    none = F.array().cast("array<string>")
    digit = q.rlike(r"(?U)\d")
    begun = q.rlike(rf"(?iU)\d|\b(?:{'|'.join(_first_words())})\b")

    def all_of(found: Column) -> Column:
        parts = []
        for kind, group in R.groups():
            if kind == "phrases":
                table = F.array(*[F.struct(_words(rule.phrases).alias("phrases"), F.lit(rule.words).alias("words")) for rule in group])
                part = F.when(F.size(found) > 0, F.transform(F.filter(table, lambda r: F.arrays_overlap(r["phrases"], found)), lambda r: r["words"]))
            elif kind == "numbered":
                part = F.when(digit, _numbered(q, *group))
            else:
                part = F.when(digit, F.transform(F.regexp_extract_all(q, F.lit(f"(?iU){group[0]}"), 1), _after(F.lit(group[1].replace("{1}", "")))))
            parts.append(F.coalesce(part, none))
        return F.array_distinct(F.flatten(F.array(*parts)))

    made = F.aggregate(F.array(phrases(q)), none, lambda _, found: F.when(digit | (F.size(found) > 0), all_of(found)).otherwise(none))
    return F.when(begun, made).otherwise(none)


def _after(lead: Column):
    return lambda n: F.concat(lead, n)


def _numbered(q: Column, code: str, rules: tuple) -> Column:
    """The rules of all section numbers that stand after the code or before it on a line: the
    numbers are read once, and a small table of the rules is looked up."""
    after = F.regexp_extract_all(q, F.lit(rf"(?iU)\b{code}\s+(?:sec(?:tion)?\s+)?(\d+[a-z]?)\b"), 1)
    before = F.regexp_extract_all(q, F.lit(rf"(?iU)\b(\d+[a-z]?)\b(?=[^\n]*\b{code}\b)"), 1)
    found = F.transform(F.concat(after, before), F.upper)
    table = F.array(*[F.struct(F.lit(re.sub(r"\[(.).\]", r"\1", n)).alias("n"), F.lit(words).alias("words")) for n, words in rules])
    return F.when(F.size(found) > 0, F.transform(F.filter(table, lambda r: F.array_contains(found, r["n"])), lambda r: r["words"]))


def expand(q: Column) -> Column:
    return F.when(q.isNotNull(), F.concat_ws(" ", q, expansions(q)))


def form_number(q: Column) -> Column:
    """Q6."""
    return _number(F.regexp_extract(q, _unicode(FORM), 1))


def _number(c: Column) -> Column:
    return F.translate(F.regexp_extract(c, r"(?U)^(\d+)", 1), "०१२३४५६७८९", "0123456789").try_cast("int")


def named_sections(q: Column) -> Column:
    """What Q7-Q9 rest on, read once: the source named with a section (upper case, else null) and
    the number, of that section or else of a bare one (Q8, case-sensitive), without a trailing
    letter."""
    source = F.upper(F.nullif(F.regexp_extract(q, _unicode(SECTION_WITH_SOURCE), 1), F.lit("")))
    number = F.coalesce(_number(F.regexp_extract(q, _unicode(SECTION_WITH_SOURCE), 2)), _number(F.regexp_extract(q, _unicode(BARE_SECTION), 1)))
    return F.struct(source.alias("section_source"), number.alias("section_number"))


def section_sources() -> Column:
    """Q7/Q8, beside section_source and section_number: the named source, or both for a bare number."""
    named = F.when(F.col("section_source").isNotNull(), F.array("section_source"))
    return named.when(F.col("section_number").isNotNull(), F.array(F.lit("BNS"), F.lit("BNSS")))


def famous_section() -> Column:
    """Q9, beside the same: the section that a bare old number most likely means, null if none or
    the same."""
    table = F.create_map(*[F.lit(v) for pair in R.FAMOUS.items() for v in pair])
    mapped = F.try_element_at(table, F.col("section_number"))
    return F.when(F.col("section_source").isNull() & (mapped != F.col("section_number")), mapped)


def bail_intent(q: Column) -> Column:
    """Q10."""
    return q.rlike(_unicode(BAIL))
