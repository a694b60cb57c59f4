"""Types, flat metadata and texts of chunks; citation labels and context entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def chunk_type() -> Column:
    """U3. "Table II" is tested first: it starts with "Table I"."""
    return (
        F.when(F.col("section_number").isNotNull(), "section").when(F.col("table").startswith("Table II"), "table2")
        .when(F.col("table").startswith("Table I"), "table1").when(F.col("schedule") == "Second Schedule", "form").otherwise("unknown")
    )


#: Metadata of each type beyond chunk_id, source_pdf, page and chunk_type.
META = {
    "section": ("chapter_number", "chapter_title", "sub_part", "section_title", "definition_term", "compounding_section", "compounding_type"),
    "table1": ("bns_section",), "table2": (), "form": ("form_title",), "unknown": (),
}


def flat_metadata() -> dict[str, Column]:
    """U4: flat columns; '' and -1 stand for null."""
    kind, first = chunk_type(), F.lit("First Schedule")
    out = {"chunk_id": F.coalesce("chunk_id", F.lit(-1)), "source_pdf": _text("source_pdf"), "page": F.coalesce("page", F.lit(-1)), "chunk_type": kind}
    for t, names in META.items():
        out |= {n: F.when(kind == t, _text(n)).otherwise("") for n in names}
    out["section_number"] = F.coalesce("section_number", F.lit(-1))
    out["form_number"] = F.when(kind == "form", F.coalesce("form_number", F.lit(-1))).otherwise(-1)
    out["schedule"] = F.when(kind.isin("table1", "table2"), first).when(kind == "form", "Second Schedule").otherwise("")
    out["table"] = F.when(kind == "table1", "Table I").when(kind == "table2", "Table II").otherwise("")
    return out


def embed_text() -> Column:
    """The text that is encoded, by type."""
    kind, src, sec, title, body = chunk_type(), _text("source_pdf"), _text("section_number"), _text("section_title"), _text("content")
    compounding = (F.col("source_pdf") == "BNSS") & (F.col("section_number") == 359)
    some = lambda name, lead: F.when(_text(name) != "", F.concat(F.lit(lead), name)).otherwise("")
    head = F.concat(F.lit("["), src, F.lit("] Chapter "), _text("chapter_number"), F.lit(" — "), _text("chapter_title"), some("sub_part", " | "), F.lit("\nSection "), sec, some("section_title", " — "))
    row = F.concat(F.lit("[BNS First Schedule Table I] Section "), _text("bns_section"), F.lit(": "), _text("offence"), F.lit(". Punishment: "), _text("punishment"), F.lit(". Cognizable: "), _text("cognizable"), F.lit(". Bailable: "), _text("bailable"), F.lit(". Court: "), _text("court"), F.lit("."))
    return (
        F.when((kind == "section") & (_text("definition_term") != ""), F.concat(F.lit("["), src, F.lit(" Section "), sec, F.lit('] Definition of "'), _text("definition_term"), F.lit('"\n'), src, F.lit(' defines "'), _text("definition_term"), F.lit('" as follows: '), body))
        .when((kind == "section") & compounding & (_text("compounding_section") != ""), F.concat(F.lit("[BNSS Section 359 — Compounding] "), body))
        .when((kind == "section") & compounding, F.concat(F.lit("[BNSS Section 359] "), title, F.lit("\n"), body))
        .when(kind == "section", F.concat(head, F.lit("\n"), body))
        .when(kind == "table2", F.concat(F.lit("[BNSS First Schedule Table II] "), _text("rule"))).when(kind == "table1", row)
        .when(kind == "form", F.concat(F.lit("[BNSS Second Schedule Form "), _text("form_number"), F.lit("] "), _text("form_title"), F.lit("\n"), body))
        .otherwise(F.when(body != "", body).otherwise(F.to_json(F.struct("*"))))
    )


def citation() -> Column:
    """R5, from flat metadata."""
    c = F.col
    return (
        F.when(c("chunk_type") == "section", F.concat(c("source_pdf"), F.lit(" Section "), c("section_number").cast("string"), F.when(c("section_title") != "", F.concat(F.lit(" — "), "section_title")).otherwise("")))
        .when(c("chunk_type") == "table1", F.concat(c("source_pdf"), F.lit(" First Schedule Table I — Section "), "bns_section"))
        .when(c("chunk_type") == "table2", F.concat(c("source_pdf"), F.lit(" First Schedule Table II")))
        .when(c("chunk_type") == "form", F.concat(c("source_pdf"), F.lit(" Second Schedule Form "), c("form_number").cast("string"), F.lit(" — "), "form_title"))
        .otherwise(F.concat(c("source_pdf"), F.lit(" chunk "), c("chunk_id").cast("string")))
    )


def context_entry(rank: Column) -> Column:
    """R7: "[i] SRC Section N — title" over the document; empty parts are left out."""
    number = F.when(F.col("chunk_type") == "section", F.col("section_number").cast("string")).otherwise(F.col("bns_section"))
    return F.concat(
        F.lit("["), rank.cast("string"), F.lit("] "), "source_pdf", F.when(number != "", F.concat(F.lit(" Section "), number)).otherwise(""),
        F.when(F.col("section_title") != "", F.concat(F.lit(" — "), "section_title")).otherwise(""), F.lit("\n"), "document",
    )
