"""Checks of answers and of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectionspark.operators.rank import CRPC_PAIRS, IPC_PAIRS

BLOCKED = "could not generate"


def missing_keywords(answer: Column, keywords: Column) -> Column:
    return F.filter(keywords, lambda k: ~F.contains(F.lower(answer), F.lower(k)))


def check_answers(cases: DataFrame, least: int = 20) -> DataFrame:
    """Adds passed and reason. cases: answer, keywords; a null answer is too short."""
    answer = F.coalesce("answer", F.lit(""))
    missing = F.array_compact(missing_keywords(answer, F.col("keywords")))
    reason = F.when(F.contains(F.lower(answer), F.lit(BLOCKED)), "blocked").when(F.length(answer) < least, "too short")
    reason = reason.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))).otherwise("")
    return cases.withColumn("reason", reason).withColumn("passed", F.col("reason") == "")


def score_by(cases: DataFrame, column: str) -> DataFrame:
    """Passed, total, percent and band for each value of ``column`` and, with a
    null there, for all."""
    out = cases.rollup(column).agg(F.sum(F.col("passed").cast("bigint")).alias("passed"), F.count("*").alias("total"))
    percent = F.floor(100 * F.col("passed") / F.col("total")).cast("bigint")
    return out.withColumn("percent", percent).withColumn("band", F.when(percent >= 80, "good").when(percent >= 60, "fair").otherwise("poor"))


def hit_at_k(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """E5: query_id, hit. hits: query_id, source, section, rank; expected: query_id, source,
    section (both as strings), k."""
    e = expected.withColumnsRenamed({"source": "e_source", "section": "e_section"})
    match = (F.col("source") == F.col("e_source")) & (F.col("section").cast("string") == F.col("e_section")) & (F.col("rank") <= F.col("k"))
    return e.join(hits, "query_id", "left").groupBy("query_id").agg(F.max(F.coalesce(match, F.lit(False)).cast("int")).alias("hit"))


def section_counts(chunks: DataFrame) -> DataFrame:
    """E6."""
    return chunks.where("section_number is not null").groupBy("source_pdf").agg(F.countDistinct("section_number").alias("sections"))


def range_checks(chunks: DataFrame) -> DataFrame:
    """Counts and ranges in one pass."""
    c = F.col
    return chunks.agg(
        F.count("*").alias("total"), F.count_if(c("chunk_type") == "table1").alias("table1_rows"), F.min("section_number").alias("least_section"),
        F.max("section_number").alias("greatest_section"), F.count_if((c("section_number") < 1) | (c("section_number") > 358)).alias("out_of_range"),
    )


def field_checks(chunks: DataFrame) -> DataFrame:
    """How many rows break each rule."""
    c = F.col
    table1 = ("bns_section", "offence", "punishment", "cognizable", "bailable")
    return chunks.agg(
        F.count_if(c("source_pdf").isNull()).alias("no_source"), F.count_if(~c("source_pdf").isin("BNS", "BNSS")).alias("bad_source"),
        *[F.count_if((c("chunk_type") == "table1") & c(n).isNull()).alias(f"no_{n}") for n in table1],
        F.count_if((c("chunk_type") == "section") & (F.trim(F.coalesce("content", F.lit(""))) == "")).alias("blank_content"),
    )


def duplicate_ids(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """E9."""
    return chunks.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def sections_with_keyword(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """source_pdf, section_number, keyword, found. One chunk that holds the keyword is
    enough, so contents need not be joined."""
    rows = wanted.join(chunks.select("source_pdf", "section_number", "content"), ["source_pdf", "section_number"], "left")
    found = F.coalesce(F.contains(F.lower("content"), F.lower("keyword")), F.lit(False))
    return rows.groupBy("source_pdf", "section_number", "keyword").agg(F.max(found).alias("found"))


def absent_sections(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (source_pdf, section) that no section has, nor a table row as such or
    as the start of "N(...)"."""
    have = chunks.where("section_number is not null").select("source_pdf", F.col("section_number").cast("string").alias("section"))
    rows = chunks.where("chunk_type = 'table1'").select("source_pdf", F.substring_index("bns_section", "(", 1).alias("section"))
    return wanted.join(have.union(rows).distinct(), ["source_pdf", "section"], "left_anti")


def coverage(chunks: DataFrame) -> DataFrame:
    """Path (section, table1, definition), source_pdf, key: what tests should cover."""
    plain = chunks.where("chunk_type = 'section' and coalesce(definition_term, '') = '' and coalesce(compounding_section, '') = ''")
    base = F.substring_index("bns_section", "(", 1)
    parts = (
        plain.select(F.lit("section").alias("path"), "source_pdf", F.col("section_number").cast("string").alias("key")),
        chunks.where(F.col("chunk_type") == "table1").where(base.rlike("^[0-9]+$")).select(F.lit("table1").alias("path"), "source_pdf", base.alias("key")),
        chunks.where("coalesce(definition_term, '') <> ''").select(F.lit("definition").alias("path"), "source_pdf", F.col("definition_term").alias("key")),
    )
    return parts[0].union(parts[1]).union(parts[2]).distinct()


# Questions on the second table; topics (what is asked, the section that an answer
# should name); questions on bail; old sections asked for (their successors are the prompt's).
TABLE2_QUESTIONS = (
    "What offences are covered in Table II of BNSS First Schedule?", "What is the bail amount prescribed in BNSS First Schedule Table II?",
    "What does Table II of BNSS say about bailable offences?",
)
TOPICS = (
    ("What is the punishment for murder?", "103"), ("What is the punishment for rape under BNS?", "64"), ("What is the punishment for theft?", "303"),
    ("What is the punishment for robbery?", "309"), ("What is the difference between robbery and dacoity?", "310"), ("What is the punishment for cheating?", "318"),
    ("What is dowry death under BNS?", "80"), ("What is the law on cruelty by husband?", "85"), ("What is defamation under BNS?", "356"),
    ("What is kidnapping under BNS?", "137"), ("What is abduction under BNS?", "138"), ("What is extortion under BNS?", "308"),
    ("What is criminal breach of trust?", "316"), ("What is criminal conspiracy under BNS?", "61"), ("What is the punishment for attempt to murder?", "109"),
    ("What is stalking under BNS?", "78"), ("What is voyeurism under BNS?", "77"), ("What is acid attack under BNS?", "124"),
    ("What is human trafficking under BNS?", "143"), ("What is organised crime under BNS?", "111"), ("What is a terrorist act under BNS?", "113"),
    ("What replaced sedition under BNS?", "152"), ("What is hit and run law under BNS?", "106"), ("What is the law on mob lynching?", "103"),
    ("What are the offences related to assault?", "74"), ("What is mischief under BNS?", "324"), ("What is hurt and grievous hurt?", "114"),
    ("What is wrongful confinement under BNS?", "126"), ("What is trespass under BNS?", "329"), ("What is forgery under BNS?", "336"),
    ("What is the procedure for filing an FIR?", "173"), ("What is a zero FIR?", "173"), ("What is anticipatory bail?", "482"),
    ("What is the procedure for bail in a bailable offence?", "480"), ("What is remand under BNSS?", "187"), ("What is the procedure when a person is arrested?", "35"),
    ("What is a charge sheet?", "193"), ("What is default bail?", "187"), ("What is anticipatory bail under BNSS?", "482"),
    ("What is compounding of offences under BNSS?", "359"), ("What is the procedure for recording a confession?", "183"), ("What is the power of High Court under BNSS?", "528"),
    ("What is a proclaimed offender?", "84"), ("What is the procedure for summoning an accused?", "63"), ("What is a warrant of arrest?", "72"),
    ("What is the procedure for search and seizure?", "185"), ("How does a Magistrate take cognizance?", "210"), ("What is the procedure for a trial?", "228"),
    ("What is Section 144 BNSS?", "163"),
    ("Is murder bailable under BNS?", "non-bailable"), ("Is rape a non-bailable offence?", "non-bailable"), ("Is theft cognizable under BNS?", "cognizable"),
    ("Is dacoity cognizable and non-bailable?", "non-bailable"), ("Is cheating a bailable offence?", "bailable"), ("What offences are in Table II of BNSS?", ""),
)
ASKED_IPC = ("302", "376", "420", "498A", "304B", "307", "379", "395", "124A", "120B")
ASKED_CRPC = ("154", "437", "438", "167", "41", "173", "164")


def fixed_questions() -> list[tuple[str, str, str]]:
    """Path, question, keyword of the questions that hold for every corpus."""
    out = [("table2", q, "") for q in TABLE2_QUESTIONS] + [("topic", q, k) for q, k in TOPICS]
    for code, asked, pairs in (("IPC", ASKED_IPC, IPC_PAIRS), ("CrPC", ASKED_CRPC, CRPC_PAIRS)):
        out += [("topic", f"What replaced {code} Section {n}?", str(dict(pairs)[n])) for n in asked]
    return out


def generated_questions(covered: DataFrame) -> DataFrame:
    """Path, question, keyword for each row of coverage, and the fixed questions. An empty
    keyword asks for an answer only."""
    c = F.col
    question = F.when(c("path") == "section", F.format_string("What is %s Section %s?", "source_pdf", "key")).when(
        c("path") == "table1", F.format_string("Is BNS Section %s cognizable and bailable?", "key")
    ).otherwise(F.format_string('What is the definition of "%s" under %s?', "key", "source_pdf"))
    keyword = F.when(c("path") == "definition", F.lower(F.substring_index("key", " ", 1))).otherwise("")
    own = covered.select("path", question.alias("question"), keyword.alias("keyword"))
    return own.union(covered.sparkSession.createDataFrame(fixed_questions(), "path string, question string, keyword string"))
