"""Inputs of the registered queries, derived from the given tables.

The texts of the tables hold no statutes, so headings, questions and chunks are derived by
expressions that Spark SQL and DuckDB both read; ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectionspark.sources.tables import read_lines

NUMBERS = (302, 304, 306, 307, 323, 354, 363, 375, 376, 379, 392, 395, 406, 420, 447, 498, 499, 503, 506, 103, 173, 154)
_NUMBER = "case when o_orderkey % 3 = 0 then 302 else case o_custkey % 22 " + " ".join(f"when {i} then {n}" for i, n in enumerate(NUMBERS)) + " end end"
_TEMPLATES = (
    "'What replaced IPC Section ' || n || '?'", "n || ' of IPC'", "'BNS ' || n", "'section ' || n", "'booked u/s ' || n", "'form ' || f",
    "'Is BNS Section ' || n || ' bailable?'", "'dhara ' || n || ' kya hai?'", "'sec. ' || n || ' punishment'", "'CrPC ' || n",
    "'What is a zero FIR?'", "'anticipatory bail in murder'", "'What is BNSS sec ' || n || '?'", "'Is section ' || n || ' cognizable'",
    "'organised crime and theft near thana'", "'What is the weather today?'",
)
QUESTIONS = (
    "select query_id, case t " + " ".join(f"when {i} then {q}" for i, q in enumerate(_TEMPLATES)) + " end as question, case when query_id % 21 = 0 then 'IPC' when query_id % 7 = 0 then 'BNS' end as source_filter "
    f"from (select o_orderkey as query_id, o_custkey % 16 as t, cast({_NUMBER} as string) as n, cast(o_custkey % 58 + 1 as string) as f from {{orders}}) x"
)
_KIND = "case when p_partkey < 40 and p_partkey % 10 = 9 then 't2' when p_partkey % 10 in (6, 7) then 't1' when p_partkey % 10 = 8 then 'fm' else 'sc' end"
CHUNKS = f"""
select p_partkey as chunk_id, case when p_size % 2 = 0 then 'BNS' else 'BNSS' end as source_pdf, cast(p_partkey % 150 + 1 as int) as page,
  case when k = 'sc' then 'IV' end as chapter_number, case when k = 'sc' then p_brand end as chapter_title,
  case when k = 'sc' and n % 3 = 0 then 'Of ' || p_type end as sub_part, case when k = 'sc' then cast(n as int) end as section_number,
  case when k = 'sc' and n % 5 > 0 then p_name end as section_title, case when k in ('sc', 'fm') then p_type || ' ' || p_name end as content,
  case when k = 'sc' and n = 2 then p_brand end as definition_term, case when k = 'sc' and n = 359 and p_size % 3 = 0 then '303(2)' end as compounding_section,
  case when k = 'sc' and n = 359 and p_size % 3 = 0 then p_name end as compounding_offence, case when k = 'sc' and n = 359 and p_size % 3 = 0 then 'with court permission' end as compounding_type,
  case when k in ('t1', 't2') then 'First Schedule' when k = 'fm' then 'Second Schedule' end as schedule,
  case k when 't1' then 'Table I — Offences' when 't2' then 'Table II — Other Laws' when 'fm' then 'Second Schedule — Legal Forms' end as tbl,
  case when k = 't1' then cast(n as string) || case when p_partkey % 4 = 0 then '' else '(' || cast(p_size % 3 + 1 as string) || ')' end end as bns_section,
  case when k = 't1' then p_name end as offence, case when k = 't1' then p_brand end as punishment, case when k = 't1' then 'Cognizable' end as cognizable,
  case when k = 't1' then 'Bailable' end as bailable, case when k = 't1' then p_type end as court, case when k = 't2' then 'If punishable with ' || p_name end as rule,
  case when k = 'fm' then cast(p_partkey % 58 + 1 as int) end as form_number, case when k = 'fm' then 'FORM No. ' || cast(p_partkey % 58 + 1 as string) end as form_title
from (select *, {_KIND} as k, p_partkey % 359 + 1 as n from {{part}}) x"""
HITS = """
select query_id, chunk_id, cast(min((chunk_id * 31 + query_id) % 997) as double) / 997 as distance
from (select o_orderkey as query_id, (o_orderkey * 7 + j * 131) % (select count(*) from {part}) + 1 as chunk_id
      from {orders} cross join (select 0 as j union all select 1 union all select 2 union all select 3 union all select 4) js
      where o_orderkey % 4 <> 3) x group by query_id, chunk_id"""
#: A line of a document with headings planted by its number.
_HEAD = "case when line_no % 12 = 0 then 'CHAPTER ' || substr('IVX', cast(line_no % 3 + 1 as int), 1) when line_no % 12 = 6 then {sub} || substr(lower(raw), 1, 60) when line_no % 3 = 2 then 'Note ' || cast(line_no % {most} + 1 as string) || '. (1) A' || raw else raw end"
PLANTED = {"BNS": _HEAD.format(sub="'Of '", most=358), "BNSS": _HEAD.format(sub="'B.—'", most=531)}
#: The same with a section of definitions and one of compounding rows in each document.
_WHOLE = """case when line_no = 3 then 'Meaning 2. Definitions ' || {a} || ' "act" denotes ' || raw || '; ' || {b} || ' "court" means ' || raw
  when line_no = 9 then 'Compounding 359.(1) The offences 115(2) The person hurt ' || substr(lower(raw), 1, 40) || ' (2) The offences punishable below 303, 12(1) The owner of it (3) When an offence is compoundable' else """
WHOLE = {"BNS": _WHOLE.format(a="'(1)'", b="'(2)'") + PLANTED["BNS"] + " end", "BNSS": _WHOLE.format(a="'(a)'", b="'(za)'") + PLANTED["BNSS"] + " end"}
FORM_LINE = "case when line_no % 7 = 3 then 'FORM No. ' || cast(line_no % 58 + 1 as string) else raw end"
WORDS = """
select l_orderkey as doc_id, cast(l_linenumber % 2 as int) as page, cast(792 as double) as page_height,
  case when j = 0 then cast(l_partkey % 350 + 1 as string) || case when l_suppkey % 2 = 0 then '(1)' else '' end else l_returnflag || l_linestatus || cast(j as string) end as text,
  cast(j * 97 + l_suppkey % 7 + case when l_linenumber % 3 = 2 and j = 0 then 95 else 0 end as double) as x0, cast(50 + l_linenumber * 24 + (l_partkey * (j + 1)) % 9 as double) as top
from {lineitem} cross join (select 0 as j union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) js"""


def _sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, QUESTIONS, "orders")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CHUNKS, "part").withColumnRenamed("tbl", "table")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are dealt by their key first, so their hits are grouped where they are made. An
    explicit number keeps partitions from being joined by size: few bytes become many rows."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.sql(HITS, part=table(spark, sf_dir, "part"), orders=table(spark, sf_dir, "orders").repartition(parts, "o_orderkey"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, WORDS, "lineitem")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "BNS").otherwise("BNSS").alias("source"), F.lit(1).alias("page"), "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_lines(pages(spark, sf_dir))


def with_vectors(spark: SparkSession, sf_dir: str, rows: DataFrame, id_col: str) -> DataFrame:
    """Rows with the vector that their id, modulo the number of vectors, stands for."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_at"), "embedding")
    return rows.withColumn("_at", F.col(id_col) % vectors.count()).join(vectors, "_at").drop("_at")


def in_duckdb(text: str, *tables: str) -> str:
    return text.format(**{t: t for t in tables})
