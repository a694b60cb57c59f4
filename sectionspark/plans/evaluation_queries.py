"""Queries that check answers and corpora, and write and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectionspark.operators import evaluate as E
from sectionspark.operators import sketches as H
from sectionspark.operators.corpus import index_records
from sectionspark.plans import derived as D
from sectionspark.sources.tables import write_report
from sectionspark.sources.workspace import new_path

_CASES = """select d.doc_id as case_id, d.source as category, d.lang as style, case when d.doc_id % 13 = 0 then 'Could not generate an answer' when d.doc_id % 11 = 0 then substr(text, 1, 15) else text end as answer,
  case when d.doc_id % 3 = 0 then 'the' when l.quality = 1 then 'Er' else 'zzz' end as k1, case when d.doc_id % 5 = 0 then 'LES' else 'e' end as k2 from {documents} d join {labels} l on d.doc_id = l.doc_id"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D._sql(spark, sf_dir, _CASES, "documents", "labels").withColumn("keywords", F.array("k1", "k2"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = D.chunks(spark, sf_dir)
    return chunks.join(index_records(chunks).select("chunk_id", "chunk_type"), "chunk_id")


def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.check_answers(_cases(spark, sf_dir)).select("case_id", "passed", "reason")


def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.score_by(E.check_answers(_cases(spark, sf_dir)), "category")


def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores by category, written as a JSON report and read back."""
    scores = category_scores(spark, sf_dir)
    path = new_path(spark, "report")
    write_report(scores, path)
    return spark.read.schema(scores.schema).json(path)


def path_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.score_by(E.check_answers(_cases(spark, sf_dir), least=30), "style")


def hits_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: the section of every question's chunk among its hits by distance."""
    from pyspark.sql import Window

    index = index_records(D.chunks(spark, sf_dir)).select("chunk_id", F.col("source_pdf").alias("source"), F.col("section_number").alias("section"))
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    hits = D.hits(spark, sf_dir).withColumn("rank", F.row_number().over(order)).join(index, "chunk_id")
    wanted = D.questions(spark, sf_dir).select("query_id", F.lit("BNS").alias("source"), (F.col("query_id") * 7 % 359 + 2).cast("string").alias("section"), F.lit(10).alias("k"))
    return E.hit_at_k(hits, wanted)


def sections_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.section_counts(D.chunks(spark, sf_dir))


def corpus_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.range_checks(_typed(spark, sf_dir))


def corpus_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.field_checks(_typed(spark, sf_dir))


def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9 over the suppliers' parts, an id that does repeat."""
    return E.duplicate_ids(D.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("chunk_id")))


_WANTED = "select distinct case when p_size % 2 = 0 then 'BNS' else 'BNSS' end as source_pdf, cast(p_partkey % 400 + 1 as int) as section_number, lower(substr(p_type, 1, 5)) as keyword from {part}"


def section_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sections_with_keyword(D.chunks(spark, sf_dir), D._sql(spark, sf_dir, _WANTED, "part"))


def sections_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = D._sql(spark, sf_dir, _WANTED, "part").select("source_pdf", F.col("section_number").cast("string").alias("section")).distinct()
    return E.absent_sections(_typed(spark, sf_dir), wanted)


def covered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.coverage(_typed(spark, sf_dir))


def coverage_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.generated_questions(E.coverage(_typed(spark, sf_dir)))


def sketched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6 and E12 by sketches beside the corpus: three loads of chunks, the second of them written
    again, merged and held against exact counts; error is what the sketches promise."""
    chunks, path = _typed(spark, sf_dir), new_path(spark, "sketches")
    for load in (0, 1, 2, 1):
        H.write_sketches(chunks.where(F.col("chunk_id") % 3 == load), path, F.lit(f"load-{load}"))
    return H.counts_compared(chunks, H.read_sketches(spark, path)).withColumn("error", F.lit(round(H.relative_error(), 4)))


QUERIES = (answer_checks, category_scores, written_report, path_scores, hits_at_10, sections_by_source, corpus_ranges, corpus_fields, repeated_ids, section_keywords, sections_absent, covered_keys, coverage_questions, sketched_keys)

# ---- the same in SQL ----

_B = f"with chunks as (select *, case when section_number is not null then 'section' when tbl like 'Table II%' then 'table2' when tbl like 'Table I%' then 'table1' else 'form' end as ct from ({D.in_duckdb(D.CHUNKS, 'part')}) c)"


def _checked(least: int) -> str:
    return f"""checked as (select *, reason = '' as passed from (select *, case when contains(lower(answer), 'could not generate') then 'blocked' when length(answer) < {least} then 'too short'
      when len(m) > 0 then 'missing: ' || array_to_string(m, ', ') else '' end as reason from (select *, list_filter([k1, k2], lambda k: not contains(lower(answer), lower(k))) as m from ({D.in_duckdb(_CASES, 'documents', 'labels')}) a) b) c)"""


def _scores(column: str, least: int) -> str:
    return f"""with {_checked(least)}, s as (select {column}, sum(passed::int)::bigint as passed, count(*) as total from checked group by rollup ({column})), p as (select *, (passed * 100 // total)::bigint as percent from s)
      select *, case when percent >= 80 then 'good' when percent >= 60 then 'fair' else 'poor' end as band from p"""


_COVER = """cov as (select distinct * from (select 'section' as path, source_pdf, section_number::varchar as key from chunks where ct = 'section' and definition_term is null and compounding_section is null
  union all select 'table1', source_pdf, split_part(bns_section, '(', 1) from chunks where ct = 'table1' and regexp_matches(split_part(bns_section, '(', 1), '^[0-9]+$')
  union all select 'definition', source_pdf, definition_term from chunks where definition_term is not null) u)"""
_W = D.in_duckdb(_WANTED, "part")

SQL = {
    "answer_checks": f"with {_checked(20)} select case_id, passed, reason from checked",
    "category_scores": _scores("category", 20),
    "written_report": _scores("category", 20),
    "path_scores": _scores("style", 30),
    "hits_at_10": f"""{_B}, questions as ({D.in_duckdb(D.QUESTIONS, 'orders')}), hits as ({D.in_duckdb(D.HITS, 'part', 'orders')}), h as (select *, row_number() over (partition by query_id order by distance, chunk_id) as rank from hits join chunks using (chunk_id))
      select q.query_id, max(case when source_pdf = 'BNS' and section_number = q.query_id * 7 % 359 + 2 and rank <= 10 then 1 else 0 end) as hit from questions q left join h using (query_id) group by 1""",
    "sections_by_source": f"{_B} select source_pdf, count(distinct section_number) as sections from chunks where section_number is not null group by 1",
    "corpus_ranges": f"{_B} select count(*) as total, count(*) filter (ct = 'table1') as table1_rows, min(section_number) as least_section, max(section_number) as greatest_section, count(*) filter (section_number < 1 or section_number > 358) as out_of_range from chunks",
    "corpus_fields": f"{_B} select count(*) filter (source_pdf is null) as no_source, count(*) filter (source_pdf not in ('BNS', 'BNSS')) as bad_source, {', '.join(f'''count(*) filter (ct = 'table1' and {n} is null) as no_{n}''' for n in ('bns_section', 'offence', 'punishment', 'cognizable', 'bailable'))}, count(*) filter (ct = 'section' and trim(coalesce(content, '')) = '') as blank_content from chunks",
    "repeated_ids": "select l_partkey as chunk_id, count(*) as n from lineitem group by 1 having count(*) > 1",
    "section_keywords": f"{_B}, w as ({_W}) select w.source_pdf, w.section_number, keyword, max(coalesce(contains(lower(content), keyword), false)) as found from w left join chunks c on c.source_pdf = w.source_pdf and c.section_number = w.section_number group by 1, 2, 3",
    "sections_absent": f"{_B}, w as (select distinct source_pdf, section_number::varchar as section from ({_W}) x) select * from w where (source_pdf, section) not in (select source_pdf, section_number::varchar from chunks where section_number is not null union all select source_pdf, split_part(bns_section, '(', 1) from chunks where ct = 'table1')",
    "covered_keys": f"{_B}, {_COVER} select * from cov",
    "sketched_keys": f"""{_B}, keys as (select 'any section' as path, source_pdf, section_number::varchar as key from chunks union all select path, source_pdf, key from ({_B}, {_COVER} select * from cov) c
      union all select 'content', source_pdf, content from chunks) select path, source_pdf, count(distinct key) as exact, true as within, 0.0487::double as error from keys where key is not null group by 1, 2""",
    "coverage_questions": f"""{_B}, {_COVER} select path, case path when 'section' then 'What is ' || source_pdf || ' Section ' || key || '?' when 'table1' then 'Is BNS Section ' || key || ' cognizable and bailable?' else 'What is the definition of "' || key || '" under ' || source_pdf || '?' end as question,
      case when path = 'definition' then lower(split_part(key, ' ', 1)) else '' end as keyword from cov union all select * from (values {', '.join(map(str, E.fixed_questions()))}) v""",
}
