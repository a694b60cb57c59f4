"""Queries that build a corpus: lines, chunks, tables, splits, ids, index records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectionspark.functions import text as T
from sectionspark.operators import chunking as C
from sectionspark.operators import segmentation as G
from sectionspark.operators import split as X
from sectionspark.operators.corpus import build_corpus, index_records, stamp_ids, union_corpus
from sectionspark.operators.segmentation import split_joined_words, word_costs
from sectionspark.operators.wordtable import table_rows
from sectionspark.plans import derived as D
from sectionspark.plans.question_queries import _META
from sectionspark.sources.tables import page_range


def _planted(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    lines = D.lines(spark, sf_dir).where(F.col("source") == source)
    return lines.withColumn("raw", F.expr(D.PLANTED[source]))


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the pages in range (page ids stand for page numbers)."""
    pages = D.pages(spark, sf_dir).withColumn("page", (F.col("doc_id") % 250).cast("int") + 1)
    from sectionspark.sources.tables import read_lines as read

    ranges = spark.createDataFrame([("BNSS", 1, 157)], "source string, first int, last int")
    return page_range(read(pages), ranges).select("doc_id", "page", "line_no", "raw")


def scrub_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(F.col("line_no") % 9 == 4, F.concat(F.lit(" "), (F.col("line_no") % 500).cast("string"))).when(F.col("line_no") % 9 == 7, F.concat(F.lit("mgipmrnd "), "raw")).otherwise(F.col("raw"))
    lines = D.lines(spark, sf_dir).withColumn("line", T.scrub(marked)).where("line <> ''")
    return lines.select("doc_id", "line_no", "line")


def boundary_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose spaces before capitals and after commas were lost."""
    lost = F.regexp_replace(F.regexp_replace("raw", " ([A-Z])", "$1"), ", ", ",")
    return D.lines(spark, sf_dir).select("doc_id", "line_no", T.boundary_spacing(F.concat(lost, F.lit(" 12a(3)Ab;c––d"))).alias("fixed"))


def frequent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_costs(D.table(spark, sf_dir, "documents")).select("word", "n", "rank", F.round("cost", 6).alias("cost"))


def split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose spaces were lost, split again by the words of the corpus."""
    docs = D.table(spark, sf_dir, "documents")
    lines = D.lines(spark, sf_dir).withColumn("raw", F.regexp_replace("raw", "([a-z]) ([a-z]{2,4}) ", "$1$2 "))
    return split_joined_words(lines, word_costs(docs)).select("doc_id", "line_no", "fixed")


def heading_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1, T5, T6 on every planted line."""
    lines = [_planted(spark, sf_dir, source).withColumn("section", T.find_section(F.col("raw"), most)) for source, most in (("BNS", 358), ("BNSS", 531))]
    title = F.when(F.col("raw").rlike("^[A-Za-z ]+$"), T.title_case_if_upper(F.upper("raw")))
    return lines[0].union(lines[1]).select("doc_id", "line_no", "section", T.extract_title(F.col("raw"), F.col("section")).alias("title"), title.alias("title_case"))


def joined_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.table(spark, sf_dir, "documents")
    return docs.where(T.joined_run(F.col("text"))).select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[a-z]{20,}"), 0)).alias("runs"))


def _sections(spark: SparkSession, sf_dir: str, source: str, rules: C.HeadingRules) -> DataFrame:
    out = C.section_chunks(_planted(spark, sf_dir, source), rules)
    return out.select("doc_id", F.col("pos.line_no").alias("line_no"), "chapter_number", "chapter_title", "sub_part", "section_number", "section_title", "content")


def section_chunks_bns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir, "BNS", C.BNS)


def section_chunks_bnss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir, "BNSS", C.BNSS)


def form_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.form_chunks(D.lines(spark, sf_dir).withColumn("raw", F.expr(D.FORM_LINE)))
    return out.select("doc_id", F.col("pos.line_no").alias("line_no"), "form_number", "form_title", "content")


_RULE_TEXT = "case when doc_id % 3 = 0 then 'II.—CLASSIFICATION OF OFFENCES AGAINST OTHER LAWS' || chr(10) || 'Offence' || chr(10) when doc_id % 3 = 1 then 'Before' || chr(10) || 'II.—CLASSIFICATION OF OFFENCES AGAINST OTHER LAWS' || chr(10) else '' end || case when doc_id % 2 = 0 then replace(text, chr(10), chr(10) || 'If punishable with ') else text end"


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = D.pages(spark, sf_dir).withColumn("text", F.expr(_RULE_TEXT))
    return C.rule_rows(pages).select("doc_id", F.col("pos.line_no").alias("segment"), "rule")


def word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table_rows(D.words(spark, sf_dir))
    return out.select("doc_id", "page", F.col("pos.line_no").alias("row_no"), "bns_section", "offence", "punishment", "cognizable", "bailable", "court")


_DEFS = """select p_partkey as chunk_id, case when p_size % 2 = 0 then 'BNS' else 'BNSS' end as source_pdf, 2 as section_number, 'Definitions' as section_title,
  case when p_partkey % 11 = 0 then 'No definitions here' when p_size % 2 = 0 then 'In this Sanhita, ( 1)"' || p_brand || '" denotes ' || p_type || '; (2) "' || p_name || '" means ' || p_brand
  else 'In this Sanhita, (a) "' || p_brand || '" shall include ' || p_type || '; (za) "' || p_name || '" means ' || p_brand end as content from {part}"""
_ANCHORED = """select p_partkey as chunk_id, case when p_partkey % 3 = 0 then 'BNS' else 'BNSS' end as source_pdf, case when p_partkey % 2 = 0 then 359 else 7 end as section_number, p_brand as section_title,
  p_name || ' 303(2) The owner of ' || p_brand || ' 115(2), 117 The person hurt' || case when p_partkey % 7 = 0 then '' else ' (2) The offences punishable ' || p_type || ' 318 The person cheated' end || ' (3) When an offence is compoundable ' || p_brand as content from {part}"""


def split_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.split_definitions(D._sql(spark, sf_dir, _DEFS, "part"))
    return out.select("chunk_id", "part_no", "definition_term", "section_title", "content")


def split_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2, X3."""
    return X.apply_splitters(D._sql(spark, sf_dir, _ANCHORED, "part")).select("chunk_id", "part_no", "section_title", "content")


def compounding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4-X7, with the offences of the derived table rows."""
    parts = X.apply_splitters(D._sql(spark, sf_dir, _ANCHORED, "part").where("section_number = 359 and source_pdf = 'BNSS'"))
    table1 = D.chunks(spark, sf_dir).where("bns_section is not null").select("bns_section", "offence", F.struct("chunk_id").alias("pos"))
    out = X.compounding_chunks(parts, table1)
    return out.select("chunk_id", "part_no", "row_no", "compounding_section", "compounding_offence", "compounding_type", "content")


def corpus_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1, U2 over sections and forms of the planted lines."""
    sections = [C.section_chunks(_planted(spark, sf_dir, source), rules) for source, rules in (("BNS", C.BNS), ("BNSS", C.BNSS))]
    forms = C.form_chunks(D.lines(spark, sf_dir).withColumn("raw", F.expr(D.FORM_LINE)))
    out = stamp_ids(union_corpus([*sections, forms]), ["pos"])
    return out.select("chunk_id", "part_ord", "doc_id", F.col("pos.line_no").alias("line_no"), "section_number", "form_number")


def whole_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1, U2 and all that leads to them: the six kinds of chunks in one corpus, with ids."""
    lines = D.lines(spark, sf_dir)
    planted = lines.withColumn("raw", F.when(F.col("source") == "BNS", F.expr(D.WHOLE["BNS"])).otherwise(F.expr(D.WHOLE["BNSS"])))
    rules = D.pages(spark, sf_dir).withColumn("text", F.expr(_RULE_TEXT))
    corpus = build_corpus(planted, D.words(spark, sf_dir), rules, lines.withColumn("raw", F.expr(D.FORM_LINE)))
    text = F.coalesce("content", "rule", "offence").alias("text")
    return corpus.select("chunk_id", "part_ord", "doc_id", "part_no", "section_number", "section_title", "definition_term", "compounding_section", "compounding_offence", "bns_section", "form_number", text)


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3-U5."""
    out = index_records(D.chunks(spark, sf_dir))
    return out.select("chunk_id", "source_pdf", "page", "chunk_type", "section_number", "form_number", "sub_part", "section_title", "bns_section", F.col("table").alias("tbl"), "document")


QUERIES = (
    read_lines, scrub_lines, boundary_spacing, frequent_words, split_words, heading_fields, joined_runs, section_chunks_bns, section_chunks_bnss,
    form_chunks, rule_rows, word_table, split_definitions, split_anchors, compounding_rows, corpus_ids, whole_corpus, index_rows,
)

# ---- the same in SQL ----


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LINES = "lines as (select doc_id, case when doc_id % 2 = 0 then 'BNS' else 'BNSS' end as source, unnest(string_split(text, chr(10))) as raw, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int as line_no from documents)"
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _scrub(c: str) -> str:
    line = _TRIM.format(c)
    return f"case when regexp_matches({line}, {_q('(?i)' + T.JUNK_PATTERN)}) or regexp_matches({line}, '^[0-9]{{1,3}}$') then '' else {line} end"


def _spacing(c: str) -> str:
    for pattern, put in T.SPACING:
        c = f"regexp_replace({c}, {_q(pattern)}, {_q(put.format('', chr(92) + '1', chr(92) + '2'))}, 'g')"
    return c


def _section(c: str, most: int) -> str:
    pattern = rf"^(?:.{{0,{T.DEEPEST - 1}}}?[^0-9])??({T.number_range(most)}){T.AFTER_NUMBER}"
    return f"try_cast(regexp_extract({c}, {_q(pattern)}, 1) as int)"


def _title(line: str, section: str) -> str:
    before = f"regexp_extract({line}, '^((?:.*?[^0-9])??)' || {section} || '\\.', 1)"
    title = f"regexp_replace({_TRIM.format(before)}, '[.,;:]+$', '')"
    return f"case when length({title}) between 3 and 79 then {title} end"


def _chunks_sql(source: str, most: int, chapter: str, sub: str, planted: dict = D.PLANTED) -> str:
    return f"""with {_LINES}, planted as (select doc_id, line_no, {planted[source]} as raw from lines where source = '{source}'),
      kept as (select doc_id, line_no, {_scrub('raw')} as line from planted where {_scrub('raw')} <> ''),
      a as (select *, nullif(regexp_extract(line, {_q(chapter)}, 1), '') as chapter, {sub} as sub0, {_section('line', most)} as num0 from kept),
      b as (select *, coalesce(lag(chapter is not null) over (partition by doc_id order by line_no), false) and chapter is null as is_title from a),
      c as (select *, case when chapter is null and not is_title then sub0 end as sub from b),
      d as (select *, case when chapter is null and not is_title and sub is null then num0 end as num from c),
      e as (select *, sum((chapter is not null or sub is not null or num is not null)::int) over w as segment, last_value(chapter ignore nulls) over w as chapter_number,
        last_value(case when is_title then case when upper(line) = line and regexp_matches(line, '\\p{{L}}') then array_to_string(list_transform(string_split(line, ' '), lambda x: upper(x[1:1]) || lower(x[2:])), ' ') else line end when chapter is not null then '' end ignore nulls) over w as chapter_title,
        last_value(coalesce(sub, case when chapter is not null then '' end) ignore nulls) over w as sub_part from d window w as (partition by doc_id order by line_no rows unbounded preceding)),
      f as (select doc_id, segment, min_by((num, line, line_no, chapter_number, chapter_title, sub_part), line_no) as h, string_agg(line, ' ' order by line_no) as content from e where not is_title group by 1, 2)
      select doc_id, h[3] as line_no, h[4] as chapter_number, nullif(h[5], '') as chapter_title, nullif(h[6], '') as sub_part, h[1] as section_number, {_title('h[2]', 'h[1]')} as section_title, content
      from f where h[1] is not null and length(content) > 20"""


_BNS_SUB = r"case when regexp_matches(line, '^Of\s+[a-z]') and length(line) < 80 and not regexp_matches(line, 'section\s+\d|,\s+[a-z]{4}') then line end"
_BNSS_SUB = r"case when regexp_matches(line, '^([A-F])[.—\-]{1,2}\s*(.+)') and length(line) < 110 then regexp_extract(line, '^([A-F])[.—\-]{1,2}\s*(.+)', 1) || ' — ' || regexp_replace(regexp_extract(line, '^([A-F])[.—\-]{1,2}\s*(.+)', 2), '^\s+|\s+$', '', 'g') end"
_FORMS = f"""with {_LINES}, kept as (select doc_id, line_no, {_scrub('r')} as line from (select doc_id, line_no, {D.FORM_LINE} as r from lines) x where {_scrub('r')} <> ''),
  a as (select *, try_cast(regexp_extract(line, {_q(C.FORM_HEADING)}, 1) as int) as num from kept),
  b as (select *, sum((num is not null)::int) over (partition by doc_id order by line_no rows unbounded preceding) as segment from a),
  forms as (select doc_id, segment, max(case when num is not null then line_no end) as line_no, max(num) as form_number, max(case when num is not null then line end) as form_title,
    string_agg(case when num is null then line end, ' ' order by line_no) as content from b where segment > 0 group by 1, 2)"""
_BNS_SQL = _chunks_sql("BNS", 358, C.BNS.chapter, _BNS_SUB)
_BNSS_SQL = _chunks_sql("BNSS", 531, C.BNSS.chapter, _BNSS_SUB)
_MARKED = "case when line_no % 9 = 4 then ' ' || (line_no % 500) when line_no % 9 = 7 then 'mgipmrnd ' || raw else raw end"
_PART = D.in_duckdb
_OPEN = {s: p.replace("(?=", "(") for s, p in X.OPENER.items()}

SQL = {
    "read_lines": f"with {_LINES} select doc_id, (doc_id % 250 + 1)::int as page, line_no, raw from lines where source = 'BNS' or doc_id % 250 + 1 between 1 and 157",
    "scrub_lines": f"with {_LINES} select doc_id, line_no, {_scrub('m')} as line from (select doc_id, line_no, {_MARKED} as m from lines) x where {_scrub('m')} <> ''",
    "boundary_spacing": f"with {_LINES} select doc_id, line_no, {_spacing('t')} as fixed from (select doc_id, line_no, regexp_replace(regexp_replace(raw, ' ([A-Z])', '\\1', 'g'), ', ', ',', 'g') || ' 12a(3)Ab;c––d' as t from lines) x",
    "frequent_words": "select word, n, rank, round(ln(rank * ln(count(*) over () + 1.0)), 6) as cost from (select word, count(*) as n, row_number() over (order by count(*) desc, word) as rank from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) a group by word) b",
    "split_words": rf"""with recursive {_LINES}, joined as (select doc_id, line_no, regexp_replace(raw, '([a-z]) ([a-z]{{2,4}}) ', '\1\2 ', 'g') as line from lines),
      counted as (select word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) a group by word),
      costs as (select word, length(word) as len, ln(row_number() over (order by n desc, word) * ln(count(*) over () + 1.0)) as cost from counted),
      priced as (select word, len, round(cost * 1000000)::bigint as c from costs), lens as (select distinct len from costs),
      rest as (select round((max(cost) + ln(count(*) + 2) * 3) * 1000000)::bigint as u from costs),
      tokens as (select distinct unnest(string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ')) as token from (select distinct line from joined)),
      pieces as (select token, unnest(regexp_extract_all(token, {_q(f'[{G.MARKS}]|[^{G.MARKS}]+')})) as part, generate_subscripts(regexp_extract_all(token, {_q(f'[{G.MARKS}]|[^{G.MARKS}]+')}), 1) as n from tokens),
      kinds as (select *, upper(part) = part and lower(part) <> part and length(part) > 8 as capitals, substr(part, 2) = lower(substr(part, 2)) or regexp_matches(part, '[a-z]{{8,}}') as small from pieces),
      marked as (select *, case when length(part) >= 4 and regexp_matches(part, '^\p{{L}}+$') and lower(part) not in ({', '.join(map(_q, sorted(G.NO_SPLIT)))}) and (capitals or (upper(part) <> part and small)) then lower(part) end as run from kinds),
      runs as (select distinct run from marked where run is not null),
      ways as (select run, e, list({{'l': len, 'c': c}}) as w from (select run, len, unnest(range(len, length(run) + 1)) as e from runs join lens on len <= length(run)) x join priced p using (len) where substr(run, e - len + 1, len) = word group by 1, 2),
      dp as (select run, 0::bigint as e, [{{'c': 0::bigint, 's': 0::bigint, 'k': 1}}] as best from runs
        union all select d.run, d.e + 1, list_append(best, list_sort([{{'c': best[d.e + 1].c + u, 's': d.e, 'k': 0}}] || coalesce(list_transform(w, lambda x: {{'c': best[d.e + 2 - x.l].c + x.c, 's': d.e + 1 - x.l, 'k': 1}}), []))[1])
        from dp d cross join rest left join ways on ways.run = d.run and ways.e = d.e + 1 where d.e < length(d.run)),
      walk as (select run, best, e as pos, false as au, []::bigint[] as cuts from dp where e = length(run)
        union all select run, best, best[pos + 1].s, best[pos + 1].k = 0, case when best[pos + 1].k = 0 and au then cuts else [pos] || cuts end from walk where pos > 0),
      split as (select run, list_transform(cuts, lambda c, i: substr(run, case when i = 1 then 1 else cuts[i - 1] + 1 end, case when i = 1 then c else c - cuts[i - 1] end)) as words from walk where pos = 0),
      written as (select token, n, case when run is null then part else array_to_string(list_transform(words, lambda w, i: case when capitals or (i = 1 and upper(part[1:1]) = part[1:1]) then upper(w[1:1]) || lower(w[2:]) else w end), ' ') end as text, regexp_matches(part, {_q(f'^[{G.MARKS}]$')}) and n > 1 as glued from marked left join split using (run)),
      fixed as (select token, ltrim(string_agg(case when glued then text else ' ' || text end, '' order by n)) as fixed from written group by 1),
      flat as (select line, unnest(string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ')) as token, generate_subscripts(string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' '), 1) as pos from (select distinct line from joined)),
      done as (select line, string_agg(fixed, ' ' order by pos) as fixed from flat join fixed using (token) group by 1)
      select doc_id, line_no, case when line is not null then coalesce(done.fixed, '') end as fixed from joined left join done using (line)""",
    "heading_fields": f"""with {_LINES}, planted as (select doc_id, line_no, {D.PLANTED['BNS']} as raw, true as bns from lines where source = 'BNS' union all select doc_id, line_no, {D.PLANTED['BNSS']}, false from lines where source = 'BNSS'),
      a as (select *, case when bns then {_section('raw', 358)} else {_section('raw', 531)} end as section, upper(raw) as u from planted)
      select doc_id, line_no, section, {_title('raw', 'section')} as title, case when regexp_matches(raw, '^[A-Za-z ]+$') then array_to_string(list_transform(string_split(u, ' '), lambda x: upper(x[1:1]) || lower(x[2:])), ' ') end as title_case from a""",
    "joined_runs": "select doc_id, len(regexp_extract_all(text, '[a-z]{20,}')) as runs from documents where regexp_matches(text, '[a-z]{20,}')",
    "section_chunks_bns": _BNS_SQL,
    "section_chunks_bnss": _BNSS_SQL,
    "form_chunks": _FORMS + r" select doc_id, line_no, form_number, form_title, content from forms where regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') <> ''",
    "rule_rows": f"""with pages as (select doc_id, {_RULE_TEXT} as text from documents), blocks as (select doc_id, substr(text, instr(text, {_q(C.RULE_MARK)})) as block from pages where instr(text, {_q(C.RULE_MARK)}) > 0),
      l as (select doc_id, {_TRIM.format('raw')} as line, line_no from (select doc_id, unnest(string_split(block, chr(10))) as raw, generate_subscripts(string_split(block, chr(10)), 1) as line_no from blocks) x),
      k as (select *, sum(starts_with(line, 'If punishable')::int) over (partition by doc_id order by line_no rows unbounded preceding) as segment from l where line <> '' and line not in ({', '.join(map(_q, C.RULE_LABELS))}) and not starts_with(line, 'II.')),
      r as (select doc_id, segment::int as segment, string_agg(line, ' ' order by line_no) as rule from k where segment > 0 group by 1, 2)
      select * from r union all select doc_id, 0, {_TRIM.format('block')} from blocks where doc_id not in (select doc_id from r)""",
    "split_definitions": f"""with d as ({_PART(_DEFS, 'part')}), s as (select *, case when source_pdf = 'BNS' then regexp_replace(content, {_q(_OPEN['BNS'])}, chr(1) || '\\1', 'g') else regexp_replace(content, {_q(_OPEN['BNSS'])}, chr(1) || '\\1', 'g') end as cut from d),
      p as (select *, list_filter(list_transform(string_split(cut, chr(1)), lambda x: {_TRIM.format('x')}), lambda x: x <> '') as parts from s),
      g as (select *, list_filter(parts, lambda x: regexp_matches(x, '^\\(\\s*[0-9a-z]')) as good, len(parts) > 1 as many from p),
      u as (select chunk_id, many and len(good) > 0 as is_cut, section_title as t, unnest(case when many and len(good) > 0 then good else [content] end) as content, generate_subscripts(case when many and len(good) > 0 then good else [content] end, 1) - 1 as part_no from g),
      v as (select *, case when is_cut then nullif({_TRIM.format(f"regexp_extract(content, {_q(X.TERM)}, 1)")}, '') end as definition_term from u)
      select chunk_id, part_no, definition_term, case when not is_cut then t when definition_term is null then 'Definitions' else 'Definition of "' || definition_term || '"' end as section_title, content from v""",
    "corpus_ids": f"""with s as ({_BNS_SQL}), t as ({_BNSS_SQL}), f as ({_FORMS} select * from forms where coalesce(content, '') <> ''),
      u as (select 0 as part_ord, doc_id, line_no, section_number, null::int as form_number from s union all select 1, doc_id, line_no, section_number, null from t union all select 2, doc_id, line_no, null, form_number from f)
      select row_number() over (order by part_ord, doc_id, line_no) as chunk_id, * from u""",
}
_THREE = f"""cut as (select *, regexp_extract(content, {_q('^((?s).*?)' + X.ANCHORS[0])}, 1) as one, regexp_extract(content, {_q('((?s)' + X.ANCHORS[0] + '.*?)' + X.ANCHORS[1])}, 1) as two, regexp_extract(content, {_q('((?s)' + X.ANCHORS[1] + '.*)$')}, 1) as three from d),
  parts as (select chunk_id, section_title as t, case when section_number = 359 and source_pdf = 'BNSS' and two <> '' and three <> '' then [{_TRIM.format('one')}, {_TRIM.format('two')}, {_TRIM.format('three')}] else [content] end as list from cut),
  flat as (select chunk_id, t, len(list) as n, unnest(list) as content, generate_subscripts(list, 1) - 1 as part_no from parts),
  titled as (select chunk_id, part_no, case when n = 1 then t else [{', '.join(map(_q, X.PARTS))}][part_no + 1] end as section_title, content from flat)"""
SQL["split_anchors"] = f"with d as ({_PART(_ANCHORED, 'part')}), {_THREE} select * from titled"
SQL["index_rows"] = f"""with chunks as ({_PART(D.CHUNKS, 'part')}), {_META}
  select chunk_id, source_pdf, page, ct as chunk_type, coalesce(section_number, -1) as section_number, coalesce(form_number, -1) as form_number, coalesce(sub_part, '') as sub_part, coalesce(section_title, '') as section_title, coalesce(bns_section, '') as bns_section,
    case ct when 'table1' then 'Table I' when 'table2' then 'Table II' else '' end as tbl, document from meta"""
# a row of the compounding table ends where the next one starts: references are marked, then cut
SQL["compounding_rows"] = rf"""with d as (select * from ({_PART(_ANCHORED, 'part')}) x where section_number = 359 and source_pdf = 'BNSS'), {_THREE},
  cutup as (select *, string_split(regexp_replace(content, {_q('(' + X.REFS + r')\s+The\s+')}, chr(1) || '\1' || chr(2), 'g'), chr(1))[2:] as rows_ from titled where not contains(section_title, 'Procedural')),
  r as (select chunk_id, part_no, section_title, unnest(rows_) as x, generate_subscripts(rows_, 1) - 1 as row_no from cutup),
  m as (select chunk_id, part_no, row_no, string_split(x, chr(2))[1] as compounding_section, left('The ' || {_TRIM.format("string_split(x, chr(2))[2]")}, 150) as person, case when contains(section_title, 'With Court') then 'with court permission' else 'without court permission' end as compounding_type from r),
  t1 as (select chunk_id as pos, bns_section as ref, left(offence, 70) as name, regexp_extract(bns_section, '^([0-9]{{1,3}})', 1) as base from ({_PART(D.CHUNKS, 'part')}) c where bns_section is not null),
  fulls as (select ref, max_by(name, pos) as name from t1 group by 1), bases as (select base, coalesce(max_by(name, pos) filter (ref = base), min_by(name, pos)) as name from t1 group by 1),
  o as (select m.*, coalesce(f.name, b.name, 'offence') as compounding_offence from m left join fulls f on f.ref = compounding_section left join bases b on b.base = regexp_extract(compounding_section, '^([0-9]{{1,3}})', 1))
  select chunk_id, part_no, row_no, compounding_section, compounding_offence, compounding_type, 'BNS Section ' || compounding_section || ' (' || compounding_offence || ') can be compounded ' || compounding_type || '. Compounded by: ' || person as content from o"""
# lines of a page: a recursive walk from anchor to anchor
SQL["word_table"] = rf"""with recursive words as ({_PART(D.WORDS, 'lineitem')}), w as (select *, round_even(top / 6, 0)::int as y from words where top > 60 and top < page_height - 40),
  anchors as (select doc_id, page, min(y) as line from w group by 1, 2 union all select a.doc_id, a.page, (select min(y) from w where w.doc_id = a.doc_id and w.page = a.page and w.y > a.line + 1) from anchors a where a.line is not null),
  c as (select w.*, a.line, case when x0 < 93 then 0 when x0 < 192 then 1 when x0 < 285 then 2 when x0 < 369 then 3 when x0 < 453 then 4 else 5 end as col from w join anchors a on w.doc_id = a.doc_id and w.page = a.page and w.y in (a.line, a.line + 1)),
  f as (select doc_id, page, line, min((y, x0, text)) as f from c group by 1, 2, 3),
  s as (select *, sum((f[2] < 93 and regexp_matches(trim(f[3]), '^\d{{1,3}}(\([a-z0-9]+\))?$'))::int) over (partition by doc_id, page order by line rows unbounded preceding)::int as row_no
    from f where trim(f[3]) not in ('1', 'Section', 'Offence', 'Punishment', 'Cognizable', 'Bailable', 'Court', 'cognizable', 'bailable', 'triable', 'THE', 'CLASSIFICATION', 'EXPLANATORY', 'I.')),
  g as (select c.doc_id, c.page, s.row_no, {', '.join(f"coalesce(string_agg(c.text, ' ' order by c.line, c.y, c.x0, c.text) filter (c.col = {i}), '') as {n}" for i, n in enumerate(('bns_section', 'offence', 'punishment', 'cognizable', 'bailable', 'court')))} from c join s on c.doc_id = s.doc_id and c.page = s.page and c.line = s.line group by 1, 2, 3)
  select * from g where regexp_matches(bns_section, '^\d')"""

# all six kinds: sections, split as above, compounding rows, the word table, rules, forms
_KEYED = "select (part_ord, doc_id, line_no) as chunk_id, source_pdf, section_number, section_title, content from sec where "
_TABLE1 = "select doc_id * 1000000 + page * 10000 + row_no as chunk_id, bns_section, offence from t1rows where offence <> ''"
_ROW = "{} as part_ord, {} as doc_id, {} as page, {} as line_no, {}::int as part_no, {} as row_no, {}::int as section_number, {}::varchar as section_title, {}::varchar as definition_term, {}::varchar as compounding_section, {}::varchar as compounding_offence, {}::varchar as bns_section, {}::int as form_number, {} as text"
_OF_KEY = ("chunk_id[1]", "chunk_id[2]", 1, "chunk_id[3]")
SQL["whole_corpus"] = f"""with bns as ({_chunks_sql("BNS", 358, C.BNS.chapter, _BNS_SUB, D.WHOLE)}), bnss as ({_chunks_sql("BNSS", 531, C.BNSS.chapter, _BNSS_SUB, D.WHOLE)}),
  sec as (select 0 as part_ord, 'BNS' as source_pdf, * from bns union all select 1, 'BNSS', * from bnss), t1rows as ({SQL["word_table"]}),
  defs as ({SQL["split_definitions"].replace(_PART(_DEFS, "part"), _KEYED + "section_number = 2")}),
  big as ({SQL["split_anchors"].replace(_PART(_ANCHORED, "part"), _KEYED + "section_number = 359 and source_pdf = 'BNSS'")}),
  micro as ({SQL["compounding_rows"].replace(_PART(_ANCHORED, "part"), _KEYED + "section_number = 359 and source_pdf = 'BNSS'").replace(_PART(D.CHUNKS, "part"), _TABLE1)}),
  rules as ({SQL["rule_rows"]}), forms as ({SQL["form_chunks"]}),
  u as (select {_ROW.format("part_ord", "doc_id", 1, "line_no", 0, "null", "section_number", "section_title", "null", "null", "null", "null", "null", "content")} from sec where not (section_number = 2 or section_number = 359 and source_pdf = 'BNSS')
    union all select {_ROW.format(*_OF_KEY, "part_no", "null", 2, "section_title", "definition_term", "null", "null", "null", "null", "content")} from defs
    union all select {_ROW.format(*_OF_KEY, "part_no", "null", 359, "section_title", "null", "null", "null", "null", "null", "content")} from big
    union all select {_ROW.format(2, *_OF_KEY[1:], "part_no", "row_no", 359, "'Compounding — BNS Section ' || compounding_section", "null", "compounding_section", "compounding_offence", "null", "null", "content")} from micro
    union all select {_ROW.format(3, "doc_id", "page", "row_no", "null", "null", "null", "null", "null", "null", "null", "bns_section", "null", "offence")} from t1rows
    union all select {_ROW.format(4, "doc_id", 1, "segment", "null", "null", "null", "null", "null", "null", "null", "null", "null", "rule")} from rules
    union all select {_ROW.format(5, "doc_id", 1, "line_no", "null", "null", "null", "null", "null", "null", "null", "null", "form_number", "content")} from forms)
  select row_number() over (order by part_ord, doc_id, page, line_no, part_no, row_no) as chunk_id, * exclude (page, line_no, row_no) from u"""
