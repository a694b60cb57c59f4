"""Queries over tables of questions: expansion, intent, pins, candidates, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectionspark.functions import questions as Q
from sectionspark.functions.labels import citation
from sectionspark.functions.rules import FAMOUS, RULES
from sectionspark.operators import rank as R
from sectionspark.operators.answer import answer_batch, expanded, top_candidates
from sectionspark.operators.corpus import build_index, index_records, update_index
from sectionspark.operators.retrieve import merged, pins, with_intent
from sectionspark.operators.search import NO_HIT, cosine_topk, embed_batches, similarity_percent
from sectionspark.plans import derived as D
from sectionspark.sources.tables import read_chunks, write_chunks
from sectionspark.sources.workspace import new_path, stored


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_records(D.chunks(spark, sf_dir))


def _top(spark: SparkSession, sf_dir: str, keep_k: int = 5) -> DataFrame:
    """The top candidates with question, query_used and the index's columns."""
    return top_candidates(stored(expanded(D.questions(spark, sf_dir)), "expanded"), _index(spark, sf_dir), D.hits(spark, sf_dir), keep_k)


def section_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: question, expansion and the citation of its primary pin."""
    asked, index, hits = D.questions(spark, sf_dir), _index(spark, sf_dir), D.hits(spark, sf_dir)
    pinned = pins(with_intent(asked, once=True), index, hits).where("pin = 'primary'")
    out = stored(expanded(asked), "expanded").join(pinned, "query_id").join(index, "chunk_id")
    return out.select("query_id", "question", "query_used", "chunk_id", citation().alias("citation"))


def expand_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = D.table(spark, sf_dir, "conversations").where("role = 'user'").select((-F.col("conv_id") * 1000 - F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    both = D.questions(spark, sf_dir).select("query_id", "question").union(turns)
    return expanded(both).select("query_id", "query_used")


def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_intent(D.questions(spark, sf_dir))
    return out.select("query_id", "form_number", "section_source", "section_number", F.concat_ws(",", "sources").alias("sources"), "famous", "bail")


def pinned_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pins(with_intent(D.questions(spark, sf_dir), once=True), _index(spark, sf_dir), D.hits(spark, sf_dir)).select("query_id", "chunk_id", "pin")


def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, index, hits = D.questions(spark, sf_dir), _index(spark, sf_dir), D.hits(spark, sf_dir)
    return merged(with_intent(asked, once=True), index, hits)


def reranked_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).select("query_id", "rank", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.citations(_top(spark, sf_dir)).select("query_id", F.array_join("citations", " | ").alias("citations"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.prompts(_top(spark, sf_dir)).select("query_id", "context", "prompt")


def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R11 on vectors of the embeddings table: a record for every question, with hits of its
    source filter or without."""
    index = D.with_vectors(spark, sf_dir, _index(spark, sf_dir), "chunk_id")
    out = answer_batch(D.questions(spark, sf_dir), index, fetch_k=6, encode=lambda asked: D.with_vectors(spark, sf_dir, asked, "query_id"))
    ids = F.transform("chunks_used", lambda c: c["chunk_id"].cast("string"))
    return out.select("query_id", "answer", F.array_join("citations", " | ").alias("citations"), F.coalesce(F.array_join(ids, ","), F.lit("")).alias("chunks"), "query_used")


#: A corpus after a change: one section is amended.
_AMENDED = "case when chunk_id = 1 then content || ' (amended)' else content end"


def written_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus is written and read back, its records are written with vectors of
    the embeddings table and counted; then a chunk changes, and the index is brought up to date."""
    path = new_path(spark, "index")
    vectors = lambda records: D.with_vectors(spark, sf_dir, records, "chunk_id")
    write_chunks(D.chunks(spark, sf_dir), f"{path}-chunks")
    n = build_index(read_chunks(spark, f"{path}-chunks"), path, vectors)
    changed = update_index(read_chunks(spark, f"{path}-chunks").withColumn("content", F.expr(_AMENDED)), path, vectors)
    folders = spark.read.parquet(path).groupBy("source_pdf", "chunk_type").agg(
        F.count("*").alias("n"), F.sum(F.length("document")).alias("letters"), F.min("chunk_id").alias("first"),
        F.round(F.sum(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x))), 3).alias("sizes"),
    )
    named = spark.createDataFrame(changed, "source_pdf string, chunk_type string").withColumn("rewritten", F.lit(True))
    return folders.join(named, ["source_pdf", "chunk_type"], "left").withColumns({"rewritten": F.coalesce("rewritten", F.lit(False)), "written": F.lit(n).cast("bigint")})


def cosine_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = cosine_topk(asked, rows.select(F.col("vec_id").alias("chunk_id"), "embedding"), 20)
    return got.select("query_id", "rank", "chunk_id", F.round("distance", 6).alias("distance"))


def cosine_top10_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.when(F.col("vec_id") % 20 == 0, F.col("label").cast("string")).alias("source_filter"))
    got = cosine_topk(asked, rows.select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("string").alias("source")), 10)
    return got.select("query_id", "rank", "chunk_id", similarity_percent(F.round("distance", 6)).alias("percent"))


def encoded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 and V2 together: the index and the distinct expanded questions are encoded."""
    index = embed_batches(_index(spark, sf_dir).select("chunk_id", "document"))
    asked = D.questions(spark, sf_dir).groupBy(Q.expand(F.col("question")).alias("document")).agg(F.min("query_id").alias("query_id"))
    return cosine_topk(embed_batches(asked.select("query_id", "document")), index, 20).select("query_id", "rank", "chunk_id", F.round("distance", 6).alias("distance"))


QUERIES = (section_answers, expand_questions, question_intents, pinned_chunks, merged_candidates, reranked_top, citations, prompts, batch_answers, written_index, cosine_top20, cosine_top10_filtered, encoded_search)

# ---- the same in SQL ----

_T = ("orders", "part", "conversations")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _expansion(q: str) -> str:
    """A list of additions in rule order; first ones are kept."""
    parts = []
    for pattern, words in RULES:
        found = _quoted(f"(?i){pattern}")
        if "{1}" in words:
            parts.append(f"list_transform(regexp_extract_all({q}, {found}, 1), lambda n: {_quoted(words.replace('{1}', ''))} || n)")
        else:
            parts.append(f"case when regexp_matches({q}, {found}) then [{_quoted(words)}] else [] end")
    return f"flatten([{', '.join(parts)}])"


def _expanded(source: str) -> str:
    first = "list_filter(list_transform(l, lambda x, i: case when list_position(l, x) = i then x end), lambda x: x is not null)"
    return f"(select query_id, question, case when len(l) = 0 then question else question || ' ' || list_aggregate({first}, 'string_agg', ' ') end as query_used from (select query_id, question, {_expansion('question')} as l from {source}) e)"


_FAMOUS = " ".join(f"when {a} then {b}" for a, b in FAMOUS.items())
_S1, _S2 = (f"regexp_extract(question, {_quoted(Q.SECTION_WITH_SOURCE)}, {g})" for g in (1, 2))
_INTENTS = f"""
intents as (select *, case when section_source <> '' then section_source when section_number is not null then 'BNS,BNSS' else '' end as sources,
    case when section_source = '' and m <> section_number then m end as famous from (
  select *, case section_number {_FAMOUS} end as m from (
    select query_id, question, try_cast(regexp_extract(question, {_quoted(Q.FORM)}, 1) as int) as form_number, upper({_S1}) as section_source,
      coalesce(try_cast(regexp_extract({_S2}, '^([0-9]+)', 1) as int), try_cast(regexp_extract(regexp_extract(question, {_quoted(Q.BARE_SECTION)}, 1), '^([0-9]+)', 1) as int)) as section_number,
      regexp_matches(question, {_quoted(Q.BAIL)}) as bail from questions) a) b)"""
_META = """
meta as (select *, coalesce(case ct when 'section' then section_title end, '') as title, case ct
    when 'section' then source_pdf || ' Section ' || section_number || case when coalesce(section_title, '') <> '' then ' — ' || section_title else '' end
    when 'table1' then source_pdf || ' First Schedule Table I — Section ' || bns_section when 'table2' then source_pdf || ' First Schedule Table II'
    else source_pdf || ' Second Schedule Form ' || form_number || ' — ' || form_title end as citation,
  case when ct = 'section' and definition_term is not null then '[' || source_pdf || ' Section ' || section_number || '] Definition of "' || definition_term || '"' || chr(10) || source_pdf || ' defines "' || definition_term || '" as follows: ' || content
    when ct = 'section' and source_pdf = 'BNSS' and section_number = 359 and compounding_section is not null then '[BNSS Section 359 — Compounding] ' || content
    when ct = 'section' and source_pdf = 'BNSS' and section_number = 359 then '[BNSS Section 359] ' || coalesce(section_title, '') || chr(10) || content
    when ct = 'section' then '[' || source_pdf || '] Chapter ' || chapter_number || ' — ' || chapter_title || case when sub_part is not null then ' | ' || sub_part else '' end || chr(10) || 'Section ' || section_number || case when section_title is not null then ' — ' || section_title else '' end || chr(10) || content
    when ct = 'table2' then '[BNSS First Schedule Table II] ' || rule
    when ct = 'table1' then '[BNS First Schedule Table I] Section ' || bns_section || ': ' || offence || '. Punishment: ' || punishment || '. Cognizable: ' || cognizable || '. Bailable: ' || bailable || '. Court: ' || court || '.'
    else '[BNSS Second Schedule Form ' || form_number || '] ' || form_title || chr(10) || content end as document
  from (select *, case when section_number is not null then 'section' when tbl like 'Table II%' then 'table2' when tbl like 'Table I%' then 'table1' when schedule = 'Second Schedule' then 'form' else 'unknown' end as ct from chunks) c)"""
_BASE = f"with questions as ({D.in_duckdb(D.QUESTIONS, *_T)}), chunks as ({D.in_duckdb(D.CHUNKS, *_T)}), hits as ({D.in_duckdb(D.HITS, *_T)}), {_INTENTS}, {_META}"
_PINS = _BASE + """,
asked as (select * from intents where query_id in (select query_id from hits)),
sections as (select source_pdf, section_number, min(chunk_id) as chunk_id from meta where ct = 'section' group by 1, 2),
formpins as (select query_id, (select min(chunk_id) from meta where ct = 'form' and meta.form_number = asked.form_number) as chunk_id from asked),
rest as (select * from asked where section_number is not null and query_id in (select query_id from formpins where chunk_id is null)),
looked as (select query_id, 0 as ord, 'BNS' as s, famous as n from rest where famous is not null
  union all select query_id, 1, 'BNS', section_number from rest where sources in ('BNS', 'BNS,BNSS') union all select query_id, 3, 'BNSS', section_number from rest where sources in ('BNSS', 'BNS,BNSS')),
found as (select query_id, chunk_id, ord, row_number() over (partition by query_id order by ord) as k from looked join sections on s = source_pdf and n = sections.section_number),
prim as (select query_id, chunk_id, 'primary' as pin, ord from found where k = 1 union all select query_id, chunk_id, 'primary', 0 from formpins where chunk_id is not null),
more as (select query_id, chunk_id, 'secondary' as pin, ord from found where k > 1
  union all select query_id, chunk_id, 'secondary', 2 from rest join meta on ct = 'table1' and (meta.bns_section = rest.section_number::varchar or starts_with(meta.bns_section, rest.section_number || '(')) where bail and sources in ('BNS', 'BNS,BNSS')
  union all select query_id, chunk_id, 'table2', 0 from asked cross join meta where bail and ct = 'table2'),
pinned as (select * from prim union all select more.* from more anti join hits on more.query_id = hits.query_id and more.chunk_id = hits.chunk_id)"""
_MERGED = _PINS + """,
u as (select query_id, chunk_id, 1 as grp, 0 as ord, distance, null as pin from hits union all
  select query_id, chunk_id, case pin when 'table2' then 2 when 'secondary' then 3 else 9 end, ord, 0.0, pin from pinned),
one as (select query_id, chunk_id, min((grp, ord, distance)) as a, bool_or(coalesce(pin = 'primary', false)) as is_primary, min(case when pin = 'secondary' then ord end) as s from u group by 1, 2),
flat as (select query_id, chunk_id, case when a[1] = 9 then 0 else a[1] end as grp, a[2] as ord, a[3] as distance, is_primary, s from one),
merged as (select query_id, chunk_id, distance, row_number() over (partition by query_id order by grp, case when grp = 1 then distance else 0.0 end, ord, chunk_id) - 1 as pos, is_primary,
  case when s is not null then row_number() over (partition by query_id order by s nulls last, chunk_id) end as secondary_no from flat)"""
_TOKENS = "list_filter(list_distinct(regexp_split_to_array(lower({}), '[^a-z0-9]+')), lambda w: w <> '')"
_RANKED = f""",
scored as (select *, case when len(qt) > 0 then len(list_intersect(qt, dt))::double / len(qt) else 0.0 end as score from (
  select m.*, x.question, x.query_used, d.document, d.citation, d.source_pdf, d.title, case when d.ct = 'section' then d.section_number::varchar else coalesce(d.bns_section, '') end as num,
    {_TOKENS.format('x.query_used')} as qt, {_TOKENS.format('d.document')} as dt from merged m join {_expanded('questions')} x using (query_id) join meta d using (chunk_id)) t),
r1 as (select *, row_number() over (partition by query_id order by score desc, pos) as r from scored),
r2 as (select * exclude (r), case when any_p and not in_p then case when is_primary then 1 when r <= 4 then r + 1 else 1000000 end else r end as r
  from (select *, bool_or(is_primary) over w as any_p, bool_or(is_primary and r <= 5) over w as in_p from r1 window w as (partition by query_id)) z),
r3 as (select * exclude (r), case when any_s and not in_s then case when secondary_no = 1 then 1 when r <= 4 then r + 1 else 1000000 end else r end as r
  from (select *, bool_or(secondary_no is not null) over w as any_s, bool_or(secondary_no is not null and r <= 5) over w as in_s from r2 window w as (partition by query_id)) z),
top as (select *, r as rank from r3 where r <= 5),
cited as (select query_id, string_agg(citation, ' | ' order by rank) as citations, count(*) as n from (select query_id, citation, min(rank) as rank from top group by 1, 2) g group by 1),
contexts as (select query_id, any_value(question) as question, any_value(query_used) as query_used, count(*) as n,
  string_agg('[' || rank || '] ' || source_pdf || case when num <> '' then ' Section ' || num else '' end || case when title <> '' then ' — ' || title else '' end || chr(10) || document, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context from top group by 1)"""
_TOP = _MERGED + _RANKED
#: The same with hits of the nearest vectors: each distinct question and filter is searched once.
_NEAREST = f"""hits as (with asked as (select question, source_filter, min(query_id) as one from questions group by 1, 2),
  near as (select one, chunk_id, distance from (select a.one, c.chunk_id, 1 - list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as distance,
      row_number() over (partition by a.one order by 1 - list_cosine_similarity(q.embedding::double[], v.embedding::double[]), c.chunk_id) as k
    from asked a join embeddings q on q.vec_id = a.one % (select count(*) from embeddings) join chunks c on a.source_filter is null or a.source_filter = c.source_pdf join embeddings v on v.vec_id = c.chunk_id % (select count(*) from embeddings)) z where k <= 6)
  select query_id, chunk_id, distance from questions join asked on questions.question = asked.question and questions.source_filter is not distinct from asked.source_filter join near using (one))"""
_ANSWERS = (_MERGED + _RANKED).replace(f"hits as ({D.in_duckdb(D.HITS, *_T)})", _NEAREST)
_COSINE = "(1 - list_cosine_similarity(q.embedding::double[], c.embedding::double[]))"

# the whole prompt as it should read, written apart from the code that makes it
_PROMPT = """You answer questions on the BNS and the BNSS, which replaced the IPC and the CrPC in 2024, from the excerpts below.
Sections that replaced others (use only these):
IPC 302 is BNS 103; IPC 304 is BNS 106; IPC 304B is BNS 80; IPC 306 is BNS 108; IPC 307 is BNS 109; IPC 308 is BNS 110; IPC 354 is BNS 74; IPC 376 is BNS 64; IPC 379 is BNS 303; IPC 392 is BNS 309; IPC 395 is BNS 310; IPC 406 is BNS 316; IPC 420 is BNS 318; IPC 427 is BNS 324; IPC 498A is BNS 85; IPC 499 is BNS 356; IPC 120B is BNS 61; IPC 124A is BNS 152; IPC 153A is BNS 196
CrPC 41 is BNSS 35; CrPC 154 is BNSS 173; CrPC 156 is BNSS 175; CrPC 161 is BNSS 180; CrPC 164 is BNSS 183; CrPC 167 is BNSS 187; CrPC 173 is BNSS 193; CrPC 320 is BNSS 359; CrPC 437 is BNSS 480; CrPC 438 is BNSS 482; CrPC 482 is BNSS 528
Rules:
1. Take the answer from the excerpts and cite act, section number and section title each time.
2. Asked what replaced a section of the IPC or the CrPC, take the new number from the list above, then describe that section by the excerpts. Never guess a section number.
3. Where the excerpts set out a procedure, explain it in plain English; that no definition is given is no reason to refuse.
4. Say "The provided sections do not contain sufficient information" only if the excerpts have nothing to do with the question.
5. Be concise and exact, in plain English, with no more legal terms than needed.
6. With a punishment, tell whether the offence is cognizable or not and bailable or not, where the excerpts say so.

CONTEXT (retrieved legal sections):
"""

SQL = {
    "section_answers": _PINS + f" select p.query_id, x.question, x.query_used, p.chunk_id, d.citation from prim p join {_expanded('questions')} x using (query_id) join meta d using (chunk_id)",
    "expand_questions": _BASE + f", both_ as (select query_id, question from questions union all select -conv_id * 1000 - turn, text from conversations where role = 'user') select query_id, query_used from {_expanded('both_')} x",
    "question_intents": _BASE + " select query_id, form_number, nullif(section_source, '') as section_source, section_number, sources, famous, bail from intents",
    "pinned_chunks": _PINS + " select query_id, chunk_id, pin from pinned",
    "merged_candidates": _MERGED + " select * from merged",
    "reranked_top": _TOP + " select query_id, rank, chunk_id, round(score, 6) as rerank_score from top",
    "citations": _TOP + " select query_id, citations from cited",
    "prompts": _TOP + f" select query_id, context, {_quoted(_PROMPT)} || context || chr(10) || chr(10) || 'QUESTION: ' || question || chr(10) || chr(10) || 'Answer based strictly on the context above. Cite section numbers.' as prompt from contexts",
    "batch_answers": _ANSWERS + f""" select query_id, null::varchar as answer, cited.citations, (select string_agg(chunk_id, ',' order by rank) from top where top.query_id = c.query_id) as chunks, c.query_used from contexts c join cited using (query_id)
      union all select query_id, {_quoted(NO_HIT)}, '', '', query_used from {_expanded('questions')} x where query_id not in (select query_id from hits)""",
    "written_index": f"""with original as ({D.in_duckdb(D.CHUNKS, *_T)}), chunks as (select * replace ({_AMENDED} as content) from original), {_META},
      folders as (select source_pdf, ct as chunk_type, count(*) as n, sum(length(document))::bigint as letters, min(chunk_id) as first,
        round(sum(list_sum(list_transform(e.embedding::double[], lambda x: abs(x)))), 3) as sizes
        from meta join embeddings e on e.vec_id = chunk_id % (select count(*) from embeddings) group by 1, 2)
      select *, (source_pdf, chunk_type) = (select (source_pdf, ct) from meta where chunk_id = 1) as rewritten, (select count(*) from meta) as written from folders""",
    "cosine_top20": f"select query_id, rank, chunk_id, round(distance, 6) as distance from (select *, row_number() over (partition by query_id order by distance, chunk_id) as rank from (select q.vec_id as query_id, c.vec_id as chunk_id, {_COSINE} as distance from embeddings q cross join embeddings c where q.vec_id % 10 = 0) a) b where rank <= 20",
    "cosine_top10_filtered": f"select query_id, rank, chunk_id, round_even((1 - round(distance, 6)) * 100, 1) as percent from (select *, row_number() over (partition by query_id order by distance, chunk_id) as rank from (select q.vec_id as query_id, c.vec_id as chunk_id, {_COSINE} as distance from embeddings q join embeddings c on q.vec_id % 20 <> 0 or q.label = c.label where q.vec_id % 10 = 0) a) b where rank <= 10",
}
