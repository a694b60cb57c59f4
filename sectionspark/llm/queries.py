"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weights_5_2_1(sources: list) -> list[int]:
    return [(5, 2, 1)[i % 3] for i in range(len(sources))]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectionspark.llm.line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectionspark.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectionspark.llm.pivot_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectionspark.llm.mixing import mix, word_count

    # short documents cost more, so a quota takes and repeats a source's longer ones first
    short = (word_count(F.col("text")) < 32).cast("int")
    return mix(_table(spark, sf_dir, "documents"), F.array("source"), weights_5_2_1, kind=short, kind_costs=(0, 0.5))


def op4_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectionspark.llm.histogram_sort import shard_documents

    docs = _table(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    out = shard_documents(docs, shards=24)
    return out.select("doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectionspark.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sectionspark.llm.token_counts import SentencePieceCounter, token_counts

    counted = token_counts(_table(spark, sf_dir, "documents"), SentencePieceCounter(public_tokenizers.path("piece_bpe_32k.model")))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectionspark.llm import quality

    docs = _table(spark, sf_dir, "documents")
    trees = quality.train(docs, _table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", quality.held_out().alias("held_out"), "text")
    scored = quality.score_quality(rows, trees, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectionspark.llm import language_id

    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", language_id.held_out().alias("held_out"), "text")
    found = language_id.identify(rows, language_id.train(docs), keep=["doc_id", "held_out"])
    return found.withColumnRenamed("lang_score", "score")


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sectionspark.llm.packing import WordTokenizer, pack

    return packed_digest(pack(_table(spark, sf_dir, "documents"), WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with the faults that op11 repairs, dealt by a checksum of each row's key."""
    blank = F.lit(" ")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectionspark.llm.conversation_repair import digests, repair_conversations

    turns = _table(spark, sf_dir, "conversations")
    report, repaired = repair_conversations(damaged(turns))
    every = turns.select(F.col("conv_id").alias("id")).distinct()
    out = every.join(report, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    out = out.join(digests(repaired), F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    counts = (F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sectionspark.llm.scratch import new_path
    from sectionspark.llm.token_files import ByteTokenizer, read_documents, write_token_files

    path = new_path(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), ByteTokenizer(public_tokenizers.path("byte_bpe_50k.json")), path, end_id=2)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectionspark.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_nearest_neighbours, op3_mixing, op4_histogram_sort, op5_minhash_dedup, op6_token_counts, op7_pivot_dedup, op8_quality, op9_language_id, op10_hilbert_packing, op11_conversation_repair, op12_token_files, op13_hard_negatives)}


#: Line dedup as a join on the words of prefixes (rarest words first), then the exact similarity.
_LINE_DEDUP = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as p from documents),
s as (select doc_id, p, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '\s+'), lambda w: w <> ''))) as ws from l),
sets as (select ws, len(ws) as n, min((doc_id, p)) as f from s where len(ws) > 0 group by ws),
words as (select f, n, unnest(ws) as w from sets), rare as (select w, count(*) as c from words group by w),
prefix as (select * from (select f, n, w, row_number() over (partition by f order by c, w) as q from words join rare using (w)) t where q <= n - (n * 80 + 99) // 100 + 1),
pairs as (select distinct x.f as x, y.f as y from prefix x join prefix y on x.w = y.w and x.f < y.f and x.n * 100 >= y.n * 80 and y.n * 100 >= x.n * 80),
near as (select distinct y from pairs join sets a on a.f = x join sets b on b.f = y where len(list_intersect(a.ws, b.ws)) * 180 >= (a.n + b.n) * 80),
gone as (select doc_id, p from s join sets using (ws) where (doc_id, p) <> f or f in (select y from near)),
kept as (select l.doc_id, string_agg(line, chr(10) order by l.p) filter (gone.p is null) as t, count(*) as n_lines, count(gone.p) as n_removed from l left join gone on l.doc_id = gone.doc_id and l.p = gone.p group by 1)
select d.doc_id, case when d.text is not null then coalesce(t, '') end as text, coalesce(n_lines, 0)::int as n_lines, coalesce(n_removed, 0)::int as n_removed from documents d left join kept on d.doc_id = kept.doc_id"""
#: All pairs of a label; the components are the closure of their links.
_PIVOT_DEDUP = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
ok as (select * from v where label is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
c as (select a as vec_id, min(b) as least from reach group by 1), n as (select a as vec_id, count(*) as n_links from links group by 1)
select vec_id, coalesce(n_links, 0)::bigint as n_links, least(vec_id, coalesce(c.least, vec_id)) as component_id, vec_id <= coalesce(c.least, vec_id) as kept
from v left join c using (vec_id) left join n using (vec_id)"""

#: All scores of all anchors.
_HARD_NEGATIVES = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding::double[], lambda x: floor(256 * x)) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, v.vec_id as id, a.label = v.label as same, list_dot_product(a.e, v.e)::bigint as score from v a join v on a.vec_id <> v.vec_id where a.vec_id % 50 = 0),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, id) as n from s where same) t where n <= 5),
w as (select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score, row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from w where rank <= 3"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express: the others hash, tokenise, sample or learn."""
    return {"op1_line_dedup": _LINE_DEDUP, "op7_pivot_dedup": _PIVOT_DEDUP, "op13_hard_negatives": _HARD_NEGATIVES}
