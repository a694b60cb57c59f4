"""Operator 1, line dedup by an exact set-similarity join, with DataFrame functions only.

A line is the set of its words. Words are ordered by rarity; two lines can reach the
similarity only if they share a word of their prefixes (the few rarest words of each). That
join on words is cut further by the lengths of the lines, the positions of the shared word
and parity bitmaps, and what is left is verified by the exact Jaccard similarity. A later
line needs one earlier match only, so all joins on words are semi-joins: a group of similar
lines never makes all of its pairs.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectionspark.llm.scratch import dropped, sorted_shuffles, stored, unused

#: Counters of the frequencies that order the words.
COUNTERS = 1 << 16
#: Parts of 64 bits in the bitmaps that candidates are compared by; a power of 2.
WIDE = 4
#: Up to so many lines their places are broadcast; more are joined by a shuffle. Up to so many
#: ids that several rows have are broadcast; with more, all rows get a digest.
BROADCAST_LINES = 1_000_000
#: Words repeat within a file, so Parquet stores them as numbers in a dictionary: about 0.9 bytes
#: of disk for each of the input instead of 2.1.
DICTIONARY = {"parquet.dictionary.page.size": 16 << 20}


def _folded(text: Column) -> Column:
    """A text in lower case, with blanks for all white space inside its lines. Few texts hold
    other white space, and a search for it is cheaper than a pattern."""
    odd = reduce(lambda a, b: a | b, [text.contains(c) for c in "\t\x0b\f\r"])
    return F.lower(F.when(odd, F.regexp_replace(text, r"[\t\x0B\f\r]", " ")).otherwise(text))


def _lines(text: Column) -> Column:
    return F.split(_folded(text), "\n")


def _words(line: Column) -> Column:
    """The distinct words of a line, by hashes of 64 bits in their order."""
    # what lies below a lambda is interpreted, so only hashing does
    hashes = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit(""))))


def _ranks(words: DataFrame) -> str:
    """Lines that hold the words of each of COUNTERS hashed counters, as ranks from 0 to 99 (two
    for each doubling). They order the words; no result depends on their errors."""
    at = words.select(F.explode("words").alias("h")).select(F.col("h").bitwiseAND(COUNTERS - 1).cast("int").alias("at"))
    rank = F.least(F.floor(F.log2("count") * 2), F.lit(99)).cast("int")
    found = at.groupBy("at").count().agg(F.collect_list("at").alias("at"), F.collect_list(rank).alias("rank")).first()  # COUNTERS numbers each at most
    out = ["0"] * COUNTERS
    for i, r in zip(found["at"], found["rank"], strict=True):
        out[i] = str(r)
    return ",".join(out)


def _rarest_first(words: str | Column, ranks: str) -> Column:
    """Hashes of words as codes, rarest first: a rank in 8 bits over 56 bits of the hash (the
    rank stands for the other 8, so the code is nearly as good as the whole hash)."""
    table = F.expr(f"cast(split('{ranks}', ',') as array<bigint>)")  # folded into a constant of a fixed size
    # where no code can be null, they are sorted as plain numbers, else one object for each
    rank = lambda h: F.coalesce(table[h.bitwiseAND(COUNTERS - 1)], F.lit(0).cast("bigint"))
    return F.sort_array(F.transform(words, lambda h: F.shiftleft(rank(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8))))


def _codes(line: Column, ranks: str) -> Column:
    """The codes of a line's distinct words, rarest first."""
    return F.array_distinct(_rarest_first(_words(line), ranks))


def _parity(words: str | Column) -> Column:
    """64 bits, each the parity of the words that hash to it; of two sets at least as many
    words differ as bits do."""
    masks = F.expr(f"cast(split('{','.join(str(1 << i) for i in range(63))},{-(1 << 63)}', ',') as array<bigint>)")
    bits = F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, h: acc.bitwiseXOR(masks[h.bitwiseAND(63)]))
    return F.coalesce(bits, F.lit(0).cast("bigint"))  # never null, so joins on it add no test that computes it again


def _n(of: str) -> Column:
    return F.shiftright(F.col(f"{of}.nq"), 32)


def _among(lines: DataFrame, ids: DataFrame, within: bool = True) -> DataFrame:
    """The lines whose number u is among those of ids, or the others. A bitmap of 4 KB tells
    32,768 numbers, so a thousand million lines take about 128 MB and need no shuffle."""
    ids = ids.select("u", F.bitmap_bucket_number("u").alias("_at")).repartition("_at")
    bits = stored(ids.groupBy("_at").agg(F.bitmap_construct_agg(F.bitmap_bit_position("u")).alias("_bits")), "bitmaps")
    near_by = F.broadcast(bits) if bits.count() <= BROADCAST_LINES // 32 else bits
    found = F.expr("getbit(cast(conv(hex(substring(_bits, cast(bitmap_bit_position(u) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position(u) % 8 as int)) = 1")
    joined = lines.join(near_by, F.bitmap_bucket_number("u") == F.col("_at"), "inner" if within else "left")
    return joined.where(found if within else ~F.coalesce(found, F.lit(False))).select(*lines.columns)


def _earlier(x: str, y: str, key: list[str]) -> Column:
    a, b = F.col(f"{x}.{key[0]}"), F.col(f"{y}.{key[0]}")
    return (a < b) | ((a == b) & _earlier(x, y, key[1:])) if key[1:] else a < b


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with the key of a document: i, the id (the least long for null), and, if any id
    has several rows, g, a digest of the text where it has, else 0; and the names of these
    columns, which docs doesn't use."""
    name = {c: unused(docs, f"_{c}") for c in "ig"}
    shared = unused(docs, "_shared")
    docs = docs.withColumn(name["i"], F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))))
    several = docs.groupBy(F.col(name["i"]).alias("i")).count().where("count > 1")
    several = stored(several.select(F.col("i").alias(name["i"]), F.lit(True).alias(shared)), "shared-ids")
    n, digest = several.count(), F.xxhash64(id_col, text_col)
    if not n:
        return docs, {"i": name["i"]}
    if n > BROADCAST_LINES:
        return docs.withColumn(name["g"], digest), name
    docs = docs.join(F.broadcast(several), name["i"], "left")
    return docs.withColumn(name["g"], F.when(F.col(shared), digest).otherwise(0)).drop(shared), name


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """All rows and columns of ``docs`` with the text's later lines removed, plus n_lines and
    n_removed (columns of these names are replaced; no other name clashes).

    Lines end at line feeds. Their words are lower-cased runs between white space. A line is
    removed if an earlier line, by (id, digest of the text, place in the text), has a Jaccard
    similarity of at least ``percent``; whether the earlier line is itself removed plays no
    part. Lines without words stay and match nothing. A null text stays null, with no lines;
    null ids sort first. Rows that share an id (or have none) and differ in their texts are
    different documents; rows equal in both are one, in which a line of the same place is
    never earlier than itself. A very long text is one row with more lines, a very long line
    one set with more words. An empty table gives an empty result. Words are told apart by 64
    bits of a hash (56 when lines are compared), texts of one id by 64.
    """
    with sorted_shuffles(docs.sparkSession):
        return _without_later(docs.drop("n_lines", "n_removed"), id_col, text_col, percent)


def _without_later(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    keyed, name = _keyed(docs, id_col, text_col)
    key = [*name, "p"]  # of a line
    base = keyed.select(*(F.col(column).alias(c) for c, column in name.items()), F.col(text_col).alias("t"))
    # a test on the words would be computed a second time below them, so the text is tested
    lines = base.select(*name, F.posexplode(_lines(F.col("t"))).alias("p", "line")).where(F.trim("line") != "")
    sets = lines.select(*key, _words(F.col("line")).alias("words"))
    # u is the line's number in the stored table
    table = sets.select(*key, F.monotonically_increasing_id().alias("u"), F.size("words").alias("n"), F.xxhash64("words").alias("s1"), F.xxhash64(F.lit(1), "words").alias("s2"), "words")
    table = stored(table, "lines", **DICTIONARY)

    # all lines of a set but its first fold; those later than it go (rows equal in id and text have lines of one key)
    several = stored(table.groupBy("s1", "s2").agg(F.count("*").alias("n")).where("n > 1").select("s1", "s2"), "repeated-lines")
    few = several.count() <= BROADCAST_LINES
    repeated = table.join(F.broadcast(several) if few else several, ["s1", "s2"]).select("s1", "s2", *key, "u")
    firsts = repeated.groupBy("s1", "s2").agg(F.min(F.struct(*key, "u")).alias("f"))
    later = F.struct(*key) != F.struct(*(F.col(f"f.{c}") for c in key))
    copies = repeated.join(F.broadcast(firsts) if few else firsts, ["s1", "s2"]).where(F.col("u") != F.col("f.u"))
    copies = stored(copies.select(*key, "u", later.alias("later")), "copied-lines")
    first = _among(table.select("u", "n", "words"), copies, within=False)
    ranks = _ranks(first)  # of the lines that meet

    n = F.col("n")
    rare = F.slice(_rarest_first("words", ranks), 1, n - F.ceil(n * percent / 100).cast("int") + 1)
    # bitmaps come before the words are dealt out, else each row computes its own
    prefix = first.select("u", "n", _parity("words").alias("b"), rare.alias("rare")).select("u", "n", "b", F.posexplode_outer("rare").alias("q", "c"))
    # outer, as for others Spark adds a test that computes them a second time; none is empty
    # 32 bits of a word are enough to find candidates; n and the position q of a word as one number
    prefix = prefix.select("u", "b", F.col("c").bitwiseAND((1 << 31) - 1).cast("int").alias("k"), F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("q")).alias("nq"))
    t, s = percent, 100 + percent  # overlap o of n1 and n2 words: o / (n1 + n2 - o) >= t / 100

    def near(order: Column, *maps: str) -> Column:
        """x and y share a word, and no filter rules them out."""
        x, y = "x", "y"
        nx, ny = _n(x), _n(y)
        apart = reduce(add, [F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in maps])
        qx, qy = (F.col(f"{a}.nq").bitwiseAND((1 << 32) - 1) for a in (x, y))
        return (
            (F.col(f"{x}.k") == F.col(f"{y}.k")) & order
            & (apart * s <= (nx + ny) * (100 - t))
            & (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * t)
            & (F.least(nx - qx, ny - qy) * s >= (nx + ny) * t)
        )

    # words of lines that have a candidate, earlier or later, at that word
    other = F.col("x.u") != F.col("y.u")
    open_ = stored(prefix.alias("y").join(prefix.alias("x"), near(other, "b"), "left_semi"), "candidates")

    # the same with wider bitmaps leaves few words, nearly all of lines that match
    wide = [f"b{j}" for j in range(WIDE)]
    maps = _among(table.select(*key, "u", "words"), open_.select("u").distinct())
    maps = maps.select("*", *(_parity(F.filter("words", lambda h: h.bitwiseAND(64 * (WIDE - 1)) == 64 * j)).alias(b) for j, b in enumerate(wide)))  # noqa: B023
    maps = stored(maps, "candidate-words", **DICTIONARY)
    dropped(table)
    beside = maps.select("u", *wide)
    facing = open_.select("u", "k", "nq").join(F.broadcast(beside) if maps.count() <= BROADCAST_LINES // 2 else beside, "u")
    close = stored(facing.alias("y").join(facing.alias("x"), near(other, *wide), "left_semi"), "close-lines")
    dropped(open_)
    words = stored(_among(maps.select("u", *key, "words"), close.select("u").distinct()), "close-words")
    few = words.count() <= BROADCAST_LINES // 2
    dropped(maps)
    raw = close
    own = words.select("u", *key)
    close = close.join(F.broadcast(own) if few else own, "u")
    sets = words.select("u", "words")

    # most later lines match the first candidate of a word; the others meet all of them
    earlier = near(_earlier("x", "y", key), *wide)
    lead = close.groupBy("k").agg(F.min(F.struct(*key, "u", "nq", *wide)).alias("lead")).select("k", "lead.*")
    pairs = close.alias("y").join(lead.alias("x"), earlier).select(F.col("y.u").alias("w"), F.col("x.u").alias("v")).distinct()
    exact = F.size(F.array_intersect("x.words", "y.words")) * s >= (F.size("x.words") + F.size("y.words")) * t
    pairs = pairs.join(sets.alias("x"), F.col("v") == F.col("x.u")).select("w", "x.words")
    easy = stored(pairs.alias("x").join(sets.alias("y"), F.col("w") == F.col("y.u")).where(exact).select("y.u").distinct(), "matched-lines")
    hard = close.join(easy, "u", "left_anti")
    hard = stored(hard.alias("y").join(close.alias("x"), earlier, "left_semi"), "open-lines")
    # a row for a line and word, with the line's words
    facing = close.join(hard.select("k").distinct(), "k", "left_semi").join(sets, "u")
    matched = hard.join(sets, "u").alias("y").join(facing.alias("x"), earlier & exact, "left_semi").select("u").union(easy)
    matched = matched.distinct()
    matched = own.join(F.broadcast(matched) if few else matched, "u", "left_semi").select(*key)
    gone = stored(copies.where("later").select(*key).union(matched).distinct(), "removed-lines")
    for used in (several, copies, words, raw, easy, hard):
        dropped(used)
    _gone = unused(keyed, "_gone")
    places = gone.groupBy(*(F.col(c).alias(column) for c, column in name.items())).agg(F.collect_set("p").alias(_gone))
    places = stored(places, "removed-places")
    if gone.count() <= BROADCAST_LINES:
        places = F.broadcast(places)
    out = keyed.join(places, list(name.values()), "left").select(*docs.columns, _gone)
    split = F.split(F.col(text_col), "\n")
    kept = F.concat_ws("\n", F.filter(split, lambda line, at: ~F.array_contains(_gone, at)))
    out = out.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)))
    out = out.withColumn("n_removed", F.when(F.col(_gone).isNull(), 0).otherwise(F.size(_gone)))
    return out.withColumn(text_col, F.when(F.col(_gone).isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(kept)).drop(_gone)
