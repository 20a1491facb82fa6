"""Similarity join of set-valued records (problem 2): extended-prefix join with adaptive prefix length.

With tokens ordered from rare to common, two sets of Jaccard >= t share at least l tokens within their prefixes of
length ``n - ceil(t n) + l``, and the l rarest shared tokens all lie there. So a candidate may be looked for by its
rarest shared token, or by its two rarest, and so on. The join starts with single tokens of the shortest prefix;
a token (or combination) that more than ``SPLIT`` records of neighbouring size hold is replaced by its combinations with
one more, later token of the longer prefix. Common tokens thus never carry a join alone, rare ones cost one key each,
and a pair is met at its own combination. A pair that shares just the combination is met before it is extended: since the
overlap is at least t times the larger set, only small sets have such pairs. Candidates are verified on the whole sets.

Combinations that are still common at LENGTHS tokens are joined in blocks: their holders are cut into blocks of about BLOCK
records and every pair of blocks is a key of its own, so no key is joined by one task whatever its frequency, and no pair is lost.

Equal sets are joined once: the join runs over distinct sets (classes). The result can be taken as pairs of classes
with their numbers of members, and membership; where pairs of records are asked for, members are joined in blocks too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import cut, table

#: Combinations held by more records than this are extended by one token.
SPLIT = 64
#: Tokens of the longest combination; combinations that are still common then are joined in blocks.
LENGTHS = 4
#: Holders of one combination, or members of one class, that one key of a join takes.
BLOCK = 256
#: Counters of the token frequencies that order tokens.
FREQUENCIES = 1 << 18
#: Smallest set that takes part.
LEAST = 3
#: Jaccard threshold as a fraction (numerator, denominator).
THRESHOLD = (3, 5)


def clean_set(c: str) -> Column:
    """Distinct members, blanks and letter case disregarded, without missing ones, sorted; null for a null list."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.col(c), lambda x: F.lower(F.btrim(x, F.lit(" \t")))), lambda x: x.isNotNull() & (x != ""))))


def set_classes(records: DataFrame, key: str, members: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(classes, membership) of the sets with at least ``least`` members.

    classes: class_id (least key of its records), items, n. membership: key column ``id``, class_id. Equal sets are
    found by a 128-bit digest together with the size, so no group is gathered and no long array is a shuffle key.
    """
    sets = records.select(F.col(key).alias("id"), clean_set(members).alias("items")).where(F.size("items") >= least)
    sets = cut(sets.withColumn("digest", F.md5(F.array_join("items", "\u0001"))).withColumn("n", F.size("items")))
    heads = sets.groupBy("digest", "n").agg(F.min("id").alias("class_id"))
    classes = sets.select(F.col("id").alias("class_id"), "items", "n").join(heads.select("class_id"), "class_id", "left_semi")
    return classes, sets.select("id", "digest", "n").join(heads, ["digest", "n"]).select("id", "class_id")


def frequencies(items: DataFrame) -> DataFrame:
    """One row, one column: an array of FREQUENCIES counters, items counted by hash (column ``item``)."""
    counted = items.groupBy(_counter("item").alias("b")).agg(F.count("*").alias("f"))
    every = items.sparkSession.range(FREQUENCIES).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("bigint").alias("f"))
    whole = counted.unionByName(every).groupBy("b").agg(F.sum("f").alias("f"))
    return whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "f"))), lambda x: x["f"]).alias("f"))  # FREQUENCIES numbers


def _counter(item: Column | str) -> Column:
    return F.pmod(F.xxhash64(item, F.lit(1)), F.lit(FREQUENCIES)).cast("int")


def ordered(classes: DataFrame) -> DataFrame:
    """class_id, n, toks: members as 64-bit tokens from rare to common.

    A token is (corpus frequency, hash) packed so that its order is the frequency's. Frequencies are counters of a fixed
    number, sent to every task, so sets are neither taken apart nor shuffled; items that share a counter only come out as
    more common than they are (any order common to all sets gives the same pairs). A hash collision can only add
    candidates, which are verified on the members themselves.
    """
    table_of = frequencies(classes.select(F.explode("items").alias("item"))).scalar()
    of = lambda x: F.shiftleft(F.least(F.get(F.col("_f"), _counter(x)), F.lit((1 << 24) - 1)), 39).bitwiseOR(F.xxhash64(x).bitwiseAND(F.lit((1 << 39) - 1)))
    return classes.withColumn("_f", table_of).select("class_id", "n", F.array_sort(F.transform("items", of)).alias("toks"))


def _prefix(n: Column, length: int, t: tuple[int, int]) -> Column:
    """Prefix length n - ceil(t n) + length, at most n."""
    return F.least(n, n - F.ceil(n * t[0] / t[1]).cast("int") + length)


def in_blocks(rows: DataFrame, key: list[str], holder: str, size: str) -> DataFrame:
    """``rows`` with ``blocks`` and ``block``: those of a key are cut by a hash of ``holder`` into blocks of about BLOCK."""
    n = F.ceil(F.col(size) / BLOCK).cast("int")
    return rows.withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64(holder, *key), n).cast("int"))


def _join(keys: DataFrame, t: tuple[int, int], found: DataFrame | None, length: int, most: int | None = None, blocks: bool = False) -> DataFrame:
    """``found`` and the pairs that meet at a key, fit in size and position, and have at most ``most`` members together.

    Position: a pair meets at the combination of its ``length`` rarest shared tokens among others; there, what it can share
    beyond lies behind the last of them in both sets, so meetings that leave too little behind are left out.

    With ``blocks`` (a number of blocks and a block a row) each pair of blocks of a key meets on its own.
    """
    a = keys.select("key", "sc", F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), *(["blocks", "block"] if blocks else []))
    b = keys.select("key", F.explode(F.array("sc", F.col("sc") - 1)).alias("sc"), F.col("sc").alias("scb"), F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), *(["blocks", "block"] if blocks else []))
    on = ["key", "sc"]
    if blocks:  # all blocks of a key have the same number, so (block of a, block of b) is met exactly once
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        a = a.select("*", F.explode(every).alias("ob")).withColumnRenamed("block", "oa").drop("blocks")
        b = b.select("*", F.explode(every).alias("oa")).withColumnRenamed("block", "ob").drop("blocks")
        on = [*on, "oa", "ob"]
    fits = (F.col("na") * t[1] >= F.col("nb") * t[0]) & (F.col("nb") * t[1] >= F.col("na") * t[0])
    fits = fits & ((length + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))) * (t[0] + t[1]) >= (F.col("na") + F.col("nb")) * t[0])
    if most is not None:
        fits = fits & (F.col("na") + F.col("nb") <= most)
    pairs = a.join(b, on).where(fits & ((F.col("scb") > F.col("sc")) | (F.col("a") < F.col("b")))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs if found is None else found.unionAll(pairs)


def candidates(sets: DataFrame, t: tuple[int, int] = THRESHOLD, split: int = SPLIT, lengths: int = LENGTHS) -> DataFrame:
    """Pairs a < b of class ids that share a key and fit in size."""
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(t[1] / t[0])) + 1e-9).cast("int")
    base = sets.withColumn("sc", size_class)
    # key: the combination so far; at: position (1-based) of its last token. Sets are joined back only to keys that are extended
    keys = base.select("class_id", "n", "sc", F.posexplode(F.slice("toks", 1, _prefix(F.col("n"), 1, t))).alias("p", "tok")).select("class_id", "n", "sc", F.col("tok").alias("key"), (F.col("p") + 1).alias("at"))
    found: DataFrame | None = None
    for length in range(1, lengths + 1):
        counts = keys.groupBy("key", "sc").agg(F.count("*").alias("c"))
        # a key's load is what a size class meets: itself and the next larger one; its largest load holds for the whole key
        load = counts.select("key", F.explode(F.array("sc", F.col("sc") - 1)).alias("sc"), "c").groupBy("key", "sc").agg(F.sum("c").alias("c"))
        live = load.groupBy("key").agg(F.max("c").alias("c")).where(F.col("c") > 1)
        keys = cut(keys.join(live, "key"))
        heavy = F.col("c") > split
        found = _join(keys.where(~heavy), t, found, length)
        some = not keys.where(heavy).isEmpty()
        if some and length == lengths:
            found = _join(in_blocks(keys.where(heavy), ["key"], "class_id", "c"), t, found, length, blocks=True)
        if not some or length == lengths:
            break
        # pairs that share no more than this combination can't be met by a longer one; only small sets have such pairs
        most = length * (t[0] + t[1]) // t[0]
        if most >= 2 * LEAST:
            found = _join(in_blocks(keys.where(heavy & (F.col("n") <= most - LEAST)), ["key"], "class_id", "c"), t, found, length, most, blocks=True)
        longer = _prefix(F.col("n"), length + 1, t)
        more = keys.where(heavy).select("class_id", "n", "sc", "key", "at").join(sets.select("class_id", "toks"), "class_id")
        more = more.select("class_id", "n", "sc", "key", "at", F.posexplode(F.slice("toks", F.col("at") + 1, F.greatest(F.lit(0), longer - F.col("at")))).alias("p", "tok"))
        keys = more.select("class_id", "n", "sc", F.xxhash64("key", "tok").alias("key"), (F.col("at") + F.col("p") + 1).alias("at"))
    return found.distinct()


def similar_classes(classes: DataFrame, t: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Pairs of distinct sets (a < b) with overlap and jaccard at or above t, verified on whole sets."""
    sets = cut(ordered(classes))
    cand = candidates(sets, t)
    # first on the tokens, half as wide as the names: hash collisions can only raise the bound
    dup = F.col("n") - F.size(F.array_distinct("toks"))
    side = lambda c: sets.select(F.col("class_id").alias(c), F.col("toks").alias(f"t{c}"), F.col("n").alias(f"n{c}"), dup.alias(f"d{c}"))
    bound = F.size(F.array_intersect("ta", "tb")) + F.col("da") + F.col("db")
    near = cand.join(side("a"), "a").join(side("b"), "b").where(bound * (t[0] + t[1]) >= (F.col("na") + F.col("nb")) * t[0]).select("a", "b")
    one = classes.select(F.col("class_id").alias("a"), F.col("items").alias("ia"), F.col("n").alias("na"))
    two = classes.select(F.col("class_id").alias("b"), F.col("items").alias("ib"), F.col("n").alias("nb"))
    v = near.join(one, "a").join(two, "b").withColumn("overlap", F.size(F.array_intersect("ia", "ib"))).withColumn("_u", F.col("na") + F.col("nb") - F.col("overlap"))
    return v.where(F.col("overlap") * t[1] >= F.col("_u") * t[0]).select("a", "b", "overlap", F.round(F.col("overlap") / F.col("_u"), 6).alias("jaccard"))


def both_tables(modules: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes and membership over both tables; members know whether they are curated (``ref``)."""
    rows = modules.select("module_id", "module_genes").unionByName(refs.select("module_id", "module_genes"))
    classes, member = set_classes(rows, "module_id", "module_genes", LEAST)
    return classes, cut(member.join(refs.select(F.col("module_id").alias("id"), F.lit(True).alias("ref")).distinct(), "id", "left").withColumn("ref", F.coalesce("ref", F.lit(False))))


def class_pairs(modules: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, membership): a, b (a = b for a class with several members), overlap, jaccard, and per class_id its records."""
    classes, member = both_tables(modules, refs)
    near = similar_classes(classes)
    crowded = member.groupBy("class_id").agg(F.count("*").alias("_c")).where("_c > 1").select(F.col("class_id").alias("a"))
    same = classes.select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.col("n").alias("overlap"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(same.join(crowded, "a", "left_semi")), member


def similar_records(modules: DataFrame, refs: DataFrame) -> DataFrame:
    """All pairs of records with Jaccard >= 0.6: both of modules, or one of each table.

    Null lists, sets of fewer than 3 members and an empty table take no part; members differ regardless of blanks and
    case; repeated members count once; equal sets pair with jaccard 1. Pairs within refs are left out. Members come to a
    pair of classes block by block, so a class of many equal sets is no single key.
    """
    pairs, member = class_pairs(modules, refs)
    sizes = member.groupBy("class_id").agg(F.count("*").alias("size"))
    held = in_blocks(member.join(sizes, "class_id"), ["class_id"], "id", "size")
    parts = sizes.select("class_id", F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK).cast("int") - 1).alias("parts"))
    p = pairs.join(parts.select(F.col("class_id").alias("a"), F.explode("parts").alias("oa")), "a")
    p = p.join(parts.select(F.col("class_id").alias("b"), F.explode("parts").alias("ob")), "b")
    m1 = held.select(F.col("class_id").alias("a"), F.col("block").alias("oa"), F.col("id").alias("x"), F.col("ref").alias("rx"))
    m2 = held.select(F.col("class_id").alias("b"), F.col("block").alias("ob"), F.col("id").alias("y"), F.col("ref").alias("ry"))
    met = p.join(m1, ["a", "oa"]).join(m2, ["b", "ob"]).where("not (rx and ry) and (a <> b or x < y)")
    return met.select(F.least("x", "y").alias("module_id_1"), F.greatest("x", "y").alias("module_id_2"), "overlap", "jaccard")


def _p2_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_records(table(spark, d, "module_sets"), table(spark, d, "ref_modules")).select("module_id_1", "module_id_2")


def _p2_similar(spark: SparkSession, d: str) -> DataFrame:
    return similar_records(table(spark, d, "module_sets"), table(spark, d, "ref_modules"))


QUERIES = {"p2_found": _p2_found, "p2_similar_modules": _p2_similar}
_SQL = """with u as (
  select module_id, module_genes, false as ref from module_sets union all select module_id, module_genes, true from ref_modules),
e as (
  select distinct module_id, ref, lower(trim(g, ' ' || chr(9))) as g from (select module_id, ref, unnest(module_genes) as g from u)
  where trim(g, ' ' || chr(9)) <> ''),
n as (select module_id, ref, count(*) as n from e group by all having count(*) >= 3),
o as (
  select x.module_id as a, y.module_id as b, count(*) as o from e x join e y on x.g = y.g and x.module_id < y.module_id where not (x.ref and y.ref) group by all)
select a as module_id_1, b as module_id_2{more}
from o join n n1 on a = n1.module_id join n n2 on b = n2.module_id where 5 * o >= 3 * (n1.n + n2.n - o)"""
ORACLES = {"p2_found": _SQL.format(more=""), "p2_similar_modules": _SQL.format(more=", cast(o as integer) as overlap, round(o / (n1.n + n2.n - o), 6) as jaccard")}
