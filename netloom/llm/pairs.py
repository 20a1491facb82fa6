"""Items that appear together (problem 5): pair counts and lift within a scope.

Items are deduplicated per record, ordered pairs are emitted per record and counted map-side; lift and pointwise mutual
information follow from the marginals. Where only pairs above a support and a lift are asked for, an item that can't be
in such a pair is dropped before pairs are emitted: c <= min(a, b), so c >= s needs a >= s, and c n >= r a b needs
r a <= n. Both tests are exact.

A record of more than ``BLOCK`` items is cut into blocks; every pair of its blocks is one row, so no row and no task
holds more than two blocks of it, and every pair of items is emitted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table, unblank

#: Most items of a record held in one row.
BLOCK = 512
#: Items of a scope that one lane (and task) takes.
LANE_ITEMS = 50_000
#: Records of an item from which its marginals are broadcast, and the most such items.
HOT_ROWS, MAX_HOT = 20_000, 50_000


def valid_items(rows: DataFrame, scope: str, record: list[str], item: str) -> DataFrame:
    """(scope, record..., item) of the rows that count: nothing null, blanks removed, no blank item."""
    return rows.select(scope, *record, unblank(item).alias("item")).dropna()


def record_sizes(items: DataFrame, scope: str, record: list[str]) -> DataFrame:
    """Rows of each record: an upper bound of its distinct items, from one small exchange."""
    return items.groupBy(scope, *record).agg(F.count("*").alias("size"))


def scope_sizes(sizes: DataFrame, scope: str) -> DataFrame:
    """n (records) and lanes of each scope: a scope of many items is spread over lanes of about LANE_ITEMS."""
    return sizes.groupBy(scope).agg(F.count("*").alias("n"), F.ceil(F.sum("size") / LANE_ITEMS).cast("int").alias("lanes"))


def with_marginals(distinct: DataFrame, sizes: DataFrame, scope: str, support: int, ratio: int) -> DataFrame:
    """Items with ``a`` (records of the item within its scope), ``n`` and ``lanes`` of the scope, pruned exactly.

    Items with more than max(HOT_ROWS, rows / MAX_HOT) records are at most MAX_HOT whatever the input: their marginals reach
    their rows by broadcast, so no task holds all rows of one; all others are joined by (scope, item).
    """
    a = distinct.groupBy(scope, "item").agg(F.count("*").cast("int").alias("a"))
    many = F.greatest(F.lit(HOT_ROWS), F.expr(f"_rows div {MAX_HOT}"))
    hot = F.col("a") > many
    known = a.where(F.col("a") >= support).join(scope_sizes(sizes, scope), scope).withColumn("_rows", sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar())
    of_hot = F.broadcast(known.where(hot).select(scope, "item", "a", "n", "lanes"))
    fits = F.col("a") * ratio <= F.col("n")
    at_hot = distinct.join(of_hot.where(fits), [scope, "item"])
    # a hot item's rows would still travel to be joined with nothing: they are left out where they lie
    others = distinct.join(of_hot.select(scope, "item"), [scope, "item"], "left_anti")
    return at_hot.unionByName(others.join(known.where(~hot & fits).select(scope, "item", "a", "n", "lanes"), [scope, "item"]))


def emitted(items: DataFrame, scope: str, record: list[str]) -> DataFrame:
    """(scope, lane, lanes, n, gene_1, a, gene_2, b) for every pair of items of a record, gene_1 < gene_2.

    Records of a scope lie together in its lanes, so equal pairs meet in one task before anything is shuffled.
    """
    it = F.struct(F.col("item").alias("g"), "a")
    lane = F.pmod(F.xxhash64(*record), F.col("lanes")).cast("int")
    small = items.withColumn("lane", lane).repartition(scope, "lane").groupBy(scope, "lane", *record).agg(F.first("n").alias("n"), F.first("lanes").alias("lanes"), F.sort_array(F.collect_list(it)).alias("x"))
    first = small.select(scope, "lane", "lanes", "n", "x", F.posexplode("x").alias("i", "p"))
    second = first.where(F.col("i") + 1 < F.size("x")).select(scope, "lane", "lanes", "n", "p", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("q"))
    return second.select(scope, "lane", "lanes", "n", F.col("p.g").alias("gene_1"), F.col("p.a").alias("a"), F.col("q.g").alias("gene_2"), F.col("q.a").alias("b"))


def counted(pairs: DataFrame, scope: str, *by: str) -> DataFrame:
    """Pairs with their count and marginals, by scope and what else is given."""
    return pairs.groupBy(scope, *by, "gene_1", "gene_2").agg(F.sum("c").alias("c"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("n").alias("n"))


def emitted_blocks(items: DataFrame, scope: str, record: list[str], sizes: DataFrame) -> DataFrame:
    """As :func:`emitted` for records above BLOCK items: items go to hash blocks, block pairs meet by equi-join."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    big = items.join(sizes.where(F.col("size") > BLOCK), [scope, *record]).withColumn("nb", blocks).withColumn("blk", F.pmod(F.xxhash64("item"), F.col("nb")).cast("int"))
    left = big.select(scope, *record, "n", F.col("item").alias("gx"), F.col("a").alias("ax"), F.col("blk").alias("lo"), F.explode(F.sequence(F.col("blk"), F.col("nb") - 1)).alias("hi"))
    right = big.select(scope, *record, F.col("item").alias("gy"), F.col("a").alias("ay"), F.col("blk").alias("hi"), F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("lo"))
    p = left.join(right, [scope, *record, "lo", "hi"]).where("gx <> gy and (lo < hi or gx < gy)")
    swap = F.col("gx") > F.col("gy")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return p.select(scope, "n", pick("gx", "gy").alias("gene_1"), pick("ax", "ay").alias("a"), pick("gy", "gx").alias("gene_2"), pick("ay", "ax").alias("b"))


def cooccurrence(rows: DataFrame, scope: str, record: list[str], item: str, support: int = 5, ratio: int = 5) -> DataFrame:
    """Pairs with c >= support and c n >= ratio a b: scope, gene_1, gene_2, n_both, n_1, n_2, n_records, lift, pmi.

    Rows with a null in scope, record or item, and blank items, are left out; repeated rows count once; records of one
    item have no pair but count in n; an empty table gives no rows; extra columns are ignored.
    """
    valid = valid_items(rows, scope, record, item)
    sizes = record_sizes(valid, scope, record)
    big = sizes.where(F.col("size") > BLOCK)
    has_big = not big.isEmpty()
    items = with_marginals(valid.distinct(), sizes, scope, support, ratio)
    local = counted(emitted(items.join(big, [scope, *record], "left_anti") if has_big else items, scope, record).withColumn("c", F.lit(1)), scope, "lane", "lanes")
    alone = F.col("lanes") == 1
    if has_big:  # a scope's pairs may come from either way
        c = counted(local.drop("lane", "lanes").unionByName(emitted_blocks(items, scope, record, sizes).withColumn("c", F.lit(1).cast("bigint"))), scope)
        done = c
    else:  # a scope in one lane is counted already
        c = counted(local.where(~alone), scope)
        done = local.where(alone).select(*c.columns).unionByName(c)
    lift = F.col("c").cast("double") * F.col("n") / (F.col("a").cast("double") * F.col("b"))
    hit = (F.col("c") >= support) & (F.col("c") * F.col("n") >= F.lit(ratio).cast("long") * F.col("a") * F.col("b"))
    return done.where(hit).select(scope, "gene_1", "gene_2", F.col("c").alias("n_both"), F.col("a").alias("n_1"), F.col("b").alias("n_2"), F.col("n").alias("n_records"), F.round(lift, 6).alias("lift"), F.round(F.log2(lift), 6).alias("pmi"))


def _p5(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence(table(spark, d, "modules"), "scan_id", ["run_no", "module"], "gene")


def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).select("scan_id", "gene_1", "gene_2")


QUERIES = {"p5_found": _p5_found, "p5_gene_pairs": _p5}
_SQL = """with m as (
  select distinct scan_id, run_no, module, trim(gene, ' ' || chr(9)) as g from modules
  where scan_id is not null and run_no is not null and module is not null and trim(gene, ' ' || chr(9)) <> ''),
n as (select scan_id, count(*) as n from (select distinct scan_id, run_no, module from m) group by 1),
a as (select scan_id, g, count(*) as a from m group by 1, 2),
c as (
  select x.scan_id, x.g as gene_1, y.g as gene_2, count(*) as c from m x join m y using (scan_id, run_no, module) where x.g < y.g group by 1, 2, 3)
select c.scan_id, gene_1, gene_2{more}
from c join n on c.scan_id = n.scan_id join a a1 on c.scan_id = a1.scan_id and gene_1 = a1.g join a a2 on c.scan_id = a2.scan_id and gene_2 = a2.g
where c.c >= 5 and c.c * n.n >= 5 * a1.a * a2.a"""
ORACLES = {
    "p5_found": _SQL.format(more=""),
    "p5_gene_pairs": _SQL.format(more=", c.c as n_both, a1.a as n_1, a2.a as n_2, n.n as n_records, round(c.c * n.n / (a1.a * a2.a), 6) as lift, round(log2(c.c * n.n / (a1.a * a2.a)), 6) as pmi"),
}
