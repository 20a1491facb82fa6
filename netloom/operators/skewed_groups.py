"""Per-group counts when a few groups own most rows (problem 1).

Eager aggregation: both inputs of a join are reduced to one compact state per join key before they meet, and
what the joined rows would have given is computed from the two states (counts multiply, sums scale by the other
side's count). The distinct step is keyed by the whole (group, left, right) row, so a group that holds a third of
all rows is spread over all tasks; the counting steps combine map-side and shuffle one state per group and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import table, unblank


def group_number(c: Column | str) -> Column:
    """The number in a group label as bigint; null for labels without digits and for numbers beyond the range of a bigint."""
    c = F.col(c) if isinstance(c, str) else c
    digits = F.regexp_extract(c, r"([0-9]+)", 1)
    return F.when(digits != "", digits).try_cast("bigint")


def distinct_pairs(pairs: DataFrame, group: str = "hog", left: str = "species1", right: str = "species2") -> DataFrame:
    """Distinct (hog, left_id, right_id): blanks removed, rows without group or partner left out."""
    return (
        pairs.select(group_number(group).alias("hog"), unblank(left).alias("left_id"), unblank(right).alias("right_id"))
        .where("hog is not null and left_id is not null and right_id is not null")
        .distinct()
    )


def pair_states(pairs: DataFrame) -> DataFrame:
    """One row per group: n_pairs, n_left, n_right, from two levels of partial counts.

    The second level goes through (group, left) states, so distinct partners are counted without a set per group.
    """
    d = distinct_pairs(pairs)
    sides = (
        d.select("hog", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left_id").alias("id")), F.struct(F.lit(1).alias("side"), F.col("right_id").alias("id")))).alias("s"))
        .groupBy("hog", "s.side", "s.id")
        .agg(F.count("*").alias("n"))
    )
    left = F.col("side") == 0
    return sides.groupBy("hog").agg(
        F.sum(F.when(left, F.col("n")).otherwise(0)).alias("n_pairs"),
        F.count_if(left).alias("n_left"),
        F.count_if(~left).alias("n_right"),
    )


def pair_counts(pairs: DataFrame) -> DataFrame:
    """One row per group with its number of distinct pairs only."""
    return distinct_pairs(pairs).groupBy("hog").agg(F.count("*").alias("n_pairs"))


def test_states(tests: DataFrame) -> DataFrame:
    """One row per group of the test log: repeated rows count once; latest non-null n_pairs by time, then id."""
    rows = tests.select(group_number("hog").alias("hog"), "n_pairs", "t_obs", "mean_eff", "tested_at", "test_id").where("hog is not null")
    once = rows.groupBy("hog", "tested_at", "t_obs", "mean_eff", "n_pairs").agg(F.max("test_id").alias("test_id"))
    return once.groupBy("hog").agg(
        F.count("*").alias("n_tests"),
        F.sum(F.nanvl("mean_eff", F.lit(None))).alias("sum_eff"),
        F.max_by("n_pairs", F.when(F.col("n_pairs").isNotNull(), F.struct("tested_at", "test_id"))).alias("reported_pairs"),
    )


def eager_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Outer join of compact states on ``hog``.

    ``per_pair`` is how many rows the outer join of the raw rows has for a pair of the group (its tests, or one row
    without a test), ``joined_rows`` how many for the whole group: counts multiply, no row is joined.
    """
    j = left.join(right, "hog", "left").withColumn("per_pair", F.coalesce("n_tests", F.lit(1)))
    return j.withColumn("joined_rows", F.col("n_pairs") * F.col("per_pair"))


def pairs_per_group(pairs: DataFrame, tests: DataFrame) -> DataFrame:
    """Every group's distinct pairs with what earlier runs reported.

    Nulls, blanks and labels without a number are no group; an empty table gives an empty result; extra columns are
    ignored. A group without tests has joined_rows 0 (inner join) and null reported_pairs. eff_over_pairs is the sum of mean_eff
    over the raw join, computed as sum x count.
    """
    j = eager_join(pair_states(pairs), test_states(tests))
    return j.select(
        "hog", "n_pairs", "n_left", "n_right", F.when(F.col("n_tests").isNull(), 0).otherwise(F.col("joined_rows")).alias("joined_rows"), "reported_pairs",
        F.round(F.col("sum_eff") * F.col("n_pairs"), 4).alias("eff_over_pairs"),
        (F.col("reported_pairs").isNotNull() & (F.col("reported_pairs") == F.col("n_pairs"))).alias("up_to_date"),
    )


def dominant_groups(pairs: DataFrame, tests: DataFrame, percent: int = 1) -> DataFrame:
    """Groups with at least ``percent`` % of all distinct (pair, group) rows, with what the test log says of them.

    All of it comes from the joined states: a group's pairs are its joined rows over the rows a pair has, and
    ``outdated_rows`` are the joined rows whose test reported another number of pairs than there are now.
    """
    states = eager_join(pair_counts(pairs), test_states(tests)).withColumn("pairs", F.expr("joined_rows div per_pair"))
    total = states.agg(F.sum("pairs"))
    old = F.when(F.coalesce(F.col("reported_pairs") != F.col("pairs"), F.lit(False)), F.col("joined_rows")).otherwise(0)
    return states.where(F.col("pairs") * 100 >= total.scalar() * percent).select("hog", F.col("pairs").alias("n_pairs"), "joined_rows", "reported_pairs", old.alias("outdated_rows"))


def _p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return pairs_per_group(table(spark, d, "orthologs"), table(spark, d, "hog_tests"))


def _p1_found(spark: SparkSession, d: str) -> DataFrame:
    return dominant_groups(table(spark, d, "orthologs"), table(spark, d, "hog_tests")).select("hog")


QUERIES = {"p1_found": _p1_found, "p1_pairs_per_group": _p1_groups}

_PAIRS = r"""
pairs as (
  select distinct try_cast(regexp_extract(hog, '[0-9]+') as bigint) as hog, trim(species1, ' ' || chr(9)) as l, trim(species2, ' ' || chr(9)) as r
  from orthologs
  where regexp_matches(hog, '[0-9]') and trim(species1, ' ' || chr(9)) <> '' and trim(species2, ' ' || chr(9)) <> ''),
states as (select hog, count(*) as n_pairs, count(distinct l) as n_left, count(distinct r) as n_right from pairs where hog is not null group by hog)
"""

ORACLES = {
    "p1_found": f"with {_PAIRS} select hog from states where n_pairs * 100 >= (select sum(n_pairs) from states)",
    "p1_pairs_per_group": f"""with {_PAIRS},
logged as (
  select try_cast(regexp_extract(hog, '[0-9]+') as bigint) as hog, n_pairs, t_obs, mean_eff, tested_at, max(test_id) as test_id
  from hog_tests where regexp_matches(hog, '[0-9]') group by all),
tests as (
  select hog, count(*) as n_tests, sum(mean_eff) as sum_eff, max_by(n_pairs, (tested_at, test_id)) filter (n_pairs is not null) as reported
  from logged where hog is not null group by hog)
select s.hog, s.n_pairs, s.n_left, s.n_right, s.n_pairs * coalesce(t.n_tests, 0) as joined_rows, t.reported as reported_pairs,
  round(t.sum_eff * s.n_pairs, 4) as eff_over_pairs, coalesce(t.reported = s.n_pairs, false) as up_to_date
from states s left join tests t on s.hog = t.hog""",
}
