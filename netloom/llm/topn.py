"""Top N rows of every group (problem 3): partition lower bounds.

Every partition's local N-th best row of a group is a lower bound of the group's N-th best row. The best of these
bounds is kept per group, rows behind it are dropped where they lie, and only the survivors are shuffled by group and
ranked. The bound is a whole row position (all sort keys and the last tie key), so ties cannot let a hot group through.

A partition finds its bounds in one pass over its own rows, without an exchange: it keeps the N best rows of each of the
groups it meets, and forgets what it has of a group only when it holds more than ``HELD`` groups (a group that is forgotten and comes back
starts anew; any N rows of a group give a valid bound, so nothing is lost but some pruning). Bounds of groups that have
more than N rows in no partition don't exist, and their rows all survive.

A bound prunes only where a group has many rows. Groups with more than ``max(MIN_ROWS, rows / MAX_BOUNDS)`` rows get one:
there are at most MAX_BOUNDS of them whatever the input, so joining their bounds by broadcast has a proven size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..sources.tables import cut, table, unblank

#: Most group bounds that are broadcast.
MAX_BOUNDS = 20_000
#: Groups up to this size never need a bound.
MIN_ROWS = 20
#: Groups of which a task keeps its best rows at once.
HELD = 100_000


def descending(c: str) -> Column:
    """Sort value of a measure for descending order with null and NaN last."""
    return F.coalesce(F.nanvl(F.col(c), F.lit(float("-inf"))), F.lit(float("-inf")))


def latest(rows: DataFrame, key: list[str], order: list[str], carried: list[str]) -> DataFrame:
    """Of each key the row with the greatest ``order``, combined map-side; the carried columns of that row."""
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *carried)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in carried])


def local_bounds(rows: DataFrame, group: list[str], place: list[str], n: int, held: int = HELD) -> DataFrame:
    """One narrow pass: (group, c, bound) of the groups of each partition, c rows of it and its local n-th row.

    ``place`` sorts ascending; its columns make up ``bound``, null where the partition has fewer than n rows of the group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, size, waiting, counts, more = None, None, [], [], 0
        level = list(range(len(group)))

        def heads(parts: list) -> pd.DataFrame:
            t = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
            t = t.sort_values(place, kind="stable")
            return t[t.groupby(group, sort=False, dropna=False).cumcount() < n]

        def merge() -> None:
            nonlocal best, size, waiting, counts, more
            if waiting:
                best = heads(waiting if best is None else [best, *waiting])
                size = pd.concat(counts if size is None else [size, *counts]).groupby(level=level, sort=False, dropna=False).sum()
                waiting, counts, more = [], [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal best, size
            merge()
            if best is not None:
                nth = best[best.groupby(group, sort=False, dropna=False).cumcount() == n - 1].assign(_has=True)
                out = size.reset_index(name="_c").merge(nth, on=group, how="left")
                has = out["_has"].notna()
                none = pa.array(~has)
                fields = [pa.array(out[c], pa.string() if out[c].dtype == object else None, from_pandas=True) for c in place]
                bound = pa.StructArray.from_arrays(fields, place, mask=none)
                yield pa.RecordBatch.from_arrays([*[pa.array(out[g], kinds[g], from_pandas=True) for g in group], pa.array(out["_c"], pa.int64()), bound], [*group, "c", "bound"])
            best = size = None

        kinds = {}
        for b in batches:
            kinds = kinds or {g: b.schema.field(g).type for g in group}
            t = b.to_pandas(integer_object_nulls=False)
            counts.append(t.groupby(group, sort=False, dropna=False).size())
            waiting.append(heads([t]))
            more += len(waiting[-1])
            if more > max(50_000, 0 if best is None else len(best)):
                merge()
                if len(size) > held:
                    yield from emit()
        yield from emit()

    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{g}` {types[g]}" for g in group], "c long", f"bound struct<{', '.join(f'`{c}`: {types[c]}' for c in place)}>"])
    return rows.select(*group, *place).mapInArrow(run, schema)


def top_n(rows: DataFrame, group: list[str], keys: list[str], tie: str, n: int) -> DataFrame:
    """The first ``n`` rows of every group with ``rank`` (from 1) and ``group_rows``.

    ``keys`` are non-null doubles sorted descending, ``tie`` a non-null unique string sorted ascending by code point.
    Null group values form a group of their own. ``rows`` is read twice, so it should be materialised. After
    it there are two exchanges: one row per group and partition for sizes and bounds, and the rows to be ranked.
    """
    place = [f"_{k}" for k in keys] + [tie]
    rows = rows.withColumns({f"_{k}": -F.col(k) for k in keys})
    stats = cut(local_bounds(rows, group, place, n).groupBy(*group).agg(F.sum("c").alias("group_rows"), F.min("bound").alias("bound")))
    total = stats.agg(F.sum("group_rows")).first()[0] or 0
    bounds = stats.where((F.col("group_rows") > max(MIN_ROWS, total // MAX_BOUNDS)) & F.col("bound").isNotNull()).select(*group, "bound")
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in group])
    at = F.struct(*[F.col(f"x.{c}") for c in place])
    kept = rows.alias("x").join(F.broadcast(bounds).alias("y"), same("x", "y"), "left").where(F.col("bound").isNull() | (at <= F.col("bound"))).select("x.*")
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*[F.col(c) for c in place]))).where(F.col("rank") <= n).drop(*place[:-1])
    return ranked.alias("x").join(stats.alias("y"), same("x", "y")).select("x.*", "y.group_rows")


_KEYS = ["degree", "global_degree", "betweenness", "mean_edge_weight"]


def hub_rows(hubs: DataFrame) -> DataFrame:
    """One row per species, module and gene: the latest by updated_at (then row_id), blanks of gene removed."""
    rows = hubs.where(F.col("module").isNotNull()).withColumn("gene", unblank("gene")).where("gene is not null")
    one = latest(rows, ["species", "module", "gene"], ["updated_at", "row_id"], _KEYS)
    return one.select("species", "module", "gene", *[descending(k).alias(k) for k in _KEYS])


def leading_hubs(hubs: DataFrame, n: int = 5, least: int = 3) -> DataFrame:
    """The n leading genes of every species and module with rank, is_hub (rank 1 to n with a degree) and module size.

    Rows without module or gene are left out; nulls and NaN in a measure rank last (a degree of -inf counts as none);
    a null species is a group of its own; repeated and outdated rows count once; modules of fewer than ``least`` genes
    have no hub; empty tables give no rows.
    """
    t = top_n(cut(hub_rows(hubs)), ["species", "module"], _KEYS, "gene", n)
    has = F.col("degree") > float("-inf")
    return t.select("species", "module", "gene", F.when(has, F.col("degree")).alias("degree"), "rank", (has & (F.col("group_rows") >= least)).alias("is_hub"), F.col("group_rows").alias("n_genes"))


def _p3_top_hubs(spark: SparkSession, d: str) -> DataFrame:
    return leading_hubs(table(spark, d, "hubs"))


def _p3_found(spark: SparkSession, d: str) -> DataFrame:
    return leading_hubs(table(spark, d, "hubs")).where("is_hub").select("species", "module", "gene")


QUERIES = {"p3_found": _p3_found, "p3_top_hubs": _p3_top_hubs}

_SQL = """with r as (
  select species, module, trim(gene, ' ' || chr(9)) as gene, updated_at, row_id,
    {keys}
  from hubs where module is not null and trim(gene, ' ' || chr(9)) <> ''),
one as (select *, row_number() over (partition by species, module, gene order by updated_at desc nulls last, row_id desc) as k from r),
g as (
  select *, count(*) over (partition by species, module) as n_genes,
    row_number() over (partition by species, module order by degree desc nulls last, global_degree desc nulls last, betweenness desc nulls last,
      mean_edge_weight desc nulls last, gene collate "binary") as rank
  from one where k = 1)
""".format(keys=", ".join(f"case when isnan({k}) then null else {k} end as {k}" for k in _KEYS)).replace(' collate "binary"', "")
ORACLES = {
    "p3_found": _SQL + "select species, module, gene from g where rank <= 5 and n_genes >= 3 and degree is not null",
    "p3_top_hubs": _SQL + "select species, module, gene, degree, cast(rank as integer) as rank, degree is not null and n_genes >= 3 as is_hub, n_genes from g where rank <= 5",
}
