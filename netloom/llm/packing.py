"""Filling containers of fixed capacity (problem 7): hierarchical residual packing.

Texts are measured in tokens; a text longer than the capacity gives full containers of its own and one rest, all others
are items that are never split. Every partition packs its items by best fit, largest first; containers filled to the
round's mark are emitted, the others become items of the next round (a container is an item of its fill), which merges
a few partitions into one and packs again. The mark falls from round to round. Rounds end when all underfull containers were
packed by one task, or when a round saved fewer than ``GAIN`` of its items. A task holds at most about
``TASK_ITEMS`` items, each a container with its list of pieces (at most ``capacity`` of them).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import cut, table
from .bpe import encoder
from .tokens import VOCABULARY, placed, sent

CAPACITY = 2048
#: Fill that a container needs to be emitted, by round; later rounds use the last.
MARKS = (0.995, 0.99, 0.98, 0.95)
TASK_ITEMS = 100_000
GAIN = 0.01
#: Partitions merged into one by a round.
FAN_IN = 8

_PIECE = pa.struct([("key", pa.int64()), ("part", pa.int32()), ("start", pa.int32()), ("n", pa.int32())])
_SCHEMA = "fill int, full boolean, pieces array<struct<key: bigint, part: int, start: int, n: int>>"
_ARROW = pa.schema([("fill", pa.int32()), ("full", pa.bool_()), ("pieces", pa.list_(_PIECE))])


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices by container: largest first, each into the fullest container that still takes it, else a new one.

    Open containers are kept by free space; a bit mask of the free spaces in use gives the least one that fits.
    """
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        fits = used >> s
        if fits:
            free = s + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                used &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        free -= s
        if free:
            by_free[free].append(b)
            used |= 1 << free
    return bins


def _emit(items: list[tuple[int, list]], capacity: int, mark: float) -> Iterator[pa.RecordBatch]:
    """Pack (fill, pieces) items; containers in batches."""
    packed = best_fit([s for s, _ in items], capacity)
    for k in range(0, len(packed), 2000):
        rows = [[items[i] for i in b] for b in packed[k : k + 2000]]
        fills = [sum(s for s, _ in b) for b in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(fills, pa.int32()), pa.array([f >= mark * capacity for f in fills], pa.bool_()), pa.array([[p for _, ps in b for p in ps] for b in rows], pa.list_(_PIECE))], schema=_ARROW
        )


def _chunks(items: list, most: int) -> Iterator[list]:
    for k in range(0, len(items), most):
        yield items[k : k + most]


def first_round(docs: DataFrame, key: str, text: str, capacity: int, vocabulary: str) -> DataFrame:
    """Measure, cut what exceeds the capacity, and pack each partition."""
    name = sent(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(placed(name)).count
        items: list[tuple[int, list]] = []
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = count(t)
                for part, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    items.append((size, [{"key": k, "part": part, "start": start, "n": size}]))
            if len(items) >= TASK_ITEMS:
                yield from _emit(items, capacity, MARKS[0])
                items = []
        yield from _emit(items, capacity, MARKS[0])

    return docs.select(key, text).where(F.col(key).isNotNull()).mapInArrow(run, _SCHEMA)


def next_round(bins: DataFrame, partitions: int, capacity: int, mark: float) -> DataFrame:
    """Pack underfull containers as items, a few partitions merged into one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [(f, p) for b in batches for f, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
        items.sort(key=lambda x: (-x[0], x[1][0]["key"], x[1][0]["part"]))  # rows arrive in any order
        for some in _chunks(items, 2 * TASK_ITEMS):
            yield from _emit(some, capacity, mark)

    to = F.pmod(F.xxhash64(F.col("pieces")[0]["key"]), F.lit(partitions)).cast("int")
    return bins.repartitionById(partitions, to).mapInArrow(run, _SCHEMA)


def pack(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: key, part, start (first token), n_tokens, container, fill.

    ``container`` is named by its first piece ("key:part"), so names are unique and don't depend on the run's layout of tasks.
    A text of up to ``capacity`` tokens is one piece; a longer one is cut into full containers and a rest. Texts
    without tokens (null, empty) get one row with n_tokens 0 and no container. Keys must be unique and not null (rows
    with a null key are left out); an empty table gives no rows.
    """
    bins = cut(first_round(docs, key, text, capacity, vocabulary))
    done, rounds = [bins.where("full")], 1
    rest = bins.where(~F.col("full"))
    count = rest.count()
    partitions = max(1, bins.rdd.getNumPartitions())
    while count:
        partitions = max(1, -(-partitions // FAN_IN), -(-count // TASK_ITEMS))
        packed = cut(next_round(rest, partitions, capacity, MARKS[min(rounds, len(MARKS) - 1)]))
        left = packed.where(~F.col("full"))
        bins_now, rounds = packed.count(), rounds + 1
        if partitions == 1 or bins_now > (1 - GAIN) * count:
            done.append(packed)
            break
        done.append(packed.where("full"))
        rest, count = left, left.count()
    whole = done[0]
    for x in done[1:]:
        whole = whole.unionAll(x)
    name = F.array_min(F.transform("pieces", lambda p: F.struct(p["key"], p["part"])))
    rows = whole.select(F.concat_ws(":", name["key"].cast("string"), name["part"].cast("string")).alias("container"), "fill", F.explode("pieces").alias("p"))
    placed = rows.select(F.col("p.key").alias(key), F.col("p.part").alias("part"), F.col("p.start").alias("start"), F.col("p.n").alias("n_tokens"), "container", "fill")
    empty = docs.where(F.col(key).isNotNull() & (F.coalesce(F.length(text), F.lit(0)) == 0))
    nothing = empty.select(F.col(key).cast("bigint"), F.lit(0).alias("part"), F.lit(0).alias("start"), F.lit(0).alias("n_tokens"), F.lit(None).cast("string").alias("container"), F.lit(None).cast("int").alias("fill"))
    return placed.unionByName(nothing)


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per container: pieces, tokens and unused space."""
    return packed.where("container is not null").groupBy("container").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens")).withColumn("unused", F.lit(capacity) - F.col("n_tokens"))


def _p7(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), "doc_id", "text")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers that can hold them, unused places, greatest fill, texts without tokens."""
    none = packed.agg(F.count_if(F.col("container").isNull()).alias("n_without_tokens"))
    c = containers(packed, capacity).agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum("unused"), F.lit(0)).alias("unused"), F.max("n_tokens").alias("most"))
    least = F.ceil(F.col("n_tokens") / capacity).alias("least_possible")
    return c.select("n_containers", "n_tokens", least, "unused", "most", none.scalar().alias("n_without_tokens"))


def _p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill(cut(_p7(spark, d)))


QUERIES = {"p7_containers": _p7, "p7_fill": _p7_fill}
ORACLES: dict[str, str] = {}
