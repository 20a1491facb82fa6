"""All-pairs similarity of profiles: variance filter, Pearson and Spearman correlation in blocks.

Profiles are standardised once, cut into blocks of ``BLOCK`` genes, and every unordered pair of blocks of a species is
one group: a matrix product in an Arrow task that holds two blocks. A block is sent to as many groups as there are
blocks, which is the least an all-pairs product needs without gathering a species in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Genes in a block: a task multiplies two blocks.
BLOCK = 512
#: Decimals kept of a correlation, so that equal profiles tie exactly.
DECIMALS = 10


def sample_variance(values: str) -> Column:
    """Sample variance (n - 1) of an array column; null for fewer than two values."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("ss"))

    def step(a: Column, x: Column) -> Column:  # one pass; a mean taken beforehand would be computed again for every element
        n, delta = a["n"] + 1.0, x - a["mean"]
        mean = a["mean"] + delta / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["ss"] + delta * (x - mean)).alias("ss"))

    return F.aggregate(values, start, step, lambda a: F.when(a["n"] > 1, a["ss"] / (a["n"] - 1)))


def variance_filter(profiles: DataFrame, min_var: float | None = 0.0) -> DataFrame:
    """Genes whose variance exceeds ``min_var`` (strictly); None keeps all."""
    return profiles if min_var is None else profiles.where(sample_variance("values") > min_var)


def row_ranks(x: np.ndarray) -> np.ndarray:
    """Row-wise ranks, ties sharing their mean."""
    order = np.argsort(x, axis=1, kind="stable")
    out = np.empty_like(x)
    for r, o in enumerate(order):
        v = x[r, o]
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        last = np.r_[first[1:], len(v)]
        out[r, o] = np.repeat((first + last + 1) / 2, last - first)
    return out


def standard_rows(x: np.ndarray, method: str = "pearson") -> np.ndarray:
    """Rows centred and scaled to length 1 (their ranks for spearman); constant rows become zeros."""
    if method == "spearman":
        x = row_ranks(x)
    x = x - x.mean(axis=1, keepdims=True)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def standardised(profiles: DataFrame, method: str = "pearson") -> DataFrame:
    """(species, gene, z): standard rows, batch by batch."""
    if method not in ("pearson", "spearman"):
        raise ValueError("method must be pearson or spearman")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = standard_rows(np.array(b.column(2).to_pylist(), dtype=np.float64), method)
            ends = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["species", "gene", "z"])

    return profiles.select("species", "gene", "values").mapInArrow(run, "species string, gene string, z array<double>")


_PAIRS = pa.schema([("species", pa.string()), ("i", pa.string()), ("j", pa.string()), ("r", pa.float64())])


def _product(t: pa.Table) -> pa.Table:
    """Correlations i < j of one pair of blocks."""
    bi, bj = t["bi"][0].as_py(), t["bj"][0].as_py()
    block = t["b"].to_numpy()
    genes = np.array(t["gene"].to_pylist(), dtype=object)
    z = np.stack(t["z"].to_numpy(zero_copy_only=False)) if t.num_rows else np.zeros((0, 1))
    left, right = block == bi, block == bj
    r = np.round(np.clip(z[left] @ z[right].T, -1, 1), DECIMALS) + 0.0
    gi, gj = genes[left], genes[right]
    a, b = np.triu_indices(len(gi), 1) if bi == bj else map(np.ravel, np.indices(r.shape))
    x, y = gi[a], gj[b]
    swap = x > y
    i, j = np.where(swap, y, x), np.where(swap, x, y)
    sp = t["species"][0].as_py()
    return pa.Table.from_arrays([pa.array([sp] * len(i), pa.string()), pa.array(i, pa.string()), pa.array(j, pa.string()), pa.array(r[a, b])], schema=_PAIRS)


def correlations(profiles: DataFrame, method: str = "pearson", absolute: bool = False, block: int = BLOCK) -> DataFrame:
    """(species, i, j, r) for all pairs of genes i < j of a species, r within [-1, 1].

    A species of one gene has no pair; genes must be unique within a species; profiles of a species have equal length.
    """
    sizes = profiles.groupBy("species").agg(F.count("*").alias("n"))
    z = standardised(profiles, method).join(sizes, "species").withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
    z = z.withColumn("b", F.pmod(F.xxhash64("gene"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    keyed = z.withColumn("o", other).select("species", "gene", "z", "b", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"))
    r = keyed.groupBy("species", "bi", "bj").applyInArrow(_product, "species string, i string, j string, r double")
    return r.withColumn("r", F.abs("r")) if absolute else r
