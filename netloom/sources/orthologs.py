"""Ortholog and expression sources: group files, long tables, groups shared by two species."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .tables import cut

PAIRED = "sp1 string, sp2 string, gene1 string, gene2 string, hog string"


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """A (gzipped) tab-separated file with species, gene_id, gene_content."""
    return spark.read.csv(path, sep="\t", header=True, schema="species string, gene_id string, gene_content string", quote="")


def parse_orthologs(groups: DataFrame, species1: str, species2: str, exact_prefix: bool = False) -> DataFrame:
    """(Species1, Species2, hog) of two species.

    Rows of species1 are kept; hog is the dense index of their distinct gene_content in sorted order, taken before
    species2 is looked at; entries (split by ;) that contain species2 anywhere are kept (``exact_prefix``: only those
    whose code is species2), and their genes (behind the colon, split by comma) are emitted one per row.
    Only the distinct contents are sorted, in ranges that are numbered side by side.
    """
    rows = groups.where(F.col("species") == species1).where(F.col("gene_content").isNotNull())
    numbered = dense_index(rows.select("gene_content").distinct(), "gene_content", "hog")
    entry = F.explode(F.split("gene_content", ";"))
    e = rows.join(numbered, "gene_content").select("gene_id", "hog", entry.alias("entry"))
    e = e.where(F.split("entry", ":")[0] == species2) if exact_prefix else e.where(F.contains("entry", F.lit(species2)))
    gene = F.explode(F.split(F.split("entry", ":")[1], ","))
    return e.select(F.col("gene_id").alias("Species1"), gene.alias("Species2"), F.col("hog").cast("string").alias("hog"))


def dense_index(values: DataFrame, column: str, name: str) -> DataFrame:
    """``values`` (distinct) with their place from 1 in sorted order: ranges are sorted and counted side by side, only their sizes meet."""
    parts = cut(values.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # one row per range
    starts = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    at = F.row_number().over(W.partitionBy("_part").orderBy(column))
    return parts.withColumn("_at", at).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_at")).cast("long")).drop("_part", "_at", "_start")


def long_to_profiles(data: DataFrame, species: str, gene: str, sample: str, value: str, order: str | None = None) -> DataFrame:
    """(species, gene, samples, values): one row per gene, samples sorted; of a repeated (gene, sample) the value with the greatest ``order`` counts, without it the greatest value.

    Long tables become arrays, not one column per sample, so the number of samples is no limit. Genes lack samples they
    have no row for.
    """
    one = data.groupBy(F.col(species).alias("species"), F.col(gene).alias("gene"), F.col(sample).alias("sample")).agg((F.max(value) if order is None else F.max_by(value, F.struct(order, value))).alias("value"))
    packed = one.groupBy("species", "gene").agg(F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("x"))
    return packed.select("species", "gene", F.col("x.sample").alias("samples"), F.col("x.value").alias("values"))


#: Rows of a group from which its pairs are made block by block, and the most groups that are.
HOT_ROWS, MAX_HOT = 2_000, 10_000


def extract_orthologs(rows: DataFrame, pairs: str = "sp1 < sp2") -> DataFrame:
    """Orthologs of all species pairs from (species, gene, hog): genes of a shared non-null hog, an equi-join on the group.

    The result has every pair of a group, as asked. A group of more than max(HOT_ROWS, rows / MAX_HOT) rows (at most
    MAX_HOT of them whatever the input, so their sizes are broadcast) is cut into blocks that meet the other side one by one.
    """
    r = rows.where(F.col("hog").isNotNull()).select("species", "gene", "hog")
    sizes = r.groupBy("hog").agg(F.count("*").alias("n"))
    many = F.greatest(F.lit(HOT_ROWS), F.expr(f"_all div {MAX_HOT}"))
    hot = sizes.withColumn("_all", r.agg(F.count("*")).scalar()).where(F.col("n") > many).select("hog", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("nb"))
    x = r.join(F.broadcast(hot), "hog", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    a = x.select(F.col("species").alias("sp1"), F.col("gene").alias("gene1"), "hog", F.pmod(F.xxhash64("species", "gene"), F.col("nb")).cast("int").alias("block"))
    b = x.select(F.col("species").alias("sp2"), F.col("gene").alias("gene2"), "hog", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"))
    return a.join(b, ["hog", "block"]).where(pairs).select("sp1", "sp2", "gene1", "gene2", F.col("hog").cast("string").alias("hog"))


def prepare_orthologs(rows: DataFrame, gene_map: DataFrame) -> DataFrame:
    """As :func:`extract_orthologs` with genes replaced by their representatives (species, original, representative), distinct.

    Unmapped genes keep their name.
    """
    m = rows.join(gene_map.select("species", F.col("original").alias("gene"), "representative"), ["species", "gene"], "left")
    return extract_orthologs(m.select("species", F.coalesce("representative", "gene").alias("gene"), "hog").distinct()).distinct()
