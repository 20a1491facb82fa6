"""Expression data with what is known of its genes and samples, and the text files they come in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .orthologs import long_to_profiles


@dataclass(frozen=True)
class Expression:
    """profiles: species, gene, samples, values. genes: species, gene, hog and metadata. samples: species, sample and metadata."""

    profiles: DataFrame
    genes: DataFrame
    samples: DataFrame

    def gene_hogs(self) -> DataFrame:
        """(species, gene, hog) of the genes with a group."""
        return self.genes.where(F.col("hog").isNotNull()).select("species", "gene", "hog")


def build_expression(
    data: DataFrame, species: list[str] | str | None = None, value: str = "vst.count", gene: str = "gene_id", sample: str = "sample_id", species_column: str = "abbrev", hog: str | None = "HOG",
    gene_metadata: list[str] = (), sample_metadata: list[str] = (), order: str | None = None,
) -> Expression:
    """Expression of ``species`` (None: all) from a long table.

    Of a repeated (gene, sample) the row with the greatest ``order`` counts, without it the greatest value. Genes lack the
    samples they have no row for. A gene's or sample's metadata are those of its least row (by order, then by the columns
    themselves). Raises ValueError for missing columns and for species without rows; a table without the hog column gives null groups.
    """
    need = [species_column, gene, sample, value]
    if missing := [c for c in need if c not in data.columns]:
        raise ValueError(f"data lack {missing}")
    q = lambda c: F.col(f"`{c}`")
    wanted = [species] if isinstance(species, str) else species
    rows = data if wanted is None else data.where(q(species_column).isin(list(wanted)))
    if wanted is not None:
        have = {r[0] for r in rows.select(q(species_column)).distinct().collect()}  # at most the wanted ones
        if missing := set(wanted) - have:
            raise ValueError(f"no rows of {sorted(missing)}")

    def first(key: str, name: str, columns: list[str]) -> DataFrame:
        kept = [c for c in columns if c in data.columns]
        rank = F.struct(*([q(order).alias("_o")] if order else []), *[q(c).alias(f"_{k}") for k, c in enumerate(kept)])
        g = rows.groupBy(q(species_column).alias("species"), q(key).alias(name)).agg(F.min(rank).alias("_r"))
        return g.select("species", name, *[F.col(f"_r._{k}").alias(c) for k, c in enumerate(kept)]) if kept else g.select("species", name)

    have_hog = hog is not None and hog in data.columns
    genes = first(gene, "gene", [*([hog] if have_hog else []), *gene_metadata])
    genes = genes.withColumnRenamed(hog, "hog") if have_hog else genes.withColumn("hog", F.lit(None).cast("string"))
    flat = rows.select(q(species_column).alias("sp"), q(gene).alias("g"), q(sample).alias("s"), q(value).cast("double").alias("v"), *([q(order).alias("o")] if order else []))
    return Expression(long_to_profiles(flat, "sp", "g", "s", "v", "o" if order else None), genes, first(sample, "sample", list(sample_metadata)))


def read_expression(spark: SparkSession, path: str, species: str) -> DataFrame:
    """(species, gene, samples, values) of a tab-separated matrix: gene names first, then one column per sample; rows without a name are left out."""
    t = spark.read.csv(path, sep="\t", header=True, quote="")
    gene, *names = t.columns
    if not names:
        raise ValueError(f"{path} has no samples")
    samples = sorted(names)
    values = F.array(*[F.col(f"`{c}`").try_cast("double") for c in samples])
    return t.where(F.col(f"`{gene}`").isNotNull()).select(F.lit(species).alias("species"), F.col(f"`{gene}`").alias("gene"), F.array(*map(F.lit, samples)).alias("samples"), values.alias("values"))


def read_orthologs(spark: SparkSession, path: str, species1: str, species2: str) -> DataFrame:
    """(sp1, sp2, gene1, gene2, hog) of a tab-separated file with Species1, Species2 (genes) and hog; rows with a null in them are left out."""
    t = spark.read.csv(path, sep="\t", header=True, quote="")
    if missing := {"Species1", "Species2", "hog"} - set(t.columns):
        raise ValueError(f"{path} lacks {sorted(missing)}")
    return t.select(F.lit(species1).alias("sp1"), F.lit(species2).alias("sp2"), F.col("Species1").alias("gene1"), F.col("Species2").alias("gene2"), F.col("hog").cast("string").alias("hog")).dropna()
