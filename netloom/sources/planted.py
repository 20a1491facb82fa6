"""Expression data of four species with planted structure, derived from the ``embeddings`` table.

A vector is a gene; it is present in species s unless vec_id % 7 = s. Its profile is its own vector plus that of its
programme plus noise from another vector. Two genes share a group (``hog``). Some groups' programmes depend on the trait.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import table

SPECIES = ("SP_A", "SP_B", "SP_C", "SP_D")
TRAITS = {"SP_A": "annual", "SP_B": "perennial", "SP_C": "annual", "SP_D": "perennial"}


def expression(spark: SparkSession, directory: str, species: tuple[str, ...] = SPECIES) -> DataFrame:
    """(species, gene, hog, label, values): one row per gene and species."""
    e = table(spark, directory, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")
    n = e.count()
    wanted = [i for i, s in enumerate(SPECIES) if s in species]
    s = F.col("s")
    h = F.floor(F.col("vec_id") / 2) % 8
    programme = F.when(h == 3, (F.col("label") + 5 * (s % 2)) % 10).when((h == 6) & (s % 2 == 1), (F.col("label") + 2 * s + 1) % 10).otherwise(F.col("label"))
    g = e.withColumn("s", F.explode(F.array(*map(F.lit, wanted)))).where(F.col("vec_id") % 7 != s)
    g = g.withColumn("c", programme.cast("long")).withColumn("o", (7 * F.col("vec_id") + 13 * (s + 1)) % n)
    other = e.select(F.col("vec_id").alias("o"), F.col("e").alias("eo"))
    centre = e.where("vec_id < 10").select(F.col("vec_id").alias("c"), F.col("e").alias("ec"))
    x = g.join(other, "o").join(F.broadcast(centre), "c")  # ten rows
    v = F.zip_with(F.zip_with("e", "ec", lambda a, b: a + F.lit(0.8) * b), "eo", lambda a, b: a + F.lit(0.6) * b)
    letter = F.element_at(F.array(*map(F.lit, "ABCD")), (s + 1).cast("int"))
    return x.select(F.concat(F.lit("SP_"), letter).alias("species"), F.concat(letter, F.col("vec_id").cast("string")).alias("gene"), F.concat(F.lit("H"), F.floor(F.col("vec_id") / 2).cast("string")).alias("hog"), F.col("label").cast("int").alias("label"), v.alias("values"))


def traits(spark: SparkSession) -> DataFrame:
    """(species, trait) of the four species."""
    return spark.createDataFrame(list(TRAITS.items()), "species string, trait string")
