"""Readers for the parquet tables a query works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``directory`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def unblank(c: Column | str) -> Column:
    """``c`` without spaces and tabs at either end; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.btrim(c, F.lit(" \t"))
    return F.when(t != "", t)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; one is set only where none is configured."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        conf = tempfile.mkdtemp(prefix="netloom-checkpoint-")  # one machine: tests only
    sc.setCheckpointDir(conf)
    return conf


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: later actions don't recompute it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` by ``by`` over all cores, for costly work per row: few bytes would be coalesced into one task."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)
