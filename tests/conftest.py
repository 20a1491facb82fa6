import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from netloom.plans.ship import ship

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s


@pytest.fixture(scope="session")
def same(spark):
    """Runs a query and its SQL over the smallest tables and compares them as sorted rows."""
    import glob
    import os

    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"create view {os.path.basename(p)[:-8]} as from '{p}'")

    def text(v):
        if isinstance(v, float):
            return f"{v:.6g}"
        return str(v)

    def check(name):
        df = entry.queries()[name](spark, DATA)
        cols = sorted(df.columns)
        mine = sorted(tuple(map(text, r)) for r in df.select(*cols).collect())
        r = db.sql(entry.oracle_sql()[name])
        assert sorted(r.columns) == cols
        theirs = sorted(tuple(map(text, x)) for x in r.project(", ".join(f'"{c}"' for c in cols)).fetchall())
        assert mine == theirs
        return len(mine)

    return check
