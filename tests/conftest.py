import numbers
import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Compares a query on the small tables with its SQL, without regard to order."""

    def values(frame):
        return sorted(repr([None if x is None or x is pd.NA or x != x else round(float(x), 6) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x) for x in row]) for row in frame[sorted(frame.columns)].itertuples(index=False))

    def check(query, sql):
        ours, theirs = query(spark, DATA).toPandas(), duck.execute(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert values(ours) == values(theirs)

    return check
