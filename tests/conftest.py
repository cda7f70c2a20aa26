import os
import sys

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(shared / "checkpoints"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def canonical(frame) -> list[tuple]:
    """Rows with columns in name order, floats rounded, sorted."""

    def value(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, float):
            return round(v, 9)
        if hasattr(v, "item"):
            return value(v.item())
        return v if isinstance(v, (int, str, bool)) else str(v)

    cols = sorted(frame.columns)
    return sorted((tuple(map(value, r)) for r in frame[cols].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{sf_dir}/{name}')")
    return con
