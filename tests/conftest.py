"""One local session for all tests, and small tables cut from the smallest test data."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small(tmp_path_factory) -> str:
    """A folder with small cuts of all tables."""
    import duckdb

    out, src = tmp_path_factory.mktemp("tables"), "/root/testdata/sf0.001"
    keep = {"documents": 40, "events": 200, "embeddings": 60, "lineitem": 100, "orders": 200}
    for t in TABLES:
        limit = f"limit {keep[t]}" if t in keep else ""
        duckdb.sql(f"copy (select * from '{src}/{t}.parquet' order by 1 {limit}) to '{out}/{t}.parquet' (format parquet)")
    return str(out)
