"""One local session and one DuckDB connection for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{work}/shared")
        .config("spark.sql.warehouse.dir", f"{work}/warehouse").config("spark.local.dir", f"{work}/local").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return connection


def normal(rows, columns) -> list[tuple]:
    """Rows as sorted text, columns by name; numbers to nine digits."""
    def one(v):
        if v is None or v != v:
            return "~"
        return f"{v:.9g}" if isinstance(v, float) else str(list(v)) if isinstance(v, (list, tuple)) else str(v)

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def same(frame, relation) -> None:
    """A DataFrame against a DuckDB relation: names and rows."""
    assert sorted(frame.columns) == sorted(relation.columns)
    assert normal([tuple(r) for r in frame.collect()], frame.columns) == normal(relation.fetchall(), relation.columns)
