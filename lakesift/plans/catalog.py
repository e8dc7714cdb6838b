"""Registered queries of the bundle-risk engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakesift.functions.dialect import Dialect, Duck
from lakesift.operators import lock, provenance, reports, rules, scan, update
from lakesift.sources import archives, bundles

FLAGSHIP = "inspect_bundle"
_SQL = {**bundles.QUERIES, **rules.QUERIES, **provenance.QUERIES}


def _query(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(make(Dialect(sf_dir)))

    return run


#: Queries of the second part have no SQL that DuckDB can run; tests hold them against rows made by hand.
QUERIES = {name: _query(make) for name, make in _SQL.items()} | scan.QUERIES | lock.QUERIES | archives.QUERIES | update.QUERIES | reports.QUERIES
ORACLE_SQL: dict[str, str] = {name: make(Duck()) for name, make in _SQL.items()} | lock.ORACLE_SQL | archives.ORACLE_SQL | reports.ORACLE_SQL
