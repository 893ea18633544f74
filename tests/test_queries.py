"""Every registered query of the engine against its SQL."""

import math
from decimal import Decimal

import duckdb
import pytest

from scorewright.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, Decimal) else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=str)
    assert got
    if name in catalog.ORACLES:
        rel = db.sql(catalog.ORACLES[name])
        order = [list(rel.columns).index(c) for c in df.columns]
        assert len(order) == len(rel.columns)
        assert got == sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=str)


@pytest.fixture
def merged_ranges(spark):
    """As on large tables: bounds of ranges are drawn from a part of the rows, and ranges are merged by their bytes."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "2", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["jsonl_scan", "line_scan", "rank_percentile"])
def test_query_over_merged_ranges(merged_ranges, db, name):
    """F2, F3, F4."""
    test_query(merged_ranges, db, name)


def test_entry_module_without_the_guarded_parts(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["role", "n", "exact_match", "raw_match"]
