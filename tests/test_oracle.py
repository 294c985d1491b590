"""Every query with oracle SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

from annoflux.plans import registry

NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    expected = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.collect(), df.columns) == rows(expected.fetchall(), expected.columns)


@pytest.mark.parametrize("name", ["w1_genome_support", "b3_evaluation", "o8_short_orf_rescue"])
def test_order_of_input_does_not_matter(spark, sf_dir, name, tmp_path):
    """The same tables in another order and partitioning give the same rows."""
    from pyspark.sql import functions as F

    for t in ("documents", "lineitem", "part", "orders"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").orderBy(F.rand(3)).repartition(5).write.parquet(f"{tmp_path}/{t}.parquet")
    query = registry.queries()[name]
    a, b = query(spark, sf_dir), query(spark, str(tmp_path))
    assert rows(a.collect(), a.columns) == rows(b.collect(), b.columns)
