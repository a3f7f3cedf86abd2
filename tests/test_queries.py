"""Registered queries against their SQL."""

import os

import pytest

import __spark_entry__ as entry_points
from compare import connect, differences
from kicknet.operators.ambiguity import DPAC, resolve_ambiguous
from kicknet.operators.matching import anti_join_all
from kicknet.plans.oracles import ORACLES
from kicknet.plans.registered import QUERIES
from kicknet.sources import driver_tables as D

FOLDER = os.environ.get("KICKNET_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    problem, *_ = differences(spark, connect(FOLDER), QUERIES[name], ORACLES[name], FOLDER)
    assert problem is None, problem


def test_flagship(spark):
    assert entry_points.entry(spark).count() > 0


def one_sample(text: str, year: str) -> str:
    """The observations with a third of all rows in one sample."""
    hot = "l_orderkey % 3 = 0"
    return (
        text.replace("cast(l_suppkey as varchar(20)) as site", f"case when {hot} then 'HOT' else cast(l_suppkey as varchar(20)) end as site")
        .replace(f"{year} as start_date", f"case when {hot} then date'2000-01-01' else {year} end as start_date")
        .replace("case when l_linenumber%2=0 then '10:30'", f"case when l_linenumber%2=0 and not ({hot}) then '10:30'")
    )


@pytest.mark.parametrize("name", ["drop_redundant", "resolve_aptc", "rarefy"])
def test_a_third_of_all_rows_in_one_sample(spark, monkeypatch, name):
    monkeypatch.setattr(D, "OBSERVATIONS_SQL", one_sample(D.OBSERVATIONS_SQL, "{year}"))
    sql = one_sample(ORACLES[name], D.DUCKDB_YEAR)
    assert "'HOT'" in sql and "2000-01-01" in sql
    problem, *_ = differences(spark, connect(FOLDER), QUERIES[name], sql, FOLDER)
    assert problem is None, problem


EAGER_SPLITS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
}


def test_hot_join_keys_are_split(spark):
    """One line of one sample holds most rows; the joins back to the rows are split at run time."""
    rows = spark.range(0, 60000, 1, 6).selectExpr(
        "if(id % 10 < 8, 'HOT', cast(id as string)) as site",
        "if(id % 10 < 8, 'g', null) as genus",
        "'t' as tribe",
        "1.0 as count",
        "id as seq",
    )
    for name, value in EAGER_SPLITS.items():
        spark.conf.set(name, value)
    try:
        resolved = resolve_ambiguous(rows, "site", ["genus", "tribe"], method=DPAC)
        anti = anti_join_all(rows.drop("seq"), rows.selectExpr("'none' as site", "genus", "tribe", "count"))
        for df in (resolved, anti):
            assert len(df.collect()) == 60000
            assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in EAGER_SPLITS:
            spark.conf.unset(name)
