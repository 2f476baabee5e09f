"""Registered queries: same result as their SQL, and plans that scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, rows_of
from findmill.plans.registry import QUERIES

PYTHON = {"review_findings", "title_ratio", "corroborated_findings", "duplicate_groups", "merged_findings"}
NATIVE = [n for n in QUERIES if n not in PYTHON and not n.startswith("model_")]


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_same_rows_as_sql(spark, sf_dir, oracle, name):
    df = entry.queries()[name](spark, sf_dir)
    result = oracle.sql(entry.oracle_sql()[name])
    columns = result.columns
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


@pytest.mark.parametrize("name", NATIVE)
def test_plans_have_no_product_and_no_python(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroups"):
        assert word not in plan


def test_filters_reach_the_scan(spark, tmp_path):
    from findmill import schemas
    from findmill.operators import marts

    spark.createDataFrame([], schemas.STORED_FINDINGS).write.parquet(str(tmp_path / "f"))
    found = spark.read.schema(schemas.STORED_FINDINGS).parquet(str(tmp_path / "f"))
    plan = marts.filter_findings(found, severity="high").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(severity,HIGH)" in plan and "struct<id:bigint,severity:string>" in plan


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "merged_from" in df.columns


def test_all_rules_are_hit(spark):
    from findmill.rulepack import RULES

    hits = entry.queries()["rule_hits"](spark, "/root/testdata/sf0.01")
    assert {r.rule_id for r in hits.select("rule_id").distinct().collect()} == {rule[0] for rule in RULES}
