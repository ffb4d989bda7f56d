"""Every query with SQL against DuckDB on the smallest tables; plans free of what does not scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lectern.plans.queries import ORACLES, QUERIES
from lectern.plans.tables import GIVEN


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or (not isinstance(x, str) and pd.isna(x)):
            return "null"
        return str(x) if isinstance(x, str) else f"{float(x):.6f}"

    return sorted(tuple(map(cell, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "rank" in df.columns


@pytest.mark.parametrize("name", ["r2_p10_batch_search", "r6_merge_probes", "k1_content_build", "a6_context_text", "k5_enrich_content", "u4_apply_selection"])
def test_plans_have_no_cartesian_product_or_row_udf(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BatchEvalPython" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["c6_not_published"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "PushedFilters: [IsNotNull(l_shipdate)" in plan
