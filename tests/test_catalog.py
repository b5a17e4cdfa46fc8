"""Registered queries against their SQL, and the plans they run."""

import importlib.util
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_DIR
from shelfsight.plans import catalog, oracle

# Every query is compared by the driver; these cover each family here.
COMPARED = ["table_profile", "csv_round_trip", "fk_check", "fill_numeric_defaults", "monthly_features",
            "promo_month", "correlation_matrix", "quantiles", "stratified_split", "arima_backtest",
            "inventory_plan", "shop_profit", "isolation_forest_contract", "seasonal_regression_backtest",
            "sales_class_by_region", "label_dictionary", "linear_regression", "sequence_regression",
            "sequence_regression_total"]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in "region nation supplier part orders lineitem".split():
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", COMPARED)
def test_query_matches_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())))
    result = sql.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) - set(oracle.oracle_sql()) == {
        "random_forest_reg", "deep_forest_reg", "gradient_boosting", "model_comparison", "forecast_next", "sales_classifier",
        "isolation_forest"}


def test_entry_answers(spark):
    assert entry.entry(spark).count() == 8


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_monthly_features_plan(spark):
    text = plan(entry.queries()["monthly_features"](spark, SF_DIR))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # one shuffle and one sort by series for all lags, rolling means and the target
    assert text.count("hashpartitioning(shop_id") == 1
    assert "l_tax" not in text and "l_comment" not in text


@pytest.mark.parametrize("name", ["arima_backtest", "stratified_split"])
def test_no_python_and_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_facts_and_inventory_share_their_partitioning(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(entry.queries()["enrich_inventory"](spark, SF_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one exchange per side, made by the aggregations and reused by the join
    assert text.count("hashpartitioning(year_month") == 2 and "SortMergeJoin" in text


def test_retail_queries_stay_when_a_package_is_missing(monkeypatch):
    """The training-data folder may not import: its queries go, the others stay."""
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("shelfsight.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    spec = importlib.util.spec_from_file_location("entry_again", entry.__file__)
    again = importlib.util.module_from_spec(spec)
    with pytest.warns(UserWarning, match="left out"):
        spec.loader.exec_module(again)
    assert set(again.queries()) == set(catalog.QUERIES) and set(again.oracle_sql()) == set(oracle.oracle_sql())


def test_correlation_passes_over_the_features_without_writing_them(spark, monkeypatch):
    """One pass: the feature table flows into the moments."""
    def refused(df, name):
        raise AssertionError(f"{name} is written")

    monkeypatch.setattr(catalog, "stage", refused)
    catalog.QUERIES["correlation_matrix"](spark, SF_DIR)
