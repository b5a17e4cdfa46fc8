from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from shelfsight.operators import decisions as D
from shelfsight.operators.sampling import series_holdout
from shelfsight.operators.series import arima_backtest, seasonal_fits
from shelfsight.plans import features as P
from shelfsight.plans.report import write_reports
from shelfsight.sources import readers, staging
from shelfsight.sources.store import load_model


def test_profit_identity(monthly, raw):
    t = P.valid_tables(raw)
    out = D.shop_profit(monthly, t["shops"])
    assert out.where("abs(total_revenue - total_cost - total_profit) > 0.001").count() == 0
    profits = [r["total_profit"] for r in out.collect()]
    assert profits == sorted(profits, reverse=True) and len(profits) == 10


def test_plan_and_what_if(spark):
    forecast = spark.createDataFrame([(1, 1, 10.0, 100.0), (1, 2, 20.0, None), (2, 1, 0.0, 300.0)],
                                     "shop_id long, item_id long, pred_qty_next_month double, mrp_inr double")
    what = {(r["shop_id"], r["item_id"]): r for r in D.whatif_price(forecast).collect()}
    assert what[1, 1]["whatif_pred_qty_next_month"] == pytest.approx(9.75)
    assert what[1, 2]["whatif_new_price"] == pytest.approx(220.0)  # median of 100 and 300, plus 10 %
    stock = spark.createDataFrame([("2020-02", 1, 1, 4.0, 1.0, 3.0, 2), ("2020-02", 1, 2, 90.0, 1.0, 3.0, 2)],
                                  "year_month string, shop_id long, item_id long, avg_on_hand double, "
                                  "avg_reorder_point double, avg_lead_time double, inv_snapshots long")
    plan = {(r["shop_id"], r["item_id"]): r for r in D.inventory_plan(forecast, stock).collect()}
    assert plan[1, 1]["reorder_qty_suggested"] == pytest.approx(7.5)
    assert plan[1, 2]["reorder_qty_suggested"] == 0.0
    assert plan[2, 1]["avg_lead_time"] == 7.0
    items = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "item_id long, item_name string, item_category_id long")
    totals = [(r["item_id"], r["pred_qty_next_month"], r["pred_qty_next_year"])
              for r in D.forecast_items(forecast, items).collect()]
    assert totals == [(2, 20.0, 240.0), (1, 10.0, 120.0)]


def test_latest_inventory_ignores_unknown_dates(spark):
    df = spark.createDataFrame([(1, "2020-01-05", 9), (2, "2020-02-02", 4), (3, None, 1)],
                               "inventory_snapshot_id long, d string, on_hand_qty int").select(
        "*", F.to_date("d").alias("week_ending_date"), F.lit(1).alias("shop_id"), F.lit(1).alias("item_id"),
        F.lit(5).alias("reorder_point_qty"), F.lit(3).alias("supplier_lead_time_days"))
    assert [(r["year_month"], r["avg_on_hand"]) for r in D.latest_inventory(df).collect()] == [("2020-02", 4.0)]


def test_csv_with_bom_quotes_and_missing_tokens(spark, tmp_path):
    text = '﻿Shop_ID , shop_city,store_size_sqft\n1,"a, ""b""",12\n9007199254740993,NA,x\n3.0,,7\n'
    (tmp_path / "shops.csv").write_text(text, encoding="utf-8")
    df = readers.typed(readers.read_csv_table(spark, str(tmp_path / "shops.csv")), "shops")
    assert [tuple(r) for r in df.collect()] == [(1, 'a, "b"', 12), (9007199254740993, None, None), (3, None, 7)]


def test_staging_folder():
    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    def session(master, named=None):
        return SimpleNamespace(sparkContext=Context(master), conf=SimpleNamespace(get=lambda key, default: named))

    assert staging.staging_root(session("yarn", "s3://shared/x/")) == "s3://shared/x"
    with pytest.raises(RuntimeError):
        staging.staging_root(session("yarn"))
    local = session("local[2]")
    assert staging.staging_root(local) == staging.staging_root(local) == local.sparkContext.folder


def test_all_reports_from_csv(spark, raw, tmp_path):
    """The seven tables as CSV in, every result table and model out."""
    for name, df in raw.items():
        df.write.option("header", True).csv(str(tmp_path / "in" / f"{name}.csv"))
    tables = readers.read_tables(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    write_reports(tables, out, trees=3, depth=3, stages=2)
    features = spark.read.parquet(f"{out}/monthly_features_parquet")
    assert features.count() == readers.read_csv_table(spark, f"{out}/monthly_features").count() > 4000
    for name in ["model_comparison_regression", "model_comparison_arima_top_series",
                 "model_comparison_seasonal_top_series", "model_comparison_total_series",
                 "forecast_next_month_shop_item", "forecast_next_month_items", "forecast_items_month_and_year",
                 "profit_ranking_shops", "whatif_price_increase", "inventory_reorder_plan_next_month",
                 "classification_confusion_matrix", "classification_report", "anomalies"]:
        assert spark.read.option("header", True).csv(f"{out}/{name}").count() > 0, name
    for name in ["encoder/dictionary", "encoder/columns", "encoder_sales_classes/dictionary", "arima_parameters",
                 "seasonal_coefficients", "model_sequence/coefficients", "model_LinearRegression/coefficients",
                 "model_isolation_forest/nodes", "model_isolation_forest/facts"]:
        assert spark.read.parquet(f"{out}/{name}").count() > 0, name
    for name in ["scaler", "model_RandomForestRegressor", "model_GradientBoostingRegressor", "model_sales_classes"]:
        assert load_model(spark, f"{out}/{name}").uid, name
    assert set(spark.read.option("header", True).csv(f"{out}/profit_ranking_shops").columns) == {
        "shop_id", "total_revenue", "total_cost", "total_profit", "total_qty",
        "shop_city", "shop_state", "shop_region"}


def test_malformed_lines_are_set_aside(spark, tmp_path):
    """Every line is read or in the quarantine, with its file and the reason."""
    folder = tmp_path / "shops.csv"
    folder.mkdir()
    header = "shop_id,shop_city,shop_state,shop_region,shop_name,store_type,store_size_sqft,opening_date\n"
    (folder / "a.csv").write_text(header + '1,"a, ""b""",s,r,n,t,12,2020-01-31\n2,x,s,r,n,t,,NA\n3,short\n')
    (folder / "b.csv").write_text(header + "4,x,s,r,n,t,big,2020-01-01\nx5,x,s,r,n,t,1,2020-01-01\n"
                                  "6,x,s,r,n,t,1,someday\n7,x,s,r,n,t,1,2020-01-01,more\n")
    rows, bad = readers.read_csv_checked(spark, str(folder), "shops")
    assert sorted((r["shop_id"], r["shop_city"], r["store_size_sqft"], r["opening_date"]) for r in rows.collect()) == [
        ("1", 'a, "b"', "12", "2020-01-31"), ("2", "x", None, None)]
    got = {(r["file"].rsplit("/", 1)[1], r["reason"], r["line"][:2]) for r in bad.collect()}
    assert got == {("a.csv", "number of fields", "3,"), ("b.csv", "no number: store_size_sqft", '["'),
                   ("b.csv", "no number: shop_id", '["'), ("b.csv", "no date: opening_date", '["'),
                   ("b.csv", "number of fields", "7,")}
    assert rows.select("shop_id").count() == 2 and bad.count() == 5  # the same whatever columns are asked for


def test_checked_lines_are_judged_as_the_operators_read_them(spark, tmp_path):
    """A text is set aside just if ``numeric`` makes no number of it; lines are counted in one scan of the files."""
    values = ["1", " 1.5 ", ".5", "5.", "-3e2", "1e999", "+inf", "Infinity", "nan", "12d", "0x1p3", "1-2", "--1", ".", "x",
              "", "NA", "1e", "\u0661"]
    folder = tmp_path / "items.csv"
    folder.mkdir()
    header = ",".join(readers.TABLES["items"]) + "\n"
    (folder / "a.csv").write_text(header + "".join(f'{i},n,1,b,t,p,"{v}",1,0\n' for i, v in enumerate(values)))
    rows, bad = readers.read_csv_checked(spark, str(folder), "items")
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v string").where(~F.col("v").isin(readers.MISSING_TOKENS))
    wrong = {r["i"] for r in frame.where(readers.numeric(F.col("v"), True).isNull()).collect()}
    assert {int(r["item_id"]) for r in rows.collect()} == set(range(len(values))) - wrong
    assert {r["reason"] for r in bad.collect()} == {"no number: mrp_inr"} and bad.count() == len(wrong) > 5
    lines = readers.read_csv_checked(spark, str(folder), "items", split=False)
    assert set(lines.where("reason is not null").select(*bad.columns).collect()) == set(bad.collect())
    assert set(lines.where("reason is null").select(*rows.columns).collect()) == set(rows.collect())
    counted = readers.count_checked(lines, "items")
    assert counted._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1
    assert {tuple(r) for r in counted.collect()} == {
        ("items", "read", len(values) - len(wrong)), ("items", "no number: mrp_inr", len(wrong))}
    (folder / "a.csv").write_text(header)
    spark.catalog.refreshByPath(str(folder))
    lines = readers.read_csv_checked(spark, str(folder), "items", split=False)
    assert [tuple(r) for r in readers.count_checked(lines, "items").collect()] == [("items", "read", 0)]


def test_bucketed_features_need_no_exchange(spark, monthly):
    """Hold-outs and back-tests of the stored table run in its buckets."""
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    stored = staging.stage_bucketed(monthly, "monthly", ["shop_id", "item_id"], 4)
    for operator in (series_holdout, arima_backtest, seasonal_fits):
        assert "Exchange" not in plan(operator(stored)), operator
        assert "Exchange" in plan(operator(monthly)), operator
    want = {tuple(r) for r in arima_backtest(monthly).select("shop_id", "item_id", F.round("RMSE", 6)).collect()}
    assert {tuple(r) for r in arima_backtest(stored).select("shop_id", "item_id", F.round("RMSE", 6)).collect()} == want
