import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfsight.operators import monthly as M
from shelfsight.plans import features as P


def months(spark, quantities, shop=1, item=1, skip=()):
    """One series; positions in ``skip`` leave a gap in the calendar."""
    rows, i = [], 0
    for q in quantities:
        while i in skip:
            i += 1
        year, month = 2020 + i // 12, i % 12 + 1
        rows.append((f"{year}-{month:02d}", year, month, shop, item, float(q), 10.0 + q))
        i += 1
    return spark.createDataFrame(
        rows, "year_month string, year int, month int, shop_id long, item_id long, qty double, avg_price double")


def test_history_matches_pandas(spark, monthly):
    cols = ["shop_id", "item_id", "year", "month", "qty", "avg_price", "qty_lag_1", "qty_lag_3", "qty_roll_3",
            "qty_roll_6", "price_change_pct", "qty_next_month"]
    got = monthly.select(*cols).toPandas().sort_values(["shop_id", "item_id", "year", "month"])
    by = got.groupby(["shop_id", "item_id"])
    # the last row of each series is gone, so only inner rows of qty_next_month can be recomputed
    assert (by["qty"].shift(1).fillna(0) == got["qty_lag_1"]).all()
    assert (by["qty"].shift(3).fillna(0) == got["qty_lag_3"]).all()
    for n in (3, 6):
        want = by["qty"].transform(lambda s: s.shift(1).rolling(n).mean()).fillna(0)
        assert np.allclose(want, got[f"qty_roll_{n}"])
    before = by["avg_price"].shift(1)
    want = ((got["avg_price"] - before) / (before + 1e-6)).clip(-2, 2)
    assert np.allclose(want, got["price_change_pct"], equal_nan=True)
    inner = by["qty"].shift(-1)
    assert (inner[inner.notna()] == got["qty_next_month"][inner.notna()]).all()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7])
def test_short_series(spark, n):
    m = M.rolling_mean(M.lag_features(months(spark, range(1, n + 1), skip=(2,))), filled=False)
    rows = m.orderBy("year", "month").collect()
    assert [r["qty_lag_1"] for r in rows] == [0.0] + [float(q) for q in range(1, n)]
    assert [r["qty_roll_3"] is None for r in rows] == [i < 3 for i in range(n)]
    assert [r["qty_roll_6"] is None for r in rows] == [i < 6 for i in range(n)]
    assert M.next_month_target(m).count() == n - 1


def test_first_price_change_stays_null(spark):
    rows = M.price_change(months(spark, [1, 2])).orderBy("month").collect()
    assert rows[0]["price_change_pct"] is None and rows[1]["price_change_pct"] == pytest.approx(1 / 11, rel=1e-6)


def test_price_ratio_of_free_goods(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, None), (30.0, 10.0), (5.0, 10.0)], "avg_price double, avg_mrp double")
    assert [(r["price_ratio"], r["price_discount_pct"]) for r in M.price_features(df).collect()] == [
        (1.0, 0.0), (1.0, 0.0), (3.0, -1.0), (0.5, 0.5)]


def test_promotions_cover_every_month_they_touch(spark):
    d = dt.date
    rows = [(d(2020, 5, 3), d(2020, 5, 20)), (d(2020, 11, 30), d(2021, 2, 1)), (d(2020, 7, 7), d(2020, 7, 7)),
            (d(2020, 9, 9), d(2020, 8, 1)), (d(2020, 9, 9), None), (None, d(2020, 1, 1))]
    df = spark.createDataFrame([(a, b, 1, i, 10.0, 1.5) for i, (a, b) in enumerate(rows)],
                               "start_date date, end_date date, shop_id long, item_category_id long, "
                               "discount_pct double, demand_uplift_mult double")
    got = sorted((r["item_category_id"], r["year_month"]) for r in M.promo_month_expand(df).collect())
    assert got == [(0, "2020-05"), (1, "2020-11"), (1, "2020-12"), (1, "2021-01"), (1, "2021-02"), (2, "2020-07")]


def test_all_null_group_sums_to_zero(spark):
    df = spark.createDataFrame([("2020-01", 1, 1, None, None, None, None, None, None)],
                               "year_month string, shop_id long, item_id long, item_cnt_day double, "
                               "item_price_inr double, item_mrp_inr double, is_promo int, stockout_flag int, "
                               "revenue_inr double")
    r = M.monthly_facts(df).first()
    assert (r["qty"], r["revenue"], r["promo_days"], r["avg_price"], r["month"]) == (0.0, 0.0, 0, None, 1)


def test_repeated_dimension_key_fans_out(spark):
    facts = spark.createDataFrame([(1, 5.0), (2, 6.0)], "shop_id long, qty double")
    dim = spark.createDataFrame([(1, "a"), (1, "b")], "shop_id long, shop_city string")
    got = sorted(map(tuple, M.attach(facts, dim, "shop_id", ["shop_city", "absent"]).collect()), key=str)
    assert got == [(1, 5.0, "a"), (1, 5.0, "b"), (2, 6.0, None)]


def test_large_dimension_is_not_broadcast(spark, monkeypatch):
    from shelfsight.functions import joins
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    facts = spark.createDataFrame([(1, 5.0)], "shop_id long, qty double")
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "shop_id long, shop_city string")
    joined = M.attach(facts, dim, "shop_id", ["shop_city"])
    assert "strategy=broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 1


def test_gap_months_can_be_filled(spark):
    m = months(spark, [5, 6, 7], skip=(1, 2)).withColumns({})
    got = [(r["year_month"], r["qty"]) for r in M.densify_months(m).orderBy("year_month").collect()]
    assert got == [("2020-01", 5.0), ("2020-02", 0.0), ("2020-03", 0.0), ("2020-04", 6.0), ("2020-05", 7.0)]


def test_monthly_totals_match_pandas(raw, monthly):
    from shelfsight.operators.cleaning import cap_outliers
    from shelfsight.plans import features as P
    sales = cap_outliers(P.valid_tables(raw)["sales"]).toPandas()
    sales = sales[(sales["item_cnt_day"] >= 0) & (sales["item_price_inr"] > 0)]
    sales["year_month"] = pd.to_datetime(sales["date"]).dt.strftime("%Y-%m")
    want = sales.groupby(["shop_id", "item_id", "year_month"])["item_cnt_day"].sum()
    got = monthly.select("shop_id", "item_id", "year_month", "qty").toPandas().set_index(
        ["shop_id", "item_id", "year_month"])["qty"]
    assert len(got) > 4000 and np.allclose(want.loc[got.index], got)


def test_sums_keep_every_digit(spark):
    df = spark.createDataFrame([(1, 0.00004)] * 3 + [(2, None)], "k int, v double")
    got = {r["k"]: (r["s"], r["m"]) for r in df.groupBy("k").agg(M.total("v").alias("s"), M.mean("v").alias("m")).collect()}
    assert got == {1: (0.00012, 4e-5), 2: (0.0, None)}


@pytest.mark.parametrize("parts", [1, 7])
def test_sums_do_not_depend_on_partitions(spark, parts):
    df = spark.range(0, 400, 1, parts).select(F.lit(12345678901.1234).alias("v"))
    assert df.agg(M.total("v")).first()[0] == 4938271560449.36


def test_names_are_attached_after_the_exchanges(spark, raw):
    """Same columns and rows as windows over enriched months; no exchange of monthly rows moves a name or a flag."""
    valid = P.valid_tables(raw)
    want = M.next_month_target(P.with_history(P.enriched_months(valid)))
    got = P.monthly_from(valid)
    assert got.dtypes == want.dtypes
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", got._jdf.queryExecution().explainString(mode))
    assert [m for m in moved if "qty#" in m]
    assert not [m for m in moved if "qty#" in m and ("shop_city#" in m or "brand#" in m or "holiday_days#" in m)]


def test_large_dimensions_and_keys_in_two_rows(spark, raw, monkeypatch):
    """Shops and items over the broadcast limit give the same rows; a shop in two rows still doubles its months."""
    valid = P.valid_tables(raw)
    want = M.next_month_target(P.with_history(P.enriched_months(valid)))
    monkeypatch.setattr(P, "is_small", lambda t: False)
    got = P.monthly_from(valid)
    assert got.dtypes == want.dtypes and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    twice = {**valid, "shops": valid["shops"].unionByName(valid["shops"].where("shop_id = 1"))}
    want = M.next_month_target(P.with_history(P.enriched_months(twice)))
    assert P.monthly_from(twice).count() == want.count() > valid["shops"].count()
