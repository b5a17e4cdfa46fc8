import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfsight.operators import cleaning as C
from shelfsight.operators import integrity as I
from shelfsight.plans.catalog import tidy


def column(df, name):
    return [r[name] for r in df.collect()]


def test_names_are_trimmed_and_lowered(spark):
    assert C.standardize_cols(spark.createDataFrame([(1, 2)], [" Shop_ID ", "QTY"])).columns == ["shop_id", "qty"]


def test_bad_dates_become_null_and_are_dropped(spark):
    df = spark.createDataFrame([("2024-02-30",), ("bad",), (None,), ("2024-02-29",)], "date string")
    parsed = C.parse_dates(df, ["date", "absent"])
    assert column(parsed, "date") == [None, None, None, dt.date(2024, 2, 29)]
    assert C.drop_bad_dates(parsed, ["date"]).count() == 1


def test_numbers_from_text(spark):
    texts = ["2.7", "x", None, "NaN", " 12 ", "1e3", "12d", "1.5f", "-.5", "inf", "", "1,000"]
    df = C.coerce_numeric(spark.createDataFrame([(t,) for t in texts], "v string"), ["v"])
    assert column(df, "v") == [2.7, None, None, None, 12.0, 1000.0, None, None, -0.5, math.inf, None, None]


def test_nan_becomes_null(spark):
    df = C.coerce_numeric(spark.createDataFrame([(math.nan,), (1.0,)], "v double"), ["v"])
    assert column(df, "v") == [None, 1.0]


def test_defaults_and_int_flags(spark):
    rows = [(None, None, 2.7), (1.0, 3.0, None), (2.0 ** 40, 1.0, math.inf)]
    df = spark.createDataFrame(rows, "flag double, rate double, n double")
    out = C.fill_numeric(df, {"flag": 0, "rate": 1.0, "n": 0, "absent": 0})
    assert [tuple(r) for r in out.collect()] == [(0, 1.0, 2), (1, 3.0, 0), (2 ** 40, 1.0, 0)]
    assert dict(out.dtypes)["flag"] == "bigint"


def test_unknown_labels(spark):
    df = spark.createDataFrame([(None, "a"), ("b", None)], "brand string, other string")
    assert [tuple(r) for r in C.fill_unknown(df, ["brand", "absent"]).collect()] == [("Unknown", "a"), ("b", None)]


def test_caps_use_interpolated_quantiles_and_keep_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (100.0,), (None,)], "v double")
    assert column(C.cap_outliers(df, ["v"]), "v") == [1.03, 2.0, 3.0, 97.09, None]


def test_sanity_filter_rejects_nan_nulls_and_returns(spark):
    rows = [(1.0, 5.0), (-1.0, 5.0), (1.0, 0.0), (1.0, math.nan), (math.nan, 5.0), (None, 5.0), (0.0, 1.0)]
    df = spark.createDataFrame(rows, "item_cnt_day double, item_price_inr double")
    assert [tuple(r) for r in C.sanity_filter(df).collect()] == [(1.0, 5.0), (0.0, 1.0)]


def test_feature_fill(spark):
    df = spark.createDataFrame([(math.inf,), (-math.inf,), (math.nan,), (None,), (2.0,)], "x double")
    assert column(C.fill_feature_matrix(df, ["x"]), "x") == [0.0, 0.0, 0.0, 0.0, 2.0]


def test_dangling_and_null_keys(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,), (3,)], "k long")
    parent = spark.createDataFrame([(1,), (1,), (3,), (None,)], "k long")
    assert I.fk_check([("k", child, parent)]).first()["missing_keys"] == 2  # 2 and null
    assert sorted(column(I.fk_filter(child, {"k": parent}), "k")) == [1, 3]


@pytest.mark.parametrize("schema", ["date string", "date date"])
def test_empty_input(spark, schema):
    df = spark.createDataFrame([], schema)
    assert C.drop_bad_dates(C.parse_dates(df, ["date"]), ["date"]).count() == 0
    assert C.cap_outliers(spark.createDataFrame([], "v double"), ["v"]).count() == 0


def test_rounded_equals_round(spark):
    """Halves, neighbours of halves, large, tiny, negative and special values; -0 becomes 0."""
    rng = np.random.default_rng(3)
    near = rng.integers(-10 ** 7, 10 ** 7, 3000) + 0.5
    values = np.concatenate([near / 1e6, np.nextafter(near / 1e6, 9), np.nextafter(near / 1e6, -9), rng.normal(size=3000),
                             rng.normal(size=2000) * 1e9, rng.integers(-99, 99, 50) / 2,
                             [0.0, -0.0, -1e-9, 1e300, -1e300, 1e-300, 4398046.511104, 1e6 / 3, np.inf, -np.inf, np.nan]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    for digits in (4, 6):
        out = tidy(df, digits).toPandas()["x"].to_numpy()
        want = df.select(F.round("x", digits).alias("r")).toPandas()["r"].to_numpy()
        np.testing.assert_array_equal(out, want)
        assert not np.signbit(out[out == 0]).any()


def test_rounding_many_columns_is_no_method_of_its_own_length(spark):
    """Rounded values of a wide table come from one expression, whatever the number of columns."""
    df = spark.range(2).select(*[(F.col("id") / 3 + i).alias(f"c{i}") for i in range(40)])
    plan = tidy(df, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rint(") <= 4
    assert tidy(df, 6).first()["c39"] == 39.0
