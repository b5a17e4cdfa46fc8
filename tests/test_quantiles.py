import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfsight.functions import quantiles
from shelfsight.functions.quantiles import exact_quantiles, quantile_bounds, quantile_table, with_order_key
from shelfsight.sources.staging import stage


def test_matches_numpy_with_hot_values_and_nulls(spark):
    rng = np.random.default_rng(7)
    smooth = np.round(rng.lognormal(3, 2, 5000), 4)
    hot = np.where(rng.random(5000) < 0.4, 7.0, rng.integers(-20, 60, 5000))
    rows = [(float(a), None if i % 11 == 0 else float(b)) for i, (a, b) in enumerate(zip(smooth, hot))]
    df = spark.createDataFrame(rows, "smooth double, hot double").repartition(5)
    qs = [0.0, 0.01, 0.33, 0.5, 0.99, 1.0]
    got = exact_quantiles(df, {"smooth": qs, "hot": qs})
    known = np.array([b for _, b in rows if b is not None])
    assert got["smooth"] == pytest.approx(np.quantile(smooth, qs), rel=1e-12)
    assert got["hot"] == pytest.approx(np.quantile(known, qs), rel=1e-12)


def test_small_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (100.0, None)], "a double, b double")
    assert exact_quantiles(df, {"a": [0.5, 0.99], "b": [0.5]}, decimals=4) == {"a": [2.5, 97.09], "b": [None]}
    assert exact_quantiles(df.where("a = 2"), {"a": [0.3]}) == {"a": [2.0]}
    assert exact_quantiles(df.limit(0), {"a": [0.3]}) == {"a": [None]}


def test_nan_counts_as_missing(spark):
    df = spark.range(5).select(F.when(F.col("id") == 0, float("nan")).otherwise(F.col("id")).alias("v"))
    assert exact_quantiles(df, {"v": [0.0, 0.5]}) == {"v": [1.0, 2.5]}


def test_keys_are_the_ordered_bits_of_a_double(spark):
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2 ** 64, 4000, dtype=np.uint64).view(np.float64)
    edges = [0.0, -0.0, 1.0, 2.0, 0.5, np.inf, -np.inf, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308,
             *np.nextafter(2.0 ** np.arange(-1022.0, 1023.0, 7), 0), *2.0 ** np.arange(-1074.0, 1023.0, 5)]
    x = np.concatenate([bits[~np.isnan(bits)], edges, rng.normal(size=500)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = {r["x"].hex(): r["k"] for r in with_order_key(df, "x", "k").collect()}
    for v in x:
        size = int(np.abs(v).view(np.int64))
        assert got[float(v).hex()] == (-size if v < 0 else size), v


def test_a_million_equal_values_and_a_crowded_slice(spark):
    """99 % of the values share all but their last digits; one far value stretches the range."""
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select(
        F.lit(3.25).alias("same"),
        F.when(F.col("id") % 100 == 0, F.pow(F.lit(10.0), F.col("id") % 300)).otherwise(
            1.0 + (F.col("id") * 7919 % n) * 2.0 ** -50).alias("crowded"))
    qs = [0.0, 0.25, 0.5, 0.99, 1.0]
    i = np.arange(n)
    crowded = np.where(i % 100 == 0, 10.0 ** (i % 300), 1.0 + (i * 7919 % n) * 2.0 ** -50)
    got = exact_quantiles(df, {"same": qs, "crowded": qs})
    assert got["same"] == [3.25] * 5
    assert got["crowded"] == pytest.approx(np.quantile(crowded, qs), rel=1e-15)


def test_no_bucket_orders_more_than_its_digits(spark, monkeypatch):
    """What a window gets is bounded by 2 ** DIGIT rows per bucket, however many rows there are."""
    counted = []
    holding = quantiles._holding

    def watched(table, by):
        keys = [c for c in ("name", "above") if c in table.columns]
        rows = table.groupBy(*keys).agg(F.count_distinct("prefix").alias("n"), F.sum("c").alias("rows")).collect()
        counted.extend((r["n"], r["rows"]) for r in rows)
        return holding(table, by)

    monkeypatch.setattr(quantiles, "_holding", watched)
    df = spark.range(200_000).select((F.rand(5) * 1000).alias("v"))
    got = exact_quantiles(df, {"v": [0.5]})["v"][0]
    assert abs(got - 500) < 10
    assert len(counted) >= quantiles.LEVELS and max(n for n, _ in counted) <= 2 ** quantiles.DIGIT
    assert min(rows for _, rows in counted) <= 2  # the last bucket holds the value itself


def test_many_groups_and_a_null_one(spark):
    n = 100_000
    df = spark.range(n * 3).select(
        F.when(F.col("id") % n != 0, F.col("id") % n).alias("g"), (F.col("id") / n).cast("int").cast("double").alias("v"))
    table = stage(quantile_table(df, {"v": [0.25, 1.0]}, by=["g"]), "quantiles")
    assert table.count() == 2 * n
    assert table.select("q", "value").distinct().orderBy("q").collect() == [(0.25, 0.5), (1.0, 2.0)]
    assert table.where("g is null").count() == 2


def test_bounds_run_one_subquery(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"))
    bounds = quantile_bounds(df, {"a": [0.1, 0.9], "b": [0.5]})
    out = df.select(*[c.alias(f"x{i}") for i, c in enumerate([*bounds["a"], *bounds["b"]])]).distinct()
    assert [tuple(r) for r in out.collect()] == [(100.0, 900.0, -500.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedSubquery") >= 2
