import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfsight.operators import eda as E
from shelfsight.operators import sampling as A
from shelfsight.operators.monthly import GRAIN


def correlations(df, columns):
    return {(r["feature_x"], r["feature_y"]): r["correlation"] for r in E.correlation_matrix(df, columns).collect()}


def test_correlation_skips_incomplete_pairs_and_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.1), (2.0, 4.0, 0.1), (3.0, 7.0, 0.1), (None, 9.0, 0.1)],
                               "a double, b double, c double").repartition(3)
    r = correlations(df, ["a", "b", "c", "absent"])
    assert len(r) == 9
    assert r["a", "b"] == r["b", "a"] == pytest.approx(0.99339926779878)
    assert r["a", "a"] == pytest.approx(1.0)
    assert r["a", "c"] is None and r["c", "c"] is None


def test_correlation_of_far_values(spark):
    """Values near 1e9 that differ by about 1, in tasks whose means differ; and a constant that is no exact sum."""
    rng = np.random.default_rng(2)
    a = 1e9 + rng.normal(size=3000)
    b = 1e9 + 0.3 * (a - 1e9) + rng.normal(size=3000)
    df = spark.createDataFrame([(float(x), float(y), 0.1) for x, y in zip(a, b)], "a double, b double, c double")
    for parts in (1, 6):
        r = correlations(df.repartitionByRange(parts, "a"), ["a", "b", "c"])
        assert r["a", "b"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-7)
        assert r["a", "c"] is None and r["c", "c"] is None and r["a", "a"] == pytest.approx(1)
    assert set(correlations(df.limit(0), ["a", "b"]).values()) == {None}


def test_correlation_matches_pandas(monthly):
    r = correlations(monthly, E.CORRELATION_COLUMNS)
    want = monthly.select(*[F.col(c).cast("double") for c in E.CORRELATION_COLUMNS]).toPandas().corr()
    for (x, y), value in r.items():
        assert np.isnan(want.loc[x, y]) if value is None else value == pytest.approx(want.loc[x, y], abs=1e-9)


def test_ties_at_the_cut_are_broken_by_key(spark):
    df = spark.createDataFrame([(s, 1, 5.0) for s in range(9)], "shop_id long, item_id long, qty double")
    assert [r["shop_id"] for r in E.series_rank(df, 3).collect()] == [0, 1, 2]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "year_month string, shop_id long, item_id long, qty double, "
                                   "promo_days long, stockout_days long, item_category_name string")
    assert E.total_monthly_qty(df).count() == E.top_categories(df).count() == E.stockout_impact(df).count() == 0
    assert A.sample_exact(df, 5, GRAIN).count() == 0
    assert A.time_split(df).count() == 0


@pytest.mark.parametrize("n", [1, 700, 10 ** 6])
def test_sample_is_exact_and_independent_of_partitioning(monthly, n):
    df = monthly.select(*GRAIN, "qty")
    one = {tuple(r) for r in A.sample_exact(df, n, GRAIN).collect()}
    other = {tuple(r) for r in A.sample_exact(df.repartition(7, "qty"), n, GRAIN).collect()}
    assert one == other and len(one) == min(n, df.count())


def test_stratified_split_takes_a_fifth_of_each_class(spark):
    rows = [(f"2020-{i:04d}", 1, i, c) for i, c in enumerate("A" * 10 + "B" * 5 + "C")]
    df = spark.createDataFrame(rows, "year_month string, shop_id long, item_id long, label string")
    split = A.stratified_split(df, "label", GRAIN, ["A", "B", "C"])
    got = {r["label"]: (r["n"], r["test"]) for r in split.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("test")).collect()}
    assert got == {"A": (10, 2), "B": (5, 1), "C": (1, 1)}


def test_hot_stratum(spark):
    df = spark.range(20_000).select(
        F.lit("2020-01").alias("year_month"), F.lit(1).cast("long").alias("shop_id"), F.col("id").alias("item_id"),
        F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("label"))
    split = A.stratified_split(df, "label", GRAIN, ["hot", "rare"])
    got = {r["label"]: r["n"] for r in split.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == {"hot": 3960, "rare": 40}


def test_time_split_has_no_leak(monthly):
    split = A.time_split(monthly).groupBy("is_validation").agg(
        F.min("year_month").alias("a"), F.max("year_month").alias("b"), F.count_distinct("year_month").alias("n"))
    train, val = sorted(split.collect(), key=lambda r: r["is_validation"])
    assert train["b"] < val["a"] and val["n"] == 3


@pytest.mark.parametrize("n,kept", [(17, 0), (18, 18)])
def test_holdout_needs_enough_rows(spark, n, kept):
    from test_monthly import months
    rows = A.series_holdout(months(spark, range(n), skip=(4,))).orderBy("t").collect()
    assert len(rows) == kept
    assert [r["is_validation"] for r in rows] == [i >= n - 3 for i in range(kept)]
