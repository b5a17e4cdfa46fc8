"""Exploratory aggregates: totals, top-k, comparisons, quantiles and correlation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite_or_null
from ..functions.quantiles import quantile_table
from .cleaning import known, present
from .monthly import SERIES, mean, promo_flag, total

# The columns whose correlations the analysis gives.
CORRELATION_COLUMNS = [
    "qty", "avg_price", "avg_mrp", "promo_days", "stockout_days", "revenue",
    "holiday_days", "weekend_days", "festive_days", "summer_days", "monsoon_days",
    "promo_discount_pct", "promo_uplift", "avg_on_hand",
    "avg_reorder_point", "avg_lead_time", "price_ratio", "price_discount_pct",
    "qty_lag_1", "qty_lag_2", "qty_lag_3", "qty_roll_3", "qty_roll_6",
    "price_change_pct", "qty_trend", "promo_intensity", "qty_next_month",
]


def top_k(df: DataFrame, metric: str, k: int, ties: list[str]) -> DataFrame:
    """The k rows with the highest metric; ``ties`` make the cut unambiguous."""
    return df.orderBy(F.desc(metric), *ties).limit(k)


def total_monthly_qty(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("year_month").agg(total("qty").alias("qty")).orderBy("year_month")


def top_categories(monthly: DataFrame, k: int = 15) -> DataFrame:
    by = known(monthly, ["item_category_name"]).groupBy("item_category_name")
    return top_k(by.agg(total("qty").alias("qty")), "qty", k, ["item_category_name"])


def top_shops_revenue(monthly: DataFrame, k: int = 15) -> DataFrame:
    return top_k(monthly.groupBy("shop_id").agg(total("revenue").alias("revenue")),
                 "revenue", k, ["shop_id"])


def promo_vs_nonpromo(monthly: DataFrame) -> DataFrame:
    """Mean monthly quantity with and without promotion sales."""
    return promo_flag(monthly).groupBy("promo_flag").agg(mean("qty").alias("avg_qty"))


def stockout_impact(monthly: DataFrame, k: int = 15) -> DataFrame:
    """Mean monthly quantity by stock-out count, for the k lowest counts."""
    return (monthly.groupBy("stockout_days").agg(mean("qty").alias("avg_qty"))
            .orderBy("stockout_days").limit(k))


def series_rank(monthly: DataFrame, k: int | None = 5) -> DataFrame:
    """Series by total quantity; all of them when k is None."""
    totals = monthly.groupBy(*SERIES).agg(total("qty").alias("qty"))
    return totals.orderBy(F.desc("qty"), *SERIES) if k is None else top_k(totals, "qty", k, SERIES)


def distinct_months(df: DataFrame) -> DataFrame:
    return known(df, ["year_month"]).select("year_month").distinct().orderBy("year_month")


def latest_month(df: DataFrame) -> Column:
    """The last month of ``df`` as a scalar subquery."""
    return df.agg(F.max("year_month")).scalar()


def min_max(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"))


def quantiles(df: DataFrame, wanted: dict[str, list[float]], decimals: int = 4) -> DataFrame:
    """(column_name, q, value) of linear-interpolated quantiles."""
    asked = df.sparkSession.createDataFrame([(n, float(q)) for n, qs in wanted.items() for q in qs],
                                            "name string, q double")
    found = quantile_table(df, wanted, decimals=decimals)
    return asked.join(found, ["name", "q"], "left").withColumnRenamed("name", "column_name")


MOMENTS = ["n", "mx", "my", "cxx", "cyy", "cxy"]  # rows, means, centred squares and products of a pair


def correlation_matrix(df: DataFrame, columns: list[str] = CORRELATION_COLUMNS) -> DataFrame:
    """Pearson correlation of every pair of columns over the rows where both are known.

    One pass: each task reduces its rows, by matrix products around a point near their own means, to the centred
    moments of every pair; the shuffle carries (number of columns)**2 rows a task whatever the data size. Moments of
    tasks are put together around the pair's overall means (Chan, Golub and LeVeque 1979), so large offsets cancel
    nothing. A pair with a constant side gives null.
    """
    columns = present(df, columns)
    data = df.select(*[finite_or_null(F.col(c).cast("double")).alias(c) for c in columns])
    k = len(columns)

    def pair_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, sums = None, np.zeros((4, k, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            there = ~np.isnan(x)
            if shift is None:
                shift = np.where(there, x, 0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
            x, there = np.where(there, x - shift, 0.0), there.astype(float)
            sums += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        if shift is None:
            return
        n, sx, sxx, sxy = sums
        i, j = np.nonzero(n)
        n, ax, ay = n[i, j], sx[i, j], sx[j, i]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (i, j, n, ax / n + shift[i], ay / n + shift[j], sxx[i, j] - ax * ax / n,
                                   sxx[j, i] - ay * ay / n, sxy[i, j] - ax * ay / n)], ["i", "j", *MOMENTS])

    parts = data.mapInArrow(pair_moments, "i long, j long, " + ", ".join(f"{m} double" for m in MOMENTS))
    pair = Window.partitionBy("i", "j")  # one row a task
    dx, dy = (F.col(m) - F.sum(F.col("n") * F.col(m)).over(pair) / F.sum("n").over(pair) for m in ("mx", "my"))
    n = F.col("n")
    sums = (parts.withColumns({"dx": dx, "dy": dy}).groupBy("i", "j").agg(
        F.sum(F.col("cxx") + n * F.col("dx") * F.col("dx")).alias("sxx"),
        F.sum(F.col("cyy") + n * F.col("dy") * F.col("dy")).alias("syy"),
        F.sum(F.col("cxy") + n * F.col("dx") * F.col("dy")).alias("sxy"),
        F.sum("n").alias("n"), F.max(F.abs("mx")).alias("mx"), F.max(F.abs("my")).alias("my")))
    # what is left of a constant after rounding is far below the square of its size
    varies = (F.col("sxx") > 1e-26 * n * F.col("mx") * F.col("mx")) & (F.col("syy") > 1e-26 * n * F.col("my") * F.col("my"))
    r = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    names = [(i, j, columns[i], columns[j]) for i in range(k) for j in range(k)]
    cells = df.sparkSession.createDataFrame(names, "i long, j long, feature_x string, feature_y string")
    return cells.join(sums, ["i", "j"], "left").select(
        "feature_x", "feature_y", F.when(varies, r).alias("correlation"))
