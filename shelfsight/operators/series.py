"""Per-series forecasting: every series at once, no driver loop.

A series has one row per month, so whatever is grouped by series stays small;
skew in the raw sales was absorbed by the monthly aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip
from .cleaning import present
from .eda import series_rank
from .linear import LinearFit, fit_linear, moments, ridge_fits, unfold
from .models import regression_metrics
from .monthly import SERIES, total
from .sampling import series_holdout

REGRESSORS = ["price_ratio", "promo_intensity", "festive_days", "holiday_days", "stockout_days"]


def get_series(monthly: DataFrame) -> DataFrame:
    """Month start, quantity and regressors of every series."""
    return monthly.select(
        *SERIES, F.to_date("year_month", "yyyy-MM").alias("ds"), F.col("qty").cast("double").alias("y"),
        *present(monthly, ["avg_price", *REGRESSORS]))


def arima_backtest(monthly: DataFrame, months: int = 3, min_rows: int = 18,
                   top_n: int | None = None) -> DataFrame:
    """RMSE of an ARIMA(1,1,1) on the last ``months`` rows of each series.

    Two-stage least squares of Hannan and Rissanen (1982) on first differences:
    a long autoregression estimates the shocks, a second regression on the last
    difference and the last shock gives phi and theta. Both are 2x2 normal
    equations, so the fit is window functions and sums over one shuffle. Where the second is singular, both are 0,
    the forecast is the last value, and ``status`` says so.
    """
    by_series = Window.partitionBy(*SERIES)
    by_time = by_series.orderBy("t")
    d, d1, d2, e1 = (F.col(c) for c in ("d", "d1", "d2", "e1"))

    rows = (series_holdout(_top_series(monthly, top_n), months, min_rows)
            .select(*SERIES, "t", "is_validation", F.col("qty").alias("y"),
                    (F.col("n_rows") - months).alias("n_train"))
            .withColumn("d", F.when(~F.col("is_validation"), F.col("y") - F.lag("y", 1).over(by_time)))
            .withColumn("d1", F.lag("d", 1).over(by_time))
            .withColumn("d2", F.lag("d", 2).over(by_time)))

    def summed(x: Column, y: Column, needed: Column) -> Column:
        return F.sum(F.when(needed.isNotNull(), x * y)).over(by_series)

    stage1 = d + d1 + d2
    rows = rows.withColumns({
        "s11": summed(d1, d1, stage1), "s22": summed(d2, d2, stage1), "s12": summed(d1, d2, stage1),
        "p1": summed(d, d1, stage1), "p2": summed(d, d2, stage1)})
    a1, a2 = _solve_2x2("s11", "s22", "s12", "p1", "p2")
    rows = (rows.withColumns({"a1": a1, "a2": a2})
            .withColumn("e", d - F.col("a1") * d1 - F.col("a2") * d2)
            .withColumn("e1", F.lag("e", 1).over(by_time)))

    def last(c: str) -> Column:
        return F.max(F.when(F.col("t") == F.col("n_train"), F.col(c)))

    stage2 = (d + d1 + e1).isNotNull()
    fits = rows.groupBy(*SERIES).agg(
        F.max("n_train").alias("n_train"),
        F.sum(F.when(stage2, d1 * d1)).alias("s11"), F.sum(F.when(stage2, e1 * e1)).alias("s22"),
        F.sum(F.when(stage2, d1 * e1)).alias("s12"), F.sum(F.when(stage2, d * d1)).alias("p1"),
        F.sum(F.when(stage2, d * e1)).alias("p2"),
        last("y").alias("y_n"), last("d").alias("d_n"), last("e").alias("e_n"),
        *[F.max(F.when(F.col("t") == F.col("n_train") + h, F.col("y"))).alias(f"y_{h}")
          for h in range(1, months + 1)])
    phi, theta = _solve_2x2("s11", "s22", "s12", "p1", "p2")
    status = F.when(_regular("s11", "s22", "s12"), "ok").otherwise("singular")
    fits = (fits.withColumn("status", status).withColumns({"phi": clip(phi, -0.99, 0.99), "theta": clip(theta, -0.99, 0.99)})
            .withColumn("step", F.col("phi") * F.col("d_n") + F.col("theta") * F.col("e_n"))
            .withColumn("level", F.col("y_n") + F.col("step")))
    squares = F.lit(0.0)
    for h in range(1, months + 1):
        squares = squares + F.pow(F.col(f"y_{h}") - F.col("level"), F.lit(2.0))
        fits = (fits.withColumn("squares", squares)
                .withColumn("step", F.col("phi") * F.col("step"))
                .withColumn("level", F.col("level") + F.col("step")))
        squares = F.col("squares")
    return fits.select(*SERIES, "n_train", "phi", "theta", F.sqrt(squares / months).alias("RMSE"), "status")


def _regular(s11: str, s22: str, s12: str) -> Column:
    both = F.col(s11) * F.col(s22)
    return F.coalesce(both - F.col(s12) * F.col(s12) > 1e-9 * both, F.lit(False))


def _solve_2x2(s11: str, s22: str, s12: str, p1: str, p2: str) -> tuple[Column, Column]:
    """Least-squares coefficients of two regressors; 0 where the system is singular."""
    regular = _regular(s11, s22, s12)
    s11, s22, s12, p1, p2 = (F.col(c) for c in (s11, s22, s12, p1, p2))
    det = s11 * s22 - s12 * s12
    return (F.when(regular, F.try_divide(p1 * s22 - p2 * s12, det)).otherwise(0.0),
            F.when(regular, F.try_divide(p2 * s11 - p1 * s12, det)).otherwise(0.0))


def _top_series(monthly: DataFrame, top_n: int | None) -> DataFrame:
    if top_n is None:
        return monthly
    best = series_rank(monthly, top_n).select(*SERIES)
    return monthly.join(F.broadcast(best), SERIES, "left_semi")


FIT = "level double, beta array<double>, mean array<double>, sd array<double>, RMSE double"


def seasonal_fits(monthly: DataFrame, months: int = 3, min_rows: int = 18, harmonics: int = 3, ridge: float = 1.0,
                  top_n: int | None = None) -> DataFrame:
    """Trend + yearly Fourier terms + regressors of each series: (n_train, status, level, beta, mean, sd, RMSE).

    A ridge regression on standardized terms per series. A series becomes sums of products in the partitions of
    the hold-out's window, and the systems of a whole batch of series are solved as one stack. A series with an
    unknown regressor cannot be fitted and says so in ``status``.
    """
    held = series_holdout(_top_series(monthly, top_n), months, min_rows)
    angle = F.col("month") * F.lit(2 * np.pi / 12)
    xs = [F.col("t") / F.col("n_rows"), *[wave(angle * F.lit(k)) for wave in (F.sin, F.cos)
                                          for k in range(1, harmonics + 1)],
          *[F.col(c).cast("double") for c in REGRESSORS]]
    missing = F.greatest(*[F.col(c).isNull() for c in [*REGRESSORS, "qty"]])
    y = F.col("qty").cast("double")
    sums = held.groupBy(*SERIES).agg(
        *moments(xs, y, ~F.col("is_validation")), F.max(missing).alias("missing"),
        F.flatten(F.collect_list(F.when(F.col("is_validation"), F.array(*xs, y)))).alias("held"))
    width = len(xs) + 2

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            good = ~batch.column("missing").to_numpy(zero_copy_only=False)
            known = batch.filter(pa.array(good))
            s = known.column("s").flatten().to_numpy(zero_copy_only=False).reshape(known.num_rows, width * (width + 1) // 2)
            level, beta, mean, sd = ridge_fits(unfold(s, width), ridge)
            out = known.column("held").flatten().to_numpy(zero_copy_only=False).reshape(known.num_rows, months, width - 1)
            z = (out[:, :, :-1] - mean[:, None]) / np.where(sd > 0, sd, 1)[:, None]
            error = out[:, :, -1] - (level[:, None] + np.einsum("gmx,gx->gm", z, beta))
            place = np.full(n, -1)
            place[good] = np.arange(known.num_rows)
            at = pa.array(place, mask=~good)
            found = [pa.array(level), *(pa.array(list(v), pa.list_(pa.float64())) for v in (beta, mean, sd)),
                     pa.array(np.sqrt((error ** 2).mean(axis=1)))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in SERIES), batch.column("n").cast(pa.int32()),
                 pa.array(np.where(good, "ok", "missing regressor")), *(f.take(at) for f in found)],
                [*SERIES, "n_train", "status", "level", "beta", "mean", "sd", "RMSE"])

    keys = ", ".join(f"{c} {dict(monthly.dtypes)[c]}" for c in SERIES)
    return sums.mapInArrow(fit, f"{keys}, n_train int, status string, {FIT}")


def seasonal_regression_backtest(monthly: DataFrame, months: int = 3, min_rows: int = 18, harmonics: int = 3,
                                 ridge: float = 1.0, top_n: int | None = None) -> DataFrame:
    """RMSE of the seasonal regression on the last rows of each series."""
    return seasonal_fits(monthly, months, min_rows, harmonics, ridge, top_n).select(
        *SERIES, "n_train", "RMSE", "status")


def total_series(monthly: DataFrame) -> DataFrame:
    """The all-shops series: one row per month."""
    return monthly.groupBy("year_month").agg(total("qty").alias("qty"))


def minmax_scale(df: DataFrame, column: str = "qty", keys: list[str] = ()) -> DataFrame:
    """Adds lo, hi and scaled = (x - lo) / (hi - lo + 1e-6), per series or over one bounded series."""
    w = Window.partitionBy(*keys)
    return (df.withColumns({"lo": F.min(column).over(w), "hi": F.max(column).over(w)})
            .withColumn("scaled", (F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-6)))


def sequence_frames(df: DataFrame, keys: list[str] = (), lookback: int = 12) -> DataFrame:
    """``lags``: the ``lookback`` previous scaled values, oldest first; rows without that many are dropped.

    Without keys, ``df`` is a single series with one row per month.
    """
    w = Window.partitionBy(*keys).orderBy("year_month")
    return (minmax_scale(df, keys=keys)
            .withColumn("lags", F.collect_list("scaled").over(w.rowsBetween(-lookback, -1)))
            .where(F.size("lags") == lookback))


def sequence_model(df: DataFrame, keys: list[str] = (), lookback: int = 12, months: int = 3
                   ) -> tuple[LinearFit, DataFrame]:
    """One pooled linear model of the next scaled value on the lags before it, over all series, and the frames with
    ``is_validation`` for the last windows of each series."""
    newest_first = Window.partitionBy(*keys).orderBy(F.desc("year_month"))
    frames = (sequence_frames(df, keys, lookback)
              .withColumn("is_validation", F.row_number().over(newest_first) <= months))
    return fit_linear(frames.where(~F.col("is_validation")), "lags", "scaled", lookback), frames


def sequence_scores(model: LinearFit, frames: DataFrame) -> DataFrame:
    """Metrics of the validation windows in the original unit."""
    size = F.col("hi") - F.col("lo") + 1e-6
    scored = model.transform(frames.where("is_validation")).select(
        (F.col("scaled") * size + F.col("lo")).alias("actual"),
        (F.col("prediction") * size + F.col("lo")).alias("predicted"))
    return regression_metrics(scored, "actual", "predicted")


def sequence_regression(df: DataFrame, keys: list[str] = (), lookback: int = 12, months: int = 3) -> DataFrame:
    """Metrics of next-value prediction from lag windows, on the last windows of each series."""
    return sequence_scores(*sequence_model(df, keys, lookback, months))
