"""Demand regression, sales classes and their scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.quantiles import quantile_bounds, quantile_table
from .hist_trees import HistForest
from .linear import MAX_WIDTH, LinearFit, fit_linear

TARGET = "qty_next_month"
# The columns that the models of the analysis are given.
FEATURES = [
    "avg_price", "avg_mrp", "promo_days", "stockout_days", "revenue",
    "holiday_days", "weekend_days", "festive_days", "summer_days", "monsoon_days",
    "promo_discount_pct", "promo_uplift", "promo_campaigns",
    "avg_on_hand", "avg_reorder_point", "avg_lead_time", "inv_snapshots",
    "price_ratio", "price_discount_pct", "price_change_pct",
    "qty_lag_1", "qty_lag_2", "qty_lag_3", "qty_roll_3", "qty_roll_6", "qty_trend",
    "promo_intensity", "store_size_sqft",
]
LABELS = ["shop_city", "shop_state", "shop_region", "store_type", "brand", "tier", "item_category_name"]
CLASS_FEATURES = ["avg_price", "promo_intensity", "holiday_days", "festive_days", "stockout_days",
                  "price_ratio", "avg_on_hand", "store_size_sqft"]
CLASSES = ["LOW", "MEDIUM", "HIGH"]


@dataclass
class LeastSquares:
    """Linear regression by moment matrices; beyond MAX_WIDTH features, by Spark's iterative solver."""
    width: int
    features: str = "scaled"

    def fit(self, df: DataFrame) -> LinearFit:
        if self.width <= MAX_WIDTH:
            return fit_linear(df, self.features, TARGET, self.width)
        return LinearRegression(featuresCol=self.features, labelCol=TARGET, regParam=0.0, solver="l-bfgs").fit(df)


def random_forest(features: str = "features", trees: int = 220, depth: int = 10,
                  seed: int = 42) -> HistForest:
    """Bagged trees over all features. All trees grow one level per pass,
    so depth is bounded; unlimited depth would keep one node per row on the driver."""
    return HistForest(TARGET, features, trees, depth, seed=seed)


def gradient_boosting(features: str = "features", stages: int = 100, rate: float = 0.1,
                      depth: int = 3, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(featuresCol=features, labelCol=TARGET, maxIter=stages, stepSize=rate,
                        maxDepth=depth, seed=seed, maxMemoryInMB=1024)


def sales_forest(trees: int = 220, depth: int = 10, seed: int = 42) -> HistForest:
    return HistForest("class_ix", "features", trees, depth, "sqrt", len(CLASSES), seed)


REGRESSORS = ["LinearRegression", "RandomForestRegressor", "GradientBoostingRegressor"]


def regressors(width: int, trees: int = 220, depth: int = 10, stages: int = 100, seed: int = 42) -> dict:
    """What has a ``fit``, by name; ``width`` is the length of the feature vector."""
    return {
        "LinearRegression": LeastSquares(width),
        "RandomForestRegressor": random_forest(trees=trees, depth=depth, seed=seed),
        "GradientBoostingRegressor": gradient_boosting(stages=stages, seed=seed),
    }


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: list[str] = ()) -> DataFrame:
    """RMSE, MAE and MAPE % (denominator 1 where the actual value is 0), in one aggregate."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    size = F.when(F.abs(y) < 1e-6, 1.0).otherwise(F.abs(y))
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("RMSE"),
        F.avg(F.abs(e)).alias("MAE"),
        (F.avg(F.abs(e / size)) * 100.0).alias("MAPE_%"))


def sales_class(df: DataFrame, low: float = 0.33, high: float = 0.66, by_region: bool = False) -> DataFrame:
    """LOW, MEDIUM or HIGH by global quantiles of quantity, or by those of the row's region.

    The regional bounds are a table, joined back by region: any number of regions takes the same passes.
    A row without a quantity is HIGH; so are all rows of a region that has none.
    """
    if not by_region:
        q1, q2 = quantile_bounds(df, {"qty": [low, high]}, decimals=4)["qty"]
        return df.withColumn("sales_class", _class(q1, q2))
    bounds = (quantile_table(df, {"qty": [low, high]}, by=["shop_region"], decimals=4)
              .groupBy(F.col("shop_region").alias("cut_region"))
              .agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n)
                     for q, n in ((float(low), "cut_low"), (float(high), "cut_high"))]))
    return (df.join(bounds, F.col("shop_region").eqNullSafe(F.col("cut_region")), "left")
            .withColumn("sales_class", _class(F.col("cut_low"), F.col("cut_high")))
            .drop("cut_region", "cut_low", "cut_high"))


def _class(q1: Column, q2: Column) -> Column:
    return F.when(F.col("qty") <= q1, "LOW").when(F.col("qty") <= q2, "MEDIUM").otherwise("HIGH")


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: list[str] = CLASSES) -> DataFrame:
    """Counts with one row per actual and one column per predicted label, in label order."""
    counts = (df.where(F.col(actual).isin(labels)).groupBy(F.col(actual).alias("actual")).agg(*[
        F.count_if(F.col(predicted) == label).alias(label) for label in labels]))
    rows = df.sparkSession.createDataFrame([(i, label) for i, label in enumerate(labels)],
                                           "position int, actual string")
    return (rows.join(counts, "actual", "left").na.fill(0, subset=labels)
            .orderBy("position").drop("position"))


def classification_report(df: DataFrame, actual: str, predicted: str,
                          labels: list[str] = CLASSES) -> DataFrame:
    """Precision, recall, F1 and support per class, then their plain and their support-weighted means over the
    classes; the accuracy over all rows in each."""
    hit = F.col(actual) == F.col(predicted)
    counted = df.agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.array(*[
        F.struct(F.lit(label).alias("sales_class"),
                 F.count_if(hit & (F.col(actual) == label)).alias("tp"),
                 F.count_if(F.col(predicted) == label).alias("n_predicted"),
                 F.count_if(F.col(actual) == label).alias("support"))
        for label in labels]).alias("per_class"))
    accuracy = ratio(F.col("hits"), F.col("n"))
    per_class = counted.select(accuracy.alias("accuracy"), F.explode("per_class").alias("c")).select(
        "c.*", "accuracy")
    precision = ratio(F.col("tp"), F.col("n_predicted"), 0.0)
    recall = ratio(F.col("tp"), F.col("support"), 0.0)
    scores = ["precision", "recall", "f1"]
    rows = (per_class.withColumns({"precision": precision, "recall": recall})
            .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"),
                                    F.col("precision") + F.col("recall"), 0.0))
            .select("sales_class", *scores, "support", "accuracy"))

    def mean(name: str, weight: Column) -> DataFrame:
        return rows.agg(*[ratio(F.sum(F.col(c) * weight), F.sum(weight), 0.0).alias(c) for c in scores],
                        F.sum("support").alias("support"), F.first("accuracy").alias("accuracy")).select(
            F.lit(name).alias("sales_class"), *scores, "support", "accuracy")

    # three rows: each mean reads the counted aggregate anew, but not the data, whose exchange is reused
    return rows.unionByName(mean("macro avg", F.lit(1.0))).unionByName(mean("weighted avg", F.col("support")))
