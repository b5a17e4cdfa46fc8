"""Feature table to models, forecasts and classes."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models as R
from ..operators.cleaning import present
from ..operators.decisions import PREDICTED
from ..operators.eda import latest_month
from ..operators.encoding import Encoder, fit_encoder, fit_scaler
from ..operators.linear import LinearFit
from ..operators.monthly import GRAIN
from ..operators.sampling import stratified_split, time_split
from ..sources.staging import spread, stage

Fitted = Model | LinearFit


class Prepared(NamedTuple):
    """Encoded rows with ``features`` and ``is_validation``, written once and read by every fit, and ``scaled``, which
    is made from them when it is read."""
    rows: DataFrame
    encoder: Encoder
    scaler: PipelineModel

    @property
    def train(self) -> DataFrame:
        return self.rows.where(~F.col("is_validation"))

    @property
    def validation(self) -> DataFrame:
        return self.rows.where("is_validation")


def prepare(monthly: DataFrame, months: int = 3) -> Prepared:
    numbers, labels = present(monthly, R.FEATURES), present(monthly, R.LABELS)
    table = stage(monthly.select(*GRAIN, R.TARGET, *numbers, *labels), "model-table")
    encoder = fit_encoder(table, numbers, labels)
    encoded = encoder.transform(time_split(table, months)).select(*GRAIN, R.TARGET, "is_validation", "features")
    # written before the scaler is fitted: no row is encoded twice, and its dense scaled copy is never written
    encoded = spread(stage(encoded, "model-rows"), *GRAIN)
    scaler = fit_scaler(encoded.where(~F.col("is_validation")))
    return Prepared(scaler.transform(encoded).drop("scaled_sample"), encoder, scaler)


def fit_models(p: Prepared, names: list[str] | None = None, **params) -> dict[str, Fitted]:
    return {name: est.fit(p.train) for name, est in R.regressors(p.encoder.width, **params).items()
            if names is None or name in names}


def validation_scores(p: Prepared, models: dict[str, Fitted]) -> DataFrame:
    """Model, RMSE, MAE and MAPE % on the validation months, best RMSE first."""
    stacked = reduce(DataFrame.unionByName, [
        m.transform(p.validation).select(F.lit(name).alias("Model"), R.TARGET, "prediction")
        for name, m in models.items()])
    return R.regression_metrics(stacked, R.TARGET, "prediction", ["Model"]).orderBy("RMSE", "Model")


def forecast_next(p: Prepared, model: Fitted) -> DataFrame:
    """Next-month quantity, at least 0, for the series with a row in the latest month."""
    latest = p.rows.where(F.col("year_month") == latest_month(p.rows))
    return model.transform(latest).select(
        "shop_id", "item_id", F.greatest(F.lit(0.0), F.col("prediction")).alias(PREDICTED))


def best_model(p: Prepared, models: dict[str, Fitted]) -> tuple[str, Fitted]:
    name = validation_scores(p, models).first()["Model"]
    return name, models[name]


def score(rows: DataFrame, encoder: Encoder, scaler: PipelineModel, model: Fitted) -> DataFrame:
    """Raw rows of the feature table, scored by a fitted or reloaded encoder, scaler and model."""
    return model.transform(scaler.transform(encoder.transform(rows))).drop("features", "scaled_sample", "scaled")


class Classifier(NamedTuple):
    """A sales-class forest with the encoder its rows need."""
    encoder: Encoder
    model: Model

    def transform(self, rows: DataFrame) -> DataFrame:
        named = IndexToString(inputCol="prediction", outputCol="predicted_class", labels=R.CLASSES)
        return named.transform(self.model.transform(self.encoder.transform(rows))).drop(
            "features", "rawPrediction", "probability", "prediction")


def classify(monthly: DataFrame, trees: int = 220, depth: int = 10, seed: int = 42) -> tuple[Classifier, DataFrame]:
    """Sales-class forest and its predictions on the stratified test rows."""
    numbers = present(monthly, R.CLASS_FEATURES)
    table = stage(monthly.select(*GRAIN, "qty", "shop_region", *numbers), "class-table")
    encoder = fit_encoder(table, numbers, ["shop_region"])
    table = stratified_split(R.sales_class(table), "sales_class", GRAIN, R.CLASSES, seed=seed)
    classes = StringIndexerModel.from_labels(R.CLASSES, "sales_class", "class_ix")
    encoded = spread(stage(classes.transform(encoder.transform(table)).select(
        *GRAIN, "sales_class", "class_ix", "is_test", "features"), "class-rows"), *GRAIN)
    model = R.sales_forest(trees, depth, seed).fit(encoded.where(~F.col("is_test")))
    named = IndexToString(inputCol="prediction", outputCol="predicted_class", labels=R.CLASSES)
    scored = named.transform(model.transform(encoded.where("is_test")))
    return Classifier(encoder, model), scored.select(*GRAIN, "sales_class", "predicted_class")
