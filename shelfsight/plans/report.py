"""Every result table and model, written to one output folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import series as S
from ..operators.anomaly import fit_isolation_forest, top_anomalies
from ..operators.linear import LinearFit
from ..operators.models import confusion_matrix, classification_report
from ..operators.monthly import GRAIN
from ..sources.staging import stage
from ..sources.writers import save_model, write_csv, write_parquet
from . import features as P
from . import forecasting as M


def write_reports(raw: dict[str, DataFrame], out: str, top_series: int | None = None, **model_params) -> None:
    """The whole analysis. Every series is back-tested unless ``top_series`` asks for the largest ones only."""
    t = P.valid_tables(raw)
    features = stage(P.monthly_from(t), "features")
    write_csv(features, f"{out}/monthly_features")
    write_parquet(features, f"{out}/monthly_features_parquet", ["year_month"])

    prepared = M.prepare(features)
    models = M.fit_models(prepared, **model_params)
    prepared.encoder.save(f"{out}/encoder")
    save_model(prepared.scaler, f"{out}/scaler")
    for name, model in models.items():
        if isinstance(model, LinearFit):
            model.save(features.sparkSession, f"{out}/model_{name}")
        else:
            save_model(model, f"{out}/model_{name}")
    write_csv(M.validation_scores(prepared, models), f"{out}/model_comparison_regression")

    arima = S.arima_backtest(features, top_n=top_series).orderBy("RMSE", "shop_id", "item_id")
    write_csv(arima.select("shop_id", "item_id", "RMSE"), f"{out}/model_comparison_arima_top_series")
    write_parquet(arima, f"{out}/arima_parameters")
    seasonal = stage(S.seasonal_fits(features, top_n=top_series), "seasonal")
    write_parquet(seasonal, f"{out}/seasonal_coefficients")
    write_csv(seasonal.where("status = 'ok'").select("shop_id", "item_id", "RMSE")
              .orderBy("RMSE", "shop_id", "item_id"), f"{out}/model_comparison_seasonal_top_series")
    sequence, frames = S.sequence_model(stage(S.total_series(features), "total-series"))
    sequence.save(features.sparkSession, f"{out}/model_sequence")
    write_csv(S.sequence_scores(sequence, frames), f"{out}/model_comparison_total_series")

    predicted = stage(M.forecast_next(prepared, M.best_model(prepared, models)[1]), "forecast")
    forecast = D.describe_forecast(predicted, t["items"], t["shops"])
    write_csv(forecast, f"{out}/forecast_next_month_shop_item")
    items = D.forecast_items(predicted, t["items"])
    write_csv(items.drop("pred_qty_next_year"), f"{out}/forecast_next_month_items")
    write_csv(items, f"{out}/forecast_items_month_and_year")
    write_csv(D.shop_profit(features, t["shops"]), f"{out}/profit_ranking_shops")
    write_csv(D.whatif_price(forecast), f"{out}/whatif_price_increase")
    write_csv(D.inventory_plan(forecast, D.latest_inventory(t["inventory_weekly"])),
              f"{out}/inventory_reorder_plan_next_month")

    forest_params = {k: v for k, v in model_params.items() if k in ("trees", "depth", "seed")}
    classifier, scored = M.classify(features, **forest_params)
    scored = stage(scored, "class-predictions")
    classifier.encoder.save(f"{out}/encoder_sales_classes")
    save_model(classifier.model, f"{out}/model_sales_classes")
    write_csv(confusion_matrix(scored, "sales_class", "predicted_class"),
              f"{out}/classification_confusion_matrix")
    write_csv(classification_report(scored, "sales_class", "predicted_class"),
              f"{out}/classification_report")

    forest, scored = fit_isolation_forest(features)
    if forest is not None:
        forest.save(f"{out}/model_isolation_forest")
    anomalies = top_anomalies(scored)
    write_csv(features.join(anomalies.select(*GRAIN, "anomaly_score", "is_anomaly"), GRAIN)
              .orderBy("anomaly_score", *GRAIN), f"{out}/anomalies")
