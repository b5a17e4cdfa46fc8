import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from shelfsight.operators import encoding as N
from shelfsight.operators import models as R
from shelfsight.operators.linear import LinearFit, fit_linear
from shelfsight.operators.monthly import GRAIN
from shelfsight.plans import forecasting as L
from shelfsight.sources.staging import stage
from shelfsight.sources.store import load_model, stored_model
from shelfsight.sources.writers import save_model


def test_one_hot_of_the_given_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "x string")
    out = N.one_hot(df, {"x": ["b", "c"]})
    assert out.columns == ["x_b", "x_c"]
    assert [tuple(r) for r in out.collect()] == [(1, 0), (0, 0), (0, 0), (0, 1)]


def test_dictionary_of_many_labels(spark):
    """Numbers follow the order of labels over all partitions; no label is left out."""
    n = 50_000
    df = spark.range(n * 2).select("id", (F.col("id") % n).cast("string").alias("many"),
                                   F.when(F.col("id") % 3 > 0, F.lit("only")).alias("one"), F.lit(None).cast("string").alias("none"))
    got = N.label_dictionary(df.repartition(7), ["many", "one", "none"]).toPandas()
    many = got[got["name"] == "many"].sort_values("place")
    assert many["label"].tolist() == sorted(map(str, range(n))) and many["place"].tolist() == list(range(n))
    assert set(many["n_labels"]) == {n}
    assert got[got["name"] == "one"][["label", "place", "n_labels"]].values.tolist() == [["only", 0, 1]]
    assert not (got["name"] == "none").any()

    encoder = N.fit_encoder(df, [], ["many", "one", "none"])
    assert encoder.sizes == {"many": n} and encoder.width == n - 1
    rows = encoder.transform(df.where("id in (0, 1, 49999)").select("id", "many", "one", "none")).collect()
    order = sorted(map(str, range(n)))
    for r in rows:
        place = order.index(r["many"])
        assert r["features"].size == n - 1
        assert r["features"].indices.tolist() == ([n - 1 - place] if place else [])


def test_encoder_fills_and_knows_its_labels(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.0, "k"), ("a", 2.0, "k"), (None, None, "k"), ("c", float("inf"), "k")],
                               "x string, n double, only string")
    encoder = N.fit_encoder(df, ["n"], ["x", "only"])
    new = df.unionByName(spark.createDataFrame([("unknown", 5.0, None)], df.schema))
    # labels are indexed from the last to the first; the first, null and unknown ones have no column
    want = [[1, 0, 1], [2, 0, 0], [0, 0, 0], [0, 1, 0], [5, 0, 0]]
    assert [list(r["features"].toArray()) for r in encoder.transform(new).collect()] == want
    encoder.save(str(tmp_path / "encoder"))
    again = N.Encoder.load(spark.newSession(), str(tmp_path / "encoder"))
    assert [list(r["features"].toArray()) for r in again.transform(new).collect()] == want


def test_scaling_uses_train_statistics(spark):
    train = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, k double")
    new = spark.createDataFrame([(3.0, 9.0)], "a double, k double")
    out = N.standard_scale(train, train.unionByName(new), ["a", "k"]).collect()
    x = np.array([1.0, 2.0, 6.0])
    want = (np.array([1.0, 2.0, 6.0, 3.0]) - x.mean()) / x.std()
    assert [r["a"] for r in out] == pytest.approx(list(want))
    assert [r["k"] for r in out] == [0.0] * 4


def test_metrics_with_zero_actuals(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 5.0)], "y double, p double")
    r = R.regression_metrics(df, "y", "p").first()
    assert (r["RMSE"], r["MAE"]) == (1.0, 1.0)
    assert r["MAPE_%"] == pytest.approx((1 + 0.5 + 0.25) / 3 * 100)


def test_confusion_and_report(spark):
    pairs = [("LOW", "LOW"), ("LOW", "HIGH"), ("HIGH", "HIGH"), ("HIGH", "HIGH")]
    df = spark.createDataFrame(pairs, "a string, p string")
    assert [tuple(r) for r in R.confusion_matrix(df, "a", "p").collect()] == [
        ("LOW", 1, 0, 1), ("MEDIUM", 0, 0, 0), ("HIGH", 0, 0, 2)]
    rows = R.classification_report(df, "a", "p").collect()
    report = {r["sales_class"]: r for r in rows}
    assert [r["sales_class"] for r in rows] == [*R.CLASSES, "macro avg", "weighted avg"]
    assert report["macro avg"]["precision"] == pytest.approx((1 + 0 + 2 / 3) / 3)
    assert report["macro avg"]["recall"] == pytest.approx((0.5 + 0 + 1) / 3) and report["macro avg"]["support"] == 4
    assert report["weighted avg"]["recall"] == pytest.approx(0.75)
    assert report["weighted avg"]["f1"] == pytest.approx((2 / 3 + 0.8) / 2)
    assert report["HIGH"]["precision"] == pytest.approx(2 / 3) and report["HIGH"]["recall"] == 1.0
    assert report["MEDIUM"]["f1"] == 0.0 and report["LOW"]["accuracy"] == 0.75


@pytest.fixture(scope="module")
def prepared(monthly):
    return L.prepare(monthly)


def test_rows_are_written_encoded_and_not_scaled(spark, prepared):
    """Fits and the scaler read the same table; the dense scaled copy is made when it is read."""
    written = spark.read.parquet(prepared.rows.inputFiles()[0]).columns
    assert "features" in written and "scaled" not in written
    assert {"features", "scaled"} <= set(prepared.rows.columns)


def test_linear_regression_is_least_squares(prepared):
    model = L.fit_models(prepared, ["LinearRegression"])["LinearRegression"]
    rows = prepared.train.select("scaled", R.TARGET).collect()
    x = np.column_stack([np.array([r["scaled"].toArray() for r in rows]), np.ones(len(rows))])
    y = np.array([r[R.TARGET] for r in rows])
    assert abs(x[:, :-1].mean(axis=0)).max() < 1e-9
    # collinear dummies leave the coefficients free, but not the residuals
    best = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    got = y - np.array([r["prediction"] for r in model.transform(prepared.train).select("prediction").collect()])
    assert np.sqrt((got ** 2).mean()) == pytest.approx(np.sqrt((best ** 2).mean()), rel=1e-4)


def test_comparison_and_forecast(prepared, monthly):
    models = L.fit_models(prepared, trees=4, depth=4, stages=4)
    scores = L.validation_scores(prepared, models).collect()
    assert {r["Model"] for r in scores} == set(R.REGRESSORS) == set(R.regressors(1))
    assert [r["RMSE"] for r in scores] == sorted(r["RMSE"] for r in scores)
    name, best = L.best_model(prepared, models)
    assert name == scores[0]["Model"]
    forecast = L.forecast_next(prepared, best)
    last = monthly.agg({"year_month": "max"}).first()[0]
    assert forecast.count() == monthly.where(f"year_month = '{last}'").count()
    assert forecast.where("pred_qty_next_month < 0").count() == 0


def test_saved_models_score_raw_rows_alike(spark, prepared, monthly, tmp_path):
    """Encoder, scaler and models from the store, in another session, over raw rows."""
    models = L.fit_models(prepared, trees=3, depth=3, stages=2)
    prepared.encoder.save(str(tmp_path / "encoder"))
    save_model(prepared.scaler, str(tmp_path / "scaler"))
    other = spark.newSession()
    encoder = N.Encoder.load(other, str(tmp_path / "encoder"))
    scaler = PipelineModel.load(str(tmp_path / "scaler"))
    raw = monthly.select(*GRAIN, *R.FEATURES, *R.LABELS)
    for name, model in models.items():
        path = str(tmp_path / name)
        if isinstance(model, LinearFit):
            model.save(spark, path)
            again = LinearFit.load(other, path)
        else:
            save_model(model, path)
            again = load_model(spark, path)
        got = L.score(raw, encoder, scaler, again).select(*GRAIN, F.col("prediction").alias("again"))
        want = model.transform(prepared.rows).select(*GRAIN, "prediction")
        both = want.join(got, GRAIN)
        assert both.count() == monthly.count()
        assert both.where("abs(prediction - again) > 1e-9 * (1 + abs(prediction))").count() == 0

    classifier, scored = L.classify(monthly, trees=3, depth=3)
    classifier.encoder.save(str(tmp_path / "class-encoder"))
    save_model(classifier.model, str(tmp_path / "classes"))
    again = L.Classifier(N.Encoder.load(other, str(tmp_path / "class-encoder")), load_model(spark, str(tmp_path / "classes")))
    raw = monthly.select(*GRAIN, "shop_region", *R.CLASS_FEATURES)
    rescored = again.transform(raw).select(*GRAIN, F.col("predicted_class").alias("again"))
    assert scored.join(rescored, GRAIN).where("predicted_class <=> again").count() == scored.count()


def test_stored_models_follow_their_files(spark, tmp_path):
    """A second query reloads the model; other files make another fingerprint."""
    data = str(tmp_path / "rows.parquet")
    fits = []

    def fit():
        fits.append(1)
        return N.fit_scaler(spark.read.parquet(data))

    def write(n):
        rows = spark.range(n).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"))
        rows.write.mode("overwrite").parquet(data)

    write(5)
    stored_model(spark, [data], "m", fit)
    stored_model(spark, [data], "m", fit)
    assert len(fits) == 1
    write(50)
    assert stored_model(spark, [data], "m", fit).stages[0].mean[0] == 24.5
    assert len(fits) == 2


def test_wide_moments_on_far_values_and_any_partitioning(spark):
    """Values near 1e9 with small spread: moments of tasks are put together around their own means."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) + 1e9
    x[:, 2] = x[:, 0] - 1e9 + (x[:, 1] - 1e9)  # depends on the others
    y = 3 * (x[:, 0] - 1e9) - 2 * (x[:, 1] - 1e9) + 7
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "features array<double>, y double")
    for parts in (1, 5):
        fit = fit_linear(df.repartition(parts), "features", "y", 3)
        got = [r["prediction"] for r in fit.transform(df).collect()]
        # the values themselves have seven digits after the point
        assert np.abs(np.array(got) - y).max() < 1e-5
    with pytest.raises(ValueError):
        fit_linear(df.limit(0), "features", "y", 3)
    with pytest.raises(ValueError):
        fit_linear(df, "features", "y", 10 ** 6)


def test_classes_cover_the_test_rows(monthly):
    _, scored = L.classify(monthly, trees=5, depth=4)
    total = sum(sum(r[c] for c in R.CLASSES)
                for r in R.confusion_matrix(scored, "sales_class", "predicted_class").collect())
    n = monthly.count()
    assert total == scored.count() and n / 5 <= total <= n / 5 + 3
    assert scored.select(*GRAIN).distinct().count() == total


def test_regional_classes(monthly):
    by_region = R.sales_class(monthly, by_region=True).toPandas()
    for _, g in by_region.groupby("shop_region"):
        q1, q2 = g["qty"].quantile([0.33, 0.66])
        assert ((g["sales_class"] == "LOW") == (g["qty"] <= round(q1, 4))).all()
        assert ((g["sales_class"] == "HIGH") == (g["qty"] > round(q2, 4))).all()


def test_staged_tables_are_written_with_zstd(spark):
    rows = stage(spark.range(100).selectExpr("id", "id * 0.5 as half"), "small")
    assert rows.inputFiles() and all(f.endswith(".zstd.parquet") for f in rows.inputFiles())
    assert rows.agg({"id": "sum"}).first()[0] == 4950
