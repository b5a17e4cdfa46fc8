"""Every operator as a query over the test tables: ``fn(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import cleaning as C
from ..operators import decisions as D
from ..operators import eda as E
from ..operators import encoding as N
from ..operators import forest as T
from ..operators import integrity as I
from ..operators import models as R
from ..operators import monthly as M
from ..operators import sampling as A
from ..operators import series as S
from ..operators.anomaly import isolation_forest, top_anomalies
from ..sources.readers import count_checked, read_csv_checked, read_csv_table, table_profile, typed
from ..sources.staging import stage, staging_path
from ..sources.testbed import SOURCES, retail_tables
from ..sources.store import stored_model
from ..sources.writers import write_csv
from . import features as P
from . import forecasting as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
GRAIN = M.GRAIN
# wide columns are for labels that the caller names; the first of each column is left out
DUMMY_LABELS = {"shop_region": ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "Unknown"],
                "store_type": ["Supermarket", "Unknown"],
                "item_category_name": [f"Category {i}" for i in range(1, 8)]}
SCALED_COLUMNS = ["qty", "avg_price", "revenue", "avg_on_hand", "qty_roll_3", "store_size_sqft"]
# the rows of each table whose lines are written again with one field too many
PLANTED = {"sales": "shop_id % 7 = 0", "items": "item_id % 7 = 0", "item_categories": "item_category_id % 7 = 0",
           "shops": "shop_id % 7 = 0", "calendar": "is_summer = 1", "promotions": "shop_id % 7 = 0",
           "inventory_weekly": "shop_id % 7 = 0"}
TREES = 220  # forests of the registered queries
DEPTH = 10  # Spark keeps trees on the driver: 2 ** depth nodes each bound them, whatever the rows


def tidy(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Output types shared with the SQL side: bigint, double, string. ``digits`` rounds computed floats.

    These are rounded as one array: written out for each of many columns, the code of a row becomes a method that is
    too long for the JVM to compile.
    """
    out = []
    floats = [] if digits is None else [name for name, kind in df.dtypes if kind in ("double", "float")]
    if floats:
        df = df.withColumn("__rounded", F.transform(F.array(*[F.col(f"`{c}`").cast("double") for c in floats]),
                                                    lambda x: rounded(x, digits)))
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint", "boolean", "bigint"):
            c = c.cast("int").cast("bigint") if kind == "boolean" else c.cast("bigint")
        elif kind == "date":
            c = c.cast("string")
        elif name in floats:
            c = F.col("__rounded")[floats.index(name)]
        if name != "__rounded":
            out.append(c.alias(name))
    return df.select(*out)


def _registrar(source: Callable[[P.Tables], object]):
    """A decorator factory: registers ``fn`` over ``source`` of the raw retail tables."""
    def query(digits: int | None = None):
        def register(fn: Callable) -> Callable:
            QUERIES[fn.__name__] = lambda spark, sf_dir: tidy(
                fn(source(retail_tables(spark, sf_dir))), digits)
            return fn
        return register
    return query


def facts(t: P.Tables) -> DataFrame:
    return M.monthly_facts(P.trusted_sales(t["sales"]))


query = _registrar(lambda raw: raw)
valid_query = _registrar(P.valid_tables)
facts_query = _registrar(lambda raw: facts(P.valid_tables(raw)))
monthly_query = _registrar(P.monthly_features)


def staged_query(columns: list[str], digits: int | None = None):
    """Register a query that passes over the monthly table more than once: the needed columns are written first."""
    return _registrar(lambda raw: stage(P.monthly_features(raw).select(*columns), "monthly"))(digits)


# --- sources and cleaning ---------------------------------------------------

@query()
def table_profiles(raw):
    return table_profile(raw)


@query()
def csv_round_trip(raw):
    """Promotions through the CSV writer and reader."""
    promotions = raw["promotions"]
    path = staging_path(promotions.sparkSession, "csv")
    write_csv(promotions, path)
    return typed(read_csv_table(promotions.sparkSession, path), "promotions")


@query()
def csv_quarantine(raw):
    """All seven tables through CSV, with lines of one field too many beside them; rows read and rows set aside."""
    kept = []
    for name, df in raw.items():
        path = staging_path(df.sparkSession, f"csv-{name}")
        write_csv(df, path)
        df.where(PLANTED[name]).withColumn("one_more", F.lit("x")).write.mode("append").option("header", True).csv(path)
        kept.append(count_checked(read_csv_checked(df.sparkSession, path, name, split=False), name))
    return reduce(DataFrame.unionByName, kept)


@query()
def standardize_cols(raw):
    p = raw["promotions"]
    return C.standardize_cols(p.toDF(*[f" {c.upper()} " for c in p.columns]))


@query()
def parse_dates(raw):
    return C.parse_dates(raw["sales"], ["date"]).select("date", "shop_id", "item_id", "revenue_inr")


@query()
def drop_bad_dates(raw):
    p = C.parse_dates(raw["promotions"], ["start_date", "end_date"])
    return C.drop_bad_dates(p, ["start_date", "end_date"])


@query()
def coerce_numeric(raw):
    return C.coerce_numeric(raw["sales"], P.SALES_NUMBERS)


@query()
def fill_numeric_defaults(raw):
    return P.clean_inventory(raw["inventory_weekly"])


@query()
def fill_unknown(raw):
    return C.fill_unknown(raw["shops"], P.SHOP_LABELS)


def _clean_query(table: str) -> None:
    """Dates, numbers, defaults and labels of a whole table, as the pipeline cleans it."""
    QUERIES[f"clean_{table}"] = lambda spark, sf_dir: tidy(P.clean_tables(retail_tables(spark, sf_dir))[table])


for _name in ("sales", "items", "shops", "calendar", "promotions"):
    _clean_query(_name)


@query()
def column_subset(raw):
    return C.column_subset(raw["promotions"], ["shop_id", "no_such_column", "discount_pct", "end_date"],
                           drop=["end_date"])


@query()
def fk_check(raw):
    return I.fk_check(P.relations(P.clean_tables(raw)))


@valid_query()
def fk_filter(t):
    return t["sales"]


@valid_query()
def cap_outliers(t):
    sales = C.cap_outliers(P.narrow_sales(t["sales"]))
    return sales.select("date", "shop_id", "item_id", *C.OUTLIER_COLUMNS)


@valid_query()
def sanity_filter(t):
    sales = C.sanity_filter(C.cap_outliers(P.narrow_sales(t["sales"])))
    return sales.select("date", "shop_id", "item_id", *C.OUTLIER_COLUMNS)


@query()
def derive_calendar_keys(raw):
    dated = M.derive_calendar_keys(P.clean_sales(raw["sales"]))
    return dated.select("date", "year", "month", "year_month", "shop_id", "item_id")


# --- monthly tables and joins -----------------------------------------------

@valid_query()
def monthly_facts(t):
    return facts(t)


@query()
def calendar_month(raw):
    return P.calendar_months(P.clean_tables(raw))


@query()
def promo_month_expand(raw):
    return M.promo_month_expand(P.clean_promotions(raw["promotions"]))


@query()
def promo_month(raw):
    return P.promo_months(P.clean_tables(raw))


@query()
def inventory_month(raw):
    return P.inventory_months(P.clean_tables(raw))


@valid_query()
def enrich_items(t):
    return M.enrich_items(facts(t), t["items"])


def _facts_with_category(t: P.Tables) -> DataFrame:
    return M.enrich_items(facts(t), t["items"]).select(*GRAIN, "item_category_id", "qty")


@valid_query()
def enrich_categories(t):
    return M.enrich_categories(_facts_with_category(t), t["item_categories"])


@valid_query()
def enrich_shops(t):
    return M.enrich_shops(facts(t), t["shops"])


@valid_query()
def enrich_calendar(t):
    return M.enrich_calendar(facts(t), P.calendar_months(t))


@valid_query()
def enrich_promotions(t):
    return M.enrich_promotions(_facts_with_category(t), P.promo_months(t))


@valid_query()
def enrich_inventory(t):
    return M.enrich_inventory(facts(t), P.inventory_months(t))


@facts_query(6)
def price_features(f):
    return M.price_features(f).select(
        *GRAIN, "avg_price", "avg_mrp", "price_ratio", "price_discount_pct")


@facts_query()
def lag_features(f):
    return M.lag_features(f).select(
        *GRAIN, "qty", "qty_lag_1", "qty_lag_2", "qty_lag_3", "price_lag_1")


@facts_query(6)
def rolling_mean(f):
    return M.rolling_mean(f, filled=False).select(*GRAIN, "qty", "qty_roll_3", "qty_roll_6")


@facts_query(6)
def price_change(f):
    return M.price_change(f).select(*GRAIN, "avg_price", "price_change_pct")


@valid_query(6)
def trend_and_intensity(t):
    with_calendar = M.enrich_calendar(facts(t), P.calendar_months(t))
    return M.trend_and_intensity(M.rolling_mean(with_calendar)).select(
        *GRAIN, "qty_trend", "promo_intensity")


@facts_query()
def next_month_target(f):
    return M.next_month_target(f).select(*GRAIN, "qty", "qty_next_month")


@query(6)
def monthly_features(raw):
    return P.monthly_features(raw)


@facts_query()
def densify_months(f):
    return M.densify_months(f).select(*GRAIN, "year", "month", "qty", "revenue")


# --- exploration ------------------------------------------------------------

@monthly_query()
def promo_flag(m):
    return M.promo_flag(m).select(*GRAIN, "promo_days", "promo_flag")


@monthly_query()
def total_monthly_qty(m):
    return E.total_monthly_qty(m)


@monthly_query()
def top_categories(m):
    return E.top_categories(m)


@monthly_query()
def top_shops_revenue(m):
    return E.top_shops_revenue(m)


@monthly_query(6)
def promo_vs_nonpromo(m):
    return E.promo_vs_nonpromo(m)


@monthly_query(6)
def stockout_impact(m):
    return E.stockout_impact(m)


@monthly_query(6)  # one pass: nothing is written first
def correlation_matrix(m):
    return E.correlation_matrix(m)


@monthly_query()
def series_rank(m):
    return E.series_rank(m)


@monthly_query()
def series_rank_all(m):
    return E.series_rank(m, None)


@monthly_query()
def distinct_months(m):
    return E.distinct_months(m)


@monthly_query()
def min_max(m):
    return E.min_max(E.total_monthly_qty(m), "qty")


@valid_query(4)
def quantiles(t):
    return E.quantiles(P.narrow_sales(t["sales"]), {c: [0.01, 0.5, 0.99] for c in C.OUTLIER_COLUMNS})


@staged_query([*GRAIN, "qty"])
def sales_class(m):
    return R.sales_class(m)


@staged_query([*GRAIN, "shop_region", "qty"])
def sales_class_by_region(m):
    return R.sales_class(m, by_region=True)


# --- samples, splits, encoding ----------------------------------------------

@staged_query([*GRAIN, "avg_price", "qty"])
def sample_exact(m):
    return A.sample_exact(m, 4000, GRAIN)


@staged_query([*GRAIN, "qty"])
def stratified_split(m):
    return A.stratified_split(R.sales_class(m).drop("qty"), "sales_class", GRAIN, R.CLASSES)


@staged_query([*GRAIN, "qty_next_month"])
def time_split(m):
    return A.time_split(m)


@monthly_query()
def series_holdout(m):
    return A.series_holdout(m).select(*GRAIN, "t", "n_rows", "is_validation")


@staged_query([*GRAIN, *DUMMY_LABELS])
def one_hot(m):
    return N.one_hot(m, DUMMY_LABELS)


@staged_query(R.LABELS)
def label_dictionary(m):
    return N.label_dictionary(m, R.LABELS)


@staged_query([*GRAIN, *SCALED_COLUMNS], 6)
def standard_scale(m):
    rows = C.fill_feature_matrix(A.time_split(m), SCALED_COLUMNS)
    return N.standard_scale(rows.where(~F.col("is_validation")), rows, SCALED_COLUMNS)


@monthly_query(6)
def fill_feature_matrix(m):
    return C.fill_feature_matrix(m.select(*GRAIN, *R.FEATURES), R.FEATURES)


@monthly_query(6)
def minmax_scale(m):
    return S.minmax_scale(S.total_series(m))


@monthly_query(6)
def sequence_frames(m):
    return _lag_columns(S.sequence_frames(S.total_series(m)), ["year_month"])


@monthly_query(6)
def sequence_frames_by_series(m):
    return _lag_columns(S.sequence_frames(m.select(*GRAIN, "qty"), M.SERIES), GRAIN)


def _lag_columns(df: DataFrame, keys: list[str], lookback: int = 12) -> DataFrame:
    return df.select(*keys, "scaled", *[
        F.col("lags")[i].alias(f"x_{i + 1}") for i in range(lookback)])


# --- scores given predictions -----------------------------------------------

@staged_query(["year_month", "qty_next_month", "qty_roll_3"], 6)
def regression_metrics(m):
    """Rolling mean as the prediction of the next month, by validation flag."""
    rows = A.time_split(m)
    return R.regression_metrics(rows, "qty_next_month", "qty_roll_3", ["is_validation"])


def _class_pairs(m: DataFrame) -> DataFrame:
    """Class of the next month as the truth, class of this month as the prediction."""
    rows = R.sales_class(m).withColumnRenamed("sales_class", "predicted").drop("qty")
    return R.sales_class(rows.withColumnRenamed("qty_next_month", "qty"))


@staged_query([*GRAIN, "qty", "qty_next_month"])
def confusion_matrix(m):
    return R.confusion_matrix(_class_pairs(m), "sales_class", "predicted")


@staged_query([*GRAIN, "qty", "qty_next_month"], 6)
def classification_report(m):
    return R.classification_report(_class_pairs(m), "sales_class", "predicted")


# --- series and decisions ---------------------------------------------------

@monthly_query(6)
def get_series(m):
    return S.get_series(m)


@monthly_query(4)
def arima_backtest(m):
    return S.arima_backtest(m)


@staged_query([*GRAIN, "year", "month", "qty"], 4)
def arima_backtest_top_series(m):
    return S.arima_backtest(m, top_n=5)


@monthly_query(6)
def seasonal_regression_backtest(m):
    return S.seasonal_regression_backtest(m)


@staged_query([*GRAIN, "qty"], 6)
def sequence_regression(m):
    return S.sequence_regression(m, M.SERIES)


@monthly_query(6)
def sequence_regression_total(m):
    return S.sequence_regression(stage(S.total_series(m), "total-series"))


@monthly_query(6)
def profit_columns(m):
    return D.profit_columns(m).select(*GRAIN, "revenue", "cost_est", "profit_est")


@valid_query(4)
def shop_profit(t):
    return D.shop_profit(P.monthly_from(t), t["shops"])


def _described(t: P.Tables) -> DataFrame:
    return D.describe_forecast(D.naive_forecast(P.monthly_from(t)), t["items"], t["shops"])


@valid_query(6)
def describe_forecast(t):
    return _described(t)


@valid_query(6)
def forecast_items(t):
    return D.forecast_items(D.naive_forecast(P.monthly_from(t)), t["items"])


@valid_query(6)
def whatif_price(t):
    forecast = stage(_described(t), "forecast")
    return D.whatif_price(forecast).select(
        "shop_id", "item_id", D.PREDICTED, "whatif_price_up_pct", "whatif_qty_multiplier",
        "whatif_pred_qty_next_month", "whatif_new_price", "whatif_revenue_next_month")


@valid_query(6)
def inventory_plan(t):
    latest = D.latest_inventory(t["inventory_weekly"])
    return D.inventory_plan(D.naive_forecast(P.monthly_from(t)), latest)


# --- fitted models ----------------------------------------------------------
# Every query prepares its rows and fits its linear model itself. Forests are fitted by the first query that needs
# them and stored below the shared folder, under a fingerprint of the input files and parameters; others reload them.

def _prepared(spark: SparkSession, sf_dir: str) -> L.Prepared:
    return L.prepare(P.monthly_features(retail_tables(spark, sf_dir)))


def _fitted(spark: SparkSession, sf_dir: str, prepared: L.Prepared, name: str) -> L.Fitted:
    def fit() -> L.Fitted:
        return L.fit_models(prepared, [name], trees=TREES, depth=DEPTH)[name]

    if name == "LinearRegression":
        return fit()
    return stored_model(spark, [f"{sf_dir}/{t}.parquet" for t in SOURCES], f"{name}-{TREES}-{DEPTH}", fit)


def _models(spark: SparkSession, sf_dir: str) -> tuple[L.Prepared, dict[str, L.Fitted]]:
    prepared = _prepared(spark, sf_dir)
    return prepared, {n: _fitted(spark, sf_dir, prepared, n) for n in R.REGRESSORS}


def _validation_query(key: str, name: str, digits: int = 6) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepared = _prepared(spark, sf_dir)
        scored = _fitted(spark, sf_dir, prepared, name).transform(prepared.validation)
        return tidy(scored.select(*GRAIN, R.TARGET, "prediction"), digits)
    QUERIES[key] = run


_validation_query("linear_regression", "LinearRegression", 4)
_validation_query("random_forest_reg", "RandomForestRegressor")
_validation_query("gradient_boosting", "GradientBoostingRegressor")


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(L.validation_scores(*_models(spark, sf_dir)), 6)


def forecast_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared, models = _models(spark, sf_dir)
    t = P.valid_tables(retail_tables(spark, sf_dir))
    forecast = L.forecast_next(prepared, L.best_model(prepared, models)[1])
    return tidy(D.describe_forecast(forecast, t["items"], t["shops"]), 6)


def sales_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scored = L.classify(P.monthly_features(retail_tables(spark, sf_dir)), trees=TREES, depth=DEPTH)
    return tidy(R.confusion_matrix(scored, "sales_class", "predicted_class"))


DEEP_TREES = 4  # trees without a depth limit in the registered query


def deep_forest_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bagged trees grown until no split is better than none, on the validation rows."""
    prepared = _prepared(spark, sf_dir)
    forest = T.fit_forest(prepared.train, GRAIN, "features", R.TARGET, trees=DEEP_TREES)
    return tidy(forest.transform(prepared.validation).select(*GRAIN, R.TARGET, "prediction"), 4)


QUERIES["deep_forest_reg"] = deep_forest_reg


@monthly_query(6)
def anomalies(m):
    return top_anomalies(isolation_forest(m))


# --- contracts of the fitted models ------------------------------------------
# What any right fit satisfies and SQL can state: rows, keys, attributes and ranges. They say nothing of accuracy.

def regressors_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model: validation rows and series, the total of the truth, predictions that are no number and, for the
    forest, whose leaves are means, predictions outside the range of the training rows."""
    prepared, models = _models(spark, sf_dir)
    low, high = prepared.train.agg(F.min(R.TARGET), F.max(R.TARGET)).first()
    p = F.col("prediction")

    def checked(name: str) -> DataFrame:
        outside = (p < low - 1e-6) | (p > high + 1e-6) if name == "RandomForestRegressor" else F.lit(False)
        return models[name].transform(prepared.validation).agg(
            F.count("*").alias("n_rows"), F.count_distinct(*M.SERIES).alias("n_series"),
            M.total(R.TARGET).alias("actual_total"), F.count_if(p.isNull() | F.isnan(p)).alias("n_missing"),
            F.count_if(outside).alias("n_outside")).withColumn("Model", F.lit(name))

    return tidy(reduce(DataFrame.unionByName, map(checked, models)), 6)


def linear_regression_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows and the mean residual, which is 0 for least squares with an intercept."""
    prepared = _prepared(spark, sf_dir)
    scored = _fitted(spark, sf_dir, prepared, "LinearRegression").transform(prepared.train)
    residual = F.col(R.TARGET) - F.col("prediction")
    return tidy(scored.agg(F.count("*").alias("n_train"), F.avg(residual).alias("mean_residual")), 4)


def forecast_next_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast rows with their attributes, and whether the prediction is a number of at least 0."""
    p = F.col(D.PREDICTED)
    out = forecast_next(spark, sf_dir)
    return tidy(out.withColumn("valid", F.coalesce((p >= 0) & ~F.isnan(p), F.lit(False))).drop(D.PREDICTED))


def sales_classifier_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows per true class."""
    support = reduce(lambda a, b: a + b, [F.col(c) for c in R.CLASSES])
    return tidy(sales_classifier(spark, sf_dir).select(F.col("actual").alias("sales_class"), support.alias("support")))


@monthly_query()
def isolation_forest_contract(m):
    """Rows scored, and whether the rows flagged are some, and at most the share asked for."""
    counts = isolation_forest(m).agg(F.count("*").alias("n_scored"), F.count_if(F.col("is_anomaly") == -1).alias("n"))
    return counts.select("n_scored", F.col("n").between(1, F.ceil(F.col("n_scored") * 0.02)).alias("share_ok"))


@monthly_query()
def seasonal_regression_contract(m):
    """Training rows of every series with a back-test."""
    return S.seasonal_regression_backtest(m).select(*M.SERIES, "n_train")


QUERIES.update(model_comparison=model_comparison, forecast_next=forecast_next,
               sales_classifier=sales_classifier, regressors_contract=regressors_contract,
               linear_regression_contract=linear_regression_contract,
               forecast_next_contract=forecast_next_contract, sales_classifier_contract=sales_classifier_contract)
QUERIES["isolation_forest"] = QUERIES.pop("anomalies")
QUERIES["table_profile"] = QUERIES.pop("table_profiles")
