"""Monthly facts, side tables, enrichment joins and row-based time features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, month_key, ratio
from ..functions.joins import small_side
from .cleaning import known, present

GRAIN = ["year_month", "shop_id", "item_id"]
SERIES = ["shop_id", "item_id"]
ITEM_ATTRIBUTES = ["item_category_id", "brand", "tier", "mrp_inr", "unit_cost_inr", "is_perishable"]
EXACT = "decimal(28,10)"  # of a summand; the sum has ten more digits, and a larger value is an error
SHOP_ATTRIBUTES = ["shop_city", "shop_state", "shop_region", "store_type", "store_size_sqft"]


def exact(c: str | Column) -> Column:
    """A number as a decimal; NaN and infinite values have none and become null."""
    return (F.col(c) if isinstance(c, str) else c).cast(EXACT)


def total(c: str | Column) -> Column:
    """The sum, 0 for an all-null group.

    Summed in decimals, so neither the order of rows nor their partitioning shows in the result.
    """
    return F.coalesce(F.sum(exact(c)).cast("double"), F.lit(0.0))


def mean(c: str | Column) -> Column:
    """Mean over the non-null values: an exact sum, divided once."""
    return F.try_divide(F.sum(exact(c)).cast("double"), F.count(exact(c)))


def count_sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def derive_calendar_keys(df: DataFrame, date: str = "date") -> DataFrame:
    """year, month and 'YYYY-MM' of a date column."""
    return df.withColumns({
        "year": F.year(date), "month": F.month(date), "year_month": month_key(F.col(date))})


def monthly_facts(sales: DataFrame) -> DataFrame:
    """Sales per month, shop and item.

    Grouped by the three columns that decide the others, so the result is
    partitioned the way the inventory join needs it.
    """
    return (known(sales, GRAIN).groupBy(*GRAIN).agg(
        total("item_cnt_day").alias("qty"),
        mean("item_price_inr").alias("avg_price"),
        mean("item_mrp_inr").alias("avg_mrp"),
        count_sum("is_promo").alias("promo_days"),
        count_sum("stockout_flag").alias("stockout_days"),
        total("revenue_inr").alias("revenue"))
        .withColumns({"year": F.substring("year_month", 1, 4).cast("int"),
                      "month": F.substring("year_month", 6, 2).cast("int")}))


def calendar_month(calendar: DataFrame) -> DataFrame:
    """Flag totals and number of days per month."""
    return (known(calendar, ["year_month"]).groupBy("year_month").agg(
        count_sum("is_national_holiday").alias("holiday_days"),
        count_sum("is_weekend").alias("weekend_days"),
        count_sum("is_festive_season").alias("festive_days"),
        count_sum("is_summer").alias("summer_days"),
        count_sum("is_monsoon").alias("monsoon_days"),
        F.count("date").alias("days_in_month")))


def promo_month_expand(promotions: DataFrame) -> DataFrame:
    """One row per promotion and month it touches; a reversed interval touches none."""
    return (known(promotions, ["start_date", "end_date"])
            .where(F.col("start_date") <= F.col("end_date"))
            .select(
                F.explode(F.sequence(F.trunc("start_date", "MM"), F.trunc("end_date", "MM"),
                                     F.expr("interval 1 month"))).alias("month_start"),
                "shop_id", "item_category_id",
                F.col("discount_pct").alias("promo_discount_pct"),
                F.col("demand_uplift_mult").alias("promo_uplift"))
            .select(month_key(F.col("month_start")).alias("year_month"), "shop_id",
                    "item_category_id", "promo_discount_pct", "promo_uplift"))


def promo_month(expanded: DataFrame) -> DataFrame:
    """Mean discount, mean uplift and number of campaigns per month, shop and category."""
    keys = ["year_month", "shop_id", "item_category_id"]
    return known(expanded, keys).groupBy(*keys).agg(
        mean("promo_discount_pct").alias("promo_discount_pct"),
        mean("promo_uplift").alias("promo_uplift"),
        F.count("promo_uplift").alias("promo_campaigns"))


def inventory_month(inventory: DataFrame) -> DataFrame:
    """Mean stock, reorder point and lead time, and number of snapshots, on the monthly grain."""
    return known(inventory, GRAIN).groupBy(*GRAIN).agg(
        mean("on_hand_qty").alias("avg_on_hand"),
        mean("reorder_point_qty").alias("avg_reorder_point"),
        mean("supplier_lead_time_days").alias("avg_lead_time"),
        F.count("inventory_snapshot_id").alias("inv_snapshots"))


def attach(df: DataFrame, dim: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join with the wanted columns of a dimension, broadcast if its checked size allows."""
    return df.join(small_side(dim, [key, *present(dim, columns)]), key, "left")


def enrich_items(monthly: DataFrame, items: DataFrame) -> DataFrame:
    return attach(monthly, items, "item_id", ITEM_ATTRIBUTES)


def enrich_categories(monthly: DataFrame, categories: DataFrame) -> DataFrame:
    return attach(monthly, categories, "item_category_id", ["item_category_name"])


def enrich_shops(monthly: DataFrame, shops: DataFrame) -> DataFrame:
    return attach(monthly, shops, "shop_id", SHOP_ATTRIBUTES)


def enrich_calendar(monthly: DataFrame, calendar_months: DataFrame) -> DataFrame:
    """``calendar_months`` has one row per month of the years 1 to 9999 at most, so a broadcast is safe."""
    return monthly.join(F.broadcast(calendar_months), "year_month", "left")


def enrich_promotions(monthly: DataFrame, promo_months: DataFrame) -> DataFrame:
    """Promotion measures, with the values of 'no promotion' where there is none."""
    return (monthly.join(promo_months, ["year_month", "shop_id", "item_category_id"], "left")
            .na.fill({"promo_discount_pct": 0.0, "promo_uplift": 1.0, "promo_campaigns": 0}))


def enrich_inventory(monthly: DataFrame, inventory_months: DataFrame) -> DataFrame:
    """Stock measures, 0 where there is no snapshot."""
    return (monthly.join(inventory_months, GRAIN, "left")
            .na.fill({"avg_on_hand": 0.0, "avg_reorder_point": 0.0, "avg_lead_time": 0.0,
                      "inv_snapshots": 0}))


def price_features(monthly: DataFrame) -> DataFrame:
    """Selling price over list price, and the discount it implies."""
    return (monthly
            .withColumn("price_ratio", ratio(F.col("avg_price"), F.col("avg_mrp"), 1.0))
            .withColumn("price_discount_pct", clip(1.0 - F.col("price_ratio"), -1, 1)))


def series_window(keys: list[str] = SERIES) -> Window:
    """Rows of one series in time order. A series has one row per month, so a partition stays small."""
    return Window.partitionBy(*keys).orderBy("year", "month")


def lag_features(monthly: DataFrame, lags: tuple[int, ...] = (1, 2, 3), filled: bool = True) -> DataFrame:
    """Quantity of the previous rows of the series and price of the last one."""
    w = series_window()
    new = {f"qty_lag_{k}": F.lag("qty", k).over(w) for k in lags}
    new["price_lag_1"] = F.lag("avg_price", 1).over(w)
    return monthly.withColumns(_zero_filled(new) if filled else new)


def rolling_mean(monthly: DataFrame, sizes: tuple[int, ...] = (3, 6), filled: bool = True) -> DataFrame:
    """Mean quantity of the n previous rows; missing until there are n of them."""
    w = series_window()
    new = {}
    for n in sizes:
        frame = w.rowsBetween(-n, -1)
        new[f"qty_roll_{n}"] = F.when(F.count("qty").over(frame) == n, F.sum("qty").over(frame) / n)
    return monthly.withColumns(_zero_filled(new) if filled else new)


def price_change(monthly: DataFrame) -> DataFrame:
    """Relative price move against the previous row; null on the first row of a series."""
    before = F.lag("avg_price", 1).over(series_window())
    return (monthly.withColumn("price_change_pct", (F.col("avg_price") - before) / (before + 1e-6))
            .withColumn("price_change_pct", clip(F.col("price_change_pct"), -2, 2)))


def trend_and_intensity(monthly: DataFrame) -> DataFrame:
    """Short minus long rolling mean, and share of the month on promotion."""
    share = ratio(F.col("promo_days").cast("double"), F.col("days_in_month"), 0.0)
    return monthly.withColumns({
        "qty_trend": F.col("qty_roll_3") - F.col("qty_roll_6"),
        "promo_intensity": clip(share, 0, 1)})


def next_month_target(monthly: DataFrame) -> DataFrame:
    """Quantity of the next row of the series; the last row has none and is dropped."""
    return (monthly.withColumn("qty_next_month", F.lead("qty", 1).over(series_window()))
            .na.drop(subset=["qty_next_month"]))


def promo_flag(monthly: DataFrame) -> DataFrame:
    """1 for a month with at least one promotion sale."""
    return monthly.withColumn("promo_flag", (F.col("promo_days") > 0).cast("int"))


def densify_months(monthly: DataFrame) -> DataFrame:
    """Add a zero-quantity row for every month a series skips, so row-based features become calendar-based."""
    start, end = (F.to_date(F.concat(f("year_month"), F.lit("-01"))) for f in (F.min, F.max))
    grid = (monthly.groupBy(*SERIES).agg(start.alias("a"), end.alias("b"))
            .select(*SERIES, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("d"))
            .select(month_key(F.col("d")).alias("year_month"), *SERIES,
                    F.year("d").alias("year"), F.month("d").alias("month")))
    return (grid.join(monthly.drop("year", "month"), GRAIN, "left")
            .na.fill(0, subset=present(monthly, ["qty", "revenue", "promo_days", "stockout_days"])))


def _zero_filled(new: dict[str, Column]) -> dict[str, Column]:
    return {name: F.coalesce(c, F.lit(0.0)) for name, c in new.items()}
