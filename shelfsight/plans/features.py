"""Raw tables to the monthly feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.joins import check_sizes, is_small, keyed_once
from ..operators import cleaning as C
from ..operators import integrity as I
from ..operators import monthly as M
from ..sources.readers import typed
from ..sources.staging import stage

Tables = dict[str, DataFrame]

SALES_NUMBERS = ["item_mrp_inr", "item_price_inr", "discount_pct", "item_cnt_day", "revenue_inr"]
CALENDAR_FLAGS = ["is_weekend", "is_national_holiday", "is_festive_season", "is_summer", "is_monsoon"]
INVENTORY_NUMBERS = ["on_hand_qty", "reorder_point_qty", "supplier_lead_time_days"]
FACT_KEYS = ["date", "shop_id", "item_id"]
PROMO_KEYS = ["year_month", "shop_id", "item_category_id"]
PROMO_MEASURES = ["promo_discount_pct", "promo_uplift", "promo_campaigns"]
FACT_FLAGS = ["is_promo", "stockout_flag"]
ITEM_LABELS = ["brand", "tier", "pack_size_uom", "item_name"]
SHOP_LABELS = ["shop_city", "shop_state", "shop_region", "store_type", "shop_name"]


def clean_sales(sales: DataFrame) -> DataFrame:
    """Dates, numbers and flags; foreign keys, caps and sanity come later, in that order."""
    out = C.drop_bad_dates(C.parse_dates(sales, ["date"]), ["date"])
    out = C.coerce_numeric(out, SALES_NUMBERS)
    return C.fill_numeric(out, {"discount_pct": 0.0, "is_promo": 0, "stockout_flag": 0})


def clean_calendar(calendar: DataFrame) -> DataFrame:
    out = C.drop_bad_dates(C.parse_dates(calendar, ["date"]), ["date"])
    return C.fill_numeric(out, dict.fromkeys(CALENDAR_FLAGS, 0))


def clean_promotions(promotions: DataFrame) -> DataFrame:
    out = C.coerce_numeric(C.parse_dates(promotions, ["start_date", "end_date"]),
                           ["discount_pct", "demand_uplift_mult"])
    return C.fill_numeric(out, {"discount_pct": 0.0, "demand_uplift_mult": 1.0})


def clean_inventory(inventory: DataFrame) -> DataFrame:
    out = C.coerce_numeric(C.parse_dates(inventory, ["week_ending_date"]), INVENTORY_NUMBERS)
    return C.fill_numeric(out, dict.fromkeys(INVENTORY_NUMBERS, 0))


def clean_tables(raw: Tables) -> Tables:
    """Every table cleaned on its own, before any rule that spans tables."""
    raw = {name: typed(C.standardize_cols(df), name) for name, df in raw.items()}
    return {
        "sales": clean_sales(raw["sales"]),
        "items": C.fill_unknown(raw["items"], ITEM_LABELS),
        "item_categories": raw["item_categories"],
        "shops": C.fill_unknown(C.parse_dates(raw["shops"], ["opening_date"]), SHOP_LABELS),
        "calendar": clean_calendar(raw["calendar"]),
        "promotions": clean_promotions(raw["promotions"]),
        "inventory_weekly": clean_inventory(raw["inventory_weekly"]),
    }


def relations(t: Tables) -> list[tuple[str, DataFrame, DataFrame]]:
    return [("shop_id", t["sales"], t["shops"]), ("item_id", t["sales"], t["items"]),
            ("item_category_id", t["items"], t["item_categories"])]


def valid_tables(raw: Tables) -> Tables:
    """Cleaned tables with dangling keys removed.

    Sales are checked against all items, also those dropped for their category:
    such sales stay, and find no item attributes later.
    """
    t = clean_tables(raw)
    check_sizes(t["shops"], t["items"], t["item_categories"])
    items = I.fk_filter(t["items"], {"item_category_id": t["item_categories"]})
    sales = I.fk_filter(t["sales"], {"shop_id": t["shops"], "item_id": t["items"]})
    return {**t, "sales": sales, "items": items}


def narrow_sales(valid_sales: DataFrame) -> DataFrame:
    """The columns that the monthly facts need, written once: the caps pass over them several times, and none of
    these passes parses dates or checks keys again."""
    return stage(C.column_subset(valid_sales, [*FACT_KEYS, *C.OUTLIER_COLUMNS, *FACT_FLAGS]), "valid-sales")


def trusted_sales(valid_sales: DataFrame) -> DataFrame:
    """Capped, plausible sales with their month."""
    return M.derive_calendar_keys(C.sanity_filter(C.cap_outliers(narrow_sales(valid_sales))))


def calendar_months(t: Tables) -> DataFrame:
    return M.calendar_month(M.derive_calendar_keys(t["calendar"]))


def promo_months(t: Tables) -> DataFrame:
    return M.promo_month(M.promo_month_expand(t["promotions"]))


def inventory_months(t: Tables) -> DataFrame:
    return M.inventory_month(M.derive_calendar_keys(t["inventory_weekly"], "week_ending_date"))


def enriched_months(t: Tables) -> DataFrame:
    """Monthly facts with inventory, item, shop, calendar and promotion attributes.

    Inventory first: facts and inventory are both grouped by the grain, so that
    join needs no further shuffle. The checked dimensions are broadcast.
    """
    m = M.enrich_inventory(M.monthly_facts(trusted_sales(t["sales"])), inventory_months(t))
    m = M.enrich_categories(M.enrich_items(m, t["items"]), t["item_categories"])
    m = M.enrich_calendar(M.enrich_shops(m, t["shops"]), calendar_months(t))
    return M.enrich_promotions(m, promo_months(t))


def with_history(months: DataFrame) -> DataFrame:
    """Price, lag, rolling and trend features: one shuffle and one sort by series."""
    m = M.price_change(M.rolling_mean(M.lag_features(M.price_features(months))))
    return M.trend_and_intensity(m)


def history_first(t: Tables) -> DataFrame:
    """What ``next_month_target(with_history(enriched_months(t)))`` gives where no dimension has a key twice.

    Such joins neither add nor drop rows, so windows see the same series before them. The exchanges by promotion key
    and by series then move quantities and measures only; names and calendar flags are attached to rows with a target.
    """
    facts = M.enrich_inventory(M.monthly_facts(trusted_sales(t["sales"])), inventory_months(t))
    items, small = t["items"], is_small(t["items"])
    m = M.attach(facts, items, "item_id", ["item_category_id"]) if small else M.enrich_items(facts, items)
    m = M.enrich_promotions(m, promo_months(t))
    if not is_small(t["shops"]):  # their join deals rows out by shop, which is how the windows want them
        m = M.enrich_shops(m, t["shops"])
    before = m.columns
    m = M.next_month_target(M.price_change(M.rolling_mean(M.lag_features(m))))
    history = [c for c in m.columns if c not in before]
    if small:
        m = M.enrich_items(m.drop("item_category_id"), items)
    m = M.enrich_categories(m, t["item_categories"])
    if is_small(t["shops"]):
        m = M.enrich_shops(m, t["shops"])
    m = M.enrich_calendar(m, calendar_months(t))
    before = m.columns
    m = M.trend_and_intensity(M.price_features(m))
    prices, trends = (new := [c for c in m.columns if c not in before])[:2], new[2:]
    names = [*PROMO_KEYS, "item_id", *facts.columns, *M.ITEM_ATTRIBUTES, "item_category_name", *M.SHOP_ATTRIBUTES]
    late = [*PROMO_MEASURES, *prices, *history[:-1], *trends, *history[-1:]]
    flags = [c for c in m.columns if c not in names and c not in late]
    return m.select(*dict.fromkeys(c for c in [*names, *flags, *late] if c in m.columns))


def monthly_features(raw: Tables) -> DataFrame:
    """The modelling table: one row per month, shop and item that has a next month."""
    return monthly_from(valid_tables(raw))


def monthly_from(valid: Tables) -> DataFrame:
    if keyed_once({valid["items"]: "item_id", valid["shops"]: "shop_id", valid["item_categories"]: "item_category_id"}):
        return history_first(valid)
    return M.next_month_target(with_history(enriched_months(valid)))
