"""Logical input tables.

Files are read as strings and coerced by the cleaning operators, so one bad
value never fails a scan and never changes the type of a column.
"""

from __future__ import annotations

from pyspark.sql import types as T

TABLES: dict[str, dict[str, str]] = {
    "sales": {
        "date": "date", "shop_id": "bigint", "item_id": "bigint",
        "item_mrp_inr": "double", "item_price_inr": "double", "discount_pct": "double",
        "item_cnt_day": "double", "revenue_inr": "double",
        "is_promo": "int", "stockout_flag": "int",
    },
    "items": {
        "item_id": "bigint", "item_name": "string", "item_category_id": "bigint",
        "brand": "string", "tier": "string", "pack_size_uom": "string",
        "mrp_inr": "double", "unit_cost_inr": "double", "is_perishable": "int",
    },
    "item_categories": {"item_category_id": "bigint", "item_category_name": "string"},
    "shops": {
        "shop_id": "bigint", "shop_city": "string", "shop_state": "string",
        "shop_region": "string", "shop_name": "string", "store_type": "string",
        "store_size_sqft": "bigint", "opening_date": "date",
    },
    "calendar": {
        "date": "date", "is_weekend": "int", "is_national_holiday": "int",
        "is_festive_season": "int", "is_summer": "int", "is_monsoon": "int",
    },
    "promotions": {
        "start_date": "date", "end_date": "date", "shop_id": "bigint",
        "item_category_id": "bigint", "discount_pct": "double",
        "demand_uplift_mult": "double",
    },
    "inventory_weekly": {
        "inventory_snapshot_id": "bigint", "week_ending_date": "date",
        "shop_id": "bigint", "item_id": "bigint", "on_hand_qty": "int",
        "reorder_point_qty": "int", "supplier_lead_time_days": "int",
    },
}

KEYS = ("shop_id", "item_id", "item_category_id", "inventory_snapshot_id")


def raw_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
