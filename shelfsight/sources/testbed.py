"""The seven retail tables as views of the test parquet, dirty on purpose.

Every table is built from all rows of its source. Bad values are planted by
expressions on keys (unparseable dates, nulls, dangling and null foreign keys,
reversed promotions), so that no cleaning operator is vacuous.

A product line is ``l_partkey % 20``: a supplier sells 20 lines, which keeps
about 25 months per (shop, item) series at every scale factor while the number
of series grows with the suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import spread

SOURCES = ["region", "nation", "supplier", "part", "orders", "lineitem"]  # the test tables read here

SALES = [
    "case when l_orderkey % 997 = 0 then 'not-a-date' else cast(cast(l_shipdate as date) as string) end as date",
    "case when l_orderkey % 503 = 0 then null when l_orderkey % 41 = 0 then -1 - l_suppkey"
    " else l_suppkey end as shop_id",
    "case when l_orderkey % 59 = 0 then 1000 + l_partkey % 20 else l_partkey % 20 end as item_id",
    "floor(l_extendedprice / l_quantity * 100) / 100 as item_mrp_inr",
    "case when l_orderkey % 211 = 0 then null"
    " else floor(l_extendedprice / l_quantity * (1 - l_discount) * 100) / 100 end as item_price_inr",
    "case when l_orderkey % 13 = 0 then 'n/a' else cast(cast(floor(l_discount * 1000 + 0.5) / 10"
    " as decimal(18,1)) as string) end as discount_pct",
    "case when l_orderkey % 307 = 0 then null when l_returnflag = 'R' and l_linenumber = 1"
    " then -l_quantity else l_quantity end as item_cnt_day",
    "floor(l_extendedprice * (1 - l_discount) * 10000 + 0.5) / 10000 as revenue_inr",
    "case when l_discount >= 0.08 then 1 when l_discount < 0.01 then null else 0 end as is_promo",
    "case when l_returnflag = 'R' and l_linestatus = 'F' then 1 else 0 end as stockout_flag",
]

INVENTORY = [
    "l_orderkey * 8 + l_linenumber as inventory_snapshot_id",
    "case when l_orderkey % 991 = 0 then null"
    " else cast(date_add(trunc(cast(l_shipdate as date), 'WEEK'), 6) as string) end as week_ending_date",
    "l_suppkey as shop_id",
    "l_partkey % 20 as item_id",
    "case when l_orderkey % 17 = 0 then 'none'"
    " else cast(cast(l_quantity * 10 as int) + l_linenumber as string) end as on_hand_qty",
    "50 + l_linenumber * 5 as reorder_point_qty",
    "case when l_orderkey % 19 = 0 then null else 3 + l_linenumber end as supplier_lead_time_days",
]

PROMOTIONS = [
    "case when o_orderkey % 499 = 0 then 'soon' else cast(cast(o_orderdate as date) as string) end as start_date",
    "cast(date_add(cast(o_orderdate as date), cast(o_orderkey % 75"
    " - case when o_orderkey % 95 = 0 then 120 else 0 end as int)) as string) as end_date",
    "cast(floor(o_custkey / 15) as bigint) as shop_id",
    "cast(floor(o_orderkey / 5) as bigint) % 8 as item_category_id",
    "case when o_orderkey % 23 = 0 then null else cast(5 + o_orderkey % 30 as double) end as discount_pct",
    "case when o_orderkey % 35 = 0 then null else 1 + (o_orderkey % 8) * 0.125D end as demand_uplift_mult",
]


# Columns of the test tables in use; naming them spares the schema inference of every file.
COLUMNS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def retail_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    def read(name: str) -> DataFrame:
        return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

    lineitem, part = read("lineitem"), read("part")
    lines = spread(lineitem, "l_orderkey")
    return {
        "sales": lines.selectExpr(*SALES),
        "items": _items(part),
        "item_categories": part.selectExpr(
            "p_partkey % 20 % 8 as item_category_id",
            "concat('Category ', cast(p_partkey % 20 % 8 as string)) as item_category_name").distinct(),
        "shops": _shops(read("supplier"), read("nation"), read("region")),
        "calendar": _calendar(lineitem),
        "promotions": spread(read("orders"), "o_orderkey").selectExpr(*PROMOTIONS),
        "inventory_weekly": lines.selectExpr(*INVENTORY),
    }


def _items(part: DataFrame) -> DataFrame:
    lines = part.selectExpr("p_partkey % 20 as item_id", "*").groupBy("item_id")
    return lines.agg(*_exprs(
        "min_by(p_name, p_partkey) as p_name", "min_by(p_brand, p_partkey) as p_brand",
        "min_by(p_type, p_partkey) as p_type", "max(p_retailprice) as p_max",
        "min(p_retailprice) as p_min")).selectExpr(
        "item_id",
        "case when item_id = 11 then null else p_name end as item_name",
        "case when item_id = 13 then 99 else item_id % 8 end as item_category_id",
        "case when item_id % 9 = 4 then null else p_brand end as brand",
        "p_type as tier",
        "case when item_id % 7 = 0 then null else 'EA' end as pack_size_uom",
        "case when item_id = 3 then null else p_max end as mrp_inr",
        "case when item_id = 5 then null else p_min * 2 end as unit_cost_inr",
        "cast(item_id % 2 as int) as is_perishable")


def _shops(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    return (supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
            .join(region, nation.n_regionkey == region.r_regionkey)
            .selectExpr(
                "s_suppkey as shop_id",
                "n_name as shop_city",
                "concat('STATE_', cast(n_nationkey % 10 as string)) as shop_state",
                "case when s_suppkey % 29 = 3 then null else r_name end as shop_region",
                "s_name as shop_name",
                "case s_suppkey % 3 when 0 then 'Hypermarket' when 1 then 'Supermarket' end as store_type",
                "10000 + (s_suppkey * 7919) % 70000 as store_size_sqft",
                "case when s_suppkey % 17 = 5 then 'unknown' else"
                " cast(date_add(date'2010-01-01', cast(s_suppkey % 3000 as int)) as string) end as opening_date"))


def _calendar(lineitem: DataFrame) -> DataFrame:
    """Every day from the first ship date to five weeks before the last: late months have no calendar."""
    days = (lineitem.selectExpr("cast(l_shipdate as date) as d")
            .agg(*_exprs("min(d) as first_day", "date_sub(max(d), 35) as last_day"))
            .selectExpr("explode(sequence(first_day, last_day)) as d"))
    return days.selectExpr(
        "case when dayofyear(d) = 200 then 'not-a-date' else cast(d as string) end as date",
        "case when dayofweek(d) in (1, 7) then 1 else 0 end as is_weekend",
        "case when day(d) = 31 then null when date_format(d, 'MM-dd') in ('01-26', '08-15', '10-02')"
        " then 1 else 0 end as is_national_holiday",
        "case when month(d) in (10, 11) then 1 else 0 end as is_festive_season",
        "case when month(d) between 4 and 6 then 1 else 0 end as is_summer",
        "case when month(d) between 7 and 9 then 1 else 0 end as is_monsoon")


def _exprs(*texts: str):
    return [F.expr(t) for t in texts]
