"""The catalog's queries as DuckDB SQL over the same parquet tables.

Written from the operator definitions, independently of the Spark code: plain
CTEs, global sorts, ``quantile_cont`` and ``corr``.
"""

from __future__ import annotations

import re

# Fixed values, spelled out here so that the code under test is not asked for them.
CORRELATION_COLUMNS = [
    "qty", "avg_price", "avg_mrp", "promo_days", "stockout_days", "revenue", "holiday_days", "weekend_days",
    "festive_days", "summer_days", "monsoon_days", "promo_discount_pct", "promo_uplift", "avg_on_hand",
    "avg_reorder_point", "avg_lead_time", "price_ratio", "price_discount_pct", "qty_lag_1", "qty_lag_2",
    "qty_lag_3", "qty_roll_3", "qty_roll_6", "price_change_pct", "qty_trend", "promo_intensity", "qty_next_month",
]
FEATURES = [
    "avg_price", "avg_mrp", "promo_days", "stockout_days", "revenue", "holiday_days", "weekend_days",
    "festive_days", "summer_days", "monsoon_days", "promo_discount_pct", "promo_uplift", "promo_campaigns",
    "avg_on_hand", "avg_reorder_point", "avg_lead_time", "inv_snapshots", "price_ratio", "price_discount_pct",
    "price_change_pct", "qty_lag_1", "qty_lag_2", "qty_lag_3", "qty_roll_3", "qty_roll_6", "qty_trend",
    "promo_intensity", "store_size_sqft",
]
LABELS = [
    "shop_city", "shop_state", "shop_region", "store_type", "brand", "tier", "item_category_name",
]

GRAIN = "year_month, shop_id, item_id"
SERIES = "shop_id, item_id"
SERIES_ORDER = "partition by shop_id, item_id order by year_month"
OUTLIERS = ["item_cnt_day", "item_price_inr", "item_mrp_inr", "revenue_inr"]


def rnd(expr: str, name: str, digits: int = 6) -> str:
    """Rounded output column without a negative zero."""
    r = f"round({expr}, {digits})"
    return f"case when {r} = 0 then 0.0::double else {r} end as {name}"


def total(expr: str, scale: int = 4) -> str:
    """An exact sum; the tables' amounts have at most ``scale`` decimals."""
    return f"coalesce(sum(cast({expr} as decimal(38,{scale})))::double, 0)"


def mean(expr: str) -> str:
    return f"sum(cast({expr} as decimal(38,4)))::double / nullif(count({expr}), 0)"


def big(expr: str, name: str) -> str:
    return f"{expr}::bigint as {name}"


def clip(expr: str, low: str, high: str) -> str:
    return f"case when {expr} is not null then greatest({low}, least({high}, {expr})) end"


CTES: dict[str, str] = {
    "raw_sales": """
        select case when l_orderkey % 997 = 0 then 'not-a-date' else cast(l_shipdate::date as varchar) end as date,
          case when l_orderkey % 503 = 0 then null when l_orderkey % 41 = 0 then -1 - l_suppkey
               else l_suppkey end as shop_id,
          case when l_orderkey % 59 = 0 then 1000 + l_partkey % 20 else l_partkey % 20 end as item_id,
          floor(l_extendedprice / l_quantity * 100) / 100 as item_mrp_inr,
          case when l_orderkey % 211 = 0 then null
               else floor(l_extendedprice / l_quantity * (1 - l_discount) * 100) / 100 end as item_price_inr,
          case when l_orderkey % 13 = 0 then 'n/a'
               else cast(cast(floor(l_discount * 1000 + 0.5) / 10 as decimal(18,1)) as varchar) end as discount_pct,
          case when l_orderkey % 307 = 0 then null when l_returnflag = 'R' and l_linenumber = 1
               then -l_quantity else l_quantity end as item_cnt_day,
          floor(l_extendedprice * (1 - l_discount) * 10000 + 0.5) / 10000 as revenue_inr,
          case when l_discount >= 0.08::double then 1 when l_discount < 0.01::double then null else 0 end as is_promo,
          case when l_returnflag = 'R' and l_linestatus = 'F' then 1 else 0 end as stockout_flag
        from lineitem""",
    "raw_items": """
        select f as item_id, case when f = 11 then null else n end as item_name,
          case when f = 13 then 99 else f % 8 end as item_category_id,
          case when f % 9 = 4 then null else b end as brand, t as tier,
          case when f % 7 = 0 then null else 'EA' end as pack_size_uom,
          case when f = 3 then null else hi end as mrp_inr,
          case when f = 5 then null else lo * 2 end as unit_cost_inr, f % 2 as is_perishable
        from (select p_partkey % 20 as f, arg_min(p_name, p_partkey) as n, arg_min(p_brand, p_partkey) as b,
                arg_min(p_type, p_partkey) as t, max(p_retailprice) as hi, min(p_retailprice) as lo
              from part group by 1)""",
    "raw_categories": """
        select distinct p_partkey % 20 % 8 as item_category_id,
          'Category ' || (p_partkey % 20 % 8) as item_category_name from part""",
    "raw_shops": """
        select s_suppkey as shop_id, n_name as shop_city, 'STATE_' || (n_nationkey % 10) as shop_state,
          case when s_suppkey % 29 = 3 then null else r_name end as shop_region, s_name as shop_name,
          case s_suppkey % 3 when 0 then 'Hypermarket' when 1 then 'Supermarket' end as store_type,
          10000 + (s_suppkey * 7919) % 70000 as store_size_sqft,
          case when s_suppkey % 17 = 5 then 'unknown'
               else cast(date '2010-01-01' + (s_suppkey % 3000)::int as varchar) end as opening_date
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "raw_calendar": """
        select case when dayofyear(d) = 200 then 'not-a-date' else cast(d as varchar) end as date,
          case when dayofweek(d) in (0, 6) then 1 else 0 end as is_weekend,
          case when day(d) = 31 then null
               when strftime(d, '%m-%d') in ('01-26', '08-15', '10-02') then 1 else 0 end as is_national_holiday,
          case when month(d) in (10, 11) then 1 else 0 end as is_festive_season,
          case when month(d) between 4 and 6 then 1 else 0 end as is_summer,
          case when month(d) between 7 and 9 then 1 else 0 end as is_monsoon
        from (select unnest(generate_series(min(l_shipdate::date), max(l_shipdate::date) - 35,
                                            interval 1 day))::date as d from lineitem)""",
    "raw_promotions": """
        select case when o_orderkey % 499 = 0 then 'soon' else cast(o_orderdate::date as varchar) end as start_date,
          cast(o_orderdate::date + (o_orderkey % 75
               - case when o_orderkey % 95 = 0 then 120 else 0 end)::int as varchar) as end_date,
          floor(o_custkey / 15)::bigint as shop_id, floor(o_orderkey / 5)::bigint % 8 as item_category_id,
          case when o_orderkey % 23 = 0 then null else (5 + o_orderkey % 30)::double end as discount_pct,
          case when o_orderkey % 35 = 0 then null
               else 1 + (o_orderkey % 8) * 0.125::double end as demand_uplift_mult
        from orders""",
    "raw_inventory": """
        select l_orderkey * 8 + l_linenumber as inventory_snapshot_id,
          case when l_orderkey % 991 = 0 then null
               else cast(date_trunc('week', l_shipdate)::date + 6 as varchar) end as week_ending_date,
          l_suppkey as shop_id, l_partkey % 20 as item_id,
          case when l_orderkey % 17 = 0 then 'none'
               else cast((l_quantity * 10)::int + l_linenumber as varchar) end as on_hand_qty,
          50 + l_linenumber * 5 as reorder_point_qty,
          case when l_orderkey % 19 = 0 then null else 3 + l_linenumber end as supplier_lead_time_days
        from lineitem""",
    "c_sales": """
        select try_cast(date as date) as date, shop_id, item_id, item_mrp_inr, item_price_inr,
          coalesce(try_cast(discount_pct as double), 0) as discount_pct, item_cnt_day, revenue_inr,
          coalesce(is_promo, 0)::bigint as is_promo, coalesce(stockout_flag, 0)::bigint as stockout_flag
        from raw_sales where try_cast(date as date) is not null""",
    "c_items": """
        select item_id, coalesce(item_name, 'Unknown') as item_name, item_category_id,
          coalesce(brand, 'Unknown') as brand, coalesce(tier, 'Unknown') as tier,
          coalesce(pack_size_uom, 'Unknown') as pack_size_uom, mrp_inr, unit_cost_inr,
          is_perishable::bigint as is_perishable
        from raw_items""",
    "c_shops": """
        select shop_id, coalesce(shop_city, 'Unknown') as shop_city, coalesce(shop_state, 'Unknown') as shop_state,
          coalesce(shop_region, 'Unknown') as shop_region, coalesce(shop_name, 'Unknown') as shop_name,
          coalesce(store_type, 'Unknown') as store_type, store_size_sqft, opening_date
        from raw_shops""",
    "c_calendar": """
        select try_cast(date as date) as date, is_weekend, coalesce(is_national_holiday, 0) as is_national_holiday,
          is_festive_season, is_summer, is_monsoon
        from raw_calendar where try_cast(date as date) is not null""",
    "c_promotions": """
        select try_cast(start_date as date) as start_date, try_cast(end_date as date) as end_date, shop_id,
          item_category_id, coalesce(discount_pct, 0) as discount_pct,
          coalesce(demand_uplift_mult, 1) as demand_uplift_mult
        from raw_promotions""",
    "c_inventory": """
        select inventory_snapshot_id, try_cast(week_ending_date as date) as week_ending_date, shop_id, item_id,
          coalesce(try_cast(on_hand_qty as int), 0)::bigint as on_hand_qty,
          reorder_point_qty::bigint as reorder_point_qty,
          coalesce(supplier_lead_time_days, 0)::bigint as supplier_lead_time_days
        from raw_inventory""",
    "v_sales": """
        select * from c_sales where shop_id in (select shop_id from c_shops)
          and item_id in (select item_id from c_items)""",
    "v_items": """
        select * from c_items where item_category_id in (select item_category_id from raw_categories)""",
    "caps": "select " + ", ".join(
        f"round(quantile_cont({c}, {q}), 4) as {c}_{side}" for c in OUTLIERS
        for side, q in (("lo", 0.01), ("hi", 0.99))) + " from v_sales",
    "capped": "select date, shop_id, item_id, is_promo, stockout_flag, " + ", ".join(
        f"{clip(c, c + '_lo', c + '_hi')} as {c}" for c in OUTLIERS) + " from v_sales, caps",
    "t_sales": """
        select *, strftime(date, '%Y-%m') as year_month from capped
        where item_cnt_day >= 0 and item_price_inr > 0""",
    "facts": f"""
        select {GRAIN}, {total('item_cnt_day')} as qty, {mean('item_price_inr')} as avg_price,
          {mean('item_mrp_inr')} as avg_mrp, sum(is_promo)::bigint as promo_days,
          sum(stockout_flag)::bigint as stockout_days, {total('revenue_inr')} as revenue,
          year(min(date))::bigint as year, month(min(date))::bigint as month
        from t_sales group by {GRAIN}""",
    "cal_month": """
        select strftime(date, '%Y-%m') as year_month, sum(is_national_holiday)::bigint as holiday_days,
          sum(is_weekend)::bigint as weekend_days, sum(is_festive_season)::bigint as festive_days,
          sum(is_summer)::bigint as summer_days, sum(is_monsoon)::bigint as monsoon_days,
          count(date)::bigint as days_in_month
        from c_calendar group by 1""",
    "promo_exp": """
        select strftime(m, '%Y-%m') as year_month, shop_id, item_category_id,
          discount_pct as promo_discount_pct, demand_uplift_mult as promo_uplift
        from (select *, unnest(generate_series(date_trunc('month', start_date), date_trunc('month', end_date),
                                               interval 1 month)) as m
              from c_promotions where start_date <= end_date)""",
    "promo_m": f"""
        select year_month, shop_id, item_category_id, {mean('promo_discount_pct')} as promo_discount_pct,
          {mean('promo_uplift')} as promo_uplift, count(promo_uplift)::bigint as promo_campaigns
        from promo_exp group by 1, 2, 3""",
    "inv_m": f"""
        select strftime(week_ending_date, '%Y-%m') as year_month, shop_id, item_id,
          {mean('on_hand_qty')} as avg_on_hand, {mean('reorder_point_qty')} as avg_reorder_point,
          {mean('supplier_lead_time_days')} as avg_lead_time, count(inventory_snapshot_id)::bigint as inv_snapshots
        from c_inventory where week_ending_date is not null group by 1, 2, 3""",
    "with_items": """
        select f.*, i.item_category_id, brand, tier, mrp_inr, unit_cost_inr, is_perishable
        from facts f left join v_items i using (item_id)""",
    "enriched": """
        select w.*, item_category_name, shop_city, shop_state, shop_region, store_type, store_size_sqft,
          holiday_days, weekend_days, festive_days, summer_days, monsoon_days, days_in_month,
          coalesce(promo_discount_pct, 0) as promo_discount_pct, coalesce(promo_uplift, 1) as promo_uplift,
          coalesce(promo_campaigns, 0) as promo_campaigns, coalesce(avg_on_hand, 0) as avg_on_hand,
          coalesce(avg_reorder_point, 0) as avg_reorder_point, coalesce(avg_lead_time, 0) as avg_lead_time,
          coalesce(inv_snapshots, 0) as inv_snapshots
        from with_items w left join raw_categories using (item_category_id)
          left join c_shops using (shop_id) left join cal_month using (year_month)
          left join promo_m p on p.year_month = w.year_month and p.shop_id = w.shop_id
            and p.item_category_id = w.item_category_id
          left join inv_m v on v.year_month = w.year_month and v.shop_id = w.shop_id and v.item_id = w.item_id""",
    "lagged": f"""
        select *, coalesce(avg_price / nullif(avg_mrp, 0), 1) as price_ratio,
          {clip('(1 - coalesce(avg_price / nullif(avg_mrp, 0), 1))', '-1', '1')} as price_discount_pct,
          coalesce(lag(qty, 1) over s, 0) as qty_lag_1, coalesce(lag(qty, 2) over s, 0) as qty_lag_2,
          coalesce(lag(qty, 3) over s, 0) as qty_lag_3, lag(avg_price) over s as price_before,
          case when count(qty) over (s rows between 3 preceding and 1 preceding) = 3
               then sum(qty) over (s rows between 3 preceding and 1 preceding) / 3 end as roll_3,
          case when count(qty) over (s rows between 6 preceding and 1 preceding) = 6
               then sum(qty) over (s rows between 6 preceding and 1 preceding) / 6 end as roll_6,
          lead(qty) over s as qty_next_month
        from enriched window s as ({SERIES_ORDER})""",
    "m": f"""
        select * exclude (roll_3, roll_6, price_before), coalesce(roll_3, 0) as qty_roll_3,
          coalesce(roll_6, 0) as qty_roll_6, coalesce(price_before, 0) as price_lag_1,
          {clip('((avg_price - price_before) / (price_before + 1e-6))', '-2', '2')} as price_change_pct,
          coalesce(roll_3, 0) - coalesce(roll_6, 0) as qty_trend,
          coalesce({clip('(promo_days / nullif(days_in_month, 0))', '0', '1')}, 0)::double as promo_intensity
        from lagged where qty_next_month is not null""",
    "tot": f"select year_month, {total('qty')} as qty from m group by 1",
    "split_month": """
        select min(year_month) as first_month
        from (select distinct year_month from m order by year_month desc limit 3)""",
    "classes": """
        select *, case when qty <= q1 then 'LOW' when qty <= q2 then 'MEDIUM' else 'HIGH' end as sales_class
        from m, (select round(quantile_cont(qty, 0.33), 4) as q1, round(quantile_cont(qty, 0.66), 4) as q2 from m)""",
    "pairs": """
        select sales_class as predicted,
          case when qty_next_month <= n1 then 'LOW' when qty_next_month <= n2 then 'MEDIUM'
               else 'HIGH' end as actual
        from classes, (select round(quantile_cont(qty_next_month, 0.33), 4) as n1,
                              round(quantile_cont(qty_next_month, 0.66), 4) as n2 from m)""",
    "holdout": f"""
        select {GRAIN}, qty, row_number() over ({SERIES_ORDER}) as t,
          count(*) over (partition by {SERIES}) as n_rows
        from m qualify n_rows >= 18""",
    "forecast": """
        select shop_id, item_id, greatest(0, qty_roll_3) as pred_qty_next_month
        from m where year_month = (select max(year_month) from m)""",
    "described": """
        select f.*, item_name, item_category_id, unit_cost_inr, mrp_inr, shop_city, shop_state, shop_region
        from forecast f left join v_items using (item_id) left join c_shops using (shop_id)""",
    "profits": """
        select *, coalesce(unit_cost_inr, 0) * qty as cost_est,
          revenue - coalesce(unit_cost_inr, 0) * qty as profit_est from m""",
    "diffs": """
        select *, case when t <= n_rows - 3 then qty - lag(qty) over (partition by shop_id, item_id order by t) end as d
        from {series_rows}""",
    "diff_lags": """
        select *, lag(d, 1) over s as d1, lag(d, 2) over s as d2
        from diffs window s as (partition by shop_id, item_id order by t)""",
    "ar_sums": """
        select shop_id, item_id, sum(d1 * d1) as s11, sum(d2 * d2) as s22, sum(d1 * d2) as s12,
          sum(d * d1) as p1, sum(d * d2) as p2
        from diff_lags where d + d1 + d2 is not null group by 1, 2""",
    "ar_fit": """
        select shop_id, item_id,
          case when det > 1e-9 * s11 * s22 then (p1 * s22 - p2 * s12) / det else 0 end as a1,
          case when det > 1e-9 * s11 * s22 then (p2 * s11 - p1 * s12) / det else 0 end as a2
        from (select *, s11 * s22 - s12 * s12 as det from ar_sums)""",
    "shocks": """
        select l.*, d - a1 * d1 - a2 * d2 as e from diff_lags l join ar_fit using (shop_id, item_id)""",
    "shock_lags": """
        select *, lag(e) over (partition by shop_id, item_id order by t) as e1 from shocks""",
    "arma_sums": """
        select shop_id, item_id, max(n_rows) - 3 as n_train,
          sum(d1 * d1) filter (d + d1 + e1 is not null) as s11, sum(e1 * e1) filter (d + d1 + e1 is not null) as s22,
          sum(d1 * e1) filter (d + d1 + e1 is not null) as s12, sum(d * d1) filter (d + d1 + e1 is not null) as p1,
          sum(d * e1) filter (d + d1 + e1 is not null) as p2, max(qty) filter (t = n_rows - 3) as y_n,
          max(d) filter (t = n_rows - 3) as d_n, max(e) filter (t = n_rows - 3) as e_n,
          max(qty) filter (t = n_rows - 2) as y1, max(qty) filter (t = n_rows - 1) as y2,
          max(qty) filter (t = n_rows) as y3
        from shock_lags group by 1, 2""",
    "arma_fit": """
        select *, greatest(-0.99::double, least(0.99::double,
            case when det > 1e-9 * s11 * s22 then (p1 * s22 - p2 * s12) / det else 0 end)) as phi,
          greatest(-0.99::double, least(0.99::double,
            case when det > 1e-9 * s11 * s22 then (p2 * s11 - p1 * s12) / det else 0 end)) as theta
        from (select *, s11 * s22 - s12 * s12 as det from arma_sums)""",
    "arma_steps": """
        select *, phi * d_n + theta * e_n as f1, phi * (phi * d_n + theta * e_n) as f2,
          phi * (phi * (phi * d_n + theta * e_n)) as f3 from arma_fit""",
}

ARIMA_OUT = f"""
    select {SERIES}, n_train::bigint as n_train, {rnd('phi', 'phi', 4)}, {rnd('theta', 'theta', 4)},
      {rnd('sqrt((pow(y1 - (y_n + f1), 2) + pow(y2 - (y_n + f1 + f2), 2) + pow(y3 - (y_n + f1 + f2 + f3), 2)) / 3)',
           'RMSE', 4)},
      case when det > 1e-9 * s11 * s22 then 'ok' else 'singular' end as status
    from arma_steps"""

VERDICT_ROWS = "(values (0, 'LOW'), (1, 'MEDIUM'), (2, 'HIGH')) as c(position, label)"


def _correlation_sql() -> str:
    pairs = ", ".join(f"{{'x': '{x}', 'y': '{y}', 'r': corr({x}, {y})}}"
                      for i, x in enumerate(CORRELATION_COLUMNS) for y in CORRELATION_COLUMNS[i:])
    value = "case when not isnan(r) then " + rnd("r", "v").removesuffix(" as v") + " end"
    return f"""
        with_pairs as (select p.x as x, p.y as y, p.r as r from (select unnest([{pairs}]) as p from m))
        select x as feature_x, y as feature_y, {value} as correlation from with_pairs
        union all select y, x, {value} from with_pairs where x <> y"""


def _sequence_sql(source: str, keys: str, partition: str) -> str:
    lags = ", ".join(f"lag(scaled, {13 - i}) over w as x_{i}" for i in range(1, 13))
    out = ", ".join(rnd(f"x_{i}", f"x_{i}") for i in range(1, 13))
    return f"""
        select {keys}, {rnd('scaled', 'scaled')}, {out}
        from (select *, {lags} from (
            select *, (qty - min(qty) over ({partition})) / (max(qty) over ({partition})
                       - min(qty) over ({partition}) + 1e-6) as scaled from {source})
          window w as ({partition} order by year_month))
        where x_1 is not null"""


def _standard_scale_sql() -> str:
    columns = ["qty", "avg_price", "revenue", "avg_on_hand", "qty_roll_3", "store_size_sqft"]
    train = "where year_month < (select first_month from split_month)"
    stats = ", ".join(f"avg(coalesce({c}, 0)) as mean_{c}, stddev_pop(coalesce({c}, 0)) as sd_{c}" for c in columns)
    out = ", ".join(rnd(f"coalesce((coalesce({c}, 0) - mean_{c}) / nullif(sd_{c}, 0), 0)", c) for c in columns)
    return f"""
        select {GRAIN}, (year_month >= first_month)::int::bigint as is_validation, {out}
        from m, split_month, (select {stats} from m {train})"""


def _one_hot_sql() -> str:
    labels = {"shop_region": ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "Unknown"],
              "store_type": ["Supermarket", "Unknown"],
              "item_category_name": [f"Category {i}" for i in range(1, 8)]}
    dummies = ", ".join(f"""coalesce({c} = '{v}', false)::int::bigint as "{c}_{v}\"""" for c, vs in labels.items()
                        for v in vs)
    return f"select {GRAIN}, {dummies} from m"


def _reason(dates: list[str]) -> str:
    cases = " ".join(f"when {c} is not null and try_cast({c} as date) is null then 'no date: {c}'" for c in dates)
    if "week_ending_date" in dates:  # the only column of numbers that holds words which are no missing value
        cases += " when on_hand_qty = 'none' then 'no number: on_hand_qty'"
    return f"case {cases} else 'read' end" if cases else "'read'"


def _solved(equations: str) -> str:
    """(k, beta) by Gauss-Jordan elimination of the rows of ``equations`` (columns r, a list of k coefficients and
    the right side, and k); an unknown that depends on those before it gets 0. Extra key columns: see _solved_by."""
    return _solved_by("", equations)


def _solved_by(keys: str, equations: str) -> str:
    lead = f"{keys}, " if keys else ""
    return f"""(
        with recursive e as (
          select {lead}1 as step, list(r order by k) as m from {equations} {f'group by {keys}' if keys else ''}
          union all
          select {lead}step + 1, case when abs(m[step][step]) < 1e-9 then m else
            [case when i = step then [v / m[step][step] for v in m[step]]
                  else [m[i][j] - m[i][step] / m[step][step] * m[step][j] for j in range(1, len(m) + 2)] end
             for i in range(1, len(m) + 1)] end
          from e where step <= len(m))
        select {lead}k, case when abs(m[k][k]) < 1e-9 then 0 else m[k][len(m) + 1] end as beta
        from (select *, unnest(range(1, len(m) + 1)) as k from e where step = len(m) + 1))"""


def _least_squares_sql(rows: str, entries: str) -> str:
    """(id, p): least squares of y on the entries (id, j, v; absent ones are 0), fitted on rows (id, held, y) that
    are not held and applied to those that are."""
    return f"""(
        with rw as ({rows}), en as ({entries}),
        total as (select count(*) as n, avg(y) as level from rw where not held),
        used as (select id, j, v, y from en join rw using (id) where not held),
        prod as (select a.j as i, b.j as j, sum(a.v * b.v) as s from used a join used b using (id) group by 1, 2),
        mean as (select j, sum(v) / any_value(n) as mu, sum(v * (y - level)) / any_value(n) as xy
                 from used, total group by j),
        kept as (select *, row_number() over (order by j) as k from (
                   select mean.*, sqrt(greatest(s / n - mu * mu, 0)) as sd
                   from mean join prod on prod.i = mean.j and prod.j = mean.j, total
                   where s / n - mu * mu > 1e-13 * mu * mu)),
        system as (
          select a.k, list((coalesce(s, 0) / n - a.mu * b.mu) / (a.sd * b.sd) order by b.k)
                   || [any_value(a.xy / a.sd)] as r
          from kept a cross join kept b left join prod on prod.i = a.j and prod.j = b.j, total group by a.k),
        beta as (select j, mu, beta / sd as slope from {_solved('system')} join kept using (k)),
        base as (select (select level from total) - coalesce(sum(slope * mu), 0) as start from beta)
        select rw.id, any_value(start) + coalesce(sum(slope * v), 0) as p
        from rw left join en using (id) left join beta using (j), base where held group by rw.id)"""


def _linear_regression_sql() -> str:
    numbers = ", ".join(f"coalesce({c}::double, 0)" for c in FEATURES)
    pairs = ", ".join(f"{{'name': '{c}', 'label': {c}}}" for c in LABELS)
    known = f"(select unnest([{pairs}], recursive := true) from m)"
    source = f"(select *, concat_ws('|', {GRAIN}) as id from m)"
    rows = f"""select id, year_month >= first_month as held, qty_next_month as y from {source}, split_month"""
    entries = f"""
        select id, j, v from (select id, unnest([{numbers}]) as v, unnest(range(1, {len(FEATURES) + 1})) as j
                              from {source}) where v <> 0
        union all
        select id, {len(FEATURES)} + j as j, 1.0::double as v
        from (select id, unnest([{pairs}], recursive := true) from {source}) join (
          select name, label, row_number() over (order by name, label) as j from (
            select distinct name, label from {known} where label is not null)
          qualify row_number() over (partition by name order by label) > 1) using (name, label)"""
    return f"""
        select {GRAIN}, qty_next_month, {rnd('p', 'prediction', 4)}
        from {source} join {_least_squares_sql(rows, entries)} using (id)"""


def _sequence_regression_sql(source: str, key: str, partition: str) -> str:
    lags = ", ".join(f"lag(scaled, {13 - i}) over w" for i in range(1, 13))
    frames = f"""(
        select *, row_number() over ({partition} order by year_month desc) <= 3 as held from (
          select *, [{lags}] as x, concat_ws('|', {key}) as id from (
            select *, (qty - lo) / (hi - lo + 1e-6) as scaled from (
              select *, min(qty) over ({partition}) as lo, max(qty) over ({partition}) as hi from {source}))
          window w as ({partition} order by year_month))
        where x[1] is not null)"""
    entries = f"select id, unnest(x) as v, unnest(range(1, 13)) as j from {frames}"
    fitted = _least_squares_sql(f"select id, held, scaled as y from {frames}", entries)
    return f"""
        select {rnd('sqrt(avg(e * e))', 'RMSE')}, {rnd('avg(abs(e))', 'MAE')},
          {rnd('avg(abs(e / case when abs(y) < 1e-6 then 1 else abs(y) end)) * 100', '"MAPE_%"')}
        from (select scaled * (hi - lo + 1e-6) + lo as y, (scaled - p) * (hi - lo + 1e-6) as e
              from {frames} join {fitted} using (id))"""


def _seasonal_sql() -> str:
    regressors = ["price_ratio", "promo_intensity", "festive_days", "holiday_days", "stockout_days"]
    waves = ", ".join(f"{f}(month * {k} * pi() / 6)" for f in ("sin", "cos") for k in (1, 2, 3))
    xs = f"[t / n_rows, {waves}, " + ", ".join(f"{c}::double" for c in regressors) + "]"
    rows = f"""(
        select {SERIES}, t, n_rows, t > n_rows - 3 as held, qty::double as y, {xs} as x,
          max(({' or '.join(f'{c} is null' for c in regressors)})::int) over (partition by {SERIES}) as gap
        from holdout join m using ({GRAIN}, qty))"""
    return f"""
        with s as (select * from {rows}),
        l as (select {SERIES}, t, held, y, unnest(x) as v, unnest(range(1, len(x) + 1)) as j from s where gap = 0),
        st as (select {SERIES}, j, avg(v) as mu, stddev_pop(v) as sd, avg(y) as level from l where not held group by all),
        z as (select {SERIES}, j, t, held, y - level as d,
                case when sd * sd > 1e-13 * mu * mu then (v - mu) / sd else 0 end as z from l join st using ({SERIES}, j)),
        a as (select {SERIES}, a.j as i, b.j as j, sum(a.z * b.z) + (a.j = b.j)::int as v
              from z a join z b using ({SERIES}, t) where not a.held group by {SERIES}, a.j, b.j),
        b as (select {SERIES}, j as i, sum(z * d) as v from z where not held group by all),
        eq as (select {SERIES}, i as k, list(a.v order by a.j) || [any_value(b.v)] as r
               from a join b using ({SERIES}, i) group by {SERIES}, i),
        beta as (select {SERIES}, k as j, beta from {_solved_by(SERIES, 'eq')}),
        er as (select {SERIES}, t, any_value(d) - sum(z * beta) as e from z join beta using ({SERIES}, j)
               where held group by {SERIES}, t),
        rm as (select {SERIES}, sqrt(avg(e * e)) as e from er group by {SERIES})
        select {SERIES}, (max(n_rows) - 3)::bigint as n_train, {rnd('any_value(e)', 'RMSE')},
          case when max(gap) = 1 then 'missing regressor' else 'ok' end as status
        from s left join rm using ({SERIES}) group by {SERIES}"""


def _label_dictionary_sql() -> str:
    pairs = ", ".join(f"{{'name': '{c}', 'label': {c}}}" for c in LABELS)
    return f"""
        select name, label, row_number() over (partition by name order by label) - 1 as place,
          count(*) over (partition by name) as n_labels
        from (select distinct * from (select unnest([{pairs}], recursive := true) from m) where label is not null)"""


def _quantile_sql() -> str:
    return " union all ".join(
        f"select '{c}' as column_name, {q}::double as q, round(quantile_cont({c}, {q}), 4) as value from v_sales"
        for c in OUTLIERS for q in (0.01, 0.5, 0.99))


MONTHLY_COLUMNS = {
    "keep": ["year_month", "shop_id", "item_id", "item_category_id", "qty", "promo_days", "stockout_days",
             "year", "month", "brand", "tier", "is_perishable", "item_category_name", "shop_city", "shop_state",
             "shop_region", "store_type", "store_size_sqft", "holiday_days", "weekend_days", "festive_days",
             "summer_days", "monsoon_days", "days_in_month", "promo_campaigns", "inv_snapshots"],
    "rounded": ["avg_price", "avg_mrp", "revenue", "mrp_inr", "unit_cost_inr", "promo_discount_pct",
                "promo_uplift", "avg_on_hand", "avg_reorder_point", "avg_lead_time", "price_ratio",
                "price_discount_pct", "qty_lag_1", "qty_lag_2", "qty_lag_3", "price_lag_1", "qty_roll_3",
                "qty_roll_6", "price_change_pct", "qty_trend", "promo_intensity", "qty_next_month"],
}


def _rounded(columns: list[str]) -> str:
    return ", ".join(rnd(c, c) for c in columns)


FINALS: dict[str, str] = {
    "table_profile": " union all ".join(
        f"select '{name}' as table_name, count(*)::bigint as n_rows, {n}::bigint as n_columns from {cte}"
        for name, cte, n in [("sales", "raw_sales", 10), ("items", "raw_items", 9),
                             ("item_categories", "raw_categories", 2), ("shops", "raw_shops", 8),
                             ("calendar", "raw_calendar", 6), ("promotions", "raw_promotions", 6),
                             ("inventory_weekly", "raw_inventory", 7)]),
    "csv_round_trip": "select * from raw_promotions",
    "csv_quarantine": " union all ".join(
        f"""select '{name}' as table_name, reason, count(*)::bigint as n_rows
            from (select {_reason(dates)} as reason from {cte} union all select 'number of fields' from {cte} where {bad})
            group by 1, 2""" for name, cte, dates, bad in [
            ("sales", "raw_sales", ["date"], "shop_id % 7 = 0"), ("items", "raw_items", [], "item_id % 7 = 0"),
            ("item_categories", "raw_categories", [], "item_category_id % 7 = 0"),
            ("shops", "raw_shops", ["opening_date"], "shop_id % 7 = 0"),
            ("calendar", "raw_calendar", ["date"], "is_summer = 1"),
            ("promotions", "raw_promotions", ["start_date", "end_date"], "shop_id % 7 = 0"),
            ("inventory_weekly", "raw_inventory", ["week_ending_date"], "shop_id % 7 = 0")]),
    "standardize_cols": "select * from raw_promotions",
    "parse_dates": "select cast(try_cast(date as date) as varchar) as date, shop_id, item_id, revenue_inr from raw_sales",
    "drop_bad_dates": """
        select cast(try_cast(start_date as date) as varchar) as start_date, end_date, shop_id, item_category_id,
          discount_pct, demand_uplift_mult from raw_promotions where try_cast(start_date as date) is not null""",
    "coerce_numeric": """
        select date, shop_id, item_id, item_mrp_inr, item_price_inr, try_cast(discount_pct as double) as discount_pct,
          item_cnt_day, revenue_inr, is_promo::bigint as is_promo, stockout_flag::bigint as stockout_flag
        from raw_sales""",
    "fill_numeric_defaults":
        "select * replace (cast(week_ending_date as varchar) as week_ending_date) from c_inventory",
    "fill_unknown": "select * from c_shops",
    "clean_sales": "select * replace (cast(date as varchar) as date) from c_sales",
    "clean_items": "select * from c_items",
    "clean_shops": "select * replace (cast(try_cast(opening_date as date) as varchar) as opening_date) from c_shops",
    "clean_calendar": "select * replace (cast(date as varchar) as date) from c_calendar",
    "clean_promotions": """
        select * replace (cast(start_date as varchar) as start_date, cast(end_date as varchar) as end_date)
        from c_promotions""",
    "column_subset": "select shop_id, discount_pct from raw_promotions",
    "fk_check": " union all ".join(
        f"""select '{key}' as foreign_key, count(*)::bigint as missing_keys from (
              select distinct {key} as k from {child}) where k is null or k not in (select {key} from {parent})"""
        for key, child, parent in [("shop_id", "c_sales", "c_shops"), ("item_id", "c_sales", "c_items"),
                                   ("item_category_id", "c_items", "raw_categories")]),
    "fk_filter": "select * replace (cast(date as varchar) as date) from v_sales",
    "cap_outliers": f"select cast(date as varchar) as date, shop_id, item_id, {', '.join(OUTLIERS)} from capped",
    "sanity_filter": f"select cast(date as varchar) as date, shop_id, item_id, {', '.join(OUTLIERS)} from t_sales",
    "derive_calendar_keys": f"""
        select cast(date as varchar) as date, {big('year(date)', 'year')}, {big('month(date)', 'month')},
          strftime(date, '%Y-%m') as year_month, shop_id, item_id from c_sales""",
    "monthly_facts": "select * from facts",
    "calendar_month": "select * from cal_month",
    "promo_month_expand": "select * from promo_exp",
    "promo_month": "select * from promo_m",
    "inventory_month": "select * from inv_m",
    "enrich_items": "select * from with_items",
    "enrich_categories": f"""
        select {GRAIN}, item_category_id, qty, item_category_name
        from with_items left join raw_categories using (item_category_id)""",
    "enrich_shops": """
        select f.*, shop_city, shop_state, shop_region, store_type, store_size_sqft
        from facts f left join c_shops using (shop_id)""",
    "enrich_calendar": "select * from facts left join cal_month using (year_month)",
    "enrich_promotions": """
        select w.year_month, w.shop_id, w.item_id, w.item_category_id, w.qty,
          coalesce(promo_discount_pct, 0) as promo_discount_pct, coalesce(promo_uplift, 1) as promo_uplift,
          coalesce(promo_campaigns, 0) as promo_campaigns
        from with_items w left join promo_m p on p.year_month = w.year_month and p.shop_id = w.shop_id
          and p.item_category_id = w.item_category_id""",
    "enrich_inventory": """
        select f.*, coalesce(avg_on_hand, 0) as avg_on_hand, coalesce(avg_reorder_point, 0) as avg_reorder_point,
          coalesce(avg_lead_time, 0) as avg_lead_time, coalesce(inv_snapshots, 0) as inv_snapshots
        from facts f left join inv_m using (year_month, shop_id, item_id)""",
    "price_features": f"""
        select {GRAIN}, {_rounded(['avg_price', 'avg_mrp'])}, {rnd('ratio', 'price_ratio')},
          {rnd('greatest(-1, least(1, 1 - ratio))', 'price_discount_pct')}
        from (select *, coalesce(avg_price / nullif(avg_mrp, 0), 1) as ratio from facts)""",
    "lag_features": f"""
        select {GRAIN}, qty, coalesce(lag(qty, 1) over s, 0) as qty_lag_1, coalesce(lag(qty, 2) over s, 0) as qty_lag_2,
          coalesce(lag(qty, 3) over s, 0) as qty_lag_3, coalesce(lag(avg_price) over s, 0) as price_lag_1
        from facts window s as ({SERIES_ORDER})""",
    "rolling_mean": f"""
        select {GRAIN}, qty, {rnd('a3', 'qty_roll_3')}, {rnd('a6', 'qty_roll_6')}
        from (select *,
            case when row_number() over s > 3 then avg(qty) over (s rows between 3 preceding and 1 preceding) end as a3,
            case when row_number() over s > 6 then avg(qty) over (s rows between 6 preceding and 1 preceding) end as a6
          from facts window s as ({SERIES_ORDER}))""",
    "price_change": f"""
        select {GRAIN}, {rnd('avg_price', 'avg_price')},
          {rnd(clip('((avg_price - p) / (p + 1e-6))', '-2', '2'), 'price_change_pct')}
        from (select *, lag(avg_price) over ({SERIES_ORDER}) as p from facts)""",
    "trend_and_intensity": f"""
        select {GRAIN}, {rnd('coalesce(a3, 0) - coalesce(a6, 0)', 'qty_trend')},
          {rnd("least(1, coalesce(promo_days / nullif(days_in_month, 0), 0))::double", 'promo_intensity')}
        from (select {GRAIN}, promo_days, days_in_month,
            case when row_number() over s > 3 then avg(qty) over (s rows between 3 preceding and 1 preceding) end as a3,
            case when row_number() over s > 6 then avg(qty) over (s rows between 6 preceding and 1 preceding) end as a6
          from facts left join cal_month using (year_month) window s as ({SERIES_ORDER}))""",
    "next_month_target": f"""
        select {GRAIN}, qty, lead(qty) over ({SERIES_ORDER}) as qty_next_month from facts
        qualify qty_next_month is not null""",
    "monthly_features": f"select {', '.join(MONTHLY_COLUMNS['keep'])}, {_rounded(MONTHLY_COLUMNS['rounded'])} from m",
    "densify_months": """
        select g.year_month, g.shop_id, g.item_id, year(g.d)::bigint as year, month(g.d)::bigint as month,
          coalesce(qty, 0) as qty, coalesce(revenue, 0) as revenue
        from (select shop_id, item_id, strftime(d, '%Y-%m') as year_month, d from (
                select shop_id, item_id, unnest(generate_series(
                  min((year_month || '-01')::date), max((year_month || '-01')::date), interval 1 month)) as d
                from facts group by 1, 2)) g
          left join facts f on f.year_month = g.year_month and f.shop_id = g.shop_id and f.item_id = g.item_id""",
    "promo_flag": f"select {GRAIN}, promo_days, (promo_days > 0)::int::bigint as promo_flag from m",
    "total_monthly_qty": "select * from tot",
    "top_categories": f"""
        select item_category_name, {total('qty')} as qty from m where item_category_name is not null
        group by 1 order by 2 desc, 1 limit 15""",
    "top_shops_revenue": f"select shop_id, {total('revenue')} as revenue from m group by 1 order by 2 desc, 1 limit 15",
    "promo_vs_nonpromo": f"""
        select (promo_days > 0)::int::bigint as promo_flag, {rnd(mean('qty'), 'avg_qty')} from m group by 1""",
    "stockout_impact": f"""
        select stockout_days, {rnd(mean('qty'), 'avg_qty')} from m group by 1 order by 1 limit 15""",
    "correlation_matrix": _correlation_sql(),
    "series_rank": f"select {SERIES}, {total('qty')} as qty from m group by 1, 2 order by 3 desc, 1, 2 limit 5",
    "series_rank_all": f"select {SERIES}, {total('qty')} as qty from m group by 1, 2 order by 3 desc, 1, 2",
    "distinct_months": "select distinct year_month from m",
    "min_max": "select min(qty) as min_value, max(qty) as max_value from tot",
    "quantiles": _quantile_sql(),
    "sales_class": f"select {GRAIN}, qty, sales_class from classes",
    "sales_class_by_region": f"""
        select {GRAIN}, shop_region, qty,
          case when qty <= q1 then 'LOW' when qty <= q2 then 'MEDIUM' else 'HIGH' end as sales_class
        from m join (select shop_region as r, round(quantile_cont(qty, 0.33), 4) as q1,
                       round(quantile_cont(qty, 0.66), 4) as q2 from m group by 1)
          on shop_region is not distinct from r""",
    "sample_exact": f"""
        select {GRAIN}, avg_price, qty from m
        order by md5(concat_ws('|', year_month, shop_id::varchar, item_id::varchar, '42')) limit 4000""",
    "stratified_split": f"""
        select {GRAIN}, sales_class, (row_number() over (partition by sales_class
            order by md5(concat_ws('|', year_month, shop_id::varchar, item_id::varchar, '42')))
          <= (count(*) over (partition by sales_class) + 4) // 5)::int::bigint as is_test
        from classes""",
    "time_split": f"""
        select {GRAIN}, qty_next_month, (year_month >= first_month)::int::bigint as is_validation
        from m, split_month""",
    "series_holdout": f"""
        select {GRAIN}, t::bigint as t, n_rows::bigint as n_rows, (t > n_rows - 3)::int::bigint as is_validation
        from holdout""",
    "one_hot": _one_hot_sql(),
    "label_dictionary": _label_dictionary_sql(),
    "linear_regression": _linear_regression_sql(),
    "sequence_regression": _sequence_regression_sql("m", GRAIN, f"partition by {SERIES}"),
    "sequence_regression_total": _sequence_regression_sql("tot", "year_month", ""),
    "seasonal_regression_backtest": f"select * from ({_seasonal_sql()})",
    "standard_scale": _standard_scale_sql(),
    "fill_feature_matrix": f"select {GRAIN}, " + ", ".join(
        rnd(f"coalesce({c}::double, 0)", c) for c in FEATURES) + " from m",
    "minmax_scale": f"""
        select year_month, qty, lo, hi, {rnd('(qty - lo) / (hi - lo + 1e-6)', 'scaled')}
        from tot, (select min(qty) as lo, max(qty) as hi from tot)""",
    "sequence_frames": _sequence_sql("tot", "year_month", ""),
    "sequence_frames_by_series": _sequence_sql("m", GRAIN, f"partition by {SERIES}"),
    "regression_metrics": f"""
        select is_validation, {rnd('sqrt(avg(e * e))', 'RMSE')}, {rnd('avg(abs(e))', 'MAE')},
          {rnd('avg(abs(e / case when abs(y) < 1e-6 then 1 else abs(y) end)) * 100', '"MAPE_%"')}
        from (select (year_month >= first_month)::int::bigint as is_validation, qty_next_month as y,
                qty_next_month - qty_roll_3 as e from m, split_month) group by 1""",
    "confusion_matrix": f"""
        select label as actual, (count(*) filter (predicted = 'LOW'))::bigint as LOW,
          (count(*) filter (predicted = 'MEDIUM'))::bigint as MEDIUM,
          (count(*) filter (predicted = 'HIGH'))::bigint as HIGH
        from {VERDICT_ROWS} left join pairs on actual = label group by label""",
    "classification_report": f"""
        select coalesce(label, kind) as sales_class, {rnd('sum(p * w) / sum(w)', 'precision')},
          {rnd('sum(r * w) / sum(w)', 'recall')},
          {rnd('sum(case when p + r > 0 then 2 * p * r / (p + r) else 0 end * w) / sum(w)', 'f1')},
          sum(support)::bigint as support, {rnd('any_value(accuracy)', 'accuracy')}
        from (select unnest([{{'kind': label, 'w': 1}}, {{'kind': 'macro avg', 'w': 1}},
                             {{'kind': 'weighted avg', 'w': support}}], recursive := true),
                p, r, support, accuracy, null as label
        from (select label, accuracy, support, coalesce(tp / nullif(said, 0), 0) as p,
                coalesce(tp / nullif(support, 0), 0) as r
              from (select label, (count(*) filter (predicted = label and actual = label))::bigint as tp,
                      (count(*) filter (predicted = label))::bigint as said,
                      (count(*) filter (actual = label))::bigint as support,
                      count(*) filter (predicted = actual) / count(*) as accuracy
                    from pairs, {VERDICT_ROWS} group by label))) group by all""",
    "get_series": f"""
        select {SERIES}, year_month || '-01' as ds, {rnd('qty', 'y')},
          {_rounded(['avg_price', 'price_ratio', 'promo_intensity'])}, festive_days, holiday_days, stockout_days
        from m""",
    "arima_backtest": ARIMA_OUT,
    "arima_backtest_top_series": ARIMA_OUT,
    "regressors_contract": f"""
        select label as "Model", n_rows, n_series, {rnd('actual_total', 'actual_total')}, 0::bigint as n_missing,
          0::bigint as n_outside
        from (select count(*)::bigint as n_rows, count(distinct (shop_id, item_id))::bigint as n_series,
                {total('qty_next_month')} as actual_total
              from m, split_month where year_month >= first_month),
          (values ('LinearRegression'), ('RandomForestRegressor'), ('GradientBoostingRegressor')) as v(label)""",
    "linear_regression_contract": """
        select count(*)::bigint as n_train, 0.0::double as mean_residual
        from m, split_month where year_month < first_month""",
    "forecast_next_contract": "select * exclude (pred_qty_next_month), 1::bigint as valid from described",
    "sales_classifier_contract":
        "select sales_class, ((count(*) + 4) // 5)::bigint as support from classes group by 1",
    "isolation_forest_contract": "select count(*)::bigint as n_scored, 1::bigint as share_ok from m",
    "seasonal_regression_contract":
        f"select {SERIES}, (max(n_rows) - 3)::bigint as n_train from holdout group by 1, 2",
    "profit_columns": f"select {GRAIN}, {_rounded(['revenue', 'cost_est', 'profit_est'])} from profits",
    "shop_profit": f"""
        select t.*, shop_city, shop_state, shop_region
        from (select shop_id, {rnd(total('revenue'), 'total_revenue', 4)}, {rnd(total('cost_est', 8), 'total_cost', 4)},
                {rnd(total('profit_est', 8), 'total_profit', 4)}, {rnd(total('qty'), 'total_qty', 4)}
              from profits group by 1) t
          left join c_shops using (shop_id)""",
    "describe_forecast": f"""
        select * replace ({rnd('pred_qty_next_month', 'pred_qty_next_month')}) from described""",
    "forecast_items": f"""
        select item_id, {rnd('p', 'pred_qty_next_month')}, item_name, item_category_id,
          {rnd('p * 12', 'pred_qty_next_year')}
        from (select item_id, {total('pred_qty_next_month', 10)} as p from forecast group by 1)
          left join v_items using (item_id)""",
    "whatif_price": f"""
        select {SERIES}, {rnd('pred_qty_next_month', 'pred_qty_next_month')}, 0.1::double as whatif_price_up_pct,
          0.975::double as whatif_qty_multiplier,
          {rnd('pred_qty_next_month * 0.975::double', 'whatif_pred_qty_next_month')},
          {rnd('price * 1.1::double', 'whatif_new_price')},
          {rnd('price * 1.1::double * (pred_qty_next_month * 0.975::double)', 'whatif_revenue_next_month')}
        from (select *, coalesce(mrp_inr, (select median(mrp_inr) from described)) as price from described)""",
    "inventory_plan": f"""
        select {SERIES}, year_month, {rnd('p', 'pred_qty_next_month')}, {rnd('stock', 'avg_on_hand')},
          {_rounded(['avg_reorder_point'])}, {rnd('coalesce(avg_lead_time, 7)', 'avg_lead_time')}, inv_snapshots,
          {rnd('0.15::double * p', 'safety_stock')},
          {rnd('greatest(0, p + 0.15::double * p - stock)', 'reorder_qty_suggested')}
        from (select f.shop_id, f.item_id, pred_qty_next_month as p, year_month, avg_reorder_point, avg_lead_time,
                inv_snapshots, coalesce(avg_on_hand, 0) as stock
              from forecast f left join (select * from inv_m where year_month = (select max(year_month) from inv_m)) v
                on v.shop_id = f.shop_id and v.item_id = f.item_id)""",
}

ALL_SERIES = "holdout"
TOP_SERIES = """(select * from holdout where (shop_id, item_id) in (
          select (shop_id, item_id) from (select shop_id, item_id, round(sum(qty), 4) as q from m
            group by 1, 2 order by 3 desc, 1, 2 limit 5)))"""


def oracle_sql() -> dict[str, str]:
    return {name: _assemble(sql, TOP_SERIES if name.endswith("top_series") else ALL_SERIES)
            for name, sql in FINALS.items()}


def _assemble(final: str, series_rows: str) -> str:
    """Prefix a final SELECT with the CTEs it reaches, in definition order."""
    bodies = {n: sql.replace("{series_rows}", series_rows) for n, sql in CTES.items()}
    needed: set[str] = set()
    waiting = [final]
    while waiting:
        text = waiting.pop()
        for name in bodies:
            if name not in needed and re.search(rf"(?:from|join|,)\s+{name}\b", text):
                needed.add(name)
                waiting.append(bodies[name])
    parts = [f"{n} as ({bodies[n]})" for n in bodies if n in needed]
    head = re.match(r"\s*(with_pairs as .*?from m\)\))\s", final, re.S)
    if head:
        parts.append(head.group(1).strip())
        final = final[head.end():]
    return "with " + ",\n".join(parts) + "\n" + final
