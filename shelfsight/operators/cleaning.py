"""Cleaning: names, dates, numbers, defaults, outlier caps and sanity filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, clip, finite_or_null, numeric
from ..functions.quantiles import quantile_bounds

OUTLIER_COLUMNS = ["item_cnt_day", "item_price_inr", "item_mrp_inr", "revenue_inr"]


def present(df: DataFrame, columns: list[str]) -> list[str]:
    """The wanted columns that ``df`` has, in the wanted order."""
    return [c for c in columns if c in df.columns]


def column_subset(df: DataFrame, keep: list[str], drop: list[str] = ()) -> DataFrame:
    """Project to the wanted columns that exist, without the dropped ones."""
    return df.select(*[c for c in present(df, keep) if c not in drop])


def standardize_cols(df: DataFrame) -> DataFrame:
    """Trim and lower-case the column names."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def parse_dates(df: DataFrame, columns: list[str], fmt: str | None = None) -> DataFrame:
    """Text or timestamps to dates; unparseable text becomes null."""
    types = dict(df.dtypes)

    def parsed(c: str) -> Column:
        if types[c] == "string":
            return F.try_to_date(F.col(c), fmt) if fmt else F.try_to_date(F.col(c))
        return F.col(c).cast("date")

    return df.withColumns({c: parsed(c) for c in present(df, columns)})


def drop_bad_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep the rows whose dates are all known."""
    return df.na.drop(subset=columns)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """To double; text that is not a number, and NaN, become null."""
    types = dict(df.dtypes)
    return df.withColumns({c: numeric(F.col(c), types[c] == "string") for c in present(df, columns)})


def fill_numeric(df: DataFrame, defaults: dict[str, float | int]) -> DataFrame:
    """Replace nulls by a default. An int default also makes the column a bigint, cut toward zero."""
    return df.withColumns({
        c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(v).cast("bigint")) if isinstance(v, int)
        else F.coalesce(F.col(c).cast("double"), F.lit(v))
        for c, v in defaults.items() if c in df.columns})


def fill_unknown(df: DataFrame, columns: list[str], label: str = "Unknown") -> DataFrame:
    """Replace null text by ``label`` in the wanted columns that exist."""
    return df.na.fill(label, subset=present(df, columns))


def cap_outliers(df: DataFrame, columns: list[str] = OUTLIER_COLUMNS,
                 low: float = 0.01, high: float = 0.99, decimals: int = 4) -> DataFrame:
    """Clamp each column to its own global quantiles.

    All columns share the same passes over the data. The bounds are rounded, so
    that sums of capped values stay on a decimal grid.
    """
    bounds = quantile_bounds(df, {c: [low, high] for c in present(df, columns)}, decimals=decimals)
    return df.withColumns({c: clip(F.col(c).cast("double"), *b) for c, b in bounds.items()})


def sanity_filter(df: DataFrame, quantity: str = "item_cnt_day", price: str = "item_price_inr") -> DataFrame:
    """Drop returns and rows without a positive price; NaN counts as missing."""
    return df.where((F.nanvl(F.col(quantity).cast("double"), F.lit(-1.0)) >= 0)
                    & (F.nanvl(F.col(price).cast("double"), F.lit(0.0)) > 0))


def fill_feature_matrix(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    """Infinite, NaN and null features become ``value``."""
    return df.withColumns({
        c: F.coalesce(finite_or_null(F.col(c).cast("double")), F.lit(value)) for c in columns})


def known(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with no null key: a group or join key that is null forms no group."""
    return df.where(all_of([F.col(k).isNotNull() for k in keys]))
