"""Reproducible samples and splits that do not depend on partitioning.

A row's place in the random order is the hash of its key. To take the first n
rows of that order, the n-th hash is found by counting hash prefixes, so no
task sorts a whole table or a whole stratum, and the rows themselves are only
filtered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_order
from .monthly import SERIES

PREFIX = 4  # hex digits: 65,536 prefixes


def _hash_limits(df: DataFrame, stratum: Column, order: Column,
                 quota: Callable[[Column], Column]) -> DataFrame:
    """(stratum, hash_limit): the quota-th smallest hash per stratum; no row where all rows fit."""
    hashed = df.select(stratum.alias("stratum"), order.alias("h"),
                       F.substring(order, 1, PREFIX).alias("prefix"))
    by_stratum = Window.partitionBy("stratum")
    running = by_stratum.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (hashed.groupBy("stratum", "prefix").agg(F.count("*").alias("c"))
            .withColumn("upto", F.sum("c").over(running))
            .withColumn("k", quota(F.sum("c").over(by_stratum)))
            .where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k")))
            .select("stratum", "prefix", (F.col("k") - F.col("upto") + F.col("c")).alias("left")))
    # one cut per stratum, and one prefix of each stratum behind it
    return (hashed.join(F.broadcast(cuts), ["stratum", "prefix"])
            .withColumn("place", F.row_number().over(by_stratum.orderBy("h")))
            .where(F.col("place") <= F.col("left"))
            .groupBy("stratum").agg(F.max("h").alias("hash_limit")))


def sample_exact(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """min(n, rows) rows, the same ones on every cluster. ``keys`` must identify a row."""
    order = hash_order(keys, seed)
    limit = (_hash_limits(df, F.lit(0), order, lambda _: F.lit(n))
             .agg(F.max("hash_limit")).scalar())
    return df.where(F.coalesce(order <= limit, F.lit(True)))


def stratified_split(df: DataFrame, stratum: str, keys: list[str], strata: list[str],
                     parts: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: one part in ``parts`` of each stratum, rounded up.

    ``strata`` lists the known values, which bounds the broadcast limits to one
    row each; rows of other strata stay, with a null ``is_test``.
    """
    order = hash_order(keys, seed)
    limits = _hash_limits(df.where(F.col(stratum).isin(strata)), F.col(stratum), order,
                          lambda n: F.floor((n + F.lit(parts - 1)) / F.lit(parts)))
    return (df.join(F.broadcast(limits.withColumnRenamed("stratum", stratum)), stratum, "left")
            .withColumn("is_test", order <= F.col("hash_limit"))
            .drop("hash_limit"))


def time_split(monthly: DataFrame, months: int = 3) -> DataFrame:
    """Adds ``is_validation``: the row lies in one of the last distinct months."""
    first = (monthly.select("year_month").distinct().orderBy(F.desc("year_month")).limit(months)
             .agg(F.min("year_month")).scalar())
    return monthly.withColumn("is_validation", F.col("year_month") >= first)


def series_holdout(monthly: DataFrame, months: int = 3, min_rows: int = 18) -> DataFrame:
    """Series with enough rows; adds their length, row number and ``is_validation`` for the last rows."""
    by_series = Window.partitionBy(*SERIES)
    return (monthly
            .withColumn("t", F.row_number().over(by_series.orderBy("year", "month")))
            .withColumn("n_rows", F.count("*").over(by_series))
            .where(F.col("n_rows") >= min_rows)
            .withColumn("is_validation", F.col("t") > F.col("n_rows") - months))
