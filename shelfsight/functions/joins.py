"""Joins whose small side is broadcast only after its size has been checked."""

from __future__ import annotations

from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
_checked: WeakKeyDictionary[DataFrame, bool] = WeakKeyDictionary()


def check_sizes(*tables: DataFrame) -> None:
    """Learn in one job which tables have at most BROADCAST_ROWS rows.

    Reads no further than that, once per DataFrame object.
    """
    unknown = [t for t in tables if t not in _checked]
    if not unknown:
        return
    counts = reduce(DataFrame.unionByName, [
        t.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n")).select(F.lit(i).alias("i"), "n")
        for i, t in enumerate(unknown)])
    for row in counts.collect():
        _checked[unknown[row["i"]]] = row["n"] <= BROADCAST_ROWS


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` has at most BROADCAST_ROWS rows; counted once per DataFrame object."""
    check_sizes(df)
    return _checked[df]


def keyed_once(keys: dict[DataFrame, str]) -> bool:
    """Whether no table has a key, null aside, in two rows; one job for all tables."""
    counts = reduce(DataFrame.unionByName, [
        t.agg(F.count(key).alias("n"), F.count_distinct(key).alias("keys")) for t, key in keys.items()])
    return all(row["n"] == row["keys"] for row in counts.collect())


def small_side(df: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted columns, with a broadcast hint when the table is small.

    A larger table is returned without: the join then shuffles, and AQE splits
    hot partitions.
    """
    side = df.select(*columns)
    return F.broadcast(side) if is_small(df) else side
