"""Foreign-key checks and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import small_side


def missing_keys(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct key values of ``child``, null included, that ``parent`` lacks."""
    return child.select(key).distinct().join(parent.select(key).distinct(), key, "left_anti")


def fk_check(relations: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """One row per (key, child, parent): how many distinct child keys dangle. A child is read once for all its keys."""
    children: list[tuple[DataFrame, list[int]]] = []
    for place, (_, child, _) in enumerate(relations):
        known = next((places for df, places in children if df is child), None)
        if known is None:
            children.append((child, [place]))
        else:
            known.append(place)

    def pairs(df: DataFrame, places: list[int]) -> DataFrame:
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(p).alias("place"), F.col(relations[p][0]).cast("string").alias("value")) for p in places]))
            .alias("k")).select("k.*")

    used = reduce(DataFrame.unionByName, [pairs(df, places) for df, places in children]).distinct()
    there = reduce(DataFrame.unionByName, [pairs(parent, [p]) for p, (_, _, parent) in enumerate(relations)]).distinct()
    missing = used.join(there, ["place", "value"], "left_anti").groupBy("place").agg(F.count("*").alias("missing_keys"))
    names = used.sparkSession.createDataFrame(list(enumerate(k for k, _, _ in relations)), "place int, foreign_key string")
    return names.join(missing, "place", "left").select("foreign_key", F.coalesce("missing_keys", F.lit(0)).alias("missing_keys"))


def fk_filter(child: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """Keep the child rows whose keys all exist in their parents."""
    for key, parent in parents.items():
        child = child.join(small_side(parent, [key]), key, "left_semi")
    return child
