"""Connected components of an edge list, by repeated star contraction (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import delete, written

MAX_ROUNDS = 60  # a guard against endless loops; the method needs about log(n) rounds


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest one; minima are reduced map-side, so a hub is one row a task."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least.withColumn("m", F.least("m", "a")), "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(joined.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node with an edge; ``root`` is the smallest node of its component.

    ``edges`` has two bigint columns; loops, repeats and either direction are welcome, nulls are not.
    """
    a, b = (F.col(f"`{c}`").cast("bigint") for c in edges.columns)
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    now = written(now, name)
    seen = None
    for _ in range(MAX_ROUNDS):
        after = written(_star(_star(now, True), False), name)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        delete(now)
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")) \
        .unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
