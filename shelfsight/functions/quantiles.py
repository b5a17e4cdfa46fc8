"""Exact linear-interpolated quantiles by radix selection, per column and per group.

``percentile`` keeps every distinct value of a column in one buffer. Here each double becomes a 64-bit key in
the order of the values, and the key of a wanted rank is found digit by digit: a pass counts the rows of the
bucket that holds the rank by their next 16 bits. Counts are summed on the map side first, so a hot value or a
hot group is one row per task, and no pass orders more than 65,536 digits per bucket, whatever the data size.
Four passes give all 64 bits; no rank can be missed.

Nothing runs before the result is read, and nothing passes through the driver. The input is read once a pass,
so callers hand in a narrow table that is cheap to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import is_small

DIGIT = 16
LEVELS = 64 // DIGIT
MANTISSA = 1 << 52
LEAST_NORMAL = 2.0 ** -1022
LEAST_SUBNORMAL = 2.0 ** -1074


def with_order_key(df: DataFrame, value: str, key: str) -> DataFrame:
    """Adds a bigint that orders like the double ``value``: the IEEE 754 bits of its magnitude, with its sign.

    The exponent comes from a logarithm, put right by one where that rounds across a power of two. Dividing by a
    power of two is exact, so the mantissa is too. Null and NaN have no key; both zeros have the same. Steps are
    columns of their own, which keeps Catalyst from computing one several times.
    """
    x, size, guess, scaled, exponent = (F.col(c) for c in (value, "__size", "__guess", "__scaled", "__exponent"))
    two = F.lit(2.0)
    bits = (F.when(size == 0, F.lit(0).cast("bigint"))
            .when(size < LEAST_NORMAL, (size / F.lit(LEAST_SUBNORMAL)).cast("bigint"))
            .when(size == float("inf"), F.lit(2047 * MANTISSA))
            .otherwise((exponent + 1023) * F.lit(MANTISSA) + ((scaled - 1) * float(MANTISSA)).cast("bigint")))
    moved = F.when(scaled >= 2, F.lit(1)).when(scaled < 1, F.lit(-1)).otherwise(F.lit(0))
    return (df.withColumn("__size", F.abs(F.nanvl(x, F.lit(None).cast("double"))))
            .withColumn("__guess", F.floor(F.log2(F.when(size < float("inf"), size))))
            .withColumn("__scaled", size / F.pow(two, guess))
            .withColumn("__exponent", guess + moved)
            .withColumn("__scaled", F.when(scaled >= 2, scaled / 2).when(scaled < 1, size / F.pow(two, exponent))
                        .otherwise(scaled))
            .withColumn(key, F.when(size.isNotNull(), F.when(x < 0, -bits).otherwise(bits)))
            .drop("__size", "__guess", "__scaled", "__exponent"))


def quantile_table(df: DataFrame, wanted: dict[str, list[float]], by: list[str] = (),
                   decimals: int | None = None) -> DataFrame:
    """(*by, name, q, value): quantiles of each column as pandas ``quantile`` gives, per group of ``by``.

    A null group is a group. A column without values in a group has no row. Nulls and NaN are missing.
    """
    by = list(by)
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v")) for n in wanted])
    known = df.select(*by, F.explode(pairs).alias("p")).where("p.v is not null and not isnan(p.v)").select(*by, "p.name", "p.v")
    # a key that cannot be null: else Catalyst repeats all of it in a filter below each join
    data = with_order_key(known, "v", "key").withColumn("key", F.coalesce("key", F.lit(0)))
    few = not by or is_small(df.select(*by).distinct())

    asked = F.create_map(*[x for n, qs in wanted.items()
                           for x in (F.lit(n), F.array(*[F.lit(float(q)) for q in qs]))])
    group = Window.partitionBy(*by, "name")
    first = (data.groupBy(*by, "name", F.shiftright("key", 64 - DIGIT).alias("prefix")).agg(F.count("*").alias("c"))
             .withColumns({"n": F.sum("c").over(group),
                           "upto": F.sum("c").over(group.orderBy("prefix").rowsBetween(
                               Window.unboundedPreceding, Window.currentRow))})
             .withColumn("q", F.explode(F.element_at(asked, F.col("name"))))
             .withColumn("rank", (F.col("n") - 1) * F.col("q"))
             .withColumn("ask", F.explode(F.array(*[
                 F.struct("q", F.lit(side).alias("side"), (F.col("rank") - F.floor("rank")).alias("part"),
                          end("rank").cast("bigint").alias("left")) for side, end in enumerate((F.floor, F.ceil))]))))
    found = _holding(first, by)
    for level in range(1, LEVELS):
        asks = found.groupBy(*by, "name", "prefix").agg(F.sort_array(F.collect_list("ask")).alias("asks"))
        found = _deeper(data, asks, by, 64 - DIGIT * (level + 1), few)
    value = F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("part")
    value = F.when(F.col("v0") == F.col("v1"), F.col("v0")).otherwise(value)
    return (found.groupBy(*by, "name", "ask.q").agg(
                F.max("ask.part").alias("part"),
                *[F.max(F.when(F.col("ask.side") == side, F.col("v"))).alias(f"v{side}") for side in (0, 1)])
            .select(*by, "name", "q", (value if decimals is None else F.round(value, decimals)).alias("value")))


def _holding(counted: DataFrame, by: list[str]) -> DataFrame:
    """The buckets that hold an asked rank, which then counts from the start of its bucket."""
    ask, before = F.col("ask"), F.col("upto") - F.col("c")
    return (counted.where((before <= ask["left"]) & (ask["left"] < F.col("upto")))
            .withColumn("ask", F.struct(ask["q"].alias("q"), ask["side"].alias("side"), ask["part"].alias("part"),
                                        (ask["left"] - before).alias("left"))))


def _deeper(data: DataFrame, asks: DataFrame, by: list[str], shift: int, few: bool) -> DataFrame:
    """One more digit: rows of the asked buckets, counted by it."""
    # a few rows a group: two ranks for each quantile asked for
    side = (F.broadcast(asks) if few else asks).alias("a")
    same = [F.col(f"d.{b}").eqNullSafe(F.col(f"a.{b}")) for b in by]
    inside = (data.alias("d").join(side, [
        *same, F.col("d.name") == F.col("a.name"),
        F.shiftright("d.key", shift + DIGIT) == F.col("a.prefix")])
        .select("d.*", "a.asks", F.col("a.prefix").alias("above")))
    counted = inside.groupBy(*by, "name", "above", "asks", F.shiftright("key", shift).alias("prefix")).agg(
        F.count("*").alias("c"), F.max("v").alias("v"))  # of the last digit, all values of a bucket are equal
    order = Window.partitionBy(*by, "name", "above").orderBy("prefix")
    return _holding(counted.withColumn("upto", F.sum("c").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("ask", F.explode("asks")), by).drop("asks", "above")


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]],
                    decimals: int | None = None) -> dict[str, list[float | None]]:
    """``{column: [quantile, ...]}`` on the driver; None for a column without values. This is an action."""
    rows = {(r["name"], r["q"]): r["value"] for r in quantile_table(df, wanted, decimals=decimals).collect()}
    return {n: [rows.get((n, float(q))) for q in qs] for n, qs in wanted.items()}


def quantile_bounds(df: DataFrame, wanted: dict[str, list[float]], decimals: int | None = None
                    ) -> dict[str, list[Column]]:
    """``{column: [quantile, ...]}`` as columns for use on any table: fields of one scalar subquery."""
    found = quantile_table(df, wanted, decimals=decimals)
    fields = [(n, i, float(q)) for n, qs in wanted.items() for i, q in enumerate(qs)]
    row = found.agg(F.struct(*[
        F.max(F.when((F.col("name") == n) & (F.col("q") == q), F.col("value"))).alias(f"{n}_{i}")
        for n, i, q in fields]).alias("bounds")).scalar()
    return {n: [row[f"{n}_{i}"] for i in range(len(qs))] for n, qs in wanted.items()}
