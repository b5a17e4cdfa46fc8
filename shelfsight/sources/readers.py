"""CSV and parquet readers, and the shape profile of the loaded tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import NUMBER, numeric
from ..operators.cleaning import standardize_cols
from ..schemas import KEYS, TABLES

# The tokens a pandas CSV read treats as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_csv_table(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Every column as text, named by the header; missing-value tokens become null.

    No schema inference: it would scan the data twice and one bad value would
    change a column's type. ``multi_line`` allows line breaks inside quotes at
    the price of unsplittable files.
    """
    df = (spark.read.option("header", True).option("escape", '"')
          .option("multiLine", multi_line).csv(path))
    return standardize_cols(df).select(*[
        F.when(~F.col(c).isin(MISSING_TOKENS), F.col(c)).alias(c)
        for c in standardize_cols(df).columns])


def checked_lines(spark: SparkSession, path: str, table: str, multi_line: bool = False) -> DataFrame:
    """Every line of a table's CSV: its fields as text, ``_malformed``, ``_file`` and ``_reason``, null if all can be read.

    Numbers and dates are checked by one function over an array of the fields: written out for each column, the code
    of a line becomes a method that is too long for the JVM to compile.
    """
    kinds = TABLES[table]
    text = ", ".join(f"`{c}` string" for c in kinds)
    # without pruning, so that a line's fields are counted whatever columns are asked for
    raw = (spark.read.schema(f"{text}, _malformed string").option("header", True).option("escape", '"')
           .option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnPruning", False)
           .option("columnNameOfCorruptRecord", "_malformed").csv(path)
           .withColumn("_file", F.col("_metadata.file_path")))
    asked = [c for c, kind in kinds.items() if kind != "string"]
    dates = [i for i, c in enumerate(asked) if kinds[c] == "date"]

    def unread(v: Column, i: Column) -> Column:
        # a text is a number if it has the pattern: `numeric` casts nothing else, and a cast of it never fails
        known = F.when(i.isin(dates), F.try_to_date(v).isNotNull()).otherwise(v.rlike(NUMBER))
        return v.isNotNull() & ~known & ~v.isin(MISSING_TOKENS)

    place = F.array_position(F.transform(F.array(*asked), unread), True).cast("int")
    reasons = F.array(*[F.lit(f"no {'date' if kinds[c] == 'date' else 'number'}: {c}") for c in asked])
    return raw.withColumn("_reason", F.when(F.col("_malformed").isNotNull(), "number of fields")
                          .otherwise(F.try_element_at(reasons, F.nullif(place, F.lit(0)))))


def read_csv_checked(spark: SparkSession, path: str, table: str, multi_line: bool = False, split: bool = True
                     ) -> tuple[DataFrame, DataFrame] | DataFrame:
    """(rows, quarantine): the rows of a table's CSV whose fields can all be read, as text, and the others.

    The quarantine has ``table_name``, ``file``, ``reason`` and ``line`` (the values as read, in order). A row is put
    there if it has too many or too few fields, or a value that is not missing and no number, or no date, where its
    column asks for one. Nothing is dropped: every line of the files is in one of the two. Without ``split`` both are
    one table of all these columns, ``reason`` and ``line`` null in a row that is read: for work that wants both in
    one scan of the files.
    """
    kinds = TABLES[table]
    filled = checked_lines(spark, path, table, multi_line).select(
        *[F.when(~F.col(c).isin(MISSING_TOKENS), F.col(c)).alias(c) for c in kinds], "_malformed", "_file", "_reason")
    line = F.coalesce("_malformed", F.to_json(F.array(*kinds)))
    notes = [F.lit(table).alias("table_name"), F.col("_file").alias("file"), F.col("_reason").alias("reason")]
    if not split:
        return filled.select(*kinds, *notes, F.when(F.col("_reason").isNotNull(), line).alias("line"))
    return (filled.where("_reason is null").select(*kinds),
            filled.where("_reason is not null").select(*notes, line.alias("line")))


def count_checked(lines: DataFrame, table: str) -> DataFrame:
    """(table_name, reason, n_rows) of unsplit checked lines: rows read (reason ``read``, also if there are none) and
    lines set aside for each reason."""
    found = lines.groupBy("reason").agg(F.count("*").alias("n"))
    none = lines.sparkSession.range(1).select(F.lit(None).cast("string").alias("reason"), F.lit(0).cast("bigint").alias("n"))
    return found.unionByName(none).groupBy(F.coalesce("reason", F.lit("read")).alias("reason")).agg(
        F.sum("n").alias("n_rows")).select(F.lit(table).alias("table_name"), "reason", "n_rows")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    if fmt == "csv":
        return read_csv_table(spark, path, **options)
    return standardize_cols(spark.read.format(fmt).options(**options).load(path))


def read_tables(spark: SparkSession, folder: str, fmt: str = "csv",
                names: Iterable[str] = tuple(TABLES), suffix: str | None = None) -> dict[str, DataFrame]:
    """The seven input tables from ``folder``, one file or directory per table."""
    ext = f".{fmt}" if suffix is None else suffix
    return {n: read_table(spark, f"{folder.rstrip('/')}/{n}{ext}", fmt) for n in names}


def typed(df: DataFrame, table: str) -> DataFrame:
    """Key columns of a text table as bigint; the cleaning operators coerce the rest.

    A key goes through bigint first so ids above 2**53 keep every digit.
    """
    types = dict(df.dtypes)
    want = TABLES[table]
    out = []
    for c in df.columns:
        if types[c] != "string" or want.get(c, "string") in ("string", "date"):
            out.append(F.col(c))
        elif c in KEYS:
            key = F.coalesce(F.col(c).try_cast("bigint"), numeric(F.col(c), True).try_cast("bigint"))
            out.append(key.alias(c))
        else:
            out.append(numeric(F.col(c), True).try_cast(want[c]).alias(c))
    return df.select(*out)


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table, counted in one job."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows",
            F.lit(len(df.columns)).cast("bigint").alias("n_columns"))
        for name, df in tables.items()])
