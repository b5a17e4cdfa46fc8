"""Feature encoding: label dictionaries, one-hot columns, vectors and scaling."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.joins import BROADCAST_ROWS
from ..sources.staging import stage
from .cleaning import fill_feature_matrix

IN_PARTITION = (1 << 33) - 1  # bits of monotonically_increasing_id that count within a partition


def label_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, label, place, n_labels): the distinct labels of each column, numbered from 0 in order; null is none.

    Labels are dealt to tasks by range, so a label's place is its place in its partition plus the number of labels
    in the partitions before. Any number of labels is numbered without a task or the driver holding them all.
    """
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("label")) for c in columns])).alias("p"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = pairs.select("p.*").where("label is not null").distinct()
    # written, because numbers and offsets must come from the same partitions
    numbered = stage(distinct.repartitionByRange(tasks, "name", "label").sortWithinPartitions("name", "label")
                     .withColumn("id", F.monotonically_increasing_id()), "labels") \
        .withColumn("part", F.shiftright("id", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = numbered.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.col("offset") + F.col("id").bitwiseAND(F.lit(IN_PARTITION))
    placed = numbered.join(F.broadcast(offsets), "part").select("name", "label", place.alias("place"))
    starts = placed.groupBy("name").agg(F.min("place").alias("start"), F.count("*").alias("n_labels"))
    return placed.join(F.broadcast(starts), "name").select(
        "name", "label", (F.col("place") - F.col("start")).alias("place"), "n_labels")


def one_hot(df: DataFrame, labels: dict[str, list[str]]) -> DataFrame:
    """Replace each column by a 0/1 column for each of the labels given; null and other labels are all 0."""
    new = {f"{c}_{label}": F.coalesce(F.col(c).cast("string") == F.lit(label), F.lit(False)).cast("int")
           for c, wanted in labels.items() for label in wanted}
    return df.withColumns(new).drop(*labels)


@dataclass
class Encoder:
    """Numbers and one-hot labels as one vector. The alphabetically first label of a column is all zeros, and so
    are null and unknown labels; unknown and infinite numbers are 0. Labels stand from the last to the second."""
    numbers: list[str]
    sizes: dict[str, int]  # labels of each encoded column
    dictionary: DataFrame

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        """``df`` with the numbers filled and the vector ``out``."""
        spark = df.sparkSession
        rows = fill_feature_matrix(df, self.numbers)
        if not self.sizes:
            return VectorAssembler(inputCols=self.numbers, outputCol=out).transform(rows)
        for c, n in self.sizes.items():
            known = self.dictionary.where(F.col("name") == c).select(
                F.col("label").alias(f"{c}_label"), (n - 1 - F.col("place")).cast("double").alias(f"{c}_ix"))
            rows = rows.join(F.broadcast(known) if n <= BROADCAST_ROWS else known,
                             F.col(c).cast("string") == F.col(f"{c}_label"), "left").drop(f"{c}_label")
        indices = [f"{c}_ix" for c in self.sizes]
        rows = rows.na.fill({f"{c}_ix": float(n - 1) for c, n in self.sizes.items()})
        # the encoder's sizes come from one row of greatest indices, not from a pass over the data
        ends = spark.createDataFrame([tuple(float(n - 1) for n in self.sizes.values())],
                                     ", ".join(f"`{i}` double" for i in indices))
        hot = OneHotEncoder(inputCols=indices, outputCols=[f"{c}_hot" for c in self.sizes], dropLast=True).fit(ends)
        vector = VectorAssembler(inputCols=[*self.numbers, *(f"{c}_hot" for c in self.sizes)], outputCol=out)
        return vector.transform(hot.transform(rows)).drop(*indices, *(f"{c}_hot" for c in self.sizes))

    @property
    def width(self) -> int:
        return len(self.numbers) + sum(n - 1 for n in self.sizes.values())

    def save(self, path: str) -> None:
        """The dictionary, and a row with the order of the columns."""
        spark = self.dictionary.sparkSession
        self.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
        order = json.dumps({"numbers": self.numbers, "sizes": list(self.sizes.items())})
        spark.createDataFrame([(order,)], "columns string").write.mode("overwrite").parquet(f"{path}/columns")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Encoder:
        order = json.loads(spark.read.parquet(f"{path}/columns").first()["columns"])
        return Encoder(order["numbers"], dict(order["sizes"]), spark.read.parquet(f"{path}/dictionary"))


def fit_encoder(df: DataFrame, numbers: list[str], labels: list[str]) -> Encoder:
    """An encoder that knows every label of ``df``; columns with a single label carry no information and are left
    out. Fitted on the whole table, so that both sides of a split know every label."""
    if not labels:
        return Encoder(numbers, {}, df.sparkSession.createDataFrame(
            [], "name string, label string, place bigint, n_labels bigint"))
    dictionary = stage(label_dictionary(df, labels), "dictionary")
    counts = {r["name"]: r["n_labels"] for r in dictionary.select("name", "n_labels").distinct().collect()}
    return Encoder(numbers, {c: counts[c] for c in labels if counts.get(c, 0) > 1}, dictionary)


def fit_scaler(train: DataFrame, vector: str = "features", out: str = "scaled") -> PipelineModel:
    """Centre and scale to unit population deviation; a constant column becomes 0."""
    scaler = StandardScaler(inputCol=vector, outputCol=f"{out}_sample", withMean=True).fit(train)
    n = train.count()
    to_population = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    product = ElementwiseProduct(inputCol=f"{out}_sample", outputCol=out,
                                 scalingVec=Vectors.dense([to_population] * scaler.mean.size))
    return PipelineModel(stages=[scaler, product])


def standard_scale(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace ``columns`` of ``df`` by their standardised values; the scale comes from ``train`` alone."""
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    scaled = fit_scaler(assembler.transform(train)).transform(assembler.transform(df))
    values = vector_to_array("scaled")
    return scaled.withColumns({c: values[i] for i, c in enumerate(columns)}).drop(
        "features", "scaled_sample", "scaled")
