"""Written intermediate tables that cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local session may name none: its driver is its executor,
    and it gets a folder of its own machine once."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shelfsight-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path; the folder's owner cleans it up like any checkpoint."""
    return f"{staging_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used before iterative work. A table beats a cache here: readers prune its
    columns, and a lost executor costs a re-read, not a recomputation. Written with
    zstd, for the shared folder holds every such table until its owner cleans up.
    """
    path = staging_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Write ``df`` bucketed and sorted by ``keys``, as a table of the session, and read it back.

    Windows, groups and joins by these keys read it without an exchange. The files lie below the shared folder;
    whoever made the table drops it.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", staging_path(spark, name)).saveAsTable(table))
    return spark.table(table)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a source that has fewer splits than the session has cores, such as one unsplittable file.

    A table of cluster size has more splits than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
