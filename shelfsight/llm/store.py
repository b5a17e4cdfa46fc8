"""Written tables in the shared folder, checked broadcasts and free column names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session that names none (a test) gets one, below its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` below the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`written` that no plan reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` of narrow rows with a broadcast hint if its checked size allows; else the join shuffles."""
    return F.broadcast(df) if is_small(df, rows) else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(df: DataFrame, names: list[str], keep: list[str] = ()) -> DataFrame:
    """``df`` without the columns called like one of ``names``, which new columns are about to replace.

    Names differ in more than case; a column of ``keep`` that would go raises, for the operator reads it.
    """
    gone = {n.lower() for n in names}
    if clash := [c for c in keep if c.lower() in gone]:
        raise ValueError(f"{clash} name both an input and an output column")
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(x.strip().split(" ", 1)) for x in schema.split(",") if x.strip()]
