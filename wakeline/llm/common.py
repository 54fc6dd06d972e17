"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(col: str | Column) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


#: Rows up to which a table of a few numbers a row is broadcast (some tens of MB); larger ones are joined by shuffles.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir.

    A folder of our own is set only where the session names none and all runs on this machine; on a cluster
    each executor would write to its own disk, so there a missing setting is an error.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "wakeline-checkpoints")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as a compressed table in the shared folder and read it back.

    Survives the loss of executors, and is columnar, so later readers take only what they need. The table goes
    when the application ends, or by discard() once nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    p, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(schema).parquet(path)
    out._written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing will read again, the lineage of no living result either."""
    for t in tables:
        p, fs = _hadoop_path(t.sparkSession, t._written_path)
        fs.delete(p, True)


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of few columns, marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(table) if table.count() <= rows else table


def masked(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ... and the new name of each old one, so that no name of ours can clash."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), {c: f"c{i}" for i, c in enumerate(docs.columns)}


def unmasked(docs: DataFrame) -> list[Column]:
    """What selects the columns of docs, by their old names, from a frame made from masked(docs)."""
    return [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
