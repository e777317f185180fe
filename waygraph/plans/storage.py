"""Cutting lineage: tables in the folder that the cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Counted rows, at most, that Spark may broadcast where it sees fit.
FEW = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local session without one (a test) gets its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="waygraph-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dealt(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as one side of a join that deals out both sides by key and sorts them.

    For tables that grow with the graph. Spark takes a table for as large as its compressed
    columns, which is a tenth of its rows in memory or less, and counts a row that is laid out
    over nine cells once: without this it broadcasts millions of rows through the driver.
    ``rows``: how many there are at most, where that has been counted.
    """
    return df if rows is not None and rows <= FEW else df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` wrote, once what was made of them is stored too."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
