"""Session settings the engine expects: UTC, adaptive execution with skew handling, last-wins map merging; tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(name: str = "tessera", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Only a local session may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def grows(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles both sides.

    Spark judges a table by the size of its file and gathers a small one whole in the driver; but rows of a Parquet file of a few
    megabytes may take hundreds there.  So a join of tables that grow says so, whatever ``autoBroadcastJoinThreshold`` is.
    """
    return df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing will read any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
