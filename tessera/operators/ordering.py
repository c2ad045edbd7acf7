"""Dense ranks over large groups or whole tables, without one task that sees all rows of a group; aggregates in the order of a table's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import stored


def ranked(df: DataFrame, by: list[str], order: list, name: str, base: int = 1) -> DataFrame:
    """Numbers from ``base`` in the order of ``order`` in each group of ``by`` (or overall).

    Rows are range-partitioned by group and order and each partition ranks its own.  A partition holds an interval of that order,
    so only its first group can have rows in earlier partitions: the offsets that are sent to all are one row for each
    partition at most.  The placed rows are written once: bounds are sampled anew whenever a range partitioning is run, so
    ranks and counts must come from one run.  They are the result's ``made``: for ``discard`` once the result is stored itself.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(n, *by, *order).withColumn("_p", F.spark_partition_id()), "placed")
    local = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_p", *by).orderBy(*order)))
    counts = placed.groupBy("_p", *by).agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_p", *by, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_b"))
    same = before.where("_b > 0").select(F.col("_p").alias("_q"), *[F.col(b).alias(f"_{b}_") for b in by], "_b")
    on = F.col("_p") == F.col("_q")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}_"))
    out = local.join(F.broadcast(same), on, "left").withColumn(name, (F.coalesce("_b", F.lit(0)) + F.col("_r") - 1 + base).cast("long")).drop("_p", "_q", "_r", "_b", *[f"_{b}_" for b in by])
    out.made = [placed]
    return out


def placed(table: DataFrame) -> DataFrame:
    """``table``, as read from Parquet files, with ``_place``: where a row stands, by its file's path and its number in the file."""
    return table.withColumn("_place", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def in_order(rows: DataFrame, by: list[str], order: list, **told: Column) -> DataFrame:
    """(by, told): aggregates of each group that take its rows in ``order``.

    A sum of doubles hangs on the order in which they are added; Spark's own hangs on partitions and on what arrives first.  Rows are
    sorted and go through a window, which spills: no group is held as a list.
    """
    line = Window.partitionBy(*by).orderBy(*order)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = rows.select(*by, *[c.over(whole).alias(name) for name, c in told.items()], F.row_number().over(line).alias("_r"))
    return marked.where("_r = 1").drop("_r")
