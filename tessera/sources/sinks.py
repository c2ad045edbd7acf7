"""Sinks: append with ordinals, resume, upserts, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import normalised
from tessera.operators.ordering import ranked


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Old rows replaced by new ones of the same key; replaced keys keep their place, new ones come after."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    w = Window.partitionBy(key)
    latest = both.withColumn("_first", F.min(F.struct("_v", order)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col("_v").desc(), F.col(order).desc()))).where("_r = 1")
    return latest.withColumn("version", F.col("_v")).withColumn("first_seen", F.col(f"_first.{order}")).drop("_v", "_r", "_first")


def partial_upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Old rows with ``columns`` overwritten where ``new`` has the key; keys that are only new are added."""
    n = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in new.columns if c != key])
    joined = old.withColumn("_old", F.lit(True)).join(n, F.col(key) == F.col("_k"), "full")
    pick = lambda c: F.when(F.col("_k").isNull(), F.col(c)).when(F.col("_old") & (~F.lit(c in columns)), F.col(c)).otherwise(F.col(f"_{c}") if c in new.columns else F.col(c))
    return joined.select(F.coalesce(key, "_k").alias(key), *[pick(c).alias(c) for c in old.columns if c != key])


def vectors_to_append(new: DataFrame, base: int, dimension: int, order: list[str]) -> DataFrame:
    """Vectors normalised and numbered on from ``base``; a wrong dimension fails the job.

    Numbers are dense, see ``ordering.ranked``.
    """
    right = F.assert_true(F.size("embedding") == dimension, F.lit(f"vectors must have {dimension} numbers"))
    checked = new.withColumn("_ok", right).withColumn("embedding", normalised(F.col("embedding")))
    return with_ordinal(checked.where("_ok is null").drop("_ok"), order, "idx", base)


def with_ordinal(df: DataFrame, order: list[str], name: str, base: int = 0) -> DataFrame:
    """Dense numbers from ``base`` in the order of ``order``, without one task ranking all rows."""
    return ranked(df, [], order, name, base)


def by_episode(df: DataFrame, path: str, key: str = "episode_id", kind: str = "parquet", mode: str = "append") -> None:
    """A table partitioned by its key; ``dynamic`` overwrite of whole partitions makes runs repeatable."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(key).format(kind).save(path)


def write_evidence(evidence: DataFrame, side: DataFrame, path: str) -> None:
    """A file of JSON lines beside the scores: the truth segments of each query (query_id, episode_id, segment) and their text (query_id, gt_side)."""
    held = [c for c in evidence.columns if c not in ("query_id", "episode_id")]
    rows = evidence.groupBy("query_id", "episode_id").agg(F.sort_array(F.collect_list(F.struct(*held))).alias("gt_ev"))
    rows.join(side.select("query_id", "gt_side"), "query_id", "left").write.mode("overwrite").json(path)


def append_new(todo: DataFrame, path: str, key: str, make) -> int:
    """Rows of ``todo`` whose key isn't in the JSON lines at ``path`` yet, made and appended; how many they were.  A run that was cut off goes on where it ended."""
    from tessera.sources.readers import jsonl

    spark = todo.sparkSession
    done = jsonl(spark, path, f"{key} {dict(todo.dtypes)[key]}")
    rest = resume(todo, done, key)
    n = rest.count()
    if n:
        make(rest).write.mode("append").json(path)
    return n
