"""The star-schema tables as tables of the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: SQL of the same tables, for comparison.
SQL_EV = """ev AS (SELECT *, 'ev_' || episode_id || '_' || lpad(idx::VARCHAR, 4, '0') AS seg_id FROM (
    SELECT user_id AS episode_id, event_id AS ord, event_type AS speaker, event_type AS label, value AS label_score, props AS text, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS "start",
    coalesce(lead((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6) OVER w, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 + 30) AS "end", row_number() OVER w - 1 AS idx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""
SQL_CV = """cv AS (SELECT conv_id AS episode_id, turn AS ord, role AS speaker, text, length(text) / 15.0::DOUBLE AS duration,
    coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 15.0::DOUBLE AS "start", sum(length(text)) OVER (w ROWS UNBOUNDED PRECEDING) / 15.0::DOUBLE AS "end"
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
SQL_SC = "sc AS (SELECT doc_id AS query_id, quality AS answer, toxic AS factual, lang AS query_type, source AS variant, (quality + toxic + doc_id) % 2 AS third FROM labels JOIN documents USING (doc_id))"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str):
    """Seconds since 2024-01-01 of a timestamp without zone."""
    return (F.unix_micros(F.col(ts).cast("timestamp")) - 1_704_067_200_000_000) / F.lit(1e6)


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as segments of their user: from each event to the next, the last for half a minute."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").withColumn("start", seconds("ts"))
    e = e.withColumn("end", F.coalesce(F.lead("start").over(w), F.col("start") + 30)).withColumn("idx", F.row_number().over(w) - 1)
    return e.select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("ord"), F.format_string("ev_%d_%04d", "user_id", "idx").alias("seg_id"), F.col("event_type").alias("speaker"), F.col("event_type").alias("label"), F.col("value").alias("label_score"), F.col("props").alias("text"), "start", "end")


def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as turns: fifteen characters a second, one after the other."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text")
    before = F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("episode_id"), F.col("turn").alias("ord"), F.col("role").alias("speaker"), "text", (n / F.lit(15.0)).alias("duration"), (before / F.lit(15.0)).alias("start"), (F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(15.0)).alias("end"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), F.concat(F.lit("v"), F.col("vec_id")).alias("seg_id"), F.col("label").cast("long").alias("episode_id"), (F.col("vec_id") * 10.0).alias("start"), (F.col("vec_id") * 10.0 + 10).alias("end"), "embedding")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return joined.select(F.col("doc_id").alias("query_id"), F.col("quality").alias("answer"), F.col("toxic").alias("factual"), F.col("lang").alias("query_type"), F.col("source").alias("variant"), ((F.col("quality") + F.col("toxic") + F.col("doc_id")) % 2).alias("third"))
