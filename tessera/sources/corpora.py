"""Corpora as tables: episodes of recordings and their ground-truth segments, from the files they come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.numbers import tier
from tessera.session import grows
from tessera.sources import readers

#: How conversations and episodes of one recording are called, the levels of the emotion scale, the dimensions of songs.
CONVERSATION, EPISODE = "MSP-Conversation_", "MSP-PODCAST_"
LEVELS = {"valence": "EmoVal", "arousal": "EmoAct", "dominance": "EmoDom"}
DIMENSIONS = ["Coherence", "Musicality", "Memorability", "Clarity", "Naturalness"]
SPOKEN = "struct<start:double,`end`:double,text:string,global_speaker2:array<string>,num_speakers:int,gender:string,arousal:double,valence:double,dominance:double>"
SONG = "track_name string, file_name string, start_time double, end_time double, annotation array<map<string,double>>"
ITEM = "id string, audio_path string, question string, options array<string>, ground_truth string, difficulty_level string"


def episode_of(conversation: Column) -> Column:
    """The episode id of a conversation's."""
    return F.replace(conversation, F.lit(CONVERSATION), F.lit(EPISODE))


def conversation_of(episode: Column) -> Column:
    return F.replace(episode, F.lit(EPISODE), F.lit(CONVERSATION))


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """(episode_id, conv_start, conv_end) of a list "conversation;start;end"; bounds may be missing."""
    rows = readers.delimited(spark, path, ["c", "a", "b"])
    return rows.select(episode_of(F.trim("c")).alias("episode_id"), F.col("a").try_cast("double").alias("conv_start"), F.col("b").try_cast("double").alias("conv_end"))


def conversation_parts(spark: SparkSession, path: str) -> DataFrame:
    """(conversation, part_id, start) of a list "part;start;..." whose part ids are a conversation's with a number behind."""
    rows = readers.delimited(spark, path, ["p", "a"])
    return rows.select(F.regexp_replace(F.trim("p"), r"_[^_]*$", "").alias("conversation"), F.trim("p").alias("part_id"), F.col("a").try_cast("double").alias("start")).where("start is not null")


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """(split, file, episode_id) of a list "split; file"; lines without both are left out."""
    parts = F.split(F.trim("value"), "; ", 2)
    rows = spark.read.text(path).where(F.size(parts) == 2).select(parts[0].alias("split"), parts[1].alias("file"))
    return rows.withColumn("episode_id", F.array_join(F.slice(F.split("file", "_"), 1, 2), "_"))


def listed_episodes(spark: SparkSession, path: str) -> DataFrame:
    """(episode_id) of JSON lines with a conversation's id; lines behind // don't count."""
    return readers.id_list(spark, path, key="conversation").select(F.concat(F.lit(EPISODE), F.element_at(F.split("conversation", "_"), -1)).alias("episode_id")).distinct()


def consensus(spark: SparkSession, path: str) -> DataFrame:
    """Labels by file; of several rows of a file the last counts."""
    rows = readers.consensus_text(spark, path).withColumn("_n", F.monotonically_increasing_id())
    return readers.keep_last(rows, "FileName", "_n").drop("_n")


def votes(spark: SparkSession, path: str) -> DataFrame:
    """(FileName, votes, secondary): how often each class was voted for, and the second most frequent, of equal ones the first seen; empty classes don't count."""
    rows = readers.detailed_text(spark, path).select("FileName", text.stripped(F.col("EmoClass_Major")).alias("c"), F.monotonically_increasing_id().alias("n")).where("c <> ''")
    counted = rows.groupBy("FileName", "c").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "n", "c")))
    by = counted.groupBy("FileName").agg(ordered.alias("o"))
    return by.select("FileName", F.map_from_entries(F.transform("o", lambda x: F.struct(x["c"], -x["k"]))).alias("votes"), F.get("o", F.lit(1))["c"].alias("secondary"))


def emotion(spark: SparkSession, objects: str, consensus_path: str, detailed_path: str, audio_dir: str, scope: DataFrame | None = None, traced: DataFrame | None = None, voted_as: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(episodes, segments) of spoken recordings: ``objects`` is one JSON object, episode id to number to segment.

    ``scope`` (episode_id) limits the episodes, ``traced`` (episode_id) tells which have traces.  Segments carry labels: class, vote
    shares, second class, votes, levels from 0 to 1; without a row of consensus all of them are null and the shares empty.
    ``voted_as`` is the name, made from ``seg_id``, by which the votes call a segment, if not by its own.
    """
    entries = readers.object_entries(spark, objects, f"map<string,{SPOKEN}>").select(F.col("key").alias("episode_id"), F.col("value").alias("segments"))
    if scope is not None:
        entries = entries.join(scope.select("episode_id").distinct(), "episode_id", "left_semi")
    t = (traced if traced is not None else spark.createDataFrame([], "episode_id string")).select("episode_id").distinct().withColumn("ct_available", F.lit(True))
    episodes = entries.select("episode_id").join(t, "episode_id", "left").select("episode_id", F.concat(F.lit(f"{audio_dir}/"), "episode_id", F.lit(".flac")).alias("audio_path"), F.coalesce("ct_available", F.lit(False)).alias("ct_available"))
    flat = entries.select("episode_id", F.explode("segments").alias("number", "s"))
    number = F.col("number").cast("int").cast("string")
    seg_id = F.concat("episode_id", F.lit("_"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), "0"))
    rows = flat.select(seg_id.alias("seg_id"), "episode_id", F.coalesce("s.start", F.lit(0.0)).alias("start"), F.coalesce("s.end", F.lit(0.0)).alias("end"), F.coalesce(F.get("s.global_speaker2", F.lit(0)), F.lit("")).alias("speaker"), F.coalesce("s.text", F.lit("")).alias("text"))
    labels = consensus(spark, consensus_path).withColumnRenamed("FileName", "_c")
    voted = votes(spark, detailed_path).withColumnRenamed("FileName", "_v")
    file = F.concat("seg_id", F.lit(".wav"))
    joined = rows.join(grows(labels), file == F.col("_c"), "left").join(grows(voted), (file if voted_as is None else F.concat(voted_as, F.lit(".wav"))) == F.col("_v"), "left")
    known = F.col("_c").isNotNull()
    total = F.aggregate(F.map_values("votes"), F.lit(0).cast("long"), lambda a, x: a + x)
    level = lambda c: F.when(known, text.safe_level(F.trim(F.col(c))))
    out = joined.select(
        "seg_id", "episode_id", "start", "end", "speaker", "text", F.nullif(F.trim("EmoClass"), F.lit("")).alias("primary"),
        F.coalesce(F.when(known, F.transform_values("votes", lambda k, v: v / total)), F.create_map().cast("map<string,double>")).alias("scores"),
        F.when(known, F.col("secondary")).alias("secondary"), F.when(known, F.col("votes")).alias("votes"), *[level(c).alias(k) for k, c in LEVELS.items()],
    )
    return episodes, out


def music(spark: SparkSession, metadata: str, audio_dir: str, tracks: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(episodes, segments) of tracks of songs, from JSON lines of songs; segments in the order of their start, numbered from 0, called SONG_01 on.

    Scores are means over the annotations that have a dimension, 0 without any; ``mean`` is theirs, to three places.
    """
    rows = readers.jsonl(spark, metadata, SONG, missing_ok=False)
    rows = rows if tracks is None else rows.where(F.col("track_name").isin(tracks))
    idx = F.row_number().over(Window.partitionBy("track_name").orderBy("start_time", "file_name")) - 1
    held = lambda d: F.filter(F.transform(F.coalesce("annotation", F.array().cast("array<map<string,double>>")), lambda a: F.element_at(a, d)), lambda x: x.isNotNull())
    mean = lambda d: F.when(F.size(held(d)) > 0, F.aggregate(held(d), F.lit(0.0), lambda s, x: s + x) / F.size(held(d))).otherwise(0.0)
    scored = rows.withColumn("_i", idx).withColumn("scores", F.create_map(*[x for d in DIMENSIONS for x in (F.lit(d), mean(d))]))
    total = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda s, x: s + x) / len(DIMENSIONS)
    segments = scored.select(F.format_string("%s_%04d", "track_name", "_i").alias("seg_id"), F.col("track_name").alias("episode_id"), F.col("start_time").alias("start"), F.col("end_time").alias("end"), F.format_string("SONG_%02d", F.col("_i") + 1).alias("speaker"), "file_name", "scores", F.round(total, 3).alias("mean"), tier(total).alias("primary"))
    episodes = rows.select(F.col("track_name").alias("episode_id")).distinct().withColumn("audio_path", F.concat(F.lit(f"{audio_dir}/"), "episode_id", F.lit(".mp3")))
    return episodes, segments


def health(spark: SparkSession, metadata: str, audio_dir: str, ids: list[str] | None = None) -> DataFrame:
    """(episode_id, audio_path, question, options, ground_truth, answer, ...) of recordings, from a JSON list of items; ``answer`` is the option that the truth's letter names, '' without one.

    A list of some hundred items, read by one task as JSON that spans lines is.
    """
    rows = spark.read.schema(ITEM).option("multiLine", "true").json(metadata)
    rows = rows if ids is None else rows.where(F.col("id").isin(ids))
    name = F.element_at(F.split("audio_path", "/"), -1)
    letter = F.regexp_extract(F.coalesce("ground_truth", F.lit("")), r"\(([a-j])\)", 1)
    options = F.coalesce("options", F.array().cast("array<string>"))
    chosen = F.filter(options, lambda o: (letter != "") & o.startswith(F.concat(F.lit("("), letter, F.lit(")"))))
    return rows.select("id", F.regexp_replace(name, r"\.[^.]*$", "").alias("episode_id"), F.concat(F.lit(f"{audio_dir}/"), name).alias("audio_path"), "question", options.alias("options"), "ground_truth", F.coalesce(F.get(F.reverse(chosen), F.lit(0)), F.lit("")).alias("answer"), "difficulty_level")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(file, annotation, grp) of lines of fields apart by four blanks, those without a recording and a group in brackets left out; of a file the last line counts."""
    lines = spark.read.text(path).where(F.contains("value", F.lit(".wav")) & F.contains("value", F.lit("["))).withColumn("_n", F.monotonically_increasing_id())
    p = F.split(F.trim("value"), " {4}")
    rows = lines.select("_n", F.trim(p[0]).alias("file"), F.trim(F.array_join(F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0))), "    ")).alias("annotation"), F.regexp_replace(F.trim(F.element_at(p, -1)), r"^\[+|[\[\]]+$", "").alias("grp"))
    return readers.keep_last(rows, "file", "_n").drop("_n")


def traces_by_dimension(traces: DataFrame) -> DataFrame:
    """(episode_id, dimension to its rows in order) of ``readers.traces``."""
    rows = traces.groupBy("episode_id", "dim").agg(F.array_sort(F.collect_list(F.struct("annotator_id", "start", "end", "mean"))).alias("rows"))
    return rows.groupBy("episode_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dim", "rows")))).alias("traces"))


def admitted_only(rows: DataFrame, most: int | None, order: list[str]) -> DataFrame:
    """The first ``most`` rows in order, all without a number: a run's early stop."""
    return rows if most is None or most <= 0 else rows.orderBy(*order).limit(most)
