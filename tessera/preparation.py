"""Whole preparations: from labels, segments and traces of recordings to numbered queries with their ground truth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.extraction import topic_phrase
from tessera.operators import builders, events, sampling, shaping
from tessera.operators.nearest import nearest_points
from tessera.operators.ordering import ranked
from tessera.session import discard, grows, stored

#: Least change of a trend, least spread between speakers, padding around a compared window and least of it on a side.
CHANGE, SPREAD, PADDING, LEAST_PADDING = 0.08, 0.10, 240, 10
DETAILS = "emo string, cf double, votes map<string,bigint>, act double, val double, dom double, dim string, direction string, delta double, half1 double, half2 double, spk_val map<string,double>, val_diff double, spk string, n long, seg_text string, topic string"


@dataclass
class Recordings:
    """What an emotion corpus gives.

    ``labels``: episode_id, n, t0, t1, spk, emo, cf, votes, act, val, dom, seg_text, and topic (what a model says a segment is about) if
    there are any.  ``segments``: episode_id, start, end, speaker (a number as text), gender, text, valence, arousal, dominance.
    ``traces``: episode_id, dim, t, value.  ``bounds``: episode_id, conv_start, conv_end.  ``speaker_clips``: clip, speaker, gender,
    episode_id, snr.  ``emotion_clips``: clip, emo, speaker, episode_id, cf, act, val, dom.
    """

    labels: DataFrame
    segments: DataFrame
    traces: DataFrame
    bounds: DataFrame
    speaker_clips: DataFrame
    emotion_clips: DataFrame


def _shaped(df: DataFrame, shape: str) -> DataFrame:
    """Rows with all details of a candidate, null where a shape has none, and a number made of what they are."""
    fields = [f.split(" ") for f in DETAILS.split(", ")]
    columns = [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields]
    out = df.select("episode_id", F.lit(shape).alias("shape"), F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1"), *columns)
    return out.withColumn("cand_id", F.xxhash64("episode_id", "shape", "t0", "t1", "dim", "n"))


def emotion_candidates(r: Recordings, width: float = 30.0, step: float = 10.0, window: float = 60.0, guard: float = 60.0, back: float = 60.0, least: float = 10.0) -> DataFrame:
    """Candidates of three shapes: labelled events, trends (the strongest of each dimension, and its flattest window), windows of several speakers.

    They are written once, shape by shape: whoever deals them out reads them several times.
    """
    spoken = builders.spoken_events(r.labels, r.segments, back=back)
    all_ = stored(events.trend_windows(r.traces, width, step, ("episode_id", "dim")), "trends")
    said = stored(events.spoken_trends(all_, r.segments, 0.7), "spoken-trends")
    keys = ["episode_id", "dim"]
    strong = events.suppressed(said.where(F.abs("delta") > CHANGE), keys, F.round(F.abs("delta"), 9), guard).select(*keys, "lo", "hi")
    kept = stored(said.join(grows(strong), [*keys, "lo", "hi"], "left_semi"), "kept")
    flat = _flat(said, kept, guard)
    told = lambda df, direction: df.select("episode_id", F.col("lo").alias("t0"), F.col("hi").alias("t1"), "dim", F.col("speaker").alias("spk"), F.round("delta", 3).alias("delta"), F.round("half1", 3).alias("half1"), F.round("half2", 3).alias("half2"), direction.alias("direction"))
    trends = told(kept, F.when(F.col("delta") > 0, "rising").otherwise("falling")).unionByName(told(flat, F.lit("none")))
    several = events.speaker_windows(r.segments, ["valence", "arousal", "dominance"], window, window / 2, least, SPREAD).select("episode_id", F.col("lo").alias("t0"), F.col("hi").alias("t1"), F.initcap("dim").alias("dim"), "spk_val", F.round("diff", 3).alias("val_diff"))
    parts = [stored(_shaped(df, shape), "candidates") for df, shape in ((spoken, "st_event"), (trends, "ct_trend"), (several, "multi_spk_window"))]
    discard(all_, said, kept)
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _flat(windows: DataFrame, taken: DataFrame, guard: float) -> DataFrame:
    """The flattest window of each episode and dimension that stays away from the episode's trends of any dimension."""
    away = taken.select(F.col("episode_id").alias("_e"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    free = windows.join(grows(away), (F.col("episode_id") == F.col("_e")) & (F.col("lo") < F.col("_hi") + guard) & (F.col("hi") > F.col("_lo") - guard), "left_anti")
    return sampling.first_n(free, ["episode_id", "dim"], [F.round(F.abs("delta"), 9), "lo"], 1)


def _with_clip(rows: DataFrame, clips: DataFrame, genders: DataFrame, speaker: str, name: str, where) -> DataFrame:
    """``rows`` with the clearest clip of a speaker from another episode, of the gender that the speaker mostly has in this one if
    there is such a clip; rows that ask for one and have none are left out."""
    pool = clips.select(F.col("speaker").alias("_spk"), F.col("episode_id").alias("_ep"), F.col("gender").alias("_their"), F.col("clip").alias(name), "snr")
    of = genders.select(F.col("episode_id").alias("_e"), F.col("speaker").alias("_s"), F.col("gender").alias("_gender"))
    asked = rows.withColumn("_spk", F.when(where, F.col(speaker)))
    asked = asked.join(grows(of), (F.col("episode_id") == F.col("_e")) & (F.col("_spk") == F.col("_s")), "left").drop("_e", "_s")
    picked = sampling.pool_pick(asked, pool, ["_spk"], "cand_id", name, [("episode_id", "_ep")], [-F.col("snr")], ("_gender", "_their"))
    return picked.where(~where | F.col(name).isNotNull()).drop("_spk", "_gender")


def _with_nearest_clip(rows: DataFrame, clips: DataFrame, where, seed: int) -> DataFrame:
    """``rows`` with one of the three clips of their emotion, of another episode and speaker, nearest in confidence and levels; drawn by the row."""
    asked = rows.where(where)
    pool = clips.select("emo", F.col("episode_id").alias("_ep"), F.col("speaker").alias("_who"), F.col("clip").alias("_clip"), F.coalesce("cf", F.lit(0.0)).alias("cf"), *[F.coalesce(c, F.lit(0.5)).alias(c) for c in ("act", "val", "dom")])
    three = nearest_points(asked, pool, ["emo"], "cand_id", "_clip", ["cf", "act", "val", "dom"], [("episode_id", "_ep"), ("spk", "_who")], 3)
    turn = F.pmod(sampling.draw(F.col("cand_id"), seed), F.count(F.lit(1)).over(Window.partitionBy("cand_id"))) + 1
    one = three.withColumn("_turn", turn).where("rank = _turn").select(F.col("cand_id").alias("_id"), F.col("_clip").alias("_near"))
    out = rows.join(grows(one), where & (F.col("cand_id") == F.col("_id")), "left").withColumn("audio_emo", F.coalesce("_near", "audio_emo"))
    return out.where(~where | F.col("_near").isNotNull()).drop("_id", "_near")


def emotion_queries(r: Recordings, candidates: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """(query_id, episode_id, query_type, query, time_ref, audio_spk, audio_spk2, audio_emo, ground_truth, judge_info): ``cap`` queries of a type for each episode, and hard ones from clusters.

    Labels are written once and so is what each step gives, so that no plan holds more than one step.
    """
    labels = stored(r.labels, "labels")
    chosen = stored(builders.assigned(candidates, cap, seed=seed), "assigned")
    grown = builders.grown_windows(labels, r.bounds).select("episode_id", "n", "win_t0", "win_t1")
    pad = F.lit(LEAST_PADDING) + sampling.draw(F.col("cand_id"), seed) % (PADDING - 2 * LEAST_PADDING + 1)
    speakers = F.transform(F.array_sort(F.transform(F.map_keys("spk_val"), lambda k: k.cast("long"))), lambda k: k.cast("string"))
    none = lambda kind: F.lit(None).cast(kind)
    plain = chosen.join(grows(grown), ["episode_id", "n"], "left").withColumn("target_t0", none("double")).withColumn("target_t1", none("double")).withColumn("n_events", none("long"))
    hard = stored(sampling.first_n(builders.hard_clusters(labels.where("spk is not null")), ["episode_id"], ["t0", "emo", "spk"], builders.CLUSTERS), "hard")
    topics = ["topic"] if "topic" in labels.columns else []
    target = labels.select("episode_id", F.col("n").alias("target_n"), F.col("t0").alias("target_t0"), F.col("t1").alias("target_t1"), "cf", "votes", "act", "val", "dom", "seg_text", *topics)
    aimed = hard.join(grows(target), ["episode_id", "target_n"]).withColumnRenamed("target_n", "n")
    clusters = _shaped(aimed, "cluster").join(grows(aimed.select("episode_id", "n", "n_events", "target_t0", "target_t1")), ["episode_id", "n"])
    rows = stored(plain, "plain").unionByName(stored(clusters.withColumn("query_type", F.lit("locate_hard")), "clusters"), True)
    rows = rows.withColumn("topic", topic_phrase(F.col("topic"))).withColumn("quote", F.when(F.coalesce("seg_text", F.lit("")) != "", _clause())).withColumn("pad_left", pad).withColumn("pad_right", F.lit(PADDING) - F.col("pad_left"))
    rows = rows.withColumn("_a", F.when(F.col("query_type") == "comparison", F.get(speakers, F.lit(0))).when(F.col("query_type") != "locate_hard", F.col("spk"))).withColumn("_b", F.when(F.col("query_type") == "comparison", F.get(speakers, F.lit(1))))
    genders = stored(shaping.modal(r.segments.where("gender is not null"), ["episode_id", "speaker"], "gender", "start"), "genders")
    rows = stored(_with_clip(rows, r.speaker_clips, genders, "_a", "audio_spk", F.col("query_type") != "locate_hard"), "speaker")
    rows = stored(_with_clip(rows, r.speaker_clips, genders, "_b", "audio_spk2", F.col("query_type") == "comparison"), "speakers")
    placing = F.col("query_type") == "locate"
    pool = r.emotion_clips.select(F.col("emo").alias("_emo"), F.col("episode_id").alias("_ep"), F.col("speaker").alias("_who"), F.col("clip").alias("audio_emo"), F.col("cf").alias("_cf"))
    rows = sampling.pool_pick(rows.withColumn("_emo", F.when(placing, F.col("emo"))), pool, ["_emo"], "cand_id", "audio_emo", [("episode_id", "_ep"), ("spk", "_who")], [-F.col("_cf")]).where(~placing | F.col("audio_emo").isNotNull())
    rows = _with_nearest_clip(stored(rows, "clipped"), r.emotion_clips, F.col("query_type") == "locate_hard", seed)
    told = builders.emotion_queries(rows).select("episode_id", "query_type", "query", "time_ref", "topic", "audio_spk", "audio_spk2", "audio_emo", "ground_truth", "judge_info", "cand_id")
    return ranked(told, [], ["episode_id", "query_type", "time_ref", "cand_id"], "query_id").drop("cand_id")


def _clause():
    from tessera.functions.text import picked_clause

    return picked_clause(F.col("seg_text"), sampling.draw(F.col("cand_id")))


def music_queries(songs: DataFrame, clips: DataFrame, pairs: int = 10, tie: float = 0.2, key: str = "track_name") -> DataFrame:
    """(query_id, track, ref_method, query, ref_a, ref_b, winner, delta, time_ref_a, time_ref_b, ...) of ``pairs`` pairs of each track with enough songs; by time, place and clip in turn."""
    methods = ["time", "position", "audio"]
    made = builders.song_pairs(songs, methods, 2 * pairs, tie, key=key).withColumnRenamed(key, "track").withColumnRenamed("file_name_a", "file_a").withColumnRenamed("file_name_b", "file_b")
    asked = builders.music_queries(made, clips)
    times = songs.select("file_name", "start", "end").dropDuplicates(["file_name"])
    return ranked(builders.enriched(asked, times), [], ["track", "pair"], "query_id")


def numbered_segments(segments: DataFrame, key: str = "episode_id") -> DataFrame:
    """Segments of each episode in the order of their start, numbered from 0: what the miners of candidates read."""
    return segments.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy("start", "end")) - 1)
