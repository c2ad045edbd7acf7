"""Extraction: recordings to turns with texts and vectors, and these to labelled segments with ordinals into the vector tables.

Models are makers (see ``experts``): a maker is called once in each task.  A reader turns a recording's bytes into samples and their rate.
Nothing is done twice: ``sinks.resume`` leaves out what is there, and patches skip episodes that have them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import experts
from tessera.functions import text
from tessera.functions.numbers import merged_labels
from tessera.operators import intervals
from tessera.sources import sinks

TURN = "episode_id string, turn_idx int, start double, `end` double, speaker string, text string, embedding array<double>"
#: Words that begin a sentence rather than a topic, and what a missing topic is called.
SENTENCE = ["i", "we", "you", "he", "she", "they", "it", "welcome", "this", "that", "there", "so", "and", "but"]
NO_TOPIC = "this topic"


def turns_of(recordings: DataFrame, diarise: experts.Maker, shortest: float, longest: float) -> DataFrame:
    """(episode_id, turn_idx, start, end, speaker) of recordings (episode_id, content): long turns are split first, then short ones merged, then numbered."""
    found = experts.diarised(recordings, diarise).select("episode_id", "start", "end", "speaker")
    shaped = intervals.merge_short(intervals.split_long(found, longest), shortest)
    return shaped.withColumn("turn_idx", (F.row_number().over(Window.partitionBy("episode_id").orderBy("start", "end")) - 1).cast("int"))


def stage_one(recordings: DataFrame, read: Callable, diarise: experts.Maker, transcribe: experts.Maker, embed: experts.Maker, shortest: float = 1.0, longest: float = 30.0) -> DataFrame:
    """``TURN``: turns with what is said in them and the vector of their sound.  A recording is read once for all of its turns."""
    turns = turns_of(recordings, diarise, shortest, longest).groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", "start", "end", "speaker"))).alias("turns"))
    schema = pa.schema([("episode_id", pa.string()), ("turn_idx", pa.int32()), ("start", pa.float64()), ("end", pa.float64()), ("speaker", pa.string()), ("text", pa.string()), ("embedding", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say, vector = transcribe(), embed()
        for batch in batches:
            for episode, content, of in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                samples, rate = read(content.as_py())
                parts = [(t, samples[int(t["start"] * rate) : int(t["end"] * rate)]) for t in of]
                rows = [{"episode_id": episode, **t, "text": say(part, rate), "embedding": list(map(float, vector(part, rate)))} for t, part in parts]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return recordings.select(F.col("episode_id").cast("string").alias("episode_id"), "content").join(turns, "episode_id").mapInArrow(run, TURN)


def text_vectors(turns: DataFrame, embed: experts.Maker) -> DataFrame:
    """(episode_id, turn_idx, embedding) of the turns' texts, from turns that are there already."""
    made = experts.mapped(embed, "array<double>")
    return turns.select("episode_id", "turn_idx", made(F.col("text")).alias("embedding"))


def merged_over(labels: list[Column]) -> Column:
    """Maps of labels from left to right: a later value that isn't null overrides; an empty map without any."""
    out = F.coalesce(labels[0], F.create_map().cast("map<string,string>")) if labels else F.create_map().cast("map<string,string>")
    for more in labels[1:]:
        out = merged_labels(out, F.coalesce(more, F.create_map().cast("map<string,string>")))
    return out


def stage_two(turns: DataFrame, labels: list[DataFrame], spaces: dict[str, DataFrame], dimensions: dict[str, int], bases: dict[str, int]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(segments, vectors by space): segments with merged labels (episode_id, turn_idx, labels of each labeler) and the ordinals of their vectors.

    ``spaces``: vectors (episode_id, turn_idx, embedding) by the name of their space; they are normalised, checked for their
    dimension and numbered on from the space's base.  A segment without a vector in a space has no ordinal there.
    """
    seg_id = F.format_string("%s_%04d", F.col("episode_id").cast("string"), "turn_idx")
    out = turns.select(seg_id.alias("seg_id"), "episode_id", "turn_idx", "start", "end", F.coalesce("speaker", F.lit("SPEAKER_00")).alias("speaker"), "text")
    names = []
    for k, part in enumerate(labels):
        out = out.join(part.select("episode_id", "turn_idx", F.col("labels").alias(f"_l{k}")), ["episode_id", "turn_idx"], "left")
        names.append(F.col(f"_l{k}"))
    out = out.withColumn("labels", merged_over(names)).drop(*[f"_l{k}" for k in range(len(labels))])
    vectors = {}
    for space, rows in spaces.items():
        named = rows.join(out.select("episode_id", "turn_idx", "seg_id", "start", "end"), ["episode_id", "turn_idx"])
        vectors[space] = sinks.vectors_to_append(named, bases.get(space, 0), dimensions[space], ["episode_id", "turn_idx"])
    return backfilled(out, vectors), vectors


def backfilled(segments: DataFrame, vectors: dict[str, DataFrame]) -> DataFrame:
    """Segments with ``{space}_idx``, the ordinal of their vector in each space; an ordinal that is there stays."""
    for space, rows in vectors.items():
        name = f"{space}_idx"
        joined = segments.join(rows.select("seg_id", F.col("idx").alias("_i")), "seg_id", "left")
        segments = joined.withColumn(name, F.coalesce(name, "_i") if name in segments.columns else F.col("_i")).drop("_i")
    return segments


def patched(segments: DataFrame, labels: DataFrame, marker: str) -> DataFrame:
    """Segments with another labeler's values (seg_id, labels) over their own; an episode whose first segment has the ``marker`` has been patched and stays as it is."""
    done = segments.groupBy("episode_id").agg(F.min_by(F.coalesce(F.map_contains_key("labels", F.lit(marker)), F.lit(False)), "turn_idx").alias("_done"))
    joined = segments.join(done, "episode_id").join(labels.select("seg_id", F.col("labels").alias("_new")), "seg_id", "left")
    fresh = merged_over([F.col("labels"), F.col("_new")])
    return joined.withColumn("labels", F.when(F.col("_done"), F.col("labels")).otherwise(fresh)).drop("_done", "_new")


def borrowed(truth: DataFrame, extracted: DataFrame, columns: list[str]) -> DataFrame:
    """Truth segments with ``columns`` of the extracted segment that they overlap most, null where they overlap none."""
    right = extracted.select(F.col("episode_id"), F.col("start").alias("lo"), F.col("end").alias("hi"), F.col("turn_idx").alias("_o"), *columns)
    best = intervals.arg_max_overlap(truth.select("episode_id", "seg_id", "start", "end"), right, "episode_id", "seg_id", "_o").select("seg_id", *columns)
    return truth.join(best, "seg_id", "left")


def languages(songs: DataFrame, first: experts.Maker, second: experts.Maker, sure: float, content: str = "content") -> DataFrame:
    """``songs`` with lang and prob, and lang2 and prob2 of a second, slower look at those under ``sure``; the others aren't looked at again."""
    kind = "lang string, prob double"
    quick, slow = experts.pairs(first, kind), experts.pairs(second, kind)
    once = songs.withColumn("_a", quick(F.col(content))).withColumn("lang", F.col("_a.lang")).withColumn("prob", F.col("_a.prob")).drop("_a")
    again = F.when(F.coalesce("prob", F.lit(0.0)) < sure, F.col(content))
    return once.withColumn("_b", slow(again)).withColumn("lang2", F.col("_b.lang")).withColumn("prob2", F.col("_b.prob")).drop("_b")


def topic_reply(reply: Column) -> Column:
    """A model's topic: its first line without marks around it, sixty characters at most; "this topic" if nothing is left."""
    bare = F.regexp_replace(text.stripped(reply), "^[\".,: ']+|[\".,: ']+$", "")
    return F.coalesce(F.nullif(F.substring(text.stripped(F.split(bare, "\n")[0]), 1, 60), F.lit("")), F.lit(NO_TOPIC))


def topic_phrase(topic: Column, reply: Column | None = None) -> Column:
    """A topic that fits behind "talking about": in lower case but for words of capitals; one that begins like a sentence is replaced by a model's ``reply``, if there is one."""
    lower = text.topic(topic)
    said = F.lit(None).cast("string") if reply is None else F.lower(F.regexp_replace(F.split(F.regexp_replace(text.stripped(reply), "^[\".,: ']+|[\".,: ']+$", ""), "\n")[0], "^$", NO_TOPIC))
    begins = F.lower(F.split(text.stripped(topic), r"\s+")[0]).isin(SENTENCE)
    return F.when(F.coalesce(topic, F.lit("")) == "", NO_TOPIC).when(begins & said.isNotNull(), said).otherwise(lower)


def clip_note(task: Column, kind: Column, clips: dict[str, Column]) -> Column:
    """What a plan is told of a query's clips: class and scores of an emotion's, words of two songs'; null for other queries and clips without a label.

    ``clips``: emo, emo_primary, emo_scores (a map), song_a, words_a, song_b, words_b.
    """
    scores = F.array_join(F.transform(F.array_sort(F.map_entries(clips["emo_scores"])), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"]))), ", ")
    emotion = F.concat(F.lit("Emotion reference clip ("), clips["emo"], F.lit("): primary="), F.coalesce(clips["emo_primary"], F.lit("unknown")), F.lit(", scores={"), F.coalesce(scores, F.lit("")), F.lit("}"))
    song = lambda x, name: F.concat(F.lit(f"{name} clip ("), clips[f"song_{x}"], F.lit('): lyrics="'), text.stripped(clips[f"words_{x}"]), F.lit('"'))
    both = F.nullif(F.concat_ws("\n", song("a", "Song A"), song("b", "Song B")), F.lit(""))
    return F.when((task == "emotion") & kind.isin("locate", "locate_hard"), emotion).when((task == "music") & (kind == "audio"), both)
