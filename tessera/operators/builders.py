"""From candidates to queries: eligibility and assignment of candidates, windows around events, clips, query texts with their ground truth."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numbers, text
from tessera.operators import sampling, shaping
from tessera.session import grows

#: Classes of emotion by name and letter, the neutral ones, and what letters stand for.
EMOTION_CODES = {"Neutral": "N", "Angry": "A", "Sad": "S", "Happy": "H", "Surprise": "U", "Fear": "F", "Disgust": "D", "Contempt": "C", "Other": "O"}
NEUTRAL = ["N", "X"]
EMOTION_NAMES = {"H": "Happy", "S": "Sad", "A": "Angry", "N": "Neutral", "D": "Disgust", "F": "Fear", "C": "Contempt", "U": "Surprise"}
#: Query types with the scarce ones first, seconds that windows grow by, and most clusters of an episode.
QUERY_ORDER = ["comparison", "change", "state", "locate"]
MOST_GROWTH, CLUSTER_SPAN, CLUSTER_PAD, CLUSTERS = 150.0, 300.0, 30.0, 3
#: Texts of queries by type.
EMOTION_TEXTS = {
    "state": 'Speaker: [audio example]. {when}, this speaker was talking about {topic} and mentioned "{quote}". What emotion(s) did this speaker show?',
    "change": "Speaker: [audio example]. From {lo} to {hi} seconds, how did this speaker's {dim} change while discussing {topic}?",
    "comparison": "Speaker A: [A's audio example].\nSpeaker B: [B's audio example].\nFrom {lo} to {hi} seconds discussing {topic}, which speaker had higher {dim} — Speaker A or Speaker B?",
    "locate": "Speaker: [speaker example].\nEmotion: [emotion example].\nBetween {lo} and {hi} seconds, when did this speaker show the same emotion as in the audio clip, and what were they saying?",
    "locate_hard": "Emotion: [audio example].\nBetween {lo} and {hi} seconds, when did someone show the same emotion as in the audio clip, and what were they saying?",
}
MUSIC_TEXTS = {
    "time": "Compare the two songs at around {a} and {b}. Which of these two songs has better overall aesthetics?",
    "position": "Compare the {a} and {b} songs in this medley. Which has better overall aesthetics?",
    "audio": "Song A: [A's audio example]. Song B: [B's audio example]. Both clips come from this medley. Which song has better overall aesthetics?",
}
HEALTH_TEXTS = {"reported": "Did the patient report any respiratory symptoms during the consultation?", "exhibited": "Were respiratory symptoms exhibited during the consultation?"}
#: Groups of health recordings, and wordings of their annotations.
UNMARKED = ("Non-respiratory episode", "NON_RES")
EXHIBITING = ["RES_SELF_ACOUSTIC", "RES_PROXY_SPEAKER_COUGH"]
WORDINGS = {
    "self, coughed": "Patient (speaker) coughed",
    "self, coughed, coarse voice": "Patient (speaker) coughed; coarse voice noted",
    "self, no cough, coarse voice": "Patient (speaker) had coarse voice; no cough",
    "self, coarse voice": "Patient (speaker) had coarse voice",
    "self, no cough": "No audible respiratory event from patient",
    "self, breathed once": "Single audible breath from patient; no cough",
    "self, no cough, stuffy nose": "Patient (speaker) had audible nasal congestion; no cough",
    "self, stuffy nose": "Patient (speaker) had audible nasal congestion",
    "daughter": "Proxy: speaker's daughter is the patient; no cough heard",
    "son": "Proxy: speaker's son is the patient; no cough heard",
    "son, but speaker coughed": "Proxy: speaker's son is the patient; speaker (parent) coughed",
    "son, coughed": "Proxy: speaker's son is the patient; speaker (parent) coughed",
    "daughter, but speaker coughed": "Proxy: speaker's daughter is the patient; speaker (parent) coughed",
    "daughter, but speaker wheezed and coughed": "Proxy: speaker's daughter is the patient; speaker (parent) wheezed and coughed",
    "someone, but speaker coughed": "Proxy: speaker coughed; described patient is a third party",
}


def lookup(key: Column, table: dict[str, str], keep: bool = True) -> Column:
    """The table's value of a key; another key is itself, or null without ``keep``."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return F.coalesce(found, key) if keep else found


# -- candidates


def strength(c: DataFrame) -> Column:
    """How good a candidate is, by its shape: confidence, size of the change, or spread between speakers; 0 for what is missing."""
    by = F.when(F.col("shape") == "st_event", F.col("cf")).when(F.col("shape") == "ct_trend", F.abs("delta")).when(F.col("shape") == "multi_spk_window", F.col("val_diff"))
    return F.coalesce(by, F.lit(0.0))


def eligible(kind: str) -> Column:
    """Whether a candidate's shape serves a query type; neutral events can't be located."""
    event = F.col("shape") == "st_event"
    return {"state": event, "locate": event & ~F.coalesce(F.col("emo"), F.lit("")).isin(NEUTRAL), "change": F.col("shape") == "ct_trend", "comparison": F.col("shape") == "multi_spk_window"}[kind]


def assigned(candidates: DataFrame, cap: int, key: str = "episode_id", id_col: str = "cand_id", seed: int = 42) -> DataFrame:
    """Candidates of each episode by query type, ``cap`` of a type at most, spread over their strength.

    Types are filled with the scarce ones first.  Changes and comparisons use a candidate up, but no shape serves two such
    types, so the types don't wait for each other; a state and a place may share an event.  Of changes, one place is for a flat
    trend, if there is one.
    """
    rows = candidates.withColumn("_s", strength(candidates))
    out = None
    for kind in QUERY_ORDER:
        pool = rows.where(eligible(kind))
        if kind == "change":
            flat = F.coalesce(F.col("direction") == "none", F.lit(False))
            one = sampling.stratified(pool.where(flat), [key], F.col("_s"), id_col, min(1, cap), seed).drop("bucket")
            taken = one.select(F.col(key).alias("_k")).distinct().withColumn("_one", F.lit(1))
            rest = pool.where(~flat).join(taken, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn("_cap", F.lit(cap) - F.coalesce("_one", F.lit(0))).drop("_k", "_one")
            part = one.unionByName(sampling.stratified(rest, [key], F.col("_s"), id_col, F.col("_cap"), seed).drop("bucket", "_cap"))
        else:
            part = sampling.stratified(pool, [key], F.col("_s"), id_col, cap, seed).drop("bucket")
        part = part.withColumn("query_type", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out.drop("_s")


def spoken_events(labels: DataFrame, segments: DataFrame, least: float = 0.5, back: float = 60.0, before: int = 2, key: str = "episode_id", bucket: float = 300.0) -> DataFrame:
    """Labelled events (key, n, t0, t1, spk text, cf) of confidence ``least`` whose speaker id is a number and whose speaker has ``before``
    segments with text (start, end, speaker, text) in the ``back`` seconds before; with ``n_before``.

    Segments and look-backs meet in the cells of a grid, so a long recording spreads.
    """
    from tessera.operators.intervals import overlap_join

    sure = labels.where((F.col("cf") >= least) & F.col("spk").rlike(r"^[0-9]+$")).withColumn("lo", F.col("t0") - back).withColumn("hi", F.col("t0"))
    said = segments.where("text <> ''").select(key, "start", "end", "speaker")
    met = overlap_join(said, sure.select(key, "n", "spk", "lo", "hi"), key, bucket).where("speaker = spk").groupBy(key, "n").agg(F.count(F.lit(1)).alias("n_before"))
    return sure.drop("lo", "hi").join(grows(met.where(F.col("n_before") >= before)), [key, "n"])


def grown_windows(events: DataFrame, bounds: DataFrame, key: str = "episode_id", most: float = MOST_GROWTH) -> DataFrame:
    """Events (key, n, spk, emo, cf, t0, t1) with the window to locate them in, ``win_t0`` to ``win_t1``.

    A window reaches to the last end before and the first start after of events of the same speaker and emotion with a
    confidence of 0.5, else to the recording's bounds (conv_start, conv_end), where these lie outside the event; by
    ``most`` seconds at most.
    """
    from tessera.operators.events import neighbour_bounds

    span = lambda e: e.select(key, "spk", "emo", "n", F.col("t0").alias("start"), F.col("t1").alias("end"))
    near = neighbour_bounds(span(events), [key, "spk", "emo"], span(events.where("cf >= 0.5 and t1 > t0")))
    joined = events.join(grows(near.select(key, "n", "prev_end", "next_start")), [key, "n"]).join(bounds, key, "left")
    left = F.when(F.col("conv_start") < F.col("t0"), F.col("conv_start")).otherwise(F.greatest(F.lit(0.0), F.col("t0") - most))
    right = F.when(F.col("conv_end") > F.col("t1"), F.col("conv_end")).otherwise(F.col("t1") + most)
    return joined.withColumn("win_t0", F.greatest(F.coalesce("prev_end", left), F.col("t0") - most)).withColumn("win_t1", F.least(F.coalesce("next_start", right), F.col("t1") + most)).drop("prev_end", "next_start")


def hard_clusters(events: DataFrame, key: str = "episode_id", span: float = CLUSTER_SPAN, pad: float = CLUSTER_PAD, least: int = 3) -> DataFrame:
    """The first cluster of each speaker and emotion of an episode: (t0, t1) padded, its size, and the member farthest from its mean as the target.

    ``events``: key, n, spk, emo, cf, t0, t1, act, val, dom.  A cluster begins at an event, goes on while events, in the order of
    their starts, end within ``span`` seconds of its begin, and has ``least`` members; neutral ones and those under a confidence of 0.5 don't count.
    """
    group = [key, "spk", "emo"]
    sure = events.where((F.col("cf") >= 0.5) & ~F.col("emo").isin(NEUTRAL) & F.col("spk").isNotNull())
    order = Window.partitionBy(*group).orderBy("t0", "n")
    # a later event that ends beyond the span ends the run; one that begins beyond it does so anyway, so only those within the span are looked at
    rows = sure.withColumn("_i", F.row_number().over(order))
    span_ahead = Window.partitionBy(*group).orderBy("t0").rangeBetween(0, ceil(span))
    near = rows.select(*group, "_i", "t0", F.collect_list(F.struct(F.col("_i").alias("j"), F.col("t1").alias("t"))).over(span_ahead).alias("_near"))
    late = F.array_min(F.transform(F.filter("_near", lambda x: (x["j"] > F.col("_i")) & (x["t"] - F.col("t0") > span)), lambda x: x["j"]))
    first = near.withColumn("_end", F.coalesce(late, F.array_max("_near.j") + 1)).where(F.col("_end") - F.col("_i") >= least)
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("_i"))).where("_r = 1").select(*group, "_i", "_end", F.col("t0").alias("_begin"))
    reach = rows.select(*group, F.col("_i").alias("_j"), "t1", "n", "act", "val", "dom")
    members = reach.join(grows(first), group).where((F.col("_j") >= F.col("_i")) & (F.col("_j") < F.col("_end")))
    w = Window.partitionBy(*group)
    far = sum(((F.col(v) - F.avg(v).over(w)) ** 2 for v in ("act", "val", "dom")), F.lit(0.0))
    target = members.withColumn("_d", F.round(far, 9)).withColumn("n_events", F.count(F.lit(1)).over(w)).withColumn("_stop", F.max_by("t1", "_j").over(w))
    target = target.withColumn("_r", F.row_number().over(w.orderBy(F.col("_d").desc(), "_j"))).where("_r = 1")
    return target.select(*group, F.greatest(F.lit(0.0), F.col("_begin") - pad).alias("t0"), (F.col("_stop") + pad).alias("t1"), F.col("n").alias("target_n"), "n_events")


def speaker_levels(segments: DataFrame, by: list[str], values: list[str], least: int = 5) -> DataFrame:
    """Means of ``values`` of each speaker with ``least`` segments, rounded to four places."""
    out = segments.groupBy(*by).agg(*[F.round(F.avg(v), 4).alias(v) for v in values], F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") >= least).drop("_n")


def english_songs(languages: DataFrame, songs: DataFrame, shortest: float = 150, longest: float = 300) -> DataFrame:
    """Songs (file, mean, seconds) that are surely English and of a fitting length, with their bucket of 1 to 5 by mean.

    ``languages``: file, lang, prob and, where a second look was taken, lang2, prob2, which count then.
    """
    sure = languages.where((F.coalesce("lang2", "lang") == "en") & (F.coalesce("prob2", "prob") > 0.5)).select("file").distinct()
    bucket = F.greatest(F.lit(1), F.least(F.lit(5), F.bround("mean", 0))).cast("long")
    return songs.join(sure, "file", "left_semi").where(F.col("seconds").between(shortest, longest)).withColumn("bucket", bucket)


def admitted(files: DataFrame, parts: DataFrame, wanted: DataFrame, most: int, ratio: float, key: str = "episode_id") -> DataFrame:
    """(key, train, test) of the ``wanted`` episodes with fewer than ``most`` training files, and under ``ratio`` of them for each test file; without test files the ratio is infinite."""
    rows = files.join(wanted.select(key).distinct(), key, "left_semi").join(parts, "file")
    counted = rows.groupBy(key).agg(F.count_if(F.col("part") == "Train").alias("train"), F.count_if(F.col("part") == "Test1").alias("test"))
    share = F.when(F.col("test") == 0, F.lit(float("inf"))).otherwise(F.col("train") / F.nullif(F.col("test"), F.lit(0)))
    return counted.where((F.col("train") < most) & (share < ratio))


# -- clips


def best_clips(segments: DataFrame, by: list[str], top: list[str], score: str, order: str, most: int) -> DataFrame:
    """The best row by ``score`` of each ``by``, and of these the ``most`` best of each ``top``, numbered; ties by ``order``."""
    one = sampling.first_n(segments, by, [F.col(score).desc(), order], 1)
    rank = F.row_number().over(Window.partitionBy(*top).orderBy(F.col(score).desc(), order))
    return one.withColumn("rank", rank).where(F.col("rank") <= most)


def clean_speech(default_speakers: int = 2, ratio: float = 20.0, shortest: float = 3.0, longest: float = 8.0) -> Column:
    """One speaker, the class Speech, a signal of ``ratio`` and a fitting length; a missing field counts as one that fails."""
    c = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    length = c("end", 0.0) - c("start", 0.0)
    return (c("num_speakers", default_speakers) == 1) & (c("sound", "") == "Speech") & (c("snr", 0.0) >= ratio) & length.between(shortest, longest)


def resolved_clip(clips: Column, ref: Column) -> Column:
    """A map's entry of a reference, else of its upper case; an empty entry counts as none."""
    present = lambda k: F.nullif(F.element_at(clips, k), F.lit(""))
    return F.coalesce(present(ref), present(F.upper(ref)))


# -- query texts


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def _whole(x: str) -> Column:
    return F.col(x).cast("long")


def emotion_queries(c: DataFrame) -> DataFrame:
    """``c`` with query, ground_truth and judge_info (JSON) by query_type.

    Columns of ``c``: query_type, t0, t1, topic, quote, seg_text, emo, cf, votes (map), act, val, dom, dim, direction, delta, half1,
    half2, spk_val (map from speaker number to value), pad_left, pad_right, win_t0, win_t1, target_t0, target_t1, n_events.
    Speakers are A and B by their numbers; of equal values the first is the winner.
    """
    dim, when = F.lower("dim"), text.half_minute_phrase(F.col("t0"))
    lo = F.when(F.col("query_type") == "comparison", F.greatest(F.lit(0), _whole("t0") - F.col("pad_left"))).when(F.col("query_type") == "locate", F.coalesce("win_t0", "t0").cast("long")).otherwise(_whole("t0"))
    hi = F.when(F.col("query_type") == "comparison", _whole("t1") + F.col("pad_right")).when(F.col("query_type") == "locate", F.coalesce("win_t1", "t1").cast("long")).otherwise(_whole("t1"))
    fields = {"when": F.concat(F.upper(F.substring(when, 1, 1)), F.substring(when, 2, 1000)), "lo": lo, "hi": hi, "dim": dim, "topic": F.col("topic"), "quote": F.coalesce("quote", F.lit(""))}
    query = shaping.filled(lookup(F.col("query_type"), EMOTION_TEXTS, False), fields)
    speakers = F.array_sort(F.transform(F.map_entries("spk_val"), lambda e: F.struct(e["key"].cast("long").alias("n"), e["value"].alias("v"))))
    a, b = F.get(speakers, F.lit(0))["v"], F.get(speakers, F.lit(1))["v"]
    best = F.get(F.array_sort(F.transform(speakers, lambda e: F.struct((-e["v"]).alias("v"), e["n"].alias("n")))), F.lit(0))["n"]
    winner = F.when(best == F.get(speakers, F.lit(0))["n"], "A").otherwise("B")
    pair = F.create_map(F.lit("A"), a, F.lit("B"), b)
    others = F.map_filter("votes", lambda k, v: k != F.col("emo"))
    target0, target1 = F.when(F.col("query_type") == "locate_hard", _whole("target_t0")).otherwise(_whole("t0")), F.when(F.col("query_type") == "locate_hard", _whole("target_t1")).otherwise(_whole("t1"))
    at = text.half_minute_phrase(F.when(F.col("query_type") == "locate_hard", F.col("target_t0")).otherwise(F.col("t0")))
    place = {"time_ref": at, "t0": target0, "t1": target1, "quote": F.coalesce("quote", F.lit("")), "emo": F.col("emo")}
    found = {"type": F.lit("time_and_quote"), "t0": target0, "t1": target1, "emo": F.col("emo"), "seg_text": F.coalesce("seg_text", F.lit("")), "time_tolerance_s": F.lit(15)}
    several = {"n_events": F.col("n_events")}
    by = lambda state, change, comparison, locate, hard: F.when(F.col("query_type") == "state", state).when(F.col("query_type") == "change", change).when(F.col("query_type") == "comparison", comparison).when(F.col("query_type") == "locate", locate).when(F.col("query_type") == "locate_hard", hard)
    halves = {"direction": F.col("direction"), "half1": F.col("half1"), "half2": F.col("half2")}
    truth = by(
        _json(emo=F.col("emo"), cf=F.col("cf"), votes=F.col("votes"), secondary=others, act=F.col("act"), val=F.col("val"), dom=F.col("dom")),
        _json(**halves, delta=F.col("delta")), _json(winner=winner, dim=F.col("dim"), spk_val=pair), _json(**place), _json(**place, **several),
    )
    judge = by(
        _json(type=F.lit("categorical"), primary=F.col("emo"), secondary=others, votes=F.col("votes"), cf=F.col("cf"), valence=F.col("val"), arousal=F.col("act"), dominance=F.col("dom")),
        _json(type=F.lit("trend"), **halves), _json(type=F.lit("speaker_id"), dim=F.col("dim"), winner=winner, spk_val=pair), _json(**found), _json(**found, **several),
    )
    ref = F.when(F.col("query_type") == "locate_hard", F.col("target_t0")).otherwise(F.col("t0"))
    return c.withColumn("query", query).withColumn("time_ref", ref).withColumn("ground_truth", truth).withColumn("judge_info", judge)


def music_queries(pairs: DataFrame, clips: DataFrame) -> DataFrame:
    """``pairs`` (track, ref_method, file_a, file_b, time_a, time_b, position_a, position_b) with query and the references a and b.

    References are seconds, places or clip names, as texts; a pair by clips that lacks a clip (name, track, file_name) is left out.
    """
    c = clips.groupBy("track", "file_name").agg(F.min("name").alias("name"))
    side = lambda x: c.select(F.col("track").alias(f"_t{x}"), F.col("file_name").alias(f"_f{x}"), F.col("name").alias(f"_clip_{x}"))
    joined = pairs
    for x in ("a", "b"):
        joined = joined.join(side(x), (F.col("track") == F.col(f"_t{x}")) & (F.col(f"file_{x}") == F.col(f"_f{x}")) & (F.col("ref_method") == "audio"), "left").drop(f"_t{x}", f"_f{x}")
    method = F.col("ref_method")
    said = lambda x: F.when(method == "time", text.half_minute_phrase(F.col(f"time_{x}"))).when(method == "position", text.ordinal(F.col(f"position_{x}")))
    ref = lambda x: F.when(method == "time", F.col(f"time_{x}").cast("string")).when(method == "position", F.col(f"position_{x}").cast("string")).when(method == "audio", F.col(f"_clip_{x}"))
    out = joined.where((method != "audio") | (F.col("_clip_a").isNotNull() & F.col("_clip_b").isNotNull()))
    return out.withColumn("query", shaping.filled(lookup(method, MUSIC_TEXTS, False), {"a": said("a"), "b": said("b")})).withColumn("ref_a", ref("a")).withColumn("ref_b", ref("b")).drop("_clip_a", "_clip_b")


def health_queries(files: DataFrame, marks: DataFrame, choices: DataFrame) -> DataFrame:
    """Two queries of each recording (file), numbered from 1 in the order of the files: query_id, episode_id, query_type, query, answer, grp, annotation.

    ``marks``: file, annotation, grp; files without a mark aren't respiratory.  ``choices``: file, question, answer.
    """
    from tessera.operators.ordering import ranked

    m = marks.select(F.col("file").alias("_m"), "annotation", "grp")
    q = choices.select(F.col("file").alias("_q"), F.coalesce("question", F.lit("")).alias("mcq_question"), F.coalesce("answer", F.lit("")).alias("mcq_answer"))
    joined = files.select("file").join(m, F.col("file") == F.col("_m"), "left").join(q, F.col("file") == F.col("_q"), "left")
    group = F.coalesce("grp", F.lit(UNMARKED[1]))
    told = lookup(F.trim(F.coalesce("annotation", F.lit(UNMARKED[0]))), WORDINGS)
    rows = shaping.doubled(joined.select("file", group.alias("grp"), told.alias("annotation"), F.coalesce("mcq_question", F.lit("")).alias("mcq_question"), F.coalesce("mcq_answer", F.lit("")).alias("mcq_answer")), ["reported", "exhibited"])
    yes = F.when(F.col("query_type") == "reported", F.col("grp") != UNMARKED[1]).otherwise(F.col("grp").isin(EXHIBITING))
    rows = rows.withColumn("query", lookup(F.col("query_type"), HEALTH_TEXTS)).withColumn("answer", F.when(yes, "Yes").otherwise("No"))
    numbered = ranked(rows, [], ["file", F.col("query_type").desc()], "query_id")
    return numbered.withColumn("episode_id", F.regexp_replace("file", r"\.[^.]*$", ""))


def enriched(queries: DataFrame, songs: DataFrame) -> DataFrame:
    """Queries (winner, delta, file_a, file_b) with near ties decided by the sign of delta, and each song's times (file_name, start, end) and their middle."""
    won = F.when((F.col("winner") == "tie") & (F.coalesce("delta", F.lit(0.0)) > 0), "A").when((F.col("winner") == "tie") & (F.coalesce("delta", F.lit(0.0)) < 0), "B").otherwise(F.col("winner"))
    out = queries.withColumn("winner", won)
    for x in ("a", "b"):
        s = songs.select(F.col("file_name").alias("_f"), F.col("start").alias(f"start_{x}"), F.col("end").alias(f"end_{x}"))
        out = out.join(s, F.col(f"file_{x}") == F.col("_f"), "left").drop("_f").withColumn(f"time_ref_{x}", (F.col(f"start_{x}") + F.col(f"end_{x}")) / 2)
    return out


def song_pairs(songs: DataFrame, methods: list[str], least: int, tie: float, seed: int = 42, key: str = "track_name") -> DataFrame:
    """Songs (key, song_id, file_name, start, end, mean) paired in a drawn order, pair by pair with the methods in turn.

    Only keys with ``least`` songs, and only the first ``least`` / 2 pairs of each; winners by the rounded difference of the means.
    """
    drawn = Window.partitionBy(key).orderBy(sampling.draw(F.col("song_id"), seed), "song_id")
    rows = songs.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("start", "file_name"))).withColumn("_n", F.row_number().over(drawn) - 1).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(key)))
    kept = rows.where((F.col("_all") >= least) & (F.col("_n") < least)).withColumn("pair", F.floor(F.col("_n") / 2))
    side = lambda x, odd: kept.where(F.col("_n") % 2 == odd).select(F.col(key).alias(f"_k{x}"), F.col("pair").alias(f"_p{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("file_name", "start", "end", "mean", "position")])
    joined = side("a", 0).join(side("b", 1), (F.col("_ka") == F.col("_kb")) & (F.col("_pa") == F.col("_pb")))
    delta = F.round(F.col("mean_a") - F.col("mean_b"), 4)
    method = F.element_at(F.array(*map(F.lit, methods)), (F.col("_pa") % len(methods) + 1).cast("int"))
    winner = F.when(F.abs(delta) < tie, "tie").when(delta > 0, "a").otherwise("b")
    ref = lambda x: F.when(method == "time", numbers.aligned_middle(F.col(f"start_{x}"), F.col(f"end_{x}")))
    return joined.select(F.col("_ka").alias(key), F.col("_pa").alias("pair"), method.alias("ref_method"), "file_name_a", "file_name_b", "position_a", "position_b", ref("a").alias("time_a"), ref("b").alias("time_b"), delta.alias("delta"), winner.alias("winner"))


# -- clips in query texts


def placed_clips(query: Column, clips: dict[str, Column]) -> Column:
    """A query text with the placeholders of clips replaced by their file names, where a clip is there."""
    #: Placeholders and the field that fills each, in the order in which they are tried.
    places = [("[A's audio example]", "audio_spk"), ("[B's audio example]", "audio_spk2"), ("[audio example]", "audio_spk"), ("[audio example]", "audio_emo"), ("[speaker example]", "audio_spk"), ("[emotion example]", "audio_emo")]
    for place, field in places:
        name = F.element_at(F.split(clips[field], "/"), -1)
        query = F.when(F.coalesce(clips[field], F.lit("")) != "", F.replace(query, F.lit(place), F.concat(F.lit("["), name, F.lit("]")))).otherwise(query)
    return query
