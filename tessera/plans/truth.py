"""Ground truth of queries: expected answers, evidence, plans made from the truth, and its descriptions for prompts.

Queries are rows with query_id, episode_id and, where a function asks for them: task, judge_type, t0 (of the judge's record), time_ref,
gt_seg_ids (array), blocks (array of time_ref, position, file_name, name: song_a, song_b, speaker_a, speaker_b), clips
(array of clip paths: the first and the second speaker's).  Truth segments have episode_id, seg_id, ord (file order), start, end,
speaker, label, text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import intervals
from tessera.operators.builders import EMOTION_NAMES, lookup
from tessera.operators.ordering import ranked
from tessera.plans.metrics import JUDGE_TOLERANCE
from tessera.session import grows, stored

#: Judge types that point at one event, seconds around a time, lengths of windows, and the grid of interval joins.
POINTING = ["categorical", "time_and_quote"]
HALF, CHANGE, COMPARISON, GRID = 30.0, 30.0, 60.0, 300.0
SEGMENT = ["seg_id", "ord", "start", "end", "speaker", "label", "text"]
#: Fixed value: about how many rows of plans one task makes where queries get all segments of an episode or a song.
PLANS = 500_000
#: What directions are called.
DIRECTIONS = {"up": "rising", "down": "falling", "none": "stable"}


def _entries(json: Column) -> Column:
    return F.from_json(json, "map<string,string>")


def expected_answer(item: Column) -> Column:
    """The expected answer in a query's JSON record: the first field that is there, even if it is null.

    In turn: the answer; of judge_info answer, direction, primary; of ground_truth direction, answer, winner, emo; of
    domain_labels primary.
    """
    top = _entries(item)
    judge, truth, labels = (_entries(F.element_at(top, k)) for k in ("judge_info", "ground_truth", "domain_labels"))
    has = lambda m, k: F.coalesce(F.map_contains_key(m, F.lit(k)), F.lit(False))
    out = F.when(has(top, "answer"), F.element_at(top, "answer"))
    for where, keys in ((judge, ("answer", "direction", "primary")), (truth, ("direction", "answer", "winner", "emo"))):
        for k in keys:
            out = out.when(has(where, k), F.element_at(where, k))
    return out.otherwise(F.element_at(labels, "primary"))


def _event_time() -> Column:
    """Seconds that a judge's record or a query points at; 0 counts as missing."""
    return F.coalesce(F.nullif("t0", F.lit(0.0)), F.nullif("time_ref", F.lit(0.0)), F.lit(0.0)).cast("double")


def _time() -> Column:
    return F.coalesce("time_ref", F.lit(0.0)).cast("double")


def _refs() -> Column:
    return F.transform(F.filter(F.coalesce("blocks", F.array()), lambda b: b["time_ref"].isNotNull()), lambda b: b["time_ref"].cast("double"))


def _positions() -> Column:
    return F.transform(F.filter(F.coalesce("blocks", F.array()), lambda b: b["position"].isNotNull()), lambda b: b["position"].cast("int"))


def _has_ids() -> Column:
    return F.size(F.coalesce("gt_seg_ids", F.array().cast("array<string>"))) > 0


def _by_ids(queries: DataFrame, truth: DataFrame) -> DataFrame:
    ids = queries.select("query_id", "episode_id", F.explode(F.array_distinct("gt_seg_ids")).alias("seg_id"))
    return ids.join(grows(truth.select("episode_id", *SEGMENT)), ["episode_id", "seg_id"]).select("query_id", *SEGMENT)


def _in_windows(windows: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, segment) of each segment that a window (query_id, episode_id, lo, hi) of its episode overlaps, once."""
    met = intervals.overlap_join(truth.select("episode_id", *SEGMENT), windows.select("query_id", "episode_id", "lo", "hi"), "episode_id", GRID)
    return met.select("query_id", *SEGMENT).dropDuplicates(["query_id", "seg_id"])


def resolved_evidence(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, segment): the truth's segments that a query is about.

    Listed ids alone where there are any.  Else, for judge types that point at an event, the one segment within a second of it
    that starts nearest, or else the one that starts nearest at all.  Else those in the window of a change (widened by a second)
    or of a comparison, if any; else those within half a minute of the query's times, if it has times; else those of its songs
    by place, if any; else all of the episode.

    Queries and truth are written once, and so is what each step finds, so that no plan holds more than one step.
    """
    queries = stored(queries.select("query_id", "episode_id", "judge_type", "t0", "time_ref", "gt_seg_ids", "blocks"), "asked")
    truth = stored(truth.select("episode_id", *SEGMENT), "truth")
    listed = queries.where(_has_ids())
    rest = queries.where(~_has_ids())
    pointing = rest.where(F.col("judge_type").isin(POINTING)).select("query_id", "episode_id", _event_time().alias("t"))
    spans = pointing.select("query_id", "episode_id", "t", (F.col("t") - 1.001).alias("lo"), (F.col("t") + 1.001).alias("hi"))
    close = intervals.overlap_join(truth.select("episode_id", *SEGMENT), spans, "episode_id", GRID).where((F.col("start") <= F.col("t") + 1) & (F.col("end") >= F.col("t") - 1))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.abs(F.col("start") - F.col("t")), "start", "ord"))
    at = stored(close.withColumn("_r", first).where("_r = 1").select("query_id", *SEGMENT), "close")
    far = stored(intervals.nearest_within(pointing.join(grows(at.select("query_id")), "query_id", "left_anti"), truth.select("episode_id", *SEGMENT), 0.0, order="ord").select("query_id", *SEGMENT), "far")
    others = rest.where(~F.coalesce(F.col("judge_type").isin(POINTING), F.lit(False)))
    lo = F.when(F.col("judge_type") == "trend", _time() - 1).when(F.col("judge_type") == "speaker_id", _time())
    hi = F.when(F.col("judge_type") == "trend", _time() + CHANGE + 1).when(F.col("judge_type") == "speaker_id", _time() + COMPARISON)
    typed = stored(_in_windows(others.withColumn("lo", lo).withColumn("hi", hi).where("lo is not null"), truth), "typed")
    others = others.join(grows(typed.select("query_id").distinct()), "query_id", "left_anti")
    times = F.concat(F.when(F.col("time_ref").isNotNull(), F.array(F.col("time_ref").cast("double"))).otherwise(F.array().cast("array<double>")), _refs())
    timed = others.where(F.size(times) > 0).select("query_id", "episode_id", F.explode(times).alias("t")).select("query_id", "episode_id", F.greatest(F.lit(0.0), F.col("t") - HALF).alias("lo"), (F.col("t") + HALF).alias("hi"))
    placeless = others.where(F.size(times) == 0)
    tags = placeless.select("query_id", "episode_id", F.explode(F.array_distinct(_positions())).alias("p")).select("query_id", "episode_id", F.format_string("SONG_%02d", F.col("p") - 1).alias("speaker"))
    placed = stored(tags.join(grows(truth.select("episode_id", *SEGMENT)), ["episode_id", "speaker"]).select("query_id", *SEGMENT), "placed")
    every = placeless.join(grows(placed.select("query_id").distinct()), "query_id", "left_anti").select("query_id", "episode_id").join(grows(truth.select("episode_id", *SEGMENT)), "episode_id").select("query_id", *SEGMENT)
    out = _by_ids(listed, truth)
    for part in (at, far, typed, stored(_in_windows(timed, truth), "timed"), placed, every):
        out = out.unionByName(part)
    return out


def _localized(start: Column, end: Column) -> Column:
    return F.format_string("%d sec to %d sec", F.floor(start), F.ceil(end))


def _given(queries: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """(query_id, set_no, localize): to each of ``queries`` all ``sets`` (numbered by ``_no``) of its ``by``.

    What comes out of a group is its queries times its sets; so a group is cut into shares of about ``PLANS`` rows, its queries dealt
    to them and its sets repeated for each, and shares go to as many tasks as shuffles have, however few bytes go in.
    """
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    shares = stored(count(queries, "_q").join(grows(count(sets, "_s")), by).select(*by, F.ceil(F.col("_q") * F.col("_s") / F.lit(PLANS)).alias("_shares")), "shares")
    dealt = queries.join(grows(shares), by).withColumn("_share", F.pmod(F.xxhash64("query_id"), F.col("_shares"))).drop("_shares").repartition(n, *by, "_share")
    copies = sets.join(grows(shares), by).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1))).drop("_shares")
    return dealt.join(grows(copies), [*by, "_share"]).select("query_id", F.col("_no").cast("int").alias("set_no"), "localize")


def oracle_plans(queries: DataFrame, truth: DataFrame, extracted: DataFrame, speakers: DataFrame, longest: int = 60) -> DataFrame:
    """(query_id, set_no, localize): plans made from the truth instead of by a model.

    Health: the recording's first ``longest`` seconds.  An event: the extracted segment (else the truth's, where an episode has no
    extracted ones) that holds it or starts nearest.  A change: its window.  A comparison: for each of the two speakers, known by
    their clips (``speakers``: clip, speaker), its first segment in the window, one with a label before others; without any, the two
    halves of the window.  Else: listed segments; else those at the blocks' times, each once; else those of the first song that
    is given by its place; else all.

    Each query takes one of these ways, so each way numbers its own sets; where a query gets all segments of an episode or a song, these
    are numbered once for all queries.  Truth and extracted segments of the queries' episodes are written once.
    """
    asked = queries.select(F.col("episode_id").alias("_asked")).distinct()
    known = lambda df: df.join(grows(asked), F.col("episode_id") == F.col("_asked"), "left_semi")
    truth = stored(known(truth.select("episode_id", "seg_id", "ord", "start", "end", "speaker", "label")), "truth")
    extracted = stored(known(extracted.select("episode_id", "ord", "start", "end")), "extracted")

    rest = queries.where("not coalesce(task = 'health', false)")
    kind = F.coalesce("judge_type", F.lit(""))
    text_of = _localized(F.col("start"), F.col("end")).alias("localize")
    only = lambda df, localize: df.select("query_id", F.lit(0).alias("set_no"), localize.alias("localize"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("o")) - 1
    numbered = lambda df, o: df.withColumn("o", o).select("query_id", number.cast("int").alias("set_no"), text_of)
    window = lambda a, b: F.concat(a.cast("long").cast("string"), F.lit(" sec to "), b.cast("long").cast("string"), F.lit(" sec"))
    health = only(queries.where("task = 'health'"), F.lit(f"0 sec to {longest} sec"))

    own = ["episode_id", "ord", "start", "end"]
    bare = truth.select(*own).join(grows(extracted.select("episode_id").distinct()), "episode_id", "left_anti")
    points = rest.where(kind.isin(POINTING)).select("query_id", "episode_id", _event_time().alias("t"))

    changes = only(rest.where(kind == "trend"), window(_time(), _time() + CHANGE))

    compared = rest.where(kind == "speaker_id").select("query_id", "episode_id", _time().cast("long").alias("a"), (_time() + COMPARISON).cast("long").alias("b"), "clips")
    named = compared.select("query_id", "episode_id", "a", "b", F.posexplode(F.coalesce("clips", F.array().cast("array<string>"))).alias("o", "clip")).withColumn("clip", F.element_at(F.split("clip", "/"), -1))
    spoken = named.join(speakers.select("clip", "speaker"), "clip").join(grows(truth.select("episode_id", "ord", "start", "end", "speaker", "label")), ["episode_id", "speaker"]).where((F.col("start") < F.col("b")) & (F.col("end") > F.col("a")))
    best = F.row_number().over(Window.partitionBy("query_id", "o").orderBy(F.coalesce("label", F.lit("")) == "", "start", "ord"))
    pairs = stored(numbered(spoken.withColumn("_r", best).where("_r = 1"), F.col("o")), "pairs")
    middle = F.floor((F.col("a") + F.col("b")) / 2)
    halves = F.array(F.struct(F.lit(0).alias("set_no"), F.col("a").alias("x"), middle.alias("y")), F.struct(F.lit(1).alias("set_no"), middle.alias("x"), F.col("b").alias("y")))
    guessed = compared.join(grows(pairs.select("query_id").distinct()), "query_id", "left_anti").select("query_id", F.explode(halves).alias("h")).select("query_id", "h.set_no", window(F.col("h.x"), F.col("h.y")).alias("localize"))

    others = rest.where(~kind.isin(*POINTING, "trend", "speaker_id"))
    listed = numbered(_by_ids(others.where(_has_ids()), truth.withColumn("text", F.lit(None).cast("string"))), F.col("ord"))
    free = others.where(~_has_ids())
    at = free.select("query_id", "episode_id", F.posexplode(_refs()).alias("o", "t"))
    line = lambda df, k: df.where("episode_id is not null").withColumn("_line", F.struct(F.lit(k).alias("k"), "episode_id")).drop("episode_id")
    places = line(points.withColumn("o", F.lit(0)), 0).unionByName(line(at, 1))
    pieces = line(extracted.select(*own).unionByName(bare).withColumn("seg_id", F.lit(None).cast(truth.schema["seg_id"].dataType)), 0).unionByName(line(truth.select("seg_id", *own), 1))
    near = stored(intervals.nearest(places, pieces, "_line", "ord"), "near")
    events = only(near.where("_line.k = 0"), text_of)
    times = stored(numbered(near.where("_line.k = 1").groupBy("query_id", "seg_id", "start", "end").agg(F.min("o").alias("_o")), F.col("_o")), "times")
    timed = F.size(_refs()) > 0
    slim = lambda df: df.select("query_id", "episode_id", _positions().alias("_at"))
    placeless = slim(free.where(~timed)).unionByName(slim(free.where(timed)).join(grows(times.select("query_id").distinct()), "query_id", "left_anti"))
    placed = F.size("_at") > 0
    of_song = ranked(truth.where("speaker is not null").select("episode_id", "speaker", "ord", text_of), ["episode_id", "speaker"], ["ord"], "_no", 0)
    of_all = ranked(truth.select("episode_id", "ord", text_of), ["episode_id"], ["ord"], "_no", 0)
    songs = _given(placeless.where(placed).select("query_id", "episode_id", F.format_string("SONG_%02d", F.col("_at")[0]).alias("speaker")), of_song, ["episode_id", "speaker"])
    every = _given(placeless.where(~placed).select("query_id", "episode_id"), of_all, ["episode_id"])
    out = health
    for part in (events, changes, pairs, guessed, listed, times, songs, every):
        out = out.unionByName(part)
    return out


def with_file_evidence(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """Queries without listed ids get those of the songs that their blocks name by file (``truth`` with file_name), in the order of the blocks."""
    named = queries.where(~_has_ids()).select("query_id", "episode_id", F.posexplode("blocks").alias("o", "b")).select("query_id", "episode_id", "o", F.col("b.file_name").alias("file_name")).where("file_name is not null")
    tag = truth.where("file_name is not null").groupBy("episode_id", "file_name").agg(F.max_by("speaker", "ord").alias("speaker"))
    last = truth.groupBy("episode_id", "speaker").agg(F.max_by("seg_id", "ord").alias("seg_id"))
    found = named.join(tag, ["episode_id", "file_name"]).join(last, ["episode_id", "speaker"]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("o", "seg_id"))).alias("_f"))
    joined = queries.join(found, "query_id", "left")
    return joined.withColumn("gt_seg_ids", F.when(F.col("_f").isNotNull(), F.transform("_f", lambda x: x["seg_id"])).otherwise(F.col("gt_seg_ids"))).drop("_f")


# -- descriptions


def level_word(x: Column) -> Column:
    return F.when(x.isNull(), "?").when(x < 2, "low").when(x < 3, "below-avg").when(x < 4, "mid").otherwise("high")


# The lines that tell the truth of a judge's record, by its type; {x} stands for a field as it is written there, {x:name} for an
# emotion's name, {x:3} for a number with three places, {x:votes} for counts by emotions' names.
SUMMARIES = {
    "speaker_id": ["GT: {spk_val:speakers}  →  winner = Speaker {winner}"],
    "categorical": ["GT primary emotion: {primary:name} ({primary}), confidence={cf:text}", "\n  annotator votes: {votes:votes}", "\n  secondary (minority): {secondary:votes}"],
    "trend": ["GT trend: {direction:trend} ('{direction}')", "  |  first-half mean={half1:3}, second-half mean={half2:3}"],
    "time_and_quote": ["GT emotion: {emo:name} ({emo})  at [{t0:none}s – {t1:none}s]", '\n  reference text: "{seg_text:some}"'],
    "songs": ["GT: Song A mean={mean_a:none} ({mean_a:level})  Song B mean={mean_b:none} ({mean_b:level})  →  winner = Song {winner}", "  (delta={delta:3})", "\n  Song A dims: {scores_a:dims}", "\n  Song B dims: {scores_b:dims}"],
}


def _fields(record: Column) -> dict:
    """How a field of a record (a map of texts) is shown, by the name of a form; null where a line with it is to be left out."""
    at = lambda k: F.element_at(record, k)
    named = lambda c: F.coalesce(lookup(F.upper(c), EMOTION_NAMES, False), c)
    entries = lambda k: F.map_entries(_entries(at(k)))
    joined = lambda k, one, apart: F.nullif(F.array_join(F.transform(entries(k), one), apart), F.lit(""))
    number = lambda c: F.format_string("%.3f", c.try_cast("double"))
    return {
        "": lambda k: F.coalesce(at(k), F.lit("?")),
        "text": lambda k: F.coalesce(at(k), F.lit("")),
        "none": lambda k: F.coalesce(at(k), F.lit("None")),
        "some": lambda k: F.nullif(at(k), F.lit("")),
        "name": lambda k: named(F.coalesce(at(k), F.lit("?"))),
        "3": lambda k: F.when(at(k).isNotNull(), number(at(k))),
        "trend": lambda k: lookup(F.lower(F.coalesce(at(k), F.lit("?"))), DIRECTIONS),
        "level": lambda k: level_word(at(k).try_cast("double")),
        "votes": lambda k: F.concat(F.lit("{"), joined(k, lambda e: F.concat(F.lit("'"), named(e["key"]), F.lit("': "), e["value"]), ", "), F.lit("}")),
        "dims": lambda k: joined(k, lambda e: F.concat(e["key"], F.lit("="), e["value"]), "  "),
        "speakers": lambda k: F.coalesce(joined(k, lambda e: F.concat(F.lit("Speaker "), e["key"], F.lit(" "), F.coalesce(at("dim"), F.lit("dim")), F.lit("="), number(e["value"])), "  "), F.lit("")),
    }


def _filled(lines: list[str], record: Column) -> Column:
    """The lines with their fields; all but the first are left out where they ask for a field that isn't there."""
    show, out = _fields(record), []
    for k, line in enumerate(lines):
        parts = [F.lit(x) if j % 2 == 0 else show[x.partition(":")[2]](x.partition(":")[0]) for j, x in enumerate(re.split(r"\{([^}]*)\}", line))]
        out.append(F.concat(*parts) if k == 0 else F.coalesce(F.concat(*parts), F.lit("")))
    return F.concat(*out)


def truth_summary(judge_info: Column, ground_truth: Column) -> Column:
    """One description of the truth by the judge's type (speaker, class, trend, place), of a pair of songs, or of whatever else the record has.

    Numbers stand as they are written in the records, entries in their order there.
    """
    j, g = F.coalesce(_entries(judge_info), _entries(F.lit("{}"))), _entries(ground_truth)
    kind = F.element_at(j, "type")
    by = F.lit(None).cast("string")
    for name in ("speaker_id", "categorical", "trend", "time_and_quote"):
        by = F.when(kind == name, _filled(SUMMARIES[name], j)).otherwise(by)
    songs = _filled(SUMMARIES["songs"], F.map_concat(j, F.coalesce(g, _entries(F.lit("{}")))))
    other = F.map_entries(F.map_filter(j, lambda k, v: v.isNotNull() & (k != "type")))
    told = F.array_join(F.transform(other, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    bare = F.coalesce(F.concat(F.lit("{'type': '"), kind, F.lit("'}")), F.lit("{}"))
    rest = F.when(F.size(other) > 0, F.concat(F.coalesce(F.concat(F.lit("GT ("), kind, F.lit("): ")), F.lit("GT: ")), told)).otherwise(bare)
    some = F.element_at(g, "mean_a").isNotNull() | F.element_at(g, "mean_b").isNotNull()
    return F.coalesce(by, F.when(some, songs).otherwise(rest))


def label_line(blocks: Column) -> Column:
    """"A = ..., B = ..." for a query's items, by their place, else their time, else their name; '' without any."""
    letters = F.array(*map(F.lit, "ABAB"))
    said = lambda b: F.when(b["position"].isNotNull(), F.concat(F.lit("song #"), b["position"].cast("string"))).when(b["time_ref"].isNotNull(), F.concat(F.lit("song/speaker around "), b["time_ref"].cast("string"), F.lit("s"))).otherwise(b["name"])
    lines = F.transform(blocks, lambda b, i: F.concat(F.get(letters, i), F.lit(" = "), said(b)))
    return F.coalesce(F.array_join(F.filter(lines, lambda x: x.isNotNull()), ", "), F.lit(""))


def set_guide(localized: Column) -> Column:
    """Which window each of a plan's sets covers, a line for each; '' for fewer than two sets."""
    order = lambda i: F.when(i == 0, "first mentioned").when(i == 1, "second mentioned").when(i == 2, "third mentioned").otherwise(F.concat((i + 1).cast("string"), F.lit("th")))
    lines = F.transform(localized, lambda x, i: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit("Set "), (i + 1).cast("string"), F.lit(": "), x, F.lit(" ("), order(i), F.lit(")"))))
    kept = F.filter(lines, lambda x: x.isNotNull())
    return F.when((F.size(localized) >= 2) & (F.size(kept) > 0), F.concat(F.lit("Evidence set time anchors:\n"), F.array_join(kept, "\n"))).otherwise("")


def trace_summaries(windows: DataFrame, traces: DataFrame, key: str = "episode_id") -> DataFrame:
    """(query_id, label, dim, mean, least, most, trend) of the trace rows (key, dim, ord, start, end, mean) that each window (query_id, label, lo, hi) overlaps."""
    from tessera.operators.events import halves

    met = intervals.overlap_join(traces.select(key, "dim", "ord", "start", "end", F.col("mean").alias("value")), windows.select(key, "query_id", "label", "lo", "hi"), key, GRID)
    return halves(met, ["query_id", "label", "dim"], ["ord"])


def truth_side(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, label, lo, hi, n, lines): the truth's segments at a query's quote, at its window or its time, and at its blocks' times.

    Queries: quote, w0, w1 (the window), time_ref, blocks.  A label without segments has no row.
    """
    from tessera.plans.prompts import truth_block

    around = lambda t: F.struct(F.greatest(F.lit(0.0), t - HALF).alias("lo"), (t + HALF).alias("hi"))
    own = F.when(F.col("w0").isNotNull() & F.col("w1").isNotNull(), F.struct(F.lit("window").alias("label"), F.struct(F.col("w0").alias("lo"), F.col("w1").alias("hi")).alias("w"))).when(F.col("time_ref").isNotNull(), F.struct(F.lit("center").alias("label"), around(F.col("time_ref").cast("double")).alias("w")))
    named = F.transform(F.filter(F.transform(F.coalesce("blocks", F.array()), lambda b, i: F.struct(F.concat(F.lit("block "), i.cast("string")).alias("label"), b["time_ref"].cast("double").alias("t"))), lambda x: x["t"].isNotNull()), lambda x: F.struct(x["label"].alias("label"), around(x["t"]).alias("w")))
    windows = queries.select("query_id", "episode_id", F.explode(F.filter(F.concat(F.array(own), named), lambda x: x.isNotNull())).alias("x")).select("query_id", "episode_id", "x.label", "x.w.lo", "x.w.hi")
    met = intervals.overlap_join(truth.select("episode_id", "seg_id", "ord", "start", "end", "speaker", "text"), windows, "episode_id", GRID).select("query_id", "label", "lo", "hi", "start", "end", "speaker", "text")
    quoted = queries.where(F.coalesce("quote", F.lit("")) != "").select("query_id", "episode_id", F.lower(F.trim("quote")).alias("_q"))
    none = F.lit(None).cast("double")
    hits = quoted.join(grows(truth.select("episode_id", "start", "end", "speaker", "text")), "episode_id").where(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.col("_q"))).select("query_id", F.lit("quote").alias("label"), none.alias("lo"), none.alias("hi"), "start", "end", "speaker", "text")
    rows = stored(met.unionByName(hits).withColumn("_key", F.struct("query_id", "label", "lo", "hi")), "side")
    n = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    return truth_block(rows, "_key").join(grows(n), "_key").select("_key.*", "n", F.col("block").alias("lines"))


def in_window(windows: DataFrame, truth: DataFrame, traced: DataFrame) -> DataFrame:
    """(query_id, seg_ids, traced): the segments in each window of its episode, in file order, and whether the episode has traces."""
    met = intervals.overlap_join(truth.select("episode_id", "seg_id", "ord", "start", "end"), windows, "episode_id", GRID).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "seg_id"))).alias("_s"))
    t = traced.select("episode_id").distinct().withColumn("_t", F.lit(True))
    none = F.array().cast("array<string>")
    return windows.join(met, "query_id", "left").join(t, "episode_id", "left").select("query_id", F.coalesce(F.transform("_s", lambda x: x["seg_id"]), none).alias("seg_ids"), F.coalesce("_t", F.lit(False)).alias("traced"))


def spoken_by(truth: DataFrame, speaker: str) -> DataFrame:
    """Segments of one speaker."""
    return truth.where(F.col("speaker") == speaker)


def evidence_windows(predictions: DataFrame) -> DataFrame:
    """(query_id, lo, hi) of the times in nested evidence (array of sets, each an array with ``time``); times that aren't pairs are left out."""
    flat = predictions.select("query_id", F.explode(F.flatten("evidence_sets")).alias("e")).where(F.size("e.time") == 2)
    return flat.select("query_id", F.col("e.time")[0].cast("double").alias("lo"), F.col("e.time")[1].cast("double").alias("hi"))


def evidence_in_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, segment): truth segments that any evidence window of a prediction (query_id, episode_id, evidence_sets) overlaps, each once."""
    w = evidence_windows(predictions).join(predictions.select("query_id", "episode_id"), "query_id")
    return _in_windows(w, truth)


def first_of(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """The rows of all parts, of rows with equal ``by`` the one of the earliest part (of equals in a part, any)."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(k))
        out = p if out is None else out.unionByName(p)
    rest = [c for c in out.columns if c not in by]
    first = out.groupBy(*by).agg(F.min_by(F.struct(*rest), "_part").alias("_x"))
    return first.select(*by, *[F.col(f"_x.{c}") for c in rest if c != "_part"])


# -- the judge's part


#: What a judge is told of the truth and asked to accept, by the judge's type; fields as in ``SUMMARIES``.
ASKED = {
    "time_and_quote": ["Truth: the emotion is {emo:name} (code {emo}), heard from {t0:none} to {t1:none} s; times from {from} to {to} s are accepted.", '\nSaid there: "{seg_text:some}"'],
    "categorical": ["Truth: the emotion is {primary:name} (code {primary}), confidence {cf:text}.", "\nVotes: {votes:votes}", "\nSome heard: {secondary:votes}"],
    "trend": ["Truth: the trend is {direction:trend} (code {direction}).", "\nMeans: {half1:3} in the first half, {half2:3} in the second."],
}
RULES = {
    "time_and_quote": "Bounds that the question names are a window to search: any time inside it may be the answer. Accept if the prediction names this emotion, by name, code or a word for the same feeling, and a time that is accepted; the words needn't be quoted.",
    "categorical": "Accept if the prediction names this emotion, by name or code, even among others; reject if it is missing or contradicted.",
    "trend": "Accept if the values that the prediction gives move this way, whatever it calls it; their scale may differ.",
}
OTHER_RULE = "The prediction may say A or B, a set's number, or name the item. A tie is also met by an answer that sees hardly a difference."
#: What a judge is told where a question has items.
SET_NOTE = "Set 1 of the evidence is A, the item mentioned first, Set 2 is B."


def judge_question(judge_info: Column, expected: Column, blocks: Column | None = None) -> Column:
    """What an answer is held against: the truth by the judge's type and what to accept; for other types the items' letters and the record."""
    j = F.coalesce(_entries(judge_info), _entries(F.lit("{}")))
    bound = lambda k, by: F.coalesce(F.round(F.element_at(j, k).try_cast("double") + by, 1).cast("string"), F.lit("?"))
    known = F.map_concat(j, F.create_map(F.lit("from"), bound("t0", -JUDGE_TOLERANCE), F.lit("to"), bound("t1", JUDGE_TOLERANCE)))
    letters = F.lit("") if blocks is None else label_line(blocks)
    items = F.when(letters != "", F.concat(letters, F.lit(f"\n{SET_NOTE}\n"))).otherwise("")
    letter = F.when(F.lower(F.trim(expected)).isin("a", "b"), F.upper(F.trim(expected))).otherwise(expected)
    out = F.concat(items, F.lit("Expected: "), letter, F.lit("\nRecord: "), F.coalesce(judge_info, F.lit("{}")), F.lit(f"\n{OTHER_RULE}"))
    for kind, lines in ASKED.items():
        out = F.when(F.element_at(j, "type") == kind, F.concat(F.lit("Expected: "), expected, F.lit("\n"), _filled(lines, known), F.lit(f"\n{RULES[kind]}"))).otherwise(out)
    return out


def judge_table(predictions: DataFrame, queries: DataFrame, audio: Column) -> DataFrame:
    """(query_id, kind, expected, prompt): what a judge is asked, two or three prompts for each prediction; answers only where one is expected, faithful not for ``audio`` variants.

    Queries: query, expected, summary, and query_type, judge_info (JSON) and blocks where there are any.  A prediction without a
    query is judged by its own fields, where it has them.
    """
    own = [c for c in ("expected", "summary", "block") if c in predictions.columns]
    more = [c for c in ("query_type", "judge_info", "blocks") if c in queries.columns]
    q = queries.select("query_id", *[F.col(c).alias(f"_{c}") for c in ("query", "expected", "summary", *more)])
    joined = predictions.join(grows(q), "query_id", "left").withColumn("_e", F.coalesce("_expected", *[c for c in own if c == "expected"])).withColumn("_s", F.coalesce("_summary", *[c for c in own if c == "summary"], F.lit("")))
    kind = F.coalesce(F.concat(F.lit(" ("), F.col("_query_type"), F.lit(")")), F.lit("")) if "query_type" in more else F.lit("")
    said = lambda ask, truth: F.concat(F.lit(f"{ask}\nQuestion"), kind, F.lit(": "), F.coalesce("_query", F.lit("")), F.lit("\n"), truth, F.lit("\nPrediction: "), F.coalesce("prediction", F.lit("")), F.lit("\nRationale: "), F.coalesce("rationale", F.lit("")), F.lit("\nReply YES or NO."))
    block = F.coalesce("block", F.lit("none")) if "block" in own else F.lit("none")
    info = F.col("_judge_info") if "judge_info" in more else F.lit(None).cast("string")
    answer = judge_question(info, F.col("_e"), F.col("_blocks") if "blocks" in more else None)
    kinds = F.array(
        F.when(F.col("_e").isNotNull(), F.struct(F.lit("answer").alias("kind"), said("Does the prediction give the expected answer?", answer).alias("prompt"))),
        F.struct(F.lit("factual").alias("kind"), said("Are the claims of the rationale in line with the truth?", F.concat(F.lit("Expected: "), F.col("_s"))).alias("prompt")),
        F.when(~audio, F.struct(F.lit("faithful").alias("kind"), said("Does the rationale follow from the evidence?", F.concat(F.lit("Expected: "), block)).alias("prompt"))),
    )
    return joined.select("query_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("x")).select("query_id", "x.*")


def judged_scores(replies: DataFrame) -> DataFrame:
    """(query_id, answer, factual, faithful, rationale) of a judge's replies (query_id, kind, reply): an answer nobody expected counts 0, faithfulness nobody asked for 1."""
    of = lambda kind, other: F.coalesce(F.max(F.when(F.col("kind") == kind, text.verdict(F.col("reply")))), F.lit(other))
    scores = replies.groupBy("query_id").agg(of("answer", 0).alias("answer"), of("factual", 0).alias("factual"), of("faithful", 1).alias("faithful"))
    return scores.withColumn("rationale", F.col("factual") * F.col("faithful"))


def score_all(judged: DataFrame, retrieval: DataFrame, plans: DataFrame) -> DataFrame:
    """All scores of each judged prediction in one row; a query without evidence or plan has the hit rate 0."""
    out = judged.join(grows(retrieval.select("query_id", F.col("hit_rate").alias("retrieval_hit_rate"))), "query_id", "left").join(grows(plans.select("query_id", "plan_hit_rate")), "query_id", "left")
    return out.fillna(0.0, ["retrieval_hit_rate", "plan_hit_rate"])

