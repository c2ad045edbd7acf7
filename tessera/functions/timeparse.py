"""Time expressions to windows of seconds, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF, WHOLE = 30, (0, 10_000)
#: The grammar of time expressions.
FULL = r"(?i)full\s*(track|recording)|whole\s*track|entire\s*track|all\s+sections?"
SONG = r"(?i)(\d+)(?:st|nd|rd|th)?\s*song"
COMPOUND = r"(?i)(\d+(?:\.\d+)?)\s*min(?:utes?)?\s+(\d+(?:\.\d+)?)\s*sec(?:onds?)?"
CLOCK = r"(\d+):(\d{2})"
RANGE = r"(?i)(\d+(?:\.\d+)?)\s*(min(?:utes?)?|sec(?:onds?)?)?\s+to\s+(\d+(?:\.\d+)?)\s*(min(?:utes?)?|sec(?:onds?)?)"
POINT = r"(?i)(?:around|at|~)?\s*(\d+(?:\.\d+)?)\s*(min(?:utes?)?|sec(?:onds?)?)"


def _window(lo, hi) -> Column:
    number = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    return F.struct(number(lo).alias("lo"), number(hi).alias("hi"))


def _around(t: Column) -> Column:
    return _window(F.greatest(F.lit(0).cast("long"), t - HALF), t + HALF)


def _pairs(text: Column, pattern: str) -> Column:
    """Seconds of each ``a`` minutes ``b`` seconds match, in order."""
    minutes, seconds = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2))
    return F.zip_with(minutes, seconds, lambda a, b: (a.cast("double") * 60 + b.cast("double")).cast("long"))


def _times_or_point(times: Column) -> Column:
    a, b = F.element_at(times, 1), F.element_at(times, 2)
    return F.when(F.size(times) >= 2, _window(F.least(a, b), F.greatest(a, b))).otherwise(_around(a))


def _scaled(number: Column, unit: Column) -> Column:
    return number.cast("double") * F.when(F.lower(F.substring(unit, 1, 1)) == "m", 60.0).otherwise(1.0)


def facts(text: Column) -> Column:
    """What the grammar's patterns find in a text: a struct that ``decided`` reads, so no pattern runs twice."""
    of = lambda pattern, *groups: F.struct(*[F.regexp_extract(text, pattern, g).alias(f"g{g}") for g in groups])
    return F.struct(text.rlike(FULL).alias("full"), text.rlike(SONG).alias("song"), _pairs(text, COMPOUND).alias("compound"), _pairs(text, CLOCK).alias("clock"), of(RANGE, 1, 2, 3, 4).alias("range"), of(POINT, 1, 2).alias("point"))


def decided(f: Column, song: Column | None = None) -> Column:
    """struct(lo, hi) in seconds from ``facts``, null where nothing matches."""
    left, right, left_unit, right_unit = f["range"]["g1"], f["range"]["g3"], f["range"]["g2"], f["range"]["g4"]
    found = F.when(f["full"], _window(*WHOLE))
    if song is not None:
        found = found.when(f["song"], _window(song["lo"], song["hi"]))
    found = (
        found.when(F.size(f["compound"]) > 0, _times_or_point(f["compound"]))
        .when(F.size(f["clock"]) > 0, _times_or_point(f["clock"]))
        .when(right != "", _window(_scaled(left, F.when(left_unit == "", right_unit).otherwise(left_unit)).cast("long"), _scaled(right, right_unit).cast("long")))
        .when(f["point"]["g1"] != "", _around(_scaled(f["point"]["g1"], f["point"]["g2"]).cast("long")))
    )
    return F.when(found["lo"].isNotNull(), found)


def localize(text: Column, song: Column | None = None) -> Column:
    """struct(lo, hi) in seconds, null where nothing matches.  ``song``: struct(lo, hi) of the song an ordinal names, null if unknown.

    The first rule that matches wins: whole recording, song ordinal (only with ``song``), minutes and seconds, clock times,
    range of one unit (not put in order), point.  Points get half a minute on each side, not before 0.
    """
    return decided(facts(text), song)


def localize_sets(plan_sets: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """``plan_sets`` (with episode_id and localize) with lo and hi; sets that don't parse are dropped.  ``segments`` resolve song ordinals."""
    text = F.col("localize")
    read = plan_sets.withColumn("_f", facts(text))
    if segments is None:
        return read.withColumn("_w", decided(F.col("_f"))).where("_w is not null").select(*plan_sets.columns, "_w.lo", "_w.hi")
    tagged = read.withColumn("_tag", F.when(F.col("_f.song"), F.format_string("SONG_%02d", F.regexp_extract(text, SONG, 1).cast("int"))))
    songs = segments.where(F.col("speaker").startswith("SONG_")).groupBy(F.col("episode_id").alias("_ep"), F.col("speaker").alias("_spk")).agg(F.min(F.struct("start", "end")).alias("_s"))
    joined = tagged.join(songs, (F.col("episode_id") == F.col("_ep")) & (F.col("_tag") == F.col("_spk")), "left")
    window = decided(F.col("_f"), F.struct(F.col("_s.start").cast("long").alias("lo"), F.col("_s.end").cast("long").alias("hi")))
    return joined.withColumn("_w", window).where("_w.lo is not null").select(*plan_sets.columns, "_w.lo", "_w.hi")
