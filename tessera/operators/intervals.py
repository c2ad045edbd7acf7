"""Interval joins, coverage, and the shaping of turns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import overlap
from tessera.operators.scan import Line, Running
from tessera.session import discard, grows, stored

#: Fixed value: how much wider each next grid of an interval join is.
FINER = 4


def overlap_join(left: DataFrame, right: DataFrame, key: str, bucket: float | None = None, how: str = "inner") -> DataFrame:
    """Rows of ``left`` (start, end) and ``right`` (lo, hi) of one key that overlap, open at both ends.

    Without ``bucket`` this is an equi-join on the key with a range condition, right where a key has few rows.  With it rows meet
    only in shared cells, so a key with many rows spreads.  An interval lies in one or two cells of a grid about as wide as itself,
    the finest of that width and each next one ``FINER`` times as wide.  Two intervals overlap only if one holds the other's start,
    which is looked up once in each grid that is in use; so rows grow with the rows, however long the intervals are.
    """
    meet = (F.col("end") > F.col("lo")) & (F.col("start") < F.col("hi"))
    right = right.withColumnRenamed(key, "_k")
    if bucket is None:
        return left.join(grows(right), (F.col(key) == F.col("_k")) & meet, how).drop("_k")
    later = _held(right, "_k", "lo", "hi", left, key, "start", bucket).where(meet & (F.col("start") > F.col("lo")))
    held = _held(left, key, "start", "end", right, "_k", "lo", bucket).where(meet & (F.col("start") <= F.col("lo")))
    return held.unionByName(later.select(*held.columns)).drop("_k")


def _held(spans: DataFrame, key: str, a: str, b: str, others: DataFrame, other_key: str, at: str, bucket: float) -> DataFrame:
    """Pairs of ``spans`` (a, b) and ``others`` whose ``at`` is in a cell of the span; each pair at most once."""
    width = lambda grid: bucket * F.pow(F.lit(float(FINER)), grid)
    grid = F.greatest(F.lit(0.0), F.ceil(F.log(float(FINER), F.greatest(F.col(b) - F.col(a), F.lit(bucket)) / bucket))).cast("int")
    known = spans.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    used = known.agg(F.collect_set(grid).alias("_grids"))  # one row
    cell = lambda c, g: F.floor(F.col(c) / width(F.col(g)))
    s = known.withColumn("_grid", grid).withColumn("_cell", F.explode(F.sequence(cell(a, "_grid"), F.greatest(cell(a, "_grid"), cell(b, "_grid")))))
    o = others.where(F.col(at).isNotNull()).crossJoin(F.broadcast(used)).withColumn("_grid2", F.explode("_grids")).withColumn("_cell2", cell(at, "_grid2")).drop("_grids")
    return s.join(grows(o), (F.col(key) == F.col(other_key)) & (F.col("_grid") == F.col("_grid2")) & (F.col("_cell") == F.col("_cell2"))).drop("_grid", "_cell", "_grid2", "_cell2")


def coverage(truth: DataFrame, windows: DataFrame, key: str = "episode_id", bucket: float | None = None) -> DataFrame:
    """(key, covered): the share of a key's intervals that any window overlaps; 0 without windows.  Equal rows of ``truth`` count each.

    Different intervals are joined once and those that a window meets counted with their copies; no row is joined back.
    """
    copies = truth.groupBy(*truth.columns).agg(F.count(F.lit(1)).alias("_copies"))
    met = overlap_join(copies.where("start is not null and `end` is not null"), windows.select(key, "lo", "hi"), key, bucket)
    hit = met.groupBy(*truth.columns).agg(F.max("_copies").alias("_hit")).groupBy(key).agg(F.sum("_hit").alias("_hits"))
    every = truth.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_all"))
    return every.join(grows(hit), F.col("_key").eqNullSafe(F.col(key)), "left").select(F.col("_key").alias(key), (F.coalesce("_hits", F.lit(0)) / F.col("_all")).alias("covered"))


def _starts(points: DataFrame, segments: DataFrame, key: str, order: str) -> DataFrame:
    """Points and segments of a key on one line: ``_pt`` the point, ``_left`` and ``_right`` the segments that start last until its ``t`` and
    first after it (of equal starts the least by ``order``), ``_first`` the earliest that ends at ``t`` or later, if one does.

    Scans instead of joining, so a key with m points and n segments costs m + n rows, not m * n, and spreads over partitions.  Segments of
    keys without a point are left out before they are ordered.  What comes after a point is known to the segment before it, which
    tells its next start and whose end the next lead waits for; so the points' line is only scanned forwards.
    """
    asked = points.select(F.col(key).alias("_asked")).distinct()
    known = segments.where(f"{key} is not null and start is not null").join(grows(asked), F.col(key) == F.col("_asked"), "left_semi")
    by_start = Line(known.withColumn("_s", F.struct(*[c for c in segments.columns if c != key])), [key], ["start", F.col(order).asc_nulls_last()])
    until = by_start.scan(_until=Running("max", F.col("end"), before=True), _before=Running("last", F.col("start"), before=True))
    opens = F.col("_before").isNull() | (F.col("start") != F.col("_before"))
    s = until.scan(_next=Running("last", F.when(opens, F.col("_s")), before=True, back=True)).done()
    none = F.lit(None).cast(s.schema["_s"].dataType)
    mark = lambda t, k, left, right, end: F.struct(t.cast("double").alias("_t"), F.lit(k).alias("_kind"), left.alias("_l"), right.alias("_r"), end.alias("_end"))
    early = F.when(F.col("_before").isNull(), mark(F.lit(None), 0, none, F.col("_s"), none))
    lead = F.when(F.col("end").isNotNull() & (F.col("_until").isNull() | (F.col("end") > F.col("_until"))), mark(F.col("_until"), 2, none, none, F.col("_s")))
    marks = s.select(key, F.explode(F.array_compact(F.array(early, F.when(opens, mark(F.col("start"), 0, F.col("_s"), F.col("_next"), none)), lead))).alias("_m"))
    p = points.select(key, F.struct(*[c for c in points.columns if c != key]).alias("_pt"), F.col("t").cast("double").alias("_t"))
    start = F.when(F.col("_m._kind") == 0, F.struct(F.col("_m._l").alias("_l"), F.col("_m._r").alias("_r"))).alias("_start")
    marks = stored(marks.select(key, "_m._t", "_m._kind", start, "_m._end", F.lit(None).cast(p.schema["_pt"].dataType).alias("_pt")), "marks")
    by_start.clear()
    line = marks.unionByName(p.where(f"{key} is not null").select(key, "_t", F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_start"].dataType).alias("_start"), none.alias("_end"), "_pt"))
    seen = Line(line, [key], ["_t", "_kind"]).scan(_near=Running("last", F.col("_start")), _first=Running("last", F.col("_end")))
    discard(marks)
    return seen.done().where("_kind = 1").select(key, "_pt", F.col("_near._l").alias("_left"), F.col("_near._r").alias("_right"), "_first")


def _closer() -> Column:
    left, right, t = F.col("_left"), F.col("_right"), F.col("_pt.t")
    return F.when(left.isNull() | (F.abs(right["start"] - t) < F.abs(left["start"] - t)), F.coalesce(right, left)).otherwise(left)


def nearest(points: DataFrame, segments: DataFrame, key: str = "episode_id", order: str = "seg_id") -> DataFrame:
    """The segment that holds each point's ``t`` (the earliest such), else the one whose start is nearest; ties by start and ``order``."""
    first = F.when(F.col("_pt.t").between(F.col("_first.start"), F.col("_first.end")), F.col("_first"))
    found = _starts(points, segments, key, order).withColumn("_s", F.coalesce(first, _closer())).where("_s is not null")
    return found.select(*[F.col(c) if c == key else F.col(f"_pt.{c}") for c in points.columns], *[F.col(f"_s.{c}") for c in segments.columns if c != key])


def nearest_within(points: DataFrame, segments: DataFrame, tolerance: float = 1.0, key: str = "episode_id", order: str = "seg_id") -> DataFrame:
    """The segment that starts nearest to the point, within ``tolerance`` or else anywhere; ties by start and ``order``."""
    found = _starts(points, segments, key, order).withColumn("_s", _closer()).where("_s is not null")
    return found.select(*[F.col(c) if c == key else F.col(f"_pt.{c}") for c in points.columns], *[F.col(f"_s.{c}") for c in segments.columns if c != key])


def arg_max_overlap(left: DataFrame, right: DataFrame, key: str, left_id: str, right_order: str, bucket: float | None = None) -> DataFrame:
    """For each row of ``left``, the row of ``right`` (lo, hi) that it overlaps most (over 0), the first of equals."""
    joined = overlap_join(left, right, key, bucket).withColumn("overlap", overlap(F.col("start"), F.col("end"), F.col("lo"), F.col("hi")))
    rank = F.row_number().over(Window.partitionBy(left_id).orderBy(F.col("overlap").desc(), right_order))
    return joined.where("overlap > 0").withColumn("_r", rank).where("_r = 1").drop("_r")


def split_long(turns: DataFrame, most: float) -> DataFrame:
    """Turns cut into ceil(length / most) equal parts."""
    n = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / F.lit(most)))
    step = (F.col("end") - F.col("start")) / n
    cut = turns.withColumn("_n", n).withColumn("_step", step).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return cut.withColumn("_s", F.col("start") + F.col("_i") * F.col("_step")).withColumn("end", F.col("start") + (F.col("_i") + 1) * F.col("_step")).withColumn("start", F.col("_s")).drop("_n", "_step", "_i", "_s")


def merge_short(turns: DataFrame, least: float, key: str = "episode_id") -> DataFrame:
    """Turns under ``least`` fold into the one before and give it their end; for turns that don't overlap.

    Each long turn opens an island, and so does the first turn, long or not.  If that first island as a whole is still too
    short, the next one begins where it began; what is too short after that is dropped.  An island has its first turn's
    speaker.
    """
    w = Window.partitionBy(key).orderBy("start", "end")
    opens = (F.col("end") - F.col("start") >= least) | (F.row_number().over(w) == 1)
    numbered = turns.withColumn("_o", opens.cast("int")).withColumn("_n", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(key, "_n").agg(F.min("start").alias("start"), F.max(F.struct("start", "end"))["end"].alias("end"), F.min_by("speaker", F.struct("start", "end")).alias("speaker"))
    islands = Window.partitionBy(key).orderBy("_n")
    early = F.lag("start").over(islands)
    gives = (F.col("_n") == 2) & (F.lag("end").over(islands) - early < least)
    return merged.withColumn("_s", F.when(gives, early).otherwise(F.col("start"))).select(key, F.col("_s").alias("start"), "end", "speaker").where(F.col("end") - F.col("start") >= least)


def merge_short_folded(turns: DataFrame, least: float, key: str = "episode_id") -> DataFrame:
    """The same for turns that may overlap, where an end that is handed on can make a turn short again: repeated until
    nothing changes, an ordered fold of each key's turns, which must fit one task."""
    kinds = dict(turns.dtypes)

    def settle(rows: list[dict]) -> list[dict]:
        short = lambda t: t["end"] - t["start"] < least
        while True:
            kept: list[dict] = []
            for turn in rows:
                if kept and short(turn):
                    kept[-1] = kept[-1] | {"end": turn["end"]}
                else:
                    kept.append(turn)
            if len(kept) > 1 and short(kept[0]):
                kept[:2] = [kept[1] | {"start": kept[0]["start"]}]
            if len(kept) == len(rows):
                return [t for t in kept if not short(t)]
            rows = kept

    def fold(rows: pa.Table) -> pa.Table:
        left = settle(sorted(rows.select(["start", "end", "speaker"]).to_pylist(), key=lambda t: (t["start"], t["end"])))
        same = rows.column(key).combine_chunks().take(pa.array([0] * len(left), pa.int64()))
        return pa.table({key: same, **{c: pa.array([t[c] for t in left], rows.schema.field(c).type) for c in ("start", "end", "speaker")}})

    return turns.groupBy(key).applyInArrow(fold, f"{key} {kinds[key]}, start double, `end` double, speaker {kinds['speaker']}")


def merge_gaps(regions: DataFrame, gap: float, key: str = "episode_id") -> DataFrame:
    """Regions joined where the gap to all that came before is under ``gap``."""
    line = Line(regions, [key], ["start", "end"]).scan(_reach=Running("max", F.col("end"), before=True))
    new = F.coalesce((F.col("start") - F.col("_reach") >= gap).cast("int"), F.lit(1))
    return line.scan(_n=Running("sum", new)).done().groupBy(key, "_n").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("parts")).drop("_n")


def timeline(items: DataFrame, duration: Column, key: str, order: list, crossfade: float = 0.0) -> DataFrame:
    """Start of each item where each follows the last, ``crossfade`` before its end."""
    line = Line(items, [key], order).scan(_n=Running("sum", F.lit(1)), _before=Running("sum", duration, before=True))
    before = F.coalesce("_before", F.lit(0))
    return line.done().withColumn("position", F.col("_n").cast("int")).withColumn("start", before - crossfade * (F.col("position") - 1)).withColumn("end", F.col("start") + duration).drop("_n", "_before")


def tumbling(spans: DataFrame, width: float) -> DataFrame:
    """Windows of ``width`` over (start, end), anchored at the start; the last one is cut off."""
    n = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / F.lit(width)))
    cut = spans.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return cut.withColumn("lo", F.col("start") + F.col("_i") * width).withColumn("hi", F.least(F.col("end"), F.col("start") + (F.col("_i") + 1) * width)).drop("_i")


def sliding(spans: DataFrame, width: float, step: float) -> DataFrame:
    """Windows of ``width`` every ``step`` that lie within (start, end), anchored at the start."""
    n = F.floor((F.col("end") - F.col("start") - F.lit(width)) / F.lit(step))
    some = spans.where(F.col("end") - F.col("start") >= width)
    return some.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), n))).withColumn("lo", F.col("start") + F.col("_i") * step).withColumn("hi", F.col("start") + F.col("_i") * step + width).drop("_i")
