"""Mining of candidate events from traces and segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import overlap, rounded
from tessera.operators.intervals import overlap_join, sliding
from tessera.operators.ordering import in_order
from tessera.operators.scan import Line, Running
from tessera.session import discard, grows, stored


def dominant_speaker(windows: DataFrame, segments: DataFrame, threshold: float, key: str = "episode_id") -> DataFrame:
    """(window_id, speaker, share): who covers most of each window, if by ``threshold`` of what is covered."""
    pieces = overlap_join(segments.select(key, "start", "end", "speaker"), windows.select(key, "window_id", "lo", "hi"), key)
    by = pieces.groupBy("window_id", "speaker").agg(F.sum(overlap(F.col("start"), F.col("end"), F.col("lo"), F.col("hi"))).alias("covered"))
    share = F.col("covered") / F.sum("covered").over(Window.partitionBy("window_id"))
    ranked = by.withColumn("share", share).withColumn("_r", F.row_number().over(Window.partitionBy("window_id").orderBy(F.round("covered", 6).desc(), "speaker")))
    return ranked.where((F.col("_r") == 1) & (F.round("share", 9) >= threshold)).select("window_id", "speaker", "share")


def trend_windows(trace: DataFrame, width: float = 30.0, step: float = 10.0, keys: tuple[str, ...] = ("episode_id",), order: list[str] | None = None) -> DataFrame:
    """Sliding windows over a trace (keys, t, value): means of both halves and their difference; a window needs values in both.

    Each point goes to the windows that hold it, width / step or one more, so rows grow with the points.  Values are added up in
    ``order``, columns of the trace; without one, means and difference have nine digits: the order in which Spark adds values up
    decides no threshold and no tie.
    """
    k = list(keys)
    span = trace.groupBy(*k).agg(F.min("t").alias("_a"), F.max("t").alias("_z")).where(F.col("_z") - F.col("_a") >= width)
    last = F.floor((F.col("_z") - F.col("_a") - width) / F.lit(step))
    low = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("t") - F.col("_a") - width) / F.lit(step)) - 1)
    high = F.least(last, F.floor((F.col("t") - F.col("_a")) / F.lit(step)) + 1)
    held = trace.join(span, k).where(low <= high).withColumn("_i", F.explode(F.sequence(low, high))).withColumn("lo", F.col("_a") + F.col("_i") * step).withColumn("hi", F.col("_a") + F.col("_i") * step + width)
    points = held.where((F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi")))
    half = F.col("t") < F.col("lo") + width / 2
    if order:
        means = in_order(points, [*k, "lo", "hi"], order, half1=F.avg(F.when(half, F.col("value"))), half2=F.avg(F.when(~half, F.col("value"))))
        return means.where("half1 is not null and half2 is not null").withColumn("delta", F.col("half2") - F.col("half1"))
    means = points.groupBy(*k, "lo", "hi").agg(F.round(F.avg(F.when(half, F.col("value"))), 9).alias("half1"), F.round(F.avg(F.when(~half, F.col("value"))), 9).alias("half2"))
    return means.where("half1 is not null and half2 is not null").withColumn("delta", F.round(F.col("half2") - F.col("half1"), 9))


def spoken_trends(trends: DataFrame, segments: DataFrame, share: float = 0.7, key: str = "episode_id") -> DataFrame:
    """``trends`` (key, lo, hi) in which one speaker has ``share`` of what is spoken, with that speaker."""
    windows = trends.select(key, "lo", "hi").distinct().withColumn("window_id", F.concat_ws("/", F.col(key).cast("string"), F.col("lo").cast("string"), F.col("hi").cast("string")))
    found = dominant_speaker(windows, segments, share, key).select("window_id", "speaker")
    return trends.join(grows(windows.join(grows(found), "window_id").select(key, "lo", "hi", "speaker")), [key, "lo", "hi"])


def suppressed(candidates: DataFrame, keys: list[str], strength: Column, guard: float = 60.0) -> DataFrame:
    """Greedy suppression: strongest first, a candidate is kept if none kept before lies within ``guard`` of it; of equals the earlier.

    In rounds over the pairs that are too near each other, found in the cells of a grid: what no stronger candidate is near to is
    kept, what is near to a kept one goes, and the rest is judged anew.  A round settles every peak of the recordings at once; no
    list of a recording's candidates is made.  Rows with a null take no part.
    """
    rows = candidates.select(*keys, F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), (-strength).cast("double").alias("_s"))
    nodes = stored(rows.dropna().distinct().withColumn("_id", F.monotonically_increasing_id()), "candidates")
    widest = nodes.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0.0
    cell = F.floor(F.col("lo") / F.lit(max(widest + guard, 1e-9)))
    weak = nodes.select(*keys, "lo", "hi", F.struct("_s", "lo", "hi").alias("_place"), F.col("_id").alias("a"), cell.alias("_cell"))
    strong = nodes.select(*keys, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.struct("_s", "lo", "hi").alias("_than"), F.col("_id").alias("b"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    near = (F.col("lo") < F.col("_hi") + guard) & (F.col("hi") > F.col("_lo") - guard) & (F.col("_than") < F.col("_place"))
    pairs = stored(weak.join(grows(strong), [*keys, "_cell"]).where(near).select("a", "b"), "pairs")
    free, kept = nodes.select(F.col("_id").alias("a")).join(grows(pairs), "a", "left_anti"), []
    free = stored(free, "free")
    while True:
        kept.append(free)
        gone = pairs.join(grows(free.select(F.col("a").alias("b"))), "b").select("a").distinct()
        left = pairs.join(grows(gone), "a", "left_anti")
        rest = stored(left.join(grows(gone.select(F.col("a").alias("b"))), "b", "left_anti").select("a", "b"), "pairs")
        free = stored(left.select("a").distinct().join(grows(rest), "a", "left_anti"), "free")
        discard(pairs)
        pairs = rest
        if free.isEmpty():
            break
    out = nodes.join(grows(reduce(DataFrame.unionByName, kept).select(F.col("a").alias("_id"))), "_id")
    return out.select(*keys, "lo", "hi", (-F.col("_s")).alias("strength"))


def flat_window(windows: DataFrame, excluded: DataFrame, keys: list[str], guard: float = 60.0) -> DataFrame:
    """The window with the least difference of each key that stays ``guard`` away from all excluded ones; the first of equals."""
    ex = excluded.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    on = (F.col("lo") < F.col("_hi") + guard) & (F.col("hi") > F.col("_lo") - guard)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    free = windows.join(ex, on, "left_anti")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(rounded(F.abs("delta"), 9), "lo"))
    return free.withColumn("_r", rank).where("_r = 1").drop("_r")


def speaker_windows(segments: DataFrame, values: list[str], width: float = 60.0, step: float = 30.0, least: float = 10.0, spread: float = 0.1, key: str = "episode_id") -> DataFrame:
    """Windows with two speakers or more of over ``least`` seconds whose means differ by over ``spread`` in the best dimension; with ``spk_val``, each speaker's mean there."""
    span = segments.groupBy(key).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    windows = sliding(span, width, step).select(key, "lo", "hi")
    pieces = overlap_join(segments, windows, key)
    by = pieces.groupBy(key, "lo", "hi", "speaker").agg(F.sum(overlap(F.col("start"), F.col("end"), F.col("lo"), F.col("hi"))).alias("covered"), *[F.avg(v).alias(v) for v in values]).where(F.col("covered") > least)
    spoken = [F.map_from_entries(F.collect_list(F.struct("speaker", F.round(v, 3).alias("v")))).alias(f"_of_{v}") for v in values]
    diffs = by.groupBy(key, "lo", "hi").agg(F.count(F.lit(1)).alias("speakers"), *[(F.max(v) - F.min(v)).alias(v) for v in values], *spoken).where("speakers >= 2")
    best = F.array_max(F.array(*[F.struct(F.round(v, 6).alias("diff"), F.lit(-k).alias("k"), F.lit(v).alias("dim")) for k, v in enumerate(values)]))
    of = F.coalesce(*[F.when(F.col("_b.dim") == v, F.col(f"_of_{v}")) for v in values])
    return diffs.withColumn("_b", best).where(F.col("_b.diff") > spread).select(key, "lo", "hi", "speakers", F.col("_b.dim").alias("dim"), F.col("_b.diff").alias("diff"), of.alias("spk_val"))


def clusters(events: DataFrame, group: list[str], least: int = 3, within: int = 300, pad: float = 30.0) -> DataFrame:
    """The first run of ``least`` events or more of a group within ``within`` seconds of its first, padded on both sides.

    Events that start a run are those with ``least`` starts in the range ahead; a frame by range finds them without a join.
    """
    ahead = Window.partitionBy(*group).orderBy("t").rangeBetween(0, int(within))
    counted = events.select(*group, "start", "end", F.col("start").alias("t")).withColumn("n", F.count(F.lit(1)).over(ahead)).withColumn("last", F.max("end").over(ahead))
    first = F.row_number().over(Window.partitionBy(*group).orderBy("start", "end"))
    return counted.where(F.col("n") >= least).withColumn("_r", first).where("_r = 1").select(*group, F.greatest(F.lit(0.0), F.col("start") - pad).alias("lo"), (F.col("last") + pad).alias("hi"), "n")


def neighbour_bounds(events: DataFrame, group: list[str], sources: DataFrame | None = None) -> DataFrame:
    """For each event the latest end before its start, and the earliest start from its end on, of ``sources`` (the events themselves) in its group.

    Ends and starts stand on one line with the places that ask for them, so a group of any size spreads.
    """
    of = events if sources is None else sources
    none = F.lit(None).cast("double")
    told = lambda df, x, kind, v: df.select(*group, F.col(x).cast("double").alias("x"), F.lit(kind).alias("kind"), v.alias("v"))
    left = told(of, "end", 0, F.col("end").cast("double")).unionByName(told(events, "start", 1, none).distinct())
    prev = Line(left, group, ["x", "kind"]).scan(prev_end=Running("max", F.col("v"))).done().where("kind = 1").select(*group, F.col("x").alias("_s"), "prev_end")
    right = told(of, "start", 1, F.col("start").cast("double")).unionByName(told(events, "end", 0, none).distinct())
    next_ = Line(right, group, ["x", "kind"]).scan(next_start=Running("min", F.col("v"), back=True)).done().where("kind = 0").select(*group, F.col("x").alias("_e"), "next_start")
    on = lambda a, d, x: [F.col(f"a.{g}") == F.col(f"{d}.{g}") for g in group] + [F.col(a) == F.col(x)]
    joined = events.alias("a").join(grows(prev.alias("p")), on("a.start", "p", "p._s"), "left").select("a.*", "prev_end").alias("a")
    return joined.join(grows(next_.alias("n")), on("a.end", "n", "n._e"), "left").select("a.*", "next_start")


def longest_runs(rows: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """(key, longest, share): the longest run of true flags in the rows' order, and the share of true ones; a run has one number of false flags before it."""
    flagged = rows.withColumn("_f", F.coalesce(flag, F.lit(False)))
    marked = Line(flagged.select(key, *order, "_f"), [key], order).scan(_i=Running("sum", (~F.col("_f")).cast("long"))).done()
    islands = marked.groupBy(key, "_i").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_f").cast("long")).alias("_true"))
    return islands.groupBy(key).agg(F.max("_true").alias("longest"), (F.sum("_true") / F.sum("_n")).alias("share"))


def most_shared(left: DataFrame, right: DataFrame, key: str = "episode_id") -> tuple[DataFrame, DataFrame]:
    """(key, n, idx, shared): the row of ``right`` (key, idx, text) with which each of ``left`` (key, n, text) shares most different words, whatever the
    case, the least ``idx`` of equals; and (key, round, met), how many rows met by a word in each round.

    Words are ordered by how few rows of the key have them.  To share c words, two rows must share one of the rarest ``size - c + 1`` of
    both.  So rows meet by their rarest half at first, and only those whose best turns out to share less go on with a smaller
    c; common words join nothing until hardly anything is shared.  How early the first common word stands bounds what two rows can
    share, and pairs over the bound are counted on their words.
    """
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    told = right.select(key, "idx", F.explode(split(F.col("text"))).alias("w")).where(F.col(key).isNotNull())
    often = told.groupBy(key, "w").agg(F.count(F.lit(1)).alias("often"))
    ordered = lambda rows, name: rows.join(often, [key, "w"]).groupBy(key, name).agg(F.array_sort(F.collect_list(F.struct("often", "w"))).alias("words")).select(key, name, F.transform("words", lambda x: x["w"]).alias(f"{name}_words"), F.size("words").alias(f"{name}_size"))
    ours = stored(ordered(left.select(key, "n", F.explode(split(F.col("text"))).alias("w")), "n"), "left-words")
    theirs = stored(ordered(told, "idx"), "right-words")
    postings = theirs.select(key, "idx", "idx_size", F.posexplode("idx_words").alias("their_place", "w"))
    open_, found, met, part = ours, [], [], 2
    while True:
        least = F.greatest(F.lit(1), F.ceil(F.col("n_size") / part)).cast("int")
        early = open_.withColumn("least", least).select(key, "n", "n_size", "least", F.posexplode(F.expr("slice(n_words, 1, n_size - least + 1)")).alias("our_place", "w"))
        pairs = early.join(postings, [key, "w"]).where("idx_size >= least and their_place <= idx_size - least")
        first = pairs.groupBy(key, "n", "idx").agg(F.min("our_place").alias("a"), F.min("their_place").alias("b"), F.first("n_size").alias("s"), F.first("idx_size").alias("t"), F.first("least").alias("least"), F.count(F.lit(1)).alias("met"))
        first = stored(first, "met")
        likely = first.where(F.least(F.col("s") - F.col("a"), F.col("t") - F.col("b")) >= F.col("least"))
        counted = likely.join(open_.select(key, "n", "n_words"), [key, "n"]).join(theirs.select(key, "idx", "idx_words"), [key, "idx"]).select(key, "n", "least", "idx", F.size(F.array_intersect("n_words", "idx_words")).alias("shared"))
        best = counted.where(F.col("shared") >= F.col("least")).groupBy(key, "n").agg(F.max(F.struct("shared", (-F.col("idx")).alias("i"))).alias("m"))
        best = stored(best.select(key, "n", (-F.col("m.i")).alias("idx"), F.col("m.shared").alias("shared")), "best")
        found.append(best)
        met.append(first.groupBy(key).agg(F.sum("met").alias("met")).select(key, F.lit(len(met) + 1).alias("round"), "met"))
        last, open_ = open_, stored(open_.where(F.col("n_size") > part).join(best, [key, "n"], "left_anti"), "open")
        if last is not ours:
            discard(last)
        part *= 2
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, met)


def matched_times(transcripts: DataFrame, segments: DataFrame, key: str = "episode_id") -> DataFrame:
    """Times of transcripts (key, n, text, t0, t1; times may be null) from the recording's segments (key, idx, start, end, text).

    A transcript without times gets those of the segment with which it shares most different words, the first of equals,
    but of no segment before that of the transcript before it; one with times stands at the segment that starts nearest and
    those after it go on from there.  Without a shared word there are no times, and it doesn't count for later ones.
    """
    from tessera.operators.intervals import nearest_within

    best = most_shared(transcripts.where("t0 is null"), segments, key)[0].select(key, "n", F.col("idx").alias("_best"))
    fixed = nearest_within(transcripts.where("t0 is not null").select(key, "n", F.col("t0").alias("t")), segments.select(key, "idx", "start", "end"), 0.0, key, "idx").select(key, "n", F.col("idx").alias("_best"))
    rows = transcripts.join(best.unionByName(fixed), [key, "n"], "left")
    order = Window.partitionBy(key).orderBy("n")
    placed = rows.withColumn("_from", F.sum(F.col("t0").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    running = Window.partitionBy(key, "_from").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    at = placed.withColumn("_at", F.when(F.col("_best").isNotNull(), F.max("_best").over(running)))
    s = segments.select(F.col(key).alias("_k"), F.col("idx").alias("_x"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    joined = at.join(s, (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_x")), "left")
    return joined.select(key, "n", F.coalesce("t0", "_s").alias("t0"), F.coalesce("t1", "_e").alias("t1")).where("t0 is not null")


def halves(trace: DataFrame, keys: list[str], order: list[str], value: str = "value", band: float = 0.05) -> DataFrame:
    """Mean, least, greatest and trend (second half against first, in row order) of each key's values."""
    w = Window.partitionBy(*keys)
    marked = trace.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("_all", F.count(F.lit(1)).over(w))
    first = F.col("_n") <= F.floor(F.col("_all") / 2)
    out = marked.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(F.when(first, F.col(value))).alias("h1"), F.avg(F.when(~first, F.col(value))).alias("h2"))
    delta = F.col("h2") - F.col("h1")
    return out.withColumn("trend", F.when(delta > band, "rising").when(delta < -band, "falling").otherwise("stable")).drop("h1", "h2")


def frames_to_seconds(frames: DataFrame, key: str, rate: float, values: list[str], padded: bool = False) -> DataFrame:
    """Frames (key, frame, values) to means of whole seconds; a second without frames has none.

    With ``padded`` a second counts ``rate`` frames whatever it has: what is missing is 0, as at a recording's end.
    """
    mean = (lambda v: F.sum(v) / F.lit(rate)) if padded else F.avg
    return frames.groupBy(key, F.floor(F.col("frame") / F.lit(rate)).alias("second")).agg(*[mean(v).alias(v) for v in values])


def series_stats(frames: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """(key, and of each value a struct mean, std, start, end): mean, population deviation, first and last value of a series, clamped to 0 and 1."""
    held = lambda v: F.least(F.greatest(F.col(v).cast("double"), F.lit(0.0)), F.lit(1.0))
    stats = [F.struct(F.avg(held(v)).alias("mean"), F.stddev_pop(held(v)).alias("std"), F.min_by(held(v), order).alias("start"), F.max_by(held(v), order).alias("end")).alias(v) for v in values]
    return frames.groupBy(key).agg(*stats)
