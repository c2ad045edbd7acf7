"""Arithmetic, array and map functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    return F.least(end, hi) - F.greatest(start, lo)


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Open intervals: touching ends don't match."""
    return (end > lo) & (start < hi)


def normalised(v: Column) -> Column:
    """A vector of doubles at length 1; a null vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def aligned_middle(start: Column, end: Column, grid: int = 30) -> Column:
    """The middle one of the grid's stamps that have a full grid step inside the interval on both sides."""
    lo, hi = (F.ceil((start + grid) / F.lit(float(grid))) * grid).cast("long"), (F.floor((end - grid) / F.lit(float(grid))) * grid).cast("long")
    stamps = F.when(lo <= hi, F.sequence(lo, hi, F.lit(grid).cast("long")))
    return F.get(stamps, F.floor(F.size(stamps) / 2).cast("int"))


def clip_start(start: Column, end: Column, length: float = 5.0, margin: float = 5.0) -> Column:
    """Start of a clip in the middle of an interval, at least ``margin`` behind its start."""
    return F.greatest(start + margin, (start + end) / 2 - length / 2)


def winner(a: Column, b: Column, tie: float = 0.0) -> Column:
    return F.when(F.abs(a - b) <= tie, "tie").when(a > b, "a").otherwise("b")


def tier(x: Column) -> Column:
    return F.when(x >= 3.5, "High").when(x >= 2.5, "Mid").otherwise("Low")


def quality_word(x: Column) -> Column:
    return F.when(x < 2, "poor").when(x < 3, "fair").when(x < 4, "good").otherwise("excellent")


def longest_run(flags: Column) -> Column:
    """Length of the longest run of true values."""
    step = lambda s, f: F.struct(F.when(f, s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["best"], F.when(f, s["now"] + 1).otherwise(0)).alias("best"))
    return F.aggregate(flags, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), step, lambda s: s["best"])


def arg_max(scores: Column) -> Column:
    """The key of a map's greatest value; of equal ones the least key."""
    ranked = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.get(ranked, F.lit(0))["k"]


def without_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull())


def merged_labels(first: Column, second: Column) -> Column:
    """Two maps of labels; values of the second that aren't null override."""
    keep = F.map_filter(first, lambda k, v: ~F.coalesce(F.map_contains_key(without_nulls(second), k), F.lit(False)))
    return F.map_concat(keep, without_nulls(second))


def softmax(v: Column) -> Column:
    most = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - most))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def one_digit(x: Column) -> Column:
    """A number with one digit behind the point, rounded by its exact value, ties to even; Spark's %.1f rounds the shortest decimal, half up.

    Differences of near numbers have no error, so the last step tells on which side of the middle a number lies.
    """
    size = F.abs(x.cast("double"))
    low = F.floor(size * 10).cast("double")
    middle = low + 0.5
    side = (size * 8 - middle) + size * 2
    whole = low + F.when((side > 0) | ((side == 0) & (low % 2 == 1)), 1).otherwise(0)
    exact = F.concat(F.when(x < 0, "-").otherwise(""), F.format_string("%.1f", whole / 10))
    return F.when(size < 1e14, exact).otherwise(F.format_string("%.1f", x.cast("double")))


def rounded(x: Column, digits: int) -> Column:
    """Rounded by its product with a power of ten, as the SQL of the queries does; Spark's ``round`` takes the shortest decimal."""
    power = F.lit(float(10**digits))
    return F.round(x * power) / power
