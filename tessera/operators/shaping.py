"""Reshaping of queries, labels and clips: joins with defaults, ordered choices, numbering by letter, evaluation rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slack_overlaps(start: Column, end: Column, t: Column, slack: float = 1.0) -> Column:
    """A point within an interval widened by ``slack``, ends included."""
    return (end + slack >= t) & (start - slack <= t)


def with_choices(queries: DataFrame, choices: DataFrame, name: str = "choices") -> DataFrame:
    """Choices of (task, query_type), else of the task's type ``default``; a query's own choices stay."""
    c = choices.select(F.col("task").alias("_t"), F.col("query_type").alias("_q"), F.col("options").alias("_o"))
    exact = queries.join(c, (F.col("task") == F.col("_t")) & (F.col("query_type") == F.col("_q")), "left").drop("_t", "_q").withColumnRenamed("_o", "_exact")
    default = exact.join(c.where("_q = 'default'"), F.col("task") == F.col("_t"), "left").drop("_t", "_q")
    return default.withColumn(name, F.coalesce(F.col(name), F.col("_exact"), F.col("_o")) if name in queries.columns else F.coalesce("_exact", "_o")).drop("_exact", "_o")


def filled(template: Column, fields: dict[str, Column]) -> Column:
    """A text with {name} replaced by each field; a null field leaves its place empty."""
    for name, value in fields.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def lettered(df: DataFrame, by: list[str], order: str, name: str = "letter") -> DataFrame:
    """A, B, C, ... by the rank of ``order`` in each group, equal values alike."""
    return df.withColumn(name, F.char(F.dense_rank().over(Window.partitionBy(*by).orderBy(order)) + 64))


def first_source(keys: DataFrame, sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """Each key with the value of the first source that has it, and that source's number."""
    out = keys
    for k, s in enumerate(sources):
        out = out.join(s.select(F.col(key).alias(f"_k{k}"), F.col(value).alias(f"_v{k}")), F.col(key) == F.col(f"_k{k}"), "left").drop(f"_k{k}")
    which = F.lit(None).cast("int")
    for k in reversed(range(len(sources))):
        which = F.when(F.col(f"_v{k}").isNotNull(), F.lit(k)).otherwise(which)
    return out.select(*keys.columns, F.coalesce(*[F.col(f"_v{k}") for k in range(len(sources))]).alias(value), which.alias("source_no"))


def doubled(df: DataFrame, kinds: list[str], name: str = "query_type") -> DataFrame:
    """Each row once for each kind."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, kinds))))


def custom_order(df: DataFrame, column: str, order: list[str], name: str = "rank") -> DataFrame:
    """The place of a value in a given list, 99 if it isn't there."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column)).cast("int")
    return df.withColumn(name, F.when(place > 0, place - 1).otherwise(99))


def window_labels(windows: DataFrame, items: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Means over an item's windows, given to every row of the item."""
    means = windows.groupBy(by).agg(*[F.avg(v).alias(v) for v in values])
    return items.join(means, by, "left")


def annotator_frames(traces: DataFrame, keys: list[str], value: str = "mean") -> DataFrame:
    """Mean and sample deviation (0 for one annotator) of each frame, and how many annotated it."""
    return traces.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("n"))


def modal(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group, of equal ones the first seen."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_f"))
    return counted.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_n").desc(), "_f", value))).where("_r = 1").select(*by, value)


def change_points(windows: DataFrame, key: str, order: str, vector: str, threshold: float) -> DataFrame:
    """Segment numbers of ordered vectors: a new one begins where the cosine to the one before falls under ``threshold``.

    The one-pass form, without a group in one task; ``kernel_change_points`` finds the best segmentation.
    """
    from tessera.functions.numbers import dot, normalised

    w = Window.partitionBy(key).orderBy(order)
    unit = windows.withColumn("_u", normalised(F.col(vector)))
    like = dot(F.col("_u"), F.lag("_u").over(w))
    marked = unit.withColumn("_new", F.when(F.lag("_u").over(w).isNull() | (like < threshold), 1).otherwise(0))
    return marked.withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_u", "_new")


#: Rows of distances that are held at once.
ROWS = 256


def squared_distances(unit: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of unit vectors; what is nothing but the rounding of equal ones is 0."""
    apart = 2 - 2 * unit @ other.T
    return np.where(apart < 1e-12, 0.0, apart)


def middle_distance(unit: np.ndarray) -> float:
    """The median of the squared distances of all pairs of unit vectors, in memory for some rows: the two middle values by counting, digit by digit."""
    n = len(unit)
    pairs = n * (n - 1) // 2

    def parts():
        for at in range(0, n, ROWS):
            apart = squared_distances(unit[at : at + ROWS], unit)
            yield np.concatenate([apart[k, at + k + 1 :] for k in range(len(apart))])

    def ranked(place: int) -> float:
        """The value at a place of all distances in order: numbers of 0 or more are ordered as their bits."""
        prefix, left = 0, place
        for shift in (48, 32, 16, 0):
            counts = np.zeros(1 << 16, np.int64)
            for part in parts():
                bits = (part + 0.0).view(np.uint64)
                if shift < 48:
                    bits = bits[(bits >> np.uint64(shift + 16)) == np.uint64(prefix)]
                counts += np.bincount(((bits >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            sums = np.cumsum(counts)
            digit = int(np.searchsorted(sums, left, "right"))
            left -= int(sums[digit] - counts[digit])
            prefix = prefix << 16 | digit
        return float(np.array([prefix], np.uint64).view(np.float64)[0])

    high = ranked(pairs // 2)
    return high if pairs % 2 else (ranked(pairs // 2 - 1) + high) / 2


def segmented(vectors: np.ndarray, penalty: float, least: int = 1) -> list[int]:
    """Ends of the segments of at least ``least`` rows with the least total cost plus ``penalty`` for each change.

    A segment's cost is its rows' scatter in the feature space of a Gaussian kernel on unit vectors (width: the median of
    their squared distances): the number of rows less the mean of the kernel over all its pairs times that number.  Exact
    dynamic programming; of equal costs the earlier cut.  A start that can't be beaten back is dropped: if it and its segment
    up to some end cost more than the best up to there, then from ``least`` rows on a cut at that end is always better, since
    parting a segment never adds to its cost.  The kernel is made column by column, from the earliest start that is left;
    memory grows with the rows alone.
    """
    n = len(vectors)
    if n < 2 * least:
        return [n]
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    middle = middle_distance(unit)
    width = middle if middle > 0 else 1.0
    best, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    best[0] = -penalty
    starts, sums = np.zeros(0, np.int64), np.zeros(0)  # the starts that are left, and the kernel's sum over each one's rows
    until = np.full(n + 1, n + 1)  # a start serves for ends before this
    for end in range(1, n + 1):
        if np.isfinite(best[end - 1]):
            starts, sums = np.append(starts, end - 1), np.append(sums, 0.0)
        kept = until[starts] > end
        starts, sums = starts[kept], sums[kept]
        first = int(starts[0])
        row = np.exp(-np.clip(squared_distances(unit[first:end], unit[end - 1]) / width, 1e-2, 1e2))
        row[-1] = 1.0
        behind = np.cumsum(row[::-1])[::-1]  # with all rows from each place on
        sums = sums + 2 * behind[starts - first] - 1
        size = end - starts
        total = np.where(size >= least, best[starts] + size - sums / size + penalty, np.inf)
        if end < least or not np.isfinite(total).any():
            continue
        k = int(np.argmin(np.round(total, 9)))
        best[end], cut[end] = total[k], starts[k]
        beaten = starts[(size >= least) & (total - penalty > best[end] + 1e-7)]
        until[beaten] = np.minimum(until[beaten], end + least)
    ends = [n]
    while cut[ends[-1]]:
        ends.append(int(cut[ends[-1]]))
    return ends[::-1]


def kernel_change_points(windows: DataFrame, key: str, order: str, vector: str, penalty: float, least: int = 1) -> DataFrame:
    """(key, order, segment): segments from 1 of each key's vectors in order, by ``segmented``.  A key is a recording, whose windows fit a task."""
    kinds = dict(windows.dtypes)

    def number(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        ends = segmented(np.array(rows.column(vector).to_pylist(), np.float64), penalty, least)
        return pa.table({key: rows.column(key), order: rows.column(order), "segment": pa.array(np.searchsorted(ends, np.arange(rows.num_rows), "right") + 1, pa.int64())})

    return windows.select(key, order, vector).groupBy(key).applyInArrow(number, f"{key} {kinds[key]}, {order} {kinds[order]}, segment long")


def vector_scores(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of all vectors to each query by cosine.

    Queries are dealt by a hash to blocks of about ``MOST_QUERIES``, each sent to all for a pass over the vectors; a task
    multiplies ``TILE`` vectors at a time with the block and keeps its own best, so only queries x tasks x k rows are shuffled.
    """
    blocks = -(-queries.count() // MOST_QUERIES)
    schema = "query_id long, idx long, score double"

    def one(rows: list) -> DataFrame:
        matrix = np.array([r["query_vector"] for r in rows], np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
        sent = vectors.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in rows], np.int64), matrix))

        def best(batches):
            names, q = sent.value
            scores, at = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
            for batch in batches:
                for i in range(0, batch.num_rows, TILE):
                    part = batch.slice(i, TILE)
                    v = np.array(part.column("embedding").to_pylist(), np.float64)
                    s = np.round(q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).T, 6)
                    scores, at = np.hstack((scores, s)), np.hstack((at, np.broadcast_to(part.column("idx").to_numpy(), s.shape)))
                    order = np.lexsort((at, -scores), axis=1)[:, :k]
                    scores, at = np.take_along_axis(scores, order, 1), np.take_along_axis(at, order, 1)
            if at.size:
                yield pa.record_batch({"query_id": np.repeat(names, at.shape[1]), "idx": at.ravel(), "score": scores.ravel()})

        return vectors.select(F.col("idx").cast("long").alias("idx"), "embedding").mapInArrow(best, schema)

    found = vectors.sparkSession.createDataFrame([], schema)
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        found = found.unionByName(one(rows)) if rows else found
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "idx"))).where(F.col("rank") <= k)


#: Query vectors of a block, about.
MOST_QUERIES = 20_000
#: Fixed value: vectors that are multiplied with a block of queries at once.
TILE = 128
