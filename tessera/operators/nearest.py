"""Nearest rows in several dimensions, exactly, without pairing a group's rows."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import ranked
from tessera.operators.sampling import first_n
from tessera.session import discard, grows, stored

#: Bits of a place on the curve, rows of the pool in a block, targets that meet a block in one task at once, and how far
#: apart distances may be that round to the same six digits.
BITS, BLOCK, UNIT, SLACK = 60, 256, 8192, 2e-6
#: How many of the nearest blocks a target without ``k`` rows asks first.
FIRST = 4


def spare(pool: DataFrame, place: list[str], apart: list[str], order: list, k: int) -> DataFrame:
    """Without rows that can't be among the first ``k`` at their place, whichever one value of each column of ``apart`` is excluded.

    Of rows with equal values in a set of columns only so many count: ``k``, and those that each other column can take away.
    Spark cuts such groups before it shuffles them, so a place that many rows share stays a handful.
    """
    most: dict[frozenset, int] = {}
    for size in range(len(apart), -1, -1):
        for same in map(frozenset, combinations(apart, size)):
            most[same] = k + sum(most[same | {c}] for c in apart if c not in same)
            pool = first_n(pool, [*place, *sorted(same)], order, most[same])
    return pool


def _place(v: str, low: list[float], span: list[float]) -> Column:
    """The place on a curve through all dimensions: the bits of the coordinates in turn, so neighbours mostly stand together."""
    dims = range(len(low))
    bits = BITS // len(low)
    at = [F.greatest(F.lit(0), F.least(F.floor((F.col(f"{v}{j}") - low[j]) / F.lit(span[j]) * (1 << bits)), F.lit((1 << bits) - 1))).cast("long") for j in dims]
    return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(F.shiftright(at[j], i).bitwiseAND(1), i * len(low) + j) for i in range(bits) for j in dims]).cast("long")


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _measured(left: pa.Table, right: pa.Table, dims: int, apart: int):
    """Distances of all targets to all rows of a block, a few targets at a time, infinite for rows that aren't apart: (first target, distances)."""
    x, y = ([_column(t, f"{v}{j}") for j in range(dims)] for t, v in ((left, "x"), (right, "y")))
    codes = []
    for j in range(apart):
        a, b = left.column(f"a{j}").combine_chunks(), right.column(f"b{j}").combine_chunks()
        both = pc.fill_null(pa.chunked_array([a, b.cast(a.type)]).combine_chunks().dictionary_encode().indices, -1).to_numpy()
        codes.append((both[: len(a)], both[len(a) :]))
    step = max(1, (1 << 19) // len(right))
    for at in range(0, len(left), step):
        some = slice(at, at + step)
        d = np.zeros((len(x[0][some]), len(right)))
        for j in range(1, dims):
            part = x[j][some, None] - y[j][None]
            d += part * part
        d = np.abs(x[0][some, None] - y[0][None]) + np.sqrt(d)
        for ours, theirs in codes:
            d[(ours[some, None] == theirs[None]) & (theirs >= 0)[None]] = np.inf
        yield at, d


def _kth(d: np.ndarray, k: int) -> np.ndarray:
    return np.partition(d, k - 1, 1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)


def _more(seen):
    """How many of its nearest blocks a target without a bound has asked after the next time."""
    return np.maximum(FIRST, 3 * seen)


class _Boxes:
    """Blocks of all groups by group and first place: their bounds, a row for each ``BLOCK`` rows of the pool or group."""

    def __init__(self, rows: pa.Table, dims: int):
        order = np.lexsort((_column(rows, "b"), _column(rows, "g")))
        self.g, self.b, self.first = (_column(rows, c)[order] for c in ("g", "b", "first"))
        self.low, self.high = (np.column_stack([_column(rows, f"{m}{j}")[order] for j in range(dims)]) for m in ("min", "max"))

    def of(self, g: int) -> slice:
        return slice(*np.searchsorted(self.g, [g, g + 1]))

    def home(self, g: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The block of each target's place in its group."""
        out = np.zeros(len(g), np.int64)
        for one in np.unique(g):
            rows, own = self.of(one), g == one
            out[own] = np.maximum(np.searchsorted(self.first[rows], place[own], "right") - 1, 0)
        return out

    def asked(self, g: int, home: int, x: np.ndarray, far: np.ndarray, seen: np.ndarray):
        """(target, block) that are to meet: blocks but the home that reach within ``far``, after the ``seen`` nearest; while nothing bounds them, the next nearest ones."""
        rows = self.of(g)
        low, high = self.low[rows], self.high[rows]
        step = min(256, max(1, (1 << 20) // len(low)))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for one in (np.flatnonzero(np.isfinite(far)), np.flatnonzero(~np.isfinite(far))):
            for at in range(0, len(one), step):
                some = one[at : at + step]
                lo, hi = x[some].min(0), x[some].max(0)
                near = np.flatnonzero(self._length(np.maximum(0, np.maximum(low - hi, lo - high))) <= far[some].max() + SLACK)
                near = near[near != home]
                d = self._length(np.maximum(0, np.maximum(low[near][None] - x[some, None], x[some, None] - high[near][None])))
                met = d <= far[some, None] + SLACK
                for t in np.flatnonzero((seen[some] > 0) | ~np.isfinite(far[some])):
                    order, done = np.argsort(d[t], kind="stable"), seen[some[t]]
                    met[t, order[:done]] = False
                    if not np.isfinite(far[some[t]]):
                        met[t, order[_more(done) :]] = False
                target, block = np.nonzero(met)
                out.append((some[target], near[block]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    @staticmethod
    def _length(d: np.ndarray) -> np.ndarray:
        return d[..., 0] + np.sqrt((d[..., 1:] ** 2).sum(-1))


def nearest_points(targets: DataFrame, pool: DataFrame, on: list[str], target_id: str, pool_id: str, near: list[str], apart: list[tuple[str, str]], k: int = 3) -> DataFrame:
    """(target_id, rank, pool_id, distance): the ``k`` rows of the pool nearest to each target, ties by id.

    Both tables have the columns ``on`` (equal) and ``near``; rows differ in each pair of ``apart`` (a target's column, the pool's;
    null differs from all).  The distance is |difference| of the first dimension and the Euclidean distance of the others, to six digits.

    A group's pool is cut along a curve through all dimensions into blocks of ``BLOCK`` rows, so blocks are small where rows are
    dense.  A target is measured against the block of its own place, which bounds its k-th distance, and then against those blocks
    alone whose bounds lie within it.  A target that a block leaves without ``k`` rows asks its nearest blocks, ever more of them, until
    it has a bound.  What is sent to all tasks is the blocks' bounds.  Targets of one block are dealt out, ``UNIT`` at a time; of
    rows at one place only those that can matter are kept (``spare``).  Rows with a null in ``on``, ``near`` or the id take no part.
    """
    spark, dims, pairs = targets.sparkSession, len(near), len(apart)
    known = lambda df, i: df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*on, *near, i]]))
    left = known(targets, target_id).select(F.col(target_id).alias("tid"), *[F.col(c).alias(f"on{j}") for j, c in enumerate(on)], *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(near)], *[F.col(a).alias(f"a{j}") for j, (a, _) in enumerate(apart)])
    right = known(pool, pool_id).select(F.col(pool_id).alias("pid"), *[F.col(c).alias(f"on{j}") for j, c in enumerate(on)], *[F.col(c).cast("double").alias(f"y{j}") for j, c in enumerate(near)], *[F.col(b).alias(f"b{j}") for j, (_, b) in enumerate(apart)])
    groups, xs, ys, own, their = ([f"{v}{j}" for j in range(n)] for v, n in (("on", len(on)), ("x", dims), ("y", dims), ("a", pairs), ("b", pairs)))
    right = stored(spare(right, [*groups, *ys], their, ["pid"], k), "pool")
    edge = right.agg(*[f(y).alias(f"{n}{j}") for j, y in enumerate(ys) for n, f in (("min", F.min), ("max", F.max))]).first()
    kinds = [targets.schema[target_id].dataType, pool.schema[pool_id].dataType]
    shape = lambda df: df.select(F.col("tid").cast(kinds[0]).alias(target_id), F.col("rank").cast("int").alias("rank"), F.col("pid").cast(kinds[1]).alias(pool_id), F.col("d").cast("double").alias("distance"))
    if edge["min0"] is None:
        return shape(left.limit(0).select("tid", F.lit(0).alias("rank"), F.lit(None).alias("pid"), F.lit(0.0).alias("d")))
    low = [edge[f"min{j}"] for j in range(dims)]
    span = [(edge[f"max{j}"] - low[j]) or 1.0 for j in range(dims)]
    names = stored(ranked(right.select(*groups).distinct(), [], groups, "g"), "groups")
    named = lambda df: df.join(names, groups).drop(*groups)
    numbered = ranked(named(right).withColumn("place", _place("y", low, span)), ["g"], ["place", "pid"], "at", 0)
    blocks = stored(numbered.withColumn("b", F.floor(F.col("at") / BLOCK)).drop("at"), "blocks")
    discard(right, *numbered.made)
    bounds = blocks.groupBy("g", "b").agg(F.min("place").alias("first"), *[f(y).alias(f"{n}{j}") for j, y in enumerate(ys) for n, f in (("min", F.min), ("max", F.max))])
    boxes = spark.sparkContext.broadcast(_Boxes(bounds.toArrow(), dims))
    blocks = blocks.drop("place")


    def at_home(batches):
        for batch in batches:
            b = boxes.value.home(batch.column("g").to_numpy(), batch.column("place").to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "place"], pa.array(b)], [*[c for c in batch.schema.names if c != "place"], "b"])

    state = ["tid", "g", "b", "home", *xs, *own, "far", "seen"]
    placed = named(left).withColumn("place", _place("x", low, span))
    homes = stored(placed.mapInArrow(at_home, placed.drop("place").withColumn("b", F.lit(0).cast("long")).schema), "targets")
    plain = homes.withColumns({"home": F.col("b"), "far": F.lit(float("inf")), "seen": F.lit(0).cast("long")}).select(*state)
    found = blocks.select("pid", F.lit(0.0).alias("d"))
    both = plain.limit(0).join(found.limit(0), F.lit(True), "full").select(*state, *found.columns).schema

    def told(rows: pa.Table, hits: list, asks: tuple | None) -> pa.Table:
        """Rows that were found, and blocks that are to be met; each has nulls for what only the other has."""
        out = []
        if hits:
            t, p, d = (np.concatenate(c) for c in zip(*hits, strict=True))
            out.append(pa.table({"tid": rows[0].column("tid").take(pa.array(t)), "pid": rows[1].column("pid").take(pa.array(p)), "d": d}))
        if asks is not None:
            t, b, far, seen = asks
            kept = rows[0].select(["tid", "g", "home", *xs, *own]).take(pa.array(t))
            out.append(kept.append_column("b", pa.array(b, pa.int64())).append_column("far", pa.array(far[t])).append_column("seen", pa.array(seen[t])))
        wanted = pa.schema([pa.field(c, (rows[1] if c == "pid" else rows[0]).schema.field(c).type if c != "d" else pa.float64()) for c in [*state, "pid", "d"]])
        return pa.concat_tables([pa.table({c: t.column(c).cast(wanted.field(c).type) if c in t.column_names else pa.nulls(len(t), wanted.field(c).type) for c in wanted.names}) for t in out] or [wanted.empty_table()])

    def met(l: pa.Table, r: pa.Table) -> pa.Table:
        """Targets against one block: rows within the bound that the target has, or gets here.  At home it then asks other blocks."""
        if not len(l) or not len(r):
            return told((l, r), [], None)
        far, hits = _column(l, "far").copy(), []
        asking = _column(l, "b")[0] == _column(l, "home")[0] and not _column(l, "seen").any() and not np.isfinite(far).any()
        for at, d in _measured(l, r, dims, pairs):
            some = slice(at, at + len(d))
            if not np.isfinite(far[some]).all():
                best = np.minimum(far[some], _kth(d, k))
                if asking:
                    far[some] = best
            else:
                best = far[some]
            t, p = np.nonzero((d <= best[:, None] + SLACK) & np.isfinite(d))
            hits.append((t + at, p, d[t, p]))
        if not asking:
            return told((l, r), hits, None)
        seen = np.zeros(len(l), np.int64)
        t, b = boxes.value.asked(_column(l, "g")[0], _column(l, "home")[0], np.column_stack([_column(l, x) for x in xs]), far, seen)
        return told((l, r), hits, (t, b, far, np.where(np.isfinite(far), 0, _more(seen))))

    def meet(asks: DataFrame) -> DataFrame:
        crowd = asks.groupBy("g", "b").agg(F.ceil(F.count(F.lit(1)) / UNIT).alias("units")).where("units > 1")
        units = F.coalesce("units", F.lit(1))
        l = asks.join(crowd, ["g", "b"], "left").withColumn("u", F.pmod(F.xxhash64("tid"), units)).drop("units")
        r = blocks.join(crowd, ["g", "b"], "left").withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), units - 1))).drop("units")
        return stored(l.groupBy("g", "b", "u").cogroup(r.groupBy("g", "b", "u")).applyInArrow(met, both), "met")

    def again(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            g, home, far, seen = (_column(rows, c) for c in ("g", "home", "far", "seen"))
            x = np.column_stack([_column(rows, c) for c in xs])
            for one in np.unique(np.column_stack((g, home)), axis=0):
                own_ = np.flatnonzero((g == one[0]) & (home == one[1]))
                t, b = boxes.value.asked(one[0], one[1], x[own_], far[own_], seen[own_])
                some = rows.take(pa.array(own_[t]))
                later = np.where(np.isfinite(far[own_[t]]), seen[own_[t]], _more(seen[own_[t]]))
                some = some.set_column(some.column_names.index("b"), "b", pa.array(b, pa.int64())).set_column(some.column_names.index("seen"), "seen", pa.array(later, pa.int64()))
                yield from some.combine_chunks().to_batches()

    rounds = [meet(plain)]
    discard(homes)
    asks = rounds[0].where("b is not null").select(*state)
    while not asks.isEmpty():
        rounds.append(meet(asks))
        open_ = asks.where(F.col("far") == float("inf")).dropDuplicates(["tid"])
        if open_.isEmpty():
            break
        seen = reduce(DataFrame.unionByName, [r.where("pid is not null").select("tid", "pid", "d") for r in rounds]).join(grows(open_.select("tid")), "tid", "left_semi")
        bound = first_n(seen, ["tid"], ["d", "pid"], k).groupBy("tid").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).alias("_far"))
        open_ = open_.join(grows(bound), "tid", "left").withColumn("far", F.coalesce("_far", F.lit(float("inf")))).select(*state)
        asks = stored(open_.mapInArrow(again, open_.schema), "asks")
    found = reduce(DataFrame.unionByName, [r.where("pid is not null").select("tid", "pid", F.round("d", 6).alias("d")) for r in rounds])
    return shape(found.withColumn("rank", F.row_number().over(Window.partitionBy("tid").orderBy("d", "pid"))).where(F.col("rank") <= k))
