"""Deterministic sampling, dealing and pairing; random picks are by a hash of the row's id, so they repeat."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import ranked

PRIME, FACTOR = 1_000_003, 7919


def draw(x: Column, seed: int = 42) -> Column:
    """A number for a whole-number id by integer arithmetic, the same in any engine."""
    return F.pmod(F.pmod(x.cast("long"), F.lit(PRIME)) * FACTOR + F.lit(seed * 104_729), F.lit(PRIME))


def first_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def stratified(df: DataFrame, by: list[str], score: Column, id_col: str, cap: int | Column, seed: int = 42) -> DataFrame:
    """One row from each of ``cap`` equal rank buckets of each group, best scores first; nothing for a cap of 0.

    ``cap`` may be a column that is the same in a group.  Ranks are taken by range, so a group of any size spreads.
    """
    if isinstance(cap, int) and cap <= 0:
        return df.limit(0).withColumn("bucket", F.lit(0).cast("long"))
    numbered = ranked(df.withColumn("_cap", F.lit(cap)).withColumn("_score", score), by, [F.col("_score").desc(), id_col], "_at", 0)
    sizes = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*[F.col(b).alias(f"_by_{b}") for b in by], "_n")
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    sized = numbered.join(sizes, on).where("_cap > 0")
    bucket = F.when(F.col("_n") <= F.col("_cap"), F.col("_at")).otherwise(F.floor(F.col("_at") * F.col("_cap") / F.col("_n")))
    dealt = sized.withColumn("bucket", bucket.cast("long")).withColumn("_draw", draw(F.col(id_col), seed))
    pick = dealt.groupBy(*by, "bucket").agg(F.min(F.struct("_draw", F.col(id_col).alias("_id"))).alias("_first")).select(*[F.col(b).alias(f"_of_{b}") for b in by], F.col("bucket").alias("_bucket"), F.col("_first._id").alias("_id"))
    on = (F.col("bucket") == F.col("_bucket")) & (F.col(id_col) == F.col("_id"))
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_of_{b}"))
    return dealt.join(pick, on, "left_semi").select(*df.columns, "bucket")


def round_robin(df: DataFrame, bucket: str, order: list, hands: int) -> DataFrame:
    """Rows dealt to ``hands``: the first of each bucket, then the second of each, and so on.  Ranks are taken by range, so a bucket spreads."""
    turned = ranked(df, [bucket], order, "turn")
    return ranked(turned, [], ["turn", bucket], "place", 0).withColumn("hand", F.pmod("place", F.lit(hands)))


def paired(df: DataFrame, by: list[str], id_col: str, seed: int = 42) -> DataFrame:
    """Rows of each group in a drawn order, two by two: (by, pair, a, b); the odd last has no partner and drops out."""
    order = Window.partitionBy(*by).orderBy(draw(F.col(id_col), seed), id_col)
    n = df.withColumn("_n", F.row_number().over(order) - 1)
    return n.groupBy(*by, F.floor(F.col("_n") / 2).alias("pair")).agg(F.min_by(id_col, "_n").alias("a"), F.max_by(id_col, "_n").alias("b"), F.count(F.lit(1)).alias("_c")).where("_c = 2").drop("_c")


def nearest_in_plane(df: DataFrame, on: str, id_col: str, x: str, y: str, k: int) -> DataFrame:
    """(a, b, distance): the ``k`` other rows of each row's group that are nearest by |x| + |y| (to 6 digits), ties by id; ids are whole numbers.

    A group is sorted by ``y``; each row looks up and down, one candidate further at a time, and stops where the difference in ``y``
    alone exceeds its k-th distance.  Of rows with equal x and y only the ``k + 1`` least ids are candidates.  A group must fit one task,
    which holds numbers only.
    """

    def find(rows: pa.Table) -> pa.Table:
        ids = rows.column("id").to_numpy()
        px, py = rows.column("x").to_numpy(), rows.column("y").to_numpy()
        order = np.lexsort((ids, px, py))
        ids, px, py = ids[order], px[order], py[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (px[1:] != px[:-1]) | (py[1:] != py[:-1])
        first = np.flatnonzero(fresh)
        place = np.arange(len(ids)) - first[np.cumsum(fresh) - 1]
        few = place <= k
        cid, cx, cy = ids[few], px[few], py[few]
        best = np.full((len(ids), k), np.inf)
        names = np.full((len(ids), k), np.iinfo(np.int64).max)
        begin = np.searchsorted(cy, py)
        for step in (1, -1):
            live, at = np.arange(len(ids)), begin if step > 0 else begin - 1
            while len(live):
                inside = (at >= 0) & (at < len(cid))
                live, at = live[inside], at[inside]
                near = np.abs(cy[at] - py[live]) <= best[live, -1] + 1e-6
                live, at = live[near], at[near]
                d = np.where(cid[at] == ids[live], np.inf, np.round(np.abs(cx[at] - px[live]) + np.abs(cy[at] - py[live]), 6))
                better = (d < best[live, -1]) | ((d == best[live, -1]) & (cid[at] < names[live, -1]) & np.isfinite(d))
                row, new = live[better], np.column_stack((best[live[better]], d[better]))
                name = np.column_stack((names[row], cid[at[better]]))
                by = np.lexsort((name, new), axis=1)[:, :k]
                best[row], names[row] = np.take_along_axis(new, by, 1), np.take_along_axis(name, by, 1)
                at = at + step
        found = np.isfinite(best)
        return pa.table({"a": np.repeat(ids, found.sum(1)), "b": names[found], "distance": best[found]})

    rows = df.where(f"{on} is not null and {x} is not null and {y} is not null")
    told = rows.select(on, F.col(id_col).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return told.groupBy(on).applyInArrow(lambda t: find(t), "a long, b long, distance double")


def kernel(rows: list[tuple[tuple, tuple]], most: int) -> list[int]:
    """Places of the rows (order, values to exclude by) that can be the first one left when each column excludes one value.

    A row counts if some choice of one value for each of the columns excludes all counted rows before it but not itself; there are
    at most C(2m, m) such rows for m columns, 2 for one and 6 for two, so ``most`` is only a stop for the search.
    """
    kept: list[int] = []
    for k in sorted(range(len(rows)), key=lambda k: rows[k][0]):
        own = rows[k][1]

        def covers(left: list[int], free: tuple[int, ...]) -> bool:
            if not left:
                return True
            first = rows[left[0]][1]
            return any(first[c] != own[c] and covers([i for i in left[1:] if rows[i][1][c] != first[c]], tuple(x for x in free if x != c)) for c in free)

        if covers(kept, tuple(range(len(own)))):
            kept.append(k)
            if len(kept) >= most:
                break
    return kept


def pool_pick(left: DataFrame, pool: DataFrame, on: list[str], left_id: str, pool_id: str, exclude: list[tuple[str, str]], order: list[Column], prefer: tuple[str, str] | None = None) -> DataFrame:
    """``left`` with the first row's ``pool_id`` of its group of the pool that differs from it in every pair of ``exclude`` (left's column, the pool's).

    Groups have equal ``on``.  With ``prefer`` (left's column, the pool's) rows that are equal there go before all others.  Each
    task reduces its part of a group to the few rows that can be picked at all (``kernel``), and these parts are
    reduced again; so rows to pick from are a handful for each group, however large it is, and nothing is joined pair by pair.
    """
    from math import comb

    most = comb(2 * len(exclude), len(exclude))
    columns = [c for _, c in exclude]
    place = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], F.col(pool_id).alias("last"))
    tiers = [on] if prefer is None else [[*on, prefer[1]], on]
    out, picked = left, []
    for t, keys in enumerate(tiers):
        rows = pool.select(*keys, F.struct(place.alias("place"), F.struct(*[F.col(c).alias(f"x{k}") for k, c in enumerate(columns)]).alias("x")).alias("row"))
        best = rows.groupBy(*keys, "row.x").agg(F.min("row").alias("row"))  # of rows with equal values to exclude by only the first can be picked
        parts = best.groupBy(*keys, F.pmod(F.xxhash64("row"), F.lit(64)).alias("_part")).agg(F.collect_list("row").alias("rows"))

        @F.pandas_udf("array<int>")
        def chosen(batch):
            import pandas as pd

            plain = lambda v: tuple(v.values()) if isinstance(v, dict) else tuple(v)
            return pd.Series([kernel([(plain(r["place"]), plain(r["x"])) for r in rows], most) for rows in batch])

        reduce = lambda df: df.withColumn("rows", F.transform(chosen("rows"), lambda k: F.get(F.col("rows"), k)))  # noqa: B023, E731
        first = reduce(parts).groupBy(*keys).agg(F.flatten(F.collect_list("rows")).alias("rows"))
        last = reduce(first).select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(keys)], F.array_sort("rows").alias(f"_rows{t}"))
        match = F.lit(True)
        for k, c in enumerate(keys):
            match = match & (F.col(prefer[0] if prefer and t == 0 and k == len(on) else c) == F.col(f"_k{k}"))
        out = out.join(last, match, "left").drop(*[f"_k{k}" for k in range(len(keys))])
        fits = lambda r: F.forall(F.array(*[~r["x"][f"x{k}"].eqNullSafe(F.col(c)) for k, (c, _) in enumerate(exclude)]), lambda b: b)
        picked.append(F.get(F.filter(f"_rows{t}", fits), F.lit(0))["place"]["last"])
    return out.withColumn(pool_id, F.coalesce(*picked)).drop(*[f"_rows{t}" for t in range(len(tiers))])


def centroid_far(df: DataFrame, by: list[str], values: list[str], id_col: str) -> DataFrame:
    """The member of each group farthest from its mean."""
    w = Window.partitionBy(*by)
    d = sum(((F.col(v) - F.avg(v).over(w)) ** 2 for v in values), F.lit(0.0))
    return first_n(df.withColumn("distance", F.round(d, 6)), by, [F.col("distance").desc(), id_col], 1)
