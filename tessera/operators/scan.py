"""Running values along an order, without one task that sees all rows of a group."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import discard, stored


@dataclass(frozen=True)
class Running:
    """A running ``sum``, ``max``, ``min`` or ``last`` (the latest value that isn't null) of a column.

    ``before``: without the row itself.  ``back``: from the end of the group, so ``last`` is the next value.
    """

    kind: str
    column: Column
    before: bool = False
    back: bool = False

    def over(self, by: list[str], order: str) -> Column:
        """Over the rows of a group.  What runs back from the end runs over the reverse order: Spark adds anew for each row up to a frame's end."""
        window = Window.partitionBy(*by).orderBy(F.col(order).desc() if self.back else F.col(order)).rowsBetween(Window.unboundedPreceding, 0 - self.before)
        return F.last(self.column, True).over(window) if self.kind == "last" else self._total().over(window)

    def whole(self, order: str) -> Column:
        """Over all rows of a group at once."""
        if self.kind == "last":
            return (F.min_by if self.back else F.max_by)(self.column, F.when(self.column.isNotNull(), F.col(order)))
        return self._total()

    def _total(self) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](self.column)

    def joined(self, near: Column, far: Column) -> Column:
        """The value of a stretch and of what lies beyond it."""
        if self.kind == "sum":
            return F.when(near.isNotNull() | far.isNotNull(), F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0)))
        return F.coalesce(near, far) if self.kind == "last" else {"max": F.greatest, "min": F.least}[self.kind](near, far)


class Line:
    """Rows in an order within groups, dealt to partitions that each hold an interval of it, so a group may span many.

    Rows are range-partitioned by group and order and written once, with the number of their partition: bounds are sampled anew
    whenever a range partitioning is run.  A scan runs in each partition alone; what a group's earlier (or later) partitions
    come to is added from a table that has a row only where a group spans partitions: at most one or two for each, so it's broadcast.
    """

    def __init__(self, rows: DataFrame, by: list[str], order: list, placed: bool = False):
        self.by, self.order = by, order
        self.made: DataFrame | None = None
        if not placed:
            n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            dealt = rows.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
            rows = self.made = stored(dealt.withColumn("_p", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "line")
        self.rows = rows

    def scan(self, **running: Running) -> Line:
        """The same rows, in the same places, with a column for each running value."""
        out = self.rows.withColumns({f"_near_{k}": r.over(["_p", *self.by], "_at") for k, r in running.items()})
        for back in (False, True):
            some = {k: r for k, r in running.items() if r.back == back}
            if not some:
                continue
            totals = self.rows.groupBy("_p", *self.by).agg(*[r.whole("_at").alias(f"_all_{k}") for k, r in some.items()])
            other = (F.lead if back else F.lag)("_p").over(Window.partitionBy(*self.by).orderBy("_p"))
            beyond = {k: Running(r.kind, F.col(f"_all_{k}"), True, back).over(self.by, "_p") for k, r in some.items()}
            carried = totals.select(F.col("_p").alias("_q"), *[F.col(b).alias(f"_by{j}") for j, b in enumerate(self.by)], other.alias("_other"), *[x.alias(f"_far_{k}") for k, x in beyond.items()])
            on = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_by{j}")) for j, b in enumerate(self.by)], F.col("_p") == F.col("_q"))
            out = out.join(F.broadcast(carried.where("_other is not null").drop("_other")), on, "left")
            out = out.withColumns({k: r.joined(F.col(f"_near_{k}"), F.col(f"_far_{k}")) for k, r in some.items()}).drop("_q", *[f"_by{j}" for j in range(len(self.by))], *[f"_far_{k}" for k in some], *[f"_near_{k}" for k in some])
        made = Line(out, self.by, self.order, True)
        made.made = self.made
        return made

    def done(self) -> DataFrame:
        """The rows without their places."""
        return self.rows.drop("_p", "_at")

    def clear(self) -> None:
        """Delete the written rows, once nothing reads them any more."""
        if self.made is not None:
            discard(self.made)
