"""Streaming forms: resume, windows and sessions of segments as they arrive."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import gcd

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: State of a key: its first and last event, the next window's number, points before the anchor is sure, and sums of cells after.
HELD = "anchor long, sure boolean, last long, next long, t array<long>, v array<double>, cell array<long>, n array<long>, total array<double>"


def new_only(stream: DataFrame, key: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows whose key wasn't seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, width: str, by: list[str], time: str = "ts", late: str = "10 minutes", value: str = "value") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def sliding(stream: DataFrame, width: str, step: str, by: list[str], offset: str = "0 seconds", time: str = "ts", late: str = "10 minutes", value: str = "value") -> DataFrame:
    """Windows anchored at ``offset`` from the epoch; ``anchored`` has anchors of each key's own."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, step, offset), *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def sessions(stream: DataFrame, gap: str, by: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Rows of a key joined while less than ``gap`` apart."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))


def append(stream: DataFrame, path: str, checkpoint: str, trigger: str | None = None):
    """An append-only sink whose checkpoint makes restarts exact; without ``trigger`` it takes what is there and ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


class Windows:
    """Sliding windows of one key, anchored at its first event; all times in microseconds.

    Until the watermark has passed the first event an earlier one may still come, so points are kept as they are.  Then they go
    into cells, of which steps and half windows are multiples: points on a cell's edge (even numbers) apart from those inside (odd),
    since a window holds both its ends.  So the state is a few numbers for each cell of one window, however many points there are.
    """

    def __init__(self, width: int, step: int, held: tuple | None = None):
        self.width, self.step, self.unit = width, step, gcd(step, width // 2)
        self.anchor, self.sure, self.last, self.next, t, v, cell, n, total = held or (None, False, None, 0, [], [], [], [], [])
        self.points = list(zip(t, v, strict=True))
        self.cells: dict[int, list] = defaultdict(lambda: [0, 0.0], {c: [k, x] for c, k, x in zip(cell, n, total, strict=True)})

    def held(self) -> tuple:
        cells = sorted(self.cells)
        return (self.anchor, self.sure, self.last, self.next, [t for t, _ in self.points], [v for _, v in self.points], cells, [self.cells[c][0] for c in cells], [self.cells[c][1] for c in cells])

    def _count(self, t: int, v: float) -> None:
        at, rest = divmod(t - self.anchor, self.unit)
        cell = self.cells[2 * at + (rest > 0)]
        cell[0] += 1
        cell[1] += v

    def add(self, t: int, v: float) -> None:
        self.last = t if self.last is None else max(self.last, t)
        if self.sure:
            self._count(t, v)
        else:
            self.anchor = t if self.anchor is None else min(self.anchor, t)
            self.points.append((t, v))

    def closed(self, watermark: int) -> Iterator[tuple[int, int, float, float]]:
        """(lo, hi, mean of the first half, mean of the second) of windows that are over: nothing before ``watermark`` can come any more."""
        if not self.sure and self.anchor is not None and watermark > self.anchor:
            self.sure, points, self.points = True, self.points, []
            for t, v in points:
                self._count(t, v)
        while self.sure and self.cells:
            first = min(self.cells) // 2 * self.unit  # windows that end before the first cell hold nothing
            self.next = max(self.next, -(-(first - self.width) // self.step))
            low = self.next * self.step
            if self.anchor + low + self.width > min(watermark, self.last):
                return
            a, b, z = (2 * (low + x) // self.unit for x in (0, self.width // 2, self.width))
            halves = [[sum(self.cells[c][k] for c in range(x, y) if c in self.cells) for k in (0, 1)] for x, y in ((a, b), (b, z + 1))]
            if halves[0][0] and halves[1][0]:
                yield self.anchor + low, self.anchor + low + self.width, halves[0][1] / halves[0][0], halves[1][1] / halves[1][0]
            self.next += 1
            for c in [c for c in self.cells if c < 2 * self.next * self.step // self.unit]:
                del self.cells[c]

    def wakes(self) -> int | None:
        """When there may be something to do without new points."""
        if not self.sure:
            return self.anchor
        end = self.anchor + self.next * self.step + self.width
        return end if self.cells and end <= self.last else None


def anchored(stream: DataFrame, by: list[str], width: float, step: float, time: str = "ts", value: str = "value", late: str = "10 minutes") -> DataFrame:
    """(by, lo, hi, half1, half2, delta) of windows of ``width`` seconds every ``step`` seconds from each key's own first event.

    The batch form is ``events.trend_windows``: a window needs values in both halves and ends by its key's last event.  It comes out
    once the watermark has passed its end; state and timeouts are kept by key, so a restart goes on where the stream was.
    """
    wide, far = round(width * 2_000_000) // 2, round(step * 1_000_000)
    rows = stream.withWatermark(time, late).select(*by, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), F.col(value).cast("double").alias("_v"), time).where("_t is not null and _v is not null")
    out = StructType([rows.schema[b] for b in by])
    for c in ("lo", "hi", "half1", "half2", "delta"):
        out = out.add(c, "double")

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        windows = Windows(wide, far, state.get if state.exists else None)
        for part in parts if not state.hasTimedOut else ():
            for t, v in zip(part["_t"].tolist(), part["_v"].tolist(), strict=True):
                windows.add(t, v)
        watermark = state.getCurrentWatermarkMs()
        found = [(*key, lo / 1e6, hi / 1e6, x, y, y - x) for lo, hi, x, y in windows.closed(watermark * 1000)]
        state.update(windows.held())
        if (at := windows.wakes()) is not None:
            state.setTimeoutTimestamp(max(at // 1000 + 1, watermark + 1))
        if found:
            yield pd.DataFrame(found, columns=out.fieldNames())

    return rows.groupBy(*by).applyInPandasWithState(run, out, HELD, "append", GroupStateTimeout.EventTimeTimeout)
