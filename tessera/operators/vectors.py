"""Exact nearest vectors by cosine, where only blocks that can hold one of them are multiplied."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import ranked
from tessera.operators.sampling import first_n
from tessera.session import discard, stored

#: Centres of clusters (vectors with the least hashes), vectors in a block, blocks that a query looks at first, queries that a block meets at once.
CENTRES, BLOCK, FIRST, TILE = 128, 512, 2, 1024


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def matrix(column: pa.Array, size: int | None = None) -> np.ndarray:
    """A column of equally long lists as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, size or 0)


class Blocks:
    """Vectors of each episode in blocks of ``BLOCK``: near one of ``CENTRES`` centres, in shells around it.

    The centres are a bounded sample and stand for all episodes.  ``table`` has a row for a block: its episode, centre, the least and the
    greatest angle to the centre, the times that it spans, and its vectors, of length 1, in one binary column.
    """

    def __init__(self, vectors: DataFrame, centres: int = CENTRES, block: int = BLOCK):
        """``vectors``: seg_id, episode_id, start, end, idx, embedding; negative idx are left out."""
        rows = vectors.where("idx >= 0 and embedding is not null").select("seg_id", "episode_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col("idx").cast("long").alias("idx"), F.col("embedding").cast("array<double>").alias("embedding"))
        chosen = rows.orderBy(F.xxhash64("idx"), "idx").limit(centres).select("embedding").toArrow()
        self.centres = c = unit(matrix(chosen["embedding"])) if chosen.num_rows else np.zeros((0, 1))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = unit(matrix(batch.column("embedding")))
                dots = np.clip(v @ c.T, -1, 1)
                at = dots.argmax(1) if len(v) else np.zeros(0, np.int64)
                angle = np.arccos(dots[np.arange(len(v)), at])
                packed = pa.array([x.tobytes() for x in v], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("seg_id", "episode_id", "start", "end", "idx")], pa.array(at.astype(np.int32)), pa.array(angle), packed], names=["seg_id", "episode_id", "start", "end", "idx", "centre", "angle", "vector"])

        kinds = f"seg_id {dict(rows.dtypes)['seg_id']}, episode_id {dict(rows.dtypes)['episode_id']}, start double, `end` double, idx long, centre int, angle double, vector binary"
        placed = ranked(rows.mapInArrow(near, kinds), ["episode_id", "centre"], ["angle", "idx"], "at", 0)
        members = F.sort_array(F.collect_list(F.struct("idx", "seg_id", "start", "end", "vector")))
        table = placed.groupBy("episode_id", "centre", F.floor(F.col("at") / block).alias("shell")).agg(F.min("angle").alias("least"), F.max("angle").alias("most"), F.min("start").alias("from"), F.max("end").alias("to"), F.count(F.lit(1)).alias("n"), members.alias("members"))
        self.table = stored(table, "blocks")
        discard(*placed.made)

    def _met(self, pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """The ``k`` best of each pair (block, centre, shell, episode, qid): (qid, seg_id, start, end, idx, score), a block in memory at a time."""
        key = ["episode_id", "centre", "shell"]
        told = pairs.join(queries.select("qid", "lo", "hi", "query"), "qid")
        tiles = told.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
        share = F.pmod(F.xxhash64("qid"), F.col("tiles")).cast("int").alias("tile")
        none = F.lit(None)
        asking = told.join(tiles, key).select(*key, share, F.lit(1).alias("kind"), "qid", "lo", "hi", "query", none.cast(self.table.schema["members"].dataType).alias("members"))
        held = self.table.join(tiles, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(0).alias("kind"), none.cast(queries.schema["qid"].dataType).alias("qid"), none.cast("double").alias("lo"), none.cast("double").alias("hi"), none.cast("binary").alias("query"), "members")
        rows = held.unionByName(asking).repartition(*key, "tile").sortWithinPartitions(*key, "tile", "kind")

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, block = None, None
            for batch in batches:
                names = list(zip(*[batch.column(x).to_pylist() for x in (*key, "tile")], strict=True))
                kind = batch.column("kind").to_pylist()
                i = 0
                while i < len(names):
                    if kind[i] == 0:
                        m = batch.column("members")[i].values
                        at, block = names[i], (m, np.frombuffer(b"".join(m.field("vector").to_pylist()), np.float64).reshape(len(m), -1), *[m.field(x).to_numpy(zero_copy_only=False) for x in ("start", "end", "idx")])
                        i += 1
                        continue
                    j = i
                    while j < len(names) and names[j] == names[i] and kind[j] == 1 and j - i < TILE:
                        j += 1
                    if names[i] == at:
                        yield from best(batch.slice(i, j - i), *block)
                    i = j

        def best(asked: pa.RecordBatch, m: pa.StructArray, v: np.ndarray, start: np.ndarray, end: np.ndarray, idx: np.ndarray) -> Iterator[pa.RecordBatch]:
            q = np.frombuffer(b"".join(asked.column("query").to_pylist()), np.float64).reshape(asked.num_rows, -1)
            lo, hi = (asked.column(x).to_numpy(zero_copy_only=False)[:, None] for x in ("lo", "hi"))
            s = np.where((end[None, :] > lo) & (start[None, :] < hi), np.round(q @ v.T, 6), -np.inf)
            few = np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
            least = np.take_along_axis(s, few, 1).min(1)[:, None]
            rows, cols = np.nonzero((s >= least) & np.isfinite(s))  # all that tie with the k-th
            order = np.lexsort((idx[cols], -s[rows, cols], rows))
            rows, cols = rows[order], cols[order]
            kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            rows, cols = rows[kept], cols[kept]
            if len(rows):
                of = m.take(pa.array(cols))
                yield pa.RecordBatch.from_arrays([asked.column("qid").take(pa.array(rows)), of.field("seg_id"), of.field("start"), of.field("end"), of.field("idx"), pa.array(s[rows, cols])], names=["qid", "seg_id", "start", "end", "idx", "score"])

        kinds = dict(self.table.select(F.col("members")[0]["seg_id"].alias("seg_id")).dtypes)["seg_id"]
        return rows.mapInArrow(multiply, f"qid {dict(queries.dtypes)['qid']}, seg_id {kinds}, start double, `end` double, idx long, score double")

    def search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(qid, seg_id, start, end, idx, score) of the ``k`` best of each query's episode and window, ties by idx; and (qid, multiplied, all), vectors
        that were multiplied and that the episode's window may hold.  ``queries``: qid, episode_id, lo, hi, query_vector.

        A block's best is at most the cosine of the angle that is left between the query and its shell.  ``FIRST`` blocks with the highest
        bounds give a k-th score; of the others only those whose bound reaches it are read.
        """
        c = self.centres

        def angled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = unit(matrix(batch.column("query_vector"), c.shape[1]))
                angles = np.arccos(np.clip(q @ c.T, -1, 1)) if len(c) else np.zeros((len(q), 0))
                lists = pa.array(list(angles), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("qid", "episode_id", "lo", "hi")], pa.array([x.tobytes() for x in q], pa.binary()), lists], names=["qid", "episode_id", "lo", "hi", "query", "angles"])

        kinds = dict(queries.dtypes)
        rows = queries.where("query_vector is not null").select("qid", "episode_id", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), F.col("query_vector").cast("array<double>").alias("query_vector"))
        asked = stored(rows.mapInArrow(angled, f"qid {kinds['qid']}, episode_id {kinds['episode_id']}, lo double, hi double, query binary, angles array<double>"), "asked")
        blocks = self.table.select("episode_id", "centre", "shell", "least", "most", "from", "to", "n")
        angle = F.get("angles", F.col("centre"))
        bound = F.cos(F.greatest(F.lit(0.0), angle - F.col("most"), F.col("least") - angle)) + 2e-6  # scores have six digits
        pairs = asked.select("qid", "episode_id", "lo", "hi", "angles").join(blocks, "episode_id").where("`to` > lo and `from` < hi").select("qid", "episode_id", "centre", "shell", "n", bound.alias("bound"))
        near = stored(first_n(pairs, ["qid"], [F.col("bound").desc(), "centre", "shell"], FIRST), "first")
        hits = stored(first_n(self._met(near, asked, k), ["qid"], [F.col("score").desc(), "idx"], k), "hits")
        known = hits.groupBy("qid").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found"))
        done = near.select("qid", "episode_id", "centre", "shell", F.lit(True).alias("done"))
        rest = pairs.join(known, "qid", "left").where(f"found is null or found < {k} or bound >= least").join(done, ["qid", "episode_id", "centre", "shell"], "left_anti")
        rest = stored(rest.select(*near.columns), "rest")
        out = first_n(hits.unionByName(self._met(rest, asked, k)), ["qid"], [F.col("score").desc(), "idx"], k)
        every = pairs.groupBy("qid").agg(F.sum("n").alias("all"))
        read = near.unionByName(rest).groupBy("qid").agg(F.sum("n").alias("multiplied"))
        return out, every.join(read, "qid", "left").select("qid", "multiplied", "all")
