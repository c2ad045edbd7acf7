"""Corpora as a data source: ``spark.read.format("tessera_episodes")`` reads records of episodes by an index of their bytes.

A corpus is a file of JSON (one object, one list of objects, or lines) and an index of it (``readers.object_index``,
``readers.line_index``), written once, in files that are each a range of episode ids.  A partition is a file of the index; conditions
on ``episode_id`` leave out the files that can't hold the ids, by the least and greatest that Parquet notes of each, and a task reads
no bytes but those of the records that are asked for.  Paths are whatever ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

NAME = "tessera_episodes"
#: Bytes of a file that are read at once, where records stand next to each other.
SPAN = 8 << 20


def write_index(index: DataFrame, path: str, files: int = 16) -> None:
    """The index of a corpus (key, entry, from, to) in ``files`` files by ranges of keys."""
    index.select(F.col("key").alias("episode_id"), F.col("entry").cast("long").alias("entry"), "from", "to").repartitionByRange(files, "episode_id", "entry").sortWithinPartitions("episode_id", "entry").write.mode("overwrite").parquet(path)


class Part(InputPartition):
    def __init__(self, file: str, ids: list[str] | None):
        super().__init__(None)
        self.file, self.ids = file, ids


class EpisodeSource(DataSource):
    """Options: path (the corpus), index (a folder of ``write_index``)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "episode_id string, entry long, record string"

    def reader(self, schema) -> EpisodeReader:
        return EpisodeReader(self.options["path"], self.options["index"])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path.removeprefix('file:'))}")


class EpisodeReader(DataSourceReader):
    def __init__(self, path: str, index: str):
        self.path, self.index, self.ids = path, index, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and lists of episode ids are taken here, everything else is left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("episode_id",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = sorted(own if self.ids is None else own & set(self.ids))
            else:
                yield f

    def partitions(self) -> list[Part]:
        where, path = opened(self.index)
        files = sorted(x.path for x in where.get_file_info(fs.FileSelector(path)) if x.base_name.endswith(".parquet"))
        out = []
        for file in files:
            if self.ids is None:
                out.append(Part(file, None))
                continue
            meta, ids = pq.read_metadata(file, filesystem=where), set()
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(0).statistics
                ids.update(i for i in self.ids if stats is None or not stats.has_min_max or stats.min <= i <= stats.max)
            if ids:
                out.append(Part(file, sorted(ids)))
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        where, _ = opened(self.index)
        rows = pq.read_table(partition.file, filesystem=where, filters=None if partition.ids is None else [("episode_id", "in", partition.ids)])
        rows = rows.sort_by("from")
        begin, end, ids, entries = (rows.column(c).to_pylist() for c in ("from", "to", "episode_id", "entry"))
        corpus, path = opened(self.path)
        with corpus.open_input_file(path) as file:
            at = 0
            while at < len(ids):
                upto = at + 1
                while upto < len(ids) and begin[upto] == end[upto - 1] and end[upto] - begin[at] <= SPAN:
                    upto += 1
                data = file.read_at(end[upto - 1] - begin[at], begin[at])
                texts = [data[b - begin[at] : e - begin[at]].decode() for b, e in zip(begin[at:upto], end[at:upto], strict=True)]
                yield pa.record_batch([pa.array(ids[at:upto], pa.string()), pa.array(entries[at:upto], pa.int64()), pa.array(texts, pa.string())], names=["episode_id", "entry", "record"])
                at = upto


def registered(spark) -> None:
    """Makes the format known to a session, and lets conditions reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EpisodeSource)


def episodes(spark, path: str, index: str) -> DataFrame:
    """(episode_id, entry, record) of a corpus; records as they stand in the file."""
    registered(spark)
    return spark.read.format(NAME).option("path", path).option("index", index).load()


def record_values(rows: DataFrame, schema: str, keyed: bool = True) -> DataFrame:
    """(episode_id, value): records parsed; ``keyed`` ones are entries of an object, whose key is the episode's id."""
    from tessera.sources.readers import _bare

    bare = _bare(F.col("record"), F.col("entry") == 0)
    if not keyed:
        return rows.select("episode_id", F.from_json(bare, schema).alias("value"))
    held = F.from_json(F.concat(F.lit("{"), bare, F.lit("}")), f"map<string,{schema}>")
    return rows.select("episode_id", F.element_at(held, F.col("episode_id")).alias("value"))
