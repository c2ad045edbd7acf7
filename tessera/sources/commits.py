"""Tables that change as a whole: data first, then a pointer, which is renamed into its place.

A table's folder holds data folders, which are never changed, and ``current``, a line of JSON: the version, the data folders that
make up the table, the next ordinal, the last batch of each stream.  What a write that broke off has left is in no pointer, so
nobody reads it, and the same write again gives the same table.  A stream's batch that comes again is known by its number.
One writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.ordering import ranked
from tessera.session import discard
from tessera.sources import sinks


class Table:
    """A table of rows of one schema, with a dense ordinal if ``ordinal`` names one."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, ordinal: str | None = None):
        self.spark, self.path, self.ordinal = spark, path.rstrip("/"), ordinal
        self.schema = schema if ordinal is None else StructType(list(schema.fields)).add(ordinal, "long")
        self._pointer = self._at("current")

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._pointer.toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())

    def state(self) -> dict:
        """What the pointer says; of a table that isn't there, an empty one."""
        files = self._files()
        if not files.util().exists(self._pointer):
            return {"version": 0, "data": [], "next": 0, "batches": {}}
        stream = files.open(self._pointer)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, state: dict) -> None:
        """The pointer, written beside its place and renamed over the old one."""
        jvm, files = self.spark._jvm, self._files()
        beside = self._at(f".current-{uuid.uuid4().hex}")
        flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.CreateOpts.createParent()
        out = files.create(beside, flags, options)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files.rename(beside, self._pointer, over)

    def read(self) -> DataFrame:
        """The rows of the version that the pointer names now."""
        data = self.state()["data"]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{d}" for d in data]) if data else self.spark.createDataFrame([], self.schema)

    def _commit(self, rows: DataFrame, state: dict, keep: list[str], stream: str | None, batch: int | None) -> int:
        """Writes ``rows`` to a new folder and points to it and to ``keep``; how many rows it holds.  The next ordinal is the number of all rows."""
        name = f"data-{state['version'] + 1:08d}-{uuid.uuid4().hex}"
        rows.select(*self.schema.fieldNames()).write.parquet(f"{self.path}/{name}")
        n = self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").count()
        batches = state["batches"] | ({stream: batch} if stream is not None else {})
        self._point({"version": state["version"] + 1, "data": [*keep, name], "next": n + (state["next"] if keep else 0), "batches": batches})
        return n

    def _known(self, state: dict, stream: str | None, batch: int | None) -> bool:
        return stream is not None and batch <= state["batches"].get(stream, -1)

    def append(self, rows: DataFrame, order: list[str], stream: str | None = None, batch: int | None = None) -> int:
        """Rows added after those that are there, numbered on in the order of ``order``; how many.  A batch that is there adds none."""
        state = self.state()
        if self._known(state, stream, batch):
            return 0
        if self.ordinal is None:
            return self._commit(rows, state, state["data"], stream, batch)
        numbered = ranked(rows, [], order, self.ordinal, state["next"])
        n = self._commit(numbered, state, state["data"], stream, batch)
        discard(*numbered.made)
        return n

    def append_vectors(self, rows: DataFrame, dimension: int, order: list[str], stream: str | None = None, batch: int | None = None) -> int:
        """Vectors, normalised, appended with their ordinals; a wrong dimension fails before the pointer moves."""
        state = self.state()
        if self._known(state, stream, batch):
            return 0
        return self._commit(sinks.vectors_to_append(rows, state["next"], dimension, order).withColumnRenamed("idx", self.ordinal), state, state["data"], stream, batch)

    def upsert(self, rows: DataFrame, key: str, order: list[str], stream: str | None = None, batch: int | None = None) -> None:
        """Rows replace those of their key, of several in ``rows`` the last by ``order``; replaced ones keep their ordinal, new ones get the next."""
        state = self.state()
        if self._known(state, stream, batch):
            return
        last = rows.groupBy(key).agg(F.max(F.struct(*order, F.struct(*rows.columns).alias("row"))).alias("m")).select("m.row.*")
        old = self.read()
        if self.ordinal is None:
            self._commit(old.join(last.select(key), key, "left_anti").unionByName(last), state, [], stream, batch)
            return
        kept = old.join(last.select(key), key, "left_anti").select(*self.schema.fieldNames())
        replaced = last.join(old.select(key, self.ordinal), key)
        new = ranked(last.join(old.select(key), key, "left_anti"), [], [*order, key], self.ordinal, state["next"])
        self._commit(kept.unionByName(replaced.select(*kept.columns)).unionByName(new.select(*kept.columns)), state, [], stream, batch)
        discard(*new.made)

    def clear(self) -> list[str]:
        """Deletes data folders that no pointer names; their names.  Not while a writer or a reader of an older version runs."""
        files, known = self._files(), set(self.state()["data"])
        found, gone = files.listStatus(self._at("")), []
        while found.hasNext():
            path = found.next().getPath()
            if path.getName().startswith("data-") and path.getName() not in known:
                files.delete(path, True)
                gone.append(path.getName())
        return gone


def fed(stream: DataFrame, table: Table, name: str, checkpoint: str, write, trigger: str | None = None):
    """A stream whose batches go to ``write(table, rows, name, number)``; a batch that is repeated after a crash is written once."""
    writer = stream.writeStream.foreachBatch(lambda rows, number: write(table, rows, name, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
