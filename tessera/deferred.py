"""Judging in two passes: prompts are handed to a service in jobs, and replies are fetched when they are there.

Three tables that change as a whole (``sources.commits``) hold all there is to know: the requests with their jobs, what has become
of each job, and the replies.  A request's key is a digest of what is asked, so what was asked before isn't asked again.  A job
is planned, then submitted under its name, then collected; a run that breaks off anywhere is simply started again: a service
knows a job that comes twice by its name, and replies that come twice by the job's.  Only names of jobs reach the driver.

A service that takes many jobs in one table (``Batches``) gets all of a pass at once; then requests are read once for a pass, not for a job.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.session import discard, grows, stored
from tessera.sources.commits import Table

#: Prompts in a job.
SIZE = 50_000


class Service(Protocol):
    """Where jobs are run.  ``submit`` of a job that it has already does nothing."""

    def submit(self, job: str, prompts: DataFrame) -> None: ...

    def done(self, job: str) -> bool: ...

    def replies(self, job: str) -> DataFrame:
        """(key, reply) of a job that is done."""


class Batches(Protocol):
    """Where many jobs are handed over at once.  ``submit_all`` does nothing for jobs that it has already."""

    def submit_all(self, prompts: DataFrame) -> None:
        """(job, key, prompt) of jobs."""

    def all_done(self) -> set[str]:
        """Names of the jobs that are done."""

    def all_replies(self) -> DataFrame:
        """(job, key, reply) of jobs that are done."""


class Deferred:
    """Prompts (query_id, kind, prompt) and the state of their jobs under one folder."""

    def __init__(self, spark: SparkSession, path: str, prompts: StructType, size: int = SIZE):
        self.spark, self.size = spark, size
        self.fields = [prompts[c] for c in ("query_id", "kind", "prompt")]
        asked = StructType([*self.fields]).add("key", "string")
        self.requests = Table(spark, f"{path}/requests", asked, "at")
        self.jobs = Table(spark, f"{path}/jobs", StructType().add("job", "string").add("state", "string"))
        self.answers = Table(spark, f"{path}/replies", StructType().add("key", "string").add("reply", "string"))

    def plan(self, prompts: DataFrame) -> int:
        """Adds what wasn't asked yet to the requests; how many prompts that is."""
        key = F.sha2(F.to_json(F.struct("query_id", "kind", "prompt")), 256)
        new = prompts.select("query_id", "kind", "prompt", key.alias("key")).dropDuplicates(["key"]).join(grows(self.requests.read().select("key")), "key", "left_anti")
        new = stored(new, "asked")
        n = 0 if new.isEmpty() else self.requests.append(new, ["key"])
        discard(new)
        return n

    def _named(self) -> DataFrame:
        """Requests with their jobs: stretches of ordinals of one planning, so a job never grows."""
        rows = self.spark.createDataFrame([], self.requests.schema).withColumn("job", F.lit(""))
        for k, folder in enumerate(self.requests.state()["data"]):
            part = self.spark.read.schema(self.requests.schema).parquet(f"{self.requests.path}/{folder}")
            rows = rows.unionByName(part.withColumn("job", F.concat(F.lit(f"job-{k}-"), F.floor(F.col("at") / self.size).cast("string"))))
        return rows

    def run(self, service: Service) -> dict[str, int]:
        """One pass: submits jobs that are planned, fetches those that are done; how many jobs are in each state after it."""
        named = self._named()
        state = {r["job"]: r["state"] for r in self.jobs.read().collect()}
        if hasattr(service, "submit_all"):
            return self._run_all(service, named, state)
        for job in sorted(r["job"] for r in named.select("job").distinct().collect()):
            if job not in state:
                service.submit(job, named.where(F.col("job") == job).select("key", "prompt"))
                self._note(job, "submitted")
                state[job] = "submitted"
            elif state[job] == "submitted" and service.done(job):
                self.answers.append(service.replies(job).select("key", "reply"), ["key"], job, 0)
                self._note(job, "collected")
                state[job] = "collected"
        return {s: list(state.values()).count(s) for s in ("submitted", "collected")}

    def _run_all(self, service: Batches, named: DataFrame, state: dict[str, str]) -> dict[str, int]:
        """The same pass in one write for each step.  Replies that were fetched but not noted are known by their keys."""
        ready = sorted({j for j, s in state.items() if s == "submitted"} & service.all_done())
        new = sorted({r["job"] for r in named.select("job").distinct().collect()} - set(state))
        if new:
            service.submit_all(named.where(F.col("job").isin(new)).select("job", "key", "prompt"))
            self._note_all(new, "submitted")
        if ready:
            fetched = service.all_replies().where(F.col("job").isin(ready)).select("key", "reply")
            self.answers.append(fetched.join(grows(self.answers.read().select("key")), "key", "left_anti"), ["key"])
            self._note_all(ready, "collected")
        state = state | dict.fromkeys(new, "submitted") | dict.fromkeys(ready, "collected")
        return {s: list(state.values()).count(s) for s in ("submitted", "collected")}

    def _note(self, job: str, state: str) -> None:
        self._note_all([job], state)

    def _note_all(self, jobs: list[str], state: str) -> None:
        self.jobs.upsert(self.spark.createDataFrame([(job, state) for job in jobs], self.jobs.schema), "job", ["state"])

    def replies(self) -> DataFrame:
        """(query_id, kind, prompt, reply) of all requests, reply null as long as there is none."""
        return self.requests.read().join(grows(self.answers.read()), "key", "left").select("query_id", "kind", "prompt", "reply")


class Folder:
    """A service that keeps its jobs in a folder and answers them with a model of lists of prompts: a stand-in, and what batch services look like."""

    def __init__(self, spark: SparkSession, path: str, model):
        self.spark, self.path, self.model = spark, path, model

    def _table(self, job: str, what: str, schema: str) -> Table:
        empty = self.spark.createDataFrame([], schema)
        return Table(self.spark, f"{self.path}/{what}/{job}", empty.schema)

    def submit(self, job: str, prompts: DataFrame) -> None:
        self._table(job, "in", "key string, prompt string").append(prompts, ["key"], job, 0)

    def work(self, job: str) -> None:
        """What a service does in its own time."""
        from tessera.experts import batched

        asked = self._table(job, "in", "key string, prompt string").read()
        self._table(job, "out", "key string, reply string").append(batched(asked, self.model).select("key", "reply"), ["key"], job, 0)

    def done(self, job: str) -> bool:
        return self._table(job, "out", "key string, reply string").state()["version"] > 0

    def replies(self, job: str) -> DataFrame:
        return self._table(job, "out", "key string, reply string").read()


class Tables:
    """The same stand-in for many jobs at once: prompts and replies of all jobs are in a table each."""

    def __init__(self, spark: SparkSession, path: str, model):
        self.spark, self.model = spark, model
        table = lambda what, schema: Table(spark, f"{path}/{what}", spark.createDataFrame([], schema).schema)
        self.asked, self.said = table("in", "job string, key string, prompt string"), table("out", "job string, key string, reply string")

    def _jobs(self, table: Table) -> set[str]:
        return {r["job"] for r in table.read().select("job").distinct().collect()}

    def submit_all(self, prompts: DataFrame) -> None:
        self.asked.append(prompts.where(~F.col("job").isin(sorted(self._jobs(self.asked)))), ["key"])

    def work(self) -> None:
        """What a service does in its own time."""
        from tessera.experts import batched

        asked = self.asked.read().where(~F.col("job").isin(sorted(self._jobs(self.said))))
        self.said.append(batched(asked, self.model).select("job", "key", "reply"), ["key"])

    def all_done(self) -> set[str]:
        return self._jobs(self.said)

    def all_replies(self) -> DataFrame:
        return self.said.read()
