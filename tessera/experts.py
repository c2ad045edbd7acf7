"""Contracts of models that plug in, and stand-ins that need none.

Each contract is a batch function over Arrow or pandas columns, made once per partition so a model loads once: speech to text
(bytes -> string), diarisation (bytes -> turns), embedding (bytes or string -> array<float>), labelling (bytes -> labels), answering
and judging (prompt -> string).  A null input gives a null output; a failed input gives null too and isn't retried.
"""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

Maker = Callable[[], Callable]


class Transcriber(Protocol):
    """Samples and their rate to text."""

    def __call__(self, samples: np.ndarray, rate: int) -> str: ...


class Embedder(Protocol):
    """Samples and their rate to a vector of a fixed length."""

    def __call__(self, samples: np.ndarray, rate: int) -> list[float]: ...


class TextEmbedder(Protocol):
    def __call__(self, text: str) -> list[float]: ...


class Diariser(Protocol):
    """A recording's bytes to turns (start, end, speaker): a table function."""

    def __call__(self, content: bytes) -> list[tuple[float, float, str]]: ...


class Labeler(Protocol):
    """Samples and their rate to labels; None for what it doesn't tell."""

    def __call__(self, samples: np.ndarray, rate: int) -> dict[str, str | None]: ...


class LanguageModel(Protocol):
    """Prompts to replies, in one batch; judges are language models that answer YES or NO."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


@dataclass(frozen=True)
class Task:
    """What a task tells its prompts, and how its truth is shown."""

    name: str
    description: str
    schema: str
    tools: dict[str, str]
    hide_speaker: frozenset[str] = frozenset()


TASKS = {
    "emotion": Task("emotion", "Answer questions about how speakers of a long recording feel.", "Segments have a class of emotion, vote shares, and levels of valence, arousal and dominance from 0 to 1.", {"time": "segments of a window", "label": "segments of an emotion", "keyword": "segments with a word", "text_emb": "segments about something", "audio_emb": "segments that sound like a clip", "domain_emb": "segments as emotional as a clip"}, frozenset({"locate_hard"})),
    "music": Task("music", "Answer questions about the songs of a long medley.", "Segments are songs or parts of them, with scores from 1 to 5.", {"time": "segments of a window", "label": "segments of a level", "audio_emb": "segments that sound like a clip", "domain_emb": "segments of a similar quality"}),
    "health": Task("health", "Answer questions about a consultation.", "Segments count the coughs that are heard in them.", {"time": "segments of a window", "label": "segments with a sound", "keyword": "segments with a word", "text_emb": "segments about something"}),
}


def from_config(config: dict) -> object:
    """The class or function that ``_target_`` names, called with the other entries."""
    module, _, name = config["_target_"].rpartition(".")
    return getattr(importlib.import_module(module), name)(**{k: v for k, v in config.items() if k != "_target_"})


def mapped(make: Maker, kind: str) -> Callable[[Column], Column]:
    """A column function from a maker of a function over one value; the maker runs once per partition."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()

        def one(x):
            try:
                return None if x is None else model(x)
            except Exception:  # a failed input is a null, as documented
                return None

        for batch in batches:
            yield pd.Series([one(x) for x in batch], dtype=object)

    return run


def pairs(make: Maker, kind: str) -> Callable[[Column], Column]:
    """As ``mapped``, for a function that gives a tuple of the fields of ``kind``."""
    names = [f.split()[0] for f in kind.split(", ")]

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            yield pd.DataFrame([(None,) * len(names) if x is None else model(x) for x in batch], columns=names)

    return run


def batched(prompts: DataFrame, make: Maker, out: str = "reply", prompt: str = "prompt", size: int = 64) -> DataFrame:
    """``prompts`` with replies of a model that takes lists; ``size`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            asked, replies = batch.column(prompt).to_pylist(), []
            for k in range(0, len(asked), size):
                replies += model(asked[k : k + size])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string())], names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInArrow(run, f"{fields}, `{out}` string")


def diarised(recordings: DataFrame, make: Maker, key: str = "episode_id", content: str = "content") -> DataFrame:
    """One recording to its turns: (key, turn_idx, start, end, speaker)."""

    schema = pa.schema([(key, pa.string()), ("turn_idx", pa.int32()), ("start", pa.float64()), ("end", pa.float64()), ("speaker", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            rows = [(k, i, *t) for k, c in pairs if c is not None for i, t in enumerate(model(c))]
            yield pa.record_batch([pa.array([r[n] for r in rows], f.type) for n, f in enumerate(schema)], schema=schema)

    return recordings.select(key, content).mapInArrow(run, f"{key} string, turn_idx int, start double, `end` double, speaker string")


def stand_in_embedder(dimension: int = 8) -> Callable:
    """Text or bytes to a unit vector drawn from its hash."""

    def embed(x) -> list[float]:
        raw = hashlib.sha256(x.encode() if isinstance(x, str) else bytes(x)).digest()
        v = np.frombuffer((raw * (dimension // 32 + 1))[:dimension], np.uint8).astype(float) - 127.5
        return (v / np.linalg.norm(v)).tolist()

    return embed


def stand_in_judge() -> Callable:
    """YES where the prompt's expected answer stands in its prediction (lines ``Expected:`` and ``Prediction:``), else NO."""

    def judge(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            fields = dict(line.split(": ", 1) for line in p.splitlines() if ": " in line)
            out.append("Answer: YES" if fields.get("Expected", "").strip().lower() and fields["Expected"].strip().lower() in fields.get("Prediction", "").lower() else "Answer: NO")
        return out

    return judge


def turn_function(spark: SparkSession, name: str, make: Maker) -> None:
    """Registers a table function: ``SELECT * FROM name(TABLE(recordings) PARTITION BY episode_id)`` gives the turns of each recording (episode_id, content).

    Turns are numbered over all rows of an episode in the order they come in; the maker runs once for each task, and a recording that
    can't be read has no turns.
    """

    class Turns:
        def __init__(self):
            self.model, self.n = make(), 0

        def eval(self, row: Row):
            try:
                found = self.model(bytes(row["content"])) if row["content"] is not None else []
            except Exception:  # as documented
                found = []
            for start, end, speaker in found:
                yield str(row["episode_id"]), self.n, float(start), float(end), speaker
                self.n += 1

    spark.udtf.register(name, F.udtf(Turns, returnType="episode_id string, turn_idx int, start double, `end` double, speaker string"))
