"""Recordings as samples: decoding, slicing, resampling, and features of their quality; one recording at a time in memory."""

from __future__ import annotations

import base64
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples of a frame and of a step, and limits of quality.
FRAME, HOP = 2048, 512
#: Fixed value: bytes of slices that a task holds before it hands them on.
HELD = 4 << 20
#: Fixed value: frames of clips of one length that are looked at together.
TOGETHER = 512
LOUD, FULL = 0.80, 0.90
SHORTEST, MOST_CLIPPED, MOST_LOUD, MOST_ACTIVE, LEAST_RATIO = 0.5, 0.005, 0.0005, 0.8, 5.0


def decoded(content: bytes) -> tuple[np.ndarray, int]:
    """(mono samples from -1 to 1 as float32, rate) of a WAV file of 8, 16, 24 or 32 bits; channels are averaged."""
    with wave.open(io.BytesIO(content)) as f:
        rate, channels, width, raw = f.getframerate(), f.getnchannels(), f.getsampwidth(), f.readframes(f.getnframes())
    if width == 1:
        samples = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        samples = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
    else:
        samples = np.frombuffer(raw, {2: np.int16, 4: np.int32}[width]).astype(np.float32) / (1 << 8 * width - 1)
    return samples.reshape(-1, channels).mean(axis=1) if channels > 1 else samples, rate


def encoded(samples: np.ndarray, rate: int) -> bytes:
    """A WAV file of 16 bits; samples beyond -1 and 1 are clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.clip(samples * 32767, -32768, 32767).astype(np.int16).tobytes())
    return out.getvalue()


def resampled(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate, by linear interpolation after an average over the steps where the rate falls."""
    if rate == to or not len(samples):
        return samples
    if to < rate:
        width = rate // to
        if width > 1:
            sums = np.concatenate(([0.0], np.cumsum(samples, dtype=np.float64)))
            low, high = np.maximum(np.arange(len(samples)) - width // 2, 0), np.minimum(np.arange(len(samples)) + width - width // 2, len(samples))
            samples = ((sums[high] - sums[low]) / (high - low)).astype(np.float32)
    at = np.arange(int(len(samples) * to / rate)) * (rate / to)
    return np.interp(at, np.arange(len(samples)), samples).astype(np.float32)


def _of(kind: str, one):
    """A column function from a function of one value; a null or a file that can't be read gives null."""

    @F.pandas_udf(kind)
    def run(batch):
        import pandas as pd

        def safe(x):
            try:
                return None if x is None else one(x)
            except (wave.Error, EOFError, KeyError, ValueError):
                return None

        return pd.Series([safe(x) for x in batch], dtype=object)

    return run


def duration(content: Column) -> Column:
    """Seconds of a recording, from its header alone; null if it can't be read."""

    def seconds(raw: bytes) -> float:
        with wave.open(io.BytesIO(raw)) as f:
            return f.getnframes() / f.getframerate()

    return _of("double", seconds)(content)


def duration_line(seconds: Column) -> Column:
    """A line that tells how long a track is, '' if that isn't known."""
    whole = seconds.cast("long")
    return F.when(whole.isNotNull(), F.format_string("Track duration: %d min %d sec (%d sec total)", F.floor(whole / 60), whole % 60, whole)).otherwise("")


def slices(windows: DataFrame, files: DataFrame, rate: int = 16_000) -> DataFrame:
    """``windows`` (clip_id, name, lo, hi and any others) with ``audio``: base64 of a 16-bit WAV of the window at ``rate``, and ``n_samples``; null where the recording is missing or can't be read.

    Windows and recordings (name, content) meet by name, and each recording is decoded once for all of its windows; slices
    are not shuffled.  They are handed on ``HELD`` bytes at a time, whether one recording has them or many.
    """
    asked = windows.where("name is not null").groupBy("name").agg(F.collect_list(F.struct(*windows.columns)).alias("w"))
    kind = windows.schema.add("audio", "string").add("n_samples", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, audio, counts, held = [], [], [], 0

        def ready() -> pa.RecordBatch:
            rows = pa.concat_arrays(told)
            return pa.record_batch([*rows.flatten(), pa.array(audio, pa.string()), pa.array(counts, pa.int64())], names=[*[f.name for f in rows.type], "audio", "n_samples"])

        for batch in batches:
            for content, asked in zip(batch.column("content"), batch.column("w"), strict=True):
                try:
                    samples, own = decoded(content.as_py() or b"")
                except (wave.Error, EOFError, KeyError, ValueError):
                    samples, own = None, 0
                rows, first = asked.values, 0
                for k, (lo, hi) in enumerate(zip(rows.field("lo").to_pylist(), rows.field("hi").to_pylist(), strict=True)):
                    part = None if samples is None or lo is None or hi is None else resampled(samples[int(float(lo) * own) : int(float(hi) * own)], own, rate)
                    audio.append(None if part is None else base64.b64encode(encoded(part, rate)).decode())
                    counts.append(None if part is None else len(part))
                    held += 64 + len(audio[-1] or "")
                    if held >= HELD:
                        told.append(rows.slice(first, k + 1 - first))
                        yield ready()
                        told, audio, counts, held, first = [], [], [], 0, k + 1
                told.append(rows.slice(first))
        if audio:
            yield ready()

    # The join holds the lists of windows in memory, not the recordings, and sends neither through the driver, whatever their files' size says.
    cut = files.select("name", "content").join(asked.hint("shuffle_hash"), "name", "right").select("content", "w").mapInArrow(run, kind)
    nameless = windows.where("name is null").withColumns({"audio": F.lit(None).cast("string"), "n_samples": F.lit(None).cast("long")})
    return cut.unionByName(nameless)


def _frames(samples: np.ndarray) -> np.ndarray:
    padded = np.pad(samples.astype(np.float64), ((0, 0), (FRAME // 2, FRAME // 2)))
    return np.lib.stride_tricks.sliding_window_view(padded, FRAME, axis=-1)[:, ::HOP]


def longest_run(flags: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def _percentile(rows: np.ndarray, q: float) -> np.ndarray:
    """A percentile of each row, by linear interpolation."""
    return np.percentile(rows, q, axis=-1)


def qualities(samples: np.ndarray, rate: int) -> list[dict]:
    """Features of clips of one length (a row each) and the first reason to reject them ('' for none), with a score, higher is better.

    Ratio of loud to quiet frames in decibels, shares of clipped and of nearly clipped samples and the longest run of
    these, share of active frames, onsets (rises of a frame's energy beyond its surroundings), flatness of the quiet frames' spectra.
    """
    if samples.shape[1] < rate * SHORTEST:
        return [{"reject": "too short"} for _ in samples]
    frames = _frames(samples)
    rms = np.sqrt((frames**2).mean(axis=-1))
    level = 20 * np.log10(np.maximum(rms + 1e-9, 1e-5))
    level = np.maximum(level, level.max(axis=-1, keepdims=True) - 80)
    ratio = _percentile(level, 90) - _percentile(level, 10)
    clipped, loud = (np.abs(samples) > FULL).mean(axis=-1), np.abs(samples) > LOUD
    active = (rms > _percentile(rms, 30)[:, None] * 3).mean(axis=-1)
    rise = np.maximum(np.diff(level, prepend=level[:, :1]), 0)
    around = np.stack([rise[:, max(0, k - 8) : k + 9].mean(axis=-1) for k in range(rise.shape[1])], axis=-1)
    none = np.zeros((len(rise), 1))
    peak = (rise > around + 3) & (rise >= np.concatenate((rise[:, 1:], none), axis=1)) & (rise > np.concatenate((none, rise[:, :-1]), axis=1))
    spectrum = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=-1)) ** 2 + 1e-10
    flat = np.exp(np.log(spectrum).mean(axis=-1)) / spectrum.mean(axis=-1)
    quiet = rms < _percentile(rms, 25)[:, None]
    out = []
    for k in range(len(samples)):
        flatness = float(flat[k][quiet[k]].mean() if quiet[k].any() else flat[k].mean())
        r, c, near, a, onsets = float(ratio[k]), float(clipped[k]), float(loud[k].mean()), float(active[k]), int(peak[k].sum())
        reasons = [("clipping", c > MOST_CLIPPED), ("saturation", near > MOST_LOUD), ("no_onset", not onsets), ("always_active", a > MOST_ACTIVE), ("low_snr", r < LEAST_RATIO)]
        score = r - c * 500 - abs(a - 0.25) * 10 - flatness * 20
        out.append({"snr": r, "clipping": c, "near_saturation": near, "longest_run": longest_run(loud[k]), "active": a, "onsets": onsets, "flatness": flatness, "duration": samples.shape[1] / rate, "reject": next((name for name, bad in reasons if bad), ""), "score": score})
    return out


def quality(samples: np.ndarray, rate: int) -> dict:
    """The same of one clip."""
    return qualities(samples[None, :], rate)[0]


QUALITY = "snr double, clipping double, near_saturation double, longest_run long, active double, onsets long, flatness double, duration double, reject string, score double"


def quality_table(files: DataFrame, key: str = "name", content: str = "content") -> DataFrame:
    """(key, features) of each recording; one that can't be read is rejected as "error"."""
    kinds = {"double": pa.float64(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(key, pa.string())] + [(f.split()[0], kinds[f.split()[1]]) for f in QUALITY.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = [{"reject": "error"}] * batch.num_rows
            alike: dict[tuple[int, int], list] = {}  # clips of one length are looked at together, some megabytes at a time

            def look(length: int, rate: int, clips: list) -> None:
                for (k, _), found in zip(clips, qualities(np.stack([x for _, x in clips]), rate), strict=True):
                    rows[k] = found  # noqa: B023

            for k, raw in enumerate(batch.column(1)):
                try:
                    samples, rate = decoded(raw.as_py() or b"")
                except (wave.Error, EOFError, KeyError, ValueError):
                    continue
                clips = alike.setdefault((len(samples), rate), [])
                clips.append((k, samples))
                if len(clips) * (len(samples) // HOP + 1) >= TOGETHER:
                    look(len(samples), rate, alike.pop((len(samples), rate)))
            for of, clips in alike.items():
                look(*of, clips)
            yield pa.RecordBatch.from_pylist([{key: name, **found} for name, found in zip(batch.column(0).to_pylist(), rows, strict=True)], schema=schema)

    return files.select(F.col(key).cast("string").alias(key), content).mapInArrow(run, f"{key} string, {QUALITY}")


def best_clean(scores: DataFrame, pool: int) -> DataFrame:
    """The ``pool`` best by score, and of these those that nothing rejects: the pool is cut before the rejects go."""
    return scores.where("score is not null").orderBy(F.col("score").desc(), "name").limit(pool).where("reject = ''")


def clip_paths(path: Column) -> Column:
    """struct(date, person, file) of a path .../date/person/file."""
    parts = F.split(path, "/")
    return F.struct(F.element_at(parts, -3).alias("date"), F.element_at(parts, -2).alias("person"), F.element_at(parts, -1).alias("file"))


def event_label(probabilities: Column, threshold: float = 0.5, what: str = "cough") -> Column:
    """struct(primary, max_prob): how many of a segment's events are likely ("n cough" or "no cough"), and the likeliest; 0 without events."""
    n = F.size(F.filter(probabilities, lambda p: p >= threshold))
    return F.struct(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}"))).otherwise(f"no {what}").alias("primary"), F.coalesce(F.array_max(probabilities), F.lit(0.0)).alias("max_prob"))


def steps(length: Column, width: int, step: int) -> Column:
    """Starts of windows of ``width`` every ``step`` over ``length`` samples; a shorter recording has one at 0."""
    last = F.greatest(F.lit(1), length - width + 1) - 1
    return F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))
