"""Periodic runs: stretches of words that repeat themselves with a period, found exactly, and texts without the repeats.

A run is a stretch of at least ``max(LEAST, TIMES * q)`` consecutive words whose smallest period is q and that no neighbouring
word extends.  A run of period q equals itself moved by q words on ``max(LEAST, TIMES * q) - q`` words or more, so each of its
words lies in a k-gram that the document has twice, where k is the least such overlap over all q (16 words for 24 and 3).
Words outside such k-grams are masked: no run reaches over them.  Stretches between masked words are searched by divide and
conquer after Main and Lorentz: a run that crosses the middle of a part has its whole period on one side of it, so for each
period the longest common extensions of two places, to both sides, tell the run; all periods of a middle are tested at once
by prefix hashes.  What is found is compared word by word.

Words are what ASCII white space separates.  Defined cases: null, empty and blank texts have no words and no runs; texts of
any length work, in memory of some multiples of one text; rows, ids and other columns pass through as they are, repeated
rows alike; a column of a name that is added (``n_words``, ``runs``, ``kept_text``) is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, words

LEAST, TIMES = 24, 3
#: An odd factor of polynomial hashes modulo 2 ** 64, and its inverse.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))
FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string"


def overlap(least: int = LEAST, times: int = TIMES) -> int:
    """The fewest words on which a run equals itself moved by its period."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


class WordHashes:
    """Hashes of all words of a text at once, from prefix sums over its bytes; equal words have equal hashes."""

    block = 1 << 20
    spaces = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))

    def __init__(self):
        self.powers = self.inverses = np.ones(0, np.uint64)

    def _raise(self, n: int) -> None:
        """Powers of the factor and of its inverse, n or more."""
        if len(self.powers) <= n:
            one = np.ones(1, np.uint64)
            self.powers, self.inverses = (np.cumprod(np.concatenate((one, np.full(2 * n, x, np.uint64)))) for x in (FACTOR, INVERSE))

    def of(self, data: np.ndarray) -> np.ndarray:
        """Hashes of the words of some bytes."""
        self._raise(len(data))
        blank = np.concatenate(([True], self.spaces[data], [True]))
        turns = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = turns[::2], turns[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)])))
        return mix((sums[ends] - sums[starts]) * self.inverses[starts])

    def __call__(self, text: bytes) -> np.ndarray:
        """Hashes of all words, block by block; blocks end at white space."""
        data, out, at = np.frombuffer(text, np.uint8), [np.zeros(0, np.uint64)], 0
        while at < len(data):
            end = at + self.block
            while end < len(data) and not self.spaces[data[end]]:
                end += 1
            out.append(self.of(data[at:end]))
            at = end
        return np.concatenate(out)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, by doubling: two stretches of a power of two cover k."""
    width, factor, out = 1, int(FACTOR), hashes
    while 2 * width <= k:
        out, width, factor = out[:-width] * np.uint64(factor) + out[width:], 2 * width, factor * factor % (1 << 64)
    return out if width == k else out[: len(hashes) - k + 1] * np.uint64(factor) + out[k - width : len(hashes) - width + 1]


def surviving(hashes: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Stretches (from, to) of words in k-grams that occur twice."""
    if len(hashes) <= k:
        return []
    found = grams(hashes, k)
    order = np.argsort(found)
    in_order = found[order]
    same = in_order[1:] == in_order[:-1]
    if not same.any():
        return []
    twice = np.zeros(len(found) + 1, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + k, -1)
    inside = np.concatenate(([False], np.cumsum(edges[:-1]) > 0, [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


class Extensions:
    """How far two places of a sequence agree, to the right and to the left, by prefix hashes; for many places at once."""

    def __init__(self, names: np.ndarray):
        self.n = len(names)
        self.powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(self.n, FACTOR, np.uint64))))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(names + FACTOR) * self.powers[:-1])))

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """True where ``size`` words from a and from b are equal, for a <= b."""
        return (self.sums[a + size] - self.sums[a]) * self.powers[b - a] == self.sums[b + size] - self.sums[b]

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from a and from b on, a <= b."""
        got = np.zeros(len(a), np.int64)
        step = 1 << max(0, self.n.bit_length() - 1)
        while step:
            at = np.flatnonzero(b + got + step <= self.n)
            at = at[self.equal(a[at] + got[at], b[at] + got[at], step)]
            got[at] += step
            step >>= 1
        return got

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree before a and before b, a <= b."""
        got = np.zeros(len(a), np.int64)
        step = 1 << max(0, self.n.bit_length() - 1)
        while step:
            at = np.flatnonzero(a - got - step >= 0)
            at = at[self.equal(a[at] - got[at] - step, b[at] - got[at] - step, step)]
            got[at] += step
            step >>= 1
        return got


def crossing(names: np.ndarray, ext: Extensions, low: int, middle: int, high: int, known: list[tuple[int, int, int]], least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """Runs (start, end, period) over the middle of a part: by periods that fit right of it, then by those that fit left of it.

    Inside a run of period q, multiples of q lead to that run again: once it is known they aren't tried.
    """
    most = len(names) // times
    after = np.flatnonzero(names[middle : min(high, middle + most)] == names[middle - 1]) + 1
    before = middle - np.arange(1, min(middle - low, most) + 1)
    before = middle - before[names[before] == names[middle]]
    known = [r for r in known if r[0] < middle < r[1]]
    for periods, sign in ((after, 1), (before, -1)):
        for start, end, q in known:
            periods = periods[(periods % q != 0) | (periods > (end - middle if sign > 0 else middle - start))]
        if not len(periods):
            continue
        a = middle - periods if sign < 0 else np.full(len(periods), middle)
        b = a + periods
        half = (np.maximum(least - periods, (times - 1) * periods) + 1) // 2  # one of the two extensions has as much
        near = np.zeros(len(periods), bool)
        for fits, back in ((b + half <= len(names), 0), (a >= half, 1)):
            at = np.flatnonzero(fits & ~near)
            near[at] = ext.equal(a[at] - back * half[at], b[at] - back * half[at], half[at])
        periods = periods[near]
        while len(periods):
            some = periods[:1] if len(periods) > 4 else periods
            a = middle - some if sign < 0 else np.full(len(some), middle)
            left, right = ext.left(a, a + some), ext.right(a, a + some)
            long = left + right >= np.maximum(least - some, (times - 1) * some)
            new = []
            for start, end, q in zip((a - left)[long].tolist(), (a + some + right)[long].tolist(), some[long].tolist(), strict=True):
                if exact(names, start, end, q):
                    new.append((start, end, q))
                else:  # two hashes were equal by chance
                    yield from ((x, y, q) for x, y in stretches(names, q, least, times))
            yield from new
            known = known + new
            periods = periods[len(some) :]
            for start, end, q in new:
                periods = periods[(periods % q != 0) | (periods > (end - middle if sign > 0 else middle - start))]


def exact(names: np.ndarray, start: int, end: int, q: int) -> bool:
    """True if the stretch has the period and can't be extended, compared word by word."""
    inside = (names[start : end - q] == names[start + q : end]).all()
    return bool(inside and (not start or names[start - 1] != names[start + q - 1]) and (end == len(names) or names[end] != names[end - q]))


def stretches(names: np.ndarray, q: int, least: int, times: int) -> Iterator[tuple[int, int]]:
    """Every stretch (start, end) of period q that is long enough and can't be extended, by comparing word by word."""
    same = np.concatenate(([False], names[q:] == names[:-q], [False]))
    turns = np.flatnonzero(same[1:] != same[:-1])
    for start, end in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        if end + q - start >= max(least, times * q):
            yield start, end + q


def main_lorentz(names: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of integers, by start and period."""
    ext, found, parts = Extensions(names.astype(np.uint64)), set(), [(0, len(names), [])]
    while parts:
        low, high, known = parts.pop()
        if high - low < least:
            continue
        middle = (low + high) // 2
        new = set(crossing(names, ext, low, middle, high, known, least, times))
        found |= new
        known = [*known, *new]
        parts += [(x, y, [r for r in known if r[0] < y and r[1] > x]) for x, y in ((low, middle), (middle, high))]
    smallest: dict[tuple[int, int], int] = {}
    for start, end, q in found:
        smallest[start, end] = min(q, smallest.get((start, end), q))
    return sorted((start, end - start, q) for (start, end), q in smallest.items())


def runs_of(text: bytes | None, hashed: WordHashes, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a text's words, by start and period."""
    hashes = hashed(text or b"")
    if len(hashes) < least:
        return []
    out, tokens = [], []
    for low, high in surviving(hashes, overlap(least, times)):
        if high - low >= least:
            tokens = tokens or words(text)
            ids: dict[bytes, int] = {}
            names = np.fromiter((ids.setdefault(w, len(ids)) for w in tokens[low:high]), np.int64, high - low)
            out += [(low + start, length, q) for start, length, q in main_lorentz(names, least, times)]
    return out


def without_repeats(tokens: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that lie in no run after its first period."""
    if not runs:
        return tokens
    keep = np.ones(len(tokens), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return [tokens[k] for k in np.flatnonzero(keep)]


def found(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period: by start, then period) and kept_text (kept words joined by one space)."""
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("kept_text", pa.string())])

    @F.arrow_udf(f"struct<{FOUND.replace(' long,', ':long,', 1).replace('runs array', 'runs:array').replace('kept_text ', 'kept_text:')}>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashed = WordHashes()
        for texts in batches:
            counts, offsets, flat, kept = [], [0], [], []
            for text in texts.cast(pa.binary()):
                text = text.as_py()
                tokens = words(text)
                runs = runs_of(text, hashed, least, times)
                counts.append(len(tokens))
                flat += runs
                offsets.append(len(flat))
                kept.append(b" ".join(without_repeats(tokens, runs)))
            columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(run_type)))
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())], fields=list(kind))

    got = docs.select("*", search(F.col(text_col)).alias("_found of runs"))
    return got.withColumns({c: got["_found of runs"][c] for c in ("n_words", "runs", "kept_text")}).drop("_found of runs")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a periodic tail in a tenth of the texts.  h = crc32(id); if h % 10 = 0, words from a on repeat the p words from there."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    w = F.filter(F.split(text_col, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    n, g = F.size("_w"), F.floor(F.col("_h") / 10)
    rows = docs.withColumn("_h", h).withColumn("_w", F.when((F.col("_h") % 10 == 0) & F.col(text_col).isNotNull(), w))
    rows = rows.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", F.when(n > 0, 1 + F.floor((n - F.col("_a")) / (3 + g % 8))))
    tail = F.transform(F.sequence(F.col("_a"), n.cast("long") - 1), lambda i: F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    told = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a").cast("int")), tail), " ")
    return rows.withColumn(text_col, F.when(n > 0, told).otherwise(F.col(text_col))).drop("_h", "_w", "_a", "_p")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document, of (doc_id, text) with planted tails: runs, the one with most periods, digests of runs and kept words."""
    rows = found(planted(docs.select("doc_id", "text"))).withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<start:long,length:long,period:long>>")))
    milli = lambda r: F.floor(1000 * r["length"] / r["period"]).cast("long")

    def better(a, b):
        """The run with the greater length / period, compared without division; then by start and period."""
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(a.isNull() | (y > x) | ((y == x) & (F.struct(b["start"], b["period"]) < F.struct(a["start"], a["period"]))), b).otherwise(a)

    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    out = rows.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli(F.col("best")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
