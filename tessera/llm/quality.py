"""Quality classifier: ordinal regression with cumulative links over hashed text.

A document's grade is 0 (toxic), 1 (poor) or 2 (good).  One weight per hashed feature gives a score s; ordered thresholds
t0 < t1 give P(grade <= k) = sigmoid(t_k - s), so all grades share the weights.  Features are, over whole texts with A-Z in
lower case: each word without its punctuation, its first letters, the marks in it, beginnings that different words share,
and shares of the words that have a shape (again: equal to the one before; capitals; marked: two marks or more; bare: marks
only), as steps.  Training: labelled documents joined to the texts, at most ``SAMPLE`` different ones with ``SAMPLE_BYTES`` of
text (those with the least hashes of id and text: the only bounds here, on rows and bytes alike); the model goes out as an array of ``1 << BITS`` numbers.  Every document is scored.

A document is rejected if P(grade <= 0) or P(grade <= 1) is above its limit.  Features that don't tell grades apart weigh
nothing, so a long or a very short clean text isn't held against its document.  Defined cases: null and empty texts have no
features and are kept with the score 0's grades; null ids or grades in labels are left out, of equal ids the least grade
counts; rows with one id are each scored, and each different text of them may be trained on; texts of any length work, in memory of a few times one
text; an empty table gives an empty result; other columns, whatever their names, pass through (``accepted``) or don't matter;
without any labels all documents are kept.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh

BITS = 18
#: Different graded texts that are fitted, and bytes of them.
SAMPLE, SAMPLE_BYTES = 12_000, 256_000_000
#: Steps of gradient descent, and the weight decay.
STEPS, RATE, DECAY = 300, 0.05, 1e-5
#: Least chi-square of a feature that gets a weight.
TELLING = 25.0
#: A document is rejected beyond these: P(grade <= 0), P(grade <= 1).
TOXIC, POOR = 0.2, 0.5
GRADES = 3
LOWER = bytes(i + 32 * (64 < i < 91) for i in range(256))
#: The ASCII marks, and all bytes but those.
MARKS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
OTHER = bytes(sorted(set(range(256)) - set(MARKS)))


#: Shapes of words that are counted, and the shares of a text's words from which on a shape is a feature.
SHAPES = (b"again", b"capitals", b"marked", b"bare")
SHARES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75)


def hashed(name: bytes) -> int:
    return xxhash.xxh3_64_intdigest(name) >> 64 - BITS


#: The hashed features of each shape, by rising shares.
SHAPE_FEATURES = [[hashed(b"s" + shape + b"%d" % k) for k in range(len(SHARES))] for shape in SHAPES]


class Features(dict):
    """Hashed features of each word (bytes), the hash of its first letters (0: too short), and its shapes; with ``weights``, only features whose weight isn't 0."""

    def __init__(self, weights: np.ndarray | None = None):
        super().__init__()
        self.telling = None if weights is None else frozenset(np.flatnonzero(weights).tolist())
        self.limit = 150_000 if weights is None else 500_000
        self.plain = ((), (), 0, 0, 0)  # most words have no feature that counts: they share one value
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.shared: dict[tuple, tuple] = {self.plain: self.plain}
        self.begun: list[dict[bytes, int]] = [{}, {}, {}, {}]  # features of beginnings, -1 for those that don't count

    def counts(self, name: bytes) -> int:
        """The feature of a name, -1 if it doesn't count."""
        k = hashed(name)
        return k if self.telling is None or k in self.telling else -1

    def beginning(self, place: int, mark: bytes, head: bytes) -> int:
        known = self.begun[place]
        if (k := known.get(head)) is None:
            k = known[head] = self.counts(mark + head)
        return k

    def __missing__(self, word: bytes) -> tuple[tuple[int, ...], tuple[int, ...], int, int, int]:
        if len(self) >= self.limit:
            self.empty()
        bare = word.translate(LOWER, MARKS)
        found, twice, marked = [self.counts(b"w" + bare)], (), len(word) - len(bare)
        if len(bare) >= 4:
            found.append(self.beginning(0, b"4", bare[:4]))
            if len(bare) >= 5:
                found.append(self.beginning(1, b"5", bare[:5]))
                if len(bare) >= 6:
                    found.append(self.beginning(2, b"6", bare[:6]))
                    if (k := self.beginning(3, b"2", bare[:6])) >= 0:
                        twice = (k,)
                    if len(bare) >= 8:
                        found.append(self.counts(b"8" + bare[:8]))
        if marked and (marks := word.translate(None, OTHER)) not in (b".", b","):
            found.append(self.counts(b"m" + marks))
        capitals = len(bare) > 1 and word.isupper()
        if capitals:
            found.append(self.counts(b"U"))
        value = (tuple([x for x in found if x >= 0]), twice, int(capitals), int(marked > 1), int(not bare))
        self[word] = value = self.shared.setdefault(value, value) if self.telling is not None else value
        return value


def features(text: bytes | None, seen: Features) -> np.ndarray:
    """What words, beginnings and marks a text has, which beginnings different words share, and what share of its words has each shape."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int32)
    counted = Counter(words)
    found: set[int] = set()
    begun: set[int] = set()
    capitals = marked = bare = 0
    plain = seen.plain
    for word, n in counted.items():
        value = seen[word]
        if value is plain:
            continue
        own, twice, a, b, c = value
        found.update(own)
        for x in twice:
            if x in begun:
                found.add(x)
            begun.add(x)
        capitals, marked, bare = capitals + a * n, marked + b * n, bare + c * n
    again = sum(map(eq, words, islice(words, 1, None)))
    for count, names in zip((again, capitals, marked, bare), SHAPE_FEATURES, strict=True):
        found.update(names[: bisect_right(SHARES, count / len(words))])
    return np.fromiter(found, np.int32, len(found))


class Model:
    """Weights and thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def score(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum(dtype=np.float64))

    def at_most(self, score: float) -> np.ndarray:
        """P(grade <= k) of each k but the last."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds - score, -500, 500)))

    @staticmethod
    def _telling(which: np.ndarray, lengths: np.ndarray, grades: np.ndarray) -> np.ndarray:
        """True for each feature whose presence depends on the grade, by Pearson's chi-square; other words get no weight at all."""
        of = np.repeat(grades.astype(np.int8), lengths)
        seen = np.stack([np.bincount(which[of == k], minlength=1 << BITS) for k in range(GRADES)]).astype(float)
        count = np.bincount(grades, minlength=GRADES)
        share = seen.sum(axis=0) / count.sum()
        expected = share * count[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = ((seen - expected) ** 2 / np.where(expected > 0, expected * (1 - share), np.inf)).sum(axis=0)
        return np.nan_to_num(chi) > TELLING

    @staticmethod
    def likelihood(weights: np.ndarray, gaps: np.ndarray, owner: np.ndarray, slot: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray]:
        """The mean negative log-likelihood with weight decay, and its gradient by weights and gaps.

        ``owner`` and ``slot``: document and weight of each feature; ``gaps``: the first threshold and the logs of the distances to the next.
        """
        n, rows = len(grades), np.arange(len(grades))
        t = np.concatenate(([gaps[0]], gaps[0] + np.cumsum(np.exp(gaps[1:]))))
        s = np.bincount(owner, weights[slot], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(t[None, :] - s[:, None], -500, 500)))
        none = np.zeros((n, 1))
        below, slope = np.hstack((none, p, none + 1)), np.hstack((none, p * (1 - p), none))
        likely = np.maximum(below[rows, grades + 1] - below[rows, grades], 1e-9)
        by_s = (slope[rows, grades + 1] - slope[rows, grades]) / likely / n
        by_t = np.array([((grades == k + 1) * slope[:, k + 1] - (grades == k) * slope[:, k + 1]) @ (1 / likely) / n for k in range(GRADES - 1)])
        by_gaps = np.concatenate(([by_t.sum()], np.cumsum(by_t[:0:-1])[::-1] * np.exp(gaps[1:])))
        by_weights = np.bincount(slot, by_s[owner], minlength=len(weights)) + DECAY * weights
        return float(-np.log(likely).mean() + DECAY / 2 * weights @ weights), np.concatenate((by_weights, by_gaps))

    @staticmethod
    def fit(which: np.ndarray, lengths: np.ndarray, grades: np.ndarray) -> Model:
        """Gradient descent (Adam) on the likelihood of the grades, from zeros, over the features that tell grades apart.

        ``which``: features of document after document; ``lengths``: how many each has.
        """
        weights = np.zeros(1 << BITS)
        if not len(grades):
            return Model(weights.astype(np.float32), np.array([-500.0, -499.0]))
        kept = Model._telling(which, lengths, grades)[which]
        owner = np.repeat(np.arange(len(grades), dtype=np.int32), lengths)[kept]
        used, slot = np.unique(which[kept], return_inverse=True)
        state = np.concatenate((np.zeros(len(used)), [-2.0, 0.5]))
        mean, square = np.zeros(len(state)), np.zeros(len(state))
        for step in range(1, STEPS + 1):
            _, gradient = Model.likelihood(state[:-2], state[-2:], owner, slot, grades)
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient**2
            state = state - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights[used] = state[:-2]
        return Model(weights.astype(np.float32), np.array([state[-2], state[-2] + np.exp(state[-1])]))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of ``labels`` (doc_id, quality, toxic)."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))


def _sample(rows: DataFrame, grades: DataFrame, sample: int, most: int = SAMPLE_BYTES) -> DataFrame:
    """(id, of, grade) of at most ``sample`` different graded texts of ``rows`` (id, of, text) and ``most`` bytes of text, by hashes of id and text."""
    ids = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("id"), "grade")
    order = [F.xxhash64("id"), "id", "of"]
    some = rows.join(F.broadcast(ids), "id").groupBy("id", "of").agg(F.first("grade").alias("grade"), F.first(F.octet_length("text")).alias("size")).orderBy(*order).limit(sample)
    sizes = F.sum(F.coalesce("size", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over the sample alone
    return some.withColumn("until", sizes).where(F.col("until") <= most).select("id", "of", "grade")


def train(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the graded documents, or of ``sample`` of them.  The sample's names are broadcast; its features reach the driver."""
    schema = pa.schema([("grade", pa.int32()), ("found", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Features()
        for batch in batches:
            yield pa.record_batch([batch.column("grade"), pa.array([features(x.as_py(), seen) for x in batch.column("text")], pa.list_(pa.int32()))], schema=schema)

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("of"), F.col(text_col).cast("binary").alias("text"))
    got = rows.join(F.broadcast(_sample(rows, grades, sample)), ["id", "of"]).groupBy("id", "of").agg(F.first("grade").alias("grade"), F.first("text").alias("text"))
    got = got.select("grade", "text").mapInArrow(run, "grade int, found array<int>").toArrow()
    found = got["found"].combine_chunks()
    ends = found.offsets.to_numpy().astype(np.int64)
    return Model.fit(found.values.to_numpy()[ends[0] : ends[-1]] if got.num_rows else np.zeros(0, np.int32), np.diff(ends), got["grade"].to_numpy().astype(np.int64))


def judged(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column of each document's expected_grade, p_toxic = P(grade <= 0) and p_poor = P(grade <= 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, p_toxic double, p_poor double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        seen = Features(m.weights)
        for batch in texts:
            scores = np.array([m.score(features(x.encode() if x else None, seen)) for x in batch])
            p = 1 / (1 + np.exp(-np.clip(m.thresholds[None, :] - scores[:, None], -500, 500)))
            yield pd.DataFrame({"expected_grade": (GRADES - 1) - p.sum(axis=1), "p_toxic": p[:, 0], "p_poor": p[:, 1]})

    return judge(F.col(text_col))


def rejected(judged: Column, text: Column) -> Column:
    """Rejected or not; a document without text isn't."""
    return (F.length(F.coalesce(text, F.lit(""))) > 0) & ((judged["p_toxic"] > TOXIC) | (judged["p_poor"] > POOR))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, p_toxic, p_poor, rejected) of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("judged", judged(rows, model))
    return rows.select("doc_id", "judged.*", rejected(F.col("judged"), F.col("text")).alias("rejected"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't rejected."""
    name = fresh(docs, "judged")
    return docs.withColumn(name, judged(docs, model, text_col)).where(~rejected(F.col(name), F.col(text_col))).select(*docs.columns)
