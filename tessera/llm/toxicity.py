"""Toxicity by a weighted grammar of finite-state transducers over clauses.

Words become symbols (insult, threat, target, negation, report or plain), read by three small transducers, composed into one
machine: negation denies what follows within some words, a report turns what follows in the clause into reported speech, and a
target makes an insult or threat one that is aimed, in whichever order they come.  What the machine gives out for a clause are
events, each with the weight of its word; a lone target, negation or report gives none.  A document's features are the weights
of its events by kind, the strongest of them, and their share of the words; a logistic regression turns them into the score.

Cue words of four languages are fixed; insults also are learned: words and beginnings of words that toxic documents have more
often than others, with the log of the odds as weight.  Both are found in the text by one Aho-Corasick automaton, and only
clauses with an insult or a threat are read by the machine.  Learning: at most ``SAMPLE`` labelled rows (distinct by id and
text, by hashes; the only bound on rows), of near copies one each; counts by Spark; ``LEXICON`` entries at most.  The
regression is fitted on a third of them with weights counted on the others, so that a word's weight isn't judged by the texts
that gave it.  What labels say of other rows, languages and sources are no inputs.

Defined cases: null and empty texts, and texts without any cue, get the score of no events; null ids or labels are left out of
learning, of equal ids in labels the toxic one counts, of equal ids in documents every text; without any toxic label the fixed
words and weights decide; texts of any length work, in memory of a few times one text; repeated rows score alike; other columns,
whatever their names, don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log1p

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, stored

PLAIN, INSULT, THREAT, TARGET, NOT, SAID = range(6)
#: Events of clauses.
EVENTS = ("insult", "aimed insult", "threat", "aimed threat", "denied", "reported", "aim")
#: Words that a negation reaches.
SCOPE = 4

# Cue words in English, German, French and Spanish.
CUES = {
    INSULT: "idiot idiots idiotic moron morons moronic stupid dumb imbecile loser losers scum trash garbage clown pathetic worthless disgusting vermin filth crétin crétine salaud ordure dummkopf arschloch vollidiot abschaum widerlich estúpido estúpida imbécil basura escoria asqueroso",
    THREAT: "kill murder strangle exterminate hurt beat destroy töten umbringen verprügeln tuer assassiner frapper matar asesinar golpear",
    TARGET: "you your yours you're he she they him her them his their people everyone du dich dir dein ihr euch euer sie ihn ihm tu toi te vous votre ton ta il elle ils elles lui tú usted ustedes él ella ellos ellas vosotros",
    NOT: "not no never isn't aren't wasn't don't doesn't won't without hardly nicht kein keine keinen nie niemals ohne pas jamais aucun aucune sans nunca jamás ningún ninguna sin tampoco",
    SAID: "said says say called calls wrote writes quoted quotes claimed claims alleged sagte sagt schrieb nannte nennt dit disait écrit appelé dijo dice escribió llamó",
}
FIXED = {word: symbol for symbol, words in CUES.items() for word in words.split()}
#: Weights of fixed insults and threats that labels say nothing of.
GIVEN = {INSULT: 4.0, THREAT: 3.0}

SAMPLE, LEXICON = 20_000, 4_000
#: Least toxic documents with a word, least chi-square, least log of the odds; lengths of beginnings of words.
SUPPORT, TELLING, ODDS, BEGINNINGS = 3, 20.0, 1.0, range(5, 9)
HELD_OUT, LIMIT = 2, 0.3
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
END = re.compile(r"[.!?;:]+(?=[\s\"'»”)]|$)|\n")
#: What the regression leans to: intercept, strongest, density, then the events.
PRIOR = np.array([-4.0, 0.5, 0.5, 0.3, 0.5, 0.3, 0.6, -0.1, -0.1, 0.1])
LEAN = 2.0


class Transducer:
    """A machine that reads a symbol and gives out one: ``step(state, symbol) -> (state, symbol)``, made into tables from its start."""

    def __init__(self, step, start, alphabet):
        states, self.next, self.out = {start: 0}, [], []
        queue = [start]
        for state in queue:
            row, said = [], []
            for symbol in alphabet:
                to, out = step(state, symbol)
                if to not in states:
                    states[to] = len(states)
                    queue.append(to)
                row.append(states[to])
                said.append(out)
            self.next.append(row)
            self.out.append(said)

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one gives out."""

        def step(state, symbol):
            a, b = state
            middle = self.out[a][symbol]
            return (self.next[a][symbol], other.next[b][middle]), other.out[b][middle]

        return Transducer(step, (0, 0), range(len(self.next[0])))

    def read(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for symbol in symbols:
            out.append(self.out[state][symbol])
            state = self.next[state][symbol]
        return out


# Symbols between the transducers, after those of words: what is denied, what is reported; then the events.
DENIED, REPORTED = 6, 7
FIRST_EVENT = 8


def negation() -> Transducer:
    """Insults and threats within ``SCOPE`` words after a negation are denied; a second negation takes the first back."""

    def step(left: int, symbol: int):
        if symbol == NOT:
            return (0 if left else SCOPE), PLAIN
        denied = left > 0 and symbol in (INSULT, THREAT)
        return (0 if denied else max(0, left - 1)), (DENIED if denied else symbol)

    return Transducer(step, 0, range(6))


def report() -> Transducer:
    """After a verb of speech, insults and threats are someone else's."""
    return Transducer(lambda told, s: (told or s == SAID, REPORTED if told and s in (INSULT, THREAT) else PLAIN if s == SAID else s), False, range(8))


def target() -> Transducer:
    """Insults and threats after a target are aimed; a target after an unaimed one aims it."""

    def step(state: tuple[bool, bool], s: int):
        aimed, open_ = state
        if s == TARGET:
            return (True, False), (FIRST_EVENT + 6 if open_ else PLAIN)
        if s in (INSULT, THREAT):
            return (aimed, not aimed), FIRST_EVENT + 2 * (s == THREAT) + aimed
        return state, {DENIED: FIRST_EVENT + 4, REPORTED: FIRST_EVENT + 5}.get(s, PLAIN)

    return Transducer(step, (False, False), range(8))


GRAMMAR = negation().then(report()).then(target())


def stems(word: str) -> list[str]:
    """A word and its beginnings, which end in a dash."""
    return [word, *[word[:k] + "-" for k in BEGINNINGS if len(word) >= k]]


class Lexicon:
    """Weighted cue words, and an automaton that finds them in lower-case text."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned
        self.automaton = ahocorasick.Automaton()
        for stem in {*learned, *[w for w, s in FIXED.items() if s in GIVEN]}:
            self.automaton.add_word(stem.removesuffix("-"), stem.removesuffix("-"))
        self.automaton.make_automaton()
        self.known: dict[str, tuple[int, float]] = {}

    def places(self, text: str) -> list[int]:
        """Where words begin that may be insults or threats."""
        out = []
        for end, found in self.automaton.iter(text):
            start = end + 1 - len(found)
            if not (start and text[start - 1].isalpha()):
                out.append(start)
        return out

    def of(self, word: str) -> tuple[int, float]:
        """Symbol and weight of a word."""
        if (known := self.known.get(word)) is None:
            weight = max((self.learned.get(s, 0.0) for s in stems(word)), default=0.0)
            symbol = FIXED.get(word, PLAIN)
            if symbol in (PLAIN, INSULT) and weight:
                symbol = INSULT
            known = symbol, weight or GIVEN.get(symbol, 0.0)
            if len(self.known) < 200_000:
                self.known[word] = known
        return known

    def clauses(self, text: str | None) -> Iterator[tuple[str, list[tuple[str, str, float]]]]:
        """Clauses with events: (clause, [(event, word, weight)])."""
        lower = (text or "").lower()
        if not (places := self.places(lower)):
            return
        ends = [0, *[m.end() for m in END.finditer(lower)], len(lower)]
        for k in sorted({bisect_right(ends, p) - 1 for p in places}):
            clause = lower[ends[k] : ends[k + 1]]
            words = WORD.findall(clause)
            told = [self.of(w) for w in words]
            events = [(EVENTS[e - FIRST_EVENT], w, x[1]) for e, w, x in zip(GRAMMAR.read([x[0] for x in told]), words, told, strict=True) if e >= FIRST_EVENT]
            if any(e != "aim" for e, _, _ in events):
                yield clause, events

    def features(self, text: str | None) -> np.ndarray:
        """1, the strongest event, events by words, and events by kind."""
        sums, strongest, total = dict.fromkeys(EVENTS, 0.0), 0.0, 0.0
        for _, events in self.clauses(text):
            for event, _, weight in events:
                sums[event] += weight or 1.0
                if event not in ("denied", "reported", "aim"):
                    strongest, total = max(strongest, weight), total + weight
        out = np.zeros(len(PRIOR))
        out[0] = 1
        if any(sums.values()):
            out[1:] = strongest, log1p(100 * total / (len(text.split()) + 20)), *[log1p(sums[e]) for e in EVENTS]
        return out


class Model:
    """A lexicon and the regression's weights."""

    def __init__(self, learned: dict[str, float], weights: np.ndarray):
        self.learned, self.weights = learned, weights

    def scores(self, texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
        x = np.array([lexicon.features(t) for t in texts]).reshape(len(texts), len(PRIOR))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -500, 500)))


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression that leans to ``PRIOR``, by Newton's method."""
    w = PRIOR.copy()
    for _ in range(50 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + LEAN * (w - PRIOR)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + LEAN * np.eye(len(w)), gradient)
        w = w - step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


def sketch(text: str) -> int:
    """The least hash of five consecutive words: near copies mostly share it, others don't."""
    w = text.split()
    return min((xxhash.xxh3_64_intdigest(" ".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))), default=0) - (1 << 63)


def sample_of(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic, part) of ``sample`` labelled rows outside the held-out quarter, one of each group of near copies; stored."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("of")).join(F.broadcast(chosen), "doc_id")
    ids = rows.select("doc_id", "of").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "of").limit(sample)
    texts = stored(rows.join(F.broadcast(ids), ["doc_id", "of"]).groupBy("doc_id", "of").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")), "sample")

    @F.arrow_udf("long")
    def sketched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sketch(t or "") for t in batch.to_pylist()], pa.int64())

    least = F.struct("doc_id", "of")
    reps = texts.withColumn("sketch", sketched("text")).groupBy("sketch", "toxic").agg(F.min_by("text", least).alias("text"))
    out = stored(reps.select("text", "toxic", (F.pmod("sketch", F.lit(3)) == 0).alias("part")), "representatives")
    discard(texts)
    return out


def counted(rows: DataFrame) -> DataFrame:
    """(stem, counts): representatives with each word or beginning, clean and toxic, outside the fitted part and in it."""
    schema = pa.schema([("stem", pa.string()), *[(f"n{k}", pa.int64()) for k in range(4)]])

    def flush(counts: list[Counter]) -> pa.RecordBatch:
        names = list(set().union(*counts))
        out = pa.record_batch([pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in counts]], schema=schema)
        for c in counts:
            c.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter() for _ in range(4)]
        for batch in batches:
            for text, toxic, part in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                found: set[str] = set()
                for word in set(WORD.findall((text or "").lower())):
                    found.update(stems(word))
                counts[2 * bool(part) + (toxic > 0)].update(found)
                if sum(map(len, counts)) > 600_000:
                    yield flush(counts)
        yield flush(counts)

    return rows.select("text", "toxic", "part").mapInArrow(run, "stem string, n0 long, n1 long, n2 long, n3 long").groupBy("stem").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)])


def telling(counts: DataFrame, clean: int, toxic: int, on: tuple[Column, Column], size: int) -> dict[str, float]:
    """Weights of at most ``size`` stems: those whose presence depends most on the label, by chi-square."""
    if not clean or not toxic:
        return {}
    c, t = (x.cast("double") for x in on)
    n = clean + toxic
    share = (c + t) / n
    chi = (t - share * toxic) ** 2 / (share * toxic * (1 - share)) + (c - share * clean) ** 2 / (share * clean * (1 - share))
    odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    kept = counts.where((t >= SUPPORT) & (c + t < n)).select("stem", chi.alias("chi"), odds.alias("odds")).where((F.col("chi") >= TELLING) & (F.col("odds") >= ODDS))
    return {r.stem: r.odds for r in kept.orderBy(F.desc("chi"), "stem").limit(size).collect()}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = LEXICON) -> Model:
    """A model of ``labels`` (doc_id, toxic) and the texts of ``docs`` (doc_id, text)."""
    rows = sample_of(docs, labels, sample)
    n = {(r.part, r.toxic > 0): r.n for r in rows.groupBy("part", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = stored(counted(rows), "stems")
    got = [n.get((part, toxic), 0) for part in (False, True) for toxic in (False, True)]
    c = [F.col(f"n{k}") for k in range(4)]
    others = telling(counts, got[0], got[1], (c[0], c[1]), size)
    every = telling(counts, got[0] + got[2], got[1] + got[3], (c[0] + c[2], c[1] + c[3]), size)
    kind = pa.schema([("toxic", pa.float64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(others)
        for batch in batches:
            x = [lexicon.features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1).cast(pa.float64()), pa.array(x, pa.list_(pa.float64()))], schema=kind)

    seen = rows.where("part").select("text", "toxic").mapInArrow(run, "toxic double, x array<double>").toArrow()
    x = np.array(seen["x"].to_pylist()).reshape(-1, len(PRIOR))
    weights = fitted(x, (np.array(seen["toxic"].to_pylist()) > 0).astype(float)) if got[3] and got[1] else PRIOR.copy()
    discard(rows, counts)
    return Model(every, weights)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the ids that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = Lexicon(sent.value.learned)
        for batch in batches:
            yield pa.array(sent.value.scores([t.as_py() for t in batch], lexicon), pa.float64())

    return score(F.col(text_col))


def matches(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, clause, event, word, weight) of every event."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(sent.value.learned)
        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                found = [(clause.strip(), *event) for clause, events in lexicon.clauses(text.as_py()) for event in events]
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.string(), pa.float64()), strict=True)] if found else []
                if columns:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1).take(pa.array([0] * len(found))), *columns], names=[id_col, "clause", "event", "word", "weight"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, clause string, event string, word string, weight double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    rows = docs.select("doc_id", "text")
    out = rows.withColumn("score", scored(rows, train(rows, labels)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
