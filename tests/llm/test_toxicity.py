"""The clause grammar against a plain reading of its rules; learning against planted words and held-out rows."""

import random
import zlib
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity as T


def told(symbols):
    """Events of a clause, symbol by symbol, by the rules as they are written."""
    out, left, said, aimed, waiting = [], 0, False, False, False
    for s in symbols:
        if s == T.NOT:
            left = 0 if left else T.SCOPE
            continue
        cue = s in (T.INSULT, T.THREAT)
        denied = cue and left > 0
        left = 0 if denied else max(0, left - 1)
        if s == T.SAID:
            said = True
        elif denied:
            out.append("denied")
        elif cue and said:
            out.append("reported")
        elif cue:
            out.append(("aimed " if aimed else "") + ("threat" if s == T.THREAT else "insult"))
            waiting = not aimed
        elif s == T.TARGET:
            if waiting:
                out.append("aim")
            aimed, waiting = True, False
    return out


def test_composed_machine_reads_as_the_rules_say():
    for n in range(6):
        for symbols in product(range(6), repeat=n):
            got = [T.EVENTS[e - T.FIRST_EVENT] for e in T.GRAMMAR.read(list(symbols)) if e >= T.FIRST_EVENT]
            assert got == told(symbols), symbols


def test_composition_is_one_machine_after_the_other():
    r = random.Random(1)
    for _ in range(300):
        symbols = r.choices(range(6), k=r.randint(0, 30))
        assert T.target().read(T.report().read(T.negation().read(symbols))) == T.GRAMMAR.read(symbols)


def test_clauses():
    lexicon = T.Lexicon({"blark": 2.0, "snurp-": 1.5})
    text = "A blark. You are a BLARK! he is not a blark\nShe said: no. She said you blark; snurping, they say. I will kill you. unblark blarks"
    got = [(clause.strip(), [(e, w) for e, w, _ in events]) for clause, events in lexicon.clauses(text)]
    assert got == [
        ("a blark.", [("insult", "blark")]),
        ("you are a blark!", [("aimed insult", "blark")]),
        ("he is not a blark", [("denied", "blark")]),
        ("she said you blark;", [("reported", "blark")]),
        ("snurping, they say.", [("insult", "snurping"), ("aim", "they")]),
        ("i will kill you.", [("threat", "kill"), ("aim", "you")]),
    ]
    assert list(lexicon.clauses(None)) == list(lexicon.clauses("")) == list(lexicon.clauses("you not said")) == []


def test_gradient_of_the_regression_is_zero_where_it_ends():
    r = np.random.default_rng(1)
    x = np.hstack((np.ones((300, 1)), r.random((300, len(T.PRIOR) - 1))))
    y = (x[:, 2] + 0.3 * r.random(300) > 0.7).astype(float)
    w = T.fitted(x, y)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (p - y) + T.LEAN * (w - T.PRIOR)).max() < 1e-4


def corpus(spark, n=900):
    r = random.Random(4)
    names = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(600)]
    bad = ["blark", "snurpo", "snurpel", "snurpix"]
    rows, labels = [], []
    for k in range(n):
        w = r.choices(names, k=r.randint(5, 120))
        toxic = r.random() < 0.2
        for _ in range(r.randint(2, 5) if toxic else 0):
            w[r.randrange(len(w))] = r.choice(bad) + r.choice(["", ".", "!!"])
        rows.append((k, " ".join(w).capitalize()))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_planted_words_are_learned_and_held_out_rows_have_no_say(spark):
    rows, labels = corpus(spark)
    hidden = {k for k, _, _ in labels if zlib.crc32(str(k).encode()) % 4 == 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    frame = lambda l: spark.createDataFrame(l, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in T.digest(docs.withColumn("lang", F.lit("xx")), frame(labels)).collect()}
    assert {k for k, r in got.items() if r.held_out} == hidden
    toxic = {k for k, _, t in labels if t}
    caught = {k for k, r in got.items() if r.predicted == 1}
    assert len(caught & toxic & hidden) >= 0.95 * len(toxic & hidden) and len((caught - toxic) & hidden) <= 0.02 * len(hidden - toxic)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    other = [(k, q, 1 - t if k in hidden else t) for k, q, t in labels] + [(None, 1, 1), (3, None, None)]
    again = {r.doc_id: r.score for r in T.digest(docs, frame(other)).collect()}
    assert again == {k: r.score for k, r in got.items()}


def test_defined_cases(spark):
    rows, labels = corpus(spark, 200)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "You idiot " + "word " * 300_000), (None, "you blark"), (5, "another text of five"), (5, "another text of five"), (1004, "You are an idiot and scum.")]
    labels += [(5, 1, 1), (5, 1, 0), (1000, 1, 0), (1003, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"of": F.lit(1), "toxic": F.lit(0), "score": F.lit("s")})
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = T.digest(docs, frame).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id in (1000, 1001, 1002)}) == 1
    assert len({r.score for r in got if r.doc_id == 5 and not r.predicted}) >= 1
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert T.digest(docs.limit(0), frame).count() == 0
    unlearned = {r.doc_id: r.predicted for r in T.digest(docs, frame.limit(0)).collect()}
    assert unlearned[1004] == 1 and unlearned[1000] == 0
    model = T.Model({"blark": 3.0}, T.PRIOR)
    found = {(r.doc_id, r.event, r.word, r.weight) for r in T.matches(docs, model).where("doc_id is null or doc_id = 1004").collect()}
    assert found == {(None, "aimed insult", "blark", 3.0), (1004, "aimed insult", "idiot", 4.0), (1004, "aimed insult", "scum", 4.0)}


def test_near_copies_count_once(spark):
    text = " ".join(f"w{k}" for k in range(200))
    copies = [(k, text + f" end{k}") for k in range(300)]
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(1).alias("toxic"))
    assert T.sample_of(docs, labels, 1000).count() < 30
    assert T.sample_of(docs, labels, 10).count() <= 10
