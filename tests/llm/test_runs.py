"""Periodic runs against a search of all periods, word by word."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import runs


def brute(w, least=24, times=3):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, times * q):
                found.setdefault((start, i + q - start), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def texts(seed, n):
    """Lists of words with stretches of a period, noise, and periods inside periods."""
    r = random.Random(seed)
    for _ in range(n):
        names = [f"a{k}é" for k in range(r.choice([1, 2, 3, 30]))]
        w = []
        for _ in range(r.randint(0, 5)):
            if r.random() < 0.5:
                w += r.choices(names, k=r.randint(0, 40))
            else:
                w += (r.choices(names, k=r.randint(1, 12)) * 80)[: r.randint(5, 90)]
        yield w


def test_runs_of_any_least_length_and_number_of_periods():
    hashed, r = runs.WordHashes(), random.Random(5)
    for w in texts(1, 1500):
        least, times = r.choice([(24, 3), (24, 3), (4, 3), (9, 2), (6, 4)])
        assert runs.runs_of(" ".join(w).encode(), hashed, least, times) == brute(w, least, times)


def test_equal_hashes_of_unequal_words_do_no_harm(monkeypatch):
    monkeypatch.setattr(runs.Extensions, "equal", lambda self, a, b, size: np.ones(len(a), bool))
    for w in texts(2, 60):
        assert runs.main_lorentz(np.array([hash(x) % 1000 for x in w], np.int64)) == brute([hash(x) % 1000 for x in w])


def test_blocks_of_a_long_text_give_the_same_hashes(monkeypatch):
    text = " \n".join(random.Random(3).choices(["ab", "x" * 70, "é", "ha"], k=900)).encode()
    whole = runs.WordHashes()(text)
    monkeypatch.setattr(runs.WordHashes, "block", 64)
    assert (runs.WordHashes()(text) == whole).all() and len(whole) == 900
    monkeypatch.undo()
    words = text.split()
    assert len(set(zip(words, whole.tolist(), strict=True))) == len(set(words)) == len(set(whole.tolist()))


def test_overlap_is_the_least_over_all_periods():
    assert runs.overlap() == 16 == min(max(24, 3 * q) - q for q in range(1, 500))


def test_operator_on_defined_cases(spark):
    rows = [(k, " ".join(w)) for k, w in enumerate(texts(4, 60))]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "ha " * 300_000), (None, "ab cd " * 30), (7, "ab cd " * 30), (7, "ab cd " * 30), (104, " ".join(map(str, range(120_000))) + " " + "x y z " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("runs", F.lit(1)).withColumn("_w", F.lit("w"))
    got = runs.found(df)
    assert [c for c in got.columns if c in df.columns] == df.columns
    seen = sorted((r.doc_id, r.text, r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in got.collect() if r.doc_id is not None and r.doc_id < 100)
    for _, text, n, found, kept in seen:
        w = text.split()
        assert (n, found) == (len(w), brute(w))
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        assert kept == " ".join(x for i, x in enumerate(w) if i not in gone)
    by = {r.doc_id: r for r in got.where("doc_id is null or doc_id > 99").collect()}
    assert [(by[k].n_words, by[k].runs, by[k].kept_text) for k in (100, 101, 102)] == [(0, [], "")] * 3
    assert [tuple(x) for x in by[103].runs] == [(0, 300_000, 1)] and by[103].kept_text == "ha"
    assert [tuple(x) for x in by[104].runs] == [(120_000, 27, 3)] and by[None].kept_text == "ab cd"
    assert sum(r[0] == 7 for r in seen) == 3
    assert runs.found(df.limit(0)).count() == 0 and runs.digest(df.limit(0)).count() == 0
    none = runs.digest(spark.createDataFrame([(1, None), (None, "a b")], "doc_id long, text string")).collect()
    assert all(r.n_runs == 0 and r.start is None and r.exponent_milli is None and r.runs_sha256 == hashlib.sha256(b"").hexdigest() for r in none)
