"""Merkle manifests against trees built in memory."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([h(*last[k : k + 2]) for k in range(0, len(last), 2)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        if i ^ 1 < len(level):
            out.append(level[i ^ 1])
        i //= 2
    return out


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows):
    """{(id, leaf): (subroot, root, digest of siblings)} of rows (id, group, text)."""
    groups = {}
    for i, g, text in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, h(field(i), field(g), field(text)), i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = {}
    for k, g in enumerate(names):
        for j, x in enumerate(sorted(groups[g])):
            out.setdefault((x[3], x[2]), set()).add((trees[g][-1][0], top[-1][0], h(*siblings(trees[g], j), *siblings(top, k))))
    return out


def shown(spark, rows):
    df = spark.createDataFrame(rows, "id long, group string, text string").repartition(3).withColumns({"tree": F.lit(1), "n": F.lit("n"), "path": F.lit("p"), "i": F.lit(0)})
    leaves = df.select("id", "group", merkle.leaf(F.col("id"), F.col("group"), F.col("text")).alias("leaf"), F.lit("x").alias("note"))
    got = merkle.manifest(leaves)
    return got.withColumn("f", merkle.folded(F.col("leaf"), F.col("path"))).collect()


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_manifest_of_groups_of_many_sizes(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    r = random.Random(bits)
    rows = [(r.randint(-5, 99), g, r.choice(["a", "é", "", None, "x" * 90])) for g, n in [("a", 1), ("é", 2), (None, 3), ("", 4), ("b", 5), ("Z", 7), ("c", 37 if bits < 8 else 300)] for _ in range(n)]
    rows += [(None, "b", "null id"), (None, None, None), (7, "b", "twice"), (7, "b", "twice"), (8, "long", "w " * 150_000)]
    want, got = brute(rows), shown(spark, rows)
    assert len(got) == len(rows)
    for x in got:
        assert (x.subroot, x.root, x.f.proof_sha256) in want[x.id, x.leaf] and x.f.folded_root == x.root and x.note == "x"


def test_one_group_one_row_and_no_row(spark):
    (one,) = shown(spark, [(1, "a", "t")])
    assert one.leaf == one.subroot == one.root == one.f.folded_root and one.f.proof_sha256 == h()
    assert shown(spark, []) == []


def test_a_changed_leaf_or_sibling_leads_elsewhere(spark):
    rows = shown(spark, [(k, "ab"[k % 2], f"t{k}") for k in range(40)])
    for x in rows[:10]:
        leaf, path = bytes.fromhex(x.leaf), bytes(x.path)
        assert merkle.fold(leaf, path).hex() == x.root
        assert merkle.fold(bytes([leaf[0] ^ 1]) + leaf[1:], path).hex() != x.root
        assert merkle.fold(leaf, path[:1] + bytes([path[1] ^ 1]) + path[2:]).hex() != x.root


def test_query_on_null_fields(spark):
    rows = [(1, None, None, None, None), (2, "t", "en", "s", 5), (None, "", "", "", 0), (14, "x", None, "s", None)]
    got = {r.doc_id: r for r in merkle.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[1].leaf == h(field(1), "-", "-", "-", "-") and got[2].leaf == h(field(2), field("s"), field("en"), field(5), field("t"))
    assert got[1].verified and got[14].verified and len({r.root for r in got.values()}) == 1
