"""Merkle manifest of a dataset: digests of rows, trees over them, a node store by level, and a proof for every row.

A row's leaf is the SHA-256 of its fields, each ``-`` if null, else its byte count, ``:`` and its value.  Rows of one group (a
language, say) are ranked by id; while more than one node remains, each two consecutive ones, or a last one alone, become the digest
of their digests as hexadecimal text.  The groups' roots, in the bytewise order of the groups with null first, are the leaves of
one more tree, whose root names the dataset.

Nothing holds a tree in memory.  Ranked leaves are sorted runs cut into blocks of ``1 << BITS``; a block streams through a task
that gives out its nodes, ``BITS`` levels at a time, into a Parquet store in folders by level; the next pass reads the highest of
them.  Proofs go down again: the rows of some levels, and the path of the block above them, are merged by coordinate (tree,
block, level, place) and each node leaves with its path.  A pass is one shuffle of small rows, and a large group is as many blocks
as it needs.  A path is, from below, ``R`` or ``L`` (the sibling's side) and the sibling, or ``N`` where there is none.

Defined cases: null groups are a group of their own; null ids come first, equal ids are ordered by their leaves; repeated rows are
leaves each; any field may be null or of any length; other columns, whatever their names, don't matter; an empty table gives an
empty manifest.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import discard, shared_folder, stored
from tessera.operators.ordering import ranked

#: Levels of a tree that one pass makes or reads; a block has as many nodes as two to this power.
BITS = 8
NODE = "tree string, i long, n long, digest binary"


def leaf(*fields: Column) -> Column:
    """The digest of a row, lowercase hexadecimal."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]).cast("binary"), 256)


def joined(*digests: bytes) -> bytes:
    """The digest of digests, which are written as hexadecimal text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def above(digests: list[bytes]) -> list[bytes]:
    """The next level of some consecutive nodes, the first of which has an even place."""
    return [joined(*digests[k : k + 2]) for k in range(0, len(digests), 2)]


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    return max(0, n - 1).bit_length()


def blocks(batches: Iterator[pa.RecordBatch], n_keys: int = 2) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of consecutive equal values in the first columns: (those values, the other columns' values of each row)."""
    key, rows = None, []
    for batch in batches:
        for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if values[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = values[:n_keys], []
            rows.append(values[n_keys:])
    if rows:
        yield key, rows


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches."""
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some = []
    if some:
        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def climbed(nodes: DataFrame, base: int) -> DataFrame:
    """The nodes of the ``BITS`` levels above ``nodes`` (tree, i, n, digest) of level ``base``: (level, tree, i, n, digest); n is a level's size."""
    schema = pa.schema([("level", pa.int32()), ("tree", pa.string()), ("i", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for (tree, block), rows in blocks(batches):
                n, digests = rows[0][1], [r[2] for r in rows]
                for level in range(1, min(BITS, height(n)) + 1):
                    digests = above(digests)
                    first = block << BITS - level
                    yield from ((base + level, tree, first + k, -(-n >> level), d) for k, d in enumerate(digests))

        return batched(made(), schema)

    placed = nodes.select("tree", F.shiftright("i", BITS).alias("block"), "i", "n", "digest")
    return placed.repartition("tree", "block").sortWithinPartitions("tree", "block", "i").mapInArrow(climb, f"level int, {NODE}")


class Store:
    """Nodes above the leaves, as Parquet in folders by level in the shared folder."""

    def __init__(self, leaves: DataFrame):
        """``leaves``: (tree, i, n, digest, and what else they carry)."""
        self.spark, self.leaves = leaves.sparkSession, leaves
        self._stored_at = f"{shared_folder(self.spark).rstrip('/')}/nodes-{uuid.uuid4().hex}"
        self.sparkSession = self.spark
        most = leaves.agg(F.max("n")).first()[0] or 0
        self.bases = list(range(0, max(1, height(most)), BITS))
        for base in self.bases:
            climbed(self.level(base), base).write.partitionBy("level").mode("append").parquet(self._stored_at)

    def nodes(self) -> DataFrame:
        return self.spark.read.schema(f"{NODE}, level int").parquet(self._stored_at)

    def level(self, k: int) -> DataFrame:
        return self.leaves.select("tree", "i", "n", "digest") if k == 0 else self.nodes().where(F.col("level") == k).select("tree", "i", "n", "digest")

    def roots(self) -> DataFrame:
        """(tree, level, digest) of the node that remains of each tree."""
        return self.leaves.where("n = 1").select("tree", F.lit(0).alias("level"), "digest").unionByName(self.nodes().where("n = 1").select("tree", "level", "digest"))

    def paths(self, above_roots: DataFrame | None = None) -> DataFrame:
        """The leaves with ``path``: siblings up to the tree's root and on along ``above_roots`` (tree, level, path), level being the root's."""
        paths = None
        for base in reversed(self.bases):
            parents = [] if paths is None else [paths.select("tree", F.col("i").alias("block"), "path")]
            if above_roots is not None:
                enters = F.least(F.floor(F.col("level") / BITS) * BITS, F.lit(self.bases[-1])) == base
                parents.append(above_roots.where(enters).select("tree", F.lit(0).cast("long").alias("block"), "path"))
            paths = self._down(base, parents)
        return paths

    def _down(self, base: int, parents: list[DataFrame]) -> DataFrame:
        """Nodes of level ``base`` with their paths, from the levels over them and the paths of the blocks they are in."""
        own = self.leaves if base == 0 else self.level(base)
        carried = [f for f in own.schema.fields if f.name not in ("tree", "i", "n", "digest")]
        null = [F.lit(None).cast(f.dataType).alias(f.name) for f in carried]
        within = F.shiftright("i", BITS).alias("block")
        rows = own.select("tree", within, F.lit(BITS).alias("kind"), "i", "n", "digest", F.lit(None).cast("binary").alias("path"), *[f.name for f in carried])
        kind = F.col("level") - base
        inner = self.nodes().where((F.col("level") > base) & (F.col("level") < base + BITS))
        rows = rows.unionByName(inner.select("tree", F.expr(f"shiftright(i, {BITS} - (level - {base}))").alias("block"), kind.alias("kind"), "i", "n", "digest", F.lit(None).cast("binary").alias("path"), *null))
        none = F.lit(None).cast("long")
        for paths in parents:
            rows = rows.unionByName(paths.select("tree", "block", F.lit(0).alias("kind"), none.alias("i"), none.alias("n"), F.lit(None).cast("binary").alias("digest"), "path", *null))
        placed = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "i")
        kinds = StructType([*own.select("tree", "i", "n", "digest").schema.fields, *carried]).add("path", "binary")
        return placed.mapInArrow(proving(len(carried)), kinds)


def proving(n_carried: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges what is sorted by (tree, block, kind, i) to nodes with their paths; a block is all that is held."""

    def entry(level: list[bytes], k: int) -> bytes:
        """What stands on a path for place ``k`` of a block's level."""
        return (b"N" if k ^ 1 >= len(level) else b"L" + level[k - 1] if k & 1 else b"R" + level[k + 1])

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def noted():
            for batch in batches:
                types[:] = [batch.schema.field(k) for k in range(len(batch.columns))]
                yield batch

        def made():
            for (tree, _), rows in blocks(noted()):
                path = next((r[4] for r in rows if r[0] == 0), None) or b""
                own = [r for r in rows if r[0] == BITS]
                if not own:
                    continue
                levels = [[r[3] for r in own]]
                for k in range(1, min(BITS, height(own[0][2]))):
                    levels.append([r[3] for r in rows if r[0] == k])
                paths = [path]
                for k in range(len(levels) - 1, -1, -1):
                    alone = own[0][2] == 1
                    paths = [(b"" if alone else entry(levels[k], j)) + paths[j >> 1] for j in range(len(levels[k]))]
                for r, p in zip(own, paths, strict=True):
                    yield (tree, r[1], r[2], r[3], *r[5 : 5 + n_carried], p)

        first = next(source := made(), None)
        if first is None:
            return
        f = {t.name: t for t in types}
        schema = pa.schema([f["tree"], f["i"], f["n"], f["digest"], *types[7 : 7 + n_carried], pa.field("path", pa.binary())])

        def again():
            yield first
            yield from source

        yield from batched(again(), schema)

    return prove


def ranked_leaves(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` (tree, digest, ...) with place and number in their tree, stored; equal rows are dealt out by a tie-breaker."""
    placed = ranked(rows.withColumn("tie of leaves", F.rand(11)), by, [*order, "tie of leaves"], "i", 0)
    leaves = stored(placed.drop("tie of leaves"), "leaves")
    discard(*placed.made)
    return leaves.join(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "tree")


def manifest(rows: DataFrame) -> DataFrame:
    """(id, group, leaf and other columns) of ``rows`` with subroot, root and path.  Needs the columns id, group, leaf (lowercase hexadecimal)."""
    trees = rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit(""))).withColumn("digest", F.unhex("leaf")).drop("leaf")
    store = Store(ranked_leaves(trees, ["tree"], ["id", "digest"]))
    tops = store.roots().select(F.lit("").alias("tree"), F.col("tree").alias("of"), "level", "digest")
    top = Store(ranked_leaves(tops, [], ["of"]))
    root = (top.roots().first() or (None, 0, b""))[2]
    upper = stored(top.paths().select(F.col("of").alias("tree"), "level", "path", F.lower(F.hex("digest")).alias("subroot")), "upper")
    out = store.paths(upper.select("tree", "level", "path")).join(upper.select("tree", "subroot"), "tree")
    return out.select("id", "group", F.lower(F.hex("digest")).alias("leaf"), "subroot", F.lit(bytes(root).hex()).alias("root"), "path", *[c for c in rows.columns if c not in ("id", "group", "leaf")])


def steps(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(side, sibling) of each level of a path."""
    at = 0
    while at < len(path):
        side = path[at : at + 1]
        end = at + (1 if side == b"N" else 33)
        yield side, path[at + 1 : end]
        at = end


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    for side, sibling in steps(path):
        digest = joined(digest) if side == b"N" else joined(sibling, digest) if side == b"L" else joined(digest, sibling)
    return digest


def folded(leaf_col: Column, path_col: Column) -> Column:
    """Of a leaf (hexadecimal) and a path: the root they lead to (folded_root), and the digest of the siblings from below (proof_sha256)."""

    @F.arrow_udf("struct<folded_root:string,proof_sha256:string>")
    def fold_all(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for leaves, paths in batches:
            roots, proofs = [], []
            for one, path in zip(leaves.to_pylist(), paths.to_pylist(), strict=True):
                roots.append(fold(bytes.fromhex(one), path).hex())
                proofs.append(joined(*[s for _, s in steps(path)]).hex())
            yield pa.StructArray.from_arrays([pa.array(roots, pa.string()), pa.array(proofs, pa.string())], names=["folded_root", "proof_sha256"])

    return fold_all(leaf_col, path_col)


def digest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, and what becomes of proofs where 1 is added to n_chars of a seventh of the rows."""
    c = F.col
    fields = lambda n: leaf(c("doc_id"), c("source"), c("lang"), n, c("text"))
    tampered = F.when(F.crc32(c("doc_id").cast("string").cast("binary")) % 7 == 0, fields(c("n_chars") + 1))
    rows = manifest(docs.select(c("doc_id").alias("id"), c("lang").alias("group"), fields(c("n_chars")).alias("leaf"), F.unhex(tampered).alias("tampered")))
    shown = F.coalesce(F.lower(F.hex("tampered")), c("leaf"))
    checked = rows.withColumn("checked", folded(shown, c("path")))
    return checked.select(c("id").alias("doc_id"), "leaf", "subroot", "root", "checked.proof_sha256", "checked.folded_root", (c("checked.folded_root") == c("root")).alias("verified"))
