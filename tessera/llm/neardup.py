"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full shingle sets, connected components.

* A text is named by its id and a hash of it, so all texts of an id take part.  Texts with equal shingle sets form a class at
  once; the least name stands for it from there on.
* Banding: 16-byte rows (key, text) are counted by key, and only those of keys that several classes have go on as buckets.
  Texts are read again for those classes alone.
* A bucket never yields all its pairs.  At first each text is compared with one pivot, the one that it shares most buckets
  with; a bucket's pivot is the member that shares buckets with most others.  Buckets whose members have all come to one
  component are done.  In the others, the *outsiders* (members outside the bucket's largest component) are held against all
  members of other components: each pair of different components has an outsider, so none is left out.  Equal buckets of
  several bands count once.  Outsiders are dealt to blocks and members to shares, both of bounded size, and compared there
  by the low bits of all their elements, which can't lose a link; what stays, hardly more than the links, comes out and is
  verified.  Rows are members times blocks (one for each ``PIVOTS`` outsiders, or ``ELEMENTS`` of their elements) and outsiders
  times shares (one for each ``SHARE_ELEMENTS`` of the members' elements): comparisons in a family of texts that are near each
  other but not linked grow with its square, that is the price of losing no link, rows by a thousandth of it or so.
* Verification streams: a pivot's text travels once to each share of at most ``SHARE`` members, so a large group spreads.

Two documents of similarity s agree on some band with probability 1 - (1 - s^rows)^bands: 0.999993 at 0.8.  Nothing after the
banding can lose a link.
Defined cases: null and empty texts and texts of white space have no shingles, link with nothing and stay; a null id is
never linked (its component is null) and stays; rows with one id are one node, linked to whatever any of their texts is near
to; repeated rows each get a row; texts of any length work, in memory of a few times one text; other columns, whatever their
names, pass through (``deduplicated``) or don't matter; an empty table gives an empty result.  Ids must cast to long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Hashes, discard, mix, partitions, stored, word_hashes, words
from tessera.llm.components import components
from tessera.llm.superminhash import signatures

LOWER = bytes(i + 32 * (64 < i < 91) for i in range(256))
BANDS, ROWS = 30, 5
SHARE = 256
BATCH = 400_000
#: Outsiders of a bucket in a block, and elements that the outsiders of a block and the members of a share have, about.
PIVOTS, ELEMENTS, SHARE_ELEMENTS = 2048, 2_000_000, 100_000
#: Elements of a set whose low 16 bits do.
SMALL = 512


def shingles(text: bytes | None, size: int, seen: Hashes) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``size`` words, A-Z in lower case; of all words where there are fewer."""
    w = word_hashes(words(text, LOWER), seen)
    if not len(w):
        return w
    size = min(size, len(w))
    n = len(w) - size + 1
    value = mix(w[:n] + np.uint64(size))
    for k in range(1, size):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n])
    return np.unique(value)


def low_bits(elements: np.ndarray) -> bytes:
    """The low bits of each element: 16 in small sets, 32 in others."""
    return elements.astype(np.uint16 if len(elements) <= SMALL else np.uint32).tobytes()


def common_at_most(own: np.ndarray, others: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """For each of ``others`` how many of its elements have low bits that ``own`` has too, at least as many as are common.

    ``table``: 65,536 false values, left as found.
    """
    flat = np.concatenate(others)
    first = np.concatenate(([0], np.cumsum([len(x) for x in others])[:-1]))
    if own.dtype == np.uint16 or flat.dtype == np.uint16:
        table[own.astype(np.uint16)] = True
        hit = table[flat.astype(np.uint16)]
        table[own.astype(np.uint16)] = False
    else:
        sorted_ = np.sort(own)
        hit = sorted_[np.minimum(np.searchsorted(sorted_, flat), len(sorted_) - 1)] == flat
    return np.add.reduceat(hit.astype(np.int64), first)


def _sketch(size: int):
    schema = pa.schema([("doc", pa.int64()), ("tk", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def emit(ids: list, names: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        count = np.array([len(x) for x in sets], np.int64)
        some = np.flatnonzero(count)
        keys = np.zeros((len(some), BANDS), np.uint64)
        s1, s2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
        if len(some):
            flat = np.concatenate([sets[i] for i in some])
            first = np.cumsum(count[some]) - count[some]
            s1[some], s2[some] = np.add.reduceat(mix(flat), first), np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), first)
            sig = signatures(flat, count[some], BANDS * ROWS).reshape(len(some), BANDS, ROWS).astype(np.uint64)
            keys += np.arange(1, BANDS + 1, dtype=np.uint64)
            for k in range(ROWS):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
        offsets = np.concatenate(([0], np.cumsum(np.where(count > 0, BANDS, 0)))).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(names, pa.int64()), pa.array(count), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), bands], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ids, names, sets, total = Hashes(), [], [], [], 0
        for batch in batches:
            for doc, tk, text in zip(batch.column("doc").to_pylist(), batch.column("tk").to_pylist(), batch.column("text"), strict=True):
                ids.append(doc)
                names.append(tk)
                sets.append(shingles(text.as_py(), size, seen))
                total += len(sets[-1])
                if total >= BATCH or len(sets) >= 4000:
                    yield emit(ids, names, sets)
                    ids, names, sets, total = [], [], [], 0
        if ids:
            yield emit(ids, names, sets)

    return run


def _with_low(size: int):
    """Texts in buckets with the low bits of their sets."""
    schema = pa.schema([("doc", pa.int64()), ("tk", pa.int64()), ("text", pa.binary()), ("low", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Hashes()
        for batch in batches:
            low = [low_bits(shingles(x.as_py(), size, seen)) for x in batch.column("text")]
            yield pa.record_batch([batch.column("doc"), batch.column("tk"), batch.column("text"), pa.array(low, pa.binary())], schema=schema)

    return run


def _compare(size: int, percent: int):
    """Rows sorted by pivot (a, ta) and share, the pivot's own row before its members': (a, ta, b, tb, linked) of each member."""
    schema = pa.schema([("a", pa.int64()), ("ta", pa.int64()), ("b", pa.int64()), ("tb", pa.int64()), ("linked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, at, own = Hashes(), None, None
        for batch in batches:
            out = []
            for a, ta, share, b, tb, text in zip(*(batch.column(x).to_pylist() for x in ("a", "ta", "share", "b", "tb")), batch.column("text"), strict=True):
                got = shingles(text.as_py(), size, seen)
                if b is None:
                    at, own = (a, ta, share), got
                elif at == (a, ta, share):
                    both = np.count_nonzero(own[np.minimum(np.searchsorted(own, got), len(own) - 1)] == got) if len(own) else 0
                    out.append((a, ta, b, tb, bool(both) and 100 * both >= percent * (len(own) + len(got) - both)))
            yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True) if out else [()] * 5, schema.types, strict=True)], schema=schema)

    return run


def _alike(percent: int):
    """Rows sorted by key, block and share, the block's outsiders first: pairs of different components that may be linked, by their low bits."""
    schema = pa.schema([("a", pa.int64()), ("ta", pa.int64()), ("b", pa.int64()), ("tb", pa.int64())])
    numbers = ("key", "block", "share", "member", "doc", "tk", "n", "comp", "outsider")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots, table = None, [], np.zeros(1 << 16, bool)
        for batch in batches:
            key, block, share, member, doc, tk, n, comp, outsider = (batch.column(x).to_numpy(zero_copy_only=False) for x in numbers)
            low = [np.frombuffer(x, np.uint16 if m <= SMALL else np.uint32) for x, m in zip(batch.column("low").to_pylist(), n, strict=True)]
            change = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0) | (np.diff(share) != 0) | (np.diff(member) != 0)) + 1
            out: list[tuple[np.ndarray, ...]] = []
            for i, j in zip([0, *change.tolist()], [*change.tolist(), len(key)], strict=True):
                if i == j:
                    continue
                if (key[i], block[i], share[i]) != at:
                    at, pivots = (key[i], block[i], share[i]), []
                if not member[i]:
                    pivots += [(doc[k], tk[k], n[k], comp[k], low[k]) for k in range(i, j)]
                    continue
                for a, ta, size, own, bits in pivots:
                    behind = (doc[i:j] > a) | ((doc[i:j] == a) & (tk[i:j] > ta)) | ~outsider[i:j]  # two outsiders are compared once
                    some = i + np.flatnonzero(behind & (comp[i:j] != own) & (100 * np.minimum(n[i:j], size) >= percent * np.maximum(n[i:j], size)))
                    for part in (some[n[some] <= SMALL], some[n[some] > SMALL]):
                        if len(part):
                            most = common_at_most(bits, [low[k] for k in part], table)
                            part = part[100 * most >= percent * (size + n[part] - most)]
                            out.append((np.full(len(part), a), np.full(len(part), ta), doc[part], tk[part]))
            yield pa.record_batch([pa.array(np.concatenate([x[c] for x in out]) if out else np.zeros(0, np.int64), t) for c, t in enumerate(schema.types)], schema=schema)

    return run


def _candidates(bucketed: DataFrame, found: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, ta, b, tb) of different components in one bucket that may be linked."""
    n = partitions(bucketed.sparkSession)
    named = bucketed.join(found, F.col("doc") == F.col("node"), "left").select("key", "doc", "tk", "n", F.coalesce("component", "doc").alias("comp"))
    named = stored(named, "named")
    parts = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("e"), F.bit_xor(F.xxhash64("doc", "tk")).alias("h1"), F.bit_xor(F.xxhash64("tk", "doc", F.lit(7))).alias("h2"))
    open_ = parts.groupBy("key").agg(F.max(F.struct("c", "comp", "e")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("c").alias("size"), F.sum("e").alias("elements"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2")).where("comps > 1")
    open_ = open_.groupBy("h1", "h2", "size", "top", "elements").agg(F.min("key").alias("key"))  # equal buckets count once
    blocks = F.greatest(F.ceil((F.col("size") - F.col("top.c")) / F.lit(PIVOTS)), F.ceil((F.col("elements") - F.col("top.e")) / F.lit(ELEMENTS)))
    open_ = stored(open_.select("key", F.col("top.comp").alias("largest"), blocks.cast("long").alias("blocks"), F.ceil(F.col("elements") / F.lit(SHARE_ELEMENTS)).cast("long").alias("shares")), "open")
    members = named.join(open_, "key").withColumn("outsider", F.col("comp") != F.col("largest"))
    known = members.join(texts.select("doc", "tk", "low"), ["doc", "tk"])
    own_block, own_share = F.expr("pmod(xxhash64(doc, tk, 1), blocks)").alias("block"), F.expr("pmod(xxhash64(doc, tk, 2), shares)").alias("share")
    as_member = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(x.alias("block"), own_share, F.lit(1).alias("member")))
    as_outsider = F.transform(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1), lambda x: F.struct(own_block, x.alias("share"), F.lit(0).alias("member")))
    places = F.explode(F.when(F.col("outsider"), F.concat(as_member, as_outsider)).otherwise(as_member)).alias("place")
    rows = known.select("key", "doc", "tk", F.col("n").cast("long").alias("n"), "comp", "outsider", "low", places).select("key", "place.*", "doc", "tk", "n", "comp", "outsider", "low")
    rows = rows.repartition(n, "key", "block", "share").sortWithinPartitions("key", "block", "share", "member")
    pairs = stored(rows.mapInArrow(_alike(percent), "a long, ta long, b long, tb long").distinct(), "likely")
    discard(named, open_)
    return pairs


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, ta, b, tb, linked) of the pairs, compared on their full sets."""
    n = partitions(pairs.sparkSession)
    shares = stored(pairs.groupBy("a", "ta").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARE)).alias("shares")), "shares")
    dealt = pairs.join(shares, ["a", "ta"]).select("a", "ta", "b", "tb", F.expr("pmod(xxhash64(b, tb), shares)").cast("long").alias("share"))
    texts = texts.select("doc", "tk", "text")
    members = dealt.join(texts, (F.col("b") == F.col("doc")) & (F.col("tb") == F.col("tk"))).select("a", "ta", "share", "b", "tb", "text")
    pivots = shares.select("a", "ta", F.explode(F.expr("sequence(0L, shares - 1)")).alias("share")).join(texts, (F.col("a") == F.col("doc")) & (F.col("ta") == F.col("tk"))).select("a", "ta", "share", F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("tb"), "text")
    rows = members.unionByName(pivots).repartition(n, "a", "ta", "share").sortWithinPartitions("a", "ta", "share", F.col("b").asc_nulls_first())
    out = stored(rows.mapInArrow(_compare(size, percent), "a long, ta long, b long, tb long, linked boolean"), "compared")
    discard(shares)
    return out


def groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_shingles, component) of each row of ``docs``: linked where 100 x intersection >= ``percent`` x union."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("tk"), F.col(text_col).cast("binary").alias("text"))
    sketch = stored(rows.mapInArrow(_sketch(size), "doc long, tk long, n long, s1 long, s2 long, bands array<long>"), "sketches")
    full = sketch.where("doc is not null and n > 0")
    classes = stored(full.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc", "tk", "bands")).alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
    several = classes.where("rows > 1").select("s1", "s2", "n", F.col("rep.doc").alias("b"))
    alike = full.select(F.col("doc").alias("a"), "s1", "s2", "n").join(several, ["s1", "s2", "n"]).where("a <> b").select("a", "b")
    banded = classes.select("rep.doc", "rep.tk", F.col("n").cast("int").alias("n"), F.explode("rep.bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("c")).where("c > 1")
    bucketed = stored(banded.join(shared, "key"), "buckets")
    degree = bucketed.groupBy("doc", "tk").agg(F.sum("c").alias("degree"))
    inside = degree.select("doc", "tk")
    known = rows.where("doc is not null").join(inside, ["doc", "tk"], "left_semi").groupBy("doc", "tk").agg(F.min("text").alias("text"))
    texts = stored(known.select("doc", "tk", "text").mapInArrow(_with_low(size), "doc long, tk long, text binary, low binary"), "texts")
    # first round: each text with the pivot that it shares most buckets with
    pivot = bucketed.join(degree, ["doc", "tk"]).groupBy("key").agg(F.max(F.struct("degree", (-F.col("doc")).alias("minus"), "tk", "n")).alias("p"))
    pivot = stored(pivot.select("key", (-F.col("p.minus")).alias("a"), F.col("p.tk").alias("ta"), F.col("p.n").alias("pn")), "pivots")
    near = F.expr(f"(doc <> a or tk <> ta) and 100L * least(n, pn) >= {percent}L * greatest(n, pn)")
    votes = bucketed.join(pivot, "key").where(near).groupBy("doc", "tk", "a", "ta").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("doc", "tk").agg(F.max(F.struct("votes", (-F.col("a")).alias("minus"), "ta")).alias("p"))
    best = stored(best.select((-F.col("p.minus")).alias("a"), F.col("p.ta").alias("ta"), F.col("doc").alias("b"), F.col("tk").alias("tb")), "best")
    compared = _verified(best, texts, size, percent)
    found = components(alike.unionByName(compared.where("linked").select("a", "b")))
    # second round: outsiders of buckets with several components
    likely = _candidates(bucketed, found, texts, percent)
    turned = compared.select(F.col("b").alias("a"), F.col("tb").alias("ta"), F.col("a").alias("b"), F.col("ta").alias("tb"))
    new = likely.join(compared.select("a", "ta", "b", "tb").unionByName(turned), ["a", "ta", "b", "tb"], "left_anti")
    more = _verified(stored(new, "new"), texts, size, percent)
    last = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.where("linked").select("a", "b"))
    found = components(last)
    discard(classes, bucketed, texts, pivot, best, compared, likely, more)
    return sketch.select("doc", F.col("n").alias("n_shingles")).join(found, F.col("doc") == F.col("node"), "left").select("doc", "n_shingles", F.coalesce("component", "doc").alias("component"))


def digest(docs: DataFrame, size: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    return groups(docs, size, percent, id_col, text_col).select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of its group; of rows with one id, all."""
    gone = groups(docs, size, percent, id_col, text_col).where("doc <> component").select(F.col("doc").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
