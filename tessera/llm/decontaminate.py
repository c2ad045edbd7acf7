"""Benchmark decontamination by a positional inverted index over the training documents.

The index is cut into *segments*, one row each, like those of a search engine: ids and lengths of some documents, the
segment's own vocabulary, and for each term the sorted places where it stands.  Places count through the segment, with a
gap between documents, so a phrase never matches across two.  Every word of every document is posted, so an index that is
written once to the shared folder serves any benchmark; searching reads it without any shuffle, and the work on one segment
is bounded by its size, whatever the skew of sources or terms.

A benchmark is searched in blocks of at most ``BLOCK`` words, each sent to all executors for a pass over the index; there may
be any number of blocks, and an item longer than a block spreads over several.  A block lists its windows under
their rarest term, so a segment fetches only windows whose rarest term it has, and of these only those that it has all terms
of are looked up: from the term that is rarest in the segment, whose places, shifted back by its offset, are the possible
starts; the next rarest term's places keep those that fit, and so on until none is left or all terms agree.

Defined cases: null or empty texts have no words and no hits; null item texts have no windows, null item ids are left out;
rows with one id are judged one by one, rows of a null id too; equal items both count; an empty table gives an empty result,
an empty benchmark no hits; documents of any length work, in memory of a few times one text; other columns, whatever their
names, pass through (``clean``) or don't matter.  Document ids must cast to long.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ALNUM, fresh, stored, words

WINDOW = 13
#: Words of a benchmark block (about 100 MB on an executor at most), and of a segment of the index.
BLOCK = 1_000_000
SEGMENT = 1_500_000


class Terms(dict):
    """Numbers of words, from 0, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Block:
    """Windows of some benchmark items, as numbers of the block's own vocabulary, padded with -1 to the longest.

    ``items``: the items that have each window.  ``anchor``: the rarest term of each window (in the block), ``order`` the windows
    by their anchors.  ``phrases``: the terms of whole items.
    """

    vocabulary: dict[bytes, int]
    windows: np.ndarray
    items: list[list[int]]
    anchor: np.ndarray
    order: np.ndarray
    phrases: dict[int, np.ndarray]

    @staticmethod
    def of(rows: list[tuple[int, list[bytes]]], width: int) -> Block:
        terms = Terms()
        found: dict[tuple[int, ...], list[int]] = {}
        phrases: dict[int, np.ndarray] = {}
        for item, tokens in rows:
            ids = [terms[w] for w in tokens]
            phrases[item] = np.union1d(phrases[item], ids) if item in phrases else np.unique(np.array(ids, np.int64))
            for k in range(max(1, len(ids) - width + 1) if ids else 0):
                owners = found.setdefault(tuple(ids[k : k + width]), [])
                if item not in owners[-1:]:
                    owners.append(item)
        windows = np.full((len(found), width), -1, np.int64)
        for k, w in enumerate(found):
            windows[k, : len(w)] = w
        used = np.bincount(windows[windows >= 0], minlength=len(terms)) if len(terms) else np.zeros(0, np.int64)
        rarity = np.where(windows >= 0, used[windows], np.iinfo(np.int64).max) if len(found) else windows
        anchor = windows[np.arange(len(found)), rarity.argmin(axis=1)] if len(found) else np.zeros(0, np.int64)
        return Block(dict(terms), windows, list(found.values()), anchor, np.argsort(anchor, kind="stable"), phrases)


def blocks(items: DataFrame, id_col: str, text_col: str, width: int = WINDOW, whole: bool = False) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The benchmark's items with their words, in blocks of about ``BLOCK`` words; longer items are cut with ``width`` - 1 words in common, unless ``whole``."""
    block, size = [], 0
    for item, text in items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).toLocalIterator():
        tokens = words(bytes(text) if text else None, ALNUM)
        step = max(BLOCK, width) if not whole else max(len(tokens), 1)
        for at in range(0, max(1, len(tokens) - width + 1) if not whole else 1, step):
            part = tokens[at : at + step + width - 1] if not whole else tokens
            if block and size + len(part) > BLOCK:
                yield block
                block, size = [], 0
            block.append((item, part))
            size += len(part)
    if block:
        yield block


SEGMENTS = "segment string, docs array<long>, keys array<long>, lengths array<long>, vocabulary binary, counts array<int>, places binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of (doc, key, text)."""
    schema = pa.schema([("segment", pa.string()), ("docs", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("vocabulary", pa.binary()), ("counts", pa.list_(pa.int32())), ("places", pa.binary())])
    packed = lambda raw: zstandard.ZstdCompressor(level=1).compress(raw)

    def emit(docs: list, keys: list, ids: list[np.ndarray], terms: Terms) -> pa.RecordBatch:
        lengths = np.array([len(x) for x in ids], np.int64)
        number = np.concatenate(ids)
        at = (np.arange(len(number)) + np.repeat(np.arange(len(ids)), lengths)).astype(np.uint32)
        order = np.argsort(number, kind="stable")
        places = at[order]
        steps = np.diff(places, prepend=np.uint32(0))
        row = (uuid.uuid4().hex, docs, keys, lengths, packed(b" ".join(terms)), np.bincount(number, minlength=len(terms)).astype(np.int32), packed(steps.view(np.uint8).reshape(-1, 4).T.tobytes()))
        return pa.record_batch([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

    docs, keys, ids, size, terms = [], [], [], 0, Terms()
    for batch in batches:
        for doc, key, text in zip(batch.column("doc").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), strict=True):
            tokens = words(text.as_py(), ALNUM)
            docs.append(doc)
            keys.append(key)
            ids.append(np.fromiter(map(terms.__getitem__, tokens), np.uint32, len(tokens)))
            size += len(tokens) + 1
            if size >= SEGMENT:
                yield emit(docs, keys, ids, terms)
                docs, keys, ids, size, terms = [], [], [], 0, Terms()
    if docs:
        yield emit(docs, keys, ids, terms)


class Segment:
    """A row of the index, unpacked, with the terms of one block."""

    def __init__(self, row: dict, block: Block):
        unpacked = lambda x: zstandard.ZstdDecompressor().decompress(x)
        self.name, self.docs, self.keys, self.lengths = row["segment"], row["docs"], row["keys"], np.array(row["lengths"], np.int64)
        self.base = np.concatenate(([0], np.cumsum(self.lengths + 1)))
        counts = np.array(row["counts"], np.int64)
        ends = np.cumsum(counts)
        self.freq = np.zeros(len(block.vocabulary), np.int64)
        self.places: dict[int, np.ndarray] = {}
        own = [(block.vocabulary[w], k) for k, w in enumerate(unpacked(row["vocabulary"]).split()) if w in block.vocabulary]
        if own:
            raw = np.frombuffer(unpacked(row["places"]), np.uint8)
            places = np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32).astype(np.int64)
            for term, k in own:
                self.places[term] = places[ends[k] - counts[k] : ends[k]]
                self.freq[term] = counts[k]
        self.block = block
        self.none = np.zeros(0, np.int64)

    def of(self, term: int) -> np.ndarray:
        return self.places.get(int(term), self.none)

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Starts of an exact phrase: lists of places, shifted by their offsets, intersected from the rarest term on."""
        lists = sorted(((self.of(t), k) for k, t in enumerate(terms)), key=lambda x: len(x[0]))
        starts = lists[0][0] - lists[0][1]
        for places, k in lists[1:]:
            if not len(starts):
                break
            want = starts + k
            at = np.searchsorted(places, want)
            at[at == len(places)] = 0
            starts = starts[places[at] == want]
        return starts

    def near(self, terms: np.ndarray, stretch: int) -> list[tuple[int, int]]:
        """(begin, end) of the shortest stretch of at most ``stretch`` words with all ``terms``, the first of equals, in each document that has one.

        Only places near one of the rarest term are looked at; the other terms' lists are taken up from the next rarest on, and a
        place of the rarest goes as soon as one of them has nothing within reach in its document.
        """
        lists = sorted((self.of(t) for t in terms), key=len)
        spots = lists[0]
        doc = np.searchsorted(self.base, spots, "right") - 1
        for places in lists[1:]:
            low = np.maximum(spots - stretch + 1, self.base[doc])
            high = np.minimum(spots + stretch - 1, self.base[doc] + self.lengths[doc] - 1)
            ok = np.searchsorted(places, high, "right") > np.searchsorted(places, low)
            spots, doc = spots[ok], doc[ok]
        best: dict[int, tuple[int, int, int]] = {}
        for d in np.unique(doc).tolist():
            mine = spots[doc == d]
            low, high = self.base[d], self.base[d] + self.lengths[d]
            here = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in lists]
            here = [x[(np.searchsorted(mine, x + stretch) > np.searchsorted(mine, x - stretch + 1))] for x in here]  # in reach of the rarest
            at = np.concatenate(here)
            which = np.repeat(np.arange(len(here)), [len(x) for x in here])
            order = np.argsort(at, kind="stable")
            last = np.full(len(here), -1, np.int64)
            for p, k in zip(at[order].tolist(), which[order].tolist(), strict=True):
                last[k] = p
                first = last.min()
                if first >= 0 and p - first < stretch and (p - first, first) < best.get(d, (stretch, 0, 0))[:2]:
                    best[d] = (p - first, int(first), p + 1)
        return [(begin, end) for _, begin, end in best.values()]

    def windows(self) -> Iterator[tuple[np.ndarray, int, list[int]]]:
        """(starts, words, items) of each window of the block that stands in the segment."""
        b = self.block
        present = self.freq > 0
        terms = np.flatnonzero(present)
        low, high = np.searchsorted(b.anchor[b.order], terms), np.searchsorted(b.anchor[b.order], terms, "right")
        total = high - low
        fetched = b.order[np.repeat(low - np.concatenate(([0], np.cumsum(total)[:-1])), total) + np.arange(total.sum())] if len(terms) else terms
        rows = b.windows[fetched]
        whole = (present[rows] | (rows < 0)).all(axis=1) if len(fetched) else np.zeros(0, bool)
        for k, row in zip(fetched[whole].tolist(), rows[whole], strict=True):
            row = row[row >= 0]
            if len(starts := self.phrase(row)):
                yield starts, len(row), b.items[k]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of the places of all words of the documents, in the shared folder; an index serves any benchmark."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    return stored(rows.mapInArrow(_segments, SEGMENTS), "index")


def _batch(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True) if out else [()] * len(schema), schema.types, strict=True)], schema=schema)


def _passes(index: DataFrame, items: DataFrame, item_col: str, item_text: str, width: int, search, kinds: str, schema: pa.Schema, whole: bool = False) -> DataFrame:
    """``search(segment)`` of each segment and each block of the benchmark; a block at a time is sent out."""
    send = index.sparkSession.sparkContext.broadcast

    def one(block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield _batch(search(Segment(row, block.value)), schema)

        return index.mapInArrow(run, kinds)

    found = None
    for rows in blocks(items, item_col, item_text, width, whole):
        part = one(send(Block.of(rows, width)))
        found = part if found is None else found.unionByName(part)
    return index.sparkSession.createDataFrame([], kinds) if found is None else found


def matches(docs: DataFrame, items: DataFrame, within: int | None = None, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, item, begin, end) in words: exact windows of ``width`` words; or with ``within`` the shortest stretch of a document that has
    all words of an item, at most ``within`` words more than the item has different ones."""

    def phrases(segment: Segment) -> list[tuple]:
        out = []
        for starts, n, owners in segment.windows():
            for k, s in zip(np.searchsorted(segment.base, starts, "right") - 1, starts.tolist(), strict=True):
                out += [(segment.docs[k], item, s - int(segment.base[k]), s - int(segment.base[k]) + n) for item in owners]
        return out

    def near(segment: Segment) -> list[tuple]:
        out = []
        for item, terms in segment.block.phrases.items():
            if len(terms) and (segment.freq[terms] > 0).all():
                for begin, end in segment.near(terms, len(terms) + within):
                    k = int(np.searchsorted(segment.base, begin, "right")) - 1
                    out.append((segment.docs[k], item, begin - int(segment.base[k]), end - int(segment.base[k])))
        return out

    schema = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
    search = phrases if within is None else near
    found = _passes(build_index(docs, id_col, text_col), items, item_col, item_text, width, search, "doc long, item long, begin long, end long", schema, within is not None)
    return found.distinct() if within is None else found


def _hits(segment: Segment) -> list[tuple]:
    """(segment, nth, spans, items) of the documents with windows of the block; spans: begin and end, in words, in turn."""
    edges = np.zeros(segment.base[-1] + 1, np.int32)
    items: dict[int, set[int]] = {}
    for starts, n, owners in segment.windows():
        edges[starts] += 1
        np.subtract.at(edges, starts + n, 1)
        for k in np.unique(np.searchsorted(segment.base, starts, "right") - 1).tolist():
            items.setdefault(k, set()).update(owners)
    covered = np.cumsum(edges) > 0
    out = []
    for k, found in items.items():
        flags = covered[segment.base[k] : segment.base[k] + segment.lengths[k]].astype(np.int8)
        out.append((segment.name, k, np.flatnonzero(np.diff(flags, prepend=0, append=0)).tolist(), sorted(found)))
    return out


def finished(doc: int | None, n_words: int, n_hit: int, items) -> tuple:
    names = sorted(map(str, items))
    return doc, n_words, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _judged(docs: DataFrame, items: DataFrame, width: int, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """``RESULT`` and the key, a hash of the text, of each document: what all blocks found, put together."""
    index = build_index(docs, id_col, text_col)
    schema = pa.schema([("segment", pa.string()), ("nth", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])
    hits = _passes(index, items, item_col, item_text, width, _hits, "segment string, nth long, spans array<long>, items array<long>", schema)
    hits = stored(hits.groupBy("segment", "nth").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items")), "hits")
    every = index.select("segment", F.posexplode(F.arrays_zip("docs", "keys", "lengths")).alias("nth", "x")).select("segment", F.col("nth").cast("long").alias("nth"), F.col("x.docs").alias("doc"), F.col("x.keys").alias("key"), F.col("x.lengths").alias("n_words"))
    out = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]]) for x in f"{RESULT}, key long".split(", ")])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, key, n, spans, found in zip(*(batch.column(x).to_pylist() for x in ("doc", "key", "n_words", "spans", "items")), strict=True):
                edges = np.zeros(n + 1 if spans else 1, np.int64)
                for one in spans or ():
                    edges[one[::2]] += 1
                    np.subtract.at(edges, one[1::2], 1)
                rows.append((*finished(doc, n, int(np.count_nonzero(np.cumsum(edges) > 0)), {i for x in found or () for i in x}), key))
            yield _batch(rows, out)

    return every.join(hits, ["segment", "nth"], "left").select("doc", "key", "n_words", "spans", "items").mapInArrow(merge, f"{RESULT}, key long")


def digest(docs: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: words, words inside windows of the benchmark, items, and the verdict (a twentieth of the words hit)."""
    return _judged(docs, items, width, id_col, text_col, item_col, item_text).drop("key")


def clean(docs: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated: of rows with one id none if one is, rows without an id by their own text."""
    name = lambda doc, key: F.when(doc.isNotNull(), F.concat(F.lit("d"), doc.cast("string"))).otherwise(F.concat(F.lit("t"), key.cast("string")))
    gone, own = fresh(docs, "gone"), fresh(docs, "own")
    bad = stored(_judged(docs, items, width, id_col, text_col, item_col, item_text).where("contaminated").select(name(F.col("doc_id"), F.col("key")).alias(gone)).distinct(), "contaminated")
    return docs.withColumn(own, name(F.col(id_col).cast("long"), F.xxhash64(text_col))).join(bad, F.col(own) == F.col(gone), "left_anti").select(*docs.columns)
