"""Substring dedup by recompression: words of long passages that an earlier document already has are found and cut.

A *window* is ``width`` consecutive words of one document.  A word is repeated if a window over it also starts in a
document with a smaller id; windows are judged on the input.  Steps, none of which gathers a group in one task:

1. ``recompression.anchors`` gives each window an anchor symbol.  Consecutive windows with one anchor form a stretch, which
   travels as one row: anchor, hash of its words, document, places.  About 18 windows share a row; equal stretches of a document
   are one row.  Of the equal stretches of a batch only the smallest id meets those of other batches; and where a batch sees
   that an anchor stands in different stretches, these are dealt by anchor and words and only a signal goes to the anchor, so
   neither a hot passage nor a hot anchor gathers in a task.
2. By anchor: a stretch with the same words in a smaller document may be repeated.  An anchor with different stretches in
   different documents (the borders of passages) needs its windows looked at one by one.
3. Only those documents are read again, and what may be repeated is verified on the words: stretches with copies as a whole,
   border stretches window by window, by a 128-bit cryptographic digest of the words themselves.
4. Verified spans are gathered per document and cut from its text.

Defined cases: null or empty text has no words; a null id has no repeats and causes none; rows with one id and different
texts are rows of one document, each with its own places; equal rows both stay; texts of any length work, in memory of a few
dozen times one text; an empty table gives an empty result; other columns, whatever their names, pass through unchanged.
Ids must cast to long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Hashes, discard, fresh, mix, partitions, stored, word_hashes, words
from tessera.llm.recompression import anchors, prefix_sums, span_hash

WIDTH = 50
#: Words that are worked on at once.
BATCH = 600_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _key(text: Column) -> Column:
    """The name of a text among those of its id: a cryptographic digest of 128 bits, since spans are cut by it."""
    return F.unhex(F.md5(text.cast("binary")))


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], make) -> Iterator[tuple[list, list, np.ndarray]]:
    """Rows with what ``make`` makes of their words, about ``BATCH`` words at a time: (columns of ``names``, made, words of each row)."""
    rows: list[list] = [[] for _ in names]
    made: list = []
    count: list[int] = []
    size = 0
    for batch in batches:
        other = [batch.column(x).to_pylist() for x in names]
        for k, text in enumerate(batch.column("text")):
            tokens = words(text.as_py())
            if not tokens:
                continue
            made.append(make(tokens))
            count.append(len(tokens))
            size += len(tokens)
            for to, of in zip(rows, other, strict=True):
                to.append(of[k])
            if size >= BATCH:
                yield rows, made, np.array(count)
                rows, made, count, size = [[] for _ in names], [], [], 0
    if made:
        yield rows, made, np.array(count)


def _first_of_equal(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where no row with equal ``a`` and ``b`` has a smaller ``doc``."""
    order = np.lexsort((doc, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    group = np.cumsum(new) - 1
    least = doc[order][np.flatnonzero(new)][group]
    out = np.empty(len(a), bool)
    out[order] = doc[order] == least
    return out


def _copied(a: np.ndarray, b: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True for rows that are ``first`` of rows with equal ``a`` and ``b`` of which some are not."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    some = np.logical_or.reduceat(~first[order], np.flatnonzero(new)) if len(a) else new
    out = np.empty(len(a), bool)
    out[order] = some[np.cumsum(new) - 1]
    return out & first


def _on_border(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True for rows whose anchor has different contents and different documents."""
    order = np.argsort(anchor, kind="stable")
    at = np.flatnonzero(np.concatenate(([True], anchor[order][1:] != anchor[order][:-1]))) if len(anchor) else order
    differ = lambda x: np.minimum.reduceat(x[order], at) != np.maximum.reduceat(x[order], at)
    out = np.empty(len(anchor), bool)
    if len(anchor):
        out[order] = np.repeat(differ(content) & differ(doc), np.diff(np.append(at, len(anchor))))
    return out


def _gathered(columns: list[np.ndarray], begin: np.ndarray) -> tuple[list[np.ndarray], pa.ListArray]:
    """The different rows of ``columns``, and the begins of each."""
    order = np.lexsort((begin, *columns))
    new = np.zeros(len(begin), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    at = np.flatnonzero(new)
    return [c[order][at] for c in columns], pa.ListArray.from_arrays(pa.array(np.append(at, len(begin)).astype(np.int32)), pa.array(begin[order].astype(np.int32)))


STRETCHES = "anchor long, words_hash long, doc long, key binary, count int, begins array<int>, repeated boolean, source boolean, border boolean, signal boolean"


def _stretches(width: int):
    names = [x.split()[0] for x in STRETCHES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Hashes()
        for (doc, key), hashes, count in _groups(batches, ["doc", "key"], lambda tokens: word_hashes(tokens, seen)):
            tokens = np.concatenate(hashes)
            if len(tokens) < width:
                continue
            row = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(count) - count, count)
            starts = np.flatnonzero(place + width <= np.repeat(count, count))
            if not len(starts):
                continue
            anchor = anchors(tokens, row, width)[starts]
            first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (np.diff(starts) > 1))))
            size = np.diff(np.append(first, len(starts)))
            begin = starts[first]
            sums, inverse = prefix_sums(tokens)
            content = span_hash(sums, inverse, begin, begin + size + (width - 1))
            at = row[begin]
            (rows, size, content, anchor), begins = _gathered([at, size, content, anchor[first]], place[begin])
            doc_ids, keys = np.array(doc, np.int64)[rows], pa.array(key, pa.binary()).take(pa.array(rows))
            least = _first_of_equal(anchor, content, doc_ids)
            border = _on_border(anchor, content, doc_ids)
            dealt = np.where(~least, mix(anchor + np.arange(len(anchor), dtype=np.uint64)), np.where(border, mix(anchor ^ content), anchor))
            no = np.zeros(len(anchor), bool)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (dealt.view(np.int64), content.view(np.int64), doc_ids)] + [keys, pa.array(size.astype(np.int32)), begins] + [pa.array(x) for x in (~least, _copied(anchor, content, doc_ids, least), border, no)], names=names)
            told = np.flatnonzero(border)
            told = told[np.unique(anchor[told], return_index=True)[1]]
            if len(told):
                none = pa.array([[]] * len(told), pa.list_(pa.int32()))
                yes, no = np.ones(len(told), bool), no[: len(told)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[told].view(np.int64), mix(content[told] ^ anchor[told]).view(np.int64), doc_ids[told])] + [keys.take(pa.array(told)), pa.array(size[told].astype(np.int32)), none] + [pa.array(x) for x in (no, no, yes, yes)], names=names)

    return run


VERIFIED = "d1 long, d2 long, doc long, key binary, n int, begins array<int>, repeated boolean"


def _digests(width: int):
    """Digests of the words of stretches and windows of (doc, key, text, parts); equal ones of a document are one row."""
    names = [x.split()[0] for x in VERIFIED.split(", ")]

    def joined(tokens: list[bytes]) -> tuple[bytes, np.ndarray]:
        return b" ".join(tokens), np.cumsum([0] + [len(x) + 1 for x in tokens])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (doc, key, parts), texts, _ in _groups(batches, ["doc", "key", "parts"], joined):
            found, begin, length, owner = [], [], [], []
            for k, ((text, at), mine) in enumerate(zip(texts, parts, strict=True)):
                spans = set()
                for p in mine:
                    for b in p["begins"]:
                        if p["whole"]:
                            spans.add((b, p["count"] + width - 1))
                        if p["windows"]:
                            spans.update((x, width) for x in range(b, b + p["count"]))
                at = at.tolist()
                for b, n in spans:
                    found.append(hashlib.blake2b(text[at[b] : at[b + n] - 1], digest_size=16).digest())
                    begin.append(b)
                    length.append(n)
                    owner.append(k)
            if not found:
                continue
            both = np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)
            (n, rows, d2, d1), begins = _gathered([np.array(length), np.array(owner), both[:, 1], both[:, 0]], np.array(begin))
            doc_ids, keys = np.array(doc, np.int64)[rows], pa.array(key, pa.binary()).take(pa.array(rows))
            least = _first_of_equal(d1, d2, doc_ids)
            d1 = np.where(least, d1, mix(d1 + np.arange(len(d1), dtype=np.uint64)))  # rows that are known to be repeated are scattered
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d1.view(np.int64), d2.view(np.int64), doc_ids)] + [keys, pa.array(n.astype(np.int32)), begins, pa.array(~least)], names=names)

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document with repeats: doc, key (a digest of the text), spans: array of begins and a length, in words."""
    n = partitions(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), _key(F.col(text_col)).alias("key"), F.col(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(_stretches(width), STRETCHES).repartition(n, "anchor")
    same, near = Window.partitionBy("anchor", "words_hash"), Window.partitionBy("anchor")
    judged = (
        found.withColumn("least", F.min("doc").over(same))
        .withColumn("most", F.max("doc").over(same))
        .withColumn("border", F.max("border").over(near) | ((F.min("words_hash").over(near) != F.max("words_hash").over(near)) & (F.min("doc").over(near) != F.max("doc").over(near))))
        .withColumn("repeated", F.col("repeated") | (F.col("least") < F.col("doc")))
        .withColumn("whole", F.col("repeated") | F.col("source") | (F.col("most") > F.col("doc")))
        .withColumn("windows", F.col("border") & ~F.col("repeated"))
        .where("not signal and (whole or windows)")
    )
    parts = stored(judged.groupBy("doc", "key").agg(F.collect_set(F.struct("begins", "count", "whole", "windows")).alias("parts")), "stretches")
    single = rows.join(parts, ["doc", "key"]).select("doc", "key", "text", "parts").mapInArrow(_digests(width), VERIFIED)
    repeated = single.withColumn("least", F.min("doc").over(Window.partitionBy("d1", "d2"))).where(F.col("repeated") | (F.col("least") < F.col("doc")))
    out = stored(repeated.groupBy("doc", "key").agg(F.collect_set(F.struct("begins", "n")).alias("spans")), "spans")
    discard(parts)
    return out


def _kept(count: int, spans: list | None) -> np.ndarray:
    """True for each word that no span covers."""
    edges = np.zeros(count + 1, np.int64)
    for s in () if spans is None else spans:
        begins = np.asarray(s["begins"], np.int64)
        np.add.at(edges, begins, 1)
        np.subtract.at(edges, begins + s["n"], 1)
    return np.cumsum(edges[:-1]) == 0


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> tuple[DataFrame, str]:
    """``docs`` with the spans to cut, an array, null where there are none; and the new column's name."""
    doc, key, spans = (fresh(docs, x) for x in ("doc", "key", "spans"))
    found = repeated_spans(docs, id_col, text_col, width).select(F.col("doc").alias(doc), F.col("key").alias(key), F.col("spans").alias(spans))
    return docs.join(found, (docs[id_col].cast("long") == found[doc]) & (_key(docs[text_col]) == found[key]), "left").drop(doc, key), spans


def cut(text: bytes, spans: list) -> bytes:
    """``text`` without the words in ``spans``.  Each kept word keeps the white space before it, but for the first."""
    found = [m.span() for m in WORD.finditer(text)]
    keep = _kept(len(found), spans)
    out = []
    for k, (begin, end) in enumerate(found):
        if keep[k]:
            out.append(text[found[k - 1][1] if k and out else begin : end])
    return b"".join(out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated passages cut from their texts; texts without any stay as they are, byte for byte."""
    columns = docs.columns
    marked, spans_col = with_spans(docs, id_col, text_col, width)

    @F.pandas_udf("string")
    def cut_all(text, spans):
        return pd.Series([cut(t.encode(), s).decode() if isinstance(t, str) and s is not None and len(s) else t for t, s in zip(text, spans, strict=True)], dtype=object)

    return marked.withColumn(text_col, F.when(F.col(spans_col).isNotNull(), cut_all(F.col(text_col), F.col(spans_col))).otherwise(F.col(text_col))).select(*columns)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("spans"), strict=True):
                tokens = words(text.as_py())
                spans = spans.as_py()
                kept = tokens if not spans else [w for w, k in zip(tokens, _kept(len(tokens), spans), strict=True) if k]
                out.append((doc, len(tokens), len(tokens) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True) if out else [()] * 4, schema.types, strict=True)], schema=schema)

    marked, spans_col = with_spans(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, width)
    return marked.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"), F.col(spans_col).alias("spans")).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
