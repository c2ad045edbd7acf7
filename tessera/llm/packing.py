"""Packing by optimal length buckets.

Every document becomes pieces of at most ``longest`` tokens (its words and one end mark, so an empty document has one).
The lengths of all documents are counted once and stored.  The histogram of piece lengths over the whole corpus, at most
``longest`` rows, goes to the driver; dynamic programming over it finds the bucket boundaries with the least padding.
Pieces of a bucket are dealt to shares by a hash of their row's number in the stored table, so equal and null ids spread
too, as many as the histogram asks for, and each share fills token-budget batches on its own: a batch has ``budget`` // bucket
length pieces, and only the last of a share may have fewer.  So no window covers a whole bucket.

Defined cases: null and empty texts are one piece of one token; null ids and repeated rows are packed like others, ties in
the order are by piece number; texts of any length work; every row and token is packed, none twice; an empty table gives an
empty result; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

BUCKETS, LONGEST, BUDGET = 16, 4096, 65_536
#: Pieces that a share has, about.
SHARE = 10_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets over the histogram (rising ``lengths``) with the least padded total.

    best[b][i]: least total of the first i lengths in b buckets.  The best last cut rises with i, so each row is found by
    halving (divide and conquer), with ties to the earlier cut.
    """
    n = len(lengths)
    total = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    best = np.concatenate(([0], lengths.astype(np.int64) * total[1:]))
    cuts = []
    for _ in range(min(buckets, n) - 1):
        new, cut = best.copy(), np.arange(n + 1)
        todo = [(1, n, 0, n)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            i = (low + high) // 2
            k = np.arange(first, min(last, i - 1) + 1)
            cost = best[k] + lengths[i - 1] * (total[i] - total[k])
            at = int(np.argmin(cost))
            new[i], cut[i] = cost[at], k[at]
            todo += [(low, i - 1, first, int(k[at])), (i + 1, high, int(k[at]), last)]
        cuts.append(cut)
        best = new
    ends, i = [n], n
    for cut in reversed(cuts):
        i = int(cut[i])
        if i == 0:
            break
        ends.append(i)
    return [int(lengths[e - 1]) for e in reversed(ends)]


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, row) of each document, stored; ``row`` is a number that no other row has."""
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1
    return stored(docs.select(F.col(id_col).alias("doc_id"), tokens.cast("long").alias("tokens"), F.monotonically_increasing_id().alias("row")), "lengths")


def pieces(counted: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(doc_id, row, piece, first_token, n_tokens) of each document of ``lengths``."""
    split = counted.select("doc_id", "tokens", "row", F.explode(F.expr(f"sequence(0L, (tokens - 1) div {longest}L)")).alias("piece"))
    return split.select("doc_id", "row", F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("first_token"), F.least(F.lit(longest).cast("long"), F.col("tokens") - F.col("piece") * longest).alias("n_tokens"))


def pack(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece with its bucket's length, its batch, its slot in the batch and its padding."""
    cut = pieces(lengths(docs, id_col, text_col), longest)
    seen = sorted((int(r[0]), int(r[1])) for r in cut.groupBy("n_tokens").count().collect())
    if not seen:
        return cut.select("doc_id", "piece", "first_token", "n_tokens", F.lit(0).cast("long").alias("bucket_tokens"), F.lit("").alias("batch"), F.lit(0).alias("slot"), F.lit(0).cast("long").alias("padding"))
    sizes, counts = (np.array(x, np.int64) for x in zip(*seen, strict=True))
    ends = boundaries(sizes, counts, buckets)
    held = np.add.reduceat(counts, np.concatenate(([0], np.searchsorted(sizes, ends[:-1], "right")))).tolist()
    bucket, share, fits = F.lit(None), F.lit(None), F.lit(None)
    for end, n in reversed(list(zip(ends, held, strict=True))):
        here = F.col("n_tokens") <= end
        bucket, share, fits = F.when(here, F.lit(end)).otherwise(bucket), F.when(here, F.lit(-(-n // SHARE))).otherwise(share), F.when(here, F.lit(max(1, budget // end))).otherwise(fits)
    dealt = cut.withColumn("bucket_tokens", bucket.cast("long")).withColumn("share", F.pmod(F.xxhash64("row", "piece"), share.cast("long"))).withColumn("fits", fits.cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket_tokens", "share").orderBy("doc_id", "row", "piece")) - 1
    placed = dealt.withColumn("place", place)
    return placed.select("doc_id", "piece", "first_token", "n_tokens", "bucket_tokens", F.format_string("%d-%d-%d", "bucket_tokens", "share", F.floor(F.col("place") / F.col("fits"))).alias("batch"), (F.col("place") % F.col("fits")).alias("slot"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"))
