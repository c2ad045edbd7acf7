"""Connected components of a link table by rounds of large-star and small-star steps; nothing goes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, stored


def _star(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """Link each node's neighbours to the least node of its neighbourhood: the larger ones, or the smaller ones and itself.

    The least nodes are a table of their own, so the join deals both sides out itself and splits the edges of a hub.
    """
    if keep_larger:
        pairs = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    joined = pairs.join(least, "a")
    if keep_larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = stored(out.where("a <> b").distinct(), "edges")
    discard(edges, least)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``links`` (a, b) reaches.  Nodes that are least themselves have no row.

    Rounds go on until one changes nothing, however long the longest chain is; each round shortens chains by a factor.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sums = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(7)))).first()
    last = sums(edges)
    while True:
        edges = _star(_star(edges, True), False)
        before, last = last, sums(edges)
        if before == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
