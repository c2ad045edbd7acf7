"""Retrieval: plan sets over segments and vectors to hits, and hits to fused evidence.

All functions work on whole tables of plan sets at once: (query_id, set_no, episode_id, lo, hi, ...).  Ties that depend on the order
of insertion are broken by explicit ordinals (modality_ord, hit_ord).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import overlap
from tessera.operators.vectors import Blocks

SET = ["query_id", "set_no"]
#: The order in which modalities add hits.
MODALITIES = ["time", "label", "text_emb", "keyword", "audio_emb", "domain_emb"]
TOP_K, KEYWORD_LIMIT, VECTOR_K = 10, 10, 5


def within(sets: DataFrame, segments: DataFrame) -> DataFrame:
    """Plan sets joined to the segments of their episode that overlap their window; the equi-key is the episode."""
    s = segments.withColumnRenamed("episode_id", "_ep")
    return sets.join(s, (F.col("episode_id") == F.col("_ep")) & (F.col("end") > F.col("lo")) & (F.col("start") < F.col("hi"))).drop("_ep")


def _hits(df: DataFrame, source: str, score: Column, order: list, limit: int | None = None) -> DataFrame:
    w = Window.partitionBy(*SET).orderBy(*order)
    out = df.withColumn("score", score).withColumn("hit_ord", F.row_number().over(w).cast("long"))
    out = out if limit is None else out.where(F.col("hit_ord") <= limit)
    return out.select(*SET, "seg_id", "start", "end", F.lit(source).alias("source"), F.col("score").cast("double").alias("score"), F.lit(MODALITIES.index(source)).alias("modality_ord"), "hit_ord")


def search_time(sets: DataFrame, segments: DataFrame) -> DataFrame:
    """Share of the window that a segment fills, best first."""
    length = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1)
    score = F.round(overlap(F.col("start"), F.col("end"), F.col("lo"), F.col("hi")) / length, 3)
    found = within(sets, segments).where(overlap(F.col("start"), F.col("end"), F.col("lo"), F.col("hi")) > 0)
    return _hits(found.withColumn("_score", score), "time", F.col("_score"), [F.col("_score").desc(), "ord"])


def search_label(sets: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments whose primary label is the set's ``label``, whatever the case; scored by the label's own score, 1 without one."""
    found = within(sets.where("label is not null and label <> ''"), segments.withColumnRenamed("label", "primary")).where(F.lower("primary") == F.lower("label"))
    return _hits(found, "label", F.round(F.coalesce(F.col("label_score"), F.lit(1.0)), 3), ["ord"])


def search_keyword(sets: DataFrame, segments: DataFrame, limit: int = KEYWORD_LIMIT) -> DataFrame:
    """The first segments in file order whose text holds the keyword, whatever the case."""
    found = within(sets.where("keyword is not null and keyword <> ''"), segments).where(F.contains(F.lower("text"), F.lower("keyword")))
    return _hits(found, "keyword", F.lit(1.0), ["ord"], limit)


def search_vectors(sets: DataFrame, vectors: DataFrame, source: str, k: int = VECTOR_K) -> DataFrame:
    """The ``k`` vectors of the episode and window most like the set's by cosine; filtered first, then exact (see ``vectors.Blocks``).

    A set's vector is ``query_vector``, or ``<source>_vector`` where sets have one for each space.
    """
    own = f"{source}_vector" if f"{source}_vector" in sets.columns else "query_vector"
    asked = sets.where(F.col(own).isNotNull()).select(F.struct(*SET).alias("qid"), "episode_id", "lo", "hi", F.col(own).alias("query_vector"))
    found, _ = Blocks(vectors).search(asked, k)
    return _hits(found.select("qid.*", "seg_id", "start", "end", "idx", F.col("score").alias("_score")), source, F.round(F.col("_score"), 3), [F.col("_score").desc(), "idx"], k)


def fuse(hits: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Hits of all modalities to evidence: best positive score of each source, their sum, the ``top_k`` by it, in time order.

    A segment whose scores are all 0 or less stays a candidate with sum 0; ties go to what was inserted first.
    """
    best = hits.groupBy(*SET, "seg_id", "source").agg(F.max("score").alias("score"), F.min(F.struct("modality_ord", "hit_ord")).alias("first"), F.min("start").alias("start"), F.min("end").alias("end"))
    sources = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("score") > 0, F.struct("source", F.round("score", 3).alias("score"))))))
    one = best.groupBy(*SET, "seg_id").agg(sources.alias("sources"), F.round(F.sum(F.when(F.col("score") > 0, F.round("score", 3)).otherwise(0.0)), 3).alias("fused"), F.min("first").alias("first"), F.min("start").alias("start"), F.min("end").alias("end"))
    ranked = one.withColumn("_r", F.row_number().over(Window.partitionBy(*SET).orderBy(F.col("fused").desc(), "first", "seg_id"))).where(F.col("_r") <= top_k)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*SET).orderBy("start", "_r"))).select(*SET, "rank", "seg_id", "start", "end", "sources", "fused")


def dispatch(sets: DataFrame, segments: DataFrame, vectors: dict[str, DataFrame] | None = None, modalities: tuple[str, ...] = ("time", "label", "keyword"), top_k: int = TOP_K, searched: list[str] | None = None) -> DataFrame:
    """Every enabled modality over every set, then fusion.  Time search runs whenever it is enabled, whatever a set asks for.

    ``searched``: the sets' columns that the searches of segments need, without the vectors.
    """
    parts, plain = [], sets if searched is None else sets.select(*searched)
    if "time" in modalities:
        parts.append(search_time(plain.drop("label"), segments))
    if "label" in modalities:
        parts.append(search_label(plain, segments))
    if "keyword" in modalities:
        parts.append(search_keyword(plain.drop("label"), segments))
    for source in ("text_emb", "audio_emb", "domain_emb"):
        if source in modalities and vectors and source in vectors:
            parts.append(search_vectors(sets, vectors[source], source))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    return fuse(hits, top_k)


def evidence(fused: DataFrame, segments: DataFrame) -> DataFrame:
    """Evidence rows for export: time pair, speaker, text, labels, sources."""
    s = segments.select("seg_id", *[c for c in ("speaker", "text", "label") if c in segments.columns])
    return fused.join(s, "seg_id").select(*SET, "rank", "seg_id", F.array("start", "end").alias("time"), *s.columns[1:], "sources")


def clip_span(fused: DataFrame, longest: float = 60.0, sets: DataFrame | None = None) -> DataFrame:
    """(query_id, set_no, lo, hi): whole seconds that the evidence spans, ``longest`` at most.

    With ``sets`` (query_id, set_no, lo, hi) every set has a span: one without evidence that of its window.
    """
    span = fused.groupBy(*SET).agg(F.min("start").cast("long").alias("lo"), F.max("end").cast("long").alias("_hi"))
    if sets is not None:
        window = sets.select(*SET, F.col("lo").cast("long").alias("_wl"), F.col("hi").cast("long").alias("_wh"))
        span = window.join(span, SET, "left").select(*SET, F.coalesce("lo", "_wl").alias("lo"), F.coalesce("_hi", "_wh").alias("_hi"))
    return span.select(*SET, "lo", F.least(F.col("_hi"), F.col("lo") + F.lit(int(longest))).alias("hi"))


def parse_plans(plans: DataFrame, text_col: str = "plan") -> DataFrame:
    """One row per set of a JSON plan, fences stripped; what doesn't parse has no sets."""
    from tessera.functions.text import strip_fence
    from tessera.schemas import PLAN_JSON

    parsed = plans.withColumn("_p", F.from_json(strip_fence(F.col(text_col)), PLAN_JSON))
    return parsed.select(*[c for c in plans.columns if c != text_col], F.posexplode("_p.sets").alias("set_no", "_s")).select("*", "_s.*").drop("_s")


def active_tools(sets: DataFrame) -> DataFrame:
    """(query_id, active): names of the plan's fields that are set (not null, false or empty) in any set; none is an empty list."""
    on = [F.when(F.coalesce(F.col("time"), F.lit(False)), F.lit("time"))] + [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.lit(c)) for c in MODALITIES if c != "time"]
    return sets.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.array(*on), lambda x: x.isNotNull()))))).alias("active"))
