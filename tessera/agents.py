"""Answering and judging whole tables of queries: plans, retrieval, answers; every model call is one batch over a table of prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import experts
from tessera.functions import text, timeparse
from tessera.operators import retrieval
from tessera.plans import prompts, truth
from tessera.session import stored

#: The modalities that each kind of agent may use.
VARIANTS = {"text": ("time", "label", "keyword"), "emb": ("time", "text_emb", "audio_emb", "domain_emb"), "hybrid": ("time", "label", "keyword", "text_emb", "audio_emb", "domain_emb")}


def planned(queries: DataFrame, model: experts.Maker, task: experts.Task, modalities: tuple[str, ...]) -> DataFrame:
    """(query_id, episode_id, plan): a model's plan for each query (query_id, episode_id, query, and note: what is known of its clips)."""
    asked = prompts.plan_prompts(queries, task, modalities)
    replies = stored(experts.batched(asked, model, "plan").select("query_id", "plan"), "plans")  # a model is asked once
    return replies.join(queries.select("query_id", "episode_id"), "query_id")


def plan_sets(plans: DataFrame, segments: DataFrame) -> DataFrame:
    """Plan sets with their windows; a plan that doesn't parse has none, a set whose time can't be told is left out and the others are numbered on."""
    from pyspark.sql import Window

    sets = timeparse.localize_sets(retrieval.parse_plans(plans), segments)
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("set_no")) - 1
    return sets.withColumn("_n", number.cast("int")).drop("set_no").withColumnRenamed("_n", "set_no")


def retrieved(sets: DataFrame, segments: DataFrame, vectors: dict[str, DataFrame] | None = None, references: dict[str, DataFrame] | None = None, modalities: tuple[str, ...] = VARIANTS["text"], top_k: int = 10) -> DataFrame:
    """Fused evidence of every set.

    ``vectors``: the vectors of a space (text_emb, audio_emb, domain_emb) by its name; ``references``: (query_id, ref, query_vector), the
    vector of the text or of the clip that a set's field of that name holds.  A reference without a vector finds nothing.
    """
    parts = [retrieval.search_time(sets, segments)] if "time" in modalities else []
    parts += [retrieval.search_label(sets, segments)] if "label" in modalities else []
    parts += [retrieval.search_keyword(sets, segments)] if "keyword" in modalities else []
    for space in ("text_emb", "audio_emb", "domain_emb"):
        if space in modalities and vectors and space in vectors and references and space in references:
            r = references[space].select(F.col("query_id").alias("_q"), F.col("ref").alias("_r"), "query_vector")
            pointed = sets.where(F.coalesce(F.col(space), F.lit("")) != "").join(r, (F.col("query_id") == F.col("_q")) & (F.col(space) == F.col("_r"))).drop("_q", "_r")
            parts.append(retrieval.search_vectors(pointed, vectors[space], space))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return retrieval.fuse(hits, top_k)


def answered(queries: DataFrame, plans: DataFrame, segments: DataFrame, model: experts.Maker, task: experts.Task, modalities: tuple[str, ...] = VARIANTS["text"], vectors: dict[str, DataFrame] | None = None, references: dict[str, DataFrame] | None = None, top_k: int = 10) -> DataFrame:
    """(query_id, prediction, rationale, n_evidence): answers of a model that sees the evidence of the plans (query_id, episode_id, plan)."""
    sets = stored(plan_sets(plans, segments), "sets")
    fused = stored(retrieved(sets, segments, vectors, references, modalities, top_k), "fused")
    blocks = prompts.evidence_blocks(retrieval.evidence(fused, segments))
    guides = sets.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("set_no", "localize"))), lambda x: x["localize"]).alias("l")).select("query_id", truth.set_guide(F.col("l")).alias("guide"))
    asked = prompts.answer_prompts(queries.join(guides, "query_id", "left"), blocks, task)
    replies = stored(experts.batched(asked, model).select("query_id", "reply"), "replies").withColumn("_a", text.answer_split(F.col("reply")))
    counts = fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    return replies.join(counts, "query_id", "left").select("query_id", F.col("_a.answer").alias("prediction"), F.col("_a.rationale").alias("rationale"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def oracle_answered(queries: DataFrame, truth_segments: DataFrame, segments: DataFrame, speakers: DataFrame, model: experts.Maker, task: experts.Task, top_k: int = 10) -> DataFrame:
    """As ``answered``, with plans made from the truth, which ask for times only."""
    made = truth.oracle_plans(queries, truth_segments, segments, speakers)
    as_json = F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("set_no", "localize"))), lambda x: F.struct(x["localize"].alias("localize"), F.lit(True).alias("time"))).alias("sets")))
    plans = queries.select("query_id", "episode_id").join(made.groupBy("query_id").agg(as_json.alias("plan")), "query_id")
    return answered(queries, plans, segments, model, task, ("time",), top_k=top_k)


def judged(predictions: DataFrame, queries: DataFrame, judge: experts.Maker, task: experts.Task, hears: bool = False) -> DataFrame:
    """(query_id, answer, factual, faithful, rationale) of predictions, all prompts in one batch; types that a task hides the speaker of are asked without it."""
    hidden = F.col("query_type").isin(*task.hide_speaker) if task.hide_speaker else F.lit(False)
    shown = predictions.join(queries.select("query_id", "query_type"), "query_id", "left")
    bare = shown.withColumn("block", F.when(F.coalesce(hidden, F.lit(False)), F.regexp_replace("block", r"(?m)^(\[[^\]]*\]) [^:(]*", "$1 ")).otherwise(F.col("block"))).drop("query_type")
    table = truth.judge_table(bare, queries, F.lit(hears))
    return truth.judged_scores(stored(experts.batched(table, judge).select("query_id", "kind", "reply"), "replies"))
