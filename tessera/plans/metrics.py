"""Evaluation metrics and reports."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.intervals import coverage
from tessera.session import grows

#: Which groups of tools a query type needs; any tool of a group will do, other types need none.
REQUIRED_TOOLS = {
    "state": [["audio_emb"], ["text_emb", "keyword"]],
    "comparison": [["audio_emb"], ["text_emb", "keyword"]],
    "change": [["audio_emb"], ["text_emb", "keyword"]],
    "locate": [["audio_emb"], ["domain_emb"], ["label"]],
    "locate_hard": [["domain_emb"], ["label"]],
    "audio": [["audio_emb", "domain_emb"]],
}
#: What the letters of the annotation page stand for, by task and query type.
STATE_LETTERS = {"A": "N", "B": "H", "C": "S", "D": "A", "E": "U", "F": "F", "G": "D", "H": "C"}
CHANGE_LETTERS = {"A": "rising", "B": "falling", "C": "none"}
MUSIC_LETTERS = {"A": "A", "B": "B", "C": "Tie"}
HEALTH_LETTERS = {"A": "Yes", "B": "No"}
JUDGE_TOLERANCE, HUMAN_TOLERANCE, STORED_TOLERANCE = 3.0, 5.0, 15.0


def rationale_score(factual: Column, faithful: Column, audio: Column) -> Column:
    """Factual and faithful; factual alone for variants that hear the audio."""
    return F.when(audio, factual).otherwise(factual * faithful)


def hit_rate(truth: DataFrame, windows: DataFrame, key: str = "query_id") -> DataFrame:
    """Share of each query's ground truth that retrieved windows cover; 0 without windows."""
    return coverage(truth, windows, key).withColumnRenamed("covered", "hit_rate")


def plan_hit_rate(time_coverage: DataFrame, tools: DataFrame, kinds: DataFrame, required: dict[str, list[list[str]]] = REQUIRED_TOOLS) -> DataFrame:
    """(time coverage + groups with an active tool) / (1 + groups); time coverage alone where a type needs none.

    ``kinds``: query_id, query_type and, optional, ``oracle``: plans made from the truth count as 1.
    """
    table = F.create_map(*[x for k, groups in required.items() for x in (F.lit(k), F.array(*[F.array(*map(F.lit, g)) for g in groups]))])
    joined = kinds.join(grows(time_coverage), "query_id", "left").join(grows(tools), "query_id", "left").withColumn("_groups", F.element_at(table, F.col("query_type")))
    active = F.coalesce(F.col("active"), F.array().cast("array<string>"))
    hits = F.size(F.filter("_groups", lambda g: F.arrays_overlap(g, active)))
    covered = F.coalesce(F.col("covered"), F.lit(0.0))
    oracle = F.coalesce(F.col("oracle"), F.lit(False)) if "oracle" in kinds.columns else F.lit(False)
    return joined.select("query_id", "query_type", F.when(oracle, F.lit(1.0)).when(F.col("_groups").isNull(), covered).otherwise((covered + hits) / (1 + F.size("_groups"))).alias("plan_hit_rate"))


def scorecard(scores: DataFrame, metrics: list[str], variant: str = "variant", kind: str = "query_type") -> DataFrame:
    """Mean of each metric by type, and the plain mean of the types as type ``overall``.  NaN stays NaN."""
    by = scores.groupBy(variant, kind).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n"))
    overall = by.groupBy(variant).agg(*[F.avg(m).alias(m) for m in metrics], F.sum("n").alias("n")).withColumn(kind, F.lit("overall"))
    return by.unionByName(overall)


def scorecard_pivot(scores: DataFrame, metric: str, kinds: list[str], variant: str = "variant", kind: str = "query_type") -> DataFrame:
    return scores.groupBy(variant).pivot(kind, kinds).agg(F.avg(metric))


def micro(scores: DataFrame, value: str, by: list[str], kind: str = "query_type") -> DataFrame:
    """Mean over rows that have a value, by type and over all (type ``all``)."""
    means = [F.avg(value).alias("mean"), F.count(value).alias("n")]
    return scores.groupBy(*by, kind).agg(*means).unionByName(scores.groupBy(*by).agg(*means).withColumn(kind, F.lit("all")))


def cohen(a: Column, b: Column) -> Column:
    """Cohen's kappa of two binary raters as an aggregate; 1 where chance agreement is complete, NaN without rows."""
    agree, pa, pb = F.avg((a == b).cast("double")), F.avg(a.cast("double")), F.avg(b.cast("double"))
    chance = pa * pb + (1 - pa) * (1 - pb)
    return F.when(F.count(F.lit(1)) == 0, F.lit(float("nan"))).when(chance >= 1, 1.0).otherwise((agree - chance) / (1 - chance))


def fleiss(ratings: Column, raters: int) -> Column:
    """Fleiss' kappa of binary ratings; ``ratings``: the number of ones of each item."""
    ones, zeros = ratings.cast("double"), raters - ratings.cast("double")
    agree = F.avg((ones * (ones - 1) + zeros * (zeros - 1)) / (raters * (raters - 1)))
    p = F.avg(ones) / raters
    chance = p * p + (1 - p) * (1 - p)
    return F.when(F.count(F.lit(1)) == 0, F.lit(float("nan"))).when(chance >= 1, 1.0).otherwise((agree - chance) / (1 - chance))


def agreement(wide: DataFrame, judges: list[str], by: list[str]) -> DataFrame:
    """Pairwise kappas, Fleiss' kappa, unanimity and each judge's mean, on rows that all judges rated."""
    common = wide.dropna(subset=judges)
    total = sum((F.col(j) for j in judges), F.lit(0))
    pairs = [cohen(F.col(a), F.col(b)).alias(f"kappa_{a}_{b}") for a, b in combinations(judges, 2)]
    return common.groupBy(*by).agg(*pairs, fleiss(total, len(judges)).alias("fleiss"), F.avg(total.isin(0, len(judges)).cast("double")).alias("unanimous"), *[F.avg(j).alias(f"mean_{j}") for j in judges], F.count(F.lit(1)).alias("n"))


def rated_by_all(scores: DataFrame, judges: int, item: str = "query_id", judge: str = "judge") -> DataFrame:
    """Items that have a row of every judge."""
    return scores.groupBy(item).agg(F.count_distinct(judge).alias("_j")).where(F.col("_j") == judges).select(item)


def _meaning(letter: Column, table: dict[str, str], keep: bool) -> Column:
    """What a letter stands for; another value is null, or itself with ``keep``."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), letter)
    return F.coalesce(found, letter) if keep else found


def human_correct(task: Column, kind: Column, choice: Column, truth: dict[str, Column]) -> Column:
    """1, 0 or null (can't be scored) for a person's ``choice``, an array of letters or of one time (mm:ss or h:mm:ss).

    ``truth``: winner, direction, emo, t0, t1, answer.  Emotion: the winner for comparisons, the direction for changes, for
    states the true class among the chosen ones, for places a time within ``HUMAN_TOLERANCE`` of the interval.  Music: the
    winner, health: the answer, whatever their case.  A missing truth of music or health is an empty text, a missing bound is 0.
    """
    same = lambda a, b: F.coalesce((a == b).cast("int"), (a.isNull() & b.isNull()).cast("int"))
    choice = F.coalesce(choice, F.array(F.lit(None).cast("string")))
    one = F.get(choice, F.lit(0))
    states = F.transform(choice, lambda c: _meaning(c, STATE_LETTERS, False))
    state = F.exists(states, lambda c: c.eqNullSafe(truth["emo"])).cast("int")
    t = F.when(F.coalesce(one, F.lit("")) != "", text.clock_seconds(one))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    located = t.between(zero(truth["t0"]) - HUMAN_TOLERANCE, zero(truth["t1"]) + HUMAN_TOLERANCE).cast("int")
    emotion = (
        F.when(kind == "comparison", same(one, truth["winner"]))
        .when(kind == "change", same(_meaning(one, CHANGE_LETTERS, False), F.coalesce(truth["direction"], F.lit(""))))
        .when(kind == "state", state)
        .when(kind.isin("locate", "locate_hard"), located)
    )
    named = lambda letters, answer: (F.lower(_meaning(one, letters, True)) == F.lower(F.coalesce(answer, F.lit("")))).cast("int")
    return F.when(task == "emotion", emotion).when(task == "music", named(MUSIC_LETTERS, truth["winner"])).when(task == "health", named(HEALTH_LETTERS, truth["answer"]))


def expected_answer(row: dict[str, Column]) -> Column:
    """The first of a query's fields that is present, in the order of ``row``."""
    return F.coalesce(*row.values())


def tsv_scorecard(scores: DataFrame, path: str, kinds: list[str], variant: str = "variant", kind: str = "query_type") -> None:
    """One row per variant, answer and rationale of each type side by side, as tab-separated text."""
    wide = scores.groupBy(variant).pivot(kind, kinds).agg(F.round(F.avg("answer"), 4).alias("ans"), F.round(F.avg("rationale"), 4).alias("rat")).orderBy(variant)
    wide.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)
