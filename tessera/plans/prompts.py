"""Prompts and text blocks for answering and judging, as columns of a prompts table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import one_digit
from tessera.functions.text import truncated
from tessera.operators.sampling import first_n
from tessera.session import grows


def segment_line(start: Column, end: Column, speaker: Column, text: Column, sources: Column | None = None) -> Column:
    """"[lo-hi] speaker (source=score, ...): text"."""
    named = F.lit("") if sources is None else F.concat(F.lit(" ("), F.array_join(F.transform(F.map_entries(sources), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.3f", e["value"]))), ", "), F.lit(")"))
    return F.concat(F.lit("["), one_digit(start), F.lit("-"), one_digit(end), F.lit("] "), F.coalesce(speaker, F.lit("?")), named, F.lit(": "), F.coalesce(truncated(text), F.lit("")))


def evidence_blocks(evidence: DataFrame) -> DataFrame:
    """(query_id, block): the evidence of a query's sets, set after set, in rank order."""
    line = segment_line(F.col("time")[0], F.col("time")[1], F.col("speaker"), F.col("text"), F.col("sources"))
    sets = evidence.groupBy("query_id", "set_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    titled = F.concat(F.format_string("Set %d:\n", F.col("set_no") + 1), F.col("lines"))
    return sets.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("set_no", titled.alias("t")))), lambda x: x["t"]), "\n\n").alias("block"))


def truth_block(segments: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, block): the first ``most`` segments of each key, and how many more there are.  Segments beyond those are only counted."""
    line = segment_line(F.col("start"), F.col("end"), F.col("speaker"), F.col("text"))
    counts = segments.groupBy(F.col(key).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    few = first_n(segments.select(key, "start", line.alias("line")), [key], ["start", "line"], most)
    rows = few.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "line"))).alias("few")).join(grows(counts), F.col(key).eqNullSafe(F.col("_of")))
    more = F.when(F.col("_n") > most, F.concat(F.lit("\n... and "), (F.col("_n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return rows.select(key, F.concat(F.array_join(F.transform("few", lambda x: x["line"]), "\n"), more).alias("block"))


def emotion_line(s: Column) -> Column:
    """What is known of a segment's emotion: class and vote shares, levels from 0 to 1, votes; '' for nothing.  ``s``: struct(primary, scores, valence, arousal, dominance, votes)."""
    entries = lambda m, shown: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), shown(e["value"]))), ", ")
    number = lambda x: F.when(x.isNotNull(), F.format_string("%.2f", x))
    named = F.concat(F.lit("primary="), s["primary"])
    shares = F.when(F.size(s["scores"]) > 0, F.concat(F.lit("["), entries(s["scores"], number), F.lit("]")))
    levels = F.nullif(F.concat_ws(", ", *[F.concat(F.lit(f"{d}="), number(s[d])) for d in ("valence", "arousal", "dominance")]), F.lit(""))
    votes = F.when(F.size(s["votes"]) > 0, entries(s["votes"], lambda v: v.cast("string")))
    emotion = F.nullif(F.concat_ws(" ", named, shares), F.lit(""))
    return F.concat_ws("\n", F.concat(F.lit("- emotion: "), emotion), F.concat(F.lit("- levels [0-1]: "), levels), F.concat(F.lit("- votes: "), votes))


def plan_prompts(queries: DataFrame, task, modalities: tuple[str, ...]) -> DataFrame:
    """(query_id, prompt): what a planner is asked: the task, what segments tell, the tools that are enabled, and the question."""
    tools = "\n".join(f"- {name}: {what}" for name, what in task.tools.items() if name in modalities)
    head = f"{task.description}\n{task.schema}\nTools:\n{tools}\nReply with JSON: a list of sets, each with localize and what to look for.\n"
    note = F.coalesce(F.concat(F.col("note"), F.lit("\n")), F.lit("")) if "note" in queries.columns else F.lit("")
    return queries.select("query_id", F.concat(F.lit(head), note, F.lit("Question: "), F.col("query")).alias("prompt"))


def answer_prompts(queries: DataFrame, blocks: DataFrame, task=None) -> DataFrame:
    """(query_id, prompt): the question and its evidence, behind lines (``guide``) that tell the sets' windows, where there are any."""
    guide = F.when(F.coalesce("guide", F.lit("")) != "", F.concat(F.col("guide"), F.lit("\n\n"))).otherwise("") if "guide" in queries.columns else F.lit("")
    head = F.lit(f"{task.description}\n{task.schema}\n" if task else "")
    text = F.concat(head, F.lit("Question: "), F.col("query"), F.lit("\nEvidence:\n"), guide, F.coalesce("block", F.lit("none")), F.lit("\nGive the answer, then Rationale: and the reason."))
    return queries.join(blocks, "query_id", "left").select("query_id", text.alias("prompt"))


def judge_prompts(predictions: DataFrame, queries: DataFrame, kind: str) -> DataFrame:
    """Prompts of one kind (answer, factual or faithful); queries without an expected answer get none and count as 0."""
    ask = {"answer": "Does the prediction give the expected answer?", "factual": "Is the rationale in line with the expected answer?", "faithful": "Does the rationale follow from the evidence?"}[kind]
    joined = predictions.join(queries.select("query_id", "expected"), "query_id").where("expected is not null")
    return joined.select("query_id", F.lit(kind).alias("kind"), F.concat(F.lit(ask), F.lit("\nExpected: "), F.col("expected"), F.lit("\nPrediction: "), F.col("prediction"), F.lit("\nReply YES or NO.")).alias("prompt"))
