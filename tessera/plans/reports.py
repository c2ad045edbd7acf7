"""Reports of scores: names and order of variants, tables as rows and as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score files and what their variants are called, in the order of the reports; those that hear the audio; metrics and their titles.
FILES = {"scores_text": "text", "scores_embed": "emb", "scores": "hybrid", "scores_audio": "hybrid_audio", "scores_all": "hybrid_all", "scores_oracle_audio": "oracle_audio", "scores_oracle_all": "oracle_all"}
HEARING = ["scores_audio", "scores_oracle_audio"]
METRICS = {"plan_hit_rate": "Plan HR", "retrieval_hit_rate": "Retr HR", "answer": "Ans Acc", "rationale": "Rat Acc"}
#: Query types by task, in the order of the reports.
TYPES = {"emotion": ["state", "change", "comparison", "locate", "locate_hard"], "health": ["reported", "exhibited"], "music": ["time", "position", "audio"]}
DASH = "—"


def base_stem(stem: Column) -> Column:
    """The score file that a file's stem is a variant of: the longest known one that it is, or begins with before an underscore; else itself."""
    out = stem
    for known in sorted(FILES, key=len):
        out = F.when((stem == known) | stem.startswith(f"{known}_"), F.lit(known)).otherwise(out)
    return out


def display_name(stem: Column) -> Column:
    """What a score file is called: its variant, and in brackets the judge that its name ends with."""
    base = base_stem(stem)
    called = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FILES.items() for x in kv]), base), F.replace(base, F.lit("scores_"), F.lit("")))
    return F.when(base != stem, F.concat(called, F.lit(" ("), F.substr(stem, F.length(base) + 2), F.lit(")"))).when(stem.isin(*FILES), called).otherwise(F.replace(stem, F.lit("scores_"), F.lit("")))


def score_files(names: DataFrame) -> DataFrame:
    """(stem, display, hearing, place): the score files among ``names`` (stem), known ones in their order, then the others by name."""
    stem = F.col("stem")
    known = F.array_position(F.array(*map(F.lit, FILES)), stem)
    found = names.where(stem.isin(*FILES) | stem.startswith("scores_")).select("stem").distinct()
    order = F.row_number().over(Window.orderBy(F.when(known > 0, known).otherwise(len(FILES) + 1), stem))  # files of a run, some dozen
    return found.select("stem", display_name(stem).alias("display"), base_stem(stem).isin(HEARING).alias("hearing"), order.alias("place"))


def sort_key(display: Column) -> Column:
    """struct(judged, judge, variant): no judge first, then judges by name; variants in their order, others at 99."""
    judge = F.regexp_extract(display, r" \((.*?)\)*$", 1)
    variant = F.split(display, r" \(", 2)[0]
    place = F.array_position(F.array(*map(F.lit, FILES.values())), variant)
    return F.struct((judge != "").cast("int").alias("judged"), judge.alias("judge"), F.when(place > 0, place - 1).otherwise(99).alias("variant"))


def task_of(types: Column) -> Column:
    """The task that a set of query types belongs to."""
    has = lambda names: F.arrays_overlap(types, F.array(*map(F.lit, names)))
    return F.when(has(TYPES["emotion"]), "emotion").when(has(TYPES["health"]), "health").otherwise("music")


def task_of_file(stem: Column) -> Column:
    """The task that an answer file's name begins with; null for none."""
    return F.coalesce(*[F.when(stem.startswith(t), F.lit(t)) for t in ("health", "emotion", "music")])


def _shown(x: Column, none: str = DASH) -> Column:
    return F.when(x.isNull() | F.isnan(x), none).otherwise(F.format_string("%.3f", x))


def scorecard_rows(scores: DataFrame, kinds: list[str], variant: str = "display", kind: str = "query_type") -> DataFrame:
    """One row of each variant with answer and rationale of each type side by side and their plain means over the types it has, as text, '' where it has none; ``place`` is its order."""
    wide = scores.groupBy(variant).pivot(kind, kinds).agg(F.avg("answer").alias("ans"), F.avg("rationale").alias("rat"))
    mean = lambda s: F.expr(f"aggregate(filter(array({', '.join(f'`{k}_{s}`' for k in kinds)}), x -> x is not null), 0D, (a, x) -> a + x, a -> a / size(filter(array({', '.join(f'`{k}_{s}`' for k in kinds)}), x -> x is not null)))")
    some = lambda s: F.coalesce(*[F.col(f"`{k}_{s}`") for k in kinds]).isNotNull()
    cells = [_shown(F.col(f"`{k}_{s}`"), "").alias(f"{k}_{s}") for k in kinds for s in ("ans", "rat")]
    place = F.row_number().over(Window.orderBy(sort_key(F.col(variant)), variant))  # one row of a variant
    return wide.select(variant, *cells, *[_shown(F.when(some(s), mean(s)), "").alias(f"avg_{s}") for s in ("ans", "rat")], place.alias("place"))


def write_scorecard(rows: DataFrame, path: str) -> None:
    """``scorecard_rows`` as one tab-separated file with a header, in order; a row for each variant, so one task writes it."""
    rows.repartition(1).sortWithinPartitions("place").drop("place").write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="")


def table_lines(scores: DataFrame, kinds: list[str], variant: str = "display", kind: str = "query_type") -> DataFrame:
    """(variant, n, line): for each metric of a variant a line with its mean by type, a dash for types without rows, and the plain mean of the types."""
    means = scores.groupBy(variant, kind).agg(*[F.avg(m).alias(m) for m in METRICS])
    long = means.select(variant, kind, F.explode(F.array(*[F.struct(F.lit(k).alias("n"), F.lit(title).alias("title"), F.col(m).alias("v")) for k, (m, title) in enumerate(METRICS.items())])).alias("x")).select(variant, kind, "x.*")
    wide = long.groupBy(variant, "n", "title").pivot(kind, kinds).agg(F.first("v"))
    shown = F.concat_ws(" ", F.rpad("title", 10, " "), *[F.lpad(_shown(F.col(f"`{k}`")), 9, " ") for k in kinds])
    values = F.filter(F.array(*[F.col(f"`{k}`") for k in kinds]), lambda x: x.isNotNull())
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))
    return wide.select(variant, "n", F.concat(shown, F.lit(" "), F.lpad(_shown(mean), 9, " ")).alias("line"))


def agreement_lines(agreement: DataFrame, judges: list[str], by: str) -> DataFrame:
    """(by, section, line) of ``metrics.agreement``: means of the judges, kappas of their pairs with the mean of those that are numbers, Fleiss' kappa and unanimity."""
    pairs = [c for c in agreement.columns if c.startswith("kappa_")]
    real = F.filter(F.array(*pairs), lambda x: ~F.isnan(x))
    mean = F.when(F.size(real) > 0, F.aggregate(real, F.lit(0.0), lambda a, x: a + x) / F.size(real))
    cells = lambda names: [F.lpad(_shown(F.col(c)), 8, " ") for c in names]
    rows = F.array(
        F.struct(F.lit("leniency").alias("section"), F.concat_ws(" ", F.lpad(F.col("n").cast("string"), 6, " "), *cells([f"mean_{j}" for j in judges])).alias("line")),
        F.struct(F.lit("pairs").alias("section"), F.concat_ws(" ", *cells(pairs), F.lpad(_shown(mean), 8, " ")).alias("line")),
        F.struct(F.lit("together").alias("section"), F.concat_ws(" ", F.lpad(_shown(F.col("fleiss")), 8, " "), F.lpad(F.when(F.isnan("unanimous"), DASH).otherwise(F.format_string("%.1f%%", F.col("unanimous") * 100)), 8, " ")).alias("line")),
    )
    return agreement.select(by, F.explode(rows).alias("x")).select(by, "x.*")


def write_quality(scores: DataFrame, path: str) -> None:
    """Quality scores as CSV files with a header."""
    scores.write.mode("overwrite").csv(path, header=True)
