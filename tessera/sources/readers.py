"""Scans of the model's files, with explicit schemas; a missing path is an empty table where the model says so."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.session import stored


def jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped, NaN and Infinity read as null numbers are cleared by ``finite``."""
    try:
        return spark.read.schema(schema).option("mode", "PERMISSIVE").option("allowNonNumericNumbers", "true").json(path)
    except AnalysisException as error:
        if missing_ok and "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles to null."""
    bad = lambda c: F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    return df.select(*[F.when(~bad(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def segments(spark: SparkSession, folder: str, episodes: list[str] | None = None) -> DataFrame:
    """Segments of a folder; of some episodes only, pruned by the partition where the table has them."""
    df = jsonl(spark, folder, schemas.SEGMENTS)
    return df.where(F.col("episode_id").isin(episodes)) if episodes is not None else df


def vector_store(spark: SparkSession, path: str) -> DataFrame | None:
    """A vector table, or None if there is none."""
    try:
        return spark.read.schema(schemas.VECTORS).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """(entry, t, from, to) of a file that is one JSON object, or one list of objects, of any size: the text of each entry with what
    stands before it, and the bytes of the file that it takes.

    The file is read in parallel, cut behind each closing brace.  Whether a piece begins inside a string and at what depth
    follows from the pieces before it: counts of quotes and braces, summed in each block of the file and then over its
    blocks.  Pieces up to a brace that closes a top-level value are put together and parsed, so no task holds the object.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    plain = F.regexp_replace("value", r"\\.", "")
    parts = F.split(plain, '"')
    n = F.size(parts)
    level = lambda parity: F.aggregate(F.transform(parts, lambda x, k: F.when(k % 2 == parity, F.length(F.regexp_replace(x, r"[^{\[]", "")) - F.length(F.regexp_replace(x, r"[^\]}]", ""))).otherwise(0)), F.lit(0), lambda a, x: a + x)
    counted = stored(pieces.select("value", "b", "i", F.octet_length("value").cast("long").alias("bytes"), ((n - 1) % 2).alias("q"), level(0).alias("d0"), level(1).alias("d1")), "pieces")
    order = Window.partitionBy("b").orderBy("i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block of the file
    odd = counted.groupBy("b").agg(F.sum("q").alias("s"), F.max("i").alias("_last"), F.sum(F.col("bytes") + 1).alias("size")).select("b", F.coalesce(F.sum("size").over(blocks), F.lit(0)).alias("at"), (F.coalesce(F.sum("s").over(blocks), F.lit(0)) % 2).alias("open"), (F.col("b") == F.max("b").over(Window.partitionBy())).alias("final"), "_last")
    stated = counted.join(odd, "b").withColumn("inside", (F.col("open") + F.coalesce(F.sum("q").over(before), F.lit(0))) % 2)
    ends_inside = (F.col("inside") + F.col("q")) % 2 == 1
    last = F.col("final") & (F.col("i") == F.col("_last"))
    closes = F.when(ends_inside | last, 0).otherwise(1)
    moved = stated.withColumn("closes", closes).withColumn("d", F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1")) - F.col("closes")).withColumn("last", last)
    deep = moved.groupBy("b").agg(F.sum("d").alias("s")).select("b", F.coalesce(F.sum("s").over(blocks), F.lit(0)).alias("from"))
    placed = moved.join(deep, "b").withColumn("after", F.col("from") + F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    done = placed.withColumn("ends", ((F.col("closes") == 1) & (F.col("after") == 1)).cast("int"))
    shut = done.groupBy("b").agg(F.sum("ends").alias("s")).select("b", F.coalesce(F.sum("s").over(blocks), F.lit(0)).alias("base"))
    numbered = done.join(shut, "b").withColumn("entry", F.col("base") + F.coalesce(F.sum("ends").over(before), F.lit(0)))
    text = F.concat("value", F.when(F.col("last") | (F.col("after") < 1), F.lit("")).otherwise(F.lit("}")))
    begins = F.col("at") + F.coalesce(F.sum(F.col("bytes") + 1).over(before), F.lit(0))
    placed = numbered.withColumn("begins", begins)
    return placed.groupBy("entry").agg(F.min("begins").alias("from"), F.max(F.col("begins") + F.col("bytes") + F.when(F.col("last"), 0).otherwise(1)).alias("to"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "i", text.alias("t")))), lambda x: x["t"]), "").alias("t"))


def _bare(text: Column, first: Column) -> Column:
    """An entry's text without what parts it from others, NaN and infinities as null."""
    body = F.regexp_replace(F.when(first, F.regexp_replace(text, r"^\s*[{\[]", "")).otherwise(text), r"^\s*,", "")
    return F.regexp_replace(body, r"\bNaN\b|-Infinity\b|\bInfinity\b", "null")


def object_entries(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(key, value) of a file that is one JSON object of any size, NaN and infinities as null; use ``where`` for some keys, ``limit`` to stop early.

    Where keys are looked up again and again, ``object_index`` is written once and ``looked_up`` reads nothing else.
    """
    whole = _entries(spark, path)
    return whole.select(F.explode(F.from_json(F.concat(F.lit("{"), _bare(F.col("t"), F.col("entry") == 0), F.lit("}")), f"map<string,{value_schema}>")).alias("key", "value"))


def object_index(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """(key, entry, from, to) of the entries of one JSON object, or, with ``key``, of a list of objects by that field: the bytes that each takes."""
    bare = _bare(F.col("t"), F.col("entry") == 0)
    names = F.map_keys(F.from_json(F.concat(F.lit("{"), bare, F.lit("}")), "map<string,string>")) if key is None else F.array(F.get_json_object(bare, f"$.{key}"))
    return _entries(spark, path).select(F.explode(names).alias("key"), "entry", "from", "to").where("key is not null")


def line_index(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, entry, from, to) of JSON lines by a field; lines of one key may stand anywhere.  Entries are numbered from 1: nothing opens the file but a line."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.octet_length("value").cast("long").alias("bytes"))
    counted = stored(lines.select("b", "i", "bytes", F.get_json_object("value", f"$.{key}").alias("key")), "lines")
    before = Window.partitionBy("b").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counted.groupBy("b").agg(F.sum(F.col("bytes") + 1).alias("size"))
    at = sizes.select("b", F.coalesce(F.sum("size").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))  # one row for each block of the file
    begins = F.col("at") + F.coalesce(F.sum(F.col("bytes") + 1).over(before), F.lit(0))
    return counted.join(at, "b").select("key", (F.col("i") + 1).alias("entry"), begins.alias("from"), (begins + F.col("bytes")).alias("to")).where("key is not null")


def ranged(spark: SparkSession, path: str, begin: int, end: int) -> bytes:
    """Some bytes of a file, wherever Spark can read it."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(where)
    try:
        stream.seek(begin)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, end - begin))
    finally:
        stream.close()


def looked_up(spark: SparkSession, path: str, index: DataFrame, keys: list[str], value_schema: str) -> tuple[DataFrame, int]:
    """(key, value) of some keys of one JSON object by its ``object_index``, and how many bytes of the file were read for them."""
    rows = index.where(F.col("key").isin(keys)).collect()
    return _parsed(spark, path, [(r["entry"], r["from"], r["to"]) for r in rows], value_schema)


def first_entries(spark: SparkSession, path: str, index: DataFrame, n: int, value_schema: str) -> tuple[DataFrame, int]:
    """(key, value) of the first ``n`` entries of the file, and how many bytes were read: an early stop."""
    rows = index.orderBy("from").limit(n).collect()
    return _parsed(spark, path, [(r["entry"], r["from"], r["to"]) for r in rows], value_schema)


def _parsed(spark: SparkSession, path: str, spans: list[tuple[int, int, int]], value_schema: str) -> tuple[DataFrame, int]:
    texts = [(entry, ranged(spark, path, begin, end).decode()) for entry, begin, end in spans]
    rows = spark.createDataFrame(texts, "entry long, t string")
    told = rows.select(F.explode(F.from_json(F.concat(F.lit("{"), _bare(F.col("t"), F.col("entry") == 0), F.lit("}")), f"map<string,{value_schema}>")).alias("key", "value"))
    return told, sum(end - begin for _, begin, end in spans)


def consensus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CONSENSUS).csv(path, header=True)


def consensus_text(spark: SparkSession, path: str) -> DataFrame:
    """The same with every column as text, as it stands."""
    return spark.read.schema(schemas.CONSENSUS.replace(" double", " string")).csv(path, header=True)


def detailed_text(spark: SparkSession, path: str) -> DataFrame:
    """(FileName, EmoClass_Major) of each vote."""
    return spark.read.schema(schemas.DETAILED).csv(path, header=True)


def detailed(spark: SparkSession, path: str) -> DataFrame:
    """(FileName, votes): how often each class was voted for a file."""
    rows = detailed_text(spark, path)
    return rows.groupBy("FileName", "EmoClass_Major").count().groupBy("FileName").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("EmoClass_Major", "count")))).alias("votes"))


def traces(spark: SparkSession, pattern: str, file_regex: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """Annotator traces; episode, dimension and annotator come from the file name by ``file_regex`` (three groups), bounds are optional."""
    rows = spark.read.schema("start double, `end` double, mean double").csv(pattern, header=True)
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    named = rows.select("*", *[F.regexp_extract(name, file_regex, k + 1).alias(c) for k, c in enumerate(("episode_id", "dim", "annotator_id"))]).where("episode_id <> ''")
    named = named if start is None else named.where(F.col("end") > start)
    return named if end is None else named.where(F.col("start") < end)


def delimited(spark: SparkSession, path: str, columns: list[str], sep: str = ";") -> DataFrame:
    """Text lines cut at a separator; blank lines are skipped, missing fields are null."""
    parts = F.split(F.trim("value"), re.escape(sep))
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.get(parts, F.lit(k)).alias(c) for k, c in enumerate(columns)])


def id_list(spark: SparkSession, path: str, comment: str = "//", key: str = "episode_id") -> DataFrame:
    """Ids of JSON lines, those that begin with ``comment`` left out."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith(comment))
    return lines.select(F.get_json_object("value", f"$.{key}").alias(key)).dropna().distinct()


def excluded(spark: SparkSession, path: str) -> DataFrame:
    """Query ids of an exclusion list: the first number of each line; comments and other lines are skipped."""
    first = F.get(F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+"), F.lit(0)).try_cast("bigint")
    return spark.read.text(path).select(first.alias("query_id")).dropna().distinct()


def spaced(spark: SparkSession, path: str) -> DataFrame:
    """(file, annotation, grp) of lines of fields apart by four blanks; the annotation may have such gaps itself."""
    p = F.split("value", r" {4}")
    n = F.size(p)
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim(F.get(p, F.lit(0))).alias("file"), F.trim(F.array_join(F.slice(p, 2, F.greatest(n - 2, F.lit(0))), " ")).alias("annotation"), F.trim(F.element_at(p, -1)).alias("grp"))


def songs(spark: SparkSession, path: str, tracks: list[str] | None = None) -> DataFrame:
    """Songs of tracks in the order of their start, with their 1-based position and tag."""
    rows = jsonl(spark, path, schemas.SONGS)
    rows = rows if tracks is None else rows.where(F.col("track_name").isin(tracks))
    position = F.row_number().over(Window.partitionBy("track_name").orderBy("start_time", "file_name"))
    return rows.withColumn("position", position).withColumn("tag", F.format_string("SONG_%02d", "position"))


def audio_files(spark: SparkSession, folder: str, glob: str = "*.{flac,wav,mp3}") -> DataFrame:
    """(name, path, content) of audio files; of files of one name in one folder the first of flac, wav, mp3.

    ``name`` is the path without its extension, below ``folder``.  Paths are chosen first, on the driver, which has listed them
    anyway; contents are read of the chosen ones alone and not shuffled.
    """
    files = lambda: spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    paths = files().load(folder).select("path", F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"), F.when(ext == "flac", 0).when(ext == "wav", 1).otherwise(2).alias("rank"))
    chosen = [r["p"] for r in paths.groupBy("stem").agg(F.min(F.struct("rank", "path"))["path"].alias("p")).collect()]
    below = folder.rstrip("/").rpartition("/")[2]
    name = F.regexp_replace(F.regexp_replace("path", rf"^.*/{re.escape(below)}/", ""), r"\.[^./]+$", "")
    empty = spark.createDataFrame([], "name string, path string, content binary")
    return files().load(chosen).select(name.alias("name"), "path", "content") if chosen else empty


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")


def stem_of(names: DataFrame, stems: list[str], col: str = "stem") -> DataFrame:
    """Each name with the longest of ``stems`` that it starts with, and what follows it."""
    best = F.lit(None).cast("string")
    for s in sorted(stems, key=len):
        best = F.when(F.col(col).startswith(s), F.lit(s)).otherwise(best)
    return names.withColumn("base", best).withColumn("suffix", F.expr(f"substring({col}, length(base) + 1)"))


def expand(node, environment: dict[str, str] | None = None):
    """A configuration tree with ${NAME} filled in; an unset name is an error."""
    env = os.environ if environment is None else environment
    if isinstance(node, dict):
        return {k: expand(v, environment) for k, v in node.items()}
    if isinstance(node, list):
        return [expand(v, environment) for v in node]
    if not isinstance(node, str):
        return node

    def fill(m: re.Match) -> str:
        if m[1] not in env:
            raise KeyError(f"{m[1]} isn't set")
        return env[m[1]]

    return re.sub(r"\$\{(\w+)\}", fill, node)


def configuration(path: str, environment: dict[str, str] | None = None) -> dict:
    """A configuration file with the environment filled in: YAML where a reader of it is installed, else JSON."""
    content = Path(path).read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:
        import json

        return expand(json.loads(content), environment)
    return expand(yaml.safe_load(content), environment)


def cached_vectors(path: str) -> dict[str, list[float]]:
    """Vectors by name from an npz file, or from a JSON object; nothing if the file isn't there.  A cache of clips, small enough for the driver."""
    import json

    import numpy as np

    if not Path(path).exists():
        return {}
    if path.endswith(".json"):
        return json.loads(Path(path).read_text(encoding="utf-8"))
    with np.load(path) as held:
        return {k: held[k].astype(float).ravel().tolist() for k in held.files}


def evidence_file(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, episode_id, gt_side, seg_ids) of evidence that was extracted before; of a query the last line counts."""
    rows = jsonl(spark, path, "query_id bigint, episode_id string, gt_ev array<struct<seg_id:string>>, gt_side string").withColumn("_n", F.monotonically_increasing_id())
    return keep_last(rows.where("query_id is not null"), "query_id", "_n").select("query_id", "episode_id", "gt_side", F.transform("gt_ev", lambda x: x["seg_id"]).alias("seg_ids"))


def option_file(spark: SparkSession, path: str) -> DataFrame:
    """(task, query_type, kind, choices) of a file of options: one JSON object, task to query type to options."""
    rows = object_entries(spark, path, "map<string,struct<type:string,choices:array<string>>>")
    return rows.select(F.col("key").alias("task"), F.explode("value").alias("query_type", "o")).select("task", "query_type", F.col("o.type").alias("kind"), F.coalesce("o.choices", F.array().cast("array<string>")).alias("choices"))


def root(flag: str | None, variable: str, default: str | Path) -> Path:
    """A folder from a flag, else the environment, else a default."""
    return Path(flag or os.environ.get(variable) or default)
