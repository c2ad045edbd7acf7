"""Named queries of corpora, recordings, extraction and reports.  Files that a query reads are written from the tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import experts, extraction
from tessera.functions.numbers import rounded
from tessera.operators import events, shaping
from tessera.operators.ordering import in_order, placed
from tessera.plans import adapters, metrics, reports
from tessera.plans.adapters import SQL_CV, SQL_EV, SQL_SC, read
from tessera.plans.queries import query
from tessera.session import grows, shared_folder, stored
from tessera.sources import corpora, readers, waves


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _lines(rows: DataFrame, line: Column, order: list, name: str) -> str:
    """Rows as lines of one text file, in order."""
    path = _path(rows.sparkSession, name)
    rows.orderBy(*order).select(line.alias("value")).coalesce(1).write.text(path)
    return path


def _object(rows: DataFrame, key: str, value: str, name: str) -> str:
    """(key, JSON value) rows as one JSON object in one file."""
    entry = F.concat(F.when(F.col(key) == F.col("_first"), "{").otherwise(","), F.to_json(F.struct(F.col(key).alias("k"))), F.col(value))
    marked = rows.crossJoin(F.broadcast(rows.agg(F.min(key).alias("_first"))))  # one row
    lines = marked.select(F.lit(0).alias("o"), F.col(key).alias("k"), F.regexp_replace(entry, r'\{"k":("(?:[^"\\]|\\.)*")\}', "$1: ").alias("_line"))
    end = rows.sparkSession.createDataFrame([(1, "", "}")], "o int, k string, _line string")
    return _lines(lines.unionByName(end), F.col("_line"), ["o", "k"], name)


def _only_file(spark: SparkSession, path: str) -> str:
    """The one file of a table of text."""
    return spark.read.text(path).select("_metadata.file_path").first()[0]


SQL_CO = f"""{SQL_EV}, sg AS (SELECT 'MSP-PODCAST_' || lpad(episode_id::VARCHAR, 4, '0') AS ep, episode_id, idx + 1 AS n, "start", "end", ord, text FROM ev), si AS (SELECT *, ep || '_' || lpad(n::VARCHAR, 4, '0') AS seg_id FROM sg WHERE episode_id % 3 <> 1 OR episode_id % 5 = 0)"""
EMO = ["N", "H", "", "S", "A"]


@query("corpus_emotion", f"""WITH {SQL_CO}, v AS (SELECT seg_id, ['N', 'H', 'S', ''][1 + (ord + k * k) % 4] AS c, k FROM si, range(0, 5) r(k) WHERE k < ord % 6), w AS (SELECT seg_id, c, count(*) AS n, min(k) AS f FROM v WHERE c <> '' GROUP BY ALL), x AS (SELECT seg_id, sum(n) AS t, max(n) AS m, list(c ORDER BY n DESC, f)[2] AS second FROM w GROUP BY 1)
SELECT seg_id, round("start", 3) AS a, text, CASE WHEN ord % 5 = 0 THEN '' ELSE (ord % 4)::VARCHAR END AS speaker, CASE WHEN ord % 3 <> 0 THEN nullif({EMO}[1 + ord % 5], '') END AS primary_, CASE WHEN ord % 3 <> 0 THEN second END AS secondary, CASE WHEN ord % 3 <> 0 THEN round(m / t, 6) END AS top, CASE WHEN ord % 3 <> 0 AND ord % 8 <> 0 THEN round((1 + ord % 6 - 1) / 6.0::DOUBLE, 6) END AS valence,
    episode_id % 2 = 0 AS traced FROM si LEFT JOIN x USING (seg_id)""")
def corpus_emotion(spark, sf_dir):
    """A corpus of one JSON object, label files, lists of conversations and partitions; read again with its labels, for the episodes of a split.

    In the files each recording has a name of its own.  The SQL's names have four digits of a number, also of longer ones, and so
    have the names that are returned; its votes are by these names, so recordings whose names are equal share theirs.  Classes
    with equal votes come in the order of their first, which leaves some of shared votes open: here the least event's.
    """
    e = adapters.event_segments(spark, sf_dir)
    o, ep = F.col("ord"), F.format_string("MSP-PODCAST_%04d", "episode_id")
    n = F.row_number().over(Window.partitionBy("episode_id").orderBy("start", "ord"))
    sg = e.select("episode_id", ep.alias("ep"), n.alias("n"), "start", "end", "ord", "text").withColumn("seg_id", F.concat("ep", F.lit("_"), F.format_string("%04d", "n")))
    short = F.regexp_replace("seg_id", r"^(MSP-PODCAST_\d{4})\d*_(\d{4})\d*$", "$1_$2")
    spoken = F.when(o % 5 == 0, F.array().cast("array<string>")).otherwise(F.array((o % 4).cast("string")))
    one = F.concat(F.lit('"'), F.col("n").cast("string"), F.lit('": '), F.to_json(F.struct("start", "end", "text", spoken.alias("global_speaker2"))), F.lit(""))
    one = F.when(o % 13 == 0, F.regexp_replace(one, r"\}$", ', "arousal": NaN, "valence": -Infinity}')).otherwise(one)
    objects = _object(sg.groupBy("ep").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("t")))), lambda x: x["t"]), ", "), F.lit("}")).alias("json")), "ep", "json", "objects")
    emo = F.element_at(F.array(*map(F.lit, EMO)), (o % 5 + 1).cast("int"))
    level = F.when(o % 8 == 0, "x").otherwise((1 + o % 6).cast("string"))
    row = lambda c: F.concat_ws(",", F.concat("seg_id", F.lit(".wav")), c, F.lit("4"), level, F.lit("4"), F.lit("1"), F.lit("f"))
    judged = sg.where("ord % 3 <> 0").select(F.lit(1).alias("p"), "ord", row(emo).alias("line"))
    older = sg.where("ord % 3 <> 0 and ord % 10 = 1").select(F.lit(0).alias("p"), "ord", row(F.lit("Z")).alias("line"))
    head = spark.createDataFrame([(-1, 0, "FileName,EmoClass,EmoAct,EmoVal,EmoDom,SpkrID,Gender")], "p int, ord long, line string")
    consensus = _lines(judged.unionByName(older).unionByName(head), F.col("line"), ["p", "ord"], "consensus")
    k = F.explode(F.array(*map(F.lit, range(5)))).alias("k")
    voted = sg.where("episode_id % 3 <> 1 or episode_id % 5 = 0").select(short.alias("seg_id"), "ord", k).where(F.col("k") < F.col("ord") % 6).withColumn("c", F.element_at(F.array(F.lit("N"), F.lit(" H "), F.lit("S"), F.lit("")), ((F.col("ord") + F.col("k") * F.col("k")) % 4 + 1).cast("int")))
    rows = voted.select("ord", "k", F.concat("seg_id", F.lit(".wav,"), "c").alias("line")).unionByName(spark.createDataFrame([(-1, -1, "FileName,EmoClass_Major")], "ord long, k int, line string"))
    detailed = _lines(rows, F.col("line"), ["k", "ord"], "detailed")
    bounds = _lines(sg.where("episode_id % 2 = 0").select(F.replace("ep", F.lit("PODCAST"), F.lit("Conversation")).alias("c")).distinct(), F.concat("c", F.lit(";1.5;900")), ["c"], "conversations")
    split = F.when(F.col("episode_id") % 3 != 1, "Test1").otherwise("Train")
    parts = _lines(sg.select("seg_id", F.concat(split, F.lit("; "), "seg_id", F.lit(".wav")).alias("line")), F.col("line"), ["seg_id"], "partitions")
    listed = _lines(sg.where("episode_id % 5 = 0").select(F.concat(F.lit('{"conversation": "'), F.replace("ep", F.lit("PODCAST"), F.lit("Conversation")), F.lit('"}')).alias("line")).distinct(), F.col("line"), ["line"], "list")
    scope = corpora.partitions(spark, parts).where("split = 'Test1'").select("episode_id").unionByName(corpora.listed_episodes(spark, listed))
    episodes, segments = corpora.emotion(spark, objects, consensus, detailed, "audio", scope, corpora.conversations(spark, bounds), short)
    top = F.array_max(F.map_values("scores"))
    return segments.join(episodes.select("episode_id", "ct_available"), "episode_id").select(short.alias("seg_id"), rounded(F.col("start"), 3).alias("a"), "text", "speaker", F.col("primary").alias("primary_"), "secondary", F.round(top, 6).alias("top"), F.round("valence", 6).alias("valence"), F.col("ct_available").alias("traced"))


@query("corpus_music", """WITH s AS (SELECT o_custkey AS t, o_orderkey AS k, o_orderkey % 5000 / 2.0::DOUBLE AS a FROM orders), m AS (SELECT l_orderkey AS k, avg(l_quantity / 10) AS c, avg(CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 50 END) AS u, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY a, 'f' || k) - 1 AS i FROM s LEFT JOIN m USING (k))
SELECT 'track_' || t || '_' || lpad(i::VARCHAR, 4, '0') AS seg_id, 'SONG_' || lpad((i + 1)::VARCHAR, 2, '0') AS speaker, round(coalesce(c, 0), 6) AS coherence, round(coalesce(u, 0), 6) AS clarity, a + 200 AS b FROM r""")
def corpus_music(spark, sf_dir):
    notes = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.map_filter(F.create_map(F.lit("Coherence"), F.col("l_quantity") / 10, F.lit("Clarity"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount") * 50)), lambda a, b: b.isNotNull())).alias("annotation"))
    k = F.col("o_orderkey")
    songs = read(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("track_"), "o_custkey").alias("track_name"), F.concat(F.lit("f"), k).alias("file_name"), (k % 5000 / F.lit(2.0)).alias("start_time"), (k % 5000 / F.lit(2.0) + 200).alias("end_time")).join(notes, "k", "left")
    path = _path(spark, "songs")
    songs.drop("k").write.json(path)
    _, segments = corpora.music(spark, path, "audio")
    return segments.select("seg_id", "speaker", F.round(F.element_at("scores", "Coherence"), 6).alias("coherence"), F.round(F.element_at("scores", "Clarity"), 6).alias("clarity"), F.col("end").alias("b"))


@query("corpus_health", """SELECT 'id' || p_partkey AS id, 'rec' || p_partkey AS episode_id, 'audio/rec' || p_partkey || '.wav' AS audio_path, CASE p_partkey % 3 WHEN 0 THEN '(a) ' || p_brand WHEN 1 THEN '(b) ' || p_type ELSE '' END AS answer, CASE WHEN p_partkey % 4 <> 0 THEN '' ELSE 'self, coughed    twice' END AS annotation FROM part""")
def corpus_health(spark, sf_dir):
    k = F.col("p_partkey")
    truth = F.when(k % 3 == 0, "it is (a), sure").when(k % 3 == 1, "(b)").otherwise("none")
    items = read(spark, sf_dir, "part").select(F.concat(F.lit("id"), k).alias("id"), F.concat(F.lit("in/rec"), k, F.lit(".wav")).alias("audio_path"), F.lit("what?").alias("question"), F.array(F.concat(F.lit("(a) "), "p_brand"), F.concat(F.lit("(b) "), "p_type")).alias("options"), truth.alias("ground_truth"))
    lines = items.select("id", F.to_json(F.struct("*")).alias("j")).crossJoin(F.broadcast(items.agg(F.min("id").alias("_first"))))  # one row
    listed = lines.select("id", F.concat(F.when(F.col("id") == F.col("_first"), "[").otherwise(","), "j").alias("line"), F.lit(0).alias("o")).unionByName(spark.createDataFrame([("", "]", 1)], "id string, line string, o int"))
    path = _lines(listed, F.col("line"), ["o", "id"], "items")
    marks = _lines(items.where("cast(substring(id, 3) as int) % 4 = 0").select("id", F.concat(F.substring("audio_path", 4, 100), F.lit("    self, coughed    twice    [RES]")).alias("line")).unionByName(spark.createDataFrame([("", "a heading")], "id string, line string")), F.col("line"), ["id"], "marks")
    told = corpora.annotations(spark, marks).select(F.regexp_replace("file", r"\.wav$", "").alias("episode_id"), "annotation")
    return corpora.health(spark, path, "audio").join(told, "episode_id", "left").select("id", "episode_id", "audio_path", "answer", F.coalesce("annotation", F.lit("")).alias("annotation"))


@query("corpus_traces", """SELECT 'ep' || user_id % 40 AS episode_id, event_type AS dim, 'a' || event_id % 3 AS annotator, count(*) AS n, round(avg(value / 100), 6) AS mean FROM events WHERE epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') > 100000000000 GROUP BY ALL""")
def corpus_traces(spark, sf_dir):
    """Traces of an annotator and a dimension in a file each; rows that end after a time, as a map by dimension."""
    e = read(spark, sf_dir, "events")
    path = _path(spark, "traces")
    name = F.concat(F.lit("ep"), (F.col("user_id") % 40).cast("string"), F.lit("_"), "event_type", F.lit("_a"), (F.col("event_id") % 3).cast("string"))
    rows = e.select(name.alias("name"), (adapters.seconds("ts") - 1).alias("start"), adapters.seconds("ts").alias("end"), (F.col("value") / 100).alias("mean"))
    rows.write.partitionBy("name").option("header", "true").csv(path)
    read_back = spark.read.schema("start double, `end` double, mean double, name string").option("header", "true").csv(path).where(F.col("end") > 100000)
    parts = F.split("name", "_")
    by = corpora.traces_by_dimension(read_back.select(parts[0].alias("episode_id"), parts[1].alias("dim"), parts[2].alias("annotator_id"), "start", "end", "mean"))
    flat = by.select("episode_id", F.explode("traces").alias("dim", "rows")).select("episode_id", "dim", F.explode("rows").alias("r"))
    return flat.groupBy("episode_id", "dim", F.col("r.annotator_id").alias("annotator")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r.mean"), 6).alias("mean"))


@query("object_lookup", """SELECT user_id AS k, count(*) AS n FROM events WHERE user_id IN (3, 7) GROUP BY 1""")
def object_lookup(spark, sf_dir):
    """Two keys of an object in one file."""
    by = read(spark, sf_dir, "events").groupBy(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("k")).agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.lit('br{ace" }').alias("t"))).alias("v"))
    found = readers.object_entries(spark, _object(by, "k", "v", "lookup"), "struct<n:bigint,t:string>")
    return found.where(F.col("key").isin("000003", "000007") & (F.col("value.t") == 'br{ace" }')).select(F.col("key").cast("long").alias("k"), "value.n")


@query("object_at", """SELECT user_id AS k, count(*) AS n FROM events WHERE user_id IN (3, 7) GROUP BY 1""")
def object_at(spark, sf_dir):
    """The same two keys by an index of the file's bytes: nothing else of the file is read."""
    by = read(spark, sf_dir, "events").groupBy(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("k")).agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.lit('br{ace" }').alias("t"))).alias("v"))
    path = _object(by, "k", "v", "lookup")
    index = stored(readers.object_index(spark, path), "index")
    found, _ = readers.looked_up(spark, _only_file(spark, path), index, ["000003", "000007"], "struct<n:bigint,t:string>")
    return found.where(F.col("value.t") == 'br{ace" }').select(F.col("key").cast("long").alias("k"), "value.n")


@query("episode_source", """SELECT user_id AS k, count(*) AS n, max(value) AS most FROM events WHERE user_id % 10 = 3 GROUP BY 1""")
def episode_source(spark, sf_dir):
    """Records of every tenth episode of a corpus in one file, through the data source and its index."""
    from tessera.sources import episodes

    by = read(spark, sf_dir, "events").groupBy(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("k")).agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"), F.lit('br{ace" }').alias("t"))).alias("v"))
    path, index = _object(by, "k", "v", "source"), f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    episodes.write_index(readers.object_index(spark, path), index, 8)
    rows = episodes.episodes(spark, _only_file(spark, path), index).where(F.col("episode_id").endswith("3"))
    return episodes.record_values(rows, "struct<n:bigint,most:double>").select(F.col("episode_id").cast("long").alias("k"), "value.n", "value.most")


# -- recordings


def _wave_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, content): a recording of each customer, forty seconds at 50 samples a second, stereo; some can't be read."""

    @F.pandas_udf("binary")
    def made(keys):
        import io
        import wave

        import numpy as np
        import pandas as pd

        def one(k: int) -> bytes:
            if k % 11 == 0:
                return b"no recording"
            left = (np.arange(2000, dtype=np.int64) * k * 37 % 2001 - 1000).astype(np.int16)
            out = io.BytesIO()
            with wave.open(out, "wb") as f:
                f.setnchannels(2)
                f.setsampwidth(2)
                f.setframerate(50)
                f.writeframes(np.column_stack((left, -(left // 2))).astype(np.int16).tobytes())
            return out.getvalue()

        return pd.Series([one(int(k)) for k in keys])

    c = read(spark, sf_dir, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism)  # keys are small, recordings aren't
    return c.select(F.col("c_custkey").cast("string").alias("name"), made(F.col("c_custkey")).alias("content"))


@query("wave_slices", """WITH w AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderkey % 35 AS lo, least(40, o_orderkey % 35 + 3 + o_orderkey % 5) AS hi FROM orders) SELECT id, CASE WHEN k % 11 <> 0 THEN (hi - lo) * 50 END AS n, CASE WHEN k % 11 <> 0 THEN 'Track duration: 0 min 40 sec (40 sec total)' ELSE '' END AS length FROM w JOIN customer ON c_custkey = k""")
def wave_slices(spark, sf_dir):
    """Windows of recordings as base64 of 16-bit files, and the line that tells how long a track is."""
    files = _wave_files(spark, sf_dir)
    told = files.select("name", waves.duration_line(waves.duration(F.col("content"))).alias("length"))
    k = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders").select(k.alias("clip_id"), F.col("o_custkey").cast("string").alias("name"), (k % 35).alias("lo"), F.least(F.lit(40), k % 35 + 3 + k % 5).alias("hi"))
    cut = waves.slices(orders.join(grows(told), "name"), files, 50)
    size = F.floor((F.length(F.unbase64("audio")) - 44) / 2)
    return cut.select(F.col("clip_id").alias("id"), F.when(size == F.col("n_samples"), F.col("n_samples")).alias("n"), "length")


@query("clip_quality")
def clip_quality(spark, sf_dir):
    """Quality features of every recording and the best that nothing rejects; no SQL, tested on made-up sounds."""
    scores = stored(waves.quality_table(_wave_files(spark, sf_dir)), "quality")  # read twice
    best = waves.best_clean(scores, 2000).select("name", F.lit(True).alias("selected"))
    return scores.join(F.broadcast(best), "name", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


@query("event_labels", """WITH p AS (SELECT l_orderkey AS k, list(l_discount * 10 ORDER BY l_linenumber) AS p FROM lineitem WHERE l_linenumber > 1 GROUP BY 1), n AS (SELECT o_orderkey AS k, p, len(list_filter(coalesce(p, []), lambda x: x >= 0.5)) AS n FROM orders LEFT JOIN p ON p.k = o_orderkey) SELECT k, CASE WHEN n > 0 THEN n || ' cough' ELSE 'no cough' END AS label, round(coalesce(list_max(p), 0), 6) AS most FROM n""")
def event_labels(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem").where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("_k")).agg(F.collect_list((F.col("l_discount") * 10).cast("double")).alias("p"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).join(p, F.col("k") == F.col("_k"), "left")
    x = waves.event_label(F.coalesce("p", F.array().cast("array<double>")))
    return o.select("k", x["primary"].alias("label"), F.round(x["max_prob"], 6).alias("most"))


@query("window_starts", """SELECT p_partkey AS k, len(range(0, greatest(1, p_size * 7 - 20 + 1), 5)) AS n, list_max(range(0, greatest(1, p_size * 7 - 20 + 1), 5)) AS last FROM part""")
def window_starts(spark, sf_dir):
    s = waves.steps(F.col("p_size") * 7, 20, 5)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.size(s).cast("long").alias("n"), F.array_max(s).alias("last"))


@query("clip_paths", """SELECT s_suppkey AS k, 'd' || s_nationkey AS date, 'p' || s_suppkey AS person, 'cough-heavy.wav' AS file FROM supplier""")
def clip_paths(spark, sf_dir):
    path = F.concat(F.lit("file:/in/d"), "s_nationkey", F.lit("/p"), "s_suppkey", F.lit("/cough-heavy.wav"))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), waves.clip_paths(path).alias("x")).select("k", "x.*")


@query("padded_seconds", """SELECT user_id, floor(event_id / 25.0::DOUBLE)::BIGINT AS second, round(sum(value) / 25, 6) AS value FROM events GROUP BY 1, 2""")
def padded_seconds(spark, sf_dir):
    f = read(spark, sf_dir, "events").withColumnRenamed("event_id", "frame")
    return events.frames_to_seconds(f, "user_id", 25.0, ["value"], padded=True).withColumn("value", F.round("value", 6))


@query("series_stats", """WITH c AS (SELECT user_id, event_id, least(greatest(value / 150, 0), 1) AS v FROM events) SELECT user_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(arg_min(v, event_id), 6) AS a, round(arg_max(v, event_id), 6) AS z FROM c GROUP BY 1""")
def series_stats(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("v", F.col("value") / 150)
    return events.series_stats(e, "user_id", "event_id", ["v"]).select("user_id", *[F.round(f"v.{c}", 6).alias(n) for c, n in (("mean", "mean"), ("std", "std"), ("start", "a"), ("end", "z"))])


@query("change_points_kernel")
def change_points_kernel(spark, sf_dir):
    """Best segmentations of recordings of a hundred vectors; no SQL, tested against all cuts."""
    v = read(spark, sf_dir, "embeddings").withColumn("recording", F.floor(F.col("vec_id") / 100).cast("long"))
    return shaping.kernel_change_points(v, "recording", "vec_id", "embedding", 2.0, 3)


# -- extraction


def _turn_reader(content: bytes):
    """A stand-in's reader: the number of a second stands for its sound, two a second."""
    import numpy as np

    return np.arange(0, 4000, 0.5), 2


def _diariser():
    import json

    return lambda content: [(t["start"], t["end"], t["speaker"]) for t in json.loads(bytes(content))]


SQL_T1 = f"""{SQL_CV}, n AS (SELECT *, greatest(1, ceil(("end" - "start") / 20.0::DOUBLE))::BIGINT AS k FROM cv WHERE "end" > "start"), s AS (SELECT episode_id, speaker, "start" + i * (("end" - "start") / k) AS a, "start" + (i + 1) * (("end" - "start") / k) AS b FROM (SELECT *, unnest(range(0, k)) AS i FROM n)), o AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY a, b) AS rn FROM s),
u AS (SELECT *, sum(CASE WHEN rn = 1 OR b - a >= 8 THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS g FROM o), m AS (SELECT episode_id, g, arg_min(a, rn) AS a, arg_max(b, rn) AS b, arg_min(speaker, rn) AS speaker FROM u GROUP BY ALL),
f AS (SELECT m.episode_id, CASE WHEN x.b - x.a < 8 THEN x.a ELSE m.a END AS a, m.b, m.speaker FROM m LEFT JOIN m x ON x.episode_id = m.episode_id AND m.g = 2 AND x.g = 1), t1 AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY a, b) - 1 AS turn_idx FROM f WHERE b - a >= 8)"""


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_id, content): each conversation as a recording whose bytes tell its turns."""
    cv = adapters.turn_segments(spark, sf_dir).where("`end` > start")
    return cv.groupBy(F.col("episode_id").cast("string").alias("episode_id")).agg(F.to_json(F.collect_list(F.struct("start", "end", "speaker"))).cast("binary").alias("content"))


@query("turn_function", f"""WITH {SQL_CV} SELECT episode_id::VARCHAR AS episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY "start", "end", speaker)::INT - 1 AS turn_idx, round("start", 6) AS a, round("end", 6) AS b, speaker FROM cv WHERE "end" > "start" """)
def turn_function(spark, sf_dir):
    """Turns of recordings by a table function in SQL."""
    experts.turn_function(spark, "turns_of", _sorted_diariser)
    return spark.sql("SELECT episode_id, turn_idx, round(start, 6) AS a, round(`end`, 6) AS b, speaker FROM turns_of(TABLE({recordings}) PARTITION BY episode_id)", recordings=_recordings(spark, sf_dir))


def _sorted_diariser():
    """The stand-in's turns in the order of their times."""
    found = _diariser()
    return lambda content: sorted(found(content))


def _stage_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    recordings = _recordings(spark, sf_dir)
    say = lambda: lambda part, rate: f"{len(part)} at {rate}"
    vector = lambda: lambda part, rate: [float(len(part)), 1.0]
    return extraction.stage_one(recordings, _turn_reader, _diariser, say, vector, 8.0, 20.0)


@query("extracted_turns", f"""WITH {SQL_T1} SELECT episode_id::VARCHAR AS episode_id, turn_idx::INT AS turn_idx, speaker, round(a, 6) AS a, round(b, 6) AS b FROM t1""")
def extracted_turns(spark, sf_dir):
    return _stage_one(spark, sf_dir).select("episode_id", "turn_idx", "speaker", F.round("start", 6).alias("a"), F.round("end", 6).alias("b"))


def _stage_two(spark: SparkSession, sf_dir: str):
    turns = _stage_one(spark, sf_dir)
    key = turns.select("episode_id", "turn_idx")
    label = lambda names: key.select("episode_id", "turn_idx", F.create_map(*[x for n, c in names.items() for x in (F.lit(n), c)]).alias("labels"))
    t = F.col("turn_idx")
    one, two = label({"primary": F.lit("H"), "level": t.cast("string")}), label({"primary": F.when(t % 3 == 0, "S"), "second": F.when(t % 2 == 0, "x")})
    text = extraction.text_vectors(turns.where("turn_idx % 4 <> 1"), lambda: experts.stand_in_embedder(4))
    return extraction.stage_two(turns, [one, two], {"audio": turns.select("episode_id", "turn_idx", "embedding"), "text": text}, {"audio": 2, "text": 4}, {"audio": 100})


@query("labelled_segments", f"""WITH {SQL_T1} SELECT episode_id || '_' || lpad(turn_idx::VARCHAR, 4, '0') AS seg_id, CASE WHEN turn_idx % 3 = 0 THEN 'S' ELSE 'H' END AS primary_, turn_idx::VARCHAR AS level, CASE WHEN turn_idx % 2 = 0 THEN 'x' END AS second, 99 + row_number() OVER (ORDER BY episode_id::VARCHAR, turn_idx) AS audio_idx,
    CASE WHEN turn_idx % 4 <> 1 THEN count(*) FILTER (turn_idx % 4 <> 1) OVER (ORDER BY episode_id::VARCHAR, turn_idx ROWS UNBOUNDED PRECEDING) - 1 END AS text_idx FROM t1""")
def labelled_segments(spark, sf_dir):
    segments, _ = _stage_two(spark, sf_dir)
    at = lambda k: F.element_at("labels", k)
    return segments.select("seg_id", at("primary").alias("primary_"), at("level").alias("level"), at("second").alias("second"), "audio_idx", "text_idx")


@query("patched_labels", f"""WITH {SQL_EV}, s AS (SELECT episode_id, seg_id, idx, ord, episode_id % 4 = 0 AS done FROM ev) SELECT seg_id, CASE WHEN done OR ord % 3 = 0 THEN 'old' ELSE 'new' END AS primary_, CASE WHEN done AND idx = 0 THEN 'm' WHEN NOT done THEN 'n' END AS mark FROM s""")
def patched_labels(spark, sf_dir):
    """A labeler's new values over the old ones; every fourth episode has been patched before."""
    e = adapters.event_segments(spark, sf_dir)
    i = F.row_number().over(Window.partitionBy("episode_id").orderBy("start", "ord")) - 1
    marked = F.when((F.col("episode_id") % 4 == 0) & (F.col("turn_idx") == 0), F.create_map(F.lit("primary"), F.lit("old"), F.lit("mark"), F.lit("m"))).otherwise(F.create_map(F.lit("primary"), F.lit("old")))
    s = e.select("episode_id", "seg_id", "ord", i.alias("turn_idx")).withColumn("labels", marked)
    new = s.select("seg_id", F.create_map(F.lit("primary"), F.when(F.col("ord") % 3 != 0, "new"), F.lit("mark"), F.lit("n")).alias("labels"))
    return extraction.patched(s, new, "mark").select("seg_id", F.element_at("labels", "primary").alias("primary_"), F.element_at("labels", "mark").alias("mark"))


@query("borrowed_ordinals", f"""WITH {SQL_EV}, t AS (SELECT episode_id, seg_id, "start" + 5 AS a, "end" + 400 AS b FROM ev WHERE ord % 2 = 0), x AS (SELECT episode_id, idx, "start" AS lo, "start" + ("end" - "start") / 2 AS hi, ord FROM ev WHERE ord % 3 <> 0), j AS (SELECT t.seg_id, x.ord, least(b, hi) - greatest(a, lo) AS o, idx FROM t JOIN x ON x.episode_id = t.episode_id AND b > lo AND a < hi)
SELECT t.seg_id, j.ord AS audio_idx FROM t LEFT JOIN (SELECT * FROM j WHERE o > 0 QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY o DESC, idx) = 1) j USING (seg_id)""")
def borrowed_ordinals(spark, sf_dir):
    e = adapters.event_segments(spark, sf_dir).withColumn("turn_idx", F.row_number().over(Window.partitionBy("episode_id").orderBy("start", "ord")) - 1)
    truth = e.where("ord % 2 = 0").select("episode_id", "seg_id", (F.col("start") + 5).alias("start"), (F.col("end") + 400).alias("end"))
    extracted = e.where("ord % 3 <> 0").select("episode_id", "turn_idx", "start", (F.col("start") + (F.col("end") - F.col("start")) / 2).alias("end"), F.col("ord").alias("audio_idx"))
    return extraction.borrowed(truth, extracted, ["audio_idx"]).select("seg_id", "audio_idx")


@query("song_languages", """SELECT doc_id, substr(lang, 1, 2) AS lang, (doc_id % 10) / 10.0::DOUBLE AS prob, CASE WHEN doc_id % 10 < 5 THEN 'x' || doc_id % 10 END AS lang2 FROM documents""")
def song_languages(spark, sf_dir):
    """A first look at all, a second at those that aren't sure; the stand-ins read language and certainty from the content."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", "lang", (F.col("doc_id") % 10).cast("string")).alias("content"))
    first = lambda: lambda x: (x.split(",")[0], int(x.split(",")[1]) / 10)
    second = lambda: lambda x: ("x" + x.split(",")[1], 1.0)
    return extraction.languages(d, first, second, 0.5).select("doc_id", "lang", "prob", "lang2")


@query("topic_phrases", """SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'this topic' WHEN 1 THEN 'a nice phrase' WHEN 2 THEN lower(p_name) || ' NASA' WHEN 3 THEN 'and so on' ELSE 'this topic' END AS topic, CASE p_partkey % 3 WHEN 0 THEN 'this topic' WHEN 1 THEN left(p_name, 60) ELSE 'first line' END AS reply FROM part""")
def topic_phrases(spark, sf_dir):
    k = F.col("p_partkey")
    topic = F.when(k % 5 == 0, "").when(k % 5 == 1, "We talk").when(k % 5 == 2, F.concat("p_name", F.lit(" NASA"))).when(k % 5 == 3, "And so on").otherwise("It is")
    said = F.when(k % 5 == 1, ' "A nice phrase".').when(k % 5 == 4, " ")
    reply = F.when(k % 3 == 0, ' "." ').when(k % 3 == 1, F.concat(F.lit("'"), "p_name", F.lit("'."))).otherwise("first line\nsecond")
    return read(spark, sf_dir, "part").select("p_partkey", extraction.topic_phrase(topic, said).alias("topic"), extraction.topic_reply(reply).alias("reply")).withColumnRenamed("p_partkey", "k")


@query("clip_notes", """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'Emotion reference clip (e' || c_custkey || '.wav): primary=H, scores={A=0.25, H=0.75}' WHEN 1 THEN 'Song A clip (a.mp3): lyrics="la la"' || chr(10) || 'Song B clip (b.mp3): lyrics="' || c_mktsegment || '"' WHEN 2 THEN 'Song B clip (b.mp3): lyrics="' || c_mktsegment || '"' END AS note FROM customer""")
def clip_notes(spark, sf_dir):
    k = F.col("c_custkey")
    clips = {
        "emo": F.concat(F.lit("e"), k, F.lit(".wav")), "emo_primary": F.lit("H"), "emo_scores": F.create_map(F.lit("H"), F.lit(0.75), F.lit("A"), F.lit(0.25)),
        "song_a": F.when(k % 4 == 1, "a.mp3"), "words_a": F.lit(" la la\n"), "song_b": F.lit("b.mp3"), "words_b": F.col("c_mktsegment"),
    }
    task, kind = F.when(k % 4 == 0, "emotion").when(k % 4 == 3, "health").otherwise("music"), F.when(k % 4 == 0, "locate").otherwise("audio")
    return read(spark, sf_dir, "customer").select(k.alias("k"), extraction.clip_note(task, kind, clips).alias("note"))


# -- reports

STEM = "CASE p_partkey % 7 WHEN 0 THEN 'scores' WHEN 1 THEN concat('scores_text_', p_size) WHEN 2 THEN concat('scores_', p_size) WHEN 3 THEN 'scores_oracle_audio' WHEN 4 THEN concat('scores_oracle_all_j', p_size) WHEN 5 THEN 'scores_textual' ELSE concat('other', p_size) END"


@query("score_file_names", f"""WITH s AS (SELECT DISTINCT {STEM} AS stem FROM part), d AS (SELECT stem, CASE WHEN stem = 'scores' THEN 'hybrid' WHEN stem = 'scores_oracle_audio' THEN 'oracle_audio' WHEN stem LIKE 'scores\\_text\\_%' ESCAPE '\\' THEN 'text (' || substr(stem, 13) || ')' WHEN stem LIKE 'scores\\_oracle\\_all\\_%' ESCAPE '\\' THEN 'oracle_all (' || substr(stem, 19) || ')'
    ELSE 'hybrid (' || substr(stem, 8) || ')' END AS display FROM s WHERE starts_with(stem, 'scores')) SELECT stem, display, stem = 'scores_oracle_audio' AS hearing, row_number() OVER (ORDER BY CASE stem WHEN 'scores' THEN 3 WHEN 'scores_oracle_audio' THEN 6 ELSE 99 END, stem) AS place FROM d""")
def score_file_names(spark, sf_dir):
    return reports.score_files(read(spark, sf_dir, "part").select(F.expr(STEM).alias("stem"))).select("stem", "display", "hearing", F.col("place").cast("long").alias("place"))


SQL_RP = f"{SQL_SC}, rp AS (SELECT CASE variant WHEN 'src0' THEN 'hybrid' WHEN 'src1' THEN 'text (judge)' WHEN 'src2' THEN 'odd' ELSE 'emb (' || variant || ')' END AS display, ['state', 'change', 'locate'][1 + query_id % 3] AS t, answer, answer * factual AS rationale FROM sc WHERE NOT (variant = 'src0' AND query_id % 3 = 2))"


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, v = adapters.scores(spark, sf_dir), F.col("variant")
    display = F.when(v == "src0", "hybrid").when(v == "src1", "text (judge)").when(v == "src2", "odd").otherwise(F.concat(F.lit("emb ("), v, F.lit(")")))
    kind = F.element_at(F.array(*map(F.lit, ["state", "change", "locate"])), (F.col("query_id") % 3 + 1).cast("int"))
    return s.where(~((v == "src0") & (F.col("query_id") % 3 == 2))).select(display.alias("display"), kind.alias("query_type"), "answer", (F.col("answer") * F.col("factual")).alias("rationale"), F.lit(0.5).alias("plan_hit_rate"), F.lit(0.25).alias("retrieval_hit_rate"))


@query("scorecard_rows", f"""WITH {SQL_RP}, m AS (SELECT display, t, avg(answer) AS a, avg(rationale) AS r FROM rp GROUP BY 1, 2), w AS (SELECT display, max(a) FILTER (t = 'state') AS s, max(a) FILTER (t = 'locate') AS l, avg(a) AS v FROM m GROUP BY 1)
SELECT display, round(s, 3) AS state_ans, l IS NULL AS no_locate, round(v, 3) AS avg_ans, row_number() OVER (ORDER BY (display LIKE '%(%')::INT, regexp_extract(display, '\\((.*)\\)', 1), CASE split_part(display, ' (', 1) WHEN 'text' THEN 0 WHEN 'emb' THEN 1 WHEN 'hybrid' THEN 2 ELSE 99 END, display) AS place FROM w""")
def scorecard_rows(spark, sf_dir):
    """A scorecard written as tab-separated text and read again, in its order."""
    rows = reports.scorecard_rows(_reported(spark, sf_dir), ["state", "change", "locate"])
    path = _path(spark, "scorecard")
    reports.write_scorecard(rows, path)
    back = spark.read.option("header", "true").option("sep", "\t").csv(path).withColumn("place", F.monotonically_increasing_id() + 1)
    number = lambda c: F.round(F.col(c).try_cast("double"), 3)
    return back.select("display", number("state_ans").alias("state_ans"), (F.coalesce("locate_ans", F.lit("")) == "").alias("no_locate"), number("avg_ans").alias("avg_ans"), "place")


@query("score_lines", f"""WITH {SQL_RP}, d AS (SELECT display, bool_or(t = 'state') AS s, bool_or(t = 'change') AS c, bool_or(t = 'locate') AS l FROM rp GROUP BY 1), x AS (SELECT *, unnest(['Plan HR   ', 'Retr HR   ']) AS title, unnest(['     0.500', '     0.250']) AS v, unnest([0, 1]) AS n FROM d)
SELECT display, n, title || CASE WHEN s THEN v ELSE '         —' END || CASE WHEN c THEN v ELSE '         —' END || CASE WHEN l THEN v ELSE '         —' END || v AS line FROM x""")
def score_lines(spark, sf_dir):
    return reports.table_lines(_reported(spark, sf_dir), ["state", "change", "locate"]).where("n < 2")


@query("agreement_lines", f"""WITH {SQL_SC}, a AS (SELECT variant, count(*) AS n, avg(answer) AS x, avg(factual) AS y, avg(third) AS z FROM sc GROUP BY 1) SELECT variant, lpad(n::VARCHAR, 6, ' ') AS rows_, round(x, 3) AS first, round(z, 3) AS last FROM a""")
def agreement_lines(spark, sf_dir):
    judges = ["answer", "factual", "third"]
    lines = reports.agreement_lines(metrics.agreement(adapters.scores(spark, sf_dir), judges, ["variant"]), judges, "variant").where("section = 'leniency'")
    cell = lambda a, n: F.round(F.substring("line", a, n).cast("double"), 3)
    return lines.select("variant", F.substring("line", 1, 6).alias("rows_"), cell(8, 8).alias("first"), cell(26, 8).alias("last"))


@query("tasks_detected", """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'emotion' WHEN 1 THEN 'health' WHEN 2 THEN 'music' ELSE 'emotion' END AS task, CASE c_custkey % 4 WHEN 0 THEN 'music' WHEN 1 THEN 'health' END AS by_file FROM customer""")
def tasks_detected(spark, sf_dir):
    k = F.col("c_custkey") % 4
    types = F.when(k == 0, F.array(F.lit("change"), F.lit("time"))).when(k == 1, F.array(F.lit("reported"), F.lit("audio"))).when(k == 2, F.array(F.lit("position"))).otherwise(F.array(F.lit("locate_hard"), F.lit("reported")))
    stem = F.when(k == 0, "music_b").when(k == 1, "health").otherwise("else")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), reports.task_of(types).alias("task"), reports.task_of_file(stem).alias("by_file"))


@query("first_episodes", """SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def first_episodes(spark, sf_dir):
    """A run's early stop: the first hundred in order."""
    return corpora.admitted_only(read(spark, sf_dir, "orders"), 100, [F.col("o_totalprice").desc(), "o_orderkey"]).select(F.col("o_orderkey").alias("k"))


@query("expert_levels", """SELECT l_orderkey AS k, round(avg(l_quantity / 10), 6) AS mean, CASE WHEN avg(l_quantity / 10) >= 3.5 THEN 'High' WHEN avg(l_quantity / 10) >= 2.5 THEN 'Mid' ELSE 'Low' END AS level FROM lineitem GROUP BY 1""")
def expert_levels(spark, sf_dir):
    """Levels of means; values are added up in the order of the table's rows, as the SQL does with one thread: a mean of 2.5 or 3.5 may fall on either side."""
    from tessera.functions.numbers import tier

    rated = placed(read(spark, sf_dir, "lineitem")).select(F.col("l_orderkey").alias("k"), (F.col("l_quantity") / 10).alias("rating"), "_place")
    m = in_order(rated, ["k"], ["_place"], m=F.avg("rating"))
    return m.select("k", F.round("m", 6).alias("mean"), tier(F.col("m")).alias("level"))
