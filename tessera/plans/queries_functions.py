"""Named queries of single functions, small readers, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import agents
from tessera.functions import numbers, text
from tessera.operators import events, retrieval
from tessera.plans import adapters, prompts, reports
from tessera.plans.adapters import SQL_CV, SQL_EV, read
from tessera.plans.queries import FUSE_SQL, SETS_SQL, TIME_SQL, VEC_SQL, query, sets_of, vector_sets_all
from tessera.plans.queries_shaping import _arrived, _stream
from tessera.session import shared_folder
from tessera.sources import commits, readers, sinks
from tessera.streaming import streams


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("truncated_texts", """SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS shown FROM documents""")
def truncated_texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text")).alias("shown"))


@query("model_slugs", r"""SELECT p_partkey AS k, regexp_replace(list_last(string_split('org/' || p_name || ' v' || p_size || '.5/' || p_type || ':free', '/')), '[^A-Za-z0-9.-]+', '_', 'g') AS slug FROM part""")
def model_slugs(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), text.slug(F.concat(F.lit("org/"), "p_name", F.lit(" v"), "p_size", F.lit(".5/"), "p_type", F.lit(":free"))).alias("slug"))


#: Counts of a user's events by type, as a map.
SQL_MP = "mp AS (SELECT user_id, event_type AS e, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2)"


def _maps(spark, sf_dir) -> DataFrame:
    by = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return by.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))


@query("greatest_of_maps", f"""WITH {SQL_MP} SELECT user_id, arg_min(e, (-n, e)) AS top FROM mp GROUP BY 1""")
def greatest_of_maps(spark, sf_dir):
    return _maps(spark, sf_dir).select("user_id", numbers.arg_max(F.col("m")).alias("top"))


@query("softmax_shares", f"""WITH {SQL_MP}, x AS (SELECT user_id, max(n) AS t FROM mp GROUP BY 1), s AS (SELECT user_id, sum(exp((n - t) / 10)) AS s FROM mp JOIN x USING (user_id) GROUP BY 1) SELECT user_id, round(1 / s, 6) AS largest FROM s""")
def softmax_shares(spark, sf_dir):
    v = numbers.softmax(F.transform(F.map_values("m"), lambda x: x / 10))
    return _maps(spark, sf_dir).select("user_id", F.round(F.array_max(v), 6).alias("largest"))


@query("kept_entries", f"""WITH {SQL_MP} SELECT user_id, count(*) FILTER (n % 2 = 0) AS kept, CASE WHEN avg(n) < 2 THEN 'poor' WHEN avg(n) < 3 THEN 'fair' WHEN avg(n) < 4 THEN 'good' ELSE 'excellent' END AS word FROM mp GROUP BY 1""")
def kept_entries(spark, sf_dir):
    held = numbers.without_nulls(F.transform_values("m", lambda k, v: F.when(v % 2 == 0, v)))
    mean = F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, x: a + x) / F.size("m")
    return _maps(spark, sf_dir).select("user_id", F.size(held).cast("long").alias("kept"), numbers.quality_word(mean).alias("word"))


@query("active_tools", """SELECT o_orderkey AS query_id, array_to_string(list_sort(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'time' END, CASE WHEN o_orderkey % 3 = 0 THEN 'label' END, CASE WHEN o_orderkey % 5 > 2 THEN 'keyword' END], lambda x: x IS NOT NULL)), ',') AS active FROM orders""")
def active_tools(spark, sf_dir):
    """Fields of plans that are set in any of their sets; false, empty and missing ones aren't."""
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    sets = F.array(
        F.struct((k % 2 == 0).alias("time"), F.when(k % 3 == 0, "x").otherwise("").alias("label"), none.alias("keyword")),
        F.struct(F.lit(None).cast("boolean").alias("time"), none.alias("label"), F.when(k % 5 > 2, "y").otherwise("").alias("keyword")),
    )
    rows = read(spark, sf_dir, "orders").select(k.alias("query_id"), F.explode(sets).alias("s")).select("query_id", "s.*", *[none.alias(c) for c in ("text_emb", "audio_emb", "domain_emb")])
    return retrieval.active_tools(rows).select("query_id", F.array_join("active", ",").alias("active"))


@query("evidence_rows", f"""WITH {SETS_SQL}, {SQL_EV}, {TIME_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, set_no ORDER BY score DESC, ord) AS r FROM tm), k AS (SELECT query_id, set_no, seg_id, row_number() OVER (PARTITION BY query_id, set_no ORDER BY "start", r) AS rank FROM r WHERE r <= 10)
SELECT query_id, set_no, rank, seg_id, round("start", 3) AS a, round("end", 3) AS b, speaker FROM k JOIN ev USING (seg_id)""")
def evidence_rows(spark, sf_dir):
    """Fused hits joined to their segments, with a time pair."""
    e = adapters.event_segments(spark, sf_dir)
    out = retrieval.evidence(retrieval.fuse(retrieval.search_time(sets_of(spark, sf_dir).drop("label"), e)), e)
    return out.select("query_id", "set_no", F.col("rank").cast("long").alias("rank"), "seg_id", F.round(F.col("time")[0], 3).alias("a"), F.round(F.col("time")[1], 3).alias("b"), "speaker")


@query("evidence_blocks", f"""WITH {SQL_CV}, l AS (SELECT episode_id, ord % 2 AS s, row_number() OVER (PARTITION BY episode_id, ord % 2 ORDER BY ord) AS r, '[' || printf('%.1f', round("start", 1)) || '-' || printf('%.1f', round("end", 1)) || '] ' || speaker || ' (label=0.250, time=0.500): ' || CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS line FROM cv),
b AS (SELECT episode_id, s, 'Set ' || (s + 1) || ':' || chr(10) || string_agg(line, chr(10) ORDER BY r) AS t FROM l GROUP BY episode_id, s) SELECT episode_id AS query_id, string_agg(t, chr(10) || chr(10) ORDER BY s) AS block FROM b GROUP BY 1""")
def evidence_blocks(spark, sf_dir):
    cv = adapters.turn_segments(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("episode_id", F.col("ord") % 2).orderBy("ord"))
    ev = cv.select(F.col("episode_id").alias("query_id"), (F.col("ord") % 2).cast("int").alias("set_no"), rank.alias("rank"), F.array(F.round("start", 1), F.round("end", 1)).alias("time"), "speaker", "text", F.create_map(F.lit("label"), F.lit(0.25), F.lit("time"), F.lit(0.5)).alias("sources"))
    return prompts.evidence_blocks(ev)


@query("store_join", f"""WITH {SQL_EV} SELECT vec_id AS idx, seg_id, speaker FROM embeddings JOIN ev ON ev.ord = vec_id WHERE vec_id % 3 = 0""")
def store_join(spark, sf_dir):
    """A vector table written and read again, joined to the segments that its rows name."""
    e = adapters.event_segments(spark, sf_dir)
    v = read(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").join(e, F.col("vec_id") == F.col("ord"))
    path = _path(spark, "vectors")
    v.select(F.lit("text").alias("space"), F.col("vec_id").cast("long").alias("idx"), "seg_id", F.col("episode_id").cast("string").alias("episode_id"), "start", "end", F.col("embedding").cast("array<float>").alias("embedding")).write.parquet(path)
    store = readers.vector_store(spark, path)
    return store.select("idx", "seg_id").join(e.select("seg_id", "speaker"), "seg_id").select("idx", "seg_id", "speaker")


@query("excluded_ids", """SELECT o_orderkey AS query_id FROM orders WHERE o_orderkey % 10 <> 1""")
def excluded_ids(spark, sf_dir):
    """Ids that an exclusion list doesn't name: the first number of a line, behind comments and other lines."""
    path = _path(spark, "exclude")
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(k)
    o.select(F.when(k % 10 == 1, F.concat(k.cast("string"), F.lit("  bad one"))).when(k % 10 == 2, F.concat(F.lit("# "), k.cast("string"))).otherwise("x 17").alias("value")).write.text(path)
    return sinks.resume(o.select(k.alias("query_id")), readers.excluded(spark, path), "query_id")


@query("last_lines", """SELECT user_id AS query_id, arg_max(event_type, event_id) AS query_type FROM events GROUP BY 1""")
def last_lines(spark, sf_dir):
    """The last row of each key."""
    return readers.keep_last(read(spark, sf_dir, "events"), "user_id", "event_id").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("query_type"))


@query("resumed_scores", """SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS run FROM orders""")
def resumed_scores(spark, sf_dir):
    """Scores appended by a run that was cut off and by the one that went on."""
    path = _path(spark, "scores")
    todo = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"))
    sinks.append_new(todo.where("query_id % 3 = 0"), path, "query_id", lambda df: df.withColumn("run", F.lit(1)))
    sinks.append_new(todo, path, "query_id", lambda df: df.withColumn("run", F.lit(2)))
    return readers.jsonl(spark, path, "query_id bigint, run int")


@query("segments_of_episodes", f"""WITH {SQL_EV} SELECT episode_id, seg_id, round(label_score, 4) AS score FROM ev WHERE episode_id IN (3, 5, 8)""")
def segments_of_episodes(spark, sf_dir):
    """Segments written in a folder for each episode and read again for some; only those folders are listed."""
    path = _path(spark, "segments")
    sinks.by_episode(adapters.event_segments(spark, sf_dir).select("episode_id", "seg_id", F.col("label_score").alias("score")), path)
    back = spark.read.schema("seg_id string, score double, episode_id long").parquet(path).where(F.col("episode_id").isin(3, 5, 8))
    return back.select("episode_id", "seg_id", F.round("score", 4).alias("score"))


@query("finite_levels", """SELECT p_partkey AS k, CASE WHEN p_size % 5 > 2 THEN p_size / 2.0::DOUBLE END AS x FROM part""")
def finite_levels(spark, sf_dir):
    """NaN and infinite numbers of JSON lines are null."""
    path = _path(spark, "levels")
    k = F.col("p_size") % 5
    value = F.when(k == 0, "NaN").when(k == 1, "-Infinity").when(k == 2, "Infinity").otherwise((F.col("p_size") / 2).cast("string"))
    read(spark, sf_dir, "part").select(F.concat(F.lit('{"k": '), "p_partkey", F.lit(', "x": '), value, F.lit("}")).alias("value")).write.text(path)
    return readers.finite(readers.jsonl(spark, path, "k bigint, x double"))


@query("emotion_lines", """SELECT o_orderkey AS k, array_to_string(list_filter([CASE WHEN o_orderkey % 4 <> 0 THEN '- emotion: primary=H [A=0.25, H=0.75]' END, CASE WHEN o_orderkey % 3 = 0 THEN '- levels [0-1]: valence=0.50, dominance=0.' || 10 + o_orderkey % 80 END, CASE WHEN o_orderkey % 5 = 1 THEN '- votes: A=1, H=3' END], lambda x: x IS NOT NULL), chr(10)) AS line FROM orders""")
def emotion_lines(spark, sf_dir):
    k = F.col("o_orderkey")
    m = lambda a, h, kind: F.create_map(F.lit("H"), F.lit(h).cast(kind), F.lit("A"), F.lit(a).cast(kind))
    s = F.struct(F.when(k % 4 != 0, "H").alias("primary"), F.when(k % 4 != 0, m(0.25, 0.75, "double")).alias("scores"), F.when(k % 3 == 0, 0.5).alias("valence"), F.lit(None).cast("double").alias("arousal"), F.when(k % 3 == 0, (10 + k % 80) / F.lit(100.0)).alias("dominance"), F.when(k % 5 == 1, m(1, 3, "bigint")).alias("votes"))
    return read(spark, sf_dir, "orders").select(k.alias("k"), s.alias("s")).select("k", prompts.emotion_line(F.col("s")).alias("line"))


@query("active_shares", """SELECT user_id, round(avg((value > 50)::INT), 6) AS share FROM events GROUP BY 1""")
def active_shares(spark, sf_dir):
    return events.longest_runs(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") > 50).select("user_id", F.round("share", 6).alias("share"))


@query("quality_csv", """SELECT p_partkey AS k, round(p_retailprice - 500 * (p_size % 3) - abs(p_size / 50.0::DOUBLE - 0.25) * 10, 4) AS score, CASE WHEN p_size % 3 = 2 THEN 'clipping' ELSE '' END AS reject FROM part""")
def quality_csv(spark, sf_dir):
    """Scores of clips by ratio, clipping and activity, written as CSV and read again."""
    path = _path(spark, "quality")
    score = F.col("p_retailprice") - 500 * (F.col("p_size") % 3) - F.abs(F.col("p_size") / 50 - 0.25) * 10
    reports.write_quality(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.round(score, 4).alias("score"), F.when(F.col("p_size") % 3 == 2, "clipping").otherwise("").alias("reject")), path)
    return spark.read.schema("k bigint, score double, reject string").option("header", "true").csv(path).withColumn("reject", F.coalesce("reject", F.lit("")))


@query("reference_search", f"""WITH v AS ({VEC_SQL}), tv AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s6 DESC, ord) AS r FROM v WHERE query_id % 3 <> 0), av AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s6 DESC, ord) AS r FROM v WHERE ord % 2 = 0 AND query_id % 4 <> 0),
h AS (SELECT query_id, set_no, seg_id, "start", "end", round(s6, 3) AS score, 'text_emb' AS source, 2 AS m, r AS o FROM tv WHERE r <= 5 UNION ALL SELECT query_id, set_no, seg_id, "start", "end", round(s6, 3), 'audio_emb', 4, r FROM av WHERE r <= 5), {FUSE_SQL.format(k=4)}""")
def reference_search(spark, sf_dir):
    """Sets that name a text and a clip, whose vectors come from tables of references; one that has none finds nothing."""
    v = adapters.vectors(spark, sf_dir)
    q = vector_sets_all(spark, sf_dir)
    sets = q.withColumn("text_emb", F.concat(F.lit("t"), "query_id")).withColumn("audio_emb", F.lit("A")).drop("query_vector")
    text_refs = q.where("query_id % 3 <> 0").select("query_id", F.concat(F.lit("t"), "query_id").alias("ref"), "query_vector")
    clip_refs = q.where("query_id % 4 <> 0").select("query_id", F.lit("A").alias("ref"), "query_vector")
    fused = agents.retrieved(sets, v, {"text_emb": v, "audio_emb": v.where("idx % 2 = 0")}, {"text_emb": text_refs, "audio_emb": clip_refs}, ("text_emb", "audio_emb"), 4)
    return fused.select("query_id", "set_no", "seg_id", "fused", "rank")


# -- streams


@query("stream_sessions", """WITH e AS (SELECT event_type, ts, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 7200000000)::INT, 1) AS nw FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), s AS (SELECT *, sum(nw) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT event_type, epoch_us(min(ts)) // 1000 AS begins, count(*) AS n FROM s GROUP BY event_type, g""")
def stream_sessions(spark, sf_dir):
    out = _arrived(streams.sessions(_stream(spark, sf_dir), "2 hours", ["event_type"]))
    return out.select("event_type", F.unix_millis("session_window.start").alias("begins"), "n")


@query("stream_appended", """SELECT event_id, user_id FROM events""")
def stream_appended(spark, sf_dir):
    """Rows of new keys appended by a stream that is started twice: its checkpoint makes the second run add nothing."""
    out, checkpoint = _path(spark, "appended"), _path(spark, "checkpoint")
    for _ in range(2):
        streams.append(streams.new_only(_stream(spark, sf_dir), "event_id"), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id")


@query("stream_anchored", """WITH e AS (SELECT user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t, value FROM events), s AS (SELECT user_id, min(t) AS a, max(t) AS z FROM e GROUP BY 1), m AS (SELECT max(t) - 86400 AS mark FROM e),
w AS (SELECT user_id, a + i * 86400.0::DOUBLE AS lo, a + i * 86400.0::DOUBLE + 259200 AS hi FROM (SELECT *, unnest(range(0, floor((least(z, mark) - a - 259200) / 86400.0::DOUBLE)::BIGINT + 1)) AS i FROM s, m WHERE least(z, mark) - a >= 259200)),
h AS (SELECT w.user_id, lo, avg(value) FILTER (t < lo + 129600) AS h1, avg(value) FILTER (t >= lo + 129600) AS h2 FROM w JOIN e ON e.user_id = w.user_id AND t BETWEEN lo AND hi GROUP BY ALL HAVING h1 IS NOT NULL AND h2 IS NOT NULL)
SELECT user_id, round(lo * 1e6)::BIGINT AS lo_us, round(h1, 6) AS half1, round(h2, 6) AS half2 FROM h""")
def stream_anchored(spark, sf_dir):
    """Windows of three days every day from each user's first event, in a stream; those that end a day before the last event of all are over."""
    path = f"{shared_folder(spark).rstrip('/')}/anchored-{uuid.uuid4().hex}"
    out = streams.anchored(_stream(spark, sf_dir), ["user_id"], 259200.0, 86400.0, late="1 day")
    streams.append(out, path, f"{path}-checkpoint").awaitTermination()
    return spark.read.schema(out.schema).parquet(path).select("user_id", F.round((F.col("lo") - 1_704_067_200) * 1e6).cast("long").alias("lo_us"), F.round("half1", 6).alias("half1"), F.round("half2", 6).alias("half2"))


@query("committed_vectors", """WITH v AS (SELECT vec_id, vec_id % 2 AS half, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v) SELECT vec_id, row_number() OVER (ORDER BY half, vec_id) - 1 AS idx, round(e[1] / n, 6) AS first FROM n""")
def committed_vectors(spark, sf_dir):
    """Vectors appended in two batches to a table that changes as a whole, the second batch twice."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    table = commits.Table(spark, f"{shared_folder(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}", rows.schema, "idx")
    first = rows.select(F.size("embedding")).first()
    for batch, half in enumerate((0, 1, 1)):
        table.append_vectors(rows.where(F.col("vec_id") % 2 == half), first[0] if first else 0, ["vec_id"], "halves", min(batch, 1))
    return table.read().select("vec_id", "idx", F.round(F.col("embedding")[0], 6).alias("first"))


@query("committed_upserts", """WITH l AS (SELECT user_id, arg_max(event_id, event_id) AS event_id FROM events GROUP BY 1), f AS (SELECT user_id, min(event_id) FILTER (event_id % 2 = 0) AS a, max(event_id) FILTER (event_id % 2 = 0) AS b, max(event_id) FILTER (event_id % 2 = 1) AS c FROM events GROUP BY 1)
SELECT user_id, coalesce(c, b) AS event_id, row_number() OVER (ORDER BY b IS NULL, CASE WHEN b IS NULL THEN c ELSE b END, user_id) - 1 AS place FROM f""")
def committed_upserts(spark, sf_dir):
    """The last event of each user: those with even numbers upserted first, then the odd ones; who was there keeps the place."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id")
    table = commits.Table(spark, f"{shared_folder(spark).rstrip('/')}/users-{uuid.uuid4().hex}", rows.schema, "place")
    for batch in (0, 1, 1):
        table.upsert(rows.where(F.col("event_id") % 2 == batch), "user_id", ["event_id"], "halves", batch)
    return table.read()
