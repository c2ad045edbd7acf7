"""Further named queries: reshaping, evaluation, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import experts
from tessera.functions import numbers, text
from tessera.operators import events, intervals, retrieval, sampling, shaping
from tessera.plans import adapters, metrics, prompts
from tessera.plans.adapters import SQL_CV, SQL_EV, SQL_SC, read
from tessera.session import shared_folder
from tessera.plans.queries import POINTS_SQL, WINDOWS_SQL, literal, points_all, query, sql_values, windows_of


@query("slack_point_match_all", f"""WITH {SQL_EV}, {POINTS_SQL} SELECT point_id, seg_id FROM pt JOIN ev USING (episode_id) WHERE "end" + 1 >= t AND "start" - 1 <= t""")
def slack_point_match_all(spark, sf_dir):
    grid = 50000.0
    cells = F.explode(F.sequence(F.floor((F.col("start") - 1) / grid), F.floor((F.col("end") + 1) / grid)))
    e = adapters.event_segments(spark, sf_dir).select(F.col("episode_id").alias("_e"), "seg_id", "start", "end").withColumn("_cell", cells)
    p = points_all(spark, sf_dir).withColumn("_at", F.floor(F.col("t") / grid))
    return p.join(e, (F.col("episode_id") == F.col("_e")) & (F.col("_at") == F.col("_cell")) & shaping.slack_overlaps(F.col("start"), F.col("end"), F.col("t"))).select("point_id", "seg_id")


CHOICES = [("music", "a", "x,y"), ("music", "default", "d"), ("health", "b", "z")]


@query("inject_choices", f"""WITH c(task, query_type, options) AS (VALUES {sql_values(CHOICES)}), q AS (SELECT n_nationkey AS query_id, CASE n_nationkey % 3 WHEN 0 THEN 'music' WHEN 1 THEN 'health' ELSE 'none' END AS task, CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS query_type, CASE WHEN n_nationkey % 7 = 0 THEN 'own' END AS choices FROM nation)
SELECT query_id, coalesce(q.choices, c.options, d.options) AS choices FROM q LEFT JOIN c ON q.task = c.task AND q.query_type = c.query_type LEFT JOIN c d ON q.task = d.task AND d.query_type = 'default'""")
def inject_choices(spark, sf_dir):
    n = F.col("n_nationkey")
    q = read(spark, sf_dir, "nation").select(n.alias("query_id"), F.when(n % 3 == 0, "music").when(n % 3 == 1, "health").otherwise("none").alias("task"), F.when(n % 2 == 0, "a").otherwise("b").alias("query_type"), F.when(n % 7 == 0, "own").alias("choices"))
    return shaping.with_choices(q, literal(spark, CHOICES, "task string, query_type string, options string")).select("query_id", "choices")


@query("fill_template", """SELECT s_suppkey, 'At ' || s_nationkey::VARCHAR || ' min ' || s_name || ' says ' || CASE WHEN s_suppkey % 2 = 0 THEN 'yes' ELSE '' END AS query FROM supplier""")
def fill_template(spark, sf_dir):
    t = shaping.filled(F.lit("At {m} min {who} says {what}"), {"m": F.col("s_nationkey"), "who": F.col("s_name"), "what": F.when(F.col("s_suppkey") % 2 == 0, "yes")})
    return read(spark, sf_dir, "supplier").select("s_suppkey", t.alias("query"))


@query("letter_speakers", """SELECT n_regionkey, n_nationkey, chr((dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 64)::INT) AS letter FROM nation""")
def letter_speakers(spark, sf_dir):
    return shaping.lettered(read(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey").select("n_regionkey", "n_nationkey", "letter")


@query("clip_map_priority", """WITH a AS (SELECT o_custkey AS k, 'o' || min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 = 0) SELECT c_custkey AS k, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 0 WHEN b.v IS NOT NULL THEN 1 END AS source_no FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey""")
def clip_map_priority(spark, sf_dir):
    a = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.concat(F.lit("o"), F.min("o_orderkey")).alias("v"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return shaping.first_source(c.select("k"), [a, c.where("k % 3 = 0")], "k", "v")


@query("two_queries_each", """SELECT r_regionkey, unnest(['reported', 'exhibited']) AS query_type FROM region""")
def two_queries_each(spark, sf_dir):
    return shaping.doubled(read(spark, sf_dir, "region").select("r_regionkey"), ["reported", "exhibited"])


@query("scorecard_order", f"""WITH {SQL_SC}, v AS (SELECT DISTINCT query_type FROM sc) SELECT query_type, CASE query_type WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 99 END AS rank FROM v""")
def scorecard_order(spark, sf_dir):
    return shaping.custom_order(adapters.scores(spark, sf_dir).select("query_type").distinct(), "query_type", ["fr", "en"])


@query("song_level_label", f"""WITH {SQL_CV}, s AS (SELECT episode_id, min("start") AS a, max("end") AS b FROM cv GROUP BY 1), w AS (SELECT episode_id, i, a + i * 30 AS lo, least(b, a + (i + 1) * 30) AS hi FROM (SELECT *, unnest(range(0, greatest(1, ceil((b - a) / 30.0::DOUBLE))::BIGINT)) AS i FROM s)),
m AS (SELECT episode_id, round(avg(hi - lo), 6) AS width FROM w GROUP BY 1) SELECT cv.episode_id, cv.ord, width FROM cv JOIN m USING (episode_id)""")
def song_level_label(spark, sf_dir):
    cv = adapters.turn_segments(spark, sf_dir)
    w = intervals.tumbling(cv.groupBy("episode_id").agg(F.min("start").alias("start"), F.max("end").alias("end")), 30.0).withColumn("width", F.col("hi") - F.col("lo"))
    return shaping.window_labels(w, cv.select("episode_id", "ord"), "episode_id", ["width"]).withColumn("width", F.round("width", 6))


@query("annotator_frames", """SELECT l_partkey, l_linenumber, round(avg(l_quantity), 6) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 6) AS std, count(l_quantity) AS n FROM lineitem GROUP BY 1, 2""")
def annotator_frames(spark, sf_dir):
    return shaping.annotator_frames(read(spark, sf_dir, "lineitem"), ["l_partkey", "l_linenumber"], "l_quantity").select("l_partkey", "l_linenumber", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("modal_value", """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, event_type) AS r FROM c) WHERE r = 1""")
def modal_value(spark, sf_dir):
    return shaping.modal(read(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("label_histogram", """SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1""")
def label_histogram(spark, sf_dir):
    by = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return by.join(F.broadcast(by.agg(F.sum("n").alias("t")))).select("event_type", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("frames_to_seconds", """SELECT user_id, floor(event_id / 25.0::DOUBLE)::BIGINT AS second, round(avg(value), 6) AS value FROM events GROUP BY 1, 2""")
def frames_to_seconds(spark, sf_dir):
    f = read(spark, sf_dir, "events").withColumnRenamed("event_id", "frame")
    return events.frames_to_seconds(f, "user_id", 25.0, ["value"]).withColumn("value", F.round("value", 6))


@query("window_truth_distinct", f"""WITH {WINDOWS_SQL}, {SQL_EV} SELECT DISTINCT seg_id FROM ev JOIN win USING (episode_id) WHERE "end" > lo AND "start" < hi""")
def window_truth_distinct(spark, sf_dir):
    return intervals.overlap_join(adapters.event_segments(spark, sf_dir), windows_of(spark, sf_dir), "episode_id").select("seg_id").distinct()


@query("change_points", """WITH l AS (SELECT label, vec_id, list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)) AS s FROM embeddings) SELECT label, vec_id, sum(CASE WHEN s IS NULL OR s < 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id)::BIGINT AS segment FROM l""")
def change_points(spark, sf_dir):
    return shaping.change_points(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.1).select("label", "vec_id", "segment")


@query("vector_topk_all", """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS idx, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS rank FROM s) SELECT query_id, idx, rank FROM r WHERE rank <= 5""")
def vector_topk_all(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "embedding")
    q = v.where("idx % 50 = 0").select(F.col("idx").alias("query_id"), F.col("embedding").alias("query_vector"))
    return shaping.vector_scores(q, v, 5).select("query_id", "idx", F.col("rank").cast("long").alias("rank"))


@query("interior_clip", """SELECT o_orderkey, greatest(o_orderkey % 100 + 5, (o_orderkey % 100 + o_orderkey % 100 + 40) / 2.0::DOUBLE - 2.5)::DOUBLE AS clip FROM orders""")
def interior_clip(spark, sf_dir):
    a = (F.col("o_orderkey") % 100).cast("double")
    return read(spark, sf_dir, "orders").select("o_orderkey", numbers.clip_start(a, a + 40).alias("clip"))


@query("active_run_lengths", """WITH f AS (SELECT user_id, event_id, value > 50 AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value > 50 ORDER BY ts, event_id) AS g FROM events), r AS (SELECT user_id, count(*) AS n FROM f WHERE f GROUP BY user_id, g) SELECT u.user_id, coalesce(max(n), 0)::INT AS longest FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r USING (user_id) GROUP BY 1""")
def active_run_lengths(spark, sf_dir):
    return events.longest_runs(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") > 50).select("user_id", F.col("longest").cast("int").alias("longest"))


@query("row_rationale", f"""WITH {SQL_SC} SELECT query_id, CASE WHEN variant IN ('src0', 'src1') THEN answer ELSE answer * factual END::BIGINT AS rationale FROM sc""")
def row_rationale(spark, sf_dir):
    s = adapters.scores(spark, sf_dir)
    return s.select("query_id", metrics.rationale_score(F.col("answer"), F.col("factual"), F.col("variant").isin("src0", "src1")).cast("long").alias("rationale"))


@query("human_correct", """WITH h AS (SELECT o_orderkey AS id, ['emotion', 'emotion', 'emotion', 'emotion', 'music', 'health', 'other'][1 + o_orderkey % 7] AS task, ['state', 'change', 'comparison', 'locate'][1 + o_orderkey % 7 % 4] AS kind,
    ['A', 'B', 'C', 'D', '0:17', 'x'][1 + o_custkey % 6] AS one, ['N', 'H', 'S', 'A', 'U'][1 + o_orderkey % 5] AS emo, ['rising', 'falling', 'none'][1 + o_orderkey % 3] AS dir, ['A', 'B', 'tie'][1 + o_orderkey % 3] AS win, ['yes', 'NO'][1 + o_orderkey % 2] AS ans, (o_orderkey % 30)::DOUBLE AS t0 FROM orders),
c AS (SELECT *, [one, 'A', 'E'] AS many, [t0, t0 + 6] AS b FROM h)
SELECT id, CASE WHEN task = 'emotion' AND kind = 'state' THEN list_contains(list_transform(many, lambda c: CASE c WHEN 'A' THEN 'N' WHEN 'B' THEN 'H' WHEN 'C' THEN 'S' WHEN 'D' THEN 'A' WHEN 'E' THEN 'U' END), emo)::INT
    WHEN task = 'emotion' AND kind = 'change' THEN (coalesce(CASE one WHEN 'A' THEN 'rising' WHEN 'B' THEN 'falling' WHEN 'C' THEN 'none' END, '-') = dir)::INT WHEN task = 'emotion' AND kind = 'comparison' THEN (one = win)::INT
    WHEN task = 'emotion' THEN CASE WHEN one = '0:17' THEN (17 BETWEEN b[1] - 5 AND b[2] + 5)::INT END WHEN task = 'music' THEN (lower(CASE one WHEN 'C' THEN 'Tie' ELSE one END) = lower(win))::INT
    WHEN task = 'health' THEN (lower(CASE one WHEN 'A' THEN 'Yes' WHEN 'B' THEN 'No' ELSE one END) = lower(ans))::INT END AS correct FROM c""")
def human_correct(spark, sf_dir):
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    o = F.col("o_orderkey")
    task, kind, one = pick(["emotion"] * 4 + ["music", "health", "other"], o % 7), pick(["state", "change", "comparison", "locate"], o % 7 % 4), pick(["A", "B", "C", "D", "0:17", "x"], F.col("o_custkey") % 6)
    choice = F.when((task == "emotion") & (kind == "state"), F.array(one, F.lit("A"), F.lit("E"))).otherwise(F.array(one))
    t0 = (o % 30).cast("double")
    truth = {"emo": pick(["N", "H", "S", "A", "U"], o % 5), "direction": pick(["rising", "falling", "none"], o % 3), "winner": pick(["A", "B", "tie"], o % 3), "answer": pick(["yes", "NO"], o % 2), "t0": t0, "t1": t0 + 6}
    return read(spark, sf_dir, "orders").select(o.alias("id"), metrics.human_correct(task, kind, choice, truth).alias("correct"))


@query("judged_answers", """WITH q AS (SELECT doc_id AS query_id, CASE quality WHEN 1 THEN 'good text' WHEN 0 THEN 'poor text' END AS expected, CASE WHEN toxic = 1 THEN 'It is a poor text' ELSE 'It is a GOOD text' END AS prediction FROM labels) SELECT query_id, contains(lower(prediction), expected)::INT AS answer FROM q""")
def judged_answers(spark, sf_dir):
    """Predictions through prompts, a judge and the verdict parser."""
    rows = read(spark, sf_dir, "labels")
    q = rows.select(F.col("doc_id").alias("query_id"), F.when(F.col("quality") == 1, "good text").otherwise("poor text").alias("expected"))
    p = rows.select(F.col("doc_id").alias("query_id"), F.when(F.col("toxic") == 1, "It is a poor text").otherwise("It is a GOOD text").alias("prediction"))
    replies = experts.batched(prompts.judge_prompts(p, q, "answer"), experts.stand_in_judge)
    return replies.select("query_id", text.verdict(F.col("reply")).alias("answer"))


@query("evidence_text", f"""WITH {WINDOWS_SQL}, {SQL_EV}, e AS (SELECT episode_id, ev."start" AS s, '[' || format('{{:.1f}}', ev."start") || '-' || format('{{:.1f}}', "end") || '] ' || speaker || ': ' || text AS line FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY s, line) AS r, count(*) OVER (PARTITION BY episode_id) AS n FROM e) SELECT episode_id, string_agg(line, chr(10) ORDER BY r) FILTER (r <= 3) || CASE WHEN max(n) > 3 THEN chr(10) || '... and ' || (max(n) - 3) || ' more' ELSE '' END AS block FROM r GROUP BY 1""")
def evidence_text(spark, sf_dir):
    return prompts.truth_block(adapters.event_segments(spark, sf_dir), "episode_id")


@query("context_snippet", f"""WITH {SQL_CV} SELECT episode_id, left(string_agg(text, ' ' ORDER BY ord), 200) AS snippet FROM cv WHERE "start" < 60 GROUP BY 1""")
def context_snippet(spark, sf_dir):
    t = adapters.turn_segments(spark, sf_dir).where("start < 60").groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("a"))
    return t.select("episode_id", F.substring(F.array_join(F.transform("a", lambda x: x["text"]), " "), 1, 200).alias("snippet"))


def _arrived(df: DataFrame) -> DataFrame:
    """What a stream's query has made of everything that is there: its whole result, written in the shared folder batch by batch."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/arrived-{uuid.uuid4().hex}"
    spark.createDataFrame([], df.schema).write.parquet(path)
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    q = df.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = read(spark, sf_dir, "events")
    rows = spark.readStream.schema(stored.schema).parquet(f"{sf_dir}/events.parque[t]")  # a glob, since the path may be a file or a folder
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_tumbling", """SELECT event_type, epoch_ms(ts) // 86400000 AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, sf_dir):
    from tessera.streaming import streams

    out = _arrived(streams.tumbling(_stream(spark, sf_dir), "1 day", ["event_type"]))
    return out.select("event_type", F.floor(F.unix_millis("window.start") / 86400000).alias("day"), "n", F.round("mean", 6).alias("mean"))


@query("stream_sliding", """SELECT (epoch_ms(ts) // 86400000) - k AS day, count(*) AS n FROM events, range(0, 3) AS r(k) GROUP BY 1""")
def stream_sliding(spark, sf_dir):
    from tessera.streaming import streams

    out = _arrived(streams.sliding(_stream(spark, sf_dir), "3 days", "1 day", []))
    return out.select(F.floor(F.unix_millis("window.start") / 86400000).alias("day"), "n")


@query("score_table_written", f"""WITH {SQL_SC} SELECT variant, round(avg(answer) FILTER (query_type = 'en'), 4)::VARCHAR AS en_ans, round(avg(factual) FILTER (query_type = 'en'), 4)::VARCHAR AS en_rat FROM sc GROUP BY 1""")
def score_table_written(spark, sf_dir):
    """A tab-separated scorecard, written and read again."""
    path = f"{shared_folder(spark).rstrip('/')}/scores-{uuid.uuid4().hex}"
    metrics.tsv_scorecard(adapters.scores(spark, sf_dir).withColumnRenamed("factual", "rationale"), path, ["en", "fr"])
    return spark.read.csv(path, sep="\t", header=True).select("variant", "en_ans", "en_rat")
