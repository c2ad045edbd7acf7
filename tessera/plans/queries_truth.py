"""Named queries of evaluation against the ground truth."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import agents, deferred, experts
from tessera.plans import adapters, metrics, truth
from tessera.plans.adapters import SQL_EV, read
from tessera.plans.queries import query
from tessera.session import shared_folder, stored

#: Events as truth segments: every other one is a song by number, labels of two thirds; and orders as queries of all kinds.
SQL_TG = f"""{SQL_EV}, tg AS (SELECT episode_id, seg_id, ord, "start", "end", CASE WHEN ord % 2 = 0 THEN 'SONG_' || lpad((ord % 6)::VARCHAR, 2, '0') ELSE speaker END AS speaker, CASE WHEN ord % 3 <> 0 THEN label END AS label, text FROM ev)"""
SQL_QU = """qu AS (SELECT o_orderkey AS query_id, o_custkey % 150 AS episode_id, ['categorical', 'time_and_quote', 'trend', 'speaker_id', NULL, NULL, NULL, NULL][1 + o_orderkey % 8] AS jt, (o_orderkey * 7919 % 2592000)::DOUBLE AS t, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey * 7919 % 2592000)::DOUBLE END AS t0,
    CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 8 < 5 THEN (o_orderkey * 7919 % 2592000)::DOUBLE + 10 END AS time_ref, CASE WHEN o_orderkey % 9 = 0 THEN ['ev_' || o_custkey % 150 || '_0001', 'ev_' || o_custkey % 150 || '_0003', 'none'] END AS ids,
    CASE WHEN o_orderkey % 8 = 4 THEN [(o_orderkey * 7919 % 2592000)::DOUBLE + 1000, (o_orderkey * 7919 % 2592000)::DOUBLE + 50000] ELSE [] END AS refs, CASE o_orderkey % 8 WHEN 5 THEN [3, 5] WHEN 7 THEN [90] ELSE [] END AS pos FROM orders)"""
BLOCK = "array<struct<time_ref:double,position:int,file_name:string,name:string>>"


def segments(spark, sf_dir) -> DataFrame:
    e, o = adapters.event_segments(spark, sf_dir), F.col("ord")
    return e.select("episode_id", "seg_id", "ord", "start", "end", F.when(o % 2 == 0, F.concat(F.lit("SONG_"), F.lpad((o % 6).cast("string"), 2, "0"))).otherwise(F.col("speaker")).alias("speaker"), F.when(o % 3 != 0, F.col("label")).alias("label"), "text")


def asked(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    t, ep = (k * 7919 % 2592000).cast("double"), F.col("o_custkey") % 150
    kind = F.element_at(F.array(*map(F.lit, ["categorical", "time_and_quote", "trend", "speaker_id", None, None, None, None])), (k % 8 + 1).cast("int"))
    none = F.lit(None)
    at = lambda time, place: F.struct(time.cast("double").alias("time_ref"), place.cast("int").alias("position"), none.cast("string").alias("file_name"), none.cast("string").alias("name"))
    blocks = F.when(k % 8 == 4, F.array(at(t + 1000, none), at(t + 50000, none))).when(k % 8 == 5, F.array(at(none, F.lit(3)), at(none, F.lit(5)))).when(k % 8 == 7, F.array(at(none, F.lit(90)))).otherwise(F.array().cast(BLOCK))
    ids = F.when(k % 9 == 0, F.array(F.format_string("ev_%d_0001", ep), F.format_string("ev_%d_0003", ep), F.lit("none")))
    clips = F.when(k % 16 == 3, F.array(F.concat(F.lit("x/s"), (k % 6).cast("string"), F.lit(".wav")), F.lit("y/q.wav")))
    return read(spark, sf_dir, "orders").select(k.alias("query_id"), ep.alias("episode_id"), F.when(k % 50 == 6, "health").otherwise("emotion").alias("task"), kind.alias("judge_type"), F.when(k % 2 == 0, t).alias("t0"), F.when((k % 5 != 0) & (k % 8 < 5), t + 10).alias("time_ref"), ids.alias("gt_seg_ids"), blocks.alias("blocks"), clips.alias("clips"))


RESOLVED_SQL = """e0 AS (SELECT query_id, seg_id FROM qu JOIN tg USING (episode_id) WHERE list_contains(ids, seg_id)), p AS (SELECT query_id, episode_id, coalesce(nullif(t0, 0), nullif(time_ref, 0), 0) AS at_ FROM qu WHERE ids IS NULL AND jt IN ('categorical', 'time_and_quote')),
e1 AS (SELECT query_id, seg_id FROM p JOIN tg USING (episode_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ("start" <= at_ + 1 AND "end" >= at_ - 1) DESC, abs("start" - at_), "start", ord) = 1),
e2 AS (SELECT query_id, seg_id FROM qu JOIN tg USING (episode_id) WHERE ids IS NULL AND ((jt = 'trend' AND "start" < coalesce(time_ref, 0) + 31 AND "end" > coalesce(time_ref, 0) - 1) OR (jt = 'speaker_id' AND "start" < coalesce(time_ref, 0) + 60 AND "end" > coalesce(time_ref, 0)))),
r AS (SELECT * FROM qu WHERE ids IS NULL AND coalesce(jt, '') NOT IN ('categorical', 'time_and_quote') AND query_id NOT IN (SELECT query_id FROM e2)), u AS (SELECT query_id, episode_id, unnest(list_concat(CASE WHEN time_ref IS NULL THEN [] ELSE [time_ref] END, refs)) AS at_ FROM r),
e3 AS (SELECT DISTINCT query_id, seg_id FROM u JOIN tg USING (episode_id) WHERE "end" > greatest(0, at_ - 30) AND "start" < at_ + 30), s AS (SELECT * FROM r WHERE time_ref IS NULL AND len(refs) = 0),
e4 AS (SELECT DISTINCT query_id, seg_id FROM (SELECT query_id, episode_id, unnest(pos) AS p FROM s) x JOIN tg ON tg.episode_id = x.episode_id AND speaker = 'SONG_' || lpad((p - 1)::VARCHAR, 2, '0')), e5 AS (SELECT query_id, seg_id FROM s JOIN tg USING (episode_id) WHERE query_id NOT IN (SELECT query_id FROM e4)),
ge AS (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3 UNION ALL SELECT * FROM e4 UNION ALL SELECT * FROM e5)"""


@query("resolved_evidence", f"WITH {SQL_TG}, {SQL_QU}, {RESOLVED_SQL} SELECT query_id, seg_id FROM ge")
def resolved_evidence(spark, sf_dir):
    return truth.resolved_evidence(asked(spark, sf_dir), segments(spark, sf_dir)).select("query_id", "seg_id")


@query("oracle_plans", f"""WITH {SQL_TG}, {SQL_QU}, x AS (SELECT * FROM tg WHERE episode_id % 4 <> 0 AND ord % 3 <> 1), b AS (SELECT episode_id, ord, "start", "end" FROM x UNION ALL SELECT episode_id, ord, "start", "end" FROM tg WHERE episode_id NOT IN (SELECT episode_id FROM x)), q AS (SELECT *, query_id % 50 = 6 AS h FROM qu),
a0 AS (SELECT query_id, 0 AS o, '0 sec to 60 sec' AS l FROM q WHERE h), p AS (SELECT query_id, episode_id, coalesce(nullif(t0, 0), nullif(time_ref, 0), 0) AS at_ FROM q WHERE NOT h AND jt IN ('categorical', 'time_and_quote')),
a1 AS (SELECT query_id, 0 AS o, floor("start")::BIGINT || ' sec to ' || ceil("end")::BIGINT || ' sec' AS l FROM p JOIN b USING (episode_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY (at_ BETWEEN "start" AND "end") DESC, CASE WHEN at_ BETWEEN "start" AND "end" THEN "start" ELSE abs("start" - at_) END, "start", ord) = 1),
a2 AS (SELECT query_id, 0 AS o, trunc(coalesce(time_ref, 0))::BIGINT || ' sec to ' || trunc(coalesce(time_ref, 0) + 30)::BIGINT || ' sec' AS l FROM q WHERE NOT h AND jt = 'trend'), c AS (SELECT query_id, episode_id, trunc(coalesce(time_ref, 0))::BIGINT AS a, trunc(coalesce(time_ref, 0) + 60)::BIGINT AS z, CASE WHEN query_id % 16 = 3 THEN 'SONG_' || lpad((query_id % 6)::VARCHAR, 2, '0') END AS who FROM q WHERE NOT h AND jt = 'speaker_id'),
a3 AS (SELECT query_id, 0 AS o, floor("start")::BIGINT || ' sec to ' || ceil("end")::BIGINT || ' sec' AS l FROM c JOIN tg ON tg.episode_id = c.episode_id AND speaker = who AND "start" < z AND "end" > a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY label IS NULL, "start", ord) = 1),
a4 AS (SELECT query_id, 0 AS o, a || ' sec to ' || (a + z) // 2 || ' sec' AS l FROM c WHERE query_id NOT IN (SELECT query_id FROM a3) UNION ALL SELECT query_id, 1, (a + z) // 2 || ' sec to ' || z || ' sec' FROM c WHERE query_id NOT IN (SELECT query_id FROM a3)), n AS (SELECT * FROM q WHERE NOT h AND coalesce(jt, '') NOT IN ('categorical', 'time_and_quote', 'trend', 'speaker_id')),
a5 AS (SELECT query_id, ord AS o, floor("start")::BIGINT || ' sec to ' || ceil("end")::BIGINT || ' sec' AS l FROM n JOIN tg USING (episode_id) WHERE list_contains(ids, seg_id)), u AS (SELECT query_id, episode_id, unnest(refs) AS at_, unnest(range(0, len(refs))) AS i FROM n WHERE ids IS NULL),
v AS (SELECT query_id, i, seg_id, "start", "end" FROM u JOIN tg USING (episode_id) QUALIFY row_number() OVER (PARTITION BY query_id, i ORDER BY (at_ BETWEEN "start" AND "end") DESC, CASE WHEN at_ BETWEEN "start" AND "end" THEN "start" ELSE abs("start" - at_) END, "start", ord) = 1), a6 AS (SELECT query_id, min(i) AS o, floor("start")::BIGINT || ' sec to ' || ceil("end")::BIGINT || ' sec' AS l FROM v GROUP BY query_id, seg_id, "start", "end"),
f AS (SELECT * FROM n WHERE ids IS NULL AND query_id NOT IN (SELECT query_id FROM a6)), a7 AS (SELECT query_id, ord AS o, floor("start")::BIGINT || ' sec to ' || ceil("end")::BIGINT || ' sec' AS l FROM f JOIN tg ON tg.episode_id = f.episode_id AND (len(pos) = 0 OR speaker = 'SONG_' || lpad(pos[1]::VARCHAR, 2, '0'))),
g AS (SELECT * FROM a0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3 UNION ALL SELECT * FROM a4 UNION ALL SELECT * FROM a5 UNION ALL SELECT * FROM a6 UNION ALL SELECT * FROM a7) SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY o) - 1)::INT AS set_no, l AS localize FROM g""")
def oracle_plans(spark, sf_dir):
    extracted = segments(spark, sf_dir).where("episode_id % 4 <> 0 and ord % 3 <> 1")
    speakers = spark.range(6).select(F.concat(F.lit("s"), "id", F.lit(".wav")).alias("clip"), F.concat(F.lit("SONG_"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("speaker"))
    return truth.oracle_plans(asked(spark, sf_dir), segments(spark, sf_dir), extracted, speakers)


@query("file_evidence", f"""WITH {SQL_TG}, {SQL_QU}, f AS (SELECT episode_id, 'f' || ord % 10 AS f, arg_max(speaker, ord) AS speaker FROM tg GROUP BY 1, 2), l AS (SELECT episode_id, speaker, arg_max(seg_id, ord) AS seg_id FROM tg GROUP BY 1, 2), b AS (SELECT query_id, episode_id, unnest(['f' || query_id % 12, 'f' || query_id % 7]) AS f, unnest([0, 1]) AS o FROM qu WHERE ids IS NULL),
r AS (SELECT query_id, list(seg_id ORDER BY o, seg_id) AS ids FROM b JOIN f USING (episode_id, f) JOIN l USING (episode_id, speaker) GROUP BY 1) SELECT query_id, array_to_string(coalesce(r.ids, qu.ids), ',') AS ids FROM qu LEFT JOIN r USING (query_id)""")
def file_evidence(spark, sf_dir):
    none = F.lit(None)
    block = lambda n: F.struct(none.cast("double").alias("time_ref"), none.cast("int").alias("position"), F.concat(F.lit("f"), (F.col("query_id") % n).cast("string")).alias("file_name"), none.cast("string").alias("name"))
    t = segments(spark, sf_dir).withColumn("file_name", F.concat(F.lit("f"), (F.col("ord") % 10).cast("string")))
    return truth.with_file_evidence(asked(spark, sf_dir).withColumn("blocks", F.array(block(12), block(7))), t).select("query_id", F.array_join("gt_seg_ids", ",").alias("ids"))


#: JSON records of queries: every step of the expected answer decides for some, a null at a step that is there too.
RECORD = """CASE o_orderkey % 11 WHEN 0 THEN concat('{"answer": "a', o_custkey, '", "judge_info": {"answer": "no"}}') WHEN 1 THEN '{"answer": null, "judge_info": {"answer": "no"}}' WHEN 2 THEN concat('{"judge_info": {"answer": "j', o_custkey, '", "primary": "H"}}')
    WHEN 3 THEN '{"judge_info": {"direction": "rising", "primary": "H"}}' WHEN 4 THEN '{"judge_info": {"primary": "S"}, "ground_truth": {"emo": "H"}}' WHEN 5 THEN '{"judge_info": {"type": "x"}, "ground_truth": {"direction": "none", "winner": "A"}}' WHEN 6 THEN concat('{"judge_info": {}, "ground_truth": {"answer": ', o_custkey, ', "winner": "A"}}')
    WHEN 7 THEN '{"judge_info": null, "ground_truth": {"winner": "B", "emo": "H"}}' WHEN 8 THEN '{"ground_truth": {"emo": "U"}, "domain_labels": {"primary": "H"}}' WHEN 9 THEN '{"ground_truth": {"mean": 1}, "domain_labels": {"primary": "Low"}}' ELSE '{"ground_truth": null}' END"""


@query("expected_answers", """SELECT o_orderkey AS id, CASE o_orderkey % 11 WHEN 0 THEN 'a' || o_custkey WHEN 2 THEN 'j' || o_custkey WHEN 3 THEN 'rising' WHEN 4 THEN 'S' WHEN 5 THEN 'none' WHEN 6 THEN o_custkey::VARCHAR WHEN 7 THEN 'B' WHEN 8 THEN 'U' WHEN 9 THEN 'Low' END AS expected FROM orders""")
def expected_answers(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), truth.expected_answer(F.expr(RECORD)).alias("expected"))


JUDGED = """CASE o_orderkey % 6 WHEN 0 THEN '{"type": "speaker_id", "dim": "Valence", "spk_val": {"B": 0.25, "A": 0.5}, "winner": "A"}' WHEN 1 THEN '{"type": "categorical", "primary": "H", "cf": 0.5, "votes": {"H": 2, "Z": 1}, "secondary": {"S": 1}}' WHEN 2 THEN concat('{"type": "trend", "direction": "', CASE WHEN o_orderkey % 4 = 0 THEN 'UP' ELSE 'rising' END, '", "half1": 0.25, "half2": 0.5}')
    WHEN 3 THEN concat('{"type": "time_and_quote", "emo": "s", "t0": ', o_custkey, ', "t1": ', o_custkey + 9, ', "seg_text": "', o_orderpriority, '"}') WHEN 4 THEN '{"scores_a": {"Clarity": 2.5}}' ELSE concat('{"type": "other", "b": ', o_custkey, ', "a": "x", "c": null}') END"""
GIVEN = """CASE WHEN o_orderkey % 6 = 4 THEN concat('{"mean_a": 3.25, "mean_b": ', CASE WHEN o_orderkey % 5 = 4 THEN 'null' ELSE concat(o_orderkey % 5, '.5') END, ', "winner": "A", "delta": 0.125}') ELSE '{}' END"""


@query("truth_summaries", """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'GT: Speaker B Valence=0.250  Speaker A Valence=0.500  →  winner = Speaker A' WHEN 1 THEN 'GT primary emotion: Happy (H), confidence=0.5' || chr(10) || '  annotator votes: {''Happy'': 2, ''Z'': 1}' || chr(10) || '  secondary (minority): {''Sad'': 1}'
    WHEN 2 THEN 'GT trend: rising (' || chr(39) || CASE WHEN o_orderkey % 4 = 0 THEN 'UP' ELSE 'rising' END || chr(39) || ')  |  first-half mean=0.250, second-half mean=0.500' WHEN 3 THEN 'GT emotion: Sad (s)  at [' || o_custkey || 's – ' || o_custkey + 9 || 's]' || chr(10) || '  reference text: "' || o_orderpriority || '"'
    WHEN 4 THEN 'GT: Song A mean=3.25 (mid)  Song B mean=' || CASE WHEN o_orderkey % 5 = 4 THEN 'None' ELSE o_orderkey % 5 || '.5' END || ' (' || ['low', 'low', 'below-avg', 'mid', '?'][1 + o_orderkey % 5] || ')  →  winner = Song A  (delta=0.125)' || chr(10) || '  Song A dims: Clarity=2.5' ELSE 'GT (other): b=' || o_custkey || ', a=x' END AS summary FROM orders""")
def truth_summaries(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), truth.truth_summary(F.expr(JUDGED), F.expr(GIVEN)).alias("summary"))


@query("label_lines", f"""WITH {SQL_QU} SELECT query_id, CASE query_id % 8 WHEN 4 THEN 'A = song/speaker around ' || printf('%.1f', t + 1000) || 's, B = song/speaker around ' || printf('%.1f', t + 50000) || 's' WHEN 5 THEN 'A = song #3, B = song #5' WHEN 7 THEN 'A = song #90' ELSE '' END AS line FROM qu""")
def label_lines(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", truth.label_line(F.col("blocks")).alias("line"))


@query("set_guides", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '' ELSE 'Evidence set time anchors:' || chr(10) || 'Set 1: ' || o_custkey || ' sec (first mentioned)' || CASE WHEN o_orderkey % 3 = 2 THEN chr(10) || 'Set 3: x (third mentioned)' || chr(10) || 'Set 4: y (4th)' ELSE chr(10) || 'Set 2: x (second mentioned)' END END AS guide FROM orders""")
def set_guides(spark, sf_dir):
    k, first = F.col("o_orderkey") % 3, F.concat(F.col("o_custkey").cast("string"), F.lit(" sec"))
    sets = F.when(k == 0, F.array(first)).when(k == 1, F.array(first, F.lit("x"))).otherwise(F.array(first, F.lit(""), F.lit("x"), F.lit("y")))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), truth.set_guide(sets).alias("guide"))


@query("truth_side", f"""WITH {SQL_TG}, {SQL_QU}, w AS (SELECT query_id, episode_id, 'window' AS label, t AS lo, t + 90000 AS hi FROM qu WHERE query_id % 3 = 0 UNION ALL SELECT query_id, episode_id, 'center', greatest(0, time_ref - 30), time_ref + 30 FROM qu WHERE query_id % 3 <> 0 AND time_ref IS NOT NULL
    UNION ALL SELECT query_id, episode_id, 'block ' || i, greatest(0, r - 30), r + 30 FROM (SELECT query_id, episode_id, unnest(refs) AS r, unnest(range(0, len(refs))) AS i FROM qu)),
m AS (SELECT query_id, w.label, lo, hi, "start" AS s, '[' || printf('%.1f', "start") || '-' || printf('%.1f', "end") || '] ' || speaker || ': ' || text AS line FROM w JOIN tg ON tg.episode_id = w.episode_id AND "end" > lo AND "start" < hi
    UNION ALL SELECT query_id, 'quote', NULL, NULL, "start", '[' || printf('%.1f', "start") || '-' || printf('%.1f', "end") || '] ' || speaker || ': ' || text FROM qu JOIN tg USING (episode_id) WHERE query_id % 10 = 1 AND contains(lower(text), '"k": 1')),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY s, line) AS r, count(*) OVER (PARTITION BY query_id, label) AS n FROM m) SELECT query_id, label, max(n) AS n, string_agg(line, chr(10) ORDER BY r) FILTER (r <= 3) || CASE WHEN max(n) > 3 THEN chr(10) || '... and ' || (max(n) - 3) || ' more' ELSE '' END AS lines FROM r GROUP BY 1, 2""")
def truth_side(spark, sf_dir):
    k = F.col("query_id")
    q = asked(spark, sf_dir).withColumn("_t", (k * 7919 % 2592000).cast("double")).withColumn("w0", F.when(k % 3 == 0, F.col("_t"))).withColumn("w1", F.when(k % 3 == 0, F.col("_t") + 90000)).withColumn("quote", F.when(k % 10 == 1, ' "K": 1 '))
    return truth.truth_side(q, segments(spark, sf_dir)).select("query_id", "label", "n", "lines")


@query("window_truth", f"""WITH {SQL_TG}, {SQL_QU}, w AS (SELECT query_id, episode_id, t AS lo, t + 100000 AS hi FROM qu), m AS (SELECT query_id, string_agg(seg_id, ',' ORDER BY ord) AS ids FROM w JOIN tg USING (episode_id) WHERE "end" > lo AND "start" < hi GROUP BY 1)
SELECT query_id, coalesce(ids, '') AS ids, episode_id IN (SELECT user_id FROM events WHERE event_type = 'error') AS traced FROM w LEFT JOIN m USING (query_id)""")
def window_truth(spark, sf_dir):
    t = (F.col("query_id") * 7919 % 2592000).cast("double")
    w = asked(spark, sf_dir).select("query_id", "episode_id", t.alias("lo"), (t + 100000).alias("hi"))
    traced = read(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("episode_id"))
    return truth.in_window(w, segments(spark, sf_dir), traced).select("query_id", F.array_join("seg_ids", ",").alias("ids"), "traced")


@query("trace_summaries", f"""WITH {SQL_EV}, {SQL_QU}, m AS (SELECT query_id, speaker AS dim, ord, label_score AS v FROM qu JOIN ev USING (episode_id) WHERE "end" > t AND "start" < t + 400000), r AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY query_id, dim) AS c FROM m WINDOW w AS (PARTITION BY query_id, dim ORDER BY ord)),
h AS (SELECT query_id, dim, avg(v) AS mean, min(v) AS least, max(v) AS most, avg(v) FILTER (n <= c // 2) AS h1, avg(v) FILTER (n > c // 2) AS h2 FROM r GROUP BY ALL) SELECT query_id, dim, round(mean, 6) AS mean, least, most, CASE WHEN h2 - h1 > 0.05 THEN 'rising' WHEN h2 - h1 < -0.05 THEN 'falling' ELSE 'stable' END AS trend FROM h""")
def trace_summaries(spark, sf_dir):
    t = (F.col("query_id") * 7919 % 2592000).cast("double")
    w = asked(spark, sf_dir).select("query_id", "episode_id", F.lit("w").alias("label"), t.alias("lo"), (t + 400000).alias("hi"))
    traces = adapters.event_segments(spark, sf_dir).select("episode_id", F.col("speaker").alias("dim"), "ord", "start", "end", F.col("label_score").alias("mean"))
    return truth.trace_summaries(w, traces).select("query_id", "dim", F.round("mean", 6).alias("mean"), "least", "most", "trend")


@query("speaker_segments", f"WITH {SQL_TG} SELECT seg_id FROM tg WHERE speaker = 'SONG_02'")
def speaker_segments(spark, sf_dir):
    return truth.spoken_by(segments(spark, sf_dir), "SONG_02").select("seg_id")


def predicted(spark, sf_dir) -> DataFrame:
    """Predictions with nested evidence: two sets, a time that is no pair among them."""
    k = F.col("o_orderkey")
    t = (k * 7919 % 2592000).cast("double")
    item = lambda *time: F.struct(F.array(*time).cast("array<double>").alias("time"))
    sets = F.array(F.array(item(t, t + 100000), item(t)), F.when(k % 2 == 0, F.array(item(t + 300000, t + 310000))).otherwise(F.array().cast("array<struct<time:array<double>>>")))
    return read(spark, sf_dir, "orders").select(k.alias("query_id"), (F.col("o_custkey") % 150).alias("episode_id"), sets.alias("evidence_sets"))


SQL_WI = "wi AS (SELECT o_orderkey AS query_id, o_custkey % 150 AS episode_id, (o_orderkey * 7919 % 2592000)::DOUBLE AS lo, (o_orderkey * 7919 % 2592000)::DOUBLE + 100000 AS hi FROM orders UNION ALL SELECT o_orderkey, o_custkey % 150, (o_orderkey * 7919 % 2592000)::DOUBLE + 300000, (o_orderkey * 7919 % 2592000)::DOUBLE + 310000 FROM orders WHERE o_orderkey % 2 = 0)"


@query("evidence_windows", f"WITH {SQL_WI} SELECT query_id, lo, hi FROM wi")
def evidence_windows(spark, sf_dir):
    return truth.evidence_windows(predicted(spark, sf_dir))


@query("evidence_in_truth", f"""WITH {SQL_TG}, {SQL_WI} SELECT DISTINCT query_id, seg_id FROM wi JOIN tg USING (episode_id) WHERE "end" > lo AND "start" < hi""")
def evidence_in_truth(spark, sf_dir):
    return truth.evidence_in_truth(predicted(spark, sf_dir), segments(spark, sf_dir)).select("query_id", "seg_id")


@query("first_occurrences", """WITH u AS (SELECT c_custkey AS k, 0 AS p, 'c' || c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey, 1, 's' || s_nationkey FROM supplier UNION ALL SELECT p_partkey, 2, 'p' || p_size FROM part) SELECT k, arg_min(v, p) AS v FROM u GROUP BY 1""")
def first_occurrences(spark, sf_dir):
    t = lambda name, key, mark, value: read(spark, sf_dir, name).select(F.col(key).alias("k"), F.concat(F.lit(mark), value).alias("v"))
    return truth.first_of([t("customer", "c_custkey", "c", "c_mktsegment").where("k % 2 = 0"), t("supplier", "s_suppkey", "s", "s_nationkey"), t("part", "p_partkey", "p", "p_size")], ["k"])


#: What the stand-in judge says by arithmetic: a prediction names the expected word for two thirds, a rationale's truth for a half.
SCORES_SQL = """js AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE (o_orderkey % 3 <> 0)::INT END AS answer, (o_orderkey % 2 = 0)::INT AS factual, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE (o_orderkey % 4 < 2)::INT END AS faithful FROM orders)"""


def judge_prompts(spark, sf_dir) -> DataFrame:
    """Prompts of all kinds for predictions of which some name what is expected."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders")
    queries = o.where("o_orderkey % 6 <> 5").select(k.alias("query_id"), F.lit("which?").alias("query"), F.when(k % 7 != 0, F.concat(F.lit("word"), (k % 13).cast("string"))).alias("expected"), F.lit("fact").alias("summary"))
    said = F.concat_ws(" ", F.when(k % 3 != 0, F.concat(F.lit("it is WORD"), (k % 13).cast("string"))).otherwise("nothing"), F.when(k % 2 == 0, "a fact"), F.when(k % 4 < 2, "as heard"))
    own = F.when((k % 7 != 0) & (k % 6 == 5), F.concat(F.lit("word"), (k % 13).cast("string")))
    predictions = o.select(k.alias("query_id"), said.alias("prediction"), F.lit("so").alias("rationale"), F.lit("heard").alias("block"), own.alias("expected"), F.lit("fact").alias("summary"))
    return truth.judge_table(predictions, queries, F.col("query_id") % 5 == 0)


def judged(spark, sf_dir) -> DataFrame:
    """Prompts of all kinds in one batch, a judge's replies, and scores."""
    return truth.judged_scores(experts.batched(judge_prompts(spark, sf_dir), experts.stand_in_judge))


@query("deferred_scores", f"WITH {SCORES_SQL} SELECT *, factual * faithful AS rationale FROM js")
def deferred_scores(spark, sf_dir):
    """The same scores by way of jobs that are submitted, worked on and collected; half of the prompts are planned later."""
    folder = f"{shared_folder(spark).rstrip('/')}/deferred-{uuid.uuid4().hex}"
    prompts = judge_prompts(spark, sf_dir)
    jobs = deferred.Deferred(spark, folder, prompts.schema)
    service = deferred.Tables(spark, f"{folder}/service", experts.stand_in_judge)
    for some in (prompts.where("query_id % 2 = 0"), prompts):
        jobs.plan(some)
        jobs.run(service)
    service.work()
    jobs.run(service)
    return truth.judged_scores(jobs.replies())


@query("judge_scores", f"WITH {SCORES_SQL} SELECT *, factual * faithful AS rationale FROM js")
def judge_scores(spark, sf_dir):
    return judged(spark, sf_dir)


@query("score_all", f"""WITH {SCORES_SQL}, {SQL_TG}, {SQL_QU}, {RESOLVED_SQL}, {SQL_WI}, hr AS (SELECT query_id, avg(CASE WHEN EXISTS (SELECT 1 FROM wi WHERE wi.query_id = ge.query_id AND tg."end" > wi.lo AND tg."start" < wi.hi) THEN 1.0 ELSE 0.0 END) AS h FROM ge JOIN tg USING (seg_id) GROUP BY 1)
SELECT query_id, answer, factual * faithful AS rationale, round(coalesce(h, 0), 6) AS retrieval_hit_rate, round(CASE WHEN query_id % 2 = 0 THEN (coalesce(h, 0) + 2) / 3 ELSE coalesce(h, 0) END, 6) AS plan_hit_rate FROM js LEFT JOIN hr USING (query_id)""")
def score_all(spark, sf_dir):
    q = asked(spark, sf_dir)
    evidence = truth.resolved_evidence(q, segments(spark, sf_dir)).select("query_id", "seg_id", "start", "end")
    retrieval = stored(metrics.hit_rate(evidence, truth.evidence_windows(predicted(spark, sf_dir))), "retrieval")  # read twice
    kinds = q.select("query_id", F.when(F.col("query_id") % 2 == 0, "state").otherwise("position").alias("query_type"))
    tools = q.select("query_id", F.array(F.lit("audio_emb"), F.lit("keyword")).alias("active"))
    plans = metrics.plan_hit_rate(retrieval.withColumnRenamed("hit_rate", "covered"), tools, kinds)
    out = truth.score_all(judged(spark, sf_dir), retrieval, plans)
    return out.select("query_id", "answer", "rationale", F.round("retrieval_hit_rate", 6).alias("retrieval_hit_rate"), F.round("plan_hit_rate", 6).alias("plan_hit_rate"))


# -- agents


def _planner():
    """A stand-in: the plan that the question spells out, "from A to B minutes about WORD"."""
    import json
    import re

    def plan(asked: list[str]) -> list[str]:
        out = []
        for p in asked:
            m = re.search(r"from (\d+) to (\d+) minutes about (\w+)", p)
            sets = [{"localize": f"{m[1]} to {m[2]} minutes", "time": True, "keyword": m[3]}, {"localize": "somewhere"}] if m else []
            out.append(f"```json\n{json.dumps({'sets': sets})}\n```" if m else "no plan")
        return out

    return plan


def _counting():
    """A stand-in: how many lines of evidence there are."""
    import re

    return lambda asked: [f"Answer: {len(re.findall(r'(?m)^.[0-9.]+-[0-9.]+. ', p))}\nRationale: counted" for p in asked]


def questions(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    said = F.concat(F.lit("what happens from "), k % 40000, F.lit(" to "), k % 40000 + 1500, F.lit(" minutes about "), F.when(k % 3 == 0, "k").otherwise("zz"))
    return read(spark, sf_dir, "orders").select(k.alias("query_id"), (F.col("o_custkey") % 150).alias("episode_id"), F.when(k % 10 != 9, said).otherwise("tell me").alias("query"))


@query("agent_answers", f"""WITH {SQL_EV}, q AS (SELECT o_orderkey AS query_id, o_custkey % 150 AS episode_id, o_orderkey % 40000 * 60 AS lo, (o_orderkey % 40000 + 1500) * 60 AS hi FROM orders WHERE o_orderkey % 10 <> 9), n AS (SELECT query_id, count(*) AS n FROM q JOIN ev USING (episode_id) WHERE "end" > lo AND "start" < hi GROUP BY 1)
SELECT o_orderkey AS query_id, 'Answer: ' || least(4, coalesce(n, 0)) AS prediction, 'counted' AS rationale, least(4, coalesce(n, 0)) AS n_evidence FROM orders LEFT JOIN n ON n.query_id = o_orderkey""")
def agent_answers(spark, sf_dir):
    """Plans, retrieval and answers of all questions, by stand-ins."""
    e, q = adapters.event_segments(spark, sf_dir), questions(spark, sf_dir)
    plans = agents.planned(q, _planner, experts.TASKS["emotion"], agents.VARIANTS["text"])
    return agents.answered(q, plans, e, _counting, experts.TASKS["emotion"], top_k=4)


@query("oracle_answers", f"""WITH {SQL_TG}, {SQL_QU}, t AS (SELECT query_id, episode_id, trunc(coalesce(time_ref, 0))::BIGINT AS lo, trunc(coalesce(time_ref, 0) + 30)::BIGINT AS hi FROM qu WHERE jt = 'trend' AND query_id % 50 <> 6), n AS (SELECT query_id, count(*) AS n FROM t JOIN tg USING (episode_id) WHERE "end" > lo AND "start" < hi GROUP BY 1)
SELECT query_id, 'Answer: ' || coalesce(n, 0) AS prediction, coalesce(n, 0) AS n_evidence FROM t LEFT JOIN n USING (query_id)""")
def oracle_answers(spark, sf_dir):
    """Questions about changes, answered with plans made from the truth."""
    q = asked(spark, sf_dir).where("judge_type = 'trend' and task <> 'health'").withColumn("query", F.lit("how?"))
    speakers = spark.createDataFrame([], "clip string, speaker string")
    s = segments(spark, sf_dir)
    return agents.oracle_answered(q, s, s, speakers, _counting, experts.TASKS["emotion"]).select("query_id", "prediction", "n_evidence")


@query("agent_scores", f"""WITH {SCORES_SQL} SELECT query_id, answer, CASE WHEN query_id % 4 < 2 THEN 1 ELSE 0 END AS faithful FROM js""")
def agent_scores(spark, sf_dir):
    """Predictions judged for a task that hides speakers of a type."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders")
    q = o.select(k.alias("query_id"), F.when(k % 2 == 0, "locate_hard").otherwise("state").alias("query_type"), F.lit("which?").alias("query"), F.when(k % 7 != 0, F.concat(F.lit("word"), (k % 13).cast("string"))).alias("expected"), F.lit("fact").alias("summary"))
    said = F.concat_ws(" ", F.when(k % 3 != 0, F.concat(F.lit("it is WORD"), (k % 13).cast("string"))).otherwise("nothing"), F.when(k % 4 < 2, "heard"))
    p = o.select(k.alias("query_id"), said.alias("prediction"), F.lit("so").alias("rationale"), F.lit("heard").alias("block"))
    return agents.judged(p, q, experts.stand_in_judge, experts.TASKS["emotion"]).select("query_id", "answer", "faithful")
