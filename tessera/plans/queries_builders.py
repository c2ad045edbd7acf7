"""Named queries of preparation: candidates, assignment, windows, clips and query texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import preparation
from tessera.functions.numbers import rounded
from tessera.operators import builders, events, sampling
from tessera.operators.nearest import nearest_points
from tessera.operators.ordering import in_order, placed
from tessera.plans import adapters
from tessera.plans.adapters import SQL_CV, SQL_EV, read
from tessera.plans.queries import draw_sql, query

#: Events as labelled events: n by time, speakers 0 to 3 or a name, emotions by event type, confidence and levels from ids.
SQL_ST = f"""{SQL_EV}, st AS (SELECT episode_id, idx AS n, "start" AS t0, "start" + 5 + ord % 7 AS t1, CASE WHEN ord % 9 = 0 THEN 'x' ELSE (ord % 4)::VARCHAR END AS spk, CASE speaker WHEN 'click' THEN 'H' WHEN 'view' THEN 'N' WHEN 'purchase' THEN 'A' WHEN 'error' THEN 'S' ELSE 'X' END AS emo,
    (ord * 37 % 100) / 100.0::DOUBLE AS cf, (ord * 13 % 100) / 100.0::DOUBLE AS act, (ord * 29 % 100) / 100.0::DOUBLE AS val, (ord * 53 % 100) / 100.0::DOUBLE AS dom, ord FROM ev)"""


def labelled(spark, sf_dir) -> DataFrame:
    e = adapters.event_segments(spark, sf_dir)
    part = lambda k: (F.col("ord") * k % 100) / F.lit(100.0)
    emo = F.when(F.col("speaker") == "click", "H").when(F.col("speaker") == "view", "N").when(F.col("speaker") == "purchase", "A").when(F.col("speaker") == "error", "S").otherwise("X")
    spk = F.when(F.col("ord") % 9 == 0, "x").otherwise((F.col("ord") % 4).cast("string"))
    n = F.row_number().over(Window.partitionBy("episode_id").orderBy("start", "ord")) - 1
    return e.select("episode_id", n.cast("long").alias("n"), F.col("start").alias("t0"), (F.col("start") + 5 + F.col("ord") % 7).alias("t1"), spk.alias("spk"), emo.alias("emo"), part(37).alias("cf"), part(13).alias("act"), part(29).alias("val"), part(53).alias("dom"), "ord")


#: All events as candidates of three shapes.
SQL_CA = """ca AS (SELECT event_id AS cand_id, user_id AS episode_id, CASE event_id % 3 WHEN 0 THEN 'st_event' WHEN 1 THEN 'ct_trend' ELSE 'multi_spk_window' END AS shape, CASE WHEN event_id % 3 = 0 THEN ['N', 'H', 'S', 'X'][1 + event_id % 4] END AS emo,
    CASE WHEN event_id % 3 = 0 THEN value / 100 END AS cf, CASE WHEN event_id % 3 = 1 THEN (event_id % 41 - 20) / 10.0::DOUBLE END AS delta, CASE WHEN event_id % 3 = 1 THEN CASE WHEN event_id % 12 = 1 THEN 'none' ELSE 'rising' END END AS direction, CASE WHEN event_id % 3 = 2 THEN value END AS val_diff FROM events)"""


def candidates(spark, sf_dir) -> DataFrame:
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    emo = F.element_at(F.array(*map(F.lit, "NHSX")), (k % 4 + 1).cast("int"))
    of = lambda n, c: F.when(k % 3 == n, c)
    return e.select(
        k.alias("cand_id"), F.col("user_id").alias("episode_id"), F.when(k % 3 == 0, "st_event").when(k % 3 == 1, "ct_trend").otherwise("multi_spk_window").alias("shape"), of(0, emo).alias("emo"), of(0, F.col("value") / 100).alias("cf"),
        of(1, (k % 41 - 20) / F.lit(10.0)).alias("delta"), of(1, F.when(k % 12 == 1, "none").otherwise("rising")).alias("direction"), of(2, F.col("value")).alias("val_diff"),
    )


def _strata(pool: str, cap: str) -> str:
    """SQL of a stratified pick of ``cap`` from each episode of a pool (cand_id, episode_id, s)."""
    return f"""SELECT cand_id, episode_id FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, b ORDER BY {draw_sql('cand_id')}, cand_id) AS p FROM (SELECT *, CASE WHEN n <= {cap} THEN r ELSE floor(r * {cap} / n::DOUBLE)::BIGINT END AS b
        FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY s DESC, cand_id) - 1 AS r, count(*) OVER (PARTITION BY episode_id) AS n FROM ({pool})) WHERE {cap} > 0)) WHERE p = 1"""


@query("assigned_candidates", f"""WITH {SQL_CA}, z AS (SELECT *, coalesce(CASE shape WHEN 'st_event' THEN cf WHEN 'ct_trend' THEN abs(delta) ELSE val_diff END, 0) AS s FROM ca), f AS ({_strata("SELECT * FROM z WHERE direction = 'none'", '1')}),
r AS (SELECT z.*, 3 - (z.episode_id IN (SELECT episode_id FROM f))::INT AS cap FROM z WHERE shape = 'ct_trend' AND direction <> 'none')
SELECT 'comparison' AS query_type, cand_id FROM ({_strata("SELECT * FROM z WHERE shape = 'multi_spk_window'", '3')}) UNION ALL SELECT 'change', cand_id FROM f UNION ALL SELECT 'change', cand_id FROM ({_strata('SELECT * FROM r', 'cap')})
UNION ALL SELECT 'state', cand_id FROM ({_strata("SELECT * FROM z WHERE shape = 'st_event'", '3')}) UNION ALL SELECT 'locate', cand_id FROM ({_strata("SELECT * FROM z WHERE shape = 'st_event' AND emo NOT IN ('N', 'X')", '3')})""")
def assigned_candidates(spark, sf_dir):
    return builders.assigned(candidates(spark, sf_dir), 3).select("query_type", "cand_id")


@query("spoken_events", f"""WITH {SQL_ST}, l AS (SELECT * FROM st WHERE cf >= 0.5 AND regexp_full_match(spk, '[0-9]+')), s AS (SELECT *, (ord % 4)::VARCHAR AS who, CASE WHEN ord % 6 <> 0 THEN text END AS said FROM ev)
SELECT l.episode_id, l.n, count(*) AS n_before FROM l JOIN s ON s.episode_id = l.episode_id AND s."end" > l.t0 - 90000 AND s."start" < l.t0 AND s.who = l.spk AND s.said <> '' GROUP BY ALL HAVING count(*) >= 2""")
def spoken_events(spark, sf_dir):
    segments = adapters.event_segments(spark, sf_dir).select("episode_id", "start", "end", (F.col("ord") % 4).cast("string").alias("speaker"), F.when(F.col("ord") % 6 != 0, F.col("text")).alias("text"))
    return builders.spoken_events(labelled(spark, sf_dir), segments, 0.5, 90000.0, 2, bucket=90000.0).select("episode_id", "n", "n_before")


SQL_BOUNDS = "bd AS (SELECT user_id AS episode_id, 40000.0::DOUBLE AS conv_start, 900000.0::DOUBLE AS conv_end FROM events WHERE user_id % 3 <> 0 GROUP BY 1)"


@query("grown_windows", f"""WITH {SQL_ST}, {SQL_BOUNDS}, w AS (SELECT a.episode_id, a.n, a.t0, a.t1, conv_start, conv_end, (SELECT max(b.t1) FROM st b WHERE b.episode_id = a.episode_id AND b.spk = a.spk AND b.emo = a.emo AND b.n <> a.n AND b.cf >= 0.5 AND b.t1 <= a.t0) AS p, (SELECT min(b.t0) FROM st b WHERE b.episode_id = a.episode_id AND b.spk = a.spk AND b.emo = a.emo AND b.n <> a.n AND b.cf >= 0.5 AND b.t0 >= a.t1) AS q
    FROM st a LEFT JOIN bd ON bd.episode_id = a.episode_id)
SELECT episode_id, n, round(greatest(coalesce(p, CASE WHEN conv_start < t0 THEN conv_start ELSE greatest(0, t0 - 150) END), t0 - 150), 6) AS win_t0, round(least(coalesce(q, CASE WHEN conv_end > t1 THEN conv_end ELSE t1 + 150 END), t1 + 150), 6) AS win_t1 FROM w""")
def grown_windows(spark, sf_dir):
    bounds = read(spark, sf_dir, "events").where("user_id % 3 <> 0").select(F.col("user_id").alias("episode_id"), F.lit(40000.0).alias("conv_start"), F.lit(900000.0).alias("conv_end")).distinct()
    return builders.grown_windows(labelled(spark, sf_dir), bounds).select("episode_id", "n", F.round("win_t0", 6).alias("win_t0"), F.round("win_t1", 6).alias("win_t1"))


@query("hard_clusters", f"""WITH {SQL_ST}, s AS (SELECT *, row_number() OVER (PARTITION BY episode_id, spk, emo ORDER BY t0, n) AS i FROM st WHERE cf >= 0.5 AND emo NOT IN ('N', 'X')), g AS (SELECT a.episode_id, a.spk, a.emo, a.i, a.t0, coalesce((SELECT min(b.i) FROM s b WHERE b.episode_id = a.episode_id AND b.spk = a.spk AND b.emo = a.emo AND b.i > a.i AND b.t1 - a.t0 > 400000),
    (SELECT max(b.i) + 1 FROM s b WHERE b.episode_id = a.episode_id AND b.spk = a.spk AND b.emo = a.emo)) AS j FROM s a), f AS (SELECT * FROM g WHERE j - i >= 3 QUALIFY row_number() OVER (PARTITION BY episode_id, spk, emo ORDER BY i) = 1),
m AS (SELECT s.*, f.t0 AS b FROM s JOIN f ON s.episode_id = f.episode_id AND s.spk = f.spk AND s.emo = f.emo AND s.i >= f.i AND s.i < f.j), d AS (SELECT *, round((act - avg(act) OVER w) ** 2 + (val - avg(val) OVER w) ** 2 + (dom - avg(dom) OVER w) ** 2, 9) AS d, count(*) OVER w AS c, arg_max(t1, i) OVER w AS z FROM m WINDOW w AS (PARTITION BY episode_id, spk, emo))
SELECT episode_id, spk, emo, round(greatest(0, b - 30), 6) AS t0, round(z + 30, 6) AS t1, n AS target_n, c AS n_events FROM d QUALIFY row_number() OVER (PARTITION BY episode_id, spk, emo ORDER BY d DESC, i) = 1""")
def hard_clusters(spark, sf_dir):
    return builders.hard_clusters(labelled(spark, sf_dir), span=400000.0).select("episode_id", "spk", "emo", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"), "target_n", "n_events")


@query("speaker_clips", f"""WITH {SQL_EV}, c AS (SELECT *, label_score AS snr FROM ev WHERE coalesce(CASE WHEN ord % 10 < 8 THEN 1 + ord % 2 END, 2) = 1 AND speaker <> 'error' AND label_score >= 20 AND 3 + ord % 9 <= 8),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY speaker, episode_id ORDER BY snr DESC, seg_id) = 1) SELECT speaker, seg_id, row_number() OVER (PARTITION BY speaker ORDER BY snr DESC, seg_id) AS rank FROM b QUALIFY rank <= 5""")
def speaker_clips(spark, sf_dir):
    """The five best clean clips of each speaker, one of an episode."""
    e = adapters.event_segments(spark, sf_dir).withColumn("snr", F.col("label_score")).withColumn("num_speakers", F.when(F.col("ord") % 10 < 8, 1 + F.col("ord") % 2)).withColumn("sound", F.when(F.col("speaker") != "error", "Speech"))
    e = e.withColumn("end", F.lit(3.0) + F.col("ord") % 9).withColumn("start", F.lit(0.0)).where(builders.clean_speech())
    return builders.best_clips(e, ["speaker", "episode_id"], ["speaker"], "snr", "seg_id", 5).select("speaker", "seg_id", F.col("rank").cast("long").alias("rank"))


@query("emotion_clips", f"""WITH {SQL_ST}, v AS (SELECT episode_id, n, ['N', 'H', 'S', 'A'][1 + (n + k * k) % 4] AS emo FROM st, range(0, 4) r(k) WHERE ord % 3 <> 1 AND k < ord % 5), c AS (SELECT episode_id, n, count(*) AS t FROM v GROUP BY ALL),
l AS (SELECT st.episode_id, st.n, st.spk, st.emo, round(coalesce((SELECT count(*) FROM v WHERE v.episode_id = st.episode_id AND v.n = st.n AND v.emo = st.emo), 0) / t::DOUBLE, 3) AS share FROM st JOIN c USING (episode_id, n)),
b AS (SELECT episode_id, spk, t1 - t0 AS length, n AS clip FROM st WHERE spk <> 'x' QUALIFY row_number() OVER (PARTITION BY episode_id, spk ORDER BY cf DESC, n) = 1)
SELECT emo, episode_id, n, clip, row_number() OVER (PARTITION BY emo ORDER BY share DESC, length DESC, episode_id, n) AS rank FROM l JOIN b USING (episode_id, spk) WHERE share >= 0.25 QUALIFY rank <= 20""")
def emotion_clips(spark, sf_dir):
    """The twenty surest labels of each emotion with the best clip of their speaker in the episode."""
    st = labelled(spark, sf_dir)
    k = F.explode(F.array(*map(F.lit, range(4)))).alias("k")
    rows = st.where("ord % 3 <> 1").select("episode_id", "n", "ord", "emo", k).where(F.col("k") < F.col("ord") % 5).withColumn("voted", F.element_at(F.array(*map(F.lit, "NHSA")), ((F.col("n") + F.col("k") * F.col("k")) % 4 + 1).cast("int")))
    votes = rows.groupBy("episode_id", "n").agg(F.round(F.avg((F.col("voted") == F.col("emo")).cast("double")), 3).alias("share"))
    best = sampling.first_n(st.where("spk <> 'x'"), ["episode_id", "spk"], [F.col("cf").desc(), "n"], 1).select("episode_id", "spk", (F.col("t1") - F.col("t0")).alias("length"), F.col("n").alias("clip"))
    joined = st.select("episode_id", "n", "spk", "emo").join(votes, ["episode_id", "n"]).join(best, ["episode_id", "spk"]).where("share >= 0.25")
    rank = F.row_number().over(Window.partitionBy("emo").orderBy(F.col("share").desc(), F.col("length").desc(), "episode_id", "n"))
    return joined.withColumn("rank", rank.cast("long")).where("rank <= 20").select("emo", "episode_id", "n", "clip", "rank")


@query("speaker_levels", f"""WITH {SQL_ST} SELECT episode_id, spk, round(avg(act), 4) AS act, round(avg(val), 4) AS val, round(avg(dom), 4) AS dom FROM st WHERE spk <> 'x' AND ord % 5 <> 0 GROUP BY ALL HAVING count(*) >= 5""")
def speaker_levels(spark, sf_dir):
    return builders.speaker_levels(labelled(spark, sf_dir).where("spk <> 'x' and ord % 5 <> 0"), ["episode_id", "spk"], ["act", "val", "dom"])


#: Events as rows to write emotion queries from.
SQL_MK = """mk AS (SELECT event_id AS id, ['state', 'change', 'comparison', 'locate', 'locate_hard'][1 + event_id % 5] AS t, event_id % 3000 + 0.5 AS t0, event_id % 3000 + 31.25 AS t1, event_type AS topic, ['H', 'S', 'A'][1 + event_id % 3] AS emo, ['Valence', 'Arousal'][1 + event_id % 2] AS dim,
    ['rising', 'falling', 'none'][1 + event_id % 3] AS direction, value AS v, 20 + event_id % 100 AS pl FROM events)"""


@query("emotion_queries", f"""WITH {SQL_MK}, h AS (SELECT *, round_even((CASE WHEN t = 'locate_hard' THEN t0 + 600 ELSE t0 END) / 30, 0)::BIGINT AS h FROM mk), w AS (SELECT *, 'around ' || h // 2 || CASE WHEN h % 2 = 1 THEN ' and a half' ELSE '' END || CASE WHEN h = 2 THEN ' minute' ELSE ' minutes' END AS phr FROM h)
SELECT id, CASE t WHEN 'state' THEN 'Speaker: [audio example]. A' || substr(phr, 2) || ', this speaker was talking about ' || topic || ' and mentioned "so ' || topic || '". What emotion(s) did this speaker show?'
    WHEN 'change' THEN 'Speaker: [audio example]. From ' || trunc(t0)::BIGINT || ' to ' || trunc(t1)::BIGINT || ' seconds, how did this speaker''s ' || lower(dim) || ' change while discussing ' || topic || '?'
    WHEN 'comparison' THEN 'Speaker A: [A''s audio example].' || chr(10) || 'Speaker B: [B''s audio example].' || chr(10) || 'From ' || greatest(0, trunc(t0)::BIGINT - pl) || ' to ' || (trunc(t1)::BIGINT + 240 - pl) || ' seconds discussing ' || topic || ', which speaker had higher ' || lower(dim) || ' — Speaker A or Speaker B?'
    WHEN 'locate' THEN 'Speaker: [speaker example].' || chr(10) || 'Emotion: [emotion example].' || chr(10) || 'Between ' || trunc(CASE WHEN id % 2 = 0 THEN t0 - 0.25 ELSE t0 END)::BIGINT || ' and ' || trunc(CASE WHEN id % 2 = 0 THEN t1 + 90 ELSE t1 END)::BIGINT || ' seconds, when did this speaker show the same emotion as in the audio clip, and what were they saying?'
    ELSE 'Emotion: [audio example].' || chr(10) || 'Between ' || trunc(t0)::BIGINT || ' and ' || trunc(t1)::BIGINT || ' seconds, when did someone show the same emotion as in the audio clip, and what were they saying?' END AS query,
    CASE WHEN t = 'locate_hard' THEN t0 + 600 ELSE t0 END AS time_ref, CASE t WHEN 'state' THEN 'categorical' WHEN 'change' THEN 'trend' WHEN 'comparison' THEN 'speaker_id' ELSE 'time_and_quote' END AS judge, CASE WHEN t = 'comparison' THEN CASE WHEN v >= 100 THEN 'A' ELSE 'B' END END AS winner,
    CASE WHEN t = 'change' THEN direction END AS direction, CASE WHEN t LIKE 'locate%' THEN phr END AS ref, CASE t WHEN 'locate' THEN trunc(t0)::BIGINT WHEN 'locate_hard' THEN trunc(t0 + 600)::BIGINT END AS judged_t0, CASE WHEN t = 'state' THEN CASE WHEN emo <> 'H' THEN 2 END END AS second_h FROM w""")
def emotion_queries(spark, sf_dir):
    k = F.col("event_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    t0, t1 = k % 3000 + F.lit(0.5), k % 3000 + F.lit(31.25)
    votes = F.create_map(F.lit("H"), F.lit(2).cast("long"), pick(["N", "S", "A"]), F.lit(1).cast("long"))
    speakers = F.create_map(F.lit("10"), F.lit(100.0), F.lit("2"), F.col("value"))
    c = read(spark, sf_dir, "events").select(
        k.alias("id"), pick(["state", "change", "comparison", "locate", "locate_hard"]).alias("query_type"), t0.alias("t0"), t1.alias("t1"), F.col("event_type").alias("topic"), F.concat(F.lit("so "), "event_type").alias("quote"), F.lit("x").alias("seg_text"), pick(["H", "S", "A"]).alias("emo"),
        F.lit(0.5).alias("cf"), votes.alias("votes"), F.lit(0.1).alias("act"), F.lit(0.2).alias("val"), F.lit(0.3).alias("dom"), pick(["Valence", "Arousal"]).alias("dim"), pick(["rising", "falling", "none"]).alias("direction"), F.lit(0.2).alias("delta"), F.lit(0.4).alias("half1"), F.lit(0.6).alias("half2"),
        speakers.alias("spk_val"), (20 + k % 100).alias("pad_left"), (220 - k % 100).alias("pad_right"), F.when(k % 2 == 0, t0 - 0.25).alias("win_t0"), F.when(k % 2 == 0, t1 + 90).alias("win_t1"), (t0 + 600).alias("target_t0"), (t1 + 600).alias("target_t1"), F.lit(3).alias("n_events"),
    )
    out = builders.emotion_queries(c)
    truth, judge = (lambda p: F.get_json_object("ground_truth", p)), (lambda p: F.get_json_object("judge_info", p))
    return out.select("id", "query", "time_ref", judge("$.type").alias("judge"), truth("$.winner").alias("winner"), truth("$.direction").alias("direction"), truth("$.time_ref").alias("ref"), judge("$.t0").cast("long").alias("judged_t0"), truth("$.secondary.H").cast("int").alias("second_h"))


@query("music_queries", """WITH p AS (SELECT o_orderkey AS id, o_custkey AS track, ['time', 'position', 'audio'][1 + o_orderkey % 3] AS m, o_orderkey % 40 * 30 + 30 AS ta, o_orderkey % 7 * 90 + 60 AS tb, o_orderkey % 25 + 1 AS pa, o_orderkey % 23 + 1 AS pb, o_orderkey % 5 AS fa, o_orderkey % 4 AS fb FROM orders),
c AS (SELECT c_custkey AS track, k AS f, 'clip_' || c_custkey || '_' || k AS name FROM customer, range(0, 3) r(k)), h AS (SELECT *, ta // 30 AS ha, tb // 30 AS hb FROM p)
SELECT id, CASE m WHEN 'time' THEN 'Compare the two songs at around around ' || ha // 2 || CASE WHEN ha % 2 = 1 THEN ' and a half' ELSE '' END || CASE WHEN ha = 2 THEN ' minute' ELSE ' minutes' END || ' and around ' || hb // 2 || CASE WHEN hb % 2 = 1 THEN ' and a half' ELSE '' END || CASE WHEN hb = 2 THEN ' minute' ELSE ' minutes' END || '. Which of these two songs has better overall aesthetics?'
    WHEN 'position' THEN 'Compare the ' || pa || CASE WHEN pa % 100 BETWEEN 11 AND 13 THEN 'th' WHEN pa % 10 = 1 THEN 'st' WHEN pa % 10 = 2 THEN 'nd' WHEN pa % 10 = 3 THEN 'rd' ELSE 'th' END || ' and ' || pb || CASE WHEN pb % 100 BETWEEN 11 AND 13 THEN 'th' WHEN pb % 10 = 1 THEN 'st' WHEN pb % 10 = 2 THEN 'nd' WHEN pb % 10 = 3 THEN 'rd' ELSE 'th' END || ' songs in this medley. Which has better overall aesthetics?'
    ELSE 'Song A: [A''s audio example]. Song B: [B''s audio example]. Both clips come from this medley. Which song has better overall aesthetics?' END AS query, CASE m WHEN 'time' THEN ta::VARCHAR WHEN 'position' THEN pa::VARCHAR ELSE x.name END AS ref_a, CASE m WHEN 'time' THEN tb::VARCHAR WHEN 'position' THEN pb::VARCHAR ELSE y.name END AS ref_b
FROM h LEFT JOIN c x ON x.track = h.track AND x.f = fa LEFT JOIN c y ON y.track = h.track AND y.f = fb WHERE m <> 'audio' OR (x.name IS NOT NULL AND y.name IS NOT NULL)""")
def music_queries(spark, sf_dir):
    k = F.col("o_orderkey")
    method = F.element_at(F.array(*map(F.lit, ["time", "position", "audio"])), (k % 3 + 1).cast("int"))
    pairs = read(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("track"), method.alias("ref_method"), (k % 40 * 30 + 30).alias("time_a"), (k % 7 * 90 + 60).alias("time_b"), (k % 25 + 1).alias("position_a"), (k % 23 + 1).alias("position_b"), (k % 5).cast("string").alias("file_a"), (k % 4).cast("string").alias("file_b"))
    clips = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track"), F.explode(F.array(*map(F.lit, "012"))).alias("file_name")).withColumn("name", F.concat(F.lit("clip_"), "track", F.lit("_"), "file_name"))
    return builders.music_queries(pairs, clips).select("id", "query", "ref_a", "ref_b")


@query("health_queries", """WITH f AS (SELECT p_partkey AS k, 'rec' || lpad(p_partkey::VARCHAR, 8, '0') AS stem FROM part), m AS (SELECT k, [' self, coughed ', 'daughter', 'self, no cough, stuffy nose', 'other words'][1 + k % 4] AS a, ['RES_SELF_ACOUSTIC', 'RES_PROXY', 'RES_PROXY_SPEAKER_COUGH', 'NON_RES'][1 + k % 4] AS g FROM f WHERE k % 3 <> 0),
j AS (SELECT stem, coalesce(g, 'NON_RES') AS g, CASE trim(coalesce(a, 'Non-respiratory episode')) WHEN 'self, coughed' THEN 'Patient (speaker) coughed' WHEN 'daughter' THEN 'Proxy: speaker''s daughter is the patient; no cough heard' WHEN 'self, no cough, stuffy nose' THEN 'Patient (speaker) had audible nasal congestion; no cough' ELSE trim(coalesce(a, 'Non-respiratory episode')) END AS annotation FROM f LEFT JOIN m USING (k)),
d AS (SELECT *, unnest(['reported', 'exhibited']) AS query_type FROM j)
SELECT row_number() OVER (ORDER BY stem, query_type DESC) AS query_id, stem AS episode_id, query_type, CASE WHEN query_type = 'reported' THEN CASE WHEN g <> 'NON_RES' THEN 'Yes' ELSE 'No' END WHEN g IN ('RES_SELF_ACOUSTIC', 'RES_PROXY_SPEAKER_COUGH') THEN 'Yes' ELSE 'No' END AS answer, annotation FROM d""")
def health_queries(spark, sf_dir):
    k = F.col("p_partkey")
    files = read(spark, sf_dir, "part").select(k, F.concat(F.lit("rec"), F.lpad(k.cast("string"), 8, "0"), F.lit(".wav")).alias("file"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % 4 + 1).cast("int"))
    marks = files.where("p_partkey % 3 <> 0").select("file", pick([" self, coughed ", "daughter", "self, no cough, stuffy nose", "other words"]).alias("annotation"), pick(["RES_SELF_ACOUSTIC", "RES_PROXY", "RES_PROXY_SPEAKER_COUGH", "NON_RES"]).alias("grp"))
    choices = files.where("p_partkey % 2 = 0").select("file", F.lit("what?").alias("question"), F.lit("(a) x").alias("answer"))
    return builders.health_queries(files, marks, choices).select("query_id", "episode_id", "query_type", "answer", "annotation")


@query("enriched_queries", """WITH q AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'a' ELSE 'tie' END AS winner, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 5 - 2) / 100.0::DOUBLE END AS delta, o_custkey AS fa, o_custkey + 3 AS fb FROM orders), s AS (SELECT c_custkey AS f, c_custkey * 3.0::DOUBLE AS a, c_custkey * 3.0::DOUBLE + 200 AS b FROM customer)
SELECT id, CASE WHEN winner = 'tie' AND coalesce(delta, 0) > 0 THEN 'A' WHEN winner = 'tie' AND coalesce(delta, 0) < 0 THEN 'B' ELSE winner END AS winner, (x.a + x.b) / 2 AS time_ref_a, (y.a + y.b) / 2 AS time_ref_b, y.b AS end_b FROM q LEFT JOIN s x ON x.f = fa LEFT JOIN s y ON y.f = fb""")
def enriched_queries(spark, sf_dir):
    k = F.col("o_orderkey")
    q = read(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 4 == 0, "a").otherwise("tie").alias("winner"), F.when(k % 7 != 0, (k % 5 - 2) / F.lit(100.0)).alias("delta"), F.col("o_custkey").alias("file_a"), (F.col("o_custkey") + 3).alias("file_b"))
    c = F.col("c_custkey")
    songs = read(spark, sf_dir, "customer").select(c.alias("file_name"), (c * 3.0).alias("start"), (c * 3.0 + 200).alias("end"))
    return builders.enriched(q, songs).select("id", "winner", "time_ref_a", "time_ref_b", "end_b")


@query("track_pairs", f"""WITH s AS (SELECT o_custkey AS track, o_orderkey AS song, 'f' || o_orderkey AS f, (o_orderkey % 997)::DOUBLE AS a, (o_orderkey % 997 + 200)::DOUBLE AS b, o_totalprice / 100000 AS m FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY a, f) AS pos, row_number() OVER (PARTITION BY track ORDER BY {draw_sql('song')}, song) - 1 AS n, count(*) OVER (PARTITION BY track) AS c FROM s),
k AS (SELECT *, n // 2 AS pair FROM r WHERE c >= 6 AND n < 6), p AS (SELECT x.track, x.pair, ['time', 'position', 'audio'][1 + x.pair % 3] AS ref_method, x.f AS file_a, y.f AS file_b, x.pos AS position_a, round(x.m - y.m, 4) AS delta, (ceil((x.a + 30) / 30) * 30)::BIGINT AS lo, (floor((x.b - 30) / 30) * 30)::BIGINT AS hi FROM k x JOIN k y ON x.track = y.track AND x.pair = y.pair AND x.n % 2 = 0 AND y.n % 2 = 1)
SELECT track, pair, ref_method, file_a, file_b, position_a, delta, CASE WHEN abs(delta) < 0.2 THEN 'tie' WHEN delta > 0 THEN 'a' ELSE 'b' END AS winner, CASE WHEN ref_method = 'time' THEN lo + 30 * (((hi - lo) // 30 + 1) // 2) END AS time_a FROM p""")
def track_pairs(spark, sf_dir):
    k = F.col("o_orderkey")
    songs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track"), k.alias("song_id"), F.concat(F.lit("f"), k).alias("file_name"), (k % 997).cast("double").alias("start"), (k % 997 + 200).cast("double").alias("end"), (F.col("o_totalprice") / 100000).alias("mean"))
    out = builders.song_pairs(songs, ["time", "position", "audio"], 6, 0.2, key="track")
    return out.select("track", "pair", "ref_method", F.col("file_name_a").alias("file_a"), F.col("file_name_b").alias("file_b"), F.col("position_a").cast("long").alias("position_a"), "delta", "winner", "time_a")


@query("english_songs", """WITH l AS (SELECT o_orderkey AS f, ['en', 'fr', 'de'][1 + o_orderkey % 3] AS lang, o_orderkey % 10 / 10.0::DOUBLE AS prob, CASE WHEN o_orderkey % 5 = 0 THEN ['fr', 'en'][1 + o_orderkey % 2] END AS lang2, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 8 / 8.0::DOUBLE END AS prob2 FROM orders),
m AS (SELECT l_orderkey AS f, avg((l_quantity / 10 + l_discount * 50 + l_tax * 50) / 3) AS s, 100 + sum(l_linenumber) * 12 AS d FROM lineitem GROUP BY 1) SELECT f AS file, d::BIGINT AS seconds, greatest(1, least(5, round_even(s, 0)))::BIGINT AS bucket FROM l JOIN m USING (f) WHERE coalesce(lang2, lang) = 'en' AND coalesce(prob2, prob) > 0.5 AND d BETWEEN 150 AND 300""")
def english_songs(spark, sf_dir):
    """Ratings are added up in the order of the table's rows, as the SQL does with one thread: a mean of x.5 may fall on either side."""
    k = F.col("o_orderkey")
    languages = read(spark, sf_dir, "orders").select(k.alias("file"), F.element_at(F.array(*map(F.lit, ["en", "fr", "de"])), (k % 3 + 1).cast("int")).alias("lang"), (k % 10 / F.lit(10.0)).alias("prob"), F.when(k % 5 == 0, F.element_at(F.array(F.lit("fr"), F.lit("en")), (k % 2 + 1).cast("int"))).alias("lang2"), F.when(k % 5 == 0, k % 8 / F.lit(8.0)).alias("prob2"))
    rated = placed(read(spark, sf_dir, "lineitem")).select(F.col("l_orderkey").alias("file"), ((F.col("l_quantity") / 10 + F.col("l_discount") * 50 + F.col("l_tax") * 50) / 3).alias("rating"), "l_linenumber", "_place")
    songs = in_order(rated, ["file"], ["_place"], mean=F.avg("rating"), n=F.sum("l_linenumber")).withColumn("seconds", 100 + F.col("n") * 12)
    return builders.english_songs(languages, songs).select("file", F.col("seconds").cast("long").alias("seconds"), "bucket")


@query("admitted_episodes", """WITH s AS (SELECT l_orderkey || '_' || l_linenumber AS f, l_orderkey AS ep FROM lineitem), p AS (SELECT l_orderkey || '_' || l_linenumber AS f, CASE WHEN l_quantity < 25 THEN 'Train' WHEN l_quantity < 45 THEN 'Test1' ELSE 'Test2' END AS part FROM lineitem WHERE l_linenumber <> 4),
c AS (SELECT ep, count(*) FILTER (part = 'Train') AS train, count(*) FILTER (part = 'Test1') AS test FROM s JOIN p USING (f) WHERE ep IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1) SELECT ep AS episode_id, train, test FROM c WHERE train < 10 AND CASE WHEN test = 0 THEN 'inf'::DOUBLE ELSE train / test::DOUBLE END < 0.8""")
def admitted_episodes(spark, sf_dir):
    f = F.concat_ws("_", "l_orderkey", "l_linenumber").alias("file")
    lines = read(spark, sf_dir, "lineitem")
    parts = lines.where("l_linenumber <> 4").select(f, F.when(F.col("l_quantity") < 25, "Train").when(F.col("l_quantity") < 45, "Test1").otherwise("Test2").alias("part"))
    wanted = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("episode_id"))
    return builders.admitted(lines.select(f, F.col("l_orderkey").alias("episode_id")), parts, wanted, 10, 0.8)


@query("clip_references", """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'low' || s_nationkey WHEN 1 THEN 'UP' || s_nationkey END AS clip FROM supplier""")
def clip_references(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    clips = F.create_map(F.lit("a"), F.when(k == 0, F.concat(F.lit("low"), "s_nationkey")).otherwise(""), F.lit("A"), F.when(k == 1, F.concat(F.lit("UP"), "s_nationkey")))
    return read(spark, sf_dir, "supplier").select("s_suppkey", builders.resolved_clip(clips, F.lit("a")).alias("clip"))


@query("placed_clips", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Speaker A: [s' || c_custkey || '.wav]. Speaker B: [B''s audio example].' WHEN 1 THEN 'Emotion: [e' || c_custkey || '.wav]. when?' ELSE 'Speaker: [s' || c_custkey || '.wav]. Emotion: [e' || c_custkey || '.wav].' END AS query FROM customer""")
def placed_clips(spark, sf_dir):
    k = F.col("c_custkey")
    q = F.when(k % 3 == 0, "Speaker A: [A's audio example]. Speaker B: [B's audio example].").when(k % 3 == 1, "Emotion: [audio example]. when?").otherwise("Speaker: [speaker example]. Emotion: [emotion example].")
    name = lambda x: F.concat(F.lit(f"clips/{x}"), k, F.lit(".wav"))
    return read(spark, sf_dir, "customer").select(k, builders.placed_clips(q, {"audio_spk": F.when(k % 3 != 1, name("s")), "audio_spk2": F.lit(""), "audio_emo": name("e")}).alias("query"))


@query("spoken_trends", f"""WITH {SQL_EV}, tr AS (SELECT episode_id, "start" AS t, label_score AS v FROM ev), sp AS (SELECT episode_id, min(t) AS a, max(t) AS b FROM tr GROUP BY 1), w AS (SELECT episode_id, a + i * 86400.0::DOUBLE AS lo, a + i * 86400.0::DOUBLE + 259200 AS hi FROM (SELECT *, unnest(range(0, floor((b - a - 259200) / 86400.0::DOUBLE)::BIGINT + 1)) AS i FROM sp WHERE b - a >= 259200)),
tw AS (SELECT episode_id, lo, hi, avg(v) FILTER (t < lo + 129600) AS h1, avg(v) FILTER (t >= lo + 129600) AS h2 FROM w JOIN tr USING (episode_id) WHERE t BETWEEN lo AND hi GROUP BY ALL HAVING h1 IS NOT NULL AND h2 IS NOT NULL AND abs(h2 - h1) > 0.08), c AS (SELECT tw.episode_id, lo, hi, speaker, sum(least("end", hi) - greatest("start", lo)) AS c FROM tw JOIN ev ON ev.episode_id = tw.episode_id AND "end" > lo AND "start" < hi GROUP BY ALL),
r AS (SELECT *, c / sum(c) OVER (PARTITION BY episode_id, lo) AS share FROM c) SELECT episode_id, round(lo, 3) AS lo, speaker FROM r WHERE round(share, 9) >= 0.7""")
def spoken_trends(spark, sf_dir):
    from tessera.plans.queries import trends

    return events.spoken_trends(trends(spark, sf_dir).where("abs(delta) > 0.08"), adapters.event_segments(spark, sf_dir)).select("episode_id", rounded(F.col("lo"), 3).alias("lo"), "speaker")


def recordings(spark, sf_dir) -> preparation.Recordings:
    """Events as an emotion corpus: labels, segments of four speakers, traces of two dimensions, clips of every speaker and emotion."""
    st = labelled(spark, sf_dir)
    e, o = adapters.event_segments(spark, sf_dir), F.col("ord")
    part = lambda k: (o * k % 100) / F.lit(100.0)
    labels = st.withColumn("votes", F.create_map(F.col("emo"), F.lit(2).cast("long"), F.lit("O"), F.lit(1).cast("long"))).withColumn("seg_text", F.lit("well, this is what they said to me then. yes"))
    labels = labels.withColumn("topic", F.element_at(F.array(F.lit("Old Money"), F.lit(""), F.lit("the NHS Budget")), (o % 3 + 1).cast("int")))
    gender = F.when(o % 5 < 2, "female").otherwise("male")
    segments = e.select("episode_id", "start", "end", (o % 4).cast("string").alias("speaker"), gender.alias("gender"), "text", part(29).alias("valence"), part(13).alias("arousal"), part(53).alias("dominance"))
    traces = e.select("episode_id", F.when(o % 2 == 0, "Valence").otherwise("Arousal").alias("dim"), F.col("start").alias("t"), (F.col("label_score") / 200).alias("value"))
    bounds = e.groupBy("episode_id").agg(F.min("start").alias("conv_start"), F.max("end").alias("conv_end"))
    clips = e.select(F.col("seg_id").alias("clip"), (o % 4).cast("string").alias("speaker"), gender.alias("gender"), "episode_id", F.col("label_score").alias("snr")).where("speaker <> '3'")
    emotions = st.select(F.concat(F.lit("e"), "ord").alias("clip"), "emo", F.col("spk").alias("speaker"), "episode_id", "cf", "act", "val", "dom")
    return preparation.Recordings(labels, segments, traces, bounds, clips, emotions)


#: Events as clips of an emotion with four levels between 0 and 1, a recording and a speaker; a third of them at a few places.
SQL_PT = """pt AS (SELECT event_id AS id, event_type AS emo, user_id AS episode_id, event_id % 5 AS spk, event_id % 3 = 0 AS few, CASE WHEN few THEN event_id % 4 / 4.0::DOUBLE ELSE event_id * 7919 % 10007 / 10007.0::DOUBLE END AS cf,
    CASE WHEN few THEN 0.5 ELSE event_id * 104729 % 9973 / 9973.0::DOUBLE END AS act, CASE WHEN few THEN 0.5 ELSE event_id * 15485863 % 9967 / 9967.0::DOUBLE END AS val, least(value, 100.0) / 100 AS dom FROM events)"""


def clip_points(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    level = lambda few, a, b: F.when(k % 3 == 0, few).otherwise(k * a % b / F.lit(float(b)))
    return read(spark, sf_dir, "events").select(k.alias("id"), F.col("event_type").alias("emo"), F.col("user_id").alias("episode_id"), (k % 5).alias("spk"), level(k % 4 / F.lit(4.0), 7919, 10007).alias("cf"), level(F.lit(0.5), 104729, 9973).alias("act"), level(F.lit(0.5), 15485863, 9967).alias("val"), (F.least("value", F.lit(100.0)) / 100).alias("dom"))


@query("nearest_clips", f"""WITH {SQL_PT}, d AS (SELECT a.id, b.id AS clip, round(abs(a.cf - b.cf) + sqrt((a.act - b.act) * (a.act - b.act) + (a.val - b.val) * (a.val - b.val) + (a.dom - b.dom) * (a.dom - b.dom)), 6) AS distance FROM pt a JOIN pt b ON a.emo = b.emo AND a.episode_id <> b.episode_id AND a.spk <> b.spk)
SELECT id, clip, distance, row_number() OVER (PARTITION BY id ORDER BY distance, clip)::INT AS rank FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, clip) <= 3""")
def nearest_clips(spark, sf_dir):
    """For every event the three events of its kind, of other recordings and speakers, nearest in confidence and three levels."""
    p = clip_points(spark, sf_dir)
    return nearest_points(p, p.withColumnRenamed("id", "clip"), ["emo"], "id", "clip", ["cf", "act", "val", "dom"], [("episode_id", "episode_id"), ("spk", "spk")], 3)


@query("prepared_queries")
def prepared_queries(spark, sf_dir):
    """An emotion corpus from labels and traces to numbered queries; no SQL for the whole, its steps have their own; tested for its rules."""
    r = recordings(spark, sf_dir)
    found = preparation.emotion_candidates(r, 259200.0, 86400.0, 172800.0, 86400.0, 90000.0, 3600.0)
    return preparation.emotion_queries(r, found, 3)


@query("prepared_pairs", """WITH s AS (SELECT o_custkey AS t, count(*) AS c FROM orders GROUP BY 1) SELECT t AS track, unnest(range(0, 3)) AS pair FROM s WHERE c >= 6 AND t % 2 = 0 UNION ALL SELECT t, unnest(range(0, 2)) FROM s WHERE c >= 6 AND t % 2 = 1""")
def prepared_pairs(spark, sf_dir):
    """Three pairs of each track with six songs; the third is by clip, which only every second track has."""
    k = F.col("o_orderkey")
    songs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track_name"), k.alias("song_id"), F.concat(F.lit("f"), k).alias("file_name"), (k % 997).cast("double").alias("start"), (k % 997 + 200).cast("double").alias("end"), (F.col("o_totalprice") / 100000).alias("mean"))
    clips = songs.where("track_name % 2 = 0").select(F.col("track_name").alias("track"), "file_name", F.concat(F.lit("c"), "song_id").alias("name"))
    return preparation.music_queries(songs, clips, 3).select("track", "pair")
