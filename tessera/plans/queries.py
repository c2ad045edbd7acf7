"""Named queries over the star-schema tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import numbers, text, timeparse
from tessera.operators import events, intervals, retrieval, sampling
from tessera.operators.ordering import placed
from tessera.plans import adapters, metrics
from tessera.plans.adapters import SQL_CV, SQL_EV, SQL_SC, read
from tessera.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


# -- parsing and formatting

#: Expressions of all kinds, for every order; the same text in both dialects.
EXPRESSION = """CASE o_orderkey % 14 WHEN 0 THEN concat(o_custkey % 90, ' min ', o_orderkey % 60, ' sec to ', o_custkey % 90 + 1, ' min ', o_orderkey % 60, ' sec')
    WHEN 1 THEN concat(o_custkey % 90, ' min ', o_orderkey % 60, ' sec') WHEN 2 THEN concat(o_custkey % 90, ':', o_orderkey % 6, o_custkey % 10, ' to ', o_custkey % 80, ':', o_orderkey % 6, '7')
    WHEN 3 THEN concat(o_custkey % 90, ':', o_orderkey % 6, o_custkey % 10) WHEN 4 THEN concat(o_custkey % 9, ' to ', o_orderkey % 50, ' minutes') WHEN 5 THEN concat('around ', o_custkey % 90, ' minutes') WHEN 6 THEN 'full recording'
    WHEN 7 THEN concat(o_orderkey % 100, ' sec') WHEN 8 THEN concat('around ', o_custkey % 90, ' and a half minutes') WHEN 9 THEN concat(o_orderkey % 90, ' sec to ', o_custkey % 9, ' min') WHEN 10 THEN 'All Sections'
    WHEN 11 THEN concat('at ', o_custkey % 90, '.5 min') WHEN 12 THEN concat('~', o_orderkey % 70, ' seconds') ELSE concat('nothing here in ', o_orderpriority) END"""


@query("time_expr_parse", rf"""
WITH x AS (SELECT o_orderkey AS id, {EXPRESSION} AS s FROM orders),
c AS (SELECT id, s, list_transform(list_zip(regexp_extract_all(s, '{timeparse.COMPOUND}', 1), regexp_extract_all(s, '{timeparse.COMPOUND}', 2)), lambda z: trunc(z[1]::DOUBLE * 60 + z[2]::DOUBLE)::BIGINT) AS c,
    list_transform(list_zip(regexp_extract_all(s, '{timeparse.CLOCK}', 1), regexp_extract_all(s, '{timeparse.CLOCK}', 2)), lambda z: z[1]::BIGINT * 60 + z[2]::BIGINT) AS k,
    regexp_extract(s, '{timeparse.RANGE}', ['a', 'ua', 'b', 'ub']) AS r, regexp_extract(s, '{timeparse.POINT}', ['a', 'u']) AS p FROM x),
m AS (SELECT *, CASE WHEN regexp_matches(s, '{timeparse.FULL}') THEN 'f' WHEN len(c) >= 2 THEN 'c2' WHEN len(c) = 1 THEN 'c1' WHEN len(k) >= 2 THEN 'k2' WHEN len(k) = 1 THEN 'k1' WHEN r.b <> '' THEN 'r' WHEN p.a <> '' THEN 'p' END AS how,
    CASE WHEN lower(coalesce(nullif(r.ua, ''), r.ub))[1] = 'm' THEN 60 ELSE 1 END AS fa, CASE WHEN lower(r.ub)[1] = 'm' THEN 60 ELSE 1 END AS fb, CASE WHEN lower(p.u)[1] = 'm' THEN 60 ELSE 1 END AS fp FROM c),
t AS (SELECT *, CASE how WHEN 'c1' THEN c[1] WHEN 'k1' THEN k[1] WHEN 'p' THEN trunc(try_cast(p.a AS DOUBLE) * fp)::BIGINT END AS t FROM m)
SELECT id, CASE how WHEN 'f' THEN 0 WHEN 'c2' THEN least(c[1], c[2]) WHEN 'k2' THEN least(k[1], k[2]) WHEN 'r' THEN trunc(try_cast(r.a AS DOUBLE) * fa)::BIGINT ELSE greatest(0, t - 30) END::BIGINT AS lo,
    CASE how WHEN 'f' THEN 10000 WHEN 'c2' THEN greatest(c[1], c[2]) WHEN 'k2' THEN greatest(k[1], k[2]) WHEN 'r' THEN trunc(try_cast(r.b AS DOUBLE) * fb)::BIGINT ELSE t + 30 END::BIGINT AS hi FROM t WHERE how IS NOT NULL
""")  # fmt: skip
def time_expr_parse(spark, sf_dir):
    return timeparse.localize_sets(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(EXPRESSION).alias("localize"))).select("id", "lo", "hi")


REPLY = """CASE o_orderkey % 7 WHEN 0 THEN 'Answer: **YES**' WHEN 1 THEN concat('YES', chr(10), 'because of ', o_orderpriority, chr(10), 'NO') WHEN 2 THEN concat('maybe ', o_orderpriority) WHEN 3 THEN concat('I think', chr(10), '`no`')
    WHEN 4 THEN 'Final answer: no' WHEN 5 THEN 'well yes and no' ELSE concat('the answer: Yes.', chr(10), 'NO') END"""


@query("verdict_parse", rf"""
WITH x AS (SELECT o_orderkey AS id, {REPLY} AS s FROM orders), y AS (SELECT id, s, upper(regexp_extract(s, '(?i)\b(?:Final\s+)?Answer\s*:\s*\**\s*(YES|NO)\b', 1)) AS l,
    list_filter(list_reverse(list_transform(string_split(s, chr(10)), lambda t: upper(regexp_replace(t, '[\s`*_]', '', 'g')))), lambda t: t IN ('YES', 'NO'))[1] AS a, regexp_extract(upper(s), '\b(YES|NO)\b', 1) AS t FROM x)
SELECT id, (coalesce(nullif(l, ''), a, nullif(t, ''), 'NO') = 'YES')::INT AS v FROM y
""")
def verdict_parse(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.verdict(F.expr(REPLY)).alias("v"))


SAID = """CASE o_orderkey % 6 WHEN 0 THEN concat('Blue ', o_orderpriority, '. Rationale: it is said.') WHEN 1 THEN concat(' ', chr(10), 'Rationale: only this ', o_orderpriority) WHEN 2 THEN concat('no reason ', o_orderpriority, chr(10))
    WHEN 3 THEN concat('A rationale: B ', o_orderpriority, ' rationale: C') WHEN 4 THEN concat('Answer: ', o_orderpriority, chr(10), chr(10), 'RATIONALE:', chr(9), 'x') ELSE 'rationale:' END"""


@query("answer_split", rf"""
WITH x AS (SELECT o_orderkey AS id, {SAID} AS s FROM orders), y AS (SELECT id, strpos(lower(s), 'rationale:') AS p, s FROM x),
z AS (SELECT id, p, trim(CASE WHEN p > 0 THEN substr(s, 1, p - 1) ELSE s END, ' ' || chr(9) || chr(10)) AS l, trim(CASE WHEN p > 0 THEN substr(s, p + 10) ELSE '' END, ' ' || chr(9) || chr(10)) AS r FROM y)
SELECT id, CASE WHEN l = '' THEN r ELSE l END AS answer, CASE WHEN l = '' THEN '' ELSE r END AS rationale FROM z
""")
def answer_split(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.answer_split(F.expr(SAID)).alias("x")).select("id", "x.*")


@query("ordinal_fmt", """
SELECT p_partkey AS n, p_partkey::VARCHAR || CASE WHEN p_partkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_partkey % 10 = 1 THEN 'st' WHEN p_partkey % 10 = 2 THEN 'nd' WHEN p_partkey % 10 = 3 THEN 'rd' ELSE 'th' END AS word FROM part
""")
def ordinal_fmt(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), text.ordinal(F.col("p_partkey")).alias("word"))


@query("halfminute_fmt", """
WITH x AS (SELECT p_partkey AS id, (p_partkey * 17 + 7) % 1000 AS s FROM part), h AS (SELECT id, round_even(s / 30.0::DOUBLE, 0)::BIGINT AS h FROM x)
SELECT id, 'around ' || (h // 2)::VARCHAR || CASE WHEN h % 2 = 1 THEN ' and a half' ELSE '' END || CASE WHEN h % 2 = 0 AND h // 2 = 1 THEN ' minute' ELSE ' minutes' END AS phrase FROM h
""")
def halfminute_fmt(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.half_minute_phrase((F.col("p_partkey") * 17 + 7) % 1000).alias("phrase"))


@query("topic_normalise", r"""
SELECT p_partkey AS id, array_to_string(list_transform(regexp_split_to_array(trim(p_name || ' ' || p_brand || ' NASA a I'), '\s+'), lambda w: CASE WHEN length(w) > 1 AND w = upper(w) AND w <> lower(w) THEN w ELSE lower(w) END), ' ') AS topic FROM part
""")
def topic_normalise(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.topic(F.concat_ws(" ", "p_name", "p_brand", F.lit("NASA a I"))).alias("topic"))


@query("clause_pick", rf"""
WITH x AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(replace(coalesce(text, ''), chr(1), ' '), '([.!?])\s+|,\s+', '\1' || chr(1), 'g'), chr(1)), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')), lambda c: c <> '') AS c FROM documents),
f AS (SELECT doc_id, c, list_filter(c, lambda y: len(string_split_regex(y, '\s+')) BETWEEN 4 AND 12) AS f FROM x), p AS (SELECT doc_id, CASE WHEN len(f) > 0 THEN f ELSE c END AS p FROM f)
SELECT doc_id, CASE WHEN len(p) = 0 THEN '' ELSE p[1 + (doc_id * {sampling.FACTOR} + {42 * 104_729}) % {sampling.PRIME} % len(p)] END AS clause FROM p
""")
def clause_pick(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.picked_clause(F.col("text"), sampling.draw(F.col("doc_id"))).alias("clause"))


@query("clock_seconds", """
SELECT o_orderkey AS id, ((o_orderkey % 3)::VARCHAR || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || ':07') AS shown, (o_orderkey % 3) * 3600 + (o_orderkey % 60) * 60 + 7 AS seconds FROM orders
""")
def clock_seconds(spark, sf_dir):
    shown = F.concat((F.col("o_orderkey") % 3).cast("string"), F.lit(":"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"), F.lit(":07"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), shown.alias("shown"), text.clock_seconds(shown).cast("long").alias("seconds"))


MATCH_SQL = f"""{SQL_CV}, sg AS (SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY ord) - 1 AS idx, "start", "end", text FROM cv),
tx AS (SELECT episode_id, ord AS n, CASE WHEN ord % 4 = 1 THEN substr(text, 40, 90) ELSE substr(text, 1, 60) END AS text, CASE WHEN ord % 5 = 3 THEN "start" END AS t0, CASE WHEN ord % 5 = 3 THEN "end" END AS t1 FROM cv WHERE ord % 3 <> 2)"""


@query("token_overlap_match", rf"""WITH {MATCH_SQL}, w AS (SELECT episode_id, n, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''))) AS w FROM tx WHERE t0 IS NULL), v AS (SELECT episode_id, idx, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''))) AS w FROM sg),
c AS (SELECT episode_id, n, idx, count(*) AS c FROM w JOIN v USING (episode_id, w) GROUP BY ALL), b AS (SELECT episode_id, n, arg_max(idx, (c, -idx)) AS best FROM c GROUP BY ALL
    UNION ALL SELECT episode_id, n, arg_min(idx, (abs("start" - t0), idx)) FROM tx JOIN sg USING (episode_id) WHERE t0 IS NOT NULL GROUP BY ALL),
r AS (SELECT tx.*, best, count(t0) OVER (PARTITION BY episode_id ORDER BY n) AS g FROM tx LEFT JOIN b USING (episode_id, n)), m AS (SELECT *, max(best) OVER (PARTITION BY episode_id, g ORDER BY n) AS at FROM r)
SELECT episode_id, n, round(coalesce(t0, "start"), 6) AS t0, round(coalesce(t1, "end"), 6) AS t1 FROM m JOIN sg ON sg.episode_id = m.episode_id AND sg.idx = m.at WHERE best IS NOT NULL""".replace("SELECT episode_id, n, round(coalesce(t0", "SELECT m.episode_id, n, round(coalesce(t0"))
def token_overlap_match(spark, sf_dir):
    cv = adapters.turn_segments(spark, sf_dir)
    segments = cv.withColumn("idx", F.row_number().over(Window.partitionBy("episode_id").orderBy("ord")) - 1).select("episode_id", "idx", "start", "end", "text")
    said = F.when(F.col("ord") % 4 == 1, F.substring("text", 40, 90)).otherwise(F.substring("text", 1, 60))
    timed = F.col("ord") % 5 == 3
    transcripts = cv.where("ord % 3 <> 2").select("episode_id", F.col("ord").alias("n"), said.alias("text"), F.when(timed, F.col("start")).alias("t0"), F.when(timed, F.col("end")).alias("t1"))
    return events.matched_times(transcripts, segments).select("episode_id", "n", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


# -- retrieval

#: Two plan sets for each user, the second later; labels and keywords of all kinds, some missing.
SETS_SQL = """sets AS (SELECT user_id AS query_id, s::INT AS set_no, user_id AS episode_id, user_id % 5 * 100000 + s * 50000 AS lo, user_id % 5 * 100000 + s * 50000 + 400000 + user_id % 3 * 700000 AS hi,
    CASE user_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'PURCHASE' WHEN 4 THEN 'login' END AS label, CASE user_id % 4 WHEN 0 THEN 'k' WHEN 1 THEN '"k": 1' WHEN 2 THEN '7' END AS keyword FROM (SELECT DISTINCT user_id FROM events), range(0, 2) r(s))"""
TIME_SQL = 'tm AS (SELECT query_id, set_no, seg_id, "start", "end", s.ord, round((least("end", hi) - greatest("start", lo)) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 3) AS score FROM sets JOIN ev s USING (episode_id) WHERE "end" > lo AND "start" < hi)'
LABEL_SQL = 'lb AS (SELECT query_id, set_no, seg_id, "start", "end", s.ord, round(coalesce(s.label_score, 1.0), 3) AS score FROM sets JOIN ev s USING (episode_id) WHERE "end" > lo AND "start" < hi AND lower(s.label) = lower(sets.label))'
WORD_SQL = """kw AS (SELECT query_id, set_no, seg_id, "start", "end", ord, 1.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, set_no ORDER BY ord) AS r FROM sets JOIN ev s USING (episode_id)
    WHERE "end" > lo AND "start" < hi AND contains(lower(s.text), lower(sets.keyword))) WHERE r <= 10)"""


def sets_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("query_id")
    lo = u % 5 * 100000 + F.col("set_no") * 50000
    label = F.when(u % 5 == 0, "click").when(u % 5 == 1, "view").when(u % 5 == 2, "PURCHASE").when(u % 5 == 4, "login")
    keyword = F.when(u % 4 == 0, "k").when(u % 4 == 1, '"k": 1').when(u % 4 == 2, "7")
    users = read(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("query_id")).distinct()
    both = users.withColumn("set_no", F.explode(F.array(F.lit(0), F.lit(1))))
    return both.select("query_id", "set_no", u.alias("episode_id"), lo.cast("long").alias("lo"), (lo + 400000 + u % 3 * 700000).cast("long").alias("hi"), label.alias("label"), keyword.alias("keyword"))


@query("search_time_topk", f"""WITH {SETS_SQL}, {SQL_EV}, {TIME_SQL}
SELECT query_id, set_no, seg_id, score, r AS hit_ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id, set_no ORDER BY score DESC, ord) AS r FROM tm) WHERE r <= 10""")
def search_time_topk(spark, sf_dir):
    return retrieval.search_time(sets_of(spark, sf_dir).drop("label"), adapters.event_segments(spark, sf_dir)).where("hit_ord <= 10").select("query_id", "set_no", "seg_id", "score", "hit_ord")


@query("search_label", f"WITH {SETS_SQL}, {SQL_EV}, {LABEL_SQL} SELECT query_id, set_no, seg_id, score FROM lb")
def search_label(spark, sf_dir):
    return retrieval.search_label(sets_of(spark, sf_dir), adapters.event_segments(spark, sf_dir)).select("query_id", "set_no", "seg_id", "score")


@query("search_keyword_limit", f"WITH {SETS_SQL}, {SQL_EV}, {WORD_SQL} SELECT query_id, set_no, seg_id, score FROM kw")
def search_keyword_limit(spark, sf_dir):
    return retrieval.search_keyword(sets_of(spark, sf_dir).drop("label"), adapters.event_segments(spark, sf_dir)).select("query_id", "set_no", "seg_id", "score")


@query("keyword_documents", """WITH k(w) AS (VALUES ('the'), ('tion'), ('100%_')) SELECT w, doc_id FROM (SELECT w, doc_id, row_number() OVER (PARTITION BY w ORDER BY doc_id) AS r FROM documents JOIN k ON contains(lower(text), w)) WHERE r <= 10""")
def keyword_documents(spark, sf_dir):
    words = F.array(F.lit("the"), F.lit("tion"), F.lit("100%_"))
    hit = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(words, lambda w: F.contains(F.lower("text"), w))).alias("w"))
    return sampling.first_n(hit, ["w"], ["doc_id"], 10).select("w", "doc_id")


VEC_SQL = """SELECT q.vec_id AS query_id, 0 AS set_no, 'v' || v.vec_id AS seg_id, v.vec_id * 10.0::DOUBLE AS "start", v.vec_id * 10.0::DOUBLE + 10 AS "end", v.vec_id AS ord, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS s6
    FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 50 = 0"""
SPAN_SQL = "(SELECT min(vec_id) * 10 AS lo, max(vec_id) * 10 + 10 AS hi FROM embeddings)"


def vector_sets_all(spark, sf_dir) -> DataFrame:
    """Every fiftieth vector as a query against all vectors of its own label, in a window from the table's first vector to its last."""
    e = read(spark, sf_dir, "embeddings")
    span = e.agg((F.min("vec_id") * 10).alias("lo"), (F.max("vec_id") * 10 + 10).alias("hi"))  # one row
    q = e.where("vec_id % 50 = 0").crossJoin(F.broadcast(span))
    return q.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("set_no"), F.col("label").cast("long").alias("episode_id"), "lo", "hi", F.col("embedding").alias("query_vector"))


@query("vector_topk_filtered_all", f"""WITH v AS ({VEC_SQL}) SELECT query_id, seg_id, round(s6, 3) AS score, r AS hit_ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s6 DESC, ord) AS r FROM v) WHERE r <= 5""")
def vector_topk_filtered_all(spark, sf_dir):
    return retrieval.search_vectors(vector_sets_all(spark, sf_dir), adapters.vectors(spark, sf_dir), "text_emb").select("query_id", "seg_id", "score", "hit_ord")


FUSE_SQL = """b AS (SELECT query_id, set_no, seg_id, source, max(score) AS score, min((m, o)) AS f, min("start") AS "start", min("end") AS "end" FROM h GROUP BY ALL),
o AS (SELECT query_id, set_no, seg_id, round(sum(CASE WHEN score > 0 THEN round(score, 3) ELSE 0 END), 3) AS fused, min(f) AS f, min("start") AS "start", min("end") AS "end" FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, set_no ORDER BY fused DESC, f, seg_id) AS r FROM o)
SELECT query_id, set_no, seg_id, fused, row_number() OVER (PARTITION BY query_id, set_no ORDER BY "start", r) AS rank FROM r WHERE r <= {k}"""


@query("hybrid_dispatch", f"""WITH {SETS_SQL}, {SQL_EV}, {TIME_SQL}, {LABEL_SQL}, {WORD_SQL},
h AS (SELECT query_id, set_no, seg_id, "start", "end", score, 'time' AS source, 0 AS m, row_number() OVER (PARTITION BY query_id, set_no ORDER BY score DESC, ord) AS o FROM tm
    UNION ALL SELECT query_id, set_no, seg_id, "start", "end", score, 'label', 1, row_number() OVER (PARTITION BY query_id, set_no ORDER BY ord) FROM lb
    UNION ALL SELECT query_id, set_no, seg_id, "start", "end", score, 'keyword', 3, row_number() OVER (PARTITION BY query_id, set_no ORDER BY ord) FROM kw), {FUSE_SQL.format(k=10)}""")
def hybrid_dispatch(spark, sf_dir):
    return retrieval.dispatch(sets_of(spark, sf_dir), adapters.event_segments(spark, sf_dir)).select("query_id", "set_no", "seg_id", "fused", "rank")


@query("fuse_evidence_topk_all", f"""WITH v AS ({VEC_SQL}), tv AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s6 DESC, ord) AS r FROM v), tt AS (SELECT *, round((least("end", hi) - greatest("start", lo)) / (hi - lo)::DOUBLE, 3) AS sc FROM v, {SPAN_SQL}),
h AS (SELECT query_id, set_no, seg_id, "start", "end", sc AS score, 'time' AS source, 0 AS m, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, ord) AS o FROM tt
    UNION ALL SELECT query_id, set_no, seg_id, "start", "end", round(s6, 3), 'text_emb', 2, r FROM tv WHERE r <= 5), {FUSE_SQL.format(k=3)}""")
def fuse_evidence_topk_all(spark, sf_dir):
    sets, v = vector_sets_all(spark, sf_dir), adapters.vectors(spark, sf_dir).withColumn("ord", F.col("idx"))
    hits = retrieval.search_time(sets.drop("query_vector"), v).unionByName(retrieval.search_vectors(sets, v, "text_emb"))
    return retrieval.fuse(hits, 3).select("query_id", "set_no", "seg_id", "fused", "rank")


SIX_SQL = """sg AS (SELECT vec_id AS ord, 'v' || vec_id AS seg_id, label::BIGINT AS episode_id, vec_id * 10.0::DOUBLE AS "start", vec_id * 10.0::DOUBLE + 10 AS "end", 'L' || vec_id % 3 AS label, (vec_id % 10) / 10.0::DOUBLE AS label_score, 'a word' || vec_id % 7 AS text, embedding::DOUBLE[] AS e FROM embeddings),
st AS (SELECT ord AS query_id, 0 AS set_no, episode_id, ord * 10 - 3000 AS lo, ord * 10 + 3000 AS hi, 'WORD' || ord % 7 AS word, e FROM sg WHERE ord % 50 = 0),
p AS (SELECT query_id, set_no, seg_id, "start", "end", ord, lo, hi, label, label_score, text, word, round(list_cosine_similarity(st.e, sg.e), 6) AS te, round(list_cosine_similarity(list_reverse(st.e), sg.e), 6) AS au, round(list_cosine_similarity(st.e[1:8], sg.e[1:8]), 6) AS de
    FROM st JOIN sg USING (episode_id) WHERE "end" > lo AND "start" < hi),
tm AS (SELECT *, round((least("end", hi) - greatest("start", lo)) / (hi - lo)::DOUBLE, 3) AS score FROM p),
h AS (SELECT query_id, set_no, seg_id, "start", "end", score, 'time' AS source, 0 AS m, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS o FROM tm
    UNION ALL SELECT query_id, set_no, seg_id, "start", "end", round(label_score, 3), 'label', 1, row_number() OVER (PARTITION BY query_id ORDER BY ord) FROM p WHERE label = 'L1'
    UNION ALL SELECT * FROM (SELECT query_id, set_no, seg_id, "start", "end", round(te, 3), 'text_emb', 2, row_number() OVER (PARTITION BY query_id ORDER BY te DESC, ord) AS o FROM p) WHERE o <= 5
    UNION ALL SELECT * FROM (SELECT query_id, set_no, seg_id, "start", "end", 1.0::DOUBLE, 'keyword', 3, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS o FROM p WHERE contains(text, lower(word))) WHERE o <= 10
    UNION ALL SELECT * FROM (SELECT query_id, set_no, seg_id, "start", "end", round(au, 3), 'audio_emb', 4, row_number() OVER (PARTITION BY query_id ORDER BY au DESC, ord) AS o FROM p) WHERE o <= 5
    UNION ALL SELECT * FROM (SELECT query_id, set_no, seg_id, "start", "end", round(de, 3), 'domain_emb', 5, row_number() OVER (PARTITION BY query_id ORDER BY de DESC, ord) AS o FROM p) WHERE o <= 5)"""


@query("hybrid_six", f"""WITH {SIX_SQL}, {FUSE_SQL.format(k=10)}""")
def hybrid_six(spark, sf_dir):
    """All six modalities at once: by time, label, word, and in three spaces of vectors, each with a vector of its own in every set."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("vec_id").alias("idx"), F.concat(F.lit("v"), "vec_id").alias("seg_id"), F.col("label").cast("long").alias("episode_id"), (F.col("vec_id") * 10.0).alias("start"), (F.col("vec_id") * 10.0 + 10).alias("end"), F.col("embedding").cast("array<double>").alias("embedding"))
    segments = v.select("ord", "seg_id", "episode_id", "start", "end", F.concat(F.lit("L"), F.col("ord") % 3).alias("label"), (F.col("ord") % 10 / F.lit(10.0)).alias("label_score"), F.concat(F.lit("a word"), F.col("ord") % 7).alias("text"))
    k = F.col("ord")
    sets = v.where("ord % 50 = 0").select(k.alias("query_id"), F.lit(0).alias("set_no"), "episode_id", (k * 10 - 3000).alias("lo"), (k * 10 + 3000).alias("hi"), F.lit("l1").alias("label"), F.concat(F.lit("WORD"), k % 7).alias("keyword"), F.col("embedding").alias("text_emb_vector"), F.reverse("embedding").alias("audio_emb_vector"), F.slice("embedding", 1, 8).alias("domain_emb_vector"))
    spaces = {"text_emb": v, "audio_emb": v, "domain_emb": v.withColumn("embedding", F.slice("embedding", 1, 8))}
    bare = ["query_id", "set_no", "episode_id", "lo", "hi", "label", "keyword"]
    out = retrieval.dispatch(sets, segments, spaces, tuple(retrieval.MODALITIES), searched=bare)
    return out.select("query_id", "set_no", "seg_id", "fused", "rank")


@query("clip_span", f"""WITH {SETS_SQL}, {SQL_EV}, {WORD_SQL}, e AS (SELECT query_id, set_no, trunc(min("start"))::BIGINT AS a, trunc(max("end"))::BIGINT AS b FROM kw GROUP BY ALL)
SELECT query_id, set_no, coalesce(a, lo)::BIGINT AS lo, least(coalesce(b, hi), coalesce(a, lo) + 60)::BIGINT AS hi FROM sets LEFT JOIN e USING (query_id, set_no)""")
def clip_span(spark, sf_dir):
    sets = sets_of(spark, sf_dir)
    return retrieval.clip_span(retrieval.search_keyword(sets.drop("label"), adapters.event_segments(spark, sf_dir)), sets=sets)


PLAN = """CASE o_orderkey % 4 WHEN 0 THEN concat('```json', chr(10), '{"sets": [{"localize": "', o_custkey, ' to ', o_custkey + 5, ' minutes", "keyword": "', o_orderpriority, '", "time": true}, {"localize": "full track", "label": ""}]}', chr(10), '```')
    WHEN 1 THEN concat('{"sets": [{"text_emb": "', o_orderpriority, '", "audio_emb": "A"}]}') WHEN 2 THEN '{"sets": []}' ELSE concat('not json ', o_orderpriority) END"""


@query("plan_parse", f"""WITH x AS (SELECT o_orderkey AS query_id, {PLAN} AS plan FROM orders), c AS (SELECT query_id, trim(regexp_replace(regexp_replace(trim(plan), '^```(json)?\\s*', ''), '\\s*```$', '')) AS p FROM x),
s AS (SELECT query_id, unnest(json_extract(p, '$.sets[*]')) AS s, unnest(range(0, len(json_extract(p, '$.sets[*]')))) AS set_no FROM c WHERE json_valid(p))
SELECT query_id, set_no::INT AS set_no, s->>'localize' AS localize, s->>'keyword' AS keyword, s->>'label' AS label FROM s""")
def plan_parse(spark, sf_dir):
    return retrieval.parse_plans(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.expr(PLAN).alias("plan"))).select("query_id", "set_no", "localize", "keyword", "label")


# -- intervals

#: Three windows for each user, from its first event on.
WINDOWS_SQL = """win AS (SELECT episode_id, a + k * 800000 AS lo, a + k * 800000 + 40000 + episode_id % 7 * 30000 AS hi FROM (SELECT user_id AS episode_id, min(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 AS a FROM events GROUP BY 1), range(0, 3) r(k))"""


def windows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("long").alias("episode_id")).agg(F.floor(F.min(adapters.seconds("ts"))).cast("long").alias("_a"))
    lo = F.col("_a") + F.col("_k") * 800000
    return first.withColumn("_k", F.explode(F.array(*map(F.lit, range(3))))).select("episode_id", lo.alias("lo"), (lo + 40000 + F.col("episode_id") % 7 * 30000).alias("hi"))


@query("interval_coverage_rate", f"""WITH {WINDOWS_SQL}, {SQL_EV} SELECT episode_id, avg(CASE WHEN EXISTS (SELECT 1 FROM win w WHERE w.episode_id = ev.episode_id AND ev."end" > w.lo AND ev."start" < w.hi) THEN 1.0 ELSE 0.0 END) AS covered FROM ev GROUP BY episode_id""")
def interval_coverage_rate(spark, sf_dir):
    return intervals.coverage(adapters.event_segments(spark, sf_dir).select("episode_id", "seg_id", "start", "end"), windows_of(spark, sf_dir), bucket=50000.0)


@query("interval_join_bucketed", f"""WITH {WINDOWS_SQL}, {SQL_EV} SELECT seg_id, lo, round(least("end", hi) - greatest("start", lo), 6) AS overlap FROM ev JOIN win USING (episode_id) WHERE "end" > lo AND "start" < hi""")
def interval_join_bucketed(spark, sf_dir):
    joined = intervals.overlap_join(adapters.event_segments(spark, sf_dir), windows_of(spark, sf_dir), "episode_id", bucket=50000.0)
    return joined.select("seg_id", F.col("lo").cast("long").alias("lo"), F.round(numbers.overlap(F.col("start"), F.col("end"), F.col("lo"), F.col("hi")), 6).alias("overlap"))


POINTS_SQL = "pt AS (SELECT o_orderkey AS point_id, o_custkey % 150 AS episode_id, (o_orderkey * 7919 % 2592000)::DOUBLE AS t FROM orders)"


def points_all(spark, sf_dir) -> DataFrame:
    """Query points: every order names a user and a second."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), (F.col("o_custkey") % 150).alias("episode_id"), (F.col("o_orderkey") * 7919 % 2592000).cast("double").alias("t"))


@query("nearest_segment_all", f"""WITH {SQL_EV}, {POINTS_SQL} SELECT point_id, seg_id FROM (SELECT point_id, seg_id, row_number() OVER (PARTITION BY point_id ORDER BY (t BETWEEN "start" AND "end") DESC, CASE WHEN t BETWEEN "start" AND "end" THEN "start" ELSE abs("start" - t) END, "start", seg_id) AS r FROM pt JOIN ev USING (episode_id)) WHERE r = 1""")
def nearest_segment_all(spark, sf_dir):
    return intervals.nearest(points_all(spark, sf_dir), adapters.event_segments(spark, sf_dir).select("episode_id", "seg_id", "start", "end")).select("point_id", "seg_id")


@query("nearest_within_all", f"""WITH {SQL_EV}, {POINTS_SQL} SELECT point_id, seg_id FROM (SELECT point_id, seg_id, row_number() OVER (PARTITION BY point_id ORDER BY (abs("start" - t) <= 1000) DESC, abs("start" - t), "start", seg_id) AS r FROM pt JOIN ev USING (episode_id)) WHERE r = 1""")
def nearest_within_all(spark, sf_dir):
    return intervals.nearest_within(points_all(spark, sf_dir), adapters.event_segments(spark, sf_dir).select("episode_id", "seg_id", "start", "end"), 1000.0).select("point_id", "seg_id")


@query("argmax_overlap", f"""WITH {WINDOWS_SQL}, {SQL_EV}, j AS (SELECT seg_id, lo, least("end", hi) - greatest("start", lo) AS o FROM ev JOIN win USING (episode_id) WHERE "end" > lo AND "start" < hi)
SELECT seg_id, lo, round(o, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY o DESC, lo) AS r FROM j WHERE o > 0) WHERE r = 1""")
def argmax_overlap(spark, sf_dir):
    return intervals.arg_max_overlap(adapters.event_segments(spark, sf_dir), windows_of(spark, sf_dir), "episode_id", "seg_id", "lo").select("seg_id", F.col("lo").cast("long").alias("lo"), F.round("overlap", 6).alias("overlap"))


@query("split_long_turns", f"""WITH {SQL_CV}, n AS (SELECT *, greatest(1, ceil(("end" - "start") / 20.0::DOUBLE))::BIGINT AS n FROM cv), s AS (SELECT *, unnest(range(0, n)) AS i FROM n)
SELECT episode_id, ord, i, round("start" + i * (("end" - "start") / n), 6) AS a, round("start" + (i + 1) * (("end" - "start") / n), 6) AS b FROM s""")
def split_long_turns(spark, sf_dir):
    cut = intervals.split_long(adapters.turn_segments(spark, sf_dir), 20.0)
    return cut.select("episode_id", "ord", (F.row_number().over(Window.partitionBy("episode_id", "ord").orderBy("start")) - 1).cast("long").alias("i"), F.round("start", 6).alias("a"), F.round("end", 6).alias("b"))


@query("merge_short_turns", f"""WITH {SQL_CV}, o AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY "start", "end") AS rn FROM cv),
k AS (SELECT *, sum(CASE WHEN rn = 1 OR "end" - "start" >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS n FROM o),
g AS (SELECT episode_id, n, arg_min("start", rn) AS a, arg_max("end", rn) AS b, arg_min(speaker, rn) AS speaker FROM k GROUP BY episode_id, n),
f AS (SELECT g.episode_id, g.n, CASE WHEN x.b - x.a < 25 THEN x.a ELSE g.a END AS a, g.b, g.speaker FROM g LEFT JOIN g x ON x.episode_id = g.episode_id AND g.n = 2 AND x.n = 1)
SELECT episode_id, round(a, 6) AS a, round(b, 6) AS b, speaker FROM f WHERE b - a >= 25""")
def merge_short_turns(spark, sf_dir):
    return intervals.merge_short(adapters.turn_segments(spark, sf_dir), 25.0).select("episode_id", F.round("start", 6).alias("a"), F.round("end", 6).alias("b"), "speaker")


@query("gap_merge", f"""WITH {SQL_EV}, r AS (SELECT episode_id, "start" AS a, "start" + 1000 AS b FROM ev), g AS (SELECT *, coalesce((a - max(b) OVER (PARTITION BY episode_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 5000)::INT, 1) AS nw FROM r),
n AS (SELECT *, sum(nw) OVER (PARTITION BY episode_id ORDER BY a, b) AS n FROM g) SELECT episode_id, round(min(a), 6) AS a, round(max(b), 6) AS b, count(*) AS parts FROM n GROUP BY episode_id, n""")
def gap_merge(spark, sf_dir):
    regions = adapters.event_segments(spark, sf_dir).select("episode_id", "start", (F.col("start") + 1000).alias("end"))
    return intervals.merge_gaps(regions, 5000.0).select("episode_id", F.round("start", 6).alias("a"), F.round("end", 6).alias("b"), "parts")


@query("crossfade_timeline", f"""WITH {SQL_CV} SELECT episode_id, ord, row_number() OVER w AS position, round(coalesce(sum(round(duration * 1000)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 3000 * (row_number() OVER w - 1), 3) AS starts FROM cv WINDOW w AS (PARTITION BY episode_id ORDER BY ord)""")
def crossfade_timeline(spark, sf_dir):
    t = adapters.turn_segments(spark, sf_dir).withColumn("ms", F.round(F.col("duration") * 1000))
    return intervals.timeline(t, F.col("ms"), "episode_id", ["ord"], 3000.0).select("episode_id", "ord", F.col("position").cast("long").alias("position"), numbers.rounded(F.col("start"), 3).alias("starts"))


@query("tumbling_windows", f"""WITH {SQL_CV}, s AS (SELECT episode_id, min("start") AS a, max("end") AS b FROM cv GROUP BY 1), n AS (SELECT *, unnest(range(0, greatest(1, ceil((b - a) / 30.0::DOUBLE))::BIGINT)) AS i FROM s) SELECT episode_id, round(a + i * 30, 6) AS lo, round(least(b, a + (i + 1) * 30), 6) AS hi FROM n""")
def tumbling_windows(spark, sf_dir):
    spans = adapters.turn_segments(spark, sf_dir).groupBy("episode_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return intervals.tumbling(spans, 30.0).select("episode_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


# -- event mining

@query("dominant_speaker", f"""WITH {WINDOWS_SQL}, {SQL_EV}, p AS (SELECT episode_id * 10000000 + lo AS window_id, speaker, sum(least("end", hi) - greatest("start", lo)) AS c FROM ev JOIN win USING (episode_id) WHERE "end" > lo AND "start" < hi GROUP BY 1, 2),
r AS (SELECT *, c / sum(c) OVER (PARTITION BY window_id) AS share, row_number() OVER (PARTITION BY window_id ORDER BY round(c, 6) DESC, speaker) AS r FROM p) SELECT window_id, speaker, round(share, 6) AS share FROM r WHERE r = 1 AND round(share, 9) >= 0.5""")
def dominant_speaker(spark, sf_dir):
    windows = windows_of(spark, sf_dir).withColumn("window_id", (F.col("episode_id") * 10000000 + F.col("lo")).cast("long"))
    return events.dominant_speaker(windows, adapters.event_segments(spark, sf_dir), 0.5).select("window_id", "speaker", F.round("share", 6).alias("share"))


TREND_SQL = f"""{SQL_EV}, tr AS (SELECT episode_id, "start" AS t, label_score AS v FROM ev), sp AS (SELECT episode_id, min(t) AS a, max(t) AS b FROM tr GROUP BY 1),
w AS (SELECT episode_id, a + i * 86400.0::DOUBLE AS lo, a + i * 86400.0::DOUBLE + 259200 AS hi FROM (SELECT *, unnest(range(0, floor((b - a - 259200) / 86400.0::DOUBLE)::BIGINT + 1)) AS i FROM sp WHERE b - a >= 259200)),
tw AS (SELECT episode_id, lo, hi, avg(v) FILTER (t < lo + 129600) AS h1, avg(v) FILTER (t >= lo + 129600) AS h2 FROM w JOIN tr USING (episode_id) WHERE t BETWEEN lo AND hi GROUP BY ALL HAVING count(*) FILTER (t < lo + 129600) > 0 AND count(*) FILTER (t >= lo + 129600) > 0)"""


def trends(spark, sf_dir) -> DataFrame:
    """Values are added up in the order of the table's rows, as the SQL does with one thread: a difference of 0.08 may fall on either side."""
    trace = placed(read(spark, sf_dir, "events")).select(F.col("user_id").alias("episode_id"), adapters.seconds("ts").alias("t"), "value", "_place")
    return events.trend_windows(trace, 259200.0, 86400.0, order=["_place"])


@query("sliding_trend", f"WITH {TREND_SQL} SELECT episode_id, round(lo, 3) AS lo, round(h1, 6) AS half1, round(h2, 6) AS half2 FROM tw WHERE abs(h2 - h1) > 0.08")
def sliding_trend(spark, sf_dir):
    return trends(spark, sf_dir).where("abs(delta) > 0.08").select("episode_id", numbers.rounded(F.col("lo"), 3).alias("lo"), numbers.rounded(F.col("half1"), 6).alias("half1"), numbers.rounded(F.col("half2"), 6).alias("half2"))


NMS_SQL = f"""WITH RECURSIVE {TREND_SQL}, c AS (SELECT *, round(abs(h2 - h1), 9) AS s FROM tw WHERE abs(h2 - h1) > 0.08), o AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY s DESC, lo, hi) AS r FROM c),
f AS (SELECT 0 AS r, episode_id, [] :: STRUCT(lo DOUBLE, hi DOUBLE)[] AS kept FROM (SELECT DISTINCT episode_id FROM o)
    UNION ALL SELECT o.r, o.episode_id, CASE WHEN len(list_filter(kept, lambda x: o.lo < x.hi + 86400 AND o.hi > x.lo - 86400)) > 0 THEN kept ELSE list_append(kept, {{'lo': o.lo, 'hi': o.hi}}) END FROM f JOIN o ON o.episode_id = f.episode_id AND o.r = f.r + 1),
l AS (SELECT episode_id, arg_max(kept, r) AS kept FROM f GROUP BY 1), k AS (SELECT episode_id, unnest(kept) AS k FROM l)"""


def strongest(spark, sf_dir) -> DataFrame:
    return events.suppressed(trends(spark, sf_dir).where("abs(delta) > 0.08"), ["episode_id"], numbers.rounded(F.abs("delta"), 9), 86400.0)


@query("greedy_nms", NMS_SQL + " SELECT episode_id, round(k.lo, 3) AS lo, round(k.hi, 3) AS hi FROM k")
def greedy_nms(spark, sf_dir):
    return strongest(spark, sf_dir).select("episode_id", numbers.rounded(F.col("lo"), 3).alias("lo"), numbers.rounded(F.col("hi"), 3).alias("hi"))


@query("flat_window", f"WITH {TREND_SQL}, ex AS (SELECT episode_id, lo, hi FROM tw WHERE abs(h2 - h1) > 60), fr AS (SELECT * FROM tw WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.episode_id = tw.episode_id AND tw.lo < ex.hi + 60 AND tw.hi > ex.lo - 60)) SELECT episode_id, round(lo, 3) AS lo FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY round(abs(h2 - h1), 9), lo) AS r FROM fr) WHERE r = 1")
def flat_window(spark, sf_dir):
    found = trends(spark, sf_dir)
    return events.flat_window(found, found.where("abs(delta) > 60"), ["episode_id"]).select("episode_id", numbers.rounded(F.col("lo"), 3).alias("lo"))


@query("multi_speaker_window", f"""WITH {SQL_EV}, sp AS (SELECT episode_id, min("start") AS a, max("end") AS b FROM ev GROUP BY 1), w AS (SELECT episode_id, a + i * 86400.0::DOUBLE AS lo, a + i * 86400.0::DOUBLE + 172800 AS hi FROM (SELECT *, unnest(range(0, floor((b - a - 172800) / 86400.0::DOUBLE)::BIGINT + 1)) AS i FROM sp WHERE b - a >= 172800)),
p AS (SELECT episode_id, lo, hi, speaker, sum(least("end", hi) - greatest("start", lo)) AS c, avg(label_score) AS v, avg("end" - "start") AS d FROM ev JOIN w USING (episode_id) WHERE "end" > lo AND "start" < hi GROUP BY ALL HAVING sum(least("end", hi) - greatest("start", lo)) > 3600),
g AS (SELECT episode_id, lo, count(*) AS speakers, round(max(v) - min(v), 6) AS dv FROM p GROUP BY episode_id, lo, hi HAVING count(*) >= 2) SELECT episode_id, round(lo, 3) AS lo, speakers, 'label_score' AS dim, dv AS diff FROM g WHERE dv > 0.1""")
def multi_speaker_window(spark, sf_dir):
    found = events.speaker_windows(adapters.event_segments(spark, sf_dir), ["label_score"], 172800.0, 86400.0, 3600.0, 0.1)
    return found.select("episode_id", numbers.rounded(F.col("lo"), 3).alias("lo"), "speakers", "dim", "diff")


@query("event_cluster", f"""WITH {SQL_EV}, c AS (SELECT episode_id, label, "start", "end", count(*) OVER w AS n, max("end") OVER w AS l FROM ev WINDOW w AS (PARTITION BY episode_id, label ORDER BY "start" RANGE BETWEEN CURRENT ROW AND 200000 FOLLOWING))
SELECT episode_id, label, round(greatest(0, "start" - 30), 6) AS lo, round(l + 30, 6) AS hi, n FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, label ORDER BY "start", "end") AS r FROM c WHERE n >= 3) WHERE r = 1""")
def event_cluster(spark, sf_dir):
    return events.clusters(adapters.event_segments(spark, sf_dir), ["episode_id", "label"], 3, 200000).select("episode_id", "label", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query("neighbor_bounds", f"""WITH {SQL_EV} SELECT seg_id, round((SELECT max(b."end") FROM ev b WHERE b.episode_id = a.episode_id AND b.label = a.label AND b."end" <= a."start"), 6) AS prev_end, round((SELECT min(b."start") FROM ev b WHERE b.episode_id = a.episode_id AND b.label = a.label AND b."start" >= a."end"), 6) AS next_start FROM ev a""")
def neighbor_bounds(spark, sf_dir):
    return events.neighbour_bounds(adapters.event_segments(spark, sf_dir), ["episode_id", "label"]).select("seg_id", F.round("prev_end", 6).alias("prev_end"), F.round("next_start", 6).alias("next_start"))


@query("speaker_baseline_having", f"""WITH {SQL_EV} SELECT episode_id, speaker, round(avg(label_score), 6) AS mean, count(*) AS n FROM ev GROUP BY 1, 2 HAVING count(*) >= 5""")
def speaker_baseline_having(spark, sf_dir):
    by = adapters.event_segments(spark, sf_dir).groupBy("episode_id", "speaker").agg(F.round(F.avg("label_score"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
    return by.where("n >= 5")


@query("context_lookback", f"""WITH {SQL_EV} SELECT a.seg_id, count(*) AS n FROM ev a JOIN ev b ON a.episode_id = b.episode_id AND b."start" < a."start" AND b."start" >= a."start" - 100000 GROUP BY 1 HAVING count(*) >= 2""")
def context_lookback(spark, sf_dir):
    before = Window.partitionBy("episode_id").orderBy("start")
    e = adapters.event_segments(spark, sf_dir)
    n = F.count(F.lit(1)).over(before.rangeBetween(-100000, Window.currentRow)) - F.count(F.lit(1)).over(before.rangeBetween(Window.currentRow, Window.currentRow))
    return e.withColumn("n", n).where("n >= 2").select("seg_id", "n")


@query("vote_confidence", """WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r, sum(n) OVER (PARTITION BY user_id) AS total FROM v)
SELECT user_id, max(event_type) FILTER (r = 1) AS top, max(event_type) FILTER (r = 2) AS runner_up, round(max(n) FILTER (r = 1) / max(total)::DOUBLE, 3) AS cf FROM r GROUP BY 1""")
def vote_confidence(spark, sf_dir):
    votes = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id")
    ranked = votes.withColumn("r", F.row_number().over(w.orderBy(F.col("n").desc(), "event_type"))).withColumn("total", F.sum("n").over(w))
    at = lambda k, c: F.max(F.when(F.col("r") == k, F.col(c)))
    return ranked.groupBy("user_id").agg(at(1, "event_type").alias("top"), at(2, "event_type").alias("runner_up"), F.round(at(1, "n") / F.max("total"), 3).alias("cf"))


@query("best_clip_topk", f"""WITH {SQL_EV}, b AS (SELECT *, row_number() OVER (PARTITION BY speaker, episode_id ORDER BY label_score DESC, seg_id) AS r FROM ev), t AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY label_score DESC, seg_id) AS k FROM b WHERE r = 1) SELECT speaker, seg_id, k AS rank FROM t WHERE k <= 5""")
def best_clip_topk(spark, sf_dir):
    best = sampling.first_n(adapters.event_segments(spark, sf_dir), ["speaker", "episode_id"], [F.col("label_score").desc(), "seg_id"], 1)
    top = sampling.first_n(best, ["speaker"], [F.col("label_score").desc(), "seg_id"], 5)
    return top.select("speaker", "seg_id", F.row_number().over(Window.partitionBy("speaker").orderBy(F.col("label_score").desc(), "seg_id")).cast("long").alias("rank"))


@query("knn_clip_all", """WITH d AS (SELECT a.p_partkey AS a, b.p_partkey AS b, round(abs(a.p_size - b.p_size) + sqrt((a.p_retailprice - b.p_retailprice) ** 2), 6) AS d FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey) SELECT a, b, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d) WHERE r <= 3""")
def knn_clip_all(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return sampling.nearest_in_plane(p, "p_brand", "p_partkey", "p_size", "p_retailprice", 3).select("a", "b", "distance")


@query("clip_with_fallback", """WITH j AS (SELECT c.c_custkey, s.s_suppkey, (c.c_mktsegment = 'BUILDING') = (s.s_suppkey % 2 = 0) AS strict, s.s_acctbal FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey WHERE c.c_custkey % 100 <> s.s_suppkey) SELECT c_custkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY strict DESC, s_acctbal DESC, s_suppkey) AS r FROM j) WHERE r = 1""")
def clip_with_fallback(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", (F.col("c_mktsegment") == "BUILDING").alias("even"), (F.col("c_custkey") % 100).alias("own"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal", (F.col("s_suppkey") % 2 == 0).alias("even_key"), F.col("s_suppkey").alias("not_own"))
    picked = sampling.pool_pick(c, s, ["nation"], "c_custkey", "s_suppkey", [("own", "not_own")], [-F.col("s_acctbal")], ("even", "even_key"))
    return picked.where("s_suppkey is not null").select("c_custkey", "s_suppkey")


@query("clip_of_others", """WITH j AS (SELECT o.o_orderkey, s.event_id, s.value FROM orders o JOIN events s ON s.event_type = ['click', 'view', 'error', 'none'][1 + o.o_orderkey % 4] AND s.user_id <> o.o_custkey % 150 AND s.event_id % 7 <> o.o_orderkey % 7) SELECT o_orderkey, event_id FROM j QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY value DESC, event_id) = 1""")
def clip_of_others(spark, sf_dir):
    """For each order the best event of its kind that is of another user and of another seventh."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(k, F.element_at(F.array(*map(F.lit, ["click", "view", "error", "none"])), (k % 4 + 1).cast("int")).alias("event_type"), (F.col("o_custkey") % 150).alias("u"), (k % 7).alias("s"))
    e = read(spark, sf_dir, "events").select("event_type", "event_id", "value", F.col("user_id").cast("long").alias("user"), (F.col("event_id") % 7).alias("seventh"))
    picked = sampling.pool_pick(o, e, ["event_type"], "o_orderkey", "event_id", [("u", "user"), ("s", "seventh")], [-F.col("value")])
    return picked.where("event_id is not null").select("o_orderkey", "event_id")


@query("centroid_farthest", """WITH d AS (SELECT p_brand, p_partkey, round((p_size - avg(p_size) OVER w) ** 2 + (p_retailprice - avg(p_retailprice) OVER w) ** 2, 6) AS d FROM part WINDOW w AS (PARTITION BY p_brand)) SELECT p_brand, p_partkey, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY d DESC, p_partkey) AS r FROM d) WHERE r = 1""")
def centroid_farthest(spark, sf_dir):
    return sampling.centroid_far(read(spark, sf_dir, "part"), ["p_brand"], ["p_size", "p_retailprice"], "p_partkey").select("p_brand", "p_partkey", "distance")


# -- sampling and query generation

def draw_sql(x: str, seed: int = 42) -> str:
    return f"(({x} * {sampling.FACTOR} + {seed * 104_729}) % {sampling.PRIME})"


@query("stratified_pick", f"""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
b AS (SELECT *, CASE WHEN n <= 4 THEN r ELSE floor(r * 4 / n::DOUBLE)::BIGINT END AS bucket FROM r) SELECT o_custkey, bucket, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, bucket ORDER BY {draw_sql('o_orderkey')}, o_orderkey) AS p FROM b) WHERE p = 1""")
def stratified_pick(spark, sf_dir):
    return sampling.stratified(read(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_totalprice"), "o_orderkey", 4).select("o_custkey", "bucket", "o_orderkey")


@query("round_robin_deal", """WITH t AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS turn FROM orders), p AS (SELECT *, row_number() OVER (ORDER BY turn, o_orderpriority) - 1 AS place FROM t) SELECT o_orderkey, place, place % 50 AS hand FROM p""")
def round_robin_deal(spark, sf_dir):
    return sampling.round_robin(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"], 50).select("o_orderkey", F.col("place").cast("long").alias("place"), F.col("hand").cast("long").alias("hand"))


@query("pair_songs", f"""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {draw_sql('o_orderkey')}, o_orderkey) - 1 AS r FROM orders) SELECT o_custkey, r // 2 AS pair, min_by(o_orderkey, r) AS a, max_by(o_orderkey, r) AS b FROM r GROUP BY 1, 2 HAVING count(*) = 2""")
def pair_songs(spark, sf_dir):
    return sampling.paired(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "pair", "a", "b")


@query("grand_mean_winner", """WITH s AS (SELECT l_orderkey AS song, avg((l_quantity + l_discount * 100 + l_tax * 100) / 3) AS m FROM lineitem GROUP BY 1), o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders),
p AS (SELECT o_custkey, r // 2 AS pair, min_by(o_orderkey, r) AS a, max_by(o_orderkey, r) AS b FROM o GROUP BY 1, 2 HAVING count(*) = 2) SELECT a, b, round(x.m, 3) AS mean_a, round(y.m, 3) AS mean_b, CASE WHEN abs(round(x.m, 3) - round(y.m, 3)) <= 0.5 THEN 'tie' WHEN round(x.m, 3) > round(y.m, 3) THEN 'a' ELSE 'b' END AS winner FROM p JOIN s x ON x.song = a JOIN s y ON y.song = b""")
def grand_mean_winner(spark, sf_dir):
    m = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("song")).agg(F.round(F.avg((F.col("l_quantity") + F.col("l_discount") * 100 + F.col("l_tax") * 100) / 3), 3).alias("m"))
    o = read(spark, sf_dir, "orders").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    p = o.groupBy("o_custkey", F.floor(F.col("r") / 2)).agg(F.min_by("o_orderkey", "r").alias("a"), F.max_by("o_orderkey", "r").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 2")
    j = p.join(m.select(F.col("song").alias("a"), F.col("m").alias("mean_a")), "a").join(m.select(F.col("song").alias("b"), F.col("m").alias("mean_b")), "b")
    return j.select("a", "b", "mean_a", "mean_b", numbers.winner(F.col("mean_a"), F.col("mean_b"), 0.5).alias("winner"))


@query("time_reference", """WITH s AS (SELECT o_orderkey, (o_orderkey % 300)::DOUBLE AS a, (o_orderkey % 300 + 60 + o_custkey % 240)::DOUBLE AS b FROM orders), g AS (SELECT o_orderkey, (ceil((a + 30) / 30.0) * 30)::BIGINT AS lo, (floor((b - 30) / 30.0) * 30)::BIGINT AS hi FROM s)
SELECT o_orderkey, CASE WHEN lo <= hi THEN lo + 30 * (((hi - lo) // 30 + 1) // 2) END AS ref FROM g""")
def time_reference(spark, sf_dir):
    a = (F.col("o_orderkey") % 300).cast("double")
    ref = numbers.aligned_middle(a, a + 60 + F.col("o_custkey") % 240)
    return read(spark, sf_dir, "orders").select("o_orderkey", ref.alias("ref"))


# -- scores

@query("scorecard_macro", f"""WITH {SQL_SC}, t AS (SELECT variant, query_type, avg(answer) AS answer, avg(factual) AS factual, count(*) AS n FROM sc GROUP BY 1, 2), u AS (SELECT * FROM t UNION ALL SELECT variant, 'overall', avg(answer), avg(factual), sum(n)::BIGINT FROM t GROUP BY 1) SELECT variant, query_type, round(answer, 6) AS answer, round(factual, 6) AS factual, n FROM u""")
def scorecard_macro(spark, sf_dir):
    return metrics.scorecard(adapters.scores(spark, sf_dir), ["answer", "factual"]).select("variant", "query_type", F.round("answer", 6).alias("answer"), F.round("factual", 6).alias("factual"), "n")


@query("scorecard_pivot", f"""WITH {SQL_SC} SELECT variant, round(avg(answer) FILTER (query_type = 'en'), 6) AS en, round(avg(answer) FILTER (query_type = 'fr'), 6) AS fr, round(avg(answer) FILTER (query_type = 'de'), 6) AS de, round(avg(answer) FILTER (query_type = 'es'), 6) AS es FROM sc GROUP BY 1""")
def scorecard_pivot(spark, sf_dir):
    kinds = ["en", "fr", "de", "es"]
    return metrics.scorecard_pivot(adapters.scores(spark, sf_dir), "answer", kinds).select("variant", *[F.round(k, 6).alias(k) for k in kinds])


@query("human_micro_rollup", f"""WITH {SQL_SC}, v AS (SELECT variant, query_type, CASE WHEN query_id % 7 <> 0 THEN answer END AS answer FROM sc) SELECT variant, CASE WHEN grouping(query_type) = 1 THEN 'all' ELSE query_type END AS query_type, round(avg(answer), 6) AS mean, count(answer) AS n FROM v GROUP BY GROUPING SETS ((variant, query_type), (variant))""")
def human_micro_rollup(spark, sf_dir):
    s = adapters.scores(spark, sf_dir).withColumn("answer", F.when(F.col("query_id") % 7 != 0, F.col("answer")))
    return metrics.micro(s, "answer", ["variant"]).select("variant", "query_type", F.round("mean", 6).alias("mean"), "n")


KAPPA_SQL = "CASE WHEN avg({a}) * avg({b}) + (1 - avg({a})) * (1 - avg({b})) >= 1 THEN 1.0 ELSE round((avg(({a} = {b})::INT) - (avg({a}) * avg({b}) + (1 - avg({a})) * (1 - avg({b})))) / (1 - (avg({a}) * avg({b}) + (1 - avg({a})) * (1 - avg({b})))), 6) END"


@query("cohen_kappa", f"WITH {SQL_SC} SELECT query_type, {KAPPA_SQL.format(a='answer', b='factual')} AS kappa FROM sc GROUP BY 1")
def cohen_kappa(spark, sf_dir):
    return adapters.scores(spark, sf_dir).groupBy("query_type").agg(F.round(metrics.cohen(F.col("answer"), F.col("factual")), 6).alias("kappa"))


@query("fleiss_kappa", f"""WITH {SQL_SC}, n AS (SELECT query_type, (answer + factual + third)::DOUBLE AS k FROM sc), a AS (SELECT query_type, avg((k * (k - 1) + (3 - k) * (2 - k)) / 6) AS o, avg(k) / 3 AS p FROM n GROUP BY 1) SELECT query_type, CASE WHEN p * p + (1 - p) * (1 - p) >= 1 THEN 1.0 ELSE round((o - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))), 6) END AS kappa FROM a""")
def fleiss_kappa(spark, sf_dir):
    total = F.col("answer") + F.col("factual") + F.col("third")
    return adapters.scores(spark, sf_dir).groupBy("query_type").agg(F.round(metrics.fleiss(total, 3), 6).alias("kappa"))


@query("judge_agreement", f"""WITH {SQL_SC} SELECT variant, {KAPPA_SQL.format(a='answer', b='third')} AS kappa, round(avg((answer + factual + third IN (0, 3))::INT), 6) AS unanimous, round(avg(answer), 6) AS mean_answer, round(avg(third), 6) AS mean_third, count(*) AS n FROM sc GROUP BY 1""")
def judge_agreement(spark, sf_dir):
    a = metrics.agreement(adapters.scores(spark, sf_dir), ["answer", "factual", "third"], ["variant"])
    return a.select("variant", F.round("kappa_answer_third", 6).alias("kappa"), F.round("unanimous", 6).alias("unanimous"), F.round("mean_answer", 6).alias("mean_answer"), F.round("mean_third", 6).alias("mean_third"), "n")


JUDGES_SQL = "j AS (SELECT doc_id AS query_id, 'a' AS judge FROM labels UNION ALL SELECT doc_id, 'b' FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'c' FROM labels WHERE doc_id % 3 = 0)"


@query("judge_intersection", f"WITH {JUDGES_SQL} SELECT query_id FROM j GROUP BY 1 HAVING count(DISTINCT judge) = 3")
def judge_intersection(spark, sf_dir):
    ids = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"))
    rows = ids.withColumn("judge", F.lit("a")).unionByName(ids.where("query_id % 2 = 0").withColumn("judge", F.lit("b"))).unionByName(ids.where("query_id % 3 = 0").withColumn("judge", F.lit("c")))
    return metrics.rated_by_all(rows, 3)


@query("resume_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf_dir):
    return sinks.resume(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


@query("exclude_anti", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def exclude_anti(spark, sf_dir):
    return sinks.resume(read(spark, sf_dir, "labels").select("doc_id", "quality"), read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id")


@query("upsert_latest", """WITH o AS (SELECT doc_id, quality, toxic, doc_id AS ord FROM labels), n AS (SELECT doc_id + 0 AS doc_id, 9 AS quality, 9 AS toxic, doc_id AS ord FROM labels WHERE doc_id % 5 = 0 UNION ALL SELECT item_id + 10000000, 7, 7, item_id FROM benchmark)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.quality, o.quality) AS quality, CASE WHEN n.doc_id IS NULL THEN 0 ELSE 1 END AS version, coalesce(o.ord, n.ord) AS first_seen FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def upsert_latest(spark, sf_dir):
    old = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.col("doc_id").alias("ord"))
    new = old.where("doc_id % 5 = 0").select("doc_id", F.lit(9).alias("quality"), F.lit(9).alias("toxic"), "ord")
    new = new.unionByName(read(spark, sf_dir, "benchmark").select((F.col("item_id") + 10000000).alias("doc_id"), F.lit(7).alias("quality"), F.lit(7).alias("toxic"), F.col("item_id").alias("ord")))
    return sinks.upsert(old, new, "doc_id").select("doc_id", "quality", "version", "first_seen")


@query("partial_upsert", """SELECT l.doc_id, CASE WHEN l.doc_id % 5 = 0 THEN 9 ELSE quality END AS quality, toxic FROM labels l UNION ALL SELECT item_id + 10000000, 9, 8 FROM benchmark""")
def partial_upsert(spark, sf_dir):
    old = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    new = old.where("doc_id % 5 = 0").select("doc_id", F.lit(9).alias("quality"), F.lit(8).alias("toxic"))
    new = new.unionByName(read(spark, sf_dir, "benchmark").select((F.col("item_id") + 10000000).alias("doc_id"), F.lit(9).alias("quality"), F.lit(8).alias("toxic")))
    return sinks.partial_upsert(old, new, "doc_id", ["quality"])


@query("label_merge_nonnull", """SELECT doc_id, CASE WHEN quality = 1 THEN 'good' END AS first, CASE WHEN toxic = 1 THEN 'bad' END AS second, coalesce(CASE WHEN toxic = 1 THEN 'bad' END, CASE WHEN quality = 1 THEN 'good' END) AS merged FROM labels""")
def label_merge_nonnull(spark, sf_dir):
    a, b = F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "bad")
    merged = numbers.merged_labels(F.create_map(F.lit("primary"), a), F.create_map(F.lit("primary"), b))
    return read(spark, sf_dir, "labels").select("doc_id", a.alias("first"), b.alias("second"), F.element_at(merged, "primary").alias("merged"))


@query("episode_admission", """WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS train, count(*) FILTER (o_orderstatus = 'O') AS test FROM orders GROUP BY 1) SELECT o_custkey, train, test FROM c WHERE train < 10 AND CASE WHEN test = 0 THEN 'inf'::DOUBLE ELSE train / test::DOUBLE END < 0.5""")
def episode_admission(spark, sf_dir):
    c = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("train"), F.count_if(F.col("o_orderstatus") == "O").alias("test"))
    return c.where((F.col("train") < 10) & (F.when(F.col("test") == 0, F.lit(float("inf"))).otherwise(F.col("train") / F.nullif(F.col("test"), F.lit(0))) < 0.5))


@query("quality_reject_cascade", """WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 2000 AS pool, CASE WHEN l_quantity < 5 THEN 'short' WHEN l_discount > 0.08 THEN 'clipped' WHEN l_tax > 0.06 THEN 'noisy' ELSE '' END AS reason FROM lineitem) SELECT l_orderkey, l_linenumber, reason, pool AND reason = '' AS selected FROM r WHERE pool""")
def quality_reject_cascade(spark, sf_dir):
    reason = F.when(F.col("l_quantity") < 5, "short").when(F.col("l_discount") > 0.08, "clipped").when(F.col("l_tax") > 0.06, "noisy").otherwise("")
    pool = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", reason.alias("reason")).orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber").limit(2000)
    return pool.select("l_orderkey", "l_linenumber", "reason", (F.col("reason") == "").alias("selected"))


#: The groups of tools that types need, as a table of its own for the SQL.
GROUPS_SQL = """need(t, g) AS (VALUES ('state', ['audio_emb']), ('state', ['text_emb', 'keyword']), ('comparison', ['audio_emb']), ('comparison', ['text_emb', 'keyword']), ('change', ['audio_emb']), ('change', ['text_emb', 'keyword']),
    ('locate', ['audio_emb']), ('locate', ['domain_emb']), ('locate', ['label']), ('locate_hard', ['domain_emb']), ('locate_hard', ['label']), ('audio', ['audio_emb', 'domain_emb']))"""
KINDS = ["state", "locate", "change", "comparison", "locate_hard", "audio", "position"]
ACTIVE = [["audio_emb", "keyword"], ["domain_emb"], ["label", "text_emb"], ["time"], []]


@query("plan_hit_rate", f"""WITH {WINDOWS_SQL}, {SQL_EV}, {GROUPS_SQL}, c AS (SELECT episode_id AS query_id, avg(CASE WHEN EXISTS (SELECT 1 FROM win w WHERE w.episode_id = ev.episode_id AND ev."end" > w.lo AND ev."start" < w.hi) THEN 1.0 ELSE 0.0 END) AS tc FROM ev GROUP BY 1),
k AS (SELECT query_id, tc, {KINDS}[1 + query_id % 7] AS t, CASE query_id % 5 WHEN 0 THEN ['audio_emb', 'keyword'] WHEN 1 THEN ['domain_emb'] WHEN 2 THEN ['label', 'text_emb'] WHEN 3 THEN ['time'] ELSE [] END AS active FROM c),
h AS (SELECT query_id, count(*) AS groups, count(*) FILTER (list_has_any(g, active)) AS hits FROM k JOIN need USING (t) GROUP BY 1)
SELECT query_id, t AS query_type, round(CASE WHEN query_id % 11 = 0 THEN 1.0 WHEN groups IS NULL THEN tc ELSE (tc + hits) / (1 + groups) END, 6) AS plan_hit_rate FROM k LEFT JOIN h USING (query_id)""")
def plan_hit_rate(spark, sf_dir):
    cover = intervals.coverage(adapters.event_segments(spark, sf_dir).select("episode_id", "seg_id", "start", "end"), windows_of(spark, sf_dir), bucket=50000.0).withColumnRenamed("episode_id", "query_id")
    pick = lambda values, n: F.element_at(F.array(*values), (F.col("query_id") % n + 1).cast("int"))
    kinds = cover.select("query_id", pick([F.lit(x) for x in KINDS], 7).alias("query_type"), (F.col("query_id") % 11 == 0).alias("oracle"))
    tools = cover.select("query_id", pick([F.array(*map(F.lit, x)).cast("array<string>") for x in ACTIVE], 5).alias("active"))
    return metrics.plan_hit_rate(cover, tools, kinds).select("query_id", "query_type", F.round("plan_hit_rate", 6).alias("plan_hit_rate"))


@query("vector_append_ordinals", """WITH n AS (SELECT *, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings) SELECT vec_id, 1000 + row_number() OVER (ORDER BY vec_id) - 1 AS idx, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: (x / n) * (x / n))), 6) AS norm, round(embedding[1] / n, 6) AS first FROM n""")
def vector_append_ordinals(spark, sf_dir):
    made = sinks.vectors_to_append(read(spark, sf_dir, "embeddings"), 1000, 64, ["vec_id"])
    return made.select("vec_id", "idx", F.round(numbers.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"), F.round(F.col("embedding")[0], 6).alias("first"))


@query("trace_halves", """WITH m AS (SELECT user_id, value, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), h AS (SELECT user_id, avg(value) AS mean, min(value) AS least, max(value) AS most, avg(value) FILTER (n <= c // 2) AS h1, avg(value) FILTER (n > c // 2) AS h2 FROM m GROUP BY 1)
SELECT user_id, round(mean, 6) AS mean, least, most, CASE WHEN h2 - h1 > 0.05 THEN 'rising' WHEN h2 - h1 < -0.05 THEN 'falling' ELSE 'stable' END AS trend FROM h""")
def trace_halves(spark, sf_dir):
    return events.halves(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", F.round("mean", 6).alias("mean"), "least", "most", "trend")


@query("clip_quality_filter", """SELECT event_id FROM events WHERE event_type = 'click' AND value >= 20 AND coalesce(json_extract(props, '$.k')::BIGINT, 0) BETWEEN 3 AND 80""")
def clip_quality_filter(spark, sf_dir):
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0))
    return read(spark, sf_dir, "events").where((F.col("event_type") == "click") & (F.col("value") >= 20) & k.between(3, 80)).select("event_id")


@query("quantile_features", """SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.1), 6) AS p10, round(stddev_pop(value), 6) AS sd FROM events GROUP BY 1""")
def quantile_features(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.9), 6).alias("p90"), F.round(F.percentile("value", 0.1), 6).alias("p10"), F.round(F.stddev_pop("value"), 6).alias("sd"))
