"""Queries of the training-data operators and, where SQL can express them, the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, media, merkle, neardup, packing, pagetext, quality, runs, substrings, tokencount, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digest(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counted(table(spark, sf_dir, "documents"), tokencount.read_pieces())


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digest(rows.unionByName(hard))


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extracted(table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), urls.PLACED + urls.PATTERNS)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the labels; one row per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.scored(docs, model).withColumn("kept", ~F.col("rejected"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where all words of a benchmark item stand near each other in a document, in any order: the index's proximity matches."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), within=20)


def reply_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best branches of each conversation read as a tree, in which a turn answers the one with half its number."""
    t = F.col("turn")
    nodes = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), t.cast("long").alias("node"), F.when(t > 0, F.floor((t - 1) / 2)).alias("parent"), "role", "text", (F.length("text") % 7).cast("double").alias("score"))
    told = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return chat.conversations(nodes, 2).select(F.col("conv").alias("conv_id"), "leaf", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_decontaminate": op2_decontaminate,
    "op3_near_dedup": op3_near_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_media": op5_media,
    "op6_token_counts": op6_token_counts,
    "op7_chat_format": op7_chat_format,
    "op8_page_text": op8_page_text,
    "op9_url_filter": op9_url_filter,
    "op10_quality": op10_quality,
    "op11_toxicity": op11_toxicity,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
    "benchmark_proximity": benchmark_proximity,
    "reply_branches": reply_branches,
}

SQL: dict[str, str] = {}

SQL["op4_substring_dedup"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS least FROM s GROUP BY h),
hit AS (SELECT s.doc_id, s.i FROM s JOIN m USING (h) WHERE m.least < s.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, range(0, 50) AS r(k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

SQL["op3_near_dedup"] = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
two AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, t.b FROM reach r JOIN two t ON r.b = t.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

SQL["op2_decontaminate"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
spot AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, spot.k, i, item_id FROM spot JOIN win ON spot.s = win.s AND spot.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS h FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(h, sha256('')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

SQL["op7_chat_format"] = """
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;') AS er, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS et FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length('<|im_start|>') + length(er) + 1 + length(et) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

SQL["op9_url_filter"] = """
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
v AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|\\.)(cheap-pills|spam-farm|free-bets|casino(-[a-z]+)?|adult(-[a-z]+)?|ads(-[a-z]+)?)\\.') THEN 'block' ELSE 'allow' END AS verdict FROM v
"""

SQL["reply_branches"] = """
WITH RECURSIVE n AS (SELECT conv_id, turn AS node, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(length(text) % 7, 0)::DOUBLE AS s FROM conversations),
p AS (SELECT conv_id, node AS leaf, node, parent, s, role, text FROM n WHERE NOT EXISTS (SELECT 1 FROM n c WHERE c.conv_id = n.conv_id AND c.parent = n.node) UNION ALL SELECT p.conv_id, p.leaf, n.node, n.parent, n.s, n.role, n.text FROM p JOIN n ON n.conv_id = p.conv_id AND n.node = p.parent),
b AS (SELECT conv_id, leaf, min(node) AS top, avg(s) AS score, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY node) AS t FROM p GROUP BY 1, 2)
SELECT conv_id, leaf::BIGINT AS leaf, n::BIGINT AS n_turns, sha256(t) AS turns_sha256 FROM b QUALIFY row_number() OVER (PARTITION BY conv_id, top ORDER BY score DESC, leaf) <= 2
"""

#: One row: the unsigned crc32 of a number in decimal as a list function of its digits needs a table of 256 entries, made from the polynomial.
CRC = """crc AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(b)))"""
CRC_OF = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)"""

SQL["op12_periodic_runs"] = f"""
WITH {CRC},
o AS (SELECT doc_id, {CRC_OF} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents, crc),
s AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM o),
p AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM s),
d AS (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_concat(w[1:a], list_transform(range(a, len(w)), lambda i: w[a + (i - a) % p + 1])) END AS w FROM p),
x AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM x JOIN x y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
isle AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same),
run AS (SELECT doc_id, min(i) AS s, count(*) + q AS l, q FROM isle GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT doc_id, s, l, min(q) AS q FROM run GROUP BY doc_id, s, l),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
kept AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS h FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
told AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS h FROM r GROUP BY doc_id),
best AS (SELECT doc_id, s, l, q FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) = 1)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli,
    coalesce(told.h, sha256('')) AS runs_sha256, coalesce(kept.h, sha256('')) AS collapsed_sha256, len(w)::BIGINT AS n_words
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

FIELDS = "{doc} || {source} || {lang} || {n} || {text}".format(**{k: f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for k, v in {"doc": "doc_id", "source": "source", "lang": "lang", "n": "N_CHARS", "text": "text"}.items()})

SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE {CRC},
l AS (SELECT doc_id, coalesce('=' || lang, '') AS k, sha256({FIELDS.replace("N_CHARS", "n_chars")}) AS leaf, sha256({FIELDS.replace("N_CHARS", "(n_chars + 1)")}) AS other, {CRC_OF} % 7 = 0 AS t FROM documents, crc),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM l),
nodes(k, level, i, n, h) AS (SELECT k, 0, i, n, leaf FROM o
    UNION ALL SELECT k, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY k, level, i // 2, n),
sub AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, i, n, h) AS (SELECT 0, i, n, subroot FROM sub
    UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
f(doc_id, k, level, i, n, h, proof) AS (SELECT doc_id, k, 0, i, n, CASE WHEN t THEN coalesce(other, leaf) ELSE leaf END, '' FROM o
    UNION ALL SELECT f.doc_id, f.k, f.level + 1, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.i % 2 = 0 THEN f.h || s.h ELSE s.h || f.h END), f.proof || coalesce(s.h, '')
    FROM f LEFT JOIN nodes s ON s.k = f.k AND s.level = f.level AND s.i = xor(f.i, 1) WHERE f.n > 1),
g(doc_id, k, level, i, n, h, proof) AS (SELECT doc_id, f.k, 0, sub.i, sub.n, f.h, f.proof FROM f JOIN sub ON sub.k = f.k WHERE f.n = 1
    UNION ALL SELECT g.doc_id, g.k, g.level + 1, g.i // 2, (g.n + 1) // 2, sha256(CASE WHEN s.h IS NULL THEN g.h WHEN g.i % 2 = 0 THEN g.h || s.h ELSE s.h || g.h END), g.proof || coalesce(s.h, '')
    FROM g LEFT JOIN tops s ON s.level = g.level AND s.i = xor(g.i, 1) WHERE g.n > 1)
SELECT o.doc_id, o.leaf, sub.subroot, tops.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = tops.h AS verified
FROM o JOIN sub ON sub.k = o.k JOIN g ON g.doc_id = o.doc_id AND g.n = 1 JOIN tops ON tops.n = 1
"""
