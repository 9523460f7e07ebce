"""The registered queries of this subpackage: opN_<name>(spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laconic.llm import chat, langid, licenses, line_dedup, mixing, sharding
from laconic.llm.common import remainder, table
from laconic.llm.decontaminate import contamination
from laconic.llm.fingerprints import fingerprints
from laconic.llm.jaccard import near_duplicates
from laconic.llm.toxicity import fit, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, n=4, percent=85)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    scored = toxicity(docs, fit(docs, learn))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_passages")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(remainder("doc_id", 3) != 1))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = mixing.planned(docs)
    at = mixing.position(F.col("_number") % len(mixing.SCHEDULES), mixing.share_done(F.lit(0)))
    rows = rows.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), F.round(F.when(F.col("_taken") > 0, at), 6).alias("position"))
    return rows.orderBy("position", "doc_id")


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query
def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotations(table(spark, sf_dir, "conversations"))


ORACLE["op7_chat_rotation"] = """
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
r AS (SELECT m.conv_id, perspective, turn, speaker, body,
        '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head
      FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS segment, CAST(speaker = perspective AS INTEGER) AS loss FROM r),
o AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_end FROM s)
SELECT conv_id, perspective, turn, speaker, segment, loss, char_end - length(segment) AS char_start, char_end,
  CASE WHEN loss = 1 THEN char_end - length(segment) + length(head) END AS loss_start, CASE WHEN loss = 1 THEN char_end - 1 END AS loss_end FROM o
"""

ORACLE["op2_mixing"] = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, CAST(number % 3 + 1 AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS lim FROM s),
l AS (SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM s) - coalesce(sum(lim) OVER (ORDER BY lim / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY lim / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, number, source_size, least(lim, (SELECT max(level) FROM l) * weight) AS target FROM l),
o AS (SELECT d.*, t.number, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS quota,
        CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS off
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS passes FROM o),
k AS (SELECT *, CAST(passes * size + greatest(0, least(size, quota - passes * source_size - off)) AS BIGINT) AS taken, CASE WHEN target > 0 THEN off / target ELSE 0 END AS y FROM f)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken,
  round(CASE WHEN taken > 0 THEN CASE number % 3
    WHEN 0 THEN least((sqrt(greatest(0, 2.25 - 2 * y)) - 1.5) / -1.0, 1)
    WHEN 1 THEN least(y, 1)
    ELSE CASE WHEN y < 0.375 THEN least(sqrt(0.25 + 2 * y) - 0.5, 0.5) ELSE least(0.5 + sqrt(1 + 2 * (y - 0.375)) - 1, 1) END END END, 6) + 0.0 AS position
FROM k
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op9_decontamination"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS r, coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
win AS (SELECT r, item, k, j, array_to_string(w[j:j + k - 1], ' ') AS win FROM (SELECT r, item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j FROM b WHERE len(w) > 0)),
dk AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hit AS (SELECT doc_id, r, item, i, j, dk.k FROM dk JOIN win ON dk.k = win.k AND array_to_string(w[i:i + dk.k - 1], ' ') = win.win),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit),
run AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, r, i - j ORDER BY i) AS g FROM hit),
mat AS (SELECT doc_id, item, min(i) - 1 AS p, min(j) - 1 AS there, count(*) + any_value(k) - 1 AS n FROM isl GROUP BY doc_id, r, item, i - j, g),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p, item, there) AS nth FROM mat)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) AS longest_match, p AS match_start, top.item AS match_item, there AS match_at, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN run USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN top ON d.doc_id = top.doc_id AND nth = 1
"""

ORACLE["op8_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^ \\t-\\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * k >= 85 * (p.n + q.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(seen) FROM r WHERE node = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""

#: White space of Unicode, as str.strip and str.split take it.
_BLANK = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

ORACLE["op4_line_dedup"] = f"""
WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text <> ''),
l AS (SELECT *, regexp_replace(line, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') AS s FROM x),
t AS (SELECT doc_id, pos, s, len(regexp_extract_all(s, '[^{_BLANK}]+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, sum(len(regexp_extract_all(s, '[^{_BLANK}]+'))) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS total FROM l WHERE s <> ''),
p AS (SELECT a.doc_id, a.k AS f, b.k AS e FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.total - a.total + a.n >= 50),
w AS (SELECT doc_id, f, min(e) AS e FROM p GROUP BY doc_id, f UNION SELECT doc_id, max(f), e FROM p GROUP BY doc_id, e),
v AS (SELECT w.doc_id, f, e, min(pos) AS first, string_agg(s, chr(10) ORDER BY k) AS body FROM w JOIN t ON w.doc_id = t.doc_id AND k BETWEEN f AND e GROUP BY w.doc_id, f, e),
o AS (SELECT *, min({{'d': doc_id, 'p': first}}) OVER (PARTITION BY body) AS origin FROM v),
g AS (SELECT DISTINCT t.doc_id, t.pos FROM o JOIN t ON o.doc_id = t.doc_id AND k BETWEEN f AND e WHERE {{'d': o.doc_id, 'p': first}} > origin),
r AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS left_over FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(left_over, text) AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN r USING (doc_id)
"""
