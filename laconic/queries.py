"""Registered queries over the supplied tables, and the same in SQL where SQL can say it.

`documents` stand in for tool outputs, turns of `conversations` for calls
and outputs, `events` for timed facts; commands are taken in turn from a
fixed list by the document's id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laconic.config import CHAR_BUDGET, EngineConfig
from laconic.functions import commands
from laconic.functions import text as tx
from laconic.operators import detect, hints, outputs, pages, stats
from laconic.operators.condense import condensed, rules
from laconic.plans import audit
from laconic.plans.compress import compressed
from laconic.plans.requests import processed
from laconic.rules import detectors
from laconic.rules.filters import Filter, builtin
from laconic.sources import requests, sessions, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

COMMANDS = ["git status", "cargo build --release", "cat src/main.rs", "rg needle src", "pytest -q", "docker ps", "npm run build", "ls -la", "sed -n 1,20p a.txt", "./mytool --run", "python script.py", "curl -i https://example.com", "jq . a.json", "make all", "go test ./..."]
CALLS = [
    ("Bash", '{"command": "ls -la"}'), ("mcp__server__bash", '{"cmd": "git status"}'), ("ns.read", '{"file_path": "src/a.rs"}'), ("Read", '{"path": "x y.txt"}'), ("grep", '{"pattern": "it\'s", "path": "src"}'), ("search_files", '{"query": "foo", "include": "*.py"}'),
    ("Glob", "{}"), ("list_dir", '{"dir": "lib"}'), ("unknown_tool", '{"command": "ls"}'), ("bash", "not json"), ("bash", '{"command": "  "}'), ("bash", '{"command": 5, "script": "make"}'), ("view", '["a"]'),
]
TYPED = ["python3 - <<'PY'", "python3 -c 'x'", "python -m venv e", "cd /tmp", "node a.js", "sudo make", "/opt/x/run --y", "brew install z", "frobnicate", "git statusx", "python -m pytest", "env A=1 cargo build", "swift package", "./a.sh"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text"))).where("text is not null")


def command_of(doc_id: str = "doc_id") -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in COMMANDS]), (F.pmod(F.col(doc_id), F.lit(len(COMMANDS))) + 1).cast("int"))


SQL_COMMAND = f"list_extract([{', '.join(map(q, COMMANDS))}], CAST(doc_id % {len(COMMANDS)} AS INTEGER) + 1)"
SQL_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL"
#: White space, word characters and digits of Unicode, as parts of RE2 classes: RE2's own \s, \w, \d and \b know ASCII only.
RE2 = {"s": r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}", "w": r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}", "d": r"\p{Nd}"}
#: A word character outside ASCII.
RE2_WORD = "(?:" + "|".join(rf"[^\x00-\x7F\P{{{x}}}]" for x in ("L", "M", "Nd", "Nl", "Pc")) + r"|[\x{200C}\x{200D}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}])"


def re2(pattern: str, edges: bool = True) -> str:
    r"""The pattern for RE2 with classes of Unicode; edges: each \b, which must come in pairs around a word, takes the character next to it (for tests, not for replacements)."""
    out, i, inside, opened = [], 0, False, False
    pattern = pattern.replace(r"[\s\S]", r"[\x{0}-\x{10FFFF}]")
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            x = pattern[i + 1]
            if x in RE2:
                c = RE2[x] if inside else f"[{RE2[x]}]"
            elif x.lower() in RE2:
                assert not inside, pattern
                c = f"[^{RE2[x.lower()]}]"
            elif x == "b" and edges:
                opened = not opened
                c = rf"(?:{r'\A' if opened else r'\z'}|[^{RE2['w']}])"
            else:
                c += x
            i += 1
        elif c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        out.append(c)
        i += 1
    return "".join(out)


SQL_ERROR = q(re2(tx.ERROR_LINE))
SQL_FILLED, SQL_TRIM = q(re2(r"\S")), q(re2(r"^\s+|\s+$"))
SQL_FOLDED = f"""
l AS ({SQL_LINES}),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS island FROM l),
r AS (SELECT doc_id, line, min(pos) AS p, count(*) AS n FROM g GROUP BY doc_id, line, island),
f AS (SELECT doc_id, string_agg(CASE WHEN n >= 3 AND regexp_matches(line, '\\S') THEN line || chr(10) || '[rtk:dropped ' || (n - 1) || ' repeated lines]' ELSE left(repeat(line || chr(10), CAST(n AS INTEGER)), CAST(n * (length(line) + 1) - 1 AS BIGINT)) END, chr(10) ORDER BY p) AS folded FROM r GROUP BY doc_id)
"""


@query(f"""
WITH {SQL_FOLDED}
SELECT source, count(*) AS messages, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS original, CAST(sum((length(folded) + 3) // 4) AS BIGINT) AS compressed,
  CAST(sum(greatest((length(text) + 3) // 4 - (length(folded) + 3) // 4, 0)) AS BIGINT) AS saved
FROM documents d JOIN f ON d.doc_id = f.doc_id GROUP BY source
""")
def savings_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "doc_id", "text", "source").select("source", tx.tokens("text").alias("original"), tx.tokens(tx.fold_runs(tx.strip_ansi("text"))).alias("compressed"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("messages"), F.sum("original").alias("original"), F.sum("compressed").alias("compressed"), F.sum(stats.saved()).alias("saved"))


@query("SELECT lang, count(*) AS n, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL GROUP BY lang")
def token_estimate_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "text", "lang").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(tx.tokens("text")).alias("tokens"))


@query("SELECT doc_id, regexp_replace(chr(27) || '[31;1m' || text || chr(27) || '[0m' || chr(27) || '[?25l', '\\x1b\\[[0-?]*[ -/]*[@-~]', '', 'g') AS plain FROM documents WHERE text IS NOT NULL")
def ansi_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    esc = F.lit("\x1b")
    return documents(spark, sf_dir).select("doc_id", tx.strip_ansi(F.concat(esc, F.lit("[31;1m"), "text", esc, F.lit("[0m"), esc, F.lit("[?25l"))).alias("plain"))


@query(f"SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(CASE doc_id % 3 WHEN 0 THEN ' STDERR | ' WHEN 1 THEN 'err: ' ELSE 'error: ' END || x, {q(re2(tx.STDERR))}, '')), chr(10)) AS stripped FROM documents WHERE text IS NOT NULL")
def stderr_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 3 == 0, " STDERR | ").when(F.col("doc_id") % 3 == 1, "err: ").otherwise("error: ")
    return documents(spark, sf_dir).select("doc_id", tx.joined(F.transform(tx.lines_lf("text"), lambda x: tx.strip_stderr(F.concat(head, x)))).alias("stripped"))


@query("SELECT source, strlen(text) <= 2000 AND length(text) - length(replace(text, chr(10), '')) < 30 AS is_short, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def short_output_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "text", "source").groupBy("source", tx.is_short_output("text", F.lit("unknown")).alias("is_short")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH l AS ({SQL_LINES}), p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(NOT regexp_matches(line, '\\S') AS INTEGER)) AS BIGINT) AS blank, CAST(sum(CAST(coalesce(line = before, false) AS INTEGER)) AS BIGINT) AS twice FROM p GROUP BY doc_id
""")
def line_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda a: F.size(a).cast("long")
    p = tx.let(tx.lines_lf("text"), lambda L: F.struct(size(L).alias("n_lines"), size(F.filter(L, lambda x: ~x.rlike(r"\S"))).alias("blank"), size(F.filter(L, lambda x, i: (i > 0) & (x == tx.before(L, i)))).alias("twice")))
    return documents(spark, sf_dir).select("doc_id", p.alias("p")).select("doc_id", "p.*")


@query(f"WITH {SQL_FOLDED} SELECT doc_id, folded FROM f")
def run_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tx.fold_runs("text").alias("folded"))


@query(f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), n AS (SELECT unnest(range({outputs.SHORTEST_BLOCK}, {outputs.LONGEST_BLOCK + 1})) AS size),
k AS (SELECT doc_id, CAST(size AS INTEGER) AS size, l, unnest(range(1, len(l) - size + 2)) AS pos FROM l, n WHERE len(l) >= size),
b AS (SELECT doc_id, size, pos, md5(array_to_string(l[pos:pos + size - 1], chr(10))) AS block FROM k)
SELECT doc_id, size, block, CAST(min(pos) - 1 AS INTEGER) AS first_pos, count(*) AS n FROM b GROUP BY doc_id, size, block HAVING count(*) > 1
""")
def block_repeat_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("array<struct<size: int, block: string, first_pos: int, n: bigint>>")
    def blocks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"size": k, "block": hashlib.md5(b.encode("utf-8", "surrogatepass")).hexdigest(), "first_pos": i, "n": n} for k, b, i, n in outputs.repeated_blocks(t)])

    return documents(spark, sf_dir).select("doc_id", F.explode(blocks("text")).alias("b")).select("doc_id", "b.*")


@query(f"WITH l AS ({SQL_LINES}) SELECT doc_id, CAST(count(*) FILTER (WHERE regexp_matches(line, {SQL_ERROR})) AS INTEGER) AS errors, CAST(count(*) FILTER (WHERE contains(lower(line), 'licen') OR contains(lower(line), 'ha')) AS INTEGER) AS wanted FROM l GROUP BY doc_id")
def error_and_keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    L = tx.lines_lf("text")
    words = F.array(F.lit("Licen"), F.lit("ha"), F.lit("x"))
    return documents(spark, sf_dir).select("doc_id", F.size(F.filter(L, tx.is_error_line)).alias("errors"), F.size(F.filter(L, lambda x: tx.has_keyword(x, words))).alias("wanted"))


@query(f"""
WITH l AS ({SQL_LINES}), k AS (SELECT *, regexp_matches(line, '(?i)licensed|^the') AS hit, regexp_matches(line, '(?i)^and') AS gone FROM l),
s AS (SELECT *, bool_or(hit) FILTER (WHERE NOT gone) OVER (PARTITION BY doc_id) AS any_hit FROM k)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone AND (hit OR NOT coalesce(any_hit, false))), '') AS kept FROM s GROUP BY doc_id
""")
def drop_then_include_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.filter(tx.lines_lf("text"), lambda x: ~x.rlike("(?i)^and"))
    hit = F.filter(left, lambda x: x.rlike("(?i)licensed|^the"))
    return documents(spark, sf_dir).select("doc_id", tx.joined(F.when(F.size(hit) > 0, hit).otherwise(left)).alias("kept"))


@query(f"""
WITH l AS ({SQL_LINES}), k AS (SELECT *, regexp_matches(line, '^[A-Z]') AS hit, row_number() OVER (PARTITION BY doc_id, regexp_matches(line, '^[A-Z]'), regexp_replace(line, {SQL_TRIM}, '', 'g') ORDER BY pos) AS nth FROM l)
SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hit OR nth = 1) AS kept FROM k GROUP BY doc_id
""")
def collapse_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tx.joined(tx.first_of_each(tx.lines_lf("text"), "^[A-Z]")).alias("kept"))


@query(f"WITH l AS ({SQL_LINES}) SELECT doc_id, string_agg(CASE WHEN length(line) <= 80 THEN line ELSE left(line, 77) || '...' END, chr(10) ORDER BY pos) AS cut FROM l GROUP BY doc_id")
def truncate_line_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tx.joined(F.transform(tx.lines_lf("text"), lambda x: tx.cut_line(x, 80))).alias("cut"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 2000 THEN text ELSE left(left(text, 1086) || chr(10) || '[rtk:truncated by chars]' || chr(10) || CASE WHEN length(text) > 888 THEN right(text, 888) ELSE '' END, 2000) END AS cut FROM documents WHERE text IS NOT NULL")
def char_cut_55_45(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tx.cut_chars("text", 2000).alias("cut"))


SQL_RENDER = "string_agg(CASE WHEN pos - before > 1 THEN '[rtk:truncated ' || (pos - before - 1) || ' lines]' || chr(10) || line ELSE line END, chr(10) ORDER BY pos)"


@query(f"""
WITH l AS ({SQL_LINES}), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
k AS (SELECT * FROM n WHERE n <= 12 OR pos <= 4 OR pos > n - 4 OR regexp_matches(line, '(?i)licensed')),
b AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM k)
SELECT doc_id, {SQL_RENDER} AS cut FROM b GROUP BY doc_id
""")
def smart_truncate_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tx.smart_truncate("text", 12, 4, 4, "(?i)licensed").alias("cut"))


@query(f"""
WITH l AS ({SQL_LINES}), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
k AS (SELECT *, (greatest(n - 4, 0)) // 2 AS mid FROM n),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos - 1 >= mid ORDER BY pos) AS nth, count(*) OVER (PARTITION BY doc_id) AS kept FROM k WHERE n > 10 AND (pos <= 4 OR (pos - 1 >= mid AND pos - 1 < mid + 4) OR pos > n - 4)),
s AS (SELECT doc_id, pos, line FROM m WHERE pos - 1 < mid OR nth > kept - 10 UNION ALL SELECT doc_id, pos, line FROM n WHERE n <= 10),
b AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM s)
SELECT doc_id, {SQL_RENDER} AS cut FROM b GROUP BY doc_id
""")
def balanced_truncate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tx.balanced_truncate("text", 10, 4, 4, 4).alias("cut"))


@query("SELECT CASE WHEN contains(url, '/') THEN regexp_replace(url, '(?s)/[^/]*$', '') ELSE '.' END AS dir, count(*) AS files FROM pages WHERE url IS NOT NULL GROUP BY 1")
def group_by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url").where("url is not null").groupBy(tx.directory("url").alias("dir")).agg(F.count(F.lit(1)).alias("files"))


def _sql_signals(d) -> str:
    return " + ".join([f"CAST(regexp_matches(text, {q(re2(p))}) AS INTEGER)" for p in d[3]]) or "0"


@query("SELECT doc_id, s.command_type AS command_type, CAST(s.signals AS INTEGER) AS signals FROM (SELECT doc_id, unnest([" + ", ".join(f"{{'command_type': {q(d[0])}, 'signals': {_sql_signals(d)}}}" for d in detectors.DETECTORS if d[3]) + f"]) AS s FROM documents WHERE text IS NOT NULL) WHERE s.signals > 0")
def detector_content_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode(detect.content_scores("text")).alias("s")).select("doc_id", "s.*")


def _sql_detect() -> str:
    scores = []
    for place, (_, _, of_command, _) in enumerate(detectors.DETECTORS):
        hit = " OR ".join(f"regexp_matches(c, {q(p)})" for p in of_command) or "false"
        n = _sql_signals(detectors.DETECTORS[place])
        scores.append(f"CASE WHEN {hit} THEN 100 * least(100, 55 + 25 * ({n})) + {99 - place} WHEN ({n}) >= 2 THEN 100 * least(100, 25 * ({n})) + {99 - place} ELSE -1 END")
    names = ", ".join(q(d[0]) for d in detectors.DETECTORS)
    return f"d AS (SELECT doc_id, text, {SQL_COMMAND} AS c FROM documents WHERE text IS NOT NULL), s AS (SELECT *, greatest({', '.join(scores)}) AS best FROM d), t AS (SELECT *, CASE WHEN best < 0 THEN 'unknown' ELSE [{names}][99 - best % 100 + 1] END AS command_type, CASE WHEN best < 0 THEN 0.35 ELSE (best // 100) / 100.0 END AS confidence FROM s)"


@query(f"WITH {_sql_detect()} SELECT doc_id, command_type, CAST(confidence AS DOUBLE) AS confidence FROM t")
def detect_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("command", command_of())
    return detect.detected(d, "text", "command").select("doc_id", "command_type", "confidence")


def _sql_filters() -> str:
    by_type: dict[str, str] = {}
    for f in builtin():
        for x in f.types:
            by_type.setdefault(x, f.id)
    tier1 = "CASE command_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in by_type.items()) + " END"
    tier2 = "CASE " + " ".join(f"WHEN {' OR '.join(f'regexp_matches(c, {q(p)})' for p in f.commands)} THEN {q(f.id)}" for f in builtin() if f.commands) + " END"
    return f"coalesce({tier1}, {tier2}, {q(by_type['generic-output'])})"


@query(f"WITH {_sql_detect()} SELECT {_sql_filters()} AS filter_id, command_type, count(*) AS n FROM t GROUP BY ALL")
def filter_match_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("command", command_of())
    d = detect.detected(d, "text", "command")
    return d.groupBy(detect.filter_id(list(builtin())).alias("filter_id"), "command_type").agg(F.count(F.lit(1)).alias("n"))


#: Phrases that the supplied conversations don't have, put in front by turn.
PHRASES = ["Hello, could you please provide a detailed explanation of", "I think that in order to test the database configuration", "I have the following code: make sure to", "However, it is important to be sure to fix", "plain"]


def _sql_condense(level: str) -> str:
    out = f"[{', '.join(map(q, PHRASES))}][CAST(turn % {len(PHRASES)} AS INTEGER) + 1] || '  ' || text"
    # word characters outside ASCII stand between low lines, so that RE2's \b takes them for parts of words
    out = f"regexp_replace({out}, {q(f'({RE2_WORD})')}, '_\\1_', 'g')"
    for _, pattern, to in rules("user", level):
        out = f"regexp_replace({out}, {q(re2(pattern, edges=False))}, {q(to)}, 'g')"
    out = f"regexp_replace({out}, {q(f'_({RE2_WORD})_')}, '\\1', 'g')"
    lines = f"list_transform(string_split_regex(regexp_replace(regexp_replace({out}, ' {{2,}}', ' ', 'g'), '\\r?\\n$', ''), '\\r?\\n'), lambda x: regexp_replace(x, {SQL_TRIM}, '', 'g'))"
    return f"SELECT conv_id, turn, array_to_string({lines}, chr(10)) AS short FROM conversations WHERE role = 'user' AND text IS NOT NULL"


def _condense(level: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = table(spark, sf_dir, "conversations").where((F.col("role") == "user") & F.col("text").isNotNull())
        front = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("turn") % len(PHRASES) + 1).cast("int"))
        return c.select("conv_id", "turn", condensed(F.concat(front, F.lit("  "), "text"), "user", level).alias("short"))

    run.__name__ = f"condense_user_{level}"
    return run


for _level in ("lite", "full", "ultra"):
    query(_sql_condense(_level))(_condense(_level))


def _sql_hint() -> str:
    value = lambda keys: "coalesce(" + ", ".join(f"CASE WHEN json_type(j, '$.{k}') = 'VARCHAR' AND trim(json_extract_string(j, '$.{k}')) <> '' THEN json_extract_string(j, '$.{k}') END" for k in keys) + ")"
    quoted = lambda x: f"'''' || replace({x}, '''', '''\\''''') || ''''"
    inside = lambda names: "n IN (" + ", ".join(map(q, names)) + ")"
    rows = ", ".join(f"({i}, {q(n)}, {q(a)})" for i, (n, a) in enumerate(CALLS))
    search = f"'rg ' || {quoted(value(hints.SEARCH_KEYS))} || coalesce(' ' || {value(hints.PLACE_KEYS)}, '') || coalesce(' --glob ' || {quoted(value(hints.GLOB_KEYS))}, '')"
    return f"""WITH v(id, name, args) AS (VALUES {rows}), p AS (SELECT id, regexp_replace(regexp_replace(lower(name), '^.*__', ''), '^.*\\.', '') AS n, TRY_CAST(args AS JSON) AS j FROM v)
SELECT id, CASE WHEN j IS NOT NULL AND json_type(j) = 'OBJECT' THEN coalesce(CASE WHEN {inside(hints.SHELL)} THEN {value(hints.SHELL_KEYS)} END, CASE WHEN {inside(hints.READ)} THEN 'cat ' || {value(hints.READ_KEYS)} END,
  CASE WHEN {inside(hints.SEARCH)} THEN {search} END, CASE WHEN {inside(hints.LIST)} THEN 'find ' || coalesce({value(hints.LIST_KEYS)}, '.') END) END AS hint FROM p"""


@query(_sql_hint())
def tool_hint_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, n, a) for i, (n, a) in enumerate(CALLS)], "id int, name string, args string")
    return rows.select("id", hints.hint("name", "args").alias("hint"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.pmod("turn", F.lit(3)).alias("call_id"))
    return c.withColumn("hint", F.when((F.col("role") == "user") & (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)) > 0), F.concat(F.lit("cmd "), F.col("turn").cast("string"))))


SQL_TURNS = "t AS (SELECT conv_id, turn, role, turn % 3 AS call_id, CASE WHEN role = 'user' AND (conv_id + turn) % 4 > 0 THEN 'cmd ' || turn END AS hint FROM conversations)"


@query(f"WITH {SQL_TURNS}, c AS (SELECT conv_id, call_id, arg_max(hint, turn) AS hint FROM t WHERE hint IS NOT NULL GROUP BY ALL) SELECT o.conv_id, o.turn, c.hint FROM t o LEFT JOIN c USING (conv_id, call_id) WHERE o.role = 'assistant'")
def call_output_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    return hints.last_call(t.where("role = 'user'"), t.where("role = 'assistant'").drop("hint"), ["conv_id", "call_id"], "turn").select("conv_id", "turn", "hint")


@query(f"WITH {SQL_TURNS}, c AS (SELECT conv_id, call_id, any_value(hint) AS hint FROM t WHERE role = 'user' GROUP BY ALL HAVING count(*) = 1) SELECT o.conv_id, o.turn, c.hint FROM t o LEFT JOIN c USING (conv_id, call_id) WHERE o.role = 'assistant'")
def call_output_unique_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    return hints.only_call(t.where("role = 'user'"), t.where("role = 'assistant'").drop("hint"), ["conv_id", "call_id"]).select("conv_id", "turn", "hint")


@query(f"WITH {SQL_TURNS}, w AS (SELECT *, last_value(hint IGNORE NULLS) OVER (PARTITION BY conv_id, call_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hint_before FROM t) SELECT conv_id, turn, hint_before FROM w WHERE role = 'assistant'")
def call_output_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hints.call_before(_turns(spark, sf_dir), ["conv_id", "call_id"], "turn").where("role = 'assistant'").select("conv_id", "turn", "hint_before")


TTL = 3600


@query(f"""
WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CASE WHEN event_type = 'click' THEN 'c' || event_id END AS c FROM events),
w AS (SELECT *, last_value(CASE WHEN c IS NOT NULL THEN {{'t': t, 'v': c}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM e)
SELECT event_id, CASE WHEN t - s.t <= {TTL * 24} THEN s.v END AS c_as_of FROM w
""")
def session_command_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _timed(spark, sf_dir).withColumn("c", F.when(F.col("event_type") == "click", F.concat(F.lit("c"), F.col("event_id").cast("string"))))
    return hints.as_of(e, ["user_id"], "t", "c", TTL * 24, "event_id").select("event_id", "c_as_of")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("t", F.unix_timestamp("ts"))


@query(f"WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM e) SELECT user_id, CAST(count(*) FILTER (WHERE gap <= {TTL * 24}) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE NOT coalesce(gap <= {TTL * 24}, false)) AS BIGINT) AS misses FROM g GROUP BY user_id")
def cache_sim_sliding_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = stats.cache_hits(_timed(spark, sf_dir).select("user_id", "t"), ["user_id"], "t", TTL * 24)
    return h.groupBy("user_id").agg(F.sum(F.col("is_hit").cast("long")).alias("hits"), F.sum((~F.col("is_hit")).cast("long")).alias("misses"))


@query(f"WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), g AS (SELECT coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {TTL * 24}, false) AS hit FROM e) SELECT CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE NOT hit) AS BIGINT) AS misses, round(100.0 * count(*) FILTER (WHERE hit) / count(*), 1) AS hit_rate_pct FROM g")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hit_rate(stats.cache_hits(_timed(spark, sf_dir).select("user_id", "t"), ["user_id"], "t", TTL * 24))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "text", "source", "lang")
    return d.select(F.nullif("source", F.lit("src0")).alias("filter_id"), F.col("lang").alias("command_type"), tx.tokens("text").alias("original"), tx.tokens(tx.cut_chars("text", 2000)).alias("compressed"))


SQL_FACTS = "f AS (SELECT nullif(source, 'src0') AS filter_id, lang AS command_type, (length(text) + 3) // 4 AS original, (length(CASE WHEN strlen(text) <= 2000 THEN text ELSE left(left(text, 1086) || '__________________________' || CASE WHEN length(text) > 888 THEN right(text, 888) ELSE '' END, 2000) END) + 3) // 4 AS compressed FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {SQL_FACTS} SELECT count(*) AS messages, CAST(sum(original) AS BIGINT) AS original, CAST(sum(compressed) AS BIGINT) AS compressed, CAST(sum(greatest(original - compressed, 0)) AS BIGINT) AS saved, 100.0 * CAST(sum(greatest(original - compressed, 0)) AS DOUBLE) / CAST(sum(original) AS DOUBLE) AS avg_savings_pct FROM f")
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(_facts(spark, sf_dir))


@query(f"WITH {SQL_FACTS} SELECT coalesce(filter_id, 'none') AS filter_id, count(*) AS hits FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_filters(_facts(spark, sf_dir))


@query(f"WITH {SQL_FACTS} SELECT command_type, count(*) AS hits, CAST(sum(greatest(original - compressed, 0)) AS BIGINT) AS saved FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_commands(_facts(spark, sf_dir))


def _event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(spark, sf_dir).select("ts", F.pmod("event_id", F.lit(97)).alias("original"), F.pmod("user_id", F.lit(89)).alias("compressed"))


SQL_EVENTS = "f AS (SELECT ts, event_id % 97 AS original, user_id % 89 AS compressed FROM events)"


def _sql_series(grain: str) -> str:
    fmt = {"month": "%Y-%m", "day": "%Y-%m-%d", "hour": "%Y-%m-%dT%H"}[grain]
    return f"SELECT strftime(ts, '{fmt}') AS bucket, count(*) AS messages, CAST(sum(original) AS BIGINT) AS original, CAST(sum(compressed) AS BIGINT) AS compressed, CAST(greatest(sum(original) - sum(compressed), 0) AS BIGINT) AS saved FROM f GROUP BY 1"


def _series(grain: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stats.series(_event_facts(spark, sf_dir), grain)

    run.__name__ = f"timeseries_{grain}"
    return run


for _grain in ("hour", "day", "month"):
    query(f"WITH {SQL_EVENTS} {_sql_series(_grain)}")(_series(_grain))


@query(f"WITH {SQL_EVENTS} " + " UNION ALL ".join(f"SELECT '{g}' AS grain, * FROM ({_sql_series(g)})" for g in ("hour", "day", "month")))
def timeseries_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.all_series(_event_facts(spark, sf_dir))


SQL_SAFE = f"l AS ({SQL_LINES}), k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l WHERE regexp_matches(line, {SQL_FILLED})), s AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE before IS NULL OR before <> line) AS safe FROM k GROUP BY doc_id)"


@query(f"WITH {SQL_SAFE} SELECT d.doc_id, CAST(strlen(text) AS INTEGER) AS orig_bytes, CAST(least(strlen(text), strlen(coalesce(safe, ''))) AS INTEGER) AS safe_bytes FROM documents d LEFT JOIN s USING (doc_id) WHERE text IS NOT NULL")
def safe_clean_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.octet_length("text").alias("orig_bytes"), F.least(F.octet_length("text"), F.octet_length(tx.safe_clean("text"))).alias("safe_bytes"))


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as if cut to 12,000 characters: measures whose SQL is plain."""
    d = documents(spark, sf_dir).withColumn("command", command_of()).withColumn("out", tx.cut_chars("text", CHAR_BUDGET)).withColumn("lines", audit.line_measures("out"))
    kind = F.when(F.pmod("doc_id", F.lit(15)).isin(2, 8), "file-read").otherwise("unknown")
    return d.select(
        "command", kind.alias("command_type"), F.octet_length("text").alias("orig_bytes"), F.octet_length("out").alias("out_bytes"), tx.tokens("text").alias("orig_tokens"), tx.tokens("out").alias("out_tokens"), F.col("lines.n").alias("out_lines"),
        F.col("lines.blank").alias("out_blank_lines"), F.col("lines.twice").alias("out_twice_lines"),
    )


SQL_MEASURES = f"""o AS (SELECT *, string_split(out, chr(10)) AS l FROM (SELECT doc_id, text, CASE WHEN strlen(text) <= 12000 THEN text ELSE left(left(text, 6586) || chr(10) || '[rtk:truncated by chars]' || chr(10) || CASE WHEN length(text) > 5388 THEN right(text, 5388) ELSE '' END, 12000) END AS out FROM documents WHERE text IS NOT NULL)),
m AS (SELECT {SQL_COMMAND} AS command, CASE WHEN doc_id % 15 IN (2, 8) THEN 'file-read' ELSE 'unknown' END AS command_type, strlen(text) AS orig_bytes, strlen(out) AS out_bytes, (length(text) + 3) // 4 AS orig_tokens, (length(out) + 3) // 4 AS out_tokens, len(l) AS out_lines, len(list_filter(l, lambda x: NOT regexp_matches(x, {SQL_FILLED}))) AS blanks, len(list_filter(list_zip(l[2:], l[:-2]), lambda x: x[1] = x[2] AND regexp_matches(x[1], {SQL_FILLED}))) AS twice FROM o)"""


@query(f"WITH {SQL_MEASURES} SELECT command_type, count(*) AS records, CAST(sum(out_tokens) AS BIGINT) AS tokens, CAST(count(*) FILTER (WHERE out_bytes >= 11500) AS BIGINT) AS at_budget, CAST(count(*) FILTER (WHERE out_bytes < 11500) AS BIGINT) AS below_budget, CAST(coalesce(sum(out_tokens) FILTER (WHERE out_bytes < 11500), 0) AS BIGINT) AS below_tokens, CAST(coalesce(sum(blanks) FILTER (WHERE out_bytes < 11500), 0) AS BIGINT) AS blank_lines, CAST(coalesce(sum(twice) FILTER (WHERE out_bytes < 11500), 0) AS BIGINT) AS twice_lines FROM m WHERE out_tokens >= 1000 AND CAST(out_bytes AS DOUBLE) / greatest(orig_bytes, 1) >= 0.9 GROUP BY command_type")
def under_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.under_compressed(_measures(spark, sf_dir))


@query(f"WITH {SQL_MEASURES} SELECT out_tokens, command_type, command, orig_tokens FROM m WHERE out_tokens >= 1000 AND CAST(out_bytes AS DOUBLE) / greatest(orig_bytes, 1) >= 0.9 ORDER BY out_tokens DESC, command_type, command LIMIT 25")
def under_compression_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.offenders(_measures(spark, sf_dir))


@query(f"WITH {SQL_MEASURES} SELECT CASE WHEN out_lines <= 50 THEN '0000-0050' WHEN out_lines <= 150 THEN '0051-0150' WHEN out_lines <= 300 THEN '0151-0300' WHEN out_lines <= 500 THEN '0301-0500' WHEN out_lines <= 1000 THEN '0501-1000' ELSE '1001-' END AS bucket, count(*) AS records, CAST(sum(out_tokens) AS BIGINT) AS tokens, CAST(count(*) FILTER (WHERE out_bytes > 12000) AS BIGINT) AS over_budget FROM m WHERE command_type = 'file-read' GROUP BY 1")
def line_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.reads(_measures(spark, sf_dir))


@query(f"WITH {SQL_MEASURES}, c AS (SELECT unnest([200, 300, 500]) AS cap) SELECT cap, CAST(count(*) FILTER (WHERE out_lines > cap) AS BIGINT) AS exceeding, CAST(sum(CASE WHEN out_lines > cap THEN CAST(floor((out_lines - cap) * (CAST(out_bytes AS DOUBLE) / greatest(out_lines, 1)) / 4) AS BIGINT) ELSE 0 END) AS BIGINT) AS saved_tokens FROM m, c WHERE command_type = 'file-read' GROUP BY cap")
def read_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.read_caps(_measures(spark, sf_dir))


@query(f"WITH {SQL_MEASURES} SELECT CASE command WHEN 'cat src/main.rs' THEN 'src/main.rs' ELSE 'a.txt' END AS target, count(*) AS reads, CAST(sum(out_tokens) AS BIGINT) AS tokens FROM m WHERE command_type = 'file-read' GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 20")
def repeated_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.repeated_reads(_measures(spark, sf_dir))


@query(f"WITH {SQL_MEASURES} SELECT command_type, count(*) AS records, CAST(sum(orig_tokens) AS BIGINT) AS orig_tokens, CAST(sum(out_tokens) AS BIGINT) AS out_tokens, round(100.0 * CAST(sum(orig_tokens) - sum(out_tokens) AS DOUBLE) / greatest(sum(orig_tokens), 1), 2) AS tokens_cut_pct FROM m GROUP BY 1")
def reduction_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_type(_measures(spark, sf_dir))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, body): each conversation as a request, in turn in one of the four dialects; assistants' texts are outputs of calls."""
    c = table(spark, sf_dir, "conversations").where("text is not null and text <> ''")
    turn, text = F.col("turn").cast("string"), F.col("text")
    tool, call = F.col("role") == "assistant", F.concat(F.lit("c"), turn)
    command = F.concat(F.lit("ls d"), turn)
    pair = lambda a, b, other: F.when(tool, F.array(F.to_json(a), F.to_json(b))).otherwise(F.array(F.to_json(other)))
    said = lambda content: F.struct("role", content.alias("content"))
    args = F.to_json(F.struct(command.alias("command")))
    chat = pair(
        F.struct(F.lit("assistant").alias("role"), F.array(F.struct(call.alias("id"), F.struct(F.lit("bash").alias("name"), args.alias("arguments")).alias("function"))).alias("tool_calls")),
        F.struct(F.lit("tool").alias("role"), call.alias("tool_call_id"), text.alias("content")), said(text),
    )
    blocks = pair(
        F.struct(F.lit("assistant").alias("role"), F.array(F.struct(F.lit("tool_use").alias("type"), call.alias("id"), F.lit("Bash").alias("name"), F.struct(command.alias("command")).alias("input"))).alias("content")),
        F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("tool_result").alias("type"), call.alias("tool_use_id"), text.alias("content"))).alias("content")),
        said(F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))),
    )
    # of two calls by one name, none is an output's
    name = F.concat(F.lit("ns"), F.when(F.col("turn") % 4 == 3, F.lit("3")).otherwise(turn), F.lit(".bash"))
    parts = pair(
        F.struct(F.lit("model").alias("role"), F.array(F.struct(F.struct(name.alias("name"), F.struct(command.alias("command")).alias("args")).alias("functionCall"))).alias("parts")),
        F.struct(F.lit("function").alias("role"), F.array(F.struct(F.struct(name.alias("name")).alias("functionResponse"), text.alias("text"))).alias("parts")),
        F.struct("role", F.array(F.struct(text.alias("text"))).alias("parts")),
    )
    items = pair(
        F.struct(F.lit("function_call").alias("type"), call.alias("call_id"), F.lit("exec_command").alias("name"), F.to_json(F.struct(command.alias("cmd"))).alias("arguments")),
        F.struct(F.lit("function_call_output").alias("type"), call.alias("call_id"), text.alias("output")), said(text),
    )
    kind = F.pmod("conv_id", F.lit(4))
    c = c.select("conv_id", "turn", kind.alias("kind"), F.when(kind == 0, chat).when(kind == 1, blocks).when(kind == 2, parts).otherwise(items).alias("m"))
    b = c.groupBy("conv_id", "kind").agg(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"])), ",").alias("m"))
    key = F.when(F.col("kind") == 2, "contents").when(F.col("kind") == 3, "input").otherwise("messages")
    return b.select(F.col("conv_id").alias("request_id"), F.concat(F.lit('{"'), key, F.lit('":['), "m", F.lit("]}")).alias("body"))


@query("""
WITH c AS (SELECT conv_id, turn, role, text, conv_id % 4 AS d, CASE WHEN turn % 4 = 3 THEN '3' ELSE CAST(turn AS VARCHAR) END AS n FROM conversations WHERE text IS NOT NULL AND text <> ''),
o AS (SELECT *, count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id, n) AS same FROM c)
SELECT conv_id AS request_id, ['chat', 'blocks', 'parts', 'items'][d + 1] AS dialect, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos,
  CASE WHEN role = 'assistant' THEN 'tool' WHEN role = 'user' AND d < 3 THEN 'user' ELSE 'other' END AS kind, md5(text) AS text, CASE WHEN role = 'assistant' AND (d <> 2 OR same = 1) THEN 'ls d' || turn END AS hint FROM o
""")
def request_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.exploded(_bodies(spark, sf_dir)).select("request_id", "dialect", "pos", "kind", F.md5("text").alias("text"), "hint")


@query("""
WITH c AS (SELECT *, conv_id % 4 AS d, (length(text) + 3) // 4 AS t FROM conversations WHERE text IS NOT NULL AND text <> '')
SELECT conv_id AS request_id, ['chat', 'blocks', 'parts', 'items'][any_value(d) + 1] AS dialect, CAST(sum(t) AS BIGINT) AS original, count(*) FILTER (WHERE role = 'assistant') AS tools FROM c GROUP BY conv_id
""")
def request_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of requests before compression, under repeated and null ids: the true key rides along in a column of its own."""
    b = _bodies(spark, sf_dir).withColumn("key", F.col("request_id")).withColumn("request_id", F.when(F.col("key") % 3 > 0, F.lit(1)))
    return processed(b).select(F.col("key").alias("request_id"), "dialect", "original", F.size("per_command").cast("long").alias("tools"))


#: Texts cut into short lines at commas, so that most have many of them.
SQL_PHRASES = "SELECT doc_id, unnest(string_split(replace(text, ', ', chr(10)), chr(10))) AS x, generate_subscripts(string_split(replace(text, ', ', chr(10)), chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL"


def _grouped(how: Callable, shaped: Callable):
    """how(lines) over the phrases of each text, shaped(x, i) being the line made of phrase x at place i."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = F.pandas_udf(lambda s: s.map(how), "string")
        lines = F.transform(F.split(F.replace("text", F.lit(", "), F.lit("\n")), "\n", -1), shaped)
        return documents(spark, sf_dir).select("doc_id", out(lines).alias("grouped"))

    return run


def _sql_shaped(period: int, shapes: dict[int, str]) -> str:
    """l: the shaped lines, k: those with s, the line without white space at its ends."""
    cases = " ".join(f"WHEN {at} THEN {shape}" for at, shape in shapes.items())
    return f"p AS ({SQL_PHRASES}), l AS (SELECT doc_id, i, CASE i % {period} {cases} ELSE x END AS line FROM p), k AS (SELECT *, regexp_replace(line, {SQL_TRIM}, '', 'g') AS s FROM l)"


def _re(pattern) -> str:
    return q(re2(pattern.pattern.replace(r"\Z", r"\z")))


SQL_LISTED = f"CASE WHEN regexp_matches(s, {_re(outputs.LONG_STATUS)}) THEN regexp_extract(s, {_re(outputs.LONG_STATUS)}, 1) WHEN regexp_matches(s, {_re(outputs.SHORT_STATUS)}) THEN regexp_extract(s, {_re(outputs.SHORT_STATUS)}, 2) WHEN regexp_matches(s, {_re(outputs.ROOTED)}) THEN s END"


@query(f"""
WITH {_sql_shaped(5, {0: "chr(9) || 'modified:   d' || (length(x) % 3) || '/f' || i", 1: "' M d' || (length(x) % 5) || '/sub/f' || i", 2: "'./top' || i", 3: "''"})},
f AS (SELECT *, {SQL_LISTED} AS path FROM k),
d AS (SELECT doc_id, CASE WHEN contains(path, '/') THEN regexp_replace(regexp_replace(path, {SQL_TRIM}, '', 'g'), '/[^/]*$', '') ELSE '.' END AS dir, count(*) AS n FROM f WHERE path IS NOT NULL GROUP BY ALL),
g AS (SELECT doc_id, sum(n) AS files, count(*) AS dirs, list('  ' || dir || ' (' || n || CASE WHEN n > 1 THEN ' files)' ELSE ' file)' END ORDER BY dir) AS listed FROM d GROUP BY doc_id),
r AS (SELECT doc_id, list(line ORDER BY i) FILTER (WHERE path IS NULL AND s <> '') AS rest FROM f GROUP BY doc_id)
SELECT doc_id, CASE WHEN files >= 5 AND dirs >= 2 THEN array_to_string(list_concat(coalesce(rest, []), ['[rtk:grouped ' || files || ' files across ' || dirs || ' directories]'], listed), chr(10)) END AS grouped FROM r LEFT JOIN g USING (doc_id)
""")
def group_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shaped(x: Column, i: Column) -> Column:
        n, at = F.length(x), i.cast("string")
        long = F.concat(F.lit("\tmodified:   d"), (n % 3).cast("string"), F.lit("/f"), at)
        short = F.concat(F.lit(" M d"), (n % 5).cast("string"), F.lit("/sub/f"), at)
        return F.when(i % 5 == 0, long).when(i % 5 == 1, short).when(i % 5 == 2, F.concat(F.lit("./top"), at)).when(i % 5 == 3, "").otherwise(x)

    return _grouped(outputs.group_files, shaped)(spark, sf_dir)


@query(f"""
WITH {_sql_shaped(8, {0: "'PASS ' || x", 1: "' FAIL ' || x", 4: "''", 6: "'Tests: 3 passed'", 7: "chr(10003) || ' ' || x"})},
c AS (SELECT *, CASE WHEN regexp_matches(s, {_re(outputs.TEST_SUMMARY)}) THEN 'summary' WHEN regexp_matches(s, {_re(outputs.TEST_FAIL)}) THEN 'fail' WHEN regexp_matches(s, {_re(outputs.TEST_PASS)}) THEN 'pass' WHEN s = '' THEN 'blank' END AS own FROM k),
w AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM c),
t AS (SELECT *, CASE WHEN own IS NOT NULL THEN own WHEN since = 'fail' THEN 'fail' ELSE 'context' END AS kind FROM w),
g AS (SELECT doc_id, {", ".join(f"coalesce(list(line ORDER BY i) FILTER (WHERE kind = '{x}'), []) AS l_{x}" for x in ("context", "fail", "pass", "summary"))} FROM t GROUP BY doc_id)
SELECT doc_id, CASE WHEN len(l_fail) + len(l_pass) >= 3 THEN array_to_string(list_concat(l_context, CASE WHEN len(l_fail) > 0 THEN list_prepend('[rtk:test-failures ' || len(l_fail) || ']', l_fail) ELSE [] END, CASE WHEN len(l_pass) > 0 THEN ['[rtk:test-passed ' || len(l_pass) || ' tests]'] ELSE [] END, l_summary), chr(10)) END AS grouped FROM g
""")
def group_test_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = {0: "PASS ", 1: " FAIL ", 7: "✓ "}

    def shaped(x: Column, i: Column) -> Column:
        out = F.when(i % 8 == 4, "").when(i % 8 == 6, "Tests: 3 passed")
        for at, head in heads.items():
            out = out.when(i % 8 == at, F.concat(F.lit(head), x))
        return out.otherwise(x)

    return _grouped(outputs.group_tests, shaped)(spark, sf_dir)


@query(f"""
WITH {_sql_shaped(6, {0: "'error: ' || x", 1: "'a.c:1: Warning: ' || x", 2: "'note: ' || x", 3: "' '"})},
c AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(s, {_re(p)}) THEN '{name}'" for name, p in outputs.BUILD)} ELSE 'other' END AS kind FROM k WHERE s <> ''),
g AS (SELECT doc_id, {", ".join(f"coalesce(list(line ORDER BY i) FILTER (WHERE kind = '{x}'), []) AS l_{x}" for x in ("other", "errors", "warnings", "info"))} FROM c GROUP BY doc_id)
SELECT doc_id, CASE WHEN len(l_errors) + len(l_warnings) + len(l_info) >= 3 THEN array_to_string(list_concat(l_other, CASE WHEN len(l_errors) > 0 THEN list_prepend('[rtk:build-errors ' || len(l_errors) || ']', l_errors) ELSE [] END,
  CASE WHEN len(l_warnings) > 0 THEN list_prepend('[rtk:build-warnings ' || len(l_warnings) || ']', l_warnings[1:10]) ELSE [] END, CASE WHEN len(l_warnings) > 10 THEN ['  ... and ' || (len(l_warnings) - 10) || ' more warnings'] ELSE [] END, CASE WHEN len(l_info) > 0 THEN ['[rtk:build-info ' || len(l_info) || ' messages]'] ELSE [] END), chr(10)) END AS grouped
FROM (SELECT DISTINCT doc_id FROM p) LEFT JOIN g USING (doc_id)
""")
def group_build_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = {0: "error: ", 1: "a.c:1: Warning: ", 2: "note: "}

    def shaped(x: Column, i: Column) -> Column:
        out = F.when(i % 6 == 3, " ")
        for at, head in heads.items():
            out = out.when(i % 6 == at, F.concat(F.lit(head), x))
        return out.otherwise(x)

    return _grouped(outputs.group_build, shaped)(spark, sf_dir)


#: A filter with every kind of rule the line stages know.
RULED = Filter(id="ruled", strip_ansi=True, strip_stderr=True, replace=((r"(\w+) (the|und|de)\b", "$2 ${1}"), (r"\d", "#")), answers=((r"^[A-D]\w+ \w+$", "short head", "licensed"), ("licensed", "a licence", None)), drop=("^(?:an|ein|un)", "^.{45,}$"), include=("[kwxz]",), collapse=(r"^\W*\w+$",), keep=("ing",), line_chars=60, max_lines=9, head=3, tail=3, on_empty="nothing")


@query(f"""
WITH l AS (SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN i = 0 THEN chr(27) || '[31merr: ' || x ELSE x END, {q(tx.CSI)}, '', 'g'), {q(re2(tx.STDERR))}, ''), {q(re2(RULED.replace[0][0], edges=False).replace(chr(92) + "b", f"([^{RE2['w']}]|" + chr(92) + "z)"))}, '\\2 \\1\\3', 'g'), '\\p{{Nd}}', '#', 'g') AS line FROM ({SQL_PHRASES})),
b AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS blob FROM l GROUP BY doc_id),
a AS (SELECT doc_id, CASE {" ".join(f"WHEN regexp_matches(blob, {q('(?im)' + re2(p))})" + (f" AND NOT regexp_matches(blob, {q('(?im)' + re2(u))})" if u else "") + f" THEN {q(m)}" for p, m, u in RULED.answers)} END AS answer FROM b),
d AS (SELECT *, regexp_matches(line, {q("(?i)" + re2(RULED.include[0]))}) AS inc FROM l WHERE NOT regexp_matches(line, {q("(?i)" + re2("|".join(RULED.drop)))})),
n AS (SELECT *, bool_or(inc) OVER (PARTITION BY doc_id) AS any_inc, regexp_matches(line, {q("(?i)" + re2(RULED.collapse[0]))}) AS col, regexp_replace(line, {SQL_TRIM}, '', 'g') AS s FROM d),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, col, s ORDER BY i) AS nth FROM n WHERE inc OR NOT any_inc),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, count(*) OVER (PARTITION BY doc_id) AS n, CASE WHEN length(line) <= 60 THEN line ELSE left(line, 57) || '...' END AS line FROM e WHERE NOT col OR nth = 1),
t AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM c WHERE n <= 9 OR pos <= 3 OR pos > n - 3 OR regexp_matches(line, '(?i)ing')),
o AS (SELECT doc_id, {SQL_RENDER} AS cut FROM t GROUP BY doc_id)
SELECT doc_id, coalesce(answer, CASE WHEN regexp_matches(coalesce(cut, ''), {SQL_FILLED}) THEN cut ELSE 'nothing' END) AS ruled FROM a LEFT JOIN o USING (doc_id)
""")
def line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.pandas_udf(lambda s: s.map(lambda t: outputs.filter_lines(t, RULED)), "string")
    return documents(spark, sf_dir).select("doc_id", run(F.concat(F.lit("\x1b[31merr: "), F.replace("text", F.lit(", "), F.lit("\n")))).alias("ruled"))


SQL_CALLED = "m AS (SELECT conv_id AS request_id, turn AS pos, nullif('f' || (length(text) % 4), 'f0') AS filter_id, CASE WHEN turn % 3 > 0 THEN 'c' || (turn % 3) END AS command_type, length(text) % 97 AS original, length(text) % 89 AS compressed, conv_id % 5 > 0 AS modified FROM conversations WHERE text IS NOT NULL)"


@query(f"""
WITH {SQL_CALLED}, u AS (SELECT request_id, filter_id, min(pos) AS pos FROM m WHERE command_type IS NOT NULL AND filter_id IS NOT NULL GROUP BY ALL), f AS (SELECT request_id, string_agg(filter_id, ',' ORDER BY pos) AS filters FROM u GROUP BY ALL),
r AS (SELECT request_id, CAST(sum(original) AS BIGINT) AS o, CAST(sum(compressed) AS BIGINT) AS c, bool_or(modified) AS modified, coalesce(string_agg(command_type || ':' || original || '->' || compressed || ',', '' ORDER BY pos) FILTER (WHERE command_type IS NOT NULL), '') AS each FROM m GROUP BY request_id)
SELECT request_id, modified AND c < o AS saves, CASE WHEN c < o THEN CAST(o AS VARCHAR) END AS h_original, CASE WHEN c < o THEN CAST(c AS VARCHAR) END AS h_compressed, CASE WHEN c < o THEN coalesce(filters, '') END AS h_filters, CASE WHEN c < o THEN left(each, 64) END AS h_commands FROM r LEFT JOIN f USING (request_id)
""")
def response_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, turn = F.length("text"), F.col("turn")
    m = table(spark, sf_dir, "conversations").where("text is not null").select(
        F.col("conv_id").alias("request_id"), turn.alias("pos"), F.nullif(F.concat(F.lit("f"), (n % 4).cast("string")), F.lit("f0")).alias("filter_id"), F.when(turn % 3 > 0, F.concat(F.lit("c"), (turn % 3).cast("string"))).alias("command_type"),
        (n % 97).alias("original"), (n % 89).alias("compressed"), (F.col("conv_id") % 5 > 0).alias("modified"),
    )
    return stats.headers(stats.by_request(m), most_bytes=64).select("request_id", "saves", "h_original", "h_compressed", "h_filters", "h_commands")


@query(f"""
WITH {SQL_FACTS}, s AS (SELECT *, greatest(original - compressed, 0) AS saved FROM f)
SELECT 'totals' AS section, 'messages' AS name, count(*) AS hits, CAST(sum(saved) AS BIGINT) AS saved, printf('%.1f', 100.0 * CAST(sum(saved) AS DOUBLE) / CAST(sum(original) AS DOUBLE)) AS note FROM s
UNION ALL SELECT * FROM (SELECT 'filters', coalesce(filter_id, 'none') AS x, count(*) AS n, NULL, NULL FROM s GROUP BY x ORDER BY n DESC, x LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'commands', command_type AS x, count(*) AS n, CAST(sum(saved) AS BIGINT), NULL FROM s GROUP BY x ORDER BY n DESC, x LIMIT 20)
""")
def stats_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.stats_page(_facts(spark, sf_dir))


def _recent(grain: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pages.recent(_event_facts(spark, sf_dir), grain)

    run.__name__ = f"recent_{grain}s"
    return run


for _grain in ("hour", "day"):
    query(f"WITH {SQL_EVENTS} {_sql_series(_grain)} ORDER BY 1 DESC LIMIT {pages.LAST[_grain]}")(_recent(_grain))


@query("""
WITH d AS (SELECT doc_id, text, ['Original token count: ' || doc_id || chr(10) || 'Output:' || chr(10), 'Output:' || chr(10), 'Original token count:  x' || chr(10), ''][CAST(doc_id % 4 AS INTEGER) + 1] AS head FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN doc_id END AS header, md5(CASE WHEN doc_id % 4 < 2 THEN text ELSE head || text END) AS body FROM d
""")
def output_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.pmod("doc_id", F.lit(4))
    count = F.concat(F.lit("Original token count: "), F.col("doc_id").cast("string"), F.lit("\nOutput:\n"))
    whole = F.concat(F.when(k == 0, count).when(k == 1, "Output:\n").when(k == 2, "Original token count:  x\n").otherwise(""), "text")
    return documents(spark, sf_dir).select("doc_id", audit.header_tokens(whole).alias("header"), F.md5(audit.body(whole)).alias("body"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the lines of session logs: users' turns are calls, assistants' are outputs, ids come again every eight turns."""
    c = table(spark, sf_dir, "conversations")
    call = F.concat_ws("-", F.col("conv_id").cast("string"), F.floor(F.pmod("turn", F.lit(8)) / 2).cast("string"))
    asked = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.array(F.lit("cat"), F.concat(F.lit("f"), F.col("turn").cast("string"))).alias("command")))).otherwise(F.to_json(F.struct(F.col("text").alias("cmd"))))
    name = F.when(F.col("conv_id") % 7 == 0, "other_tool").when(F.col("conv_id") % 2 == 0, "exec_command").otherwise("shell_command")
    body = F.concat(F.lit("Original token count: "), F.col("turn").cast("string"), F.lit("\nOutput:\n"), "text")
    item = F.when(F.col("role") == "user", F.to_json(F.struct(F.lit("function_call").alias("type"), name.alias("name"), call.alias("call_id"), asked.alias("arguments")))).when(F.col("role") == "assistant", F.to_json(F.struct(F.lit("function_call_output").alias("type"), call.alias("call_id"), body.alias("output")))).otherwise('{"type": "message"}')
    inner = F.when(F.col("turn") % 4 < 2, item).otherwise(F.concat(F.lit('{"item":'), item, F.lit("}")))
    line = F.when(F.col("turn") % 16 == 15, "not json").otherwise(F.concat(F.lit('{"type":"response_item","payload":'), inner, F.lit("}")))
    return c.select(F.col("conv_id").cast("string").alias("file"), F.struct(F.lit(0).cast("long").alias("block"), F.col("turn").cast("long").alias("line")).alias("place"), line.alias("value"))


SQL_LOG = f"""c AS (SELECT conv_id, turn, conv_id || '-' || (turn % 8 // 2) AS call_id, role, text, CASE WHEN turn % 3 = 0 THEN 'cat' || chr(10) || 'f' || turn WHEN regexp_matches(text, {SQL_FILLED}) THEN text END AS command FROM conversations WHERE turn % 16 <> 15),
calls AS (SELECT * FROM c WHERE role = 'user' AND conv_id % 7 <> 0), outs AS (SELECT * FROM c WHERE role = 'assistant')"""


@query(f"""
WITH {SQL_LOG}, a AS (SELECT call_id, arg_max(command, turn) AS command FROM calls WHERE command IS NOT NULL GROUP BY call_id), o AS (SELECT call_id, max(turn) AS turn FROM outs GROUP BY call_id)
SELECT call_id, md5(a.command) AS command, md5(coalesce(text, '')) AS output, CASE WHEN text IS NOT NULL THEN CAST(o.turn AS BIGINT) END AS header_tokens FROM a JOIN o USING (call_id) JOIN outs USING (call_id, turn)
""")
def session_log_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.paired(sessions.items(_log(spark, sf_dir))).select("call_id", F.md5("command").alias("command"), F.md5("output").alias("output"), "header_tokens")


@query(f"WITH {SQL_LOG}, a AS (SELECT DISTINCT call_id FROM calls WHERE command IS NOT NULL), o AS (SELECT DISTINCT call_id FROM outs) SELECT (SELECT count(*) FROM calls) AS exec_calls, (SELECT count(*) FROM o JOIN a USING (call_id)) AS paired, (SELECT count(*) FROM o ANTI JOIN a USING (call_id)) AS orphan_outputs")
def session_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pairing_counts(sessions.items(_log(spark, sf_dir)))


@query("""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, coalesce(w[1], 'q') AS a, coalesce(w[2], 'q') AS b, coalesce(w[3], 'q') AS c, coalesce(w[4], 'q') AS d FROM w),
l AS (SELECT doc_id, list_concat(list_filter([a, b], lambda x: length(x) >= 3), list_filter([c, d], lambda x: length(x) >= 2)) AS l FROM t)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS terms FROM l
""")
def search_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda k: F.coalesce(F.get(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0), F.lit(k)), F.lit("q"))
    script = F.concat(F.lit("# looks\nLC_ALL=C /usr/bin/rg -n '"), word(0), F.lit("|"), word(1), F.lit("' src && grep -e "), word(2), F.lit(" x | ag ./lib "), word(3))
    return documents(spark, sf_dir).select("doc_id", F.array_join(commands.keywords(script), " ").alias("terms"))


@query("""
WITH e AS (SELECT user_id % 50 AS s, 'c' || event_id AS c, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id, event_id % 2 = 0 AS fresh FROM events WHERE event_type = 'click'),
l AS (SELECT s, fresh, arg_max(c, (t, c)) AS c, max(t) AS t FROM e WHERE s % 3 > 0 OR NOT fresh GROUP BY ALL)
SELECT s AS session_id, c AS command, CAST(t AS BIGINT) AS updated_at FROM l WHERE fresh OR s NOT IN (SELECT s FROM l WHERE fresh)
""")
def session_state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _timed(spark, sf_dir).where("event_type = 'click'").select(F.pmod("user_id", F.lit(50)).cast("long").alias("session_id"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("command"), F.col("t").alias("updated_at"), (F.col("event_id") % 2 == 0).alias("fresh"))
    fresh, stored = e.where("fresh and session_id % 3 > 0").drop("fresh"), state.latest(e.where("not fresh").drop("fresh"))
    return state.merge(fresh, stored)


#: Filters that only their content tells apart; the first one wins where both match.
BY_CONTENT = [Filter(id="licensed", contents=(r"^licensed\b",)), Filter(id="heading", contents=(r"^[A-Z]\w+\.$",)), Filter(id="rest", types=("generic-output",))]


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'rest' WHEN regexp_matches(text, {q('(?im)' + re2('^licensed(?:[^' + RE2['w'] + ']|' + chr(92) + 'z)'))}) THEN 'licensed' WHEN regexp_matches(text, {q('(?im)' + re2(BY_CONTENT[1].contents[0]))}) THEN 'heading' ELSE 'rest' END AS filter_id FROM documents WHERE text IS NOT NULL")
def filter_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumns({"command_type": F.when(F.col("doc_id") % 3 == 0, "unknown").otherwise("make"), "norm_command": F.lit("make")})
    return d.select("doc_id", detect.filter_id(BY_CONTENT).alias("filter_id"))


# queries without SQL: sequential by nature; tests hold them against plain Python


@query()
def block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else outputs.fold(t)), "string")
    return documents(spark, sf_dir).select("doc_id", fold("text").alias("folded"))


@query()
def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else outputs.within_budget(t, 2000, ["Licensed"])), "string")
    return documents(spark, sf_dir).select("doc_id", cut("text").alias("cut"))


@query()
def output_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("command", command_of())
    return compressed(d, "text", "command").select("doc_id", "command_type", "confidence", "filter_id", "grouped", "original_tokens", "compressed_tokens", F.md5("compressed").alias("digest"))


@query()
def request_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    m = F.struct(F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"))
    bodies = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", m.alias("m")))).alias("l")).select(F.col("conv_id").alias("request_id"), F.to_json(F.struct(F.col("l.m").alias("messages"))).alias("body"))
    return processed(bodies, EngineConfig(condense=True)).select("request_id", "dialect", "original", "compressed", "saves", "filters", F.md5("new_body").alias("digest"))


@query()
def command_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(c,) for c in COMMANDS + TYPED], "command string")
    return audit.classified(rows)


@query()
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = documents(spark, sf_dir).select(command_of().alias("command"), F.col("text").alias("output"))
    return audit.against_floor(audit.measured(pairs))


@query()
def command_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(c,) for c in COMMANDS + TYPED + ["rg 'foo|bar' src && grep -e baz x"]], "command string")
    return rows.select("command", commands.normal("command").alias("norm"), commands.keywords("command").alias("terms"))
