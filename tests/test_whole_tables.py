"""Queries cover every row and line of their tables, texts outside ASCII too."""

import hashlib
import random
import re

import __spark_entry__ as entry
import duckdb
import pytest
from test_oracle import plain

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()

TEXTS = [
    "plain ascii\nerror: one\n\nerror: one",
    "Überfall \nÜberfall\nfailé ist kein Fehler\nein　fail hier",
    "   　  \n \nnaïve\nnaïve\n The end \nThe end",
    "stderr :　кирилл\nзаголовок\nfound 3 vulnerabilities éhighé\nhigh é\n٣",
    "● nginx.service\n Loaded: ok\n Active: yes\n日本 vitest\n ✓ süß\nTest Files ٣ passed\nТraceback\nTests: ٣\nPASS　x",
    "　{ \"ключ\": 1 } ",
    "Ha licence ÄNDERUNG LICENCE\nüdenied\ndenied ü",
    "",
    None,
]
TURNS = ["bitte pleaseé please　now, a bitï a bit, naïve database", "thanks ", "éin order to \nin order to é ", "_é_ plain the function", "probably", None]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables of few rows, most of them outside ASCII, and DuckDB over the same."""
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, k, "user", t) for i in range(5) for k, t in enumerate(TURNS, i)], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"create view {name} as select * from '{d}/{name}.parquet/*.parquet'")
    return d, con


def same_as_sql(spark, small, name):
    d, con = small
    df = QUERIES[name](spark, d)
    found = con.execute(ORACLE[name])
    names, rows = [c[0] for c in found.description], df.collect()
    assert plain([[r[c] for c in names] for r in rows]) == plain(found.fetchall())
    return rows


@pytest.mark.parametrize("name", ["detect_argmax", "stderr_prefix", "error_and_keyword_lines", "collapse_first", "safe_clean_baseline", "condense_user_lite", "condense_user_full", "condense_user_ultra"])
def test_every_row_outside_ascii(spark, small, name):
    rows = same_as_sql(spark, small, name)
    assert len(rows) == (5 * (len(TURNS) - 1) if name.startswith("condense") else len(TEXTS) - 1)


def test_scores_and_tiers_outside_ascii(spark, small):
    scores = {(r.doc_id, r.command_type): r.signals for r in same_as_sql(spark, small, "detector_content_scores")}
    assert scores[4, "test-vitest"] == 3 and scores[4, "systemctl-status"] == 3 and scores[5, "json-output"] == 1 and scores[3, "npm-audit"] == 2
    assert sum(r.n for r in same_as_sql(spark, small, "filter_match_tiers")) == len(TEXTS) - 1


def test_outside_ascii_by_hand(spark, small):
    d, _ = small
    # Python's own classes are Unicode
    error = re.compile(r"(?i)error|warning|\bfail(?:ed|ure)?\b|panic|exception|traceback|fatal|\bdenied\b|not found")
    got = {r.doc_id: (r.errors, r.wanted) for r in QUERIES["error_and_keyword_lines"](spark, d).collect()}
    assert got == {i: (sum(bool(error.search(x)) for x in t.split("\n")), sum("licen" in x.lower() or "ha" in x.lower() for x in t.split("\n"))) for i, t in enumerate(TEXTS) if t is not None}

    def clean(t):
        kept = [x for x in t.split("\n") if x.strip()]
        return "\n".join(x for k, x in enumerate(kept) if not k or x != kept[k - 1])

    got = {r.doc_id: r.safe_bytes for r in QUERIES["safe_clean_baseline"](spark, d).collect()}
    assert got == {i: len(clean(t).encode()) for i, t in enumerate(TEXTS) if t is not None}
    short = {r.turn: r.short for r in QUERIES["condense_user_lite"](spark, d).where("conv_id = 0").collect()}
    assert short[0].endswith("bitte pleaseé now, a bitï , naïve database") and short[2].endswith("éin order to\nto é")


def test_blocks_of_every_size(spark, tmp_path):
    rng = random.Random(4)
    part = [f"line {i}" for i in range(31)]
    texts = ["\n".join([*part, "é", *part]), "\n".join("same" for _ in range(40)), "", "a\nb", *("\n".join(rng.choice(["a", "b", "", "ü"]) for _ in range(rng.randrange(60))) for _ in range(12))]
    spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, t in enumerate(texts):
        lines = t.split("\n")
        for size in range(3, 31):
            every = ["\n".join(lines[k : k + size]) for k in range(len(lines) - size + 1)]
            want |= {(i, size, hashlib.md5(b.encode()).hexdigest(), every.index(b), every.count(b)) for b in every if every.count(b) > 1}
    got = QUERIES["block_repeat_candidates"](spark, str(tmp_path)).select("doc_id", "size", "block", "first_pos", "n").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want and {r.size for r in got if r.doc_id == 0} == set(range(3, 31))


def test_repeated_lines_are_counted(spark, tmp_path):
    long = ["word " * 40 + str(i % 3 // 2) for i in range(22)]
    texts = ["\n".join([*long, "", "", "\u3000", "\u3000", "é", "é", "é"]), "\n".join(long), "a\na", "\n".join([*long, *long, *long, *long])]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(ORACLE["under_compression"])
    names, rows = [c[0] for c in found.description], QUERIES["under_compression"](spark, str(tmp_path)).collect()
    assert plain([[r[c] for c in names] for r in rows]) == plain(found.fetchall())
    # at least 1,000 tokens and below the budget: the first two
    want = [sum(bool(y.strip()) and x == y for x, y in zip(v, v[1:])) for v in (t.split("\n") for t in texts[:2])]
    assert sum(r.twice_lines for r in rows) == sum(want) == 16 and sum(r.blank_lines for r in rows) == 4


def test_prefixes_of_every_line(spark, small):
    head = [" STDERR | ", "err: ", "error: "]
    strip = lambda x: re.sub(r"(?i)^\s*(?:stderr|err)\s*(?:\||:)\s*", "", x)
    got = {r.doc_id: r.stripped for r in same_as_sql(spark, small, "stderr_prefix")}
    assert got == {i: "\n".join(strip(head[i % 3] + x) for x in t.split("\n")) for i, t in enumerate(TEXTS) if t is not None}
    assert got[2].count("\n") == TEXTS[2].count("\n") > 0


def test_top_offenders_do_not_follow_the_order_of_rows(spark, tmp_path):
    # equal in size, type and command; five more than the limit
    rows = [(15 * i + 2, "x" * (12001 + 40 * i)) for i in range(30)]
    got = []
    for name, order in (("up", rows), ("down", rows[::-1])):
        spark.createDataFrame(order, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got.append([tuple(r) for r in QUERIES["under_compression_top"](spark, f"{tmp_path}/{name}").collect()])
    every = duckdb.connect().execute(f"create view documents as select * from '{tmp_path}/up/documents.parquet/*.parquet'").execute(ORACLE["under_compression_top"].replace("LIMIT 25", "")).fetchall()
    assert len(every) == 30 and got[0] == got[1] == sorted(every, key=lambda r: (-r[0], r[1:]))[:25]
