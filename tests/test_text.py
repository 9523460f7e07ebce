import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from laconic.functions import commands
from laconic.functions import text as tx
from laconic.operators import outputs as o
from laconic.operators import stats
from laconic.operators.condense import condensed, rules
from laconic.plans.compress import register

TEXTS = ["", "\n", "a", "a\n", "a\r\nb\r\n", "a\rb", "\n\n\n", "x\nx\nx", "x\nx", " \n \n \n", "é😀\né😀\né😀\né😀", "a\r\na\r\na\r\n", "  x  ", "error: 1\nok\nFAILED\nfailure", None]


def sample():
    rng = random.Random(5)
    pool = ["a", "b", "", "  ", "error x", "é😀 line", "k" * 50, "rep 1", " rep 1 ", "rep 2"]
    return TEXTS + ["\n".join(rng.choice(pool[: rng.randrange(2, 11)]) for _ in range(rng.randrange(30))) for _ in range(150)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(sample())), "i int, t string").cache()


def hold(df, column, f):
    for r in df.select("t", column.alias("got")).collect():
        assert r.got == (None if r.t is None else f(r.t)), (r.t, r.got)


def test_lines(df):
    hold(df, tx.lines_lf("t"), lambda t: t.split("\n"))
    hold(df, tx.lines_crlf("t"), lambda t: t.replace("\r\n", "\n").split("\n"))
    hold(df, tx.lines("t"), commands.split_lines)
    hold(df, tx.trim("t"), str.strip)
    hold(df, tx.newlines("t"), lambda t: t.count("\n"))
    hold(df, tx.tokens("t"), lambda t: (len(t) + 3) // 4)


def test_folding_and_cutting(df):
    hold(df, tx.fold_runs("t"), o.fold_runs)
    hold(df, tx.fold_runs("t", 2), lambda t: o.fold_runs(t, 2))
    for most in (10, 26, 27, 60, 100):
        hold(df, tx.cut_chars("t", most), lambda t, most=most: t if o.size(t) <= most else o.cut_chars(t, most))
    for limit in (2, 3, 4, 20):
        cut = partial(tx.cut_line, limit=limit)
        hold(df, tx.joined(F.transform(tx.lines_lf("t"), lambda x: cut(x))), lambda t, limit=limit: "\n".join(o.cut_line(x, limit) for x in t.split("\n")))
    hold(df, tx.smart_truncate("t", 6, 2, 1, "^rep", F.array(F.lit("kk"), F.lit("z"))), lambda t: o.smart_truncate(t, 6, 2, 1, [__import__("re").compile("^rep")], ["kk", "z"]))


def balanced_by_hand(t, most, head, middle, tail):
    lines = t.split("\n")
    n = len(lines)
    if not most or n <= most:
        return t
    start = max(0, n - middle) // 2
    kept = {i for i in range(n) if i < head or start <= i < start + middle or i >= n - tail}
    while len(kept) > most:
        kept.discard(min((i for i in kept if i >= start), default=max(kept)))
    return o.render(lines, sorted(kept))


def test_balanced(df):
    for a in ((8, 3, 3, 3), (5, 4, 4, 4), (3, 5, 0, 5), (2, 6, 6, 0), (0, 1, 1, 1), (1, 0, 0, 3)):
        hold(df, tx.balanced_truncate("t", *a), lambda t, a=a: balanced_by_hand(t, *a))


def first_by_hand(t):
    seen, out = set(), []
    for x in t.split("\n"):
        if x.strip().startswith("rep"):
            if x.strip() in seen:
                continue
            seen.add(x.strip())
        out.append(x)
    return "\n".join(out)


def clean_by_hand(t):
    out = []
    for x in commands.split_lines(t):
        if x.strip() and (not out or out[-1] != x):
            out.append(x)
    return "\n".join(out)


def test_first_of_each_and_floor(df):
    hold(df, tx.joined(tx.first_of_each(tx.lines_lf("t"), r"^\s*rep")), first_by_hand)
    hold(df, tx.safe_clean("t"), clean_by_hand)


def test_many_lines(spark):
    # distinct lines and a long run: work grows with the lines, not with their square
    t = "\n".join([f"Line {k}" for k in range(60_000)] + ["same"] * 1000 + ["Line 7"])
    df = spark.createDataFrame([(t,)], "t string")
    got = df.select(tx.fold_runs("t").alias("folded"), tx.joined(tx.first_of_each(tx.lines_lf("t"), "^L")).alias("kept")).first()
    assert got.folded == o.fold_runs(t)
    assert got.kept == t.removesuffix("\nLine 7")


def test_predicates(spark):
    rows = [("stderr | x", "x"), (" ERR: y", "y"), ("error: z", "error: z"), ("stderr", "stderr")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert all(r.got == r.b for r in df.select("b", tx.strip_stderr("a").alias("got")).collect())
    marks = {"an Error": True, "failover": False, "it failed": True, "access denied": True, "undenied": False, "not found": True, "fine": False}
    df = spark.createDataFrame(list(marks.items()), "a string, b boolean")
    assert all(r.got == r.b for r in df.select("b", tx.is_error_line("a").alias("got")).collect())
    df = spark.createDataFrame([("a/b/c", "a/b"), ("/x", ""), ("x", "."), ("a/", "a")], "a string, b string")
    assert all(r.got == r.b for r in df.select("b", tx.directory("a").alias("got")).collect())


def test_condensing(spark):
    assert [len(rules("user", x)) for x in ("lite", "full", "ultra", "other")] == [24, 32, 42, 24]
    assert len(rules("user", "ultra", strict=False)) == 47 and "summary_replacement" in [r[0] for r in rules("assistant", "lite")]
    cases = {
        "Hello, could you please provide a detailed explanation of X": "explain X",
        "please  fix\n    indented\n": "fix\nindented",
        "I think that in order to go": "to go",
        "Please stay": "Please stay",
        "a\r\n b \r\n": "a\nb",
        "": "",
    }
    df = spark.createDataFrame(list(cases.items()), "a string, b string")
    assert all(r.got == r.b for r in df.select("b", condensed("a").alias("got")).collect())
    df = spark.createDataFrame([("the database configuration and dependencies", "DB config"), ("x", "x")], "a string, b string")
    assert df.select(condensed("a", level="ultra")).first()[0] == "the DB config and dep"
    assert df.select(condensed("a", level="ultra", strict=False)).first()[0] == "DB config and dep"


def test_stats(spark):
    facts = spark.createDataFrame([("f", "t", 100, 30, "2024-01-02 03:04:05"), (None, "t", 10, 20, "2024-01-02 03:59:00"), ("f", "u", 0, 0, "2024-02-01 00:00:00")], "filter_id string, command_type string, original long, compressed long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    s = stats.summary(facts).first()
    assert (s.messages, s.original, s.compressed, s.saved) == (3, 110, 50, 70) and s.avg_savings_pct == pytest.approx(7000 / 110)
    assert tuple(stats.summary(facts.limit(0)).first()) == (0, 0, 0, 0, 0.0)
    assert [tuple(r) for r in stats.top_filters(facts).collect()] == [("f", 2), ("none", 1)]
    assert [tuple(r) for r in stats.top_commands(facts, 1).collect()] == [("t", 2, 70)]
    got = {(r.grain, r.bucket): (r.messages, r.saved) for r in stats.all_series(facts).collect()}
    assert got == {("hour", "2024-01-02T03"): (2, 60), ("hour", "2024-02-01T00"): (1, 0), ("day", "2024-01-02"): (2, 60), ("day", "2024-02-01"): (1, 0), ("month", "2024-01"): (2, 60), ("month", "2024-02"): (1, 0)}
    uses = spark.createDataFrame([("k", 0), ("k", 5), ("k", 11), ("j", 5)], "key string, t long")
    assert tuple(stats.hit_rate(stats.cache_hits(uses, ["key"], "t", 5)).first()) == (1, 3, 25.0)
    assert tuple(stats.hit_rate(stats.cache_hits(uses.limit(0), ["key"], "t", 5)).first()) == (0, 0, 0.0)


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("select estimate_tokens('12345') a, fold_lines('x\nx\nx') b, compress_output('done', 'echo done') c").first()
    assert tuple(r) == (2, "x\n[rtk:dropped 2 repeated lines]", "done")
