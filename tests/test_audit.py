import json

from pyspark.sql import functions as F

from laconic.functions import commands
from laconic.operators import plain
from laconic.plans import audit
from laconic.sources import sessions


def line(item, wrapped=False):
    return json.dumps({"type": "response_item", "payload": {"item": item} if wrapped else item})


LOG = [
    line({"type": "function_call", "name": "exec_command", "call_id": "1", "arguments": '{"cmd": "cat a.rs"}'}),
    line({"type": "function_call_output", "call_id": "1", "output": "Chunk\nOriginal token count: 40\nOutput:\nline 1\n\nline 2"}, True),
    line({"type": "function_call", "name": "shell_command", "call_id": "2", "arguments": {"command": ["git", "status"]}}, True),
    line({"type": "function_call_output", "call_id": "2", "output": "first"}),
    line({"type": "function_call_output", "call_id": "2", "output": {"k": 1}}),
    line({"type": "function_call", "name": "exec_command", "call_id": "3", "arguments": '{"cmd": "  "}'}),
    line({"type": "function_call_output", "call_id": "3", "output": "no command"}),
    line({"type": "function_call_output", "call_id": "orphan", "output": "x"}),
    line({"type": "function_call", "name": "other", "call_id": "4", "arguments": "{}"}),
    '{"type": "other"}', "broken", "", json.dumps({"type": "response_item"}),
]


def test_pairs(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "a.jsonl").write_text("\n".join(LOG))
    (tmp_path / "b.txt").write_text(LOG[0])
    items = sessions.items(sessions.session_lines(spark, str(tmp_path)))
    got = {r.call_id: (r.command, r.output, r.header_tokens) for r in audit.paired(items).collect()}
    assert got == {"1": ("cat a.rs", "line 1\n\nline 2", 40), "2": ("git\nstatus", '{"k":1}', None)}
    assert tuple(audit.pairing_counts(items).first()) == (3, 2, 2)
    (tmp_path / "c").write_text('"git status"\n\nls -la\n"  "\n[1]\n')
    assert [r.command for r in sessions.commands(spark, str(tmp_path / "c")).collect()] == ["git status", "ls -la", "[1]"]


PAIRS = [("cat src/a.rs", "fn a() {}\n\nfn a() {}\n" * 30), ("cat src/a.rs", "one"), ("./tool", "\n".join(f"./d{i % 3}/f{i}" for i in range(40))), ("./tool", "row\n" * 3 + "\n\nend"), ("rg key src", "\n".join(f"a/b.rs:{i}: key {i} {'x' * 60}" for i in range(300))), ("echo hi", "hi"), ("./long", "\n".join(f"{i} {'y' * 90}" for i in range(60)))]


def test_measures(spark):
    df = spark.createDataFrame(PAIRS, "command string, output string")
    m = audit.measured(df).cache()
    rows = m.collect()
    for (c, t), r in zip(PAIRS, rows, strict=True):
        want = plain.compress_output(t, c)
        assert (r.command_type, r.filter_id, r.out_bytes, r.orig_bytes) == (want.command_type, want.filter_id, len(want.text.encode()), len(t.encode()))
        floor = [x for x in commands.split_lines(t) if x.strip()]
        floor = [x for i, x in enumerate(floor) if not i or floor[i - 1] != x]
        assert r.safe_bytes == min(len(t.encode()), len("\n".join(floor).encode()))
        assert r.truncated == ("[rtk:truncated" in want.text) and r.n_keywords == len(commands.search_terms(c)) and r.out_lines == len(want.text.split("\n"))
    s = audit.scalars(m).first()
    assert (s.records, s.passthrough, s.orig_bytes, s.with_keywords) == (7, sum(r.passthrough for r in rows), sum(r.orig_bytes for r in rows), 1)
    assert audit.scalars(m.limit(0)).first().bytes_cut_pct == 0.0
    floor = {r.command_type: r for r in audit.against_floor(m).collect()}
    for kind, r in floor.items():
        own = [x for x in rows if x.command_type == kind]
        assert (r.unused, r.lossy) == (sum(max(0, x.out_bytes - x.safe_bytes) for x in own), sum(max(0, x.safe_bytes - x.out_bytes) for x in own)) and r.lossy == r.lossy_budget + r.lossy_rules
    assert sum(r.records for r in audit.unknown_losses(m).collect()) == floor["unknown"].n_lossy_rules
    assert [(r.target, r.reads) for r in audit.repeated_reads(m).collect()] == [("src/a.rs", 2)]
    assert {r.bucket: r.records for r in audit.reads(m).collect()} == {"0000-0050": 1, "0051-0150": 1}
    assert [r.exceeding for r in audit.read_caps(m).collect()] == [0, 0, 0]
    assert [(r.head, r.records) for r in audit.grouped_unknowns(m).collect()] == [("./tool", 1)]
    big = [r for r in rows if r.out_tokens >= 1000 and r.out_bytes / r.orig_bytes >= 0.9]
    assert sum(r.records for r in audit.under_compressed(m).collect()) == len(big) == audit.offenders(m).count()
    assert {r.command_type: r.records for r in audit.by_type(m).collect()}["file-read"] == 2 and audit.by_filter(m).count() > 2


def test_small_functions(spark):
    cases = {"sed -n '1,20p' src/x.rs": "src/x.rs", "cd a && cat b/c.txt | head -5": "head -5", "cat README.md": "README.md", "cat -n 1,2p": "cat -n 1,2p", "": ""}
    df = spark.createDataFrame(list(cases.items()), "a string, b string")
    assert all(r.got == r.b for r in df.select("b", audit.read_target("a").alias("got")).collect())
    forms = {"python -": "stdin/heredoc (python -)", "python - <<'PY'": "stdin/heredoc (python -)", "python -c 'x'": "-c inline", "python -m venv e": "-m venv", "python -m pip list": "-m (should-be-other!)", "python -m foo": "-m other module", "python -V": "--version", "python": "bare python", "python3 a.py x": ".py file (should-match!)", "python -u": "other"}
    df = spark.createDataFrame(list(forms.items()), "a string, b string")
    assert all(r.got == r.b for r in df.select("b", audit.python_form("a").alias("got")).collect())
    kinds = {"cd /x": "shell-control", "git statusx": "git-partial", "npx foo": "node-npm", "swift package": "build-partial", "brew x": "tooling", "sudo x": "privileged", "./a --b": "custom-binary", "run.sh": "custom-binary", "frob": "other", "pythonw x": "python-gap"}
    df = spark.createDataFrame(list(kinds.items()), "a string, b string").withColumn("h", audit.head_of("a"))
    assert all(r.got == r.b for r in df.select("b", audit.unknown_kind("a", "h").alias("got")).collect())


def test_command_report(spark):
    df = spark.createDataFrame([("git status",), ("cd /tmp",), ("frob " + "x" * 3000,), ("frob",), ("python3 -c 'x'",)], "command string")
    c = audit.classified(df).cache()
    t = audit.command_totals(c).first()
    assert (t.commands, t.unknown, t.unknown_short, t.unknown_long, t.unknown_pct) == (5, 3, 2, 1, 60.0)
    assert {r.kind: (r.commands, r.short, r.long) for r in audit.unknown_kinds(c).collect()} == {"shell-control": (1, 1, 0), "other": (2, 1, 1)}
    assert [(r.head, r.commands) for r in audit.unknown_heads(c).collect()] == [("frob", 2), ("cd", 1)]
    assert {r.command_type: r.commands for r in audit.command_types(c).collect()} == {"git-status": 1, "unknown": 3, "python-script": 1}
    assert audit.python_forms(c).count() == 0 and c.where(F.col("is_short")).count() == 4
