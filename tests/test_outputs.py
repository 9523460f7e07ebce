import json
import random

import pytest

from laconic.config import EngineConfig
from laconic.operators import outputs as o
from laconic.operators import plain
from laconic.plans.compress import compressed
from laconic.rules import filters

run = plain.compress_output


def many(n, f):
    return "\n".join(map(f, range(n)))


def test_small_and_empty():
    assert run("").text == ""
    r = run("just one sentence here")
    assert r.command_type == "unknown" and r.text and r.filter_id is None
    assert run("done\n", "echo done").text == "done\n" and run("\x1b[31mdone\x1b[0m", "echo done").text == "done"
    assert run("On branch main\nChanges not staged for commit:\n\tmodified: a\n").filter_id == "git-status"
    t = "On branch main\nChanges not staged for commit:\n" + many(25, lambda i: f"\tmodified:   dir{i % 5}/file{i}.ts")
    assert "[rtk:grouped 25 files across 5 directories]\n  dir0 (5 files)" in run(t).text
    assert run("running 10 tests\ntest a ... ok\ntest b ... FAILED\n\nfailures:\n  b\n\ntest result: FAILED. 9 passed\nx").filter_id == "test-cargo"


@pytest.mark.parametrize(
    ("text", "command", "kind", "n_lines"),
    [
        ("$ cat src/main.rs\n" + many(180, lambda i: f"line_{i:03d}"), None, "file-read", 181),
        ("$ find . -type f\n" + many(220, lambda i: f"./src/d{i % 7}/f{i}.rs"), None, "file-list", 221),
        (many(300, lambda i: f"0000{i:04x} mov x0, x{i % 7}"), "otool -tV bin", "binary-read", 300),
        (many(200, lambda i: f"src/a.rs:{i}: target_sym"), "rg target_sym", "shell-grep", 200),
        (many(120, lambda i: f"code {i}"), "sed '1,240p' src/mod.rs", "file-read", 120),
        ("$ yq . config.yml\n" + many(270, lambda i: f"item_{i}: x"), None, "structured-read", 271),
        (many(120, lambda i: f"kern.x{i}: {i}"), "sysctl -a", "macos-inspect", 120),
        (many(40, lambda i: f"u{i}") + "\nsame" * 5 + "\n" + many(40, lambda i: f"v{i}"), "otool -tV bin", "binary-read", 85),
    ],
)
def test_kept_whole(text, command, kind, n_lines):
    r = run(text, command)
    assert r.command_type == kind and len(r.text.split("\n")) == n_lines and "[rtk:" not in r.text


def test_budget():
    r = run(many(30, lambda i: f"{i:02d} " + "x" * 505))
    assert o.size(r.text) <= 12_000 and "[rtk:truncated" in r.text
    t = many(400, lambda i: f"src/f{i}.rs:{i}: " + ("needle_symbol" if i == 200 else "y" * 40))
    assert "needle_symbol" in run(t, "rg needle_symbol src").text and o.size(run(t, "rg needle_symbol src").text) <= 12_000
    block = many(8, lambda i: f"frame {i} " + "z" * 40)
    t = "\n".join([block] * 20 + ["error: the middle"] + [block] * 20)
    assert "error: the middle" in run(t).text and o.size(run(t).text) < o.size(t) / 4


def test_kinds():
    t = 'Traceback (most recent call last):\n  File "foo.py", line 3, in <module>\n    main()\nValueError: bad'
    r = run(t, "python foo.py")
    assert (r.command_type, r.filter_id) == ("python-script", "python-script") and "Traceback" in r.text and "ValueError: bad" in r.text
    t = many(50, lambda i: f"   Compiling crate{i} v0.1.0") + "\nerror[E0308]: mismatched types\n --> src/main.rs:3:5\n  |\n3 |     x\n  |     ^ expected\n    Finished dev"
    r = run(t, "cargo build")
    assert (r.command_type, r.filter_id) == ("cargo-build", "compile-build") and "Compiling" not in r.text and " --> src/main.rs:3:5" in r.text and "Finished" in r.text
    r = run("commit 0123456789abcdef\nAuthor: A\n\n    msg\n\n@@ -1,2 +1,3 @@\n+new line\n-old", "git log -p")
    assert r.command_type == "git-log" and "+new line" in r.text and "@@" in r.text
    assert "hello body" in run("HTTP/1.1 200 OK\nServer: x\n\nhello body", "curl -i https://example.com").text
    t = many(250, lambda i: "\x1b[31mERROR here\x1b[0m" if i == 130 else f"row {i}")
    r = run(t, "./mytool --run")
    assert r.command_type == "unknown" and "\x1b" not in r.text and "[rtk:truncated" not in r.text and r.filter_id == "generic-output"


def test_folding():
    t = many(35, lambda i: f"u{i}") + "\nsame" * 5
    assert "[rtk: omitted" in run(t, "./noise").text
    block = many(10, lambda i: f"b{i}")
    t = "\n".join(f"{block}\nsep{k}" for k in range(3)) + "\n" + many(30, lambda i: f"w{i}")
    r = run(t, "./tool").text
    assert "omitted 10-line block" in r and r.count("b9") == 1
    fold = lambda n: o.fold("\n".join(["x"] * n)).split("\n")
    note = lambda n: o.NOTE_BLOCK.format(n, "x")
    assert fold(2) == ["x", "x"] and fold(3) == ["x", "[rtk:dropped 2 repeated lines]"] and fold(4) == ["x", note(3)]
    assert fold(31) == ["x", note(30)] and fold(32) == ["x", note(30), "x"] and fold(34) == ["x", note(30), note(3)] and fold(91) == ["x", note(30), "[rtk:dropped 2 repeated lines]"]
    assert o.fold_runs("a\na\r\na\r\na\r") == "a\na\r\n[rtk:dropped 2 repeated lines]" and o.fold_runs("\n\n\n\n") == "\n\n\n\n"


def blocks_by_hand(text):
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        n = next((k for k in range(min(30, len(lines) - i), 2, -1) if any(lines[j : j + k] == lines[i : i + k] for j in range(i))), 0)
        if n and len(lines) >= 3:
            out.append(o.NOTE_BLOCK.format(n, o._anchor(lines[i])))
            i += n
        else:
            out.append(lines[i])
            i += 1
    return "\n".join(out)


def budget_by_hand(text, most, keywords):
    if not most or o.size(text) <= most:
        return text
    lines = text.split("\n")
    n = len(lines)
    must = {i for i, x in enumerate(lines) if o._ERROR.search(x) or o.has_keyword(x, keywords)}
    shown = lambda h, t: o.render(lines, sorted(must | set(range(h)) | set(range(n - t, n))))
    h = t = 0
    if o.size(shown(0, 0)) <= most:
        moved = True
        while moved:
            moved = False
            if h + t < n and o.size(shown(h + 1, t)) <= most:
                h, moved = h + 1, True
            if h + t < n and o.size(shown(h, t + 1)) <= most:
                t, moved = t + 1, True
    out = shown(h, t)
    return out if o.size(out) <= most else o.cut_chars(out, most)


def test_sequential_steps_like_plain_versions():
    rng = random.Random(11)
    pool = ["a", "b", "", "  ", "error x", "é😀 long line", "key", "[rtk:x]", 'q"\\']
    for _ in range(1500):
        lines = [rng.choice(pool[: rng.randrange(1, 10)]) for _ in range(rng.randrange(45))]
        for _ in range(rng.randrange(4)):
            if lines:
                i, n, j = rng.randrange(len(lines)), rng.randrange(1, 35), rng.randrange(len(lines))
                lines[j:j] = lines[i : i + n]
        text = "\n".join(lines)
        assert o.fold_blocks(text) == blocks_by_hand(text)
        most = rng.choice([0, 5, 26, 30, 60, 100, 200, 400])
        assert o.within_budget(text, most, ["key"]) == budget_by_hand(text, most, ["key"]), (text, most)


def test_filter_stages():
    pack = [{"id": "t", "category": "c", "match": {"outputTypes": ["unknown"]}, "rules": {
        "stripAnsi": True, "filterStderr": True, "replace": [{"pattern": r"(\d+)ms", "replacement": "${1} ms"}, {"pattern": "(", "replacement": ""}],
        "matchOutput": [{"pattern": "^all good$", "message": "ok", "unless": "warn"}], "dropPatterns": ["^noise", "(?=x)"], "collapsePatterns": ["^rep"], "truncateLineAt": 12, "maxLines": 4, "headLines": 1, "tailLines": 1, "onEmpty": "(nothing)"},
        "preserve": {"errorPatterns": ["IMPORTANT"]}}]
    (f,) = filters.parse(json.dumps(pack))
    assert o.filter_lines("\x1b[1mstderr: took 5ms\x1b[0m\r\nNOISE x", f) == "took 5 ms"
    assert o.filter_lines("x\nAll good\ny", f) == "ok" and o.filter_lines("All good\nwarn", f) != "ok"
    assert o.filter_lines("noise\nNoise 2", f) == "(nothing)"
    assert o.filter_lines("rep a\nb\nrep a\nrep c", f) == "rep a\nb\nrep c"
    assert o.filter_lines("123456789012345", f) == "123456789..."
    assert o.filter_lines("1\n2\nimportant\n4\n5\n6", f) == "1\n[rtk:truncated 1 lines]\nimportant\n[rtk:truncated 2 lines]\n6"
    (g,) = filters.parse(json.dumps([{"id": "g", "category": "c", "match": {"outputTypes": ["x"]}, "rules": {"includePatterns": ["^keep"]}}]))
    assert o.filter_lines("a\nkeep b", g) == "keep b" and o.filter_lines("a\nb", g) == "a\nb"


def test_packs():
    assert filters.parse("not json") == [] and filters.parse('[{"id": "x"}]') == [] and filters.parse('{"id": "x"}') == []
    old = filters.parse('[{"id": "b", "category": "c", "commandTypes": ["git-status"], "stripPatterns": ["x"], "maxLines": 3, "priority": 9}, {"id": "a", "category": "c", "priority": 9}]')
    assert [f.id for f in old] == ["a", "b"] and (old[1].types, old[1].drop, old[1].max_lines, old[1].head) == (("git-status",), ("x",), 3, 20)
    (f,) = filters.parse('[{"id": "m", "category": "c", "match": {"commands": ["^x"]}}]', filters.CUSTOM)
    assert (f.head, f.tail) == (0, 0) and filters.combined([f])[0] is f
    (f,) = filters.parse('[{"id": "m", "category": "c", "match": {"commands": ["^x"]}, "rules": {}}]')
    assert (f.head, f.tail) == (20, 20)
    ids = {f.id for f in filters.builtin()}
    assert {"git-status", "git-diff", "test-cargo", "generic-output", "file-read", "python-script", "binary-read", "macos-inspect", "compile-build"} <= ids


def test_grouping():
    files = many(6, lambda i: f"./d{i % 2}/f{i}")
    assert o.group(files, "shell-ls") == ("[rtk:grouped 6 files across 2 directories]\n  ./d0 (3 files)\n  ./d1 (3 files)", True)
    assert o.group(files, "file-list")[1] is False and o.group("./a/b\n./c/d", "shell-ls")[1] is False and o.group(many(6, lambda i: f"./d/f{i}"), "unknown")[1] is False
    t = "head\nPASS a\nPASS b\nFAIL c\n  detail\n\nTests: 2 passed\n"
    assert o.group(t, "test-jest") == ("head\n[rtk:test-failures 2]\nFAIL c\n  detail\n[rtk:test-passed 2 tests]\nTests: 2 passed", True)
    t = "start\nerror: a\n" + many(12, lambda i: f"warning: w{i}") + "\nnote: n\n\n"
    out, done = o.group(t, "ruff")
    assert done and out.startswith("start\n[rtk:build-errors 1]\nerror: a\n[rtk:build-warnings 12]\nwarning: w0") and out.endswith("warning: w9\n  ... and 2 more warnings\n[rtk:build-info 1 messages]")
    assert o.group("one\ntwo\nthree\nfour\nfive", "ruff")[1] is False


def test_cuts():
    assert o.cut_line("abcdef", 5) == "ab..." and o.cut_line("abcdef", 3) == "abc" and o.cut_line("abc", 3) == "abc"
    assert len(o.cut_chars("é" * 100, 50)) == 50 and o.cut_chars("x" * 100, 10) == o.NOTE_CHARS[:10]
    assert o.smart_truncate("a\nb\nc", 0, 1, 1) == "a\nb\nc" and o.smart_truncate("a\nb\nc", 2, 1, 0) == "a"


def test_in_spark(spark):
    rows = [(1, "git status", "On branch main\nUntracked files:\n  x"), (2, None, None), (3, None, "tiny"), (4, "rg x", many(50, lambda i: f"a/b.rs:{i}: x")), (4, "rg x", many(50, lambda i: f"a/b.rs:{i}: x"))]
    df = spark.createDataFrame(rows, "id long, cmd string, text string")
    for distinct in (False, True):
        for r in compressed(df, "text", "cmd", distinct=distinct).collect():
            want = None if r.text is None else run(r.text, r.cmd)
            assert (r.compressed, r.filter_id, r.command_type, r.grouped) == ((want.text, want.filter_id, want.command_type, want.grouped) if want else (None, None, None, False))
    off = compressed(df, "text", "cmd", EngineConfig(compress=False)).collect()
    assert all(r.compressed == r.text and r.original_tokens == r.compressed_tokens for r in off)
    assert compressed(df.limit(0), "text", "cmd").count() == 0
