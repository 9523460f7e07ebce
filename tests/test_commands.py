import pytest
from pyspark.sql import functions as F

from laconic.functions import commands as c
from laconic.functions.patterns import jvm, lint, needed, python
from laconic.operators import detect, plain
from laconic.rules import detectors
from laconic.rules.condense import RULES


@pytest.mark.parametrize(
    ("raw", "normal"),
    [
        ("FOO=1 BAR='x y' cargo test", "cargo test"),
        ("cd /repo && git status", "git status"),
        ("/usr/bin/python3.11 -m pytest -q", "python -m pytest -q"),
        ("bash -lc 'cargo build --release'", "cargo build --release"),
        ('zsh -c "rg foo src"', "rg foo src"),
        ("/usr/bin/time -lp cargo build", "cargo build"),
        ("# a comment\n\nls -la", "ls -la"),
        ("$ $ git log", "git log"),
        ("env A=1 nice -n 5 make all", "make all"),
        ("frobnicate --x; true", "frobnicate --x"),
        ("python3 - <<'PY'", "python - <<'PY'"),
        ("", ""),
    ],
)
def test_normalise(raw, normal):
    assert c.normalise(raw) == normal


@pytest.mark.parametrize(
    ("text", "command", "kind"),
    [
        ("", "cargo nextest run", "test-cargo"), ("", "cargo build", "cargo-build"), ("", "swift build", "swift-build"), ("", "go vet ./...", "go-build"), ("", "clang a.c", "clang-build"), ("", "sysctl -a", "macos-inspect"), ("", "codesign -d x", "macos-inspect"),
        ("", "dyld_info x", "binary-read"), ("", "python3 -c 'x'", "python-script"), ("", "python", "python-script"), ("", "python -m json.tool a", "python-script"), ("", "python -m pytest", "test-pytest"), ("", "python -m mypy x", "mypy"), ("", "python -m pip list", "pip"),
        ("", "sed -n '1,20p' a.rs", "file-read"), ("", "sed '1,240p' src/mod.rs", "file-read"), ("", "sed -i s/a/b/ x", "unknown"), ("", "cat a.yaml", "structured-read"), ('{"a": 1}', "cat a.json", "json-output"), ("", "npm run build", "npm-script-build"),
        ("", "g++ a.c", "unknown"), ("", "cd x && cmake ..", "unknown"), ("src/a.rs\nsrc/b.rs", "find . -type f", "file-list"), ("./x\n./y", "find .", "shell-find"), ("On branch main\nUntracked files:\n x", None, "git-status"), ("On branch main", None, "unknown"),
        ("$ git status\nclean", None, "git-status"), ("Traceback (most recent call last):\nError: x", None, "generic-error"), ("plain words", None, "unknown"), ("a ERROR b", None, "unknown"),
    ],
)
def test_detect(text, command, kind):
    assert plain.detect(text, command)[0] == kind


def test_detection_as_columns_is_the_same(spark):
    texts = ["", "plain", "On branch main\nUntracked files:\n", "commit 0123456789\nAuthor: x", "running 3 tests\ntest a ... ok\ntest result: ok", '[{"a": 1}]', "src/a.py:3:\nlib/b.go:4:", "Traceback (most recent call last):\n  File \"x\", line 3\nImportError", "● a.service\n Loaded: x\n Active: y", "diff --git a b\n@@ -1,2 +3,4 @@", "é * main\n* x\nSwitched to branch 'a'"]
    cmds = [None, "", "git status", "sed '1,3p' x", "sed 's/a/b/' x", "cargo test", "python3 x.py", "g++ a.c", "clang++ a.c", "weird", "bash -c 'npm test'"]
    rows = [(t, k) for t in [*texts, None] for k in cmds]
    df = spark.createDataFrame(rows, "text string, cmd string")
    for r in detect.detected(df, "text", "cmd").collect():
        assert (r.command_type, r.category, r.confidence, r.norm_command) == plain.detect(r.text or "", r.cmd), r


@pytest.mark.parametrize(
    ("command", "terms"),
    [
        ("rg needle src", ["needle"]), ("rg --files src", []), ("grep 'two words' x", ["two words"]), ("echo hi\nrg -n foo_bar src", ["foo_bar"]), ("rg '.{0,100}Foo.*' x", ["Foo"]), ("rg 'alpha|beta_x' .", ["alpha", "beta_x"]), ("cat x | grep -i err", ["err"]),
        ("rg 'a | b' x", []), ("rg 'one two' x", ["one two"]), ("LC_ALL=C /usr/bin/grep -e one -e two f", ["one", "two"]), ("ag ./path word", ["word"]), ("ls", []), ("rg a", []),
    ],
)
def test_search_terms(command, terms):
    assert c.search_terms(command) == terms


def test_reads_with_sed():
    assert [c.reads_with_sed(x) for x in ("sed -n 1p a", "sed '1,240p' a", "sed -e 3q a", "sed 's/a/b/' a", "sed -n 's#a#b#p' a", "awk x")] == [True, True, True, False, False, False]


def test_rules_are_complete_and_sound(spark):
    assert len(detectors.DETECTORS) == 66 and len(RULES) == 49
    assert [r[0] for r in RULES if lint(r[3])] == ["pleasantries", "filler_adverbs", "emphasis_removal", "articles", "leader_phrases"]
    for d in detectors.DETECTORS:
        for p in [*d[2], *d[3]]:
            assert lint(p) is None
            python(p)
            spark.range(1).where(F.lit("x").rlike(jvm(p))).count()


@pytest.mark.parametrize(("pattern", "text", "matches"), [("a.b", "a\rb", True), ("a.b", "a\nb", False), ("b$", "ab\n", False), ("(?m)^b$", "a\nb\n", True), ("(?m)^b$", "b\r\n", False), (r"\bt\b", "été", False), (r"\w", "é", True), ("(?i)É", "é", True), ("[$]", "$", True), (r"\$", "$", True)])
def test_one_dialect(spark, pattern, text, matches):
    assert bool(python(pattern).search(text)) == matches
    assert spark.range(1).select(F.lit(text).rlike(jvm(pattern))).first()[0] == matches


def test_needed_literals():
    assert needed(r"(?m)^On branch ") == (("On branch ",), False)
    assert needed(r"(?i)Plan: \d+ to add") == ((" to add",), True)
    assert needed(r"(?:abc|de)x?") == (("abc", "de"), False)
    assert needed(r"[ab]+")[0] == ()
