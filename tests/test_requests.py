import json

from pyspark.sql import functions as F

from laconic.config import EngineConfig
from laconic.operators import hints
from laconic.plans.requests import messages, processed, session_updates, with_sessions
from laconic.queries import CALLS
from laconic.sources import encode, requests, state
from laconic.sources.rules import custom, custom_from

LS = "\n".join(f"./src/d{i % 3}/f{i}.rs" for i in range(30))
STATUS = "On branch main\nChanges not staged for commit:\n" + "\n".join(f"\tmodified:   dir{i % 5}/file{i}.ts" for i in range(25))


def chat(call_id="c1"):
    return {"model": "m", "messages": [{"role": "user", "content": "Hello, please run it"}, {"role": "assistant", "content": None, "tool_calls": [{"id": "c1", "function": {"name": "bash", "arguments": '{"command": "git status"}'}}]}, {"role": "tool", "tool_call_id": call_id, "content": STATUS}, {"role": "system", "content": "be brief"}, {"role": "user", "content": ""}]}


def blocks():
    return {"messages": [
        {"role": "assistant", "content": [{"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "find . -name x"}}, {"type": "tool_use", "id": "t2", "name": "Read", "input": {"file_path": "a.rs"}}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": LS}, {"type": "tool_result", "tool_use_id": "t2", "content": [{"type": "text", "text": "fn main() {}"}]}, {"type": "text", "text": "please go on"}, {"type": "image"}]},
        {"role": "user", "content": "plain"}]}


def parts(twice=False):
    call = {"functionCall": {"name": "read_file", "args": {"path": "a.rs"}}}
    return {"contents": [{"role": "user", "parts": [{"text": "please"}]}, {"role": "model", "parts": [call, *([call] if twice else [])]}, {"role": "function", "parts": [{"functionResponse": {"name": "read_file"}, "text": "fn main() {}"}]}]}


def items():
    return {"tools": [{"z": 1, "a": 2}], "input": [
        {"role": "user", "content": "please list"},
        {"type": "function_call", "call_id": "a", "name": "exec_command", "arguments": '{"cmd": "cargo build"}'},
        {"type": "function_call_output", "call_id": "a", "output": "Process running with session ID 7\nCompiling"},
        {"type": "function_call", "call_id": "b", "name": "write_stdin", "arguments": '{"session_id": 7, "chars": ""}'},
        {"type": "function_call_output", "call_id": "b", "output": "more"},
        {"type": "function_call_output", "call_id": "later", "output": "too early"},
        {"type": "function_call", "call_id": "later", "name": "exec_command", "arguments": {"command": "git status"}},
        {"type": "function_call_output", "call_id": "later", "output": STATUS},
        {"type": "function_call", "call_id": "s", "name": "write_stdin", "arguments": '{"session_id": 9, "chars": "$ git log -3\\n"}'},
        {"type": "function_call_output", "call_id": "s", "output": "commit x"}]}


def read(body):
    kind, rows, remembered = requests.read(json.dumps(body))
    return kind, [(r["kind"], r["text"], r["hint"]) for r in rows], [(r["session_id"], r["command"]) for r in remembered]


def test_dialects():
    assert read(chat()) == ("chat", [("user", "Hello, please run it", None), ("tool", STATUS, "git status"), ("other", "be brief", None)], [])
    assert read(chat("none"))[1][1][2] is None
    assert read(blocks()) == ("blocks", [("tool", LS, "find . -name x"), ("tool", "fn main() {}", "cat a.rs"), ("user", "please go on", None), ("user", "plain", None)], [])
    assert read(parts()) == ("parts", [("user", "please", None), ("tool", "fn main() {}", "cat a.rs")], [])
    assert read(parts(True))[1][1] == ("tool", "fn main() {}", None)
    kind, rows, remembered = read(items())
    assert kind == "items" and [r[2] for r in rows] == [None, "cargo build", "cargo build", None, "git status", "git log -3"]
    assert remembered == [(7, "cargo build"), (9, "git log -3")]
    for bad in (None, "", "nope", "[]", '{"foo": "bar"}', '{"messages": 3}', '{"input": "text"}', '{"messages": [3, null, {"content": 5}]}', '{"contents": [{"parts": [1, {"functionCall": 3}]}]}', '{"input": [1, {"type": 4, "content": [7]}]}'):
        assert requests.read(bad)[1] == []


def test_sessions_of_earlier_requests():
    body = {"input": [{"type": "function_call", "call_id": "x", "name": "write_stdin", "arguments": '{"session_id": 5, "chars": "q"}'}, {"type": "function_call_output", "call_id": "x", "output": "o"}, {"type": "function_call", "call_id": "y", "name": "exec_command", "arguments": '{"cmd": "ls", "session_id": 5}'}, {"type": "function_call_output", "call_id": "y", "output": "p"}]}
    assert [m["hint"] for m in requests.read(json.dumps(body))[1]] == [None, "ls"]
    assert [m["hint"] for m in requests.read(json.dumps(body), {5: "make"})[1]] == ["make", "make"]


def test_typed_commands():
    for chars in ("q", "PY", "cd repo", "export A=1", "", "  ", "\x03", "quit\n", "$ ", "bash"):
        assert requests.typed_command(chars) is None
    assert requests.typed_command("x\n% cargo test\n\n") == "cargo test" and requests.typed_command("/usr/bin/python3 a.py") == "python a.py"


def test_hints_in_both_forms(spark):
    rows = [*CALLS, ("rg", '{"regex": "a", "directory": "d", "glob": "*.x"}'), ("Bash", '{"command": ["a"]}'), ("READ.FILE.view", '{"file": "z"}'), ("grep", "{}"), ("ls", "{}"), ("bash", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, args string")
    for r in df.select("*", hints.hint("name", "args").alias("h")).collect():
        assert r.h == requests.plain_hint(r.name, requests._arguments(r.args) if r.args else None), r
    df = spark.createDataFrame([("Process running with session ID 12\n",), ("x\nProcess session ID 3",), ("none",)], "o string")
    assert [r[0] for r in df.select(hints.session_in("o")).collect()] == [12, 3, None]


def test_requests_in_spark(spark):
    bodies = [(1, json.dumps(chat())), (2, json.dumps(blocks())), (3, json.dumps(parts())), (4, json.dumps(items(), separators=(",", ":"))), (5, "nope"), (6, None), (7, '{"foo": 1}')]
    df = spark.createDataFrame(bodies, "request_id long, body string")
    m = {(r.request_id, r.pos): r for r in messages(df, EngineConfig(condense=True)).collect()}
    assert m[1, 0].after == "run it" and m[1, 1].filter_id == "git-status" and m[1, 1].command_type == "git-status" and m[1, 2].filter_id is None
    assert m[2, 0].command_type == "file-list" and m[2, 0].after == LS and m[2, 1].command_type == "file-read"
    assert m[4, 0].after == "please list" and m[4, 1].command_type == "cargo-build"
    out = {r.request_id: r for r in processed(df, EngineConfig(condense=True)).collect()}
    assert len(out) == 7 and all(out[k].new_body == dict(bodies)[k] for k in (5, 6, 7))
    one = out[1]
    assert one.saves and one.filters == ["git-status"] and one.compressed < one.original and one.h_commands == f"git-status:{one.per_command[0].original}->{one.per_command[0].compressed},"
    new = json.loads(one.new_body)
    assert list(new) == ["model", "messages"] and new["messages"][0]["content"] == "run it" and "[rtk:grouped" in new["messages"][2]["content"]
    four = out[4]
    assert four.saves and four.new_body.startswith('{"tools":[{"z":1,"a":2}],"input":[{"role":"user"') and "[rtk:grouped" in four.new_body
    assert json.loads(four.new_body)["input"][:7] == items()["input"][:7]
    assert processed(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    one, two = json.dumps(chat()), json.dumps(blocks())
    alone = {b: spark.createDataFrame([(1, b)], "request_id long, body string") for b in (one, two)}
    want = {b: processed(df).drop("request_id").first() for b, df in alone.items()}
    df = spark.createDataFrame([(7, one), (7, one), (7, two), (None, one), (None, two)], "request_id long, body string")
    rows = processed(df).collect()
    assert sorted((str(r.request_id), r.body) for r in rows) == sorted((str(i), b) for i, b in df.collect())
    for r in rows:
        assert tuple(x for k, x in r.asDict().items() if k != "request_id") == tuple(want[r.body])
    assert want[one].original > want[one].compressed and not want[two].saves


def test_one_pass_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, json.dumps(chat()))], "request_id long, body string")
    plan = processed(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 2


def test_custom_filters_in_requests(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "mine", "category": "c", "priority": 900, "match": {"outputTypes": ["git-status"]}}]')
    df = spark.createDataFrame([(1, json.dumps(chat()))], "request_id long, body string")
    assert processed(df).first().filters == ["git-status"]
    assert processed(df, custom=custom(str(tmp_path))).first().filters == ["mine"]
    assert processed(df, EngineConfig(filters_dir=str(tmp_path))).first().filters == ["mine"]


def test_sessions_from_stored_state(spark):
    asks = json.dumps({"input": [{"type": "function_call", "call_id": "x", "name": "write_stdin", "arguments": '{"session_id": 5, "chars": ""}'}, {"type": "function_call_output", "call_id": "x", "output": "nothing to see"}]})
    bodies = [(1, asks), (1, asks), (None, json.dumps(items())), (4, None), (5, "nope")]
    df = spark.createDataFrame(bodies, "request_id long, body string")
    stored = spark.createDataFrame([(5, "old", 10), (5, "cargo build", 20), (6, "make", 30)], state.SCHEMA)
    with_known = with_sessions(df, stored)
    assert sorted((str(r.request_id), [tuple(k) for k in r.known or []]) for r in with_known.collect()) == sorted([("1", [(5, "cargo build")]), ("1", [(5, "cargo build")]), ("None", []), ("4", []), ("5", [])])
    done = processed(with_known, known="known")
    assert [r.per_command[0].command_type for r in done.where("request_id = 1").collect()] == ["cargo-build"] * 2
    assert processed(df).where("request_id = 1").first().per_command[0].command_type == "unknown"
    fresh = session_updates(done, 50)
    assert sorted(map(tuple, fresh.collect())) == [(7, "cargo build", 50), (9, "git log -3", 50)]
    assert sorted(map(tuple, state.merge(fresh, state.latest(stored)).collect())) == [(5, "cargo build", 20), (6, "make", 30), (7, "cargo build", 50), (9, "git log -3", 50)]


def test_patches():
    body = '{"b":1,"output":"x\\n1","a":[{"output": "y"}]}'
    assert encode.patched(body, [("x\n1", "X"), ("y", "Y")]) == '{"b":1,"output":"X","a":[{"output": "Y"}]}'
    assert encode.patched(body, [("x\n1", "X"), ("absent", "Z")]) is None and encode.patched(body, []) == body
    assert encode.patched('{"output":"é"}', [("é", "e")]) == '{"output":"e"}'


def test_state_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "old", 10), (1, "new", 20), (2, "x", 5)], state.SCHEMA)
    state.write(rows, str(tmp_path / "s"), 100)
    assert sorted(map(tuple, state.read(spark, str(tmp_path / "s"), 110, 60).collect())) == [(1, "new", 100), (2, "x", 100)]
    assert state.read(spark, str(tmp_path / "s"), 1000, 60).count() == 0
    fresh = spark.createDataFrame([(2, "y", 120)], state.SCHEMA)
    assert sorted(map(tuple, state.merge(fresh, state.read(spark, str(tmp_path / "s"), 110, 60)).collect())) == [(1, "new", 100), (2, "y", 120)]
    (tmp_path / "a.json").write_text('[{"session_id": 3, "command": "z", "updated_at": 50}]')
    assert state.from_json(spark, str(tmp_path / "a.json"), 60, 60).first().command == "z"


def test_packs_from_folders(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "mine", "category": "c", "match": {"outputTypes": ["git-status"]}}]')
    (tmp_path / "b.json").write_text("broken")
    assert [f.id for f in custom(str(tmp_path))] == ["mine"] == [f.id for f in custom_from(spark, str(tmp_path))]
    assert custom(str(tmp_path / "none")) == []


def test_bodies_from_text(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text(json.dumps(chat()) + "\n\nnope\n")
    rows = requests.from_text(spark, str(tmp_path / "r.jsonl")).collect()
    assert [r.rejected for r in rows] == [False, True, True]


def test_call_joins(spark):
    calls = spark.createDataFrame([(1, "a", 0, "x"), (1, "a", 5, "y"), (1, "a", 9, None), (1, "b", 1, "z")], "r int, id string, pos int, hint string")
    outs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "r int, id string")
    assert sorted(map(tuple, hints.last_call(calls, outs, ["r", "id"]).collect()), key=str) == [(1, "a", "y"), (1, "b", "z"), (1, "c", None), (2, "a", None)]
    assert sorted(map(tuple, hints.only_call(calls, outs, ["r", "id"]).collect()), key=str) == [(1, "a", None), (1, "b", "z"), (1, "c", None), (2, "a", None)]
    got = {r.pos: r.hint_before for r in hints.call_before(calls, ["r", "id"]).where(F.col("id") == "a").collect()}
    assert got == {0: None, 5: "x", 9: "y"}


def test_config():
    c = EngineConfig.from_env({"LACONIC_CONDENSE": "full", "LACONIC_GROUPING": "0", "LACONIC_CHAR_BUDGET": "99"})
    assert (c.condense, c.condense_level, c.grouping, c.char_budget, c.compress) == (True, "full", False, 99, True)
    assert EngineConfig.from_env({"LACONIC_CONDENSE": "ultra", "LACONIC_CONDENSE_LEVEL": "aggressive"}).condense_level == "lite"
    assert EngineConfig.from_env({}) == EngineConfig()


def test_variant_form_is_the_same(spark):
    from laconic.sources import variant

    odd = [{"messages": [3, None, {"content": 5}, {"role": "tool", "tool_call_id": "c1", "content": "o"}]}, {"contents": [{"parts": [1, {"functionCall": 3}, {"text": "t"}]}]}, {"messages": [{"role": "user", "content": [{"type": "tool_result", "content": [{"text": "a"}, {"text": ""}, 3]}, {"type": "text", "text": ""}]}]}]
    bodies = [json.dumps(b) for b in (chat(), chat("none"), blocks(), parts(), parts(True), *odd, {"foo": 1})] + ["nope", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id int, body string")
    got: dict = {}
    for r in variant.messages(df).collect():
        got.setdefault(r.request_id, []).append((tuple(r.at), (r.role, r.kind, r.text, r.hint)))
    for i, b in enumerate(bodies):
        want = [(m["role"], m["kind"], m["text"], m["hint"]) for m in requests.read(b)[1]]
        assert sorted(x for _, x in got.get(i, [])) == sorted(want, key=str) if not any(w[3] is None for w in want) else sorted(map(str, (x for _, x in got.get(i, [])))) == sorted(map(str, want)), i
