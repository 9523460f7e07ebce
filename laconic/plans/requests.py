"""Requests end to end: messages, hints, compression, totals, rewritten bodies.

    body -> parsed, its tool outputs compressed (one Arrow pass)
         -> user texts condensed, totals, filters, header values (Columns over the row's own array)
         -> the body to send (a second Arrow pass over the changed texts)

A request never leaves its row: nothing is shuffled, nothing is parsed or
compressed twice, and request ids are only carried along, so repeated and
null ids do no harm.  Commands of sessions from earlier requests come from a
state table (`with_sessions`), and `session_updates` gives what the requests
add to it.

Defined results: a body that is no request (null, not JSON, another shape)
has a null dialect, null totals, `saves` false, and is sent as it came.
"""

from __future__ import annotations

from dataclasses import astuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laconic.config import EngineConfig
from laconic.functions import text as tx
from laconic.operators import plain, stats
from laconic.plans.compress import user_text
from laconic.rules.filters import Filter, combined
from laconic.sources import requests as src
from laconic.sources import rules, state
from laconic.sources.encode import encode

MESSAGE = "pos int, path string, kind string, before string, after string, command_type string, filter_id string"
DONE = f"dialect string, messages array<struct<{', '.join(x.replace(' ', ':') for x in MESSAGE.split(', '))}>>, remembered array<struct<pos:int, session_id:long, command:string>>"


def _one(body: str | None, known, config: EngineConfig, filters: list[Filter]) -> tuple:
    dialect, rows, remembered = src.read(body, {k["session_id"]: k["command"] for k in known} if known is not None else None)
    out = []
    for m in rows:
        after, kind, found = m["text"], None, None
        if m["kind"] == "tool":
            if config.compress:
                after, kind, _, _, found, _ = astuple(plain.compress_output(m["text"], m["hint"], config, filters))
            found = found or "none"
        out.append({"pos": m["pos"], "path": m["path"], "kind": m["kind"], "before": m["text"], "after": after, "command_type": kind, "filter_id": found})
    return dialect, out, remembered


def _read(requests: DataFrame, config: EngineConfig, known: str | None, custom: list[Filter] | None) -> DataFrame:
    """requests with dialect, messages (MESSAGE with original, compressed, modified) and remembered."""
    if custom is None and config.filters_dir:
        custom = rules.custom(config.filters_dir)
    filters = combined(custom or ())

    @F.pandas_udf(DONE)
    def run(s: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_one(b, k, config, filters) for b, k in zip(s["b"], s["k"], strict=True)], columns=["dialect", "messages", "remembered"])

    before = F.col(known) if known else F.lit(None).cast(src.KNOWN)
    done = requests.withColumn("_p", run(F.struct(F.col("body").alias("b"), before.alias("k")))).select("*", "_p.*").drop("_p")

    def counted(m: Column) -> Column:
        after = F.when(m["kind"] == "user", user_text(m["before"], config)).otherwise(m["after"])
        kept = [m[c].alias(c) for c in ("pos", "path", "kind", "before")]
        # a lambda binds the condensed text, so that it is made once
        return tx.let(after, lambda a: F.struct(*kept, a.alias("after"), m["filter_id"].alias("filter_id"), m["command_type"].alias("command_type"), tx.tokens(m["before"]).alias("original"), tx.tokens(a).alias("compressed"), (a != m["before"]).alias("modified")))

    # one row stays one row; the generator keeps the optimiser from repeating the work for each use of the array
    return done.withColumn("messages", F.explode(F.array(F.transform("messages", counted))))


def messages(requests: DataFrame, config: EngineConfig | None = None, known: str | None = None, custom: list[Filter] | None = None) -> DataFrame:
    """(request_id, dialect, pos, path, kind, before, after, filter_id, command_type, original, compressed, modified) of each text.

    Item requests keep their user texts; other texts than those of tools
    and users are only counted.
    """
    return _read(requests, config or EngineConfig(), known, custom).select("request_id", "dialect", F.explode("messages").alias("m")).select("request_id", "dialect", "m.*")


def processed(requests: DataFrame, config: EngineConfig | None = None, known: str | None = None, custom: list[Filter] | None = None) -> DataFrame:
    """requests with dialect, remembered, their totals, filters, per_command, saves, header values and the body to send (new_body).

    known: a column of commands by session (see `with_sessions`); custom:
    filters before the built-in ones (default: those of config.filters_dir).
    """
    done = _read(requests, config or EngineConfig(), known, custom)
    total = lambda name: F.when(F.size("messages") > 0, F.aggregate(F.transform("messages", lambda m: m[name]), F.lit(0).cast("long"), lambda a, x: a + x))
    tools = F.filter("messages", lambda m: m["command_type"].isNotNull())
    named = lambda m: F.when(m["filter_id"] != "none", m["filter_id"])
    each = F.transform(tools, lambda m: F.struct(m["pos"].alias("pos"), named(m).alias("filter_id"), m["command_type"].alias("command_type"), m["original"].alias("original"), m["compressed"].alias("compressed")))
    done = done.withColumns({"original": total("original"), "compressed": total("compressed"), "modified": F.exists("messages", lambda m: m["modified"]), "per_command": F.when(F.size("messages") > 0, each)})
    done = done.withColumn("filters", F.array_distinct(F.filter(F.transform("per_command", lambda m: m["filter_id"]), lambda x: x.isNotNull())))
    done = stats.headers(done.withColumn("saves", F.coalesce(F.col("modified") & (F.col("compressed") < F.col("original")), F.lit(False))))
    changed = F.filter("messages", lambda m: m["modified"])
    texts = F.coalesce(F.transform(changed, lambda m: F.struct(m["path"].alias("path"), m["before"].alias("before"), m["after"].alias("after"))), F.array().cast("array<struct<path:string,before:string,after:string>>"))
    return done.withColumn("_texts", texts).withColumn("new_body", encode("body", "dialect", "_texts", "saves")).drop("_texts", "messages")


def with_sessions(requests: DataFrame, sessions: DataFrame, body: str = "body", name: str = "known") -> DataFrame:
    """requests with a column `known`: the stored command of each session that the body names (null: none is stored).

    sessions: rows of `sources.state`.  Equal bodies name equal sessions, so
    they are looked up once, by a digest of the body; only session ids and
    commands are shuffled.
    """
    ids = F.array_distinct(F.regexp_extract_all(F.col(body), F.lit(r'session(?:_id\\*"\s*:| ID)\s*(-?\d{1,18})'), 1))
    asked = requests.select(F.sha2(F.col(body), 256).alias("_digest"), F.explode(ids).alias("_s")).distinct().select("_digest", F.col("_s").cast("long").alias("session_id"))
    found = asked.join(state.latest(sessions), "session_id").groupBy("_digest").agg(F.sort_array(F.collect_set(F.struct("session_id", "command"))).alias(name))
    out = requests.join(found, F.sha2(requests[body], 256) == found["_digest"], "left")
    return out.select(*[requests[c] for c in requests.columns if c != name], name)


def session_updates(done: DataFrame, now: int) -> DataFrame:
    """What processed requests add to the session state: (session_id, command, updated_at), the last command of each request's sessions; `now` for all."""
    last = F.aggregate("remembered", F.create_map().cast("map<bigint,string>"), lambda a, r: F.map_concat(F.map_filter(a, lambda k, _: k != r["session_id"]), F.create_map(r["session_id"], r["command"])))
    return done.select(F.explode(last).alias("session_id", "command")).withColumn("updated_at", F.lit(now).cast("long"))
