"""The same message relation by VARIANT functions and joins, without Python.

For analyses that don't send a request on: three dialects become
(request_id, at, role, kind, text, hint), with calls joined to outputs as
relations.  `sources.requests` reads all four, keeps paths and key order,
and is what the rewriting plans use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laconic.operators import hints

LIST = "array<variant>"


def _get(v, path: str) -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, "variant")


def _text(v, path: str) -> Column:
    """A string at the path; null for anything else."""
    x = _get(v, path)
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def _list(v, path: str) -> Column:
    return F.try_variant_get(_get(v, path), "$", LIST)


def _is_list(v, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_get(v, path)).startswith("ARRAY"), F.lit(False))


def _arguments(v: Column) -> Column:
    """Arguments as JSON text, whether they came as text or as an object."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def with_dialect(requests: DataFrame, body: str = "body") -> DataFrame:
    """(request_id, v, dialect) of bodies that are requests."""
    d = requests.select("request_id", F.try_parse_json(body).alias("v"))
    blocks = F.exists(_list("v", "$.messages"), lambda m: F.coalesce(F.schema_of_variant(_get(m, "$.content")).startswith("ARRAY"), F.lit(False)))
    kind = F.when(_is_list("v", "$.contents"), "parts").when(_is_list("v", "$.input"), "items").when(_is_list("v", "$.messages"), F.when(blocks, "blocks").otherwise("chat"))
    return d.withColumn("dialect", kind).where("dialect is not null")


def _kind(role: Column, tool: Column) -> Column:
    return F.when(tool, "tool").when(role == "user", "user").otherwise("other")


def chat(requests: DataFrame) -> DataFrame:
    m = requests.where("dialect = 'chat'").select("request_id", F.posexplode(_list("v", "$.messages")).alias("i", "m"))
    call = m.select("request_id", "i", F.posexplode(_list("m", "$.tool_calls")).alias("j", "c")).select("request_id", F.struct("i", "j").alias("pos"), _text("c", "$.id").alias("call_id"), hints.hint(F.coalesce(_text("c", "$.function.name"), F.lit("")), _arguments(_get("c", "$.function.arguments"))).alias("hint"))
    role = F.coalesce(_text("m", "$.role"), F.lit(""))
    rows = m.select("request_id", F.array("i").alias("at"), role.alias("role"), _kind(role, role == "tool").alias("kind"), _text("m", "$.content").alias("text"), F.when(role == "tool", _text("m", "$.tool_call_id")).alias("call_id")).where("text <> ''")
    return hints.last_call(call.where("call_id <> ''"), rows, ["request_id", "call_id"]).drop("call_id")


def blocks(requests: DataFrame) -> DataFrame:
    m = requests.where("dialect = 'blocks'").select("request_id", F.posexplode(_list("v", "$.messages")).alias("i", "m")).withColumn("role", F.coalesce(_text("m", "$.role"), F.lit("")))
    b = m.select("request_id", "role", "i", F.posexplode(_list("m", "$.content")).alias("j", "b")).withColumn("type", _text("b", "$.type"))
    call = b.where("type = 'tool_use'").select("request_id", F.struct("i", "j").alias("pos"), _text("b", "$.id").alias("call_id"), hints.hint(F.coalesce(_text("b", "$.name"), F.lit("")), F.to_json(_get("b", "$.input"))).alias("hint"))
    none = F.lit(None).cast("string").alias("call_id")
    plain = m.select("request_id", F.array("i").alias("at"), "role", _kind(F.col("role"), F.lit(False)).alias("kind"), _text("m", "$.content").alias("text"), none).where("text <> ''")
    said = b.where("type = 'text'").select("request_id", F.array("i", "j").alias("at"), "role", _kind(F.col("role"), F.lit(False)).alias("kind"), _text("b", "$.text").alias("text"), none).where("text is not null")
    result = b.where("type = 'tool_result'").withColumn("call_id", _text("b", "$.tool_use_id"))
    whole = result.select("request_id", F.array("i", "j").alias("at"), "role", F.lit("tool").alias("kind"), _text("b", "$.content").alias("text"), "call_id").where("text <> ''")
    inner = result.select("request_id", "role", "call_id", "i", "j", F.posexplode(_list("b", "$.content")).alias("k", "x")).select("request_id", F.array("i", "j", "k").alias("at"), "role", F.lit("tool").alias("kind"), _text("x", "$.text").alias("text"), "call_id").where("text <> ''")
    rows = plain.union(said).union(whole).union(inner)
    return hints.last_call(call.where("call_id <> ''"), rows, ["request_id", "call_id"]).drop("call_id")


def parts(requests: DataFrame) -> DataFrame:
    c = requests.where("dialect = 'parts'").select("request_id", F.posexplode(_list("v", "$.contents")).alias("i", "c")).withColumn("role", F.coalesce(_text("c", "$.role"), F.lit("")))
    p = c.select("request_id", "role", "i", F.posexplode(_list("c", "$.parts")).alias("j", "p"))
    name = _text("p", "$.functionCall.name")
    call = p.select("request_id", name.alias("call_id"), hints.hint(name, F.to_json(_get("p", "$.functionCall.args"))).alias("hint")).where("call_id <> ''")
    answers = _get("p", "$.functionResponse").isNotNull()
    tool = answers | (F.col("role") == "function")
    rows = p.select("request_id", F.array("i", "j").alias("at"), "role", _kind(F.col("role"), tool).alias("kind"), _text("p", "$.text").alias("text"), F.when(tool, _text("p", "$.functionResponse.name")).alias("call_id")).where("text <> ''")
    return hints.only_call(call, rows, ["request_id", "call_id"]).drop("call_id")


def messages(requests: DataFrame, body: str = "body") -> DataFrame:
    """All three; `at` is the place of a text in its request."""
    d = with_dialect(requests, body)
    return chat(d).unionByName(blocks(d)).unionByName(parts(d))
