"""Commands that tool calls stand for.

`hint` maps a tool's name and JSON arguments to a command line that
detection understands; `last_call`, `only_call` and `call_before` join
calls to outputs as the request dialects need it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laconic.functions.text import col, trim

# Names under which tools are known, and their argument keys in order of preference.
SHELL = ["bash", "sh", "shell", "zsh", "exec", "exec_command", "execcommand", "shell_command", "shellcommand", "execute_command", "executecommand", "run_command", "runcommand", "run_terminal_cmd", "runterminalcmd", "terminal", "terminal_command"]
READ = ["read", "read_file", "readfile", "cat", "view", "view_file", "viewfile", "open_file", "openfile", "get_file", "getfile"]
SEARCH = ["grep", "rg", "ripgrep", "ag", "search", "grep_search", "grepsearch", "search_files", "searchfiles", "find_text", "findtext"]
LIST = ["glob", "list_files", "listfiles", "list_dir", "listdir", "find_files", "findfiles"]
SHELL_KEYS, READ_KEYS = ["command", "cmd", "script"], ["file_path", "filePath", "path", "filename", "file"]
SEARCH_KEYS, PLACE_KEYS, GLOB_KEYS, LIST_KEYS = ["pattern", "query", "regex", "search"], ["path", "dir", "directory"], ["include", "glob", "type"], ["path", "dir", "directory", "cwd"]
SESSION = r"(?m)Process (?:running with )?session ID (\d+)"


def tool_name(name) -> Column:
    """Lower case, without namespaces (`a__b`, `a.b`)."""
    return trim(F.substring_index(F.substring_index(F.lower(col(name)), "__", -1), ".", -1))


def _first(args: Column, keys: list[str]) -> Column:
    """The first key that holds a string which is not blank."""

    def one(key: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(args, f"$.{key}", "variant"))
        value = F.try_variant_get(args, f"$.{key}", "string")
        return F.when((kind == "STRING") & (trim(value) != ""), value)

    return F.coalesce(*[one(k) for k in keys])


def _quoted(x: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def hint(name, arguments) -> Column:
    """A command line for a tool call, or null; arguments: JSON text of an object."""
    n, args = tool_name(name), F.try_parse_json(col(arguments))
    place, glob = _first(args, PLACE_KEYS), _first(args, GLOB_KEYS)
    search = F.concat(F.lit("rg "), _quoted(_first(args, SEARCH_KEYS)), F.coalesce(F.concat(F.lit(" "), place), F.lit("")), F.coalesce(F.concat(F.lit(" --glob "), _quoted(glob)), F.lit("")))
    listing = F.concat(F.lit("find "), F.coalesce(_first(args, LIST_KEYS), F.lit(".")))
    is_object = F.schema_of_variant(args).startswith("OBJECT")
    found = F.coalesce(F.when(n.isin(SHELL), _first(args, SHELL_KEYS)), F.when(n.isin(READ), F.concat(F.lit("cat "), _first(args, READ_KEYS))), F.when(n.isin(SEARCH), search), F.when(n.isin(LIST), listing))
    return F.when(is_object, found)


def session_in(output) -> Column:
    """The session id that an output announces."""
    return F.regexp_extract(col(output), SESSION, 1).try_cast("long")


def last_call(calls: DataFrame, outputs: DataFrame, keys: list[str], pos: str = "pos", value: str = "hint") -> DataFrame:
    """outputs with `value` of the last call with their keys, wherever it stands; calls without a value don't count."""
    last = calls.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, pos).alias(value))
    return outputs.join(last, keys, "left")


def only_call(calls: DataFrame, outputs: DataFrame, keys: list[str], value: str = "hint") -> DataFrame:
    """outputs with `value` of the call with their keys, if there is exactly one such call."""
    only = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(value)).where("_n = 1").drop("_n")
    return outputs.join(only, keys, "left")


def call_before(items: DataFrame, keys: list[str], pos: str = "pos", value: str = "hint") -> DataFrame:
    """items with `value_before`: the last value of an earlier item with their keys."""
    order = W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    return items.withColumn(f"{value}_before", F.last(value, ignorenulls=True).over(order))


def as_of(events: DataFrame, keys: list[str], ts: str, value: str, ttl_s: int, pos: str | None = None) -> DataFrame:
    """events with `value_as_of`: the last value of an earlier event with their keys that is at most ttl_s old.

    ts: seconds since the epoch.  One sort per key, no join.
    """
    order = W.partitionBy(*keys).orderBy(ts, *([pos] if pos else [])).rowsBetween(W.unboundedPreceding, -1)
    seen = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))), ignorenulls=True).over(order)
    return events.withColumn("_seen", seen).withColumn(f"{value}_as_of", F.when(F.col(ts) - F.col("_seen.t") <= ttl_s, F.col("_seen.v"))).drop("_seen")
