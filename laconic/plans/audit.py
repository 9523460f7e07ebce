"""Batch audits over session logs and command lists.

`paired` joins calls to outputs once; every report is one pre-aggregated
grouping over the compressed pairs (`measured`), so the texts are read and
compressed once and only their measures are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laconic.config import CHAR_BUDGET, SHORT_BYTES, SHORT_NEWLINES, EngineConfig
from laconic.functions import commands
from laconic.functions import text as tx
from laconic.operators import detect
from laconic.plans.compress import compressed
from laconic.sources import sessions

BIG_TOKENS, LITTLE_REDUCTION, NEAR_BUDGET = 1000, 0.90, 11_500
CAPS = (200, 300, 500)


def body(output) -> Column:
    """What follows the header of an output."""
    o = tx.col(output)
    after = lambda mark: F.substring(o, F.instr(o, mark) + len(mark), F.length(o))
    return F.when(F.instr(o, "\nOutput:\n") > 0, after("\nOutput:\n")).when(F.instr(o, "Output:\n") > 0, after("Output:\n")).otherwise(o)


def header_tokens(output) -> Column:
    return F.regexp_extract(tx.col(output), r"Original token count:\s*(\d+)", 1).try_cast("long")


def calls(items: DataFrame) -> DataFrame:
    """Shell calls of a log: (call_id, command), null where the call has none."""
    c = items.where((F.col("type") == "function_call") & F.col("name").isin("exec_command", "shell_command"))
    return c.select("file", "place", "call_id", sessions.command_of("arguments").alias("command"))


def paired(items: DataFrame) -> DataFrame:
    """(call_id, command, output, header_tokens): calls and outputs of one id; the last of each counts."""
    order = F.struct("file", "place")
    c = calls(items).where("call_id is not null and command is not null").groupBy("call_id").agg(F.max_by("command", order).alias("command"))
    o = items.where((F.col("type") == "function_call_output") & F.col("call_id").isNotNull()).withColumn("raw", F.coalesce(sessions.as_text(F.col("output")), F.lit("")))
    o = o.groupBy("call_id").agg(F.max_by("raw", order).alias("raw"))
    return c.join(o, "call_id").select("call_id", "command", body("raw").alias("output"), header_tokens("raw").alias("header_tokens"))


def pairing_counts(items: DataFrame) -> DataFrame:
    """exec_calls, paired, orphan_outputs."""
    c = calls(items).select("call_id", F.lit(1).alias("call"), F.col("command").isNotNull().alias("asks"), F.lit(False).alias("answers"))
    o = items.where((F.col("type") == "function_call_output") & F.col("call_id").isNotNull()).select("call_id", F.lit(0).alias("call"), F.lit(False).alias("asks"), F.lit(True).alias("answers"))
    ids = c.unionByName(o).groupBy("call_id").agg(F.sum("call").alias("calls"), (F.bool_or("asks") & F.col("call_id").isNotNull()).alias("asks"), F.bool_or("answers").alias("answers"))
    return ids.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("exec_calls"), _n(F.col("asks") & F.col("answers")).alias("paired"), _n(~F.col("asks") & F.col("answers")).alias("orphan_outputs"))


def read_target(command) -> Column:
    """What a read command reads, without line ranges."""
    first = tx.trim(F.substring_index(tx.col(command), "\n", 1))
    segment = tx.trim(F.substring_index(F.substring_index(first, "&&", -1), "|", -1))
    words = F.filter(F.split(segment, r"(?U)\s+", -1), lambda w: (w != "") & ~w.startswith("-") & ~w.rlike(r"""^[0-9,p'"]+\z""") & ~w.isin("cat", "bat", "sed", "nl", "head", "tail") & (w.contains("/") | w.contains(".")))
    return F.when(F.size(words) > 0, F.element_at(words, -1)).otherwise(F.substring(segment, 1, 60))


def line_measures(text) -> Column:
    """Struct (n, blank, twice): lines, blank ones, and those equal to the line before that aren't blank."""
    blank = lambda x: tx.trim(x) == ""
    twice = lambda L: F.filter(L, lambda x, i: (i > 0) & ~blank(x) & (x == tx.before(L, i)))
    return tx.let(tx.lines_lf(text), lambda L: F.struct(F.size(L).alias("n"), F.size(F.filter(L, blank)).alias("blank"), F.size(twice(L)).alias("twice")))


def measured(pairs: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """One row of measures for each pair (command, output)."""
    d = compressed(pairs, "output", "command", config)
    d = d.withColumn("n_keywords", F.size(commands.keywords(F.col("command"))))
    noted = F.contains("compressed", F.lit("[rtk:truncated"))
    size, small, safe = F.octet_length("output"), F.octet_length("compressed"), F.least(F.octet_length(tx.safe_clean("output")), F.octet_length("output"))
    d = d.withColumn("_lines", line_measures("compressed"))
    return d.select(
        "command", "command_type", "filter_id", "grouped", "n_keywords", "header_tokens" if "header_tokens" in pairs.columns else F.lit(None).cast("long").alias("header_tokens"),
        noted.alias("truncated"), size.alias("orig_bytes"), small.alias("out_bytes"), safe.alias("safe_bytes"), F.col("original_tokens").alias("orig_tokens"), F.col("compressed_tokens").alias("out_tokens"),
        F.col("_lines.n").alias("out_lines"), F.col("_lines.blank").alias("out_blank_lines"), F.col("_lines.twice").alias("out_twice_lines"),
        ((F.col("command_type") == "unknown") & F.col("filter_id").isNull() & ~F.col("grouped") & (size <= SHORT_BYTES) & (tx.newlines("output") < SHORT_NEWLINES)).alias("passthrough"),
    )


def _n(condition) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def _pct(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part / F.greatest(whole, F.lit(1)), 2)


def scalars(m: DataFrame) -> DataFrame:
    """One row of totals."""
    s = m.agg(
        F.count(F.lit(1)).alias("records"), _n(F.col("passthrough")).alias("passthrough"), _n(F.col("truncated")).alias("truncated"), _n(F.col("n_keywords") > 0).alias("with_keywords"), _n((F.col("n_keywords") > 0) & F.col("truncated")).alias("with_keywords_truncated"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("orig_bytes", "out_bytes", "orig_tokens", "out_tokens")],
        F.coalesce(F.sum("header_tokens"), F.lit(0)).alias("header_tokens"), F.count("header_tokens").alias("with_header"), _n(F.col("out_bytes") < F.col("orig_bytes")).alias("smaller"), _n(F.col("out_bytes") >= F.col("orig_bytes")).alias("unchanged"),
    )
    return s.withColumns({"bytes_cut_pct": _pct(F.col("orig_bytes") - F.col("out_bytes"), F.col("orig_bytes")), "tokens_cut_pct": _pct(F.col("orig_tokens") - F.col("out_tokens"), F.col("orig_tokens")), "passthrough_pct": _pct(F.col("passthrough"), F.col("records")), "truncated_pct": _pct(F.col("truncated"), F.col("records"))})


def by_type(m: DataFrame) -> DataFrame:
    g = m.groupBy("command_type").agg(F.count(F.lit(1)).alias("records"), F.sum("orig_tokens").alias("orig_tokens"), F.sum("out_tokens").alias("out_tokens"))
    return g.withColumn("tokens_cut_pct", _pct(F.col("orig_tokens") - F.col("out_tokens"), F.col("orig_tokens")))


def by_filter(m: DataFrame) -> DataFrame:
    return m.groupBy(F.coalesce("filter_id", F.lit("passthrough/none")).alias("filter_id")).agg(F.count(F.lit(1)).alias("records"))


def against_floor(m: DataFrame) -> DataFrame:
    """For each type: bytes against the lossless floor; what lies above it is unused, below it lossy (by the budget or by rules)."""
    over, cut = F.col("out_bytes") - F.col("safe_bytes"), F.col("safe_bytes") - F.col("out_bytes")
    big, total = F.col("orig_bytes") > CHAR_BUDGET, lambda c, when: F.sum(F.when(when, c).otherwise(0))
    return m.groupBy("command_type").agg(
        F.count(F.lit(1)).alias("records"), F.sum("orig_bytes").alias("orig_bytes"), F.sum("out_bytes").alias("out_bytes"), F.sum("safe_bytes").alias("safe_bytes"),
        total(over, over > 0).alias("unused"), _n(over > 0).alias("n_unused"), total(cut, cut > 0).alias("lossy"), _n(cut > 0).alias("n_lossy"), total(cut, (cut > 0) & big).alias("lossy_budget"), total(cut, (cut > 0) & ~big).alias("lossy_rules"), _n((cut > 0) & ~big).alias("n_lossy_rules"),
    )


def unknown_losses(m: DataFrame) -> DataFrame:
    """Why outputs of unknown commands lost lines within the budget."""
    lost = m.where((F.col("command_type") == "unknown") & (F.col("safe_bytes") > F.col("out_bytes")) & (F.col("orig_bytes") <= CHAR_BUDGET))
    return lost.groupBy(F.when(F.col("grouped"), "grouped").when(F.col("truncated"), "truncated").otherwise("other").alias("cause")).agg(F.count(F.lit(1)).alias("records"))


def line_bucket(lines: Column) -> Column:
    """Labels that sort as their numbers do."""
    out = F.lit("1001-")
    for low, high in ((501, 1000), (301, 500), (151, 300), (51, 150), (0, 50)):
        out = F.when(lines <= high, F.lit(f"{low:04d}-{high:04d}")).otherwise(out)
    return out


def reads(m: DataFrame) -> DataFrame:
    """Read outputs by their lines."""
    return m.where("command_type = 'file-read'").groupBy(line_bucket(F.col("out_lines")).alias("bucket")).agg(F.count(F.lit(1)).alias("records"), F.sum("out_tokens").alias("tokens"), _n(F.col("out_bytes") > CHAR_BUDGET).alias("over_budget"))


def read_caps(m: DataFrame) -> DataFrame:
    """What caps on the lines of reads would have saved."""
    r = m.where("command_type = 'file-read'").select("out_lines", "out_bytes", F.explode(F.array(*[F.lit(c) for c in CAPS])).alias("cap"))
    saved = F.floor((F.col("out_lines") - F.col("cap")) * (F.col("out_bytes") / F.greatest("out_lines", F.lit(1))) / 4)
    return r.groupBy("cap").agg(_n(F.col("out_lines") > F.col("cap")).alias("exceeding"), F.sum(F.when(F.col("out_lines") > F.col("cap"), saved).otherwise(0)).alias("saved_tokens"))


def repeated_reads(m: DataFrame, k: int = 20) -> DataFrame:
    g = m.where("command_type = 'file-read'").groupBy(read_target("command").alias("target")).agg(F.count(F.lit(1)).alias("reads"), F.sum("out_tokens").alias("tokens"))
    return g.where("reads > 1").orderBy(F.desc("reads"), "target").limit(k)


def grouped_unknowns(m: DataFrame) -> DataFrame:
    head = F.coalesce(F.element_at(F.filter(F.split(F.substring_index("command", "\n", 1), r"(?U)\s+", -1), lambda w: w != ""), 1), F.lit(""))
    g = m.where("command_type = 'unknown' and grouped")
    return g.groupBy(F.when(F.lit(True), head).alias("head")).agg(F.count(F.lit(1)).alias("records"), F.sum(F.greatest(F.col("orig_tokens") - F.col("out_tokens"), F.lit(0))).alias("tokens_cut"))


def _under() -> Column:
    return (F.col("out_tokens") >= BIG_TOKENS) & (F.col("out_bytes") / F.greatest("orig_bytes", F.lit(1)) >= LITTLE_REDUCTION)


def under_compressed(m: DataFrame) -> DataFrame:
    """Big outputs that hardly shrank, by type: at the budget, or below it with what could still go."""
    below = F.col("out_bytes") < NEAR_BUDGET
    return m.where(_under()).groupBy("command_type").agg(
        F.count(F.lit(1)).alias("records"), F.sum("out_tokens").alias("tokens"), _n(~below).alias("at_budget"), _n(below).alias("below_budget"), F.sum(F.when(below, F.col("out_tokens")).otherwise(0)).alias("below_tokens"),
        F.sum(F.when(below, F.col("out_blank_lines")).otherwise(0)).alias("blank_lines"), F.sum(F.when(below, F.col("out_twice_lines")).otherwise(0)).alias("twice_lines"),
    )


def offenders(m: DataFrame, k: int = 25) -> DataFrame:
    """The k largest of these outputs; of outputs equal in size, type and command those that shrank least, so that the order of the rows doesn't matter."""
    return m.where(_under()).select("out_tokens", "command_type", F.substring(F.substring_index("command", "\n", 1), 1, 70).alias("command"), "orig_tokens").orderBy(F.desc("out_tokens"), "command_type", "command", "orig_tokens").limit(k)


# Heads of commands that no detector knows, by kind.
KINDS = [
    ("shell-control", ["cd", "rm", "mkdir", "export", "set", "kill", "pkill", "echo", "printf", "sleep", "pwd", "source", "test", "which", "date", "wc", "if", "for"]),
    ("git-partial", ["git"]),
    ("node-npm", ["node", "npm", "npx", "pnpm", "yarn"]),
    ("build-partial", ["cargo", "swift", "go"]),
    ("tooling", ["brew", "uv", "codex"]),
    ("privileged", ["sudo"]),
]
MODULES = [("py_compile", "-m py_compile"), ("json.tool", "-m json.tool"), ("http.server", "-m http.server"), ("venv", "-m venv"), ("pip", "-m (should-be-other!)"), ("pytest", "-m (should-be-other!)"), ("mypy", "-m (should-be-other!)")]


def head_of(norm) -> Column:
    return F.coalesce(F.element_at(F.filter(F.split(tx.col(norm), r"(?U)\s+", -1), lambda w: w != ""), 1), F.lit("<empty>"))


def unknown_kind(norm, head) -> Column:
    n, h = F.lower(tx.col(norm)), tx.col(head)
    out = F.when(n.startswith("python") | h.isin("python", "python3") | h.endswith("/python"), "python-gap")
    for kind, heads in KINDS:
        out = out.when(h.isin(heads), kind)
    return out.when(h.contains("/") | h.endswith(".sh") | h.endswith(".py"), "custom-binary").otherwise("other")


def python_form(norm) -> Column:
    rest = F.regexp_replace(F.regexp_replace(tx.col(norm), r"^python3?", ""), r"(?U)^\s+", "")
    word = lambda s: F.coalesce(F.element_at(F.filter(F.split(s, r"(?U)\s+", -1), lambda w: w != ""), 1), F.lit(""))
    module = word(F.substring(rest, 4, 1 << 30))
    named = F.lit("-m other module")
    for name, label in MODULES:
        named = F.when(module == name, label).otherwise(named)
    return F.when(rest.startswith("- ") | (rest == "-") | rest.startswith("-<"), "stdin/heredoc (python -)").when(rest.startswith("-c"), "-c inline").when(rest.startswith("-m "), named).when(rest.startswith("--version") | rest.startswith("-V"), "--version").when(rest == "", "bare python").when(word(rest).endswith(".py"), ".py file (should-match!)").otherwise("other")


def classified(cmds: DataFrame, command: str = "command") -> DataFrame:
    """Commands with command_type, is_short, and for unknown ones head, kind and python_form."""
    d = detect.detected(cmds.withColumn("_empty", F.lit("")), "_empty", command)
    unknown = F.col("command_type") == "unknown"
    d = d.withColumn("_norm", F.coalesce("norm_command", F.lit(""))).withColumn("head", F.when(unknown, head_of("_norm")))
    d = d.withColumn("kind", F.when(unknown, unknown_kind("_norm", "head"))).withColumn("python_form", F.when(F.col("kind") == "python-gap", python_form("_norm")))
    return d.withColumn("is_short", (F.octet_length(command) <= SHORT_BYTES) & (tx.newlines(command) < SHORT_NEWLINES)).drop("_empty", "_norm", "norm_command", "category", "confidence")


def command_totals(c: DataFrame) -> DataFrame:
    unknown = F.col("command_type") == "unknown"
    t = c.agg(F.count(F.lit(1)).alias("commands"), _n(unknown).alias("unknown"), _n(unknown & F.col("is_short")).alias("unknown_short"), _n(unknown & ~F.col("is_short")).alias("unknown_long"))
    return t.withColumn("unknown_pct", _pct(F.col("unknown"), F.col("commands")))


def command_types(c: DataFrame) -> DataFrame:
    return c.groupBy("command_type").agg(F.count(F.lit(1)).alias("commands"))


def unknown_kinds(c: DataFrame) -> DataFrame:
    return c.where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("commands"), _n(F.col("is_short")).alias("short"), _n(~F.col("is_short")).alias("long"))


def unknown_heads(c: DataFrame, k: int = 50) -> DataFrame:
    return c.where("head is not null").groupBy("head").agg(F.count(F.lit(1)).alias("commands")).orderBy(F.desc("commands"), "head").limit(k)


def python_forms(c: DataFrame) -> DataFrame:
    return c.where("python_form is not null").groupBy("python_form").agg(F.count(F.lit(1)).alias("commands"))
