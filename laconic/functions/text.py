"""Text functions as Column expressions; all of them stay in the JVM.

Lines are split in three ways, each as its stage needs it: `lines_crlf`
(line filter), `lines_lf` (folding, truncation) and `lines` (grouping,
condensing: no line for a last newline, none for an empty text).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from laconic.functions.patterns import jvm

# Escape sequences, stream prefixes, what marks an error line, and the formats of notes that replace lines.
CSI = r"\x1b\[[0-?]*[ -/]*[@-~]"
CSI_AUDIT = r"\x1b\[[0-9;?]*[ -/]*[@-~]"
STDERR = r"(?i)^\s*(?:stderr|err)\s*(?:\||:)\s*"
ERROR_LINE = r"(?i)error|warning|\bfail(?:ed|ure)?\b|panic|exception|traceback|fatal|\bdenied\b|not found"
NOTE_LINES, NOTE_CHARS = "[rtk:truncated {} lines]", "\n[rtk:truncated by chars]\n"
NOTE_RUN = "[rtk:dropped {} repeated lines]"
NOTE_BLOCK = '[rtk: omitted {}-line block repeating earlier content starting with "{}"]'


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f(value), with the value computed once: an expression inside a lambda is evaluated for each element."""
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)


def tokens(text) -> Column:
    """Estimated tokens: a quarter of the characters, rounded up."""
    return F.floor((F.length(col(text)) + 3) / 4).cast("long")


def strip_ansi(text, pattern: str = CSI) -> Column:
    return F.regexp_replace(col(text), pattern, "")


def trim(text) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+\z", "")


def lines_crlf(text) -> Column:
    return F.split(col(text), "\r?\n", -1)


def lines_lf(text) -> Column:
    return F.split(col(text), "\n", -1)


def lines(text) -> Column:
    t = col(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, r"\r?\n\z", ""), "\r?\n", -1))


def joined(array) -> Column:
    return F.array_join(col(array), "\n", "")


def newlines(text) -> Column:
    t = col(text)
    return F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))


def is_short_output(text, command_type) -> Column:
    from laconic.config import SHORT_BYTES, SHORT_NEWLINES

    return (col(command_type) == "unknown") & (F.octet_length(col(text)) <= SHORT_BYTES) & (newlines(text) < SHORT_NEWLINES)


def strip_stderr(line) -> Column:
    return F.regexp_replace(col(line), jvm(STDERR), "")


def is_error_line(line) -> Column:
    return col(line).rlike(jvm(ERROR_LINE))


def has_keyword(line, keywords) -> Column:
    """Any keyword of two bytes or more occurs in the line, whatever its case."""
    return F.exists(col(keywords), lambda k: (F.octet_length(k) >= 2) & F.contains(F.lower(col(line)), F.lower(k)))


def cut_line(line, limit: int) -> Column:
    """At most `limit` characters; longer lines end in dots (0: no limit)."""
    x = col(line)
    if limit <= 0:
        return x
    short = F.substring(x, 1, limit) if limit <= 3 else F.concat(F.substring(x, 1, limit - 3), F.lit("..."))
    return F.when(F.length(x) <= limit, x).otherwise(short)


def cut_chars(text, most: int) -> Column:
    """The first 55 % and the last 45 % of `most`, with a note between; texts of at most `most` bytes stay."""
    t, note = col(text), NOTE_CHARS
    budget = max(0, most - len(note))
    if budget == 0:
        return F.when(F.octet_length(t) > most, F.lit(note[:most])).otherwise(t)
    head = -(-budget * 55 // 100)
    tail = budget - head
    last = F.when(F.length(t) > tail, F.substring(t, -tail, tail)).otherwise(F.lit("")) if tail else F.lit("")
    return F.when(F.octet_length(t) <= most, t).otherwise(F.substring(F.concat(F.substring(t, 1, head), F.lit(note), last), 1, most))


def directory(path) -> Column:
    """What comes before the last slash, or a dot."""
    p = col(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"(?s)/[^/]*\z", "")).otherwise(F.lit("."))


def fold_runs(text, least: int = 3) -> Column:
    """Runs of `least` or more equal lines become the line and a note; runs of blank lines stay."""
    least = max(2, least)

    def folded(s: Column) -> Column:
        L, first = s["L"], s["first"]

        def run(i: Column, j: Column) -> Column:
            line, n = F.get(L, i), F.coalesce(F.get(first, j + 1), F.size(L)) - i
            note = F.concat(F.lit("[rtk:dropped "), (n - 1).cast("string"), F.lit(" repeated lines]"))
            return F.when((n >= least) & (trim(line) != ""), F.array(line, note)).otherwise(F.array_repeat(line, n))

        return joined(F.flatten(F.transform(first, run)))

    first = lambda L: F.filter(F.sequence(F.lit(0), F.size(L) - 1), lambda i: (i == 0) | (F.get(L, i) != before(L, i)))
    runs = let(lines_lf(text), lambda L: F.struct(L.alias("L"), first(L).alias("first")))
    return F.when(col(text).isNotNull(), let(runs, folded))


def rendered(array, keep) -> Column:
    """Lines joined, with a note for each gap between kept ones (none before the first or after the last).

    keep: sorted line numbers (from 0).
    """

    def render(L: Column, k: Column) -> Column:
        note = lambda gap: F.concat(F.lit("[rtk:truncated "), gap.cast("string"), F.lit(" lines]"))

        def one(i: Column, j: Column) -> Column:
            line, before = F.element_at(L, i.cast("int") + 1), F.get(k, j - 1)  # null for the first
            return F.when(i > before + 1, F.array(note(i - before - 1), line)).otherwise(F.array(line))

        return F.array_join(F.flatten(F.transform(k, one)), "\n", "")

    return F.when(col(array).isNotNull(), let(F.struct(col(array).alias("L"), col(keep).alias("k")), lambda s: render(s["L"], s["k"])))


def smart_truncate(text, max_lines: int, head: int, tail: int, priority: str | None = None, keywords=None, max_bytes: int = 0) -> Column:
    """Head, tail, priority and keyword lines of texts over a limit; what is kept may exceed max_lines."""
    t = col(text)

    def cut(L: Column) -> Column:
        n = F.size(L)

        def kept(x: Column, i: Column) -> Column:
            keep = (i < head) | (i >= n - tail)
            if priority:
                keep = keep | x.rlike(priority)
            if keywords is not None:
                keep = keep | has_keyword(x, keywords)
            return F.when(keep, i)

        out = rendered(L, F.filter(F.transform(L, kept), lambda i: i.isNotNull()))
        return cut_chars(out, max_bytes) if max_bytes > 0 else out

    over = F.lit(False)
    if max_lines > 0:
        over = over | (newlines(t) >= max_lines)
    if max_bytes > 0:
        over = over | (F.octet_length(t) > max_bytes)
    return F.when(over, let(lines_lf(text), cut)).otherwise(t)


def balanced_lines(n, max_lines: int, head: int, middle: int, tail: int) -> Column:
    """Line numbers that a balanced cut keeps of n lines: head, middle and tail; beyond max_lines, the first ones from the middle on go."""
    n = col(n)
    start = F.floor(F.greatest(n - middle, F.lit(0)) / 2)
    span = lambda a, size: F.when((F.lit(size) > 0) & (a < n), F.sequence(a.cast("int"), (F.least(a + size, n) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    every = F.array_sort(F.array_union(F.array_union(span(F.lit(0), head), span(start, middle)), span(F.greatest(n - tail, F.lit(0)), tail)))
    extra = F.greatest(F.size(every) - max_lines, F.lit(0))
    before, after = F.filter(every, lambda i: i < start), F.filter(every, lambda i: i >= start)
    cut = F.when(extra <= F.size(after), F.concat(before, F.slice(after, extra + 1, F.greatest(F.size(after) - extra, F.lit(0))))).otherwise(F.slice(before, F.lit(1), F.greatest(F.size(before) - (extra - F.size(after)), F.lit(0))))
    return F.when((F.lit(max_lines) == 0) | (n <= max_lines), F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))).otherwise(cut)


def balanced_truncate(text, max_lines: int, head: int, middle: int, tail: int) -> Column:
    t = col(text)
    cut = let(lines_lf(text), lambda L: rendered(L, balanced_lines(F.size(L), max_lines, head, middle, tail)))
    return F.when((F.lit(max_lines) == 0) | (newlines(t) < max_lines), t).otherwise(cut)


def first_of_each(array, pattern: str) -> Column:
    """Of the lines that match, the first for each trimmed text; other lines all stay."""

    def kept(s: Column) -> Column:
        fresh = F.filter(s, lambda x, j: x["key"].isNull() | (j == 0) | ~x["key"].eqNullSafe(before(s, j)["key"]))
        return F.transform(F.sort_array(F.transform(fresh, lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line")))), lambda x: x["line"])

    present = F.filter(col(array), lambda x: x.isNotNull())
    keyed = F.transform(present, lambda x, i: F.struct(F.when(x.rlike(pattern), trim(x)).alias("key"), i.alias("i"), x.alias("line")))
    return let(F.sort_array(keyed), kept)


def before(L: Column, i: Column) -> Column:
    """The element before number i of an array that a lambda binds; null for the first."""
    return F.get(L, i - 1)


def safe_clean(text) -> Column:
    """The lossless floor: no escape codes, no blank lines, no line twice in a row."""
    kept = F.filter(lines(strip_ansi(text, CSI_AUDIT)), lambda x: trim(x) != "")
    return let(kept, lambda L: F.array_join(F.filter(L, lambda x, i: (i == 0) | (x != before(L, i))), "\n", ""))
