"""Filler-phrase removal as nested replacements in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from laconic.functions.patterns import jvm, lint
from laconic.functions.text import col, lines, trim
from laconic.rules.condense import LEVELS, RULES


def rules(role: str = "user", level: str = "lite", strict: bool = True) -> list[tuple[str, str, str]]:
    """(name, pattern, replacement) that apply; strict: without the rules that the rules' dialect can't run."""
    most = LEVELS.index(level) if level in LEVELS else 0
    return [(name, pattern, to) for name, context, least, pattern, to in RULES if LEVELS.index(least) <= most and context in ("all", role) and not (strict and lint(pattern))]


def condensed(text, role: str = "user", level: str = "lite", strict: bool = True) -> Column:
    """The text without filler phrases, with single blanks and trimmed lines.

    Other levels than full and ultra mean lite.  Patterns are case-sensitive,
    and ^ is the start of the text.
    """
    out = col(text)
    for _, pattern, to in rules(role, level, strict):
        out = F.regexp_replace(out, jvm(pattern), to.replace("\\", "\\\\").replace("$", "\\$"))
    return F.array_join(F.transform(lines(F.regexp_replace(out, " {2,}", " ")), trim), "\n", "")
