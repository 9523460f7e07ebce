"""The whole output pipeline on one text: what an Arrow batch runs for each of its rows.

Detection tries a content pattern only on texts that hold a literal it
needs, so most of the patterns cost one substring search.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from laconic.config import SHORT_BYTES, SHORT_NEWLINES, EngineConfig
from laconic.functions import commands
from laconic.functions.patterns import needed, python
from laconic.operators import outputs
from laconic.rules import detectors
from laconic.rules.filters import Filter, combined

_COMMAND = [[python(p) for p in d[2]] for d in detectors.DETECTORS]
_CONTENT = [[(*needed(p), python(p)) for p in d[3]] for d in detectors.DETECTORS]
_PACKS: dict[tuple, list[Filter]] = {}


@dataclass(frozen=True)
class Output:
    text: str
    command_type: str
    category: str
    confidence: float
    filter_id: str | None
    grouped: bool


@lru_cache(4096)
def _of_command(c: str) -> tuple[bool, ...]:
    """Whether each detector knows the command."""
    return tuple(any(p.search(c) for p in patterns) or (d[0] == "file-read" and commands.reads_with_sed(c)) for patterns, d in zip(_COMMAND, detectors.DETECTORS, strict=True))


def signals(text: str) -> list[int]:
    """Number of each detector's content patterns that match."""
    low = text.lower()
    return [sum((not literals or any(x in (low if folded else text) for x in literals)) and p.search(text) is not None for literals, folded, p in patterns) for patterns in _CONTENT]


_NO_COMMAND = (False,) * len(_COMMAND)


def detect(text: str, command: str | None = None) -> tuple[str, str, float, str | None]:
    """(type, category, confidence, normal command)."""
    c = (commands.normalise(command) if command is not None else None) or commands.command_in(text)
    best, at = -1, -1
    for i, (hit, n) in enumerate(zip(_NO_COMMAND if c is None else _of_command(c), signals(text), strict=True)):
        points = min(100, 55 * hit + 25 * n)
        if (hit or points >= 50) and points > best:
            best, at = points, i
    if at < 0:
        return "unknown", "generic", 0.35 if c is not None else 0.1, c
    return detectors.DETECTORS[at][0], detectors.DETECTORS[at][1], best / 100, c


def choose(filters: list[Filter], text: str, kind: str, command: str | None) -> Filter | None:
    tiers = [lambda f: kind in f.types, lambda f: bool(command) and any(p.search(command) for p in f.patterns("commands", "")), lambda f: kind != "unknown" and any(p.search(text) for p in f.patterns("contents", "im")), lambda f: "generic-output" in f.types]
    return next((f for tier in tiers for f in filters if tier(f)), None)


def compress_output(text: str, command: str | None = None, config: EngineConfig | None = None, filters: list[Filter] | None = None) -> Output:
    """filters: best first; without it, the built-in ones."""
    config = config or EngineConfig()
    kind, category, confidence, c = detect(text, command)
    if kind == "unknown" and outputs.size(text) <= SHORT_BYTES and text.count("\n") < SHORT_NEWLINES:
        return Output(outputs._CSI.sub("", text), kind, category, confidence, None, False)
    f = choose(_PACKS.setdefault((), combined()) if filters is None else filters, text, kind, c)
    out, grouped = outputs.compress(text, kind, f, commands.search_terms(command) if command else [], config.grouping, config.char_budget)
    return Output(out, kind, category, confidence, f.id if f else None, grouped)
