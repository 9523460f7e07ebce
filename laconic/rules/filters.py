"""Filter packs: JSON rule files, read and checked on the driver.

A pack is a list of filters in the full form (`match`, `rules`, `preserve`)
or the short one (`commandTypes`, `stripPatterns`, ...).  One entry without
`id` or `category` makes its whole file count as empty; a pattern that does
not compile is left out.  The built-in pack is our own.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import lru_cache
from importlib import resources

from laconic.functions.patterns import lint, python

BUILTIN, CUSTOM = 50, 100


@dataclass(frozen=True)
class Filter:
    id: str
    category: str = ""
    name: str = ""
    description: str = ""
    types: tuple[str, ...] = ()
    commands: tuple[str, ...] = ()
    contents: tuple[str, ...] = ()
    priority: int = 50
    source_priority: int = BUILTIN
    strip_ansi: bool = False
    strip_stderr: bool = False
    replace: tuple[tuple[str, str], ...] = ()
    answers: tuple[tuple[str, str, str | None], ...] = ()  # (pattern, message, unless)
    drop: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    collapse: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    line_chars: int = 0
    max_lines: int = 0
    head: int = 20
    tail: int = 20
    on_empty: str = ""
    compiled: dict = field(default_factory=dict, compare=False, repr=False, hash=False)

    def patterns(self, name: str, flags: str) -> list[re.Pattern]:
        """Compiled rules of a family, made once for each process."""
        if name not in self.compiled:
            self.compiled[name] = [python(p, flags) for p in getattr(self, name)]
        return self.compiled[name]

    def __getstate__(self):
        return self.__dict__ | {"compiled": {}}


def _sound(patterns) -> tuple[str, ...]:
    return tuple(p for p in patterns or () if lint(p) is None)


def parse(text: str, source_priority: int = BUILTIN) -> list[Filter]:
    """The filters of one file, best first; [] if it is not a list of filters."""
    try:
        rows = json.loads(text)
    except ValueError:
        return []
    if not isinstance(rows, list) or any(not isinstance(r, dict) or not isinstance(r.get("id"), str) or not isinstance(r.get("category"), str) for r in rows):
        return []
    out = []
    for r in rows:
        match, rules, preserve = r.get("match") or {}, r.get("rules"), r.get("preserve") or {}
        own = rules or {}
        keep = _sound([*preserve.get("errorPatterns", []), *preserve.get("summaryPatterns", [])])
        base = {"id": r["id"], "category": r["category"], "name": r.get("name") or r.get("label") or "", "description": r.get("description", ""), "priority": r.get("priority", 50), "source_priority": source_priority, "keep": keep}
        full = any(match.get(k) for k in ("commands", "patterns", "outputTypes")) or own.get("dropPatterns") or own.get("includePatterns") or own.get("stripAnsi")
        if full:
            ends = 0 if rules is None else 20  # a missing `rules` keeps neither end, an empty one both
            base |= {
                "types": tuple(match.get("outputTypes", [])), "commands": _sound(match.get("commands")), "contents": _sound(match.get("patterns")),
                "strip_ansi": own.get("stripAnsi", False), "strip_stderr": own.get("filterStderr", False),
                "replace": tuple((x["pattern"], x["replacement"]) for x in own.get("replace", []) if lint(x["pattern"]) is None),
                "answers": tuple((x["pattern"], x["message"], x.get("unless")) for x in own.get("matchOutput", []) if lint(x["pattern"]) is None),
                "drop": _sound(own.get("dropPatterns")), "include": _sound(own.get("includePatterns")), "collapse": _sound(own.get("collapsePatterns")),
                "line_chars": own.get("truncateLineAt", 0), "max_lines": own.get("maxLines", 0), "head": own.get("headLines", ends), "tail": own.get("tailLines", ends), "on_empty": own.get("onEmpty", ""),
            }
        else:
            base |= {
                "types": tuple(r.get("commandTypes", [])), "strip_ansi": bool(r.get("stripAnsi")), "drop": _sound(r.get("stripPatterns")), "include": _sound(r.get("keepPatterns")), "collapse": _sound(r.get("collapsePatterns")),
                "max_lines": r.get("maxLines") or 0, "head": 20 if r.get("preserveHead") is None else r["preserveHead"], "tail": 20 if r.get("preserveTail") is None else r["preserveTail"],
            }
        out.append(Filter(**base))
    return sorted(out, key=lambda f: (-f.priority, f.id))


@lru_cache(None)
def builtin() -> tuple[Filter, ...]:
    return tuple(parse(resources.files("laconic.rules").joinpath("filters.json").read_text()))


def combined(custom: list[Filter] | tuple[Filter, ...] = ()) -> list[Filter]:
    """Custom filters before built-in ones, then by priority, then by id."""
    return sorted([*custom, *builtin()], key=lambda f: (-f.source_priority, -f.priority, f.id))
