"""One regex dialect for rules, carried over to the JVM's and Python's.

Rules are written for a linear-time engine: no look-around, no back
references, `.` and `$` stop at \\n only, classes are Unicode.
"""

from __future__ import annotations

import re
from functools import lru_cache

_LOOK = re.compile(r"\(\?(?:=|!|<=|<!)|(?<!\\)(?:\\\\)*\\[1-9]|\(\?P=")
_FLAGS = re.compile(r"^\(\?([a-z]+)\)")


def lint(pattern: str) -> str | None:
    """Why a rule with this pattern is dropped, or None."""
    if _LOOK.search(pattern):
        return "look-around or back reference"
    try:
        re.compile(pattern)
    except re.error as e:
        return str(e)
    return None


def _split_flags(pattern: str) -> tuple[str, str]:
    m = _FLAGS.match(pattern)
    return (m[1], pattern[m.end() :]) if m else ("", pattern)


def _dollar(body: str, end: str) -> str:
    """body with each $ that is an anchor replaced by `end`."""
    out, i, inside = [], 0, False
    while i < len(body):
        c = body[i]
        if c == "\\":
            out.append(body[i : i + 2])
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        out.append(end if c == "$" and not inside else c)
        i += 1
    return "".join(out)


def jvm(pattern: str, flags: str = "") -> str:
    """The pattern for java.util.regex, with the same matches."""
    own, body = _split_flags(pattern)
    flags = "".join(sorted(set(own + flags)))
    if "m" not in flags:
        body = _dollar(body, r"\z")
    return f"(?{flags}{'u' if 'i' in flags else ''}dU){body}"


def python(pattern: str, flags: str = "") -> re.Pattern:
    own, body = _split_flags(pattern)
    own = set(own + flags)
    if "m" not in own:
        body = _dollar(body, r"\Z")
    value = sum(getattr(re, f.upper()) for f in own)
    return re.compile(body, value)


_parse = re._parser.parse


def _needs(nodes, folded: bool) -> list[str] | None:
    """Literals of which each match holds at least one; None if there is no such set."""
    best, run = None, ""

    def better(x, y):
        return x if y is None or (x is not None and min(map(len, x)) > min(map(len, y))) else y

    for op, arg in [*nodes, (None, None)]:
        name = str(op)
        if name == "LITERAL" and (not folded or arg < 128):
            run += chr(arg)
            continue
        if run:
            best, run = better([run], best), ""
        if name == "SUBPATTERN":
            best = better(_needs(arg[-1], folded), best)
        elif name == "MAX_REPEAT" and arg[0] > 0:
            best = better(_needs(arg[2], folded), best)
        elif name == "BRANCH":
            each = [_needs(x, folded) for x in arg[1]]
            if all(each):
                best = better([x for e in each for x in e], best)
    return best


@lru_cache(None)
def needed(pattern: str) -> tuple[tuple[str, ...], bool]:
    """(literals of which a match holds at least one, whether in lower case)."""
    tree = _parse(pattern)
    folded = bool(tree.state.flags & re.IGNORECASE)
    found = _needs(list(tree), folded) or []
    found = [x.lower() if folded else x for x in found]
    return (tuple(found) if found and min(map(len, found)) > 1 else ()), folded
