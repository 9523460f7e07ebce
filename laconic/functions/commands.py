"""Shell command lines: their normal form, and what a search looks for.

Plain functions with a small amount of state, for the Arrow passes; `normal`
and `keywords` wrap them as Columns.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from laconic.rules.detectors import PREFIXES

# Environment assignments, wrappers, connectors, nested shells and interpreters in front of a command.
_ENV = re.compile(r"""^(?:[A-Za-z_][A-Za-z0-9_]*=(?:"[^"]*"|'[^']*'|\S+)\s+)+""")
_WRAPPER = re.compile(r"^(?:env\s+|command\s+|builtin\s+|noglob\s+|(?:/usr/bin/)?time\s+(?:-[A-Za-z]+\s+)*|stdbuf\s+(?:-[A-Za-z]+\s+\S+\s+)*|nice\s+(?:-n\s+\S+\s+)?)")
_CONNECTOR = re.compile(r"\s*(?:&&|\|\||;)\s*")
_NESTED = re.compile(r"(?s)^(?:ba|z)?sh\s+-[A-Za-z]*c\s+(.*)\Z")
_PYTHON = re.compile(r"^(?:\S*/)?python(?:\d+(?:\.\d+)?)?\b")
_KNOWN = re.compile(rf"^(?:{'|'.join('g+' if x == 'g++' else 'clang+' if x == 'clang++' else x for x in PREFIXES)})\b")
_PRINTS = re.compile(r"""(?i)(?:['"][^'"]*\d+,\d*p[^'"]*['"]|['"][^'"]*\d+p[^'"]*['"]|-e\s+['"]?\d)""")
_SUBSTITUTES = re.compile(r"""(?i)['"][^'"]*s[/|#]""")
_META = set(r"\.^$|()[]{}*+?")


def split_lines(text: str) -> list[str]:
    """Lines as grouping and commands see them: a last newline adds none, one \\r before a newline goes."""
    if not text:
        return []
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
        ended = True
    else:
        ended = False
    last = len(out) - 1
    return [x[:-1] if x.endswith("\r") and (i < last or ended) else x for i, x in enumerate(out)]


def _first_line(text: str) -> str:
    return next((s for x in split_lines(text) if (s := x.strip()) and not s.startswith("#")), text.strip())


def _bare(command: str) -> str:
    before = None
    command = command.strip()
    while before != command:
        before, command = command, _WRAPPER.sub("", _ENV.sub("", command, 1), 1).strip()
    return command


def is_known(command: str) -> bool:
    return bool(_KNOWN.match(command))


def normalise(command: str) -> str:
    """The part of a command line that says what it does."""
    text = command.strip()
    while text.startswith("$ "):
        text = text[2:]
    text = _bare(_first_line(text.strip()))
    if nested := _NESTED.match(text):
        inner = nested[1].strip()
        if len(inner) >= 2 and inner[0] == inner[-1] and inner[0] in "'\"":
            inner = inner[1:-1]
        if inner := _first_line(inner):
            text = _bare(inner)
    parts = [s for x in _CONNECTOR.split(text) if (s := x.strip())]
    for part in parts:
        if is_known(name := _PYTHON.sub("python", part, 1)):
            return name
    return _PYTHON.sub("python", parts[0] if parts else text, 1)


def command_in(text: str) -> str | None:
    """A known command on one of the first four lines of an output."""
    return next((c for x in split_lines(text)[:4] if (c := normalise(x)) and is_known(c)), None)


def reads_with_sed(command: str) -> bool:
    c = normalise(command)
    if not c.lower().startswith("sed") or any(x in c for x in ("s/", "s#", "s|")) or _SUBSTITUTES.search(c):
        return False
    return " -n" in c.lower() or bool(_PRINTS.search(c))


def shell_tokens(command: str) -> list[str]:
    """Tokens at white space; one that begins with a quote runs to the next such quote."""
    out, i, n = [], 0, len(command)
    while i < n:
        if command[i].isspace():
            i += 1
            continue
        if command[i] in "'\"":
            end = command.find(command[i], i + 1)
            end = n if end < 0 else end
            token, i = command[i + 1 : end], end + 1
        else:
            end = next((j for j in range(i, n) if command[j].isspace()), n)
            token, i = command[i:end], end
        if token:
            out.append(token)
    return out


def _is_path(token: str) -> bool:
    return token.startswith(("./", "../", "/")) or token in (".", "..")


def _search_patterns(tokens: list[str]) -> list[str]:
    found, i = [], 1
    while i < len(tokens):
        if tokens[i].startswith("-"):
            if tokens[i] in ("-e", "--regexp", "-f", "--file"):
                i += 1
                if i < len(tokens) and not tokens[i].startswith("-"):
                    found.append(tokens[i])
        elif not found and not _is_path(tokens[i]):
            found.append(tokens[i])
        i += 1
    return found


def literal_cores(pattern: str) -> list[str]:
    """What a match must hold literally: the whole pattern if it has no special character, else its longer words."""
    if not _META & set(pattern):
        return [pattern]
    return [x for x in re.findall(r"[A-Za-z0-9_]{3,}", pattern) if re.search("[A-Za-z]", x)]


def search_terms(command: str) -> list[str]:
    """Up to four distinct literals that the searches of a script look for."""
    raw: list[str] = []
    for line in split_lines(command):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        segment: list[str] = []
        for token in [*shell_tokens(line), ";"]:
            if token not in ("&&", "||", ";", "|", "&"):
                segment.append(token)
                continue
            while segment and re.match(r"[A-Za-z_][A-Za-z0-9_]*=", segment[0]):
                segment.pop(0)
            if segment:
                tool = segment[0].rsplit("/", 1)[-1].lower()
                if tool in ("rg", "grep", "egrep", "fgrep", "ag") and not (tool == "rg" and "--files" in segment):
                    raw += _search_patterns(segment)
            segment = []
    cores = [c for p in raw for c in literal_cores(p) if len(c.encode()) >= 2 and not _is_path(c)]
    return list(dict.fromkeys(cores))[:4]


def normal(command) -> Column:
    """normalise() as a Column; apply it to distinct commands where there are few."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return s.map(lambda c: None if c is None else known[c] if c in known else known.setdefault(c, normalise(c)))

    return run(command)


def keywords(command) -> Column:
    """search_terms() as a Column."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda c: [] if c is None else search_terms(c))

    return run(command)
