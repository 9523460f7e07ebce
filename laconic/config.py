"""Engine options: plain values, or read once from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

#: Bytes of a compressed tool output at most.
CHAR_BUDGET = 12_000
#: An output of an unknown type up to these bytes and with fewer newlines only loses its escape codes.
SHORT_BYTES, SHORT_NEWLINES = 2_000, 30


def _on(value: str | None, default: bool) -> bool:
    return default if value is None else value.strip().lower() not in ("", "0", "false", "off", "no")


@dataclass(frozen=True)
class EngineConfig:
    compress: bool = True  # tool outputs
    condense: bool = False  # user texts
    condense_level: str = "lite"
    grouping: bool = True
    char_budget: int = CHAR_BUDGET
    filters_dir: str | None = None
    session_ttl_s: int = 86_400
    cache_ttl_s: int = 86_400

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> EngineConfig:
        """LACONIC_COMPRESS, _CONDENSE (on/off or a level), _CONDENSE_LEVEL (wins), _GROUPING, _CHAR_BUDGET, _FILTERS_DIR, _SESSION_TTL, _CACHE_TTL.

        Levels other than full and ultra mean lite; a budget of 0 lifts the limit.
        """
        env = os.environ if env is None else env
        condense = env.get("LACONIC_CONDENSE")
        named = (condense or "").strip().lower()
        level = env.get("LACONIC_CONDENSE_LEVEL", named if named in ("full", "ultra") else "lite").strip().lower()
        number = lambda key, default: int(env[key]) if env.get(key, "").strip().isdigit() else default
        return cls(
            compress=_on(env.get("LACONIC_COMPRESS"), True),
            condense=_on(condense, False),
            condense_level=level if level in ("full", "ultra") else "lite",
            grouping=_on(env.get("LACONIC_GROUPING"), True),
            char_budget=number("LACONIC_CHAR_BUDGET", CHAR_BUDGET),
            filters_dir=env.get("LACONIC_FILTERS_DIR") or None,
            session_ttl_s=number("LACONIC_SESSION_TTL", 86_400),
            cache_ttl_s=number("LACONIC_CACHE_TTL", 86_400),
        )
