"""Wildcards over names (PAT-1 to PAT-3) and over values of a column (FLT-3)."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Sequence


def has_pattern(s: object) -> bool:
    """Only strings can hold a wildcard."""
    return isinstance(s, str) and any(c in s for c in "*?[")


def expand(patterns: Iterable[str], available: Sequence[str]) -> list[str]:
    """Literals as they are, wildcards as the names that they match; each name once, where it comes first."""
    out: dict[str, None] = {}
    for p in patterns:
        names = fnmatch.filter(available, p) if has_pattern(p) else [p]
        out.update(dict.fromkeys(names))
    return list(out)


def select_names(include: Sequence[str] | None, exclude: Sequence[str] | None, available: Sequence[str]) -> list[str]:
    """``include`` (all, if empty) without what ``exclude`` names or matches."""
    names = expand(include, available) if include else list(available)
    return [n for n in names if not any(fnmatch.fnmatchcase(n, p) if has_pattern(p) else n == p for p in exclude or ())]


def java_regex(pattern: str) -> str:
    """An anchored Java regular expression for one wildcard pattern."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            inner = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out.append(f"[^{inner[1:]}]" if inner.startswith("!") else f"[{inner}]")
            i = end + 1
        else:
            out.append(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c)
    return f"(?s)^(?:{''.join(out)})$"
