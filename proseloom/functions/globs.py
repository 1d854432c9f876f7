"""Path globs as anchored patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = re.compile(r"\*\*/|\*\*|\*|\?|\{[^{}]*\}|.", re.S)


def glob_pattern(glob: str) -> str:
    """``**/`` any folders, ``**`` anything, ``*`` and ``?`` inside a name, ``{a,b}`` literal choices."""
    fixed = {"**/": r"(?:[^/]+/)*", "**": r".*", "*": r"[^/]*", "?": r"[^/]"}
    choice = lambda t: "(?:" + "|".join(re.escape(x) for x in t[1:-1].split(",")) + ")"
    return r"\A" + "".join(fixed.get(t) or (choice(t) if t[0] == "{" and len(t) > 1 else re.escape(t)) for t in _SPECIAL.findall(glob)) + r"\z"


def matches_any(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for glob in globs:
        out = out | path.rlike(glob_pattern(glob))
    return out


def first_match(path: Column, ordered: list[tuple[str, str]], default: str) -> Column:
    """The value of the first glob that matches."""
    return F.coalesce(*(F.when(path.rlike(glob_pattern(g)), F.lit(v)) for g, v in ordered), F.lit(default))
