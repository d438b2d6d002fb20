"""Path patterns as regular expressions, compiled once on the driver and matched by the engine."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A glob as a regex of the whole path: ** over directories, * and ? within one, [...] classes."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """An ignore-file pattern as (regex, excludes); None for blanks and comments.

    A slash at the end matches directories (anything below), one elsewhere anchors the pattern to the root.
    """
    line = pattern.rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    only_dir, body = line.endswith("/"), line.strip("/")
    anchored = "/" in line.rstrip("/")
    tail = "/.*" if only_dir else "(?:/.*)?"
    return "^" + ("" if anchored else "(?:.*/)?") + glob_regex(body) + tail + "$", not negated


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last ignore pattern that matches ``path`` excludes it."""
    result = F.lit(False)
    for found in filter(None, map(ignore_regex, patterns)):
        result = F.when(path.rlike(found[0]), F.lit(found[1])).otherwise(result)
    return result


def pattern_filter(path: Column, patterns: str) -> Column:
    """Filter box: patterns between blanks or commas, any must match; a bare word is *word* anywhere, ! excludes; case is ignored."""
    wanted, unwanted = [], []
    for p in filter(None, re.split(r"[\s,]+", patterns)):
        target, body = (unwanted, p[1:]) if p.startswith("!") else (wanted, p)
        if body:
            target.append("(?i)^" + glob_regex(body if re.search(r"[*?\[\]{}]", body) else f"**/*{body}*") + "$")
    return (_any(path, wanted) if wanted else F.lit(True)) & ~_any(path, unwanted)


def _any(path: Column, regexes: list[str]) -> Column:
    result = F.lit(False)
    for r in regexes:
        result = result | path.rlike(r)
    return result
