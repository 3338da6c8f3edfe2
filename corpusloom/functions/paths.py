"""Column functions on repo-relative POSIX paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

def no_strings() -> Column:
    return F.array().cast("array<string>")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Directory part, '' at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(name: Column) -> Column:
    """Last extension with its dot; '' for dot files and names without one."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/")))


def ancestors(path: Column) -> Column:
    """Every proper ancestor directory, outermost first; empty for a root file."""
    parts = F.split(path, "/")
    return F.filter(
        F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i), "/")),
        lambda d: d != "",
    )


def module_of(path: Column) -> Column:
    return F.coalesce(F.nullif(dirname(path), F.lit("")), F.lit("."))


def group_of(path: Column, levels: int = 2) -> Column:
    """The first ``levels`` directories as ``a/b/``, or ``(root files)``."""
    parts = F.split(path, "/")
    n = F.least(F.size(parts) - 1, F.lit(levels))
    head = F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))
    return F.when(n > 0, head).otherwise(F.lit("(root files)"))


def normalised(path: Column) -> Column:
    """Collapse empty, ``.`` and ``..`` segments; '' stays '', an empty result is ``.``."""
    segments = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))

    def step(acc: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != "..")
        return F.when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.array_append(acc, s)
        )

    folded = F.array_join(F.aggregate(segments, no_strings(), step), "/")
    # Most paths have nothing to collapse; the fold runs only for those that do.
    needs = path.rlike(r"(^|/)\.{0,2}(/|$)")
    return (
        F.when(path == "", path)
        .when(needs, F.when(folded == "", F.lit(".")).otherwise(folded))
        .otherwise(path)
    )


def strip_chars(text: Column, chars: str) -> Column:
    """Remove any of ``chars`` (a regex class body) from both ends."""
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


LINE_SUFFIX = r"[:#]L?(\d+)(?:-L?(\d+))?$"


def reference_lines(raw: Column) -> tuple[Column, Column]:
    """Start and end line written after a path (``:12-20``, ``#L5``)."""
    text = _unquoted(raw)
    start = F.nullif(F.regexp_extract(text, LINE_SUFFIX, 1), F.lit("")).cast("int")
    end = F.nullif(F.regexp_extract(text, LINE_SUFFIX, 2), F.lit("")).cast("int")
    return start, F.coalesce(end, start)


def _unquoted(raw: Column) -> Column:
    return F.trim(strip_chars(F.trim(raw), "`'\""))


def reference_path(raw: Column) -> Column:
    """A written path without quotes, line suffix, backslashes, ``./`` and leading slashes."""
    text = F.regexp_replace(_unquoted(raw), LINE_SUFFIX, "")
    text = F.replace(text, F.lit("\\"), F.lit("/"))
    text = F.regexp_replace(F.regexp_replace(text, r"^\./", ""), "^/+", "")
    return normalised(text)


def without_repo_prefix(text: Column, repo_name: Column) -> Column:
    """Drop a leading ``owner/name/`` or ``name/`` (case-insensitive)."""
    name = F.lower(repo_name)
    for prefix in (F.concat(name, F.lit("/")), F.concat(basename(name), F.lit("/"))):
        hit = (name != "") & F.startswith(F.lower(text), prefix)
        text = F.when(hit, F.substring(text, F.length(prefix) + 1, F.length(text))).otherwise(text)
    return normalised(text)


def glob_regex(glob: str) -> str:
    """Shell wildcard pattern (``*`` also crosses ``/``) as a full-match regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^(?:{out})$"


def glob_matches(path: Column, glob: str) -> Column:
    """``glob``, or ``glob`` without ``**/``, matches the whole path."""
    hit = path.rlike(glob_regex(glob))
    plain = glob.replace("**/", "")
    return hit | path.rlike(glob_regex(plain)) if plain != glob else hit


def path_contains(path: Column, query: str) -> Column:
    """Case-insensitive substring filter; a blank query keeps every path."""
    needle = query.strip().lower()
    return F.contains(F.lower(path), F.lit(needle)) if needle else F.lit(True)


def repo_ref(url: Column) -> Column:
    """Repository address as ``struct(owner, name, url_key)``; NULL when it is not one.

    Accepts ``https://host/o/r(.git)(/...)``, ``host/o/r``, ``git@host:o/r`` and ``o/r``.
    """
    text = F.trim(url)
    text = F.when(text.rlike(r"(?U)^[\w.-]+/[\w.-]+$"), F.concat(F.lit("github.com/"), text)).otherwise(text)
    text = F.regexp_replace(text, "(?i)^https?://", "")
    text = F.regexp_replace(text, "^git@([^:]*):", "$1/")
    parts = F.filter(F.split(text, "/"), lambda p: p != "")
    owner = F.get(parts, 1)
    name = F.regexp_replace(F.get(parts, 2), r"\.git$", "")
    valid = (
        F.lower(F.get(parts, 0)).isin("github.com", "www.github.com")
        & owner.rlike(r"^[A-Za-z0-9_.-]{1,100}$")
        & name.rlike(r"^[A-Za-z0-9_.-]{1,100}$")
        & ~name.isin(".", "..")
    )
    key = F.lower(F.concat(F.lit("github.com/"), owner, F.lit("/"), name))
    return F.when(
        F.coalesce(valid, F.lit(False)),
        F.struct(owner.alias("owner"), name.alias("name"), key.alias("url_key")),
    )
