"""Archive paths: normal form, categories, patterns, ancestors."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.payload import case_folded

#: Directory names that the source profile leaves out.
DEFAULT_EXCLUDES = (
    ".git",
    ".venv",
    "venv",
    "__pycache__",
    ".mypy_cache",
    ".pytest_cache",
    ".ruff_cache",
    "node_modules",
    "dist",
    "build",
)

#: Categories of source files, by suffix.
CATEGORIES = {
    "python": (".py",),
    "c-cpp": (".c", ".cc", ".cpp", ".h", ".hpp"),
    "arduino": (".ino",),
    "javascript-typescript": (".js", ".jsx", ".ts", ".tsx"),
    "html-css": (".html", ".css"),
    "json-yaml": (".json", ".yaml", ".yml"),
    "documentation": (".md", ".rst", ".txt"),
}


class UnsafePath(ValueError):
    """A path that is absolute, climbs, names a drive, or has no parts."""


def normalize_path(value: str) -> str:
    """The driver's form of `normalized`; raises UnsafePath."""
    value = value.replace("\\", "/")
    parts = [p for p in value.split("/") if p not in ("", ".")]
    if "\0" in value or value.startswith("/") or re.match("[A-Za-z]:", value) or not parts or ".." in parts:
        raise UnsafePath(f"unsafe archive path: {value!r}")
    return "/".join(parts)


def _slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normalized(path: Column) -> Column:
    """Relative, with forward slashes and without empty or '.' parts; null if unsafe."""
    slashed = _slashes(path)
    parts = F.filter(F.split(slashed, "/"), lambda x: ~x.isin("", "."))
    unsafe = F.contains(slashed, F.lit("\0")) | slashed.rlike("^(/|[A-Za-z]:)") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~unsafe, F.array_join(parts, "/"))


def suffix(path: Column) -> Column:
    """The last part's suffix with its dot, '' if it has none; a leading dot begins no suffix."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def category(path: Column) -> Column:
    pairs = [F.lit(x) for name, ends in CATEGORIES.items() for end in ends for x in (end, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(suffix(path))), F.lit("other"))


def glob_pattern(glob: str) -> str:
    """A shell pattern as a regular expression; * and ? also match slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", i + 1 + (glob[i : i + 1] == "!"))) > 0:
            body = glob[i:end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&").replace("^", r"\^")
            out += f"[^{body[1:]}]" if body.startswith("!") else f"[{body}]"
            i = end + 1
        else:
            out += re.sub(r"([^A-Za-z0-9_/])", r"\\\1", c)
    return f"(?s)^{out}$"


def matches(path: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Whether the whole path fits a shell pattern, or a part of it equals one."""
    out = F.lit(False)
    if patterns:
        out = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, patterns)))
        for p in patterns:
            out = out | path.rlike(glob_pattern(p))
    return out


def ancestors(path: Column) -> Column:
    """All strict ancestors, the topmost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def collision_key(path: Column, ascii_only: bool = False) -> Column:
    """What two paths share if they differ in case alone. Plain `lower` is enough for ASCII."""
    return F.lower(path) if ascii_only else case_folded(path)


def selected(path: Column, values: list[str]) -> Column:
    """Whether the path is one of the values or below one; all paths if there are none."""
    if not values:
        return F.lit(True)
    out = F.lit(False)
    for v in values:
        v = normalize_path(v)
        out = out | (path == v) | F.startswith(path, F.lit(v + "/"))
    return out


def inside(root: str, path: str) -> str:
    """Where an archive path lies below a local folder; raises UnsafePath if a link would lead out of it."""
    import os

    base = os.path.realpath(root)
    target = os.path.join(base, *PurePosixPath(normalize_path(path)).parts)
    at = base
    for part in PurePosixPath(normalize_path(path)).parts[:-1]:
        at = os.path.join(at, part)
        if os.path.islink(at):
            raise UnsafePath(f"a link lies on the way to {path!r}")
    return target
