r"""Path scalars over string columns, for ``C:\dir\file`` and ``/dir/file`` alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# First path components that hold system or program files.
SYSTEM_DIRS = (
    "windows",
    "program files",
    "program files (x86)",
    "programdata",
    "$recycle.bin",
    "system volume information",
)

# A drive letter, or a UNC server and share.
_DRIVE = r"^(?:[A-Za-z]:|[\\/]{2}[^\\/]+[\\/][^\\/]+)"
# Listings may name local files as URIs.
_FILE_URI = r"^file:/+(?=[A-Za-z]:)"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)\z", 1)


def dir_name(path: Column) -> Column:
    """Everything before the last separator, without trailing separators unless it is a root."""
    head = F.regexp_extract(path, r"(?s)^(.*[\\/])?[^\\/]*\z", 1)
    bare = F.regexp_replace(head, r"[\\/]+\z", "")
    return F.when(bare.rlike(r"^[A-Za-z]:\z") | (bare == ""), head).otherwise(bare)


def raw_extension(path: Column) -> Column:
    """Extension with its dot, in the case it was written."""
    return F.regexp_extract(base_name(path), r"(?s)^\.*[^.].*?(\.[^.]*)\z", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; leading dots of a name do not start one."""
    return F.lower(raw_extension(path))


def stem(path: Column) -> Column:
    """The base name without the extension."""
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(raw_extension(path)))


def ext_in(path: Column, extensions: Sequence[str]) -> Column:
    wanted = sorted({"." + e.lower().lstrip(".") for e in extensions})
    return extension(path).isin(wanted)


def normalize_root(root: Column) -> Column:
    r"""Backslashes only, exactly one at the end; ``C:`` becomes ``C:\``; empty stays empty."""
    body = F.regexp_replace(F.replace(root, F.lit("/"), F.lit("\\")), r"\\+\z", "")
    return F.when(root == "", F.lit("")).otherwise(F.concat(body, F.lit("\\")))


def under(path: Column, root: str | Column) -> Column:
    """Is ``path`` inside ``root``? Anchored at the start and blind to case."""
    prefix = F.lower(normalize_root(F.lit(root) if isinstance(root, str) else root))
    return F.lower(F.replace(path, F.lit("/"), F.lit("\\"))).startswith(prefix)


def _first_component(path: Column) -> Column:
    tail = F.regexp_replace(path, _DRIVE, "")
    return F.lower(F.regexp_extract(tail, r"^[\\/]*([^\\/]*)", 1))


def not_system_dir(path: Column) -> Column:
    """False for paths whose first component after the drive is a system directory."""
    path = F.regexp_replace(path, _FILE_URI, "")
    return ~(path.rlike(_DRIVE) & _first_component(path).isin(list(SYSTEM_DIRS)))


def not_system_dir_of_root(path: Column, root: Column) -> Column:
    """As :func:`not_system_dir`, but only where the scanned root is a whole drive."""
    drive_root = normalize_root(root).rlike(r"^[A-Za-z]:\\\z")
    excluded = [under(path, F.concat(normalize_root(root), F.lit(d))) for d in SYSTEM_DIRS]
    inside = excluded[0]
    for condition in excluded[1:]:
        inside = inside | condition
    return ~(drive_root & inside)


def _collapse(parts: Column, rooted: Column) -> Column:
    """Resolve ``.``, ``..`` and empty parts; ``..`` above a root disappears."""
    nothing = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        can_pop = (F.size(done) > 0) & (last != "..")
        return (
            F.when((part == "") | (part == "."), done)
            .when(part != "..", F.concat(done, F.array(part)))
            .when(can_pop, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(rooted, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    return F.aggregate(parts, nothing, step)


def path_key(path: Column, style: str = "windows") -> Column:
    """Comparable form of a path: one separator, no ``.``/``..``, case folded on Windows."""
    if style == "windows":
        plain = F.replace(path, F.lit("/"), F.lit("\\"))
        drive = F.regexp_extract(plain, _DRIVE, 0)
        tail = F.substring(plain, F.length(drive) + 1, F.length(plain))
        separator, split_on = "\\", r"\\"
    else:
        plain = path
        drive = F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", 0)
        tail = F.substring(plain, F.length(drive) + 1, F.length(plain))
        separator, split_on = "/", "/"
    rooted = tail.startswith(separator)
    body = F.array_join(_collapse(F.split(tail, split_on), rooted), separator)
    joined = F.concat(drive, F.when(rooted, F.lit(separator)).otherwise(F.lit("")), body)
    key = F.when(joined == "", F.lit(".")).otherwise(joined)
    return F.lower(key) if style == "windows" else key
