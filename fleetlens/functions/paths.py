"""Path rules as Column expressions.

All functions take a Column (or column name) holding a '/'-separated relative
path and return a Column, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's rules.
# Top-level folders treated as source roots by the boundary and depth rules.
SRC_DIRS = ["src", "lib", "app", "source", "sources"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path) -> Column:
    """Last path segment."""
    return F.try_element_at(F.split(_col(path), "/"), F.lit(-1))


def module_of(path) -> Column:
    """Module of a file path.

    The segment after the first ``src`` segment (which must not be the last
    one), with its last extension removed when the extension including the
    dot is at most five characters and the dot is not the first character.
    Otherwise the first segment if the path has more than one, else ''.
    """
    parts = F.split(_col(path), "/")
    pos = F.array_position(parts, "src")
    raw = F.try_element_at(parts, (pos + 1).cast("int"))
    stripped = F.regexp_replace(raw, r"^(.+)\.[^.]{0,4}$", "$1")
    return (F.when((pos > 0) & (pos < F.size(parts)), stripped)
            .when(F.size(parts) > 1, F.try_element_at(parts, F.lit(1)))
            .otherwise(F.lit("")))


def symbol_of(path) -> Column:
    """Symbol name of a file: basename without its last extension, split on
    '-' and '_', each part with an upper-cased first character, joined."""
    stem = F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")
    parts = F.split(stem, "[-_]")
    return F.array_join(
        F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))),
        "")


def boundary_of(module_path) -> Column:
    """Boundary of a module path (see SRC_DIRS)."""
    parts = F.split(_col(module_path), "/")
    n = F.size(parts)
    first = F.try_element_at(parts, F.lit(1))
    second = F.try_element_at(parts, F.lit(2))
    has_ext = F.try_element_at(parts, F.lit(-1)).rlike(r"\.[^.]+$")
    under_src = (F.when(n >= 3, second)
                 .when((n == 2) & has_ext, F.lit("root"))
                 .when(n == 2, second)
                 .otherwise(F.lit("root")))
    elsewhere = F.when(n >= 2, first).otherwise(F.lit("root"))
    return F.when(first.isin(SRC_DIRS), under_src).otherwise(elsewhere)


def depth_after_src(path) -> Column:
    """Folder depth of a file below its source root (or below the project
    root when the first segment is not a source root)."""
    parts = F.split(_col(path), "/")
    return F.size(parts) - F.when(F.try_element_at(parts, F.lit(1)).isin(SRC_DIRS), 2).otherwise(1)


def content_hash(content) -> Column:
    """Lower-case SHA-256 hex of the bytes (or UTF-8 text) of a file."""
    return F.sha2(_col(content), 256)
