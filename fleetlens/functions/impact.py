"""Impact rating of symbol changes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Impact levels in rising order and the summary sentence.
LEVELS = ["low", "medium", "high"]
NO_CHANGES = "No changes detected."
SUMMARY_FORMAT = "%s impact: %d symbol change(s) across %d module(s). %d spec(s) potentially affected."


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def impact_level(name, affected_modules) -> Column:
    """'high' when the first character equals its upper-case form or more
    than three modules are affected, 'medium' for one to three, else 'low'.
    An empty name does not count as upper-case."""
    return impact_level_n(name, F.size(_col(affected_modules)))


def impact_level_n(name, n_affected) -> Column:
    """``impact_level`` from the number of affected modules (no list needed)."""
    name = _col(name)
    n_aff = F.coalesce(_col(n_affected), F.lit(0))
    first = F.substring(name, 1, 1)
    upper_first = (F.length(name) > 0) & (first == F.upper(first))
    return (F.when(upper_first | (n_aff > 3), F.lit("high"))
            .when(n_aff >= 1, F.lit("medium"))
            .otherwise(F.lit("low")))


def level_rank(level) -> Column:
    level = _col(level)
    return (F.when(level == "high", 2).when(level == "medium", 1).otherwise(0))


def level_from_rank(rank) -> Column:
    rank = F.coalesce(_col(rank), F.lit(0))
    return F.when(rank >= 2, "high").when(rank == 1, "medium").otherwise("low")


def summary_text(level, n_changes, n_modules, n_specs) -> Column:
    level = _col(level)
    word = F.concat(F.upper(F.substring(level, 1, 1)), F.substring(level, 2, 100))
    return F.when(_col(n_changes) == 0, F.lit(NO_CHANGES)).otherwise(
        F.format_string(SUMMARY_FORMAT, word, _col(n_changes), _col(n_modules), _col(n_specs)))
