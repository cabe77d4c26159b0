"""Change classification, impact rating, document mapping and conflicts.

Per-project results are single aggregations on ``project``: partial
(map-side) aggregation runs first, so a project holding a third of all
changes costs one pre-aggregated row per task, not a hot shuffle partition.
Lists kept in a report row hold distinct modules or documents only; the
change list itself stays a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import impact_level, level_from_rank, level_rank, summary_text
from .mentions import contains_join

# Change types. The generated-document marker is whatever the
# generator writes; it is a parameter with a neutral default.
CHANGE_TYPES = ["added", "modified", "removed", "renamed"]
GENERATED_MARKER = "Auto-generated by fleetlens"
CONFLICT_REASON = 'Spec "%s" contains manual edits (not auto-generated)'


def classify_changes(symbols: DataFrame, group: Sequence[str] = ("project",)) -> DataFrame:
    """Counts of changes per type and group (one column per type)."""
    return (symbols.groupBy(*group)
            .agg(*[F.count(F.when(F.col("type") == t, 1)).alias(f"n_{t}") for t in CHANGE_TYPES]))


def rate_symbols(symbols: DataFrame) -> DataFrame:
    """Adds ``impact_level`` per symbol change."""
    return symbols.withColumn("impact_level", impact_level("name", "affected_modules"))


def map_documents(symbols: DataFrame, docs: DataFrame | None = None, state: DataFrame | None = None,
                  state_key: str = "key") -> DataFrame:
    """Documents of each (project, module) of the changes.

    (a) the sync state's ``mapped_specs`` of the entry keyed by the module;
    (b) ``.md`` documents whose lower-cased text contains the lower-cased
    module name (exact containment join, see ``contains_join``).
    Returns distinct (project, module, spec).
    """
    mods = symbols.select("project", "module").distinct()
    parts = []
    if state is not None:
        parts.append(mods.join(state.select("project", F.col(state_key).alias("module"),
                                            F.explode("mapped_specs").alias("spec")), ["project", "module"]))
    if docs is not None:
        md = docs.where(F.col("name").endswith(".md")).select("project", "name", "text")
        hits = contains_join(md, mods, "text", "module", group=["project"], text_keys=["name"],
                             needle_keys=["module"])
        parts.append(hits.select("project", "module", F.col("name").alias("spec")))
    if not parts:
        return mods.select("project", "module", F.lit(None).cast("string").alias("spec")).where(F.lit(False))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def impact_modules(symbols: DataFrame, group: Sequence[str] = ("project",)) -> DataFrame:
    """Affected modules as a table: distinct non-empty (project, module)."""
    return symbols.where(F.col("module") != "").select(*group, "module").distinct()


def impact_report(symbols: DataFrame, specs: DataFrame | None = None, projects: DataFrame | None = None,
                  group: Sequence[str] = ("project",)) -> DataFrame:
    """One row per project (or ``group``): overall level (max over symbols, ``low`` when
    none), numbers of changes, distinct non-empty modules and distinct specs,
    and the summary sentence. ``projects`` adds projects without changes.
    The module and spec lists stay tables (``impact_modules``, ``specs``)."""
    group = list(group)
    per = (symbols.groupBy(*group)
           .agg(F.max(level_rank(impact_level("name", "affected_modules"))).alias("_rank"),
                F.count(F.lit(1)).alias("n_changes")))
    mods = impact_modules(symbols, group).groupBy(*group).agg(F.count(F.lit(1)).alias("n_modules"))
    per = per.join(mods, group, "left")
    if specs is not None:
        sp = specs.select(*group, "spec").distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("n_specs"))
        per = per.join(sp, group, "left")
    else:
        per = per.withColumn("n_specs", F.lit(0).cast("long"))
    if projects is not None:
        per = projects.select(*group).distinct().join(per, group, "left")
    n_changes = F.coalesce(F.col("n_changes"), F.lit(0))
    n_modules = F.coalesce(F.col("n_modules"), F.lit(0))
    n_specs = F.coalesce(F.col("n_specs"), F.lit(0))
    level = level_from_rank("_rank")
    return per.select(*group, level.alias("impact_level"), n_changes.alias("n_changes"),
                      n_modules.alias("n_modules"), n_specs.alias("n_specs"),
                      summary_text(level, n_changes, n_modules, n_specs).alias("summary"))


def change_report(report: DataFrame, symbols: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """The change report as rows (project, section, item): a 'summary' and a
    'level' row, then one row per affected module, spec and change, and a
    '(none)' row for an empty section. Every project's report is a set of
    rows, never one gathered value."""
    none = F.lit("(none)")
    head = (report.select("project", F.lit("summary").alias("section"), F.col("summary").alias("item"))
            .unionByName(report.select("project", F.lit("level").alias("section"),
                                       F.col("impact_level").alias("item"))))
    mods = impact_modules(symbols).select("project", F.lit("modules").alias("section"), F.col("module").alias("item"))
    empty_mods = report.where(F.col("n_modules") == 0).select("project", F.lit("modules").alias("section"),
                                                               none.alias("item"))
    lines = change_lines(symbols).select("project", F.lit("changes").alias("section"), F.col("line").alias("item"))
    empty_changes = report.where(F.col("n_changes") == 0).select("project", F.lit("changes").alias("section"),
                                                                  none.alias("item"))
    out = head.unionByName(mods).unionByName(empty_mods).unionByName(lines).unionByName(empty_changes)
    empty_specs = report.where(F.col("n_specs") == 0).select("project", F.lit("specs").alias("section"),
                                                              none.alias("item"))
    if specs is not None:
        out = out.unionByName(specs.select("project", F.lit("specs").alias("section"),
                                           F.col("spec").alias("item")).distinct())
    return out.unionByName(empty_specs)


def change_lines(symbols: DataFrame) -> DataFrame:
    """One report line per change: '- **<name>** (<type>): <summary>'."""
    return symbols.select("project", "name", "type",
                          F.format_string("- **%s** (%s): %s", "name", "type", "summary").alias("line"))


def detect_conflicts(specs: DataFrame, docs: DataFrame, marker: str = GENERATED_MARKER) -> DataFrame:
    """Affected specs whose document exists and lacks the generated marker.
    A missing document is no conflict. Returns (project, spec, reason)."""
    d = docs.select("project", F.col("name").alias("spec"), "text")
    return (specs.select("project", "spec").distinct().join(d, ["project", "spec"])
            .where(~F.col("text").contains(marker))
            .select("project", "spec", F.format_string(CONFLICT_REASON, F.col("spec")).alias("reason")))


def conflict_flags(conflicts: DataFrame, projects: DataFrame) -> DataFrame:
    """``has_conflict`` and count per project (projects without conflicts kept)."""
    c = conflicts.groupBy("project").agg(F.count(F.lit(1)).alias("n_conflicts"))
    return (projects.select("project").distinct().join(c, "project", "left")
            .select("project", (F.coalesce("n_conflicts", F.lit(0)) > 0).alias("has_conflict"),
                    F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts")))


def guarded_overwrite(candidates: DataFrame, existing: DataFrame, marker: str = GENERATED_MARKER,
                      keys: Sequence[str] = ("project", "name")) -> DataFrame:
    """Decide per generated document whether it may be written: only when no
    document exists under its key or the existing one carries the marker.
    Returns the candidate columns plus ``action`` in ('written', 'skipped').
    The marker is looked for where the documents are scanned; their texts
    take no part in the join."""
    keys = list(keys)
    manual = existing.where(~F.coalesce(F.col("text").contains(marker), F.lit(True))).select(*keys).distinct()
    j = candidates.join(manual.withColumn("_manual", F.lit(True)), keys, "left")
    return j.withColumn("action", F.when(F.col("_manual"), "skipped").otherwise("written")).drop("_manual")
