"""Module structure and dependency-graph health.

Inputs: ``modules(project, name, path)``, their exports and files as rows
``(project, name, export)`` and ``(project, file)``, and ``edges(project,
source, target)``. Module tables join by shuffle on
(project, name); nothing here is broadcast because module tables grow with
the fleet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import basename, boundary_of, depth_after_src

# Reference thresholds, penalties, entry-point name pattern and
# issue texts.
GOD_MODULE_EXPORTS = 50
DEEP_NEST_DEPTH = 4
ENTRY_PATTERN = r"^(index|main|app|server|cli|bin)\."
PENALTY = {"cycle": 20, "god_module": 15, "orphan": 10, "deep_file": 5}
RULE_ORDER = {"cycle": 1, "god_module": 2, "orphan": 3, "deep_file": 4}
ISSUE_TEXT = {
    "cycle": "circular dependency: %s",
    "god_module": 'god module "%s" has >%d exports',
    "orphan": 'orphan module "%s" has no incoming or outgoing dependencies',
    "deep_file": 'deep-nested file "%s" is more than %d levels deep',
}


def module_boundaries(modules: DataFrame) -> DataFrame:
    """(project, name, path, boundary) for every module."""
    return modules.select("project", "name", "path", boundary_of("path").alias("boundary"))


def boundaries(modules: DataFrame) -> DataFrame:
    """One row per boundary: (project, boundary, n_modules, first_module,
    last_module). The member list stays a table (``module_boundaries``), so a
    boundary with millions of modules never becomes one row."""
    return (module_boundaries(modules).groupBy("project", "boundary")
            .agg(F.count(F.lit(1)).alias("n_modules"), F.min("name").alias("first_module"),
                 F.max("name").alias("last_module")))


def _name_boundary(modules: DataFrame) -> DataFrame:
    # a name listed in two boundaries resolves to one boundary (the largest name)
    return (module_boundaries(modules).groupBy("project", "name")
            .agg(F.max("boundary").alias("boundary")))


def core_apis(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are known modules in different boundaries:
    (project, name=target, route='source → target', method='export',
    module=target boundary). Duplicate edges are kept."""
    nb = _name_boundary(modules)
    src = nb.select("project", F.col("name").alias("source"), F.col("boundary").alias("_sb"))
    dst = nb.select("project", F.col("name").alias("target"), F.col("boundary").alias("_tb"))
    j = edges.join(src, ["project", "source"]).join(dst, ["project", "target"])
    return (j.where(F.col("_sb") != F.col("_tb"))
            .select("project", F.col("target").alias("name"),
                    F.concat_ws(" → ", F.col("source").cast("string"), F.col("target").cast("string")).alias("route"),
                    F.lit("export").alias("method"), F.col("_tb").alias("module"),
                    F.col("_sb").alias("source_boundary")))


def boundary_matrix(core: DataFrame) -> DataFrame:
    """Cross-boundary dependency counts per (source boundary, target boundary)."""
    return (core.groupBy("project", F.col("source_boundary"), F.col("module").alias("target_boundary"))
            .agg(F.count(F.lit(1)).alias("n_edges")))


def module_dependencies(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct direct dependencies of every module as rows (project, name,
    dependency); a module without any gets one row with a null dependency.
    Callers sort; no module's list is gathered into one row."""
    deps = edges.select("project", F.col("source").alias("name"), F.col("target").alias("dependency")).distinct()
    return modules.select("project", "name").join(deps, ["project", "name"], "left")


def call_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges touching each symbol (as source or target)."""
    s = symbols.select("project", F.col("name").alias("symbol"))
    out = edges.join(s.withColumnRenamed("symbol", "source"), ["project", "source"]) \
        .withColumn("symbol", F.col("source"))
    inc = edges.join(s.withColumnRenamed("symbol", "target"), ["project", "target"]) \
        .withColumn("symbol", F.col("target"))
    return out.unionByName(inc).distinct()


def orphans(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules that are neither source nor target of any edge (a self-loop
    counts as an edge)."""
    ends = (edges.select("project", F.col("source").alias("name"))
            .unionByName(edges.select("project", F.col("target").alias("name"))))
    return modules.select("project", "name").join(ends, ["project", "name"], "left_anti")


def export_counts(exports: DataFrame) -> DataFrame:
    """(project, name, n_exports) of the rows (project, name, export); a
    repeated export counts once."""
    return exports.groupBy("project", "name").agg(F.countDistinct("export").alias("n_exports"))


def god_modules(counts: DataFrame, threshold: int = GOD_MODULE_EXPORTS) -> DataFrame:
    """Modules with more than ``threshold`` exports, from (project, name,
    n_exports)."""
    return counts.select("project", "name", "n_exports").where(F.col("n_exports") > threshold)


def deep_files(files: DataFrame, threshold: int = DEEP_NEST_DEPTH) -> DataFrame:
    """Files nested more than ``threshold`` folders below their source root.
    ``files(project, file, ...)``."""
    return (files.withColumn("depth", depth_after_src("file"))
            .where(F.col("depth") > threshold))


def entry_points(files: DataFrame) -> DataFrame:
    """Files named index./main./app./server./cli./bin. at depth 0 or 1."""
    return files.where(basename("file").rlike(ENTRY_PATTERN) & (depth_after_src("file") <= 1))


def issue_rows(cycles: DataFrame | None = None, gods: DataFrame | None = None,
               orphan_mods: DataFrame | None = None, deep: DataFrame | None = None,
               god_threshold: int = GOD_MODULE_EXPORTS, deep_threshold: int = DEEP_NEST_DEPTH) -> DataFrame:
    """Union of rule findings: (project, rule, rule_order, subject, issue, penalty).

    ``cycles(project, component, path)`` holds one row per cyclic component
    with a cycle through it (see ``graph.witness_cycles``), ``gods``/``orphan_mods(project,
    name)``, ``deep(project, file)``."""
    parts = []

    def add(df, rule, subject, text):
        parts.append(df.select("project", F.lit(rule).alias("rule"),
                               F.lit(RULE_ORDER[rule]).alias("rule_order"),
                               subject.alias("subject"), text.alias("issue"),
                               F.lit(PENALTY[rule]).alias("penalty")))
    if cycles is not None:
        # a cycle's text may be long: concat joins its bytes, format_string would hold it as characters
        before, after = ISSUE_TEXT["cycle"].split("%s")
        add(cycles, "cycle", F.col("component").cast("string"), F.concat(F.lit(before), F.col("path"), F.lit(after)))
    if gods is not None:
        add(gods, "god_module", F.col("name").cast("string"),
            F.format_string(ISSUE_TEXT["god_module"], F.col("name").cast("string"), F.lit(god_threshold)))
    if orphan_mods is not None:
        add(orphan_mods, "orphan", F.col("name").cast("string"),
            F.format_string(ISSUE_TEXT["orphan"], F.col("name").cast("string")))
    if deep is not None:
        add(deep, "deep_file", F.col("file"),
            F.format_string(ISSUE_TEXT["deep_file"], F.col("file"), F.lit(deep_threshold)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def health(issues: DataFrame, projects: DataFrame) -> DataFrame:
    """Score per project: max(0, 100 - sum of penalties), with per-rule issue
    counts; projects without issues score 100."""
    per = (issues.groupBy("project")
           .agg(F.sum("penalty").alias("_pen"),
                *[F.count(F.when(F.col("rule") == r, 1)).alias(f"n_{r}") for r in RULE_ORDER]))
    j = projects.select("project").distinct().join(per, "project", "left")
    return j.select(
        "project",
        F.greatest(F.lit(0), F.lit(100) - F.coalesce("_pen", F.lit(0))).cast("int").alias("score"),
        *[F.coalesce(f"n_{r}", F.lit(0)).alias(f"n_{r}") for r in RULE_ORDER])
