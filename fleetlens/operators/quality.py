"""Row validation, layered defaults, status rollups and check tallies.

All per-project rollups are one aggregation per input table on ``project``
(partial aggregation first), joined on ``project``; nothing is collected.
"""

from __future__ import annotations

import json

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import by_locale, with_positions

# Config enumerations and validation messages, folders of notes.
STRATEGIES = ["embedded", "standalone", "hybrid"]
SYNC_MODES = ["manual", "git-hook", "watch"]
CONFIG_MESSAGES = {
    "project": "project is required",
    "project.name": "project.name is required and must be a non-empty string",
    "project.languages": "project.languages must be a non-empty array",
    "project.rootDir": "project.rootDir is required and must be a non-empty string",
    "project.srcDir": "project.srcDir is required and must be a non-empty string",
    "obsidian": "obsidian is required",
    "obsidian.strategy": "obsidian.strategy must be one of: embedded, standalone, hybrid",
    "sync": "sync is required",
    "sync.mode": "sync.mode must be one of: manual, git-hook, watch",
}
NOTE_KINDS = ["modules", "apis", "data", "journal", "decisions"]
CHECK_LEVELS = ["pass", "warn", "fail"]


# --------------------------------------------------------------------------- A10

def required_string(col: str, message: str | None = None):
    """Rule: the field must be a non-empty string."""
    c = F.col(col)
    return F.when(c.isNull() | (F.length(c.cast("string")) == 0),
                  F.lit(message or f"{col} is required and must be a non-empty string"))


def non_empty_array(col: str, message: str | None = None):
    c = F.col(col)
    return F.when(c.isNull() | (F.size(c) == 0), F.lit(message or f"{col} must be a non-empty array"))


def one_of(col: str, values: Sequence[str], message: str | None = None):
    c = F.col(col)
    return F.when(c.isNull() | ~c.isin(list(values)),
                  F.lit(message or f"{col} must be one of: {', '.join(values)}"))


def required_struct(col: str, message: str | None = None):
    return F.when(F.col(col).isNull(), F.lit(message or f"{col} is required"))


def validate_rows(df: DataFrame, rules: Sequence[Column]) -> DataFrame:
    """Adds ``issues`` (array of messages, in rule order) and ``n_issues``."""
    issues = F.array_compact(F.array(*rules))
    return df.withColumn("issues", issues).withColumn("n_issues", F.size("issues"))


def config_rules(prefix: str = "cfg") -> list[Column]:
    """The config checks: project fields, vault strategy and sync mode."""
    def inside(part: str, rule: Column) -> Column:
        return F.when(F.col(f"{prefix}.{part}").isNotNull(), rule)

    def field(make, name: str, *args) -> Column:
        return inside(name.split(".")[0], make(f"{prefix}.{name}", *args, CONFIG_MESSAGES[name]))

    def whole(part: str) -> Column:
        return required_struct(f"{prefix}.{part}", CONFIG_MESSAGES[part])

    return [whole("project"), field(required_string, "project.name"), field(non_empty_array, "project.languages"),
            field(required_string, "project.rootDir"), field(required_string, "project.srcDir"),
            whole("obsidian"), field(one_of, "obsidian.strategy", STRATEGIES),
            whole("sync"), field(one_of, "sync.mode", SYNC_MODES)]


# --------------------------------------------------------------------------- P12

def resolve_defaults(value: Column, defaults: Column, dtype: T.DataType) -> Column:
    """Leaf-wise merge of a struct with a defaults struct of the same type:
    nested structs merge recursively, any other set value (arrays included)
    replaces the default. A null leaf counts as unset."""
    if isinstance(dtype, T.StructType):
        fields = [resolve_defaults(value.getField(f.name), defaults.getField(f.name), f.dataType).alias(f.name)
                  for f in dtype.fields]
        return F.when(value.isNull(), defaults).otherwise(F.struct(*fields))
    return F.coalesce(value, defaults)


def with_defaults(df: DataFrame, col: str, defaults: dict, dtype: T.StructType) -> DataFrame:
    """Replaces struct column ``col`` by its merge with literal ``defaults``."""
    lit = _literal(defaults, dtype)
    return df.withColumn(col, resolve_defaults(F.col(col), lit, dtype))


def _literal(value, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        value = value or {}
        return F.struct(*[_literal(value.get(f.name), f.dataType).alias(f.name) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return F.array(*[F.lit(v) for v in (value or [])]).cast(dtype)
    return F.lit(value).cast(dtype)


def merge_defaults(value: Column, defaults) -> Column:
    """Layered defaults for a VARIANT of any shape: objects are merged field
    by field, whatever fields they have; everything else that is set replaces
    the default, arrays and an explicit null included. Only an absent field
    (SQL NULL, unlike a JSON null) takes the default. ``defaults`` is a
    literal; the recursion follows its objects, and fields it does not name
    pass through whole."""
    given = F.parse_json(F.lit(json.dumps(defaults)))
    if not isinstance(defaults, dict):
        return F.coalesce(value, given)
    fields = F.try_variant_get(value, "$", "map<string,variant>")  # null unless it is an object
    if not defaults:
        return F.coalesce(value, given)
    named = [F.lit(k) for k in defaults]
    rest = F.map_filter(fields, lambda k, _: ~k.isin(*defaults))
    merged = F.map_from_arrays(F.array(*named), F.array(*[merge_defaults(fields[k], d) for k, d in defaults.items()]))
    return (F.when(value.isNull(), given).when(fields.isNull(), value)
            .otherwise(F.to_variant_object(F.map_concat(rest, merged))))


# --------------------------------------------------------------------------- A6 A7 A8 A14

def count_by(df: DataFrame, name: str, cond: Column | None = None, group: Sequence[str] = ("project",)) -> DataFrame:
    """(project, <name>) with the number of rows (matching ``cond``)."""
    c = F.count(F.lit(1)) if cond is None else F.count(F.when(cond, 1))
    return df.groupBy(*group).agg(c.alias(name))


def status_rollup(projects: DataFrame, parts: Sequence[DataFrame], count_cols: Sequence[str]) -> DataFrame:
    """Left-join per-project aggregates onto the project list; missing counts
    become 0."""
    out = projects.select("project").distinct()
    for p in parts:
        out = out.join(p, "project", "left")
    for c in count_cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    return out


def iso_utc(ts: str) -> Column:
    """A timestamp as ISO text in UTC, whatever the session's time zone."""
    millis = F.unix_millis(F.col(ts))
    utc = F.timestamp_add("MILLISECOND", millis, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def last_sync(state: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Per project: configured ref/time when set, else the latest entry time;
    '(never)' when nothing is known."""
    s = state.groupBy("project").agg(F.max("last_synced_at").alias("_max_at"))
    if configs is not None:
        s = configs.select("project", F.col("last_ref").alias("_cfg_ref"), F.col("last_at").alias("_cfg_at")) \
            .join(s, "project", "full_outer")
    else:
        s = s.withColumn("_cfg_ref", F.lit(None).cast("string")).withColumn("_cfg_at", F.lit(None).cast("string"))
    at = F.coalesce(F.nullif(F.col("_cfg_at"), F.lit("")),
                    iso_utc("_max_at"), F.lit("(never)"))
    ref = F.coalesce(F.nullif(F.col("_cfg_ref"), F.lit("")), F.lit("(never)"))
    return s.select("project", ref.alias("last_ref"), at.alias("last_at"))


# --------------------------------------------------------------------------- A9

def check_rows(df: DataFrame, check: str, level: Column, detail: Column | None = None) -> DataFrame:
    """(project, check, level, detail) rows of one check."""
    return df.select("project", F.lit(check).alias("check"), level.alias("level"),
                     (detail if detail is not None else F.lit("")).alias("detail"))


def check_tally(checks: DataFrame) -> DataFrame:
    """Counts of passed / warning / failed checks per project."""
    return (checks.groupBy("project")
            .agg(F.count(F.when(F.col("level") == "pass", 1)).alias("passed"),
                 F.count(F.when(F.col("level") == "warn", 1)).alias("warnings"),
                 F.count(F.when(F.col("level") == "fail", 1)).alias("failures")))


def project_checks(facts: DataFrame) -> DataFrame:
    """(project, check, level, detail): the checks of a project's data, from
    one row of facts per project - ``config_issues`` (array of messages),
    ``has_index``, ``n_specs``, ``n_notes``, ``n_tracked``, ``n_stale`` (null
    where there is no such folder or state) and ``has_context``. One narrow
    projection; the checks of a project never meet in a shuffle."""
    def row(check: str, cond: Column, good: Column, level: str, bad: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), F.when(cond, "pass").otherwise(level).alias("level"),
                        F.when(cond, good).otherwise(bad).alias("detail"))

    n = F.size("config_issues")
    no_state = F.col("n_tracked").isNull()
    return facts.select("project", F.explode(F.array(
        row("config", n == 0, F.lit("config valid"), "fail", F.concat(F.lit("config invalid: "), F.array_join("config_issues", "; "))),
        row("index", F.col("has_index"), F.lit("index found"), "warn", F.lit("index not found")),
        row("specs", F.col("n_specs").isNotNull(), F.format_string("spec folder exists (%d specs)", "n_specs"), "warn", F.lit("spec folder not found")),
        row("notes", F.col("n_notes").isNotNull(), F.format_string("vault found (%d notes)", "n_notes"), "warn", F.lit("vault not found")),
        row("state", ~no_state, F.format_string("sync state present (%d files tracked)", "n_tracked"), "warn", F.lit("sync state not found")),
        row("state_consistent", ~no_state & (F.coalesce("n_stale", F.lit(0)) == 0), F.lit("sync state consistent"), "warn",
            F.when(no_state, "consistency check skipped (no sync state)").otherwise(F.format_string("%d stale sync entries", F.coalesce("n_stale", F.lit(0))))),
        row("context", F.col("has_context"), F.lit("context file present"), "warn", F.lit("context file not found")))).alias("c")
    ).select("project", "c.check", "c.level", "c.detail")


# --------------------------------------------------------------------------- A14 S4

def notes_by_kind(files: DataFrame, kinds: Sequence[str] = tuple(NOTE_KINDS), path_col: str = "path") -> DataFrame:
    """(project, kind, n_notes): ``.md`` files directly in the folder of a
    kind, and under kind '' those at the vault's root. Neither is recursive;
    other folders (templates) do not count."""
    parts = F.split(path_col, "/")
    kind = F.when(F.size(parts) == 1, "").when((F.size(parts) == 2) & F.element_at(parts, 1).isin(list(kinds)), F.element_at(parts, 1))
    return (files.where(F.col(path_col).endswith(".md")).withColumn("kind", kind).where(F.col("kind").isNotNull())
            .groupBy("project", "kind").agg(F.count(F.lit(1)).alias("n_notes")))


def note_listing(files: DataFrame, path_col: str = "path") -> DataFrame:
    """S4: (project, folder, position, name): the ``.md`` files of every
    folder without their extension, in locale order."""
    md = files.where(F.col(path_col).endswith(".md")).select(
        "project", F.regexp_replace(path_col, "/?[^/]*$", "").alias("folder"),
        F.regexp_replace(F.element_at(F.split(path_col, "/"), -1), r"\.md$", "").alias("name"))
    return with_positions(md, [by_locale("name"), "name"], ["project", "folder"])
