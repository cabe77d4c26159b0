"""Conformance checks: documented vs actual items, rule severities, removed
exports, broken links, copied blocks, line rules, size limits, checklists,
archive index and the overall verdict.

Line-level checks split texts into lines with ``posexplode`` (a narrow
operation: no shuffle). Repeated blocks and lines are found by their digests;
no text is shuffled for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .ordered import with_positions

# Architecture rule severities, review severities and the
# action each severity implies.
RULE_SEVERITY = {
    "cycle": "BLOCK",
    "forbidden_boundary": "BLOCK",
    "removed_export": "BLOCK",
    "god_module": "WARN",
    "deep_file": "WARN",
    "boundary_crossing": "WARN",
    "orphan": "INFO",
    "module_without_spec": "INFO",
}
SEVERITY_RANK = {"INFO": 1, "WARN": 2, "BLOCK": 3}
REVIEW_ACTION = {"CRITICAL": "BLOCK", "HIGH": "WARN", "MEDIUM": "INFO", "LOW": "NOTE"}

# Line rules of the code review: name -> (regex, review severity).
LINE_RULES = {
    "hardcoded_secret": (r"(?i)\b(password|passwd|secret|api[_-]?key|token|access[_-]?key)\s*[:=]\s*[\"'][^\"']{8,}[\"']",
                         "CRITICAL"),
    "sql_concatenation": (r"(?i)\b(select|insert|update|delete)\b[^\n]*[\"']\s*\+\s*\w", "CRITICAL"),
    "mutation_call": (r"\.(push|pop|splice|sort|reverse|shift|unshift)\(", "HIGH"),
}
MAX_FILE_LINES = 800
COPY_BLOCK_LINES = 6     # more than 5 identical consecutive lines
REPEAT_PLACES = 3        # the same line in 3 or more places
CHECKLIST = r"^\s*- \[( |x|X)\]"
WIKI_LINK = r"\[\[([^\]|]+)"


def _map(d: dict):
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


# --------------------------------------------------------------------------- C1

def documented_vs_actual(documented: DataFrame, actual: DataFrame,
                         keys: Sequence[str] = ("project", "module", "kind", "name")) -> DataFrame:
    """GAP (documented only), DRIFT (actual only), MATCH (both)."""
    keys = list(keys)
    d = documented.select(*keys).distinct().withColumn("_d", F.lit(True))
    a = actual.select(*keys).distinct().withColumn("_a", F.lit(True))
    j = d.join(a, keys, "full_outer")
    return j.select(*keys, F.when(F.col("_a").isNull(), "GAP").when(F.col("_d").isNull(), "DRIFT")
                    .otherwise("MATCH").alias("status"))


# --------------------------------------------------------------------------- C2 C10

def with_severity(issues: DataFrame, rule_col: str = "rule") -> DataFrame:
    """Adds ``severity`` from the fixed rule -> severity table (a literal map,
    so no join at all)."""
    return issues.withColumn("severity", F.coalesce(_map(RULE_SEVERITY)[F.col(rule_col)], F.lit("INFO")))


def new_findings(current: DataFrame, previous: DataFrame, keys: Sequence[str] = ("project", "rule", "subject")) -> DataFrame:
    """Findings of this run that the previous run did not have."""
    return current.join(previous.select(*keys).distinct(), list(keys), "left_anti")


def verdict(findings: DataFrame, projects: DataFrame, severity_col: str = "severity") -> DataFrame:
    """Per project: counts per severity and PASS unless a BLOCK finding exists."""
    rank = _map(SEVERITY_RANK)[F.col(severity_col)]
    per = findings.groupBy("project").agg(
        F.max(rank).alias("_r"),
        *[F.count(F.when(F.col(severity_col) == s, 1)).alias(f"n_{s.lower()}") for s in SEVERITY_RANK])
    j = projects.select("project").distinct().join(per, "project", "left")
    return j.select("project", *[F.coalesce(f"n_{s.lower()}", F.lit(0)).alias(f"n_{s.lower()}") for s in SEVERITY_RANK],
                    F.when(F.coalesce("_r", F.lit(0)) >= SEVERITY_RANK["BLOCK"], "FAIL").otherwise("PASS")
                    .alias("verdict"))


def forbidden_crossings(core: DataFrame, zone_of: DataFrame, zone_col: str = "zone") -> DataFrame:
    """Cross-boundary dependencies whose two boundaries lie in different
    zones (``zone_of(boundary, zone)``): (project, route, source_boundary,
    target_boundary, rule='forbidden_boundary', severity). Two equi joins to
    the zone table, no pairing of boundaries."""
    z = zone_of.select("boundary", F.col(zone_col).alias("_z"))
    j = (core.join(z.withColumnRenamed("boundary", "source_boundary").withColumnRenamed("_z", "_sz"), "source_boundary")
         .join(z.withColumnRenamed("boundary", "module").withColumnRenamed("_z", "_tz"), "module"))
    return (j.where(F.col("_sz") != F.col("_tz"))
            .select("project", "route", "source_boundary", F.col("module").alias("target_boundary"),
                    F.lit("forbidden_boundary").alias("rule"),
                    F.lit(RULE_SEVERITY["forbidden_boundary"]).alias("severity")))


# --------------------------------------------------------------------------- C3

def removed_without_deprecation(old: DataFrame, new: DataFrame, deprecated: DataFrame,
                                keys: Sequence[str] = ("project", "module", "export")) -> DataFrame:
    """Exports present before and gone now, minus the deprecated ones."""
    keys = list(keys)
    gone = old.select(*keys).distinct().join(new.select(*keys).distinct(), keys, "left_anti")
    return gone.join(deprecated.select(*keys).distinct(), keys, "left_anti")


# --------------------------------------------------------------------------- C4

def extract_links(notes: DataFrame, text_col: str = "text", pattern: str = WIKI_LINK,
                  keys: Sequence[str] = ("project", "name")) -> DataFrame:
    """(keys..., target) for every link target in the text (distinct)."""
    return (notes.select(*keys, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 1)).alias("target"))
            .distinct())


def broken_links(links: DataFrame, notes: DataFrame, group: Sequence[str] = ("project",),
                 note_col: str = "name") -> DataFrame:
    """Links whose target is not the name of any note (anti join)."""
    n = notes.select(*group, F.col(note_col).alias("target")).distinct()
    return links.join(n, list(group) + ["target"], "left_anti")


def modules_without_note(modules: DataFrame, notes: DataFrame, group: Sequence[str] = ("project",),
                         module_col: str = "name", note_col: str = "name") -> DataFrame:
    """Modules that have no note of the same name: (group..., subject,
    rule='module_without_spec', severity)."""
    n = notes.select(*group, F.col(note_col).alias("_m")).distinct()
    m = modules.select(*group, F.col(module_col).alias("_m")).distinct()
    return (m.join(n, list(group) + ["_m"], "left_anti")
            .select(*group, F.col("_m").alias("subject"), F.lit("module_without_spec").alias("rule"),
                    F.lit(RULE_SEVERITY["module_without_spec"]).alias("severity")))


# --------------------------------------------------------------------------- lines, C5 C6 C7 C8

def text_lines(docs: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """(keys..., line_no 1-based, line) for every line of every text."""
    return docs.select(*keys, F.posexplode(F.split(F.col(text_col), "\n")).alias("_pos", "line")) \
        .select(*keys, (F.col("_pos") + 1).alias("line_no"), "line")


def copied_blocks(docs: DataFrame, keys: Sequence[str], text_col: str = "text", size: int = COPY_BLOCK_LINES,
                  min_docs: int = 2) -> DataFrame:
    """Blocks of ``size`` consecutive identical lines found in at least
    ``min_docs`` texts: (block_hash sha-256 hex, n_docs, n_places).

    Blocks are cut from each text's line array and digested in the scan; only
    digests leave it. Places are summed per (digest, text) first, so a block
    that a third of all texts hold is a short sum per task, and texts are read
    once."""
    lines = F.split(F.col(text_col), "\n")
    block = F.transform(F.sequence(F.lit(1), F.size("_l") - size + 1),
                        lambda i: F.sha2(F.array_join(F.slice("_l", i, size), "\n"), 256))
    blocks = (docs.select(*keys, lines.alias("_l")).where(F.size("_l") >= size)
              .select(*keys, F.explode(block).alias("block_hash")))
    return _in_several(blocks, list(keys), "block_hash", min_docs)


def copied_ranges(docs: DataFrame, key: str, text_col: str = "text", size: int = COPY_BLOCK_LINES) -> DataFrame:
    """Which lines of a text are which lines of another: (key, representative,
    first_line, last_line, first_line_there), lines from 1.

    A block of ``size`` lines that several texts hold is represented by its
    first place, the smallest text and line. Every other text's places of the
    block meet that one place only, so a block that a third of all texts hold
    gives one row for each of them and no pairs. Places whose line and whose
    representative's line advance together lie on one diagonal (the same
    difference of lines); neighbours on it are put together into the longest
    possible ranges."""
    block = F.transform(F.sequence(F.lit(1), F.size("_l") - size + 1), lambda i: F.struct(
        i.cast("long").alias("line"), F.unhex(F.sha2(F.array_join(F.slice("_l", i, size), "\n"), 256)).alias("digest")))
    blocks = (docs.select(F.col(key).alias("k"), F.split(F.col(text_col), "\n").alias("_l")).where(F.size("_l") >= size)
              .select("k", F.explode(block).alias("b")).select("k", "b.line", "b.digest"))
    blocks = written(blocks, "blocks")
    first = (blocks.groupBy("digest").agg(F.min(F.struct("k", "line")).alias("rep"), F.max("k").alias("_most"))
             .where(F.col("rep.k") != F.col("_most")).select("digest", "rep"))
    places = (blocks.join(first, "digest").where(F.col("k") != F.col("rep.k"))
              .select("k", F.col("rep.k").alias("representative"), "line", (F.col("line") - F.col("rep.line")).alias("diagonal")))
    along = Window.partitionBy("k", "representative", "diagonal").orderBy("line")
    island = (F.col("line") - F.row_number().over(along)).alias("island")
    return (places.select("*", island).groupBy("k", "representative", "diagonal", "island")
            .agg(F.min("line").alias("first_line"), (F.max("line") + size - 1).alias("last_line"))
            .select(F.col("k").alias(key), "representative", "first_line", "last_line",
                    (F.col("first_line") - F.col("diagonal")).alias("first_line_there")))


def _in_several(rows: DataFrame, keys: list[str], digest: str, min_docs: int) -> DataFrame:
    """(digest, n_docs, n_places) of the digests found in enough texts."""
    per_text = rows.groupBy(digest, *keys).agg(F.count(F.lit(1)).alias("_n"))
    return (per_text.groupBy(digest).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("_n").alias("n_places"))
            .where(F.col("n_docs") >= min_docs))


def repeated_lines(lines: DataFrame, keys: Sequence[str], min_docs: int = REPEAT_PLACES) -> DataFrame:
    """Non-blank lines present in at least ``min_docs`` texts: (line_hash,
    n_docs, n_places), in one pass over the lines' digests."""
    digests = lines.where(F.trim("line") != "").select(*keys, F.sha2("line", 256).alias("line_hash"))
    return _in_several(digests, list(keys), "line_hash", min_docs)


def line_findings(lines: DataFrame, keys: Sequence[str], rules: dict | None = None) -> DataFrame:
    """(keys..., line_no, rule, severity, action) for every line matching a
    rule. One combined regex filters lines first; the rules are literal
    column expressions, so the check is a narrow projection (no join)."""
    rules = rules or LINE_RULES
    keys = list(keys)
    combined = "|".join(f"(?:{p})" for p, _ in rules.values())
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(name)) for name, (p, _) in rules.items()]))
    sev = _map({name: s for name, (_, s) in rules.items()})
    out = (lines.where(F.col("line").rlike(combined))
           .select(*keys, "line_no", F.explode(hits).alias("rule")))
    return out.withColumn("severity", sev[F.col("rule")]).withColumn("action", _map(REVIEW_ACTION)[F.col("severity")])


def long_texts(docs: DataFrame, keys: Sequence[str], text_col: str = "text",
               max_lines: int = MAX_FILE_LINES) -> DataFrame:
    """Texts with more than ``max_lines`` lines: (keys..., n_lines)."""
    return (docs.select(*keys, F.size(F.split(F.col(text_col), "\n")).alias("n_lines"))
            .where(F.col("n_lines") > max_lines))


def checklist_completion(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per text: number of checklist items, checked items, complete flag."""
    items = lines.where(F.col("line").rlike(CHECKLIST)).withColumn(
        "_done", F.lower(F.regexp_extract("line", CHECKLIST, 1)) == "x")
    return (items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tasks"),
                                    F.count(F.when(F.col("_done"), 1)).alias("n_done"))
            .withColumn("complete", F.col("n_tasks") == F.col("n_done")))


def task_completion(tasks: DataFrame, group: Sequence[str], done_col: str) -> DataFrame:
    """Per group: tasks, done tasks and whether all are done."""
    return (tasks.groupBy(*group).agg(F.count(F.lit(1)).alias("n_tasks"),
                                     F.count(F.when(F.col(done_col), 1)).alias("n_done"),
                                     F.bool_and(done_col).alias("complete")))


# --------------------------------------------------------------------------- C9

def month_index(items: DataFrame, ts_col: str, name_col: str, group: Sequence[str] = ()) -> DataFrame:
    """Archive index by month: (group..., month 'yyyy-MM', n_items, first, last).
    Names stay a table; only the bounds of each month are kept here."""
    return (items.groupBy(*group, F.date_format(ts_col, "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("n_items"), F.min(name_col).alias("first_item"),
                 F.max(name_col).alias("last_item")))


def month_members(items: DataFrame, ts_col: str, name_col: str, group: Sequence[str] = ()) -> DataFrame:
    """The index's entries as rows: (group..., month, position, name), the
    oldest first, names in code-unit order within one time."""
    rows = items.select(*group, F.date_format(ts_col, "yyyy-MM").alias("month"), F.col(ts_col).alias("_ts"), F.col(name_col).alias("name"))
    return with_positions(rows, ["_ts", "name"], [*group, "month"]).drop("_ts")
