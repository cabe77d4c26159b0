"""Queries on customers as projects: status, checks, notes, checklists, line
rules and the archive index.

Derived inputs, all from whole tables:

* module files (``inputs.module_files``): those in ``lib`` are specs, those in
  ``app`` schemas, those in ``src`` the index; orders that are open are active
  changes, all others tracked entries, synced on their day;
* configs: a customer's market segment is the vault strategy (two segments
  name none), its balance decides which of the configured ref and time are set
  and whether the sync mode is one of the known;
* notes: every document is a note; its id decides the folder, whether it lies
  deeper and whether it is Markdown;
* code lines: one per line of an order, whose attributes decide what it does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conform as C
from ..operators import inventory as INV
from ..operators import quality as Q
from ..operators import snapshot as snap
from ..session import written
from . import inputs as I
from .catalog import BEFORE, query

SEGMENTS = {"FURNITURE": "embedded", "MACHINERY": "standalone", "BUILDING": "hybrid", "AUTOMOBILE": "other"}
SYNCED = "2024-06-01T12:00:00.000Z"

SQL_PROJECTS = I.SQL_EDGES + "," + I.SQL_MODULES + "," + I.SQL_FILES + "," + I.SQL_PAGE_FILES + "," + I.SQL_SIZED_FILES + f""",
projects AS (SELECT 'customer-' || CAST(c_custkey AS VARCHAR) AS project, * FROM customer),
cust_orders AS (SELECT 'customer-' || CAST(o_custkey AS VARCHAR) AS project, * FROM orders),
n_files AS (SELECT project, count(*) FILTER (WHERE file LIKE 'lib/%') AS n_specs, count(*) FILTER (WHERE file LIKE 'app/%') AS n_schemas
            FROM module_files GROUP BY project),
n_orders AS (SELECT project, count(*) FILTER (WHERE o_orderstatus = 'O') AS active_changes,
                    count(*) FILTER (WHERE o_orderstatus <> 'O') AS tracked_files,
                    max(o_orderdate) FILTER (WHERE o_orderstatus <> 'O') AS latest FROM cust_orders GROUP BY project),
n_size AS (SELECT project, CAST(sum(size) AS BIGINT) AS index_size FROM sized_files WHERE starts_with(path, 'src/') GROUP BY project)
"""


def _project(key: str):
    return F.concat(F.lit("customer-"), F.col(key).cast("string")).alias("project")


def _customers(spark, sf):
    return I.table(spark, sf, "customer").select(_project("c_custkey"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _files(spark, sf):
    return I.module_files(spark, sf).withColumnRenamed("file", "path")


def _entries(spark, sf):
    """State entries (project, key, last_synced_at): orders that are not open."""
    o = I.table(spark, sf, "orders").where("o_orderstatus <> 'O'")
    return o.select(_project("o_custkey"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderdate").cast("timestamp").alias("last_synced_at"))


@query("project_status", "WITH " + SQL_PROJECTS + f"""
SELECT p.project, coalesce(f.n_specs, 0) AS n_specs, coalesce(f.n_schemas, 0) AS n_schemas,
       coalesce(o.active_changes, 0) AS active_changes, coalesce(o.tracked_files, 0) AS tracked_files,
       coalesce(s.index_size, 0) AS index_size,
       CASE WHEN p.c_acctbal >= 5000 THEN p.c_mktsegment ELSE '(never)' END AS last_ref,
       CASE WHEN p.c_acctbal >= 8000 THEN '{SYNCED}' WHEN o.latest IS NULL THEN '(never)'
            ELSE strftime(o.latest, '%Y-%m-%dT%H:%M:%S.000Z') END AS last_at
FROM projects p LEFT JOIN n_files f ON f.project = p.project LEFT JOIN n_orders o ON o.project = p.project
LEFT JOIN n_size s ON s.project = p.project""")
def project_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status of every project: specs, schemas, active changes, tracked
    files, index size below its path, configured or latest sync."""
    c, files = _customers(spark, sf), _files(spark, sf)
    configs = c.select("project", F.when(F.col("c_acctbal") >= 5000, F.col("c_mktsegment")).otherwise("").alias("last_ref"),
                       F.when(F.col("c_acctbal") >= 8000, SYNCED).otherwise("").alias("last_at"))
    entries = _entries(spark, sf)
    orders = I.table(spark, sf, "orders").select(_project("o_custkey"), "o_orderstatus")
    counts = files.groupBy("project").agg(F.count(F.when(F.col("path").startswith("lib/"), 1)).alias("n_specs"),
                                          F.count(F.when(F.col("path").startswith("app/"), 1)).alias("n_schemas"))
    parts = [counts, Q.count_by(orders, "active_changes", F.col("o_orderstatus") == "O"), Q.count_by(entries, "tracked_files"),
             INV.size_below(I.sized_files(spark, sf), "src").select("project", F.col("n_bytes").alias("index_size")),
             Q.last_sync(entries, configs)]
    names = ["n_specs", "n_schemas", "active_changes", "tracked_files", "index_size"]
    return Q.status_rollup(c, parts, names).select("project", *names, "last_ref", "last_at")


SQL_CONFIG = """
cfg AS (
  SELECT project, list_filter([
    CASE WHEN c_name = '' THEN 'project.name is required and must be a non-empty string' END,
    CASE WHEN c_nationkey = 0 THEN 'project.languages must be a non-empty array' END,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'obsidian is required' END,
    CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'obsidian.strategy must be one of: embedded, standalone, hybrid' END,
    CASE WHEN c_acctbal < -500 THEN 'sync is required' WHEN c_acctbal < 0 THEN 'sync.mode must be one of: manual, git-hook, watch' END],
    lambda x: x IS NOT NULL) AS issues FROM projects)
"""


def _config_issues(spark, sf):
    strategy = F.create_map(*[F.lit(x) for kv in SEGMENTS.items() for x in kv])[F.col("c_mktsegment")]
    langs = F.when(F.col("c_nationkey") == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("typescript")))
    cfg = F.struct(
        F.struct(F.col("c_name").alias("name"), langs.alias("languages"), F.lit(".").alias("rootDir"), F.lit("src").alias("srcDir")).alias("project"),
        F.when(strategy.isNotNull(), F.struct(strategy.alias("strategy"))).alias("obsidian"),
        F.when(F.col("c_acctbal") >= -500, F.struct(F.when(F.col("c_acctbal") < 0, "never").otherwise("watch").alias("mode"))).alias("sync"))
    return Q.validate_rows(_customers(spark, sf).select("project", cfg.alias("cfg")), Q.config_rules()).select("project", "issues")


@query("config_issues", "WITH projects AS (SELECT 'customer-' || CAST(c_custkey AS VARCHAR) AS project, * FROM customer)," + SQL_CONFIG + """
SELECT project, unnest(issues) AS issue FROM cfg""")
def config_issues(spark: SparkSession, sf: str) -> DataFrame:
    return _config_issues(spark, sf).select("project", F.explode("issues").alias("issue"))


SQL_CHECKS = SQL_PROJECTS + "," + SQL_CONFIG + f""",
known AS (SELECT DISTINCT 'customer-' || CAST(o.o_custkey AS VARCHAR) AS project, l.l_suppkey AS name
          FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderdate < DATE '{BEFORE}'),
stale AS (SELECT m.project, count(*) AS n_tracked, count(*) FILTER (WHERE k.name IS NULL) AS n_stale
          FROM modules m LEFT JOIN known k ON k.project = m.project AND k.name = m.name GROUP BY m.project),
folders AS (SELECT project, count(*) FILTER (WHERE file LIKE 'lib/%') AS n_specs, count(*) FILTER (WHERE file LIKE 'app/%') AS n_notes,
                   bool_or(file LIKE 'src/%.go') AS has_index, bool_or(ends_with(file, '/part-6.ts')) AS has_context
            FROM module_files GROUP BY project),
facts AS (
  SELECT p.project, c.issues, coalesce(f.has_index, false) AS has_index, nullif(f.n_specs, 0) AS n_specs, nullif(f.n_notes, 0) AS n_notes,
         s.n_tracked, s.n_stale, coalesce(f.has_context, false) AS has_context
  FROM projects p JOIN cfg c ON c.project = p.project LEFT JOIN folders f ON f.project = p.project LEFT JOIN stale s ON s.project = p.project),
checks AS (
  SELECT project, 'config' AS "check", CASE WHEN len(issues) = 0 THEN 'pass' ELSE 'fail' END AS level,
         CASE WHEN len(issues) = 0 THEN 'config valid' ELSE 'config invalid: ' || array_to_string(issues, '; ') END AS detail FROM facts
  UNION ALL SELECT project, 'index', CASE WHEN has_index THEN 'pass' ELSE 'warn' END,
         CASE WHEN has_index THEN 'index found' ELSE 'index not found' END FROM facts
  UNION ALL SELECT project, 'specs', CASE WHEN n_specs IS NOT NULL THEN 'pass' ELSE 'warn' END,
         coalesce('spec folder exists (' || n_specs || ' specs)', 'spec folder not found') FROM facts
  UNION ALL SELECT project, 'notes', CASE WHEN n_notes IS NOT NULL THEN 'pass' ELSE 'warn' END,
         coalesce('vault found (' || n_notes || ' notes)', 'vault not found') FROM facts
  UNION ALL SELECT project, 'state', CASE WHEN n_tracked IS NOT NULL THEN 'pass' ELSE 'warn' END,
         coalesce('sync state present (' || n_tracked || ' files tracked)', 'sync state not found') FROM facts
  UNION ALL SELECT project, 'state_consistent', CASE WHEN n_stale = 0 THEN 'pass' ELSE 'warn' END,
         CASE WHEN n_tracked IS NULL THEN 'consistency check skipped (no sync state)' WHEN n_stale = 0 THEN 'sync state consistent'
              ELSE n_stale || ' stale sync entries' END FROM facts
  UNION ALL SELECT project, 'context', CASE WHEN has_context THEN 'pass' ELSE 'warn' END,
         CASE WHEN has_context THEN 'context file present' ELSE 'context file not found' END FROM facts)
"""


def _names(spark, sf):
    """(project, name) of the modules now, and of those before the day: from
    one pass over the lines, in partitions whose size does not grow."""
    n = I.pieces(spark, sf, "lineitem", "orders")
    now = written(I.dated_names(spark, sf, BEFORE), "names")
    return [m.select("project", "name").repartition(n, "project", "name") for m in (now, now.where("early"))]


def _checks(spark, sf):
    modules, noted = _names(spark, sf)
    modules = modules.withColumnRenamed("name", "key")
    stale = snap.stale_entries(modules, noted, present_key="name")
    files = _files(spark, sf).groupBy("project").agg(
        F.nullif(F.count(F.when(F.col("path").startswith("lib/"), 1)), F.lit(0)).alias("n_specs"),
        F.nullif(F.count(F.when(F.col("path").startswith("app/"), 1)), F.lit(0)).alias("n_notes"),
        F.bool_or(F.col("path").like("src/%.go")).alias("has_index"), F.bool_or(F.col("path").endswith("/part-6.ts")).alias("has_context"))
    facts = (_config_issues(spark, sf).withColumnRenamed("issues", "config_issues").join(files, "project", "left")
             .join(Q.count_by(modules, "n_tracked"), "project", "left").join(Q.count_by(stale, "n_stale"), "project", "left"))
    return Q.project_checks(facts.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_index", "has_context")}))


@query("project_checks", "WITH " + SQL_CHECKS + ' SELECT project, "check", level, detail FROM checks')
def project_checks(spark: SparkSession, sf: str) -> DataFrame:
    return _checks(spark, sf)


@query("project_check_tally", "WITH " + SQL_CHECKS + """
SELECT project, count(*) FILTER (WHERE level = 'pass') AS passed, count(*) FILTER (WHERE level = 'warn') AS warnings,
       count(*) FILTER (WHERE level = 'fail') AS failures FROM checks GROUP BY project""")
def project_check_tally(spark: SparkSession, sf: str) -> DataFrame:
    return Q.check_tally(_checks(spark, sf))


# --------------------------------------------------------------------------- A14 S4 C4

SQL_NOTES = """
notes AS (
  SELECT lang AS project,
         CASE WHEN doc_id % 7 < 5 THEN ['modules', 'apis', 'data', 'journal', 'decisions'][doc_id % 7 + 1] || '/'
              WHEN doc_id % 7 = 5 THEN '' ELSE 'templates/' END
         || CASE WHEN doc_id % 17 = 0 THEN 'old/' ELSE '' END
         || CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END || '-' || CAST(doc_id AS VARCHAR)
         || CASE WHEN doc_id % 13 = 0 THEN '.txt' ELSE '.md' END AS path FROM documents)
"""


def _notes(spark, sf):
    d, i = I.table(spark, sf, "documents"), F.col("doc_id") % 7
    kinds = F.array(*[F.lit(k) for k in Q.NOTE_KINDS])
    folder = F.when(i < 5, F.concat(F.get(kinds, i.cast("int")), F.lit("/"))).when(i == 5, "").otherwise("templates/")
    name = F.when(F.col("doc_id") % 3 == 0, F.upper("source")).otherwise(F.col("source"))
    return d.select(F.col("lang").alias("project"), F.concat(
        folder, F.when(F.col("doc_id") % 17 == 0, "old/").otherwise(""), name, F.lit("-"), F.col("doc_id").cast("string"),
        F.when(F.col("doc_id") % 13 == 0, ".txt").otherwise(".md")).alias("path"))


@query("notes_by_kind", "WITH " + SQL_NOTES + """
SELECT project, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS kind, count(*) AS n_notes FROM notes
WHERE path LIKE '%.md' AND len(string_split(path, '/')) <= 2 AND NOT starts_with(path, 'templates/') AND NOT starts_with(path, 'old/')
GROUP BY 1, 2""")
def notes_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return Q.notes_by_kind(_notes(spark, sf))


@query("note_listing", "WITH " + SQL_NOTES + """,
md AS (SELECT project, array_to_string(string_split(path, '/')[:-2], '/') AS folder, regexp_replace(string_split(path, '/')[-1], '\\.md$', '') AS name
       FROM notes WHERE path LIKE '%.md')
SELECT project, folder, name, row_number() OVER (PARTITION BY project, folder ORDER BY name COLLATE en_us, name) AS position FROM md""")
def note_listing(spark: SparkSession, sf: str) -> DataFrame:
    return Q.note_listing(_notes(spark, sf))


@query("modules_without_note", "WITH now AS (WITH " + I.SQL_EDGES + "," + I.SQL_MODULES + f""" SELECT project, name FROM modules),
noted AS (SELECT DISTINCT 'customer-' || CAST(o.o_custkey AS VARCHAR) AS project, l.l_suppkey AS name
          FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderdate < DATE '{BEFORE}')
SELECT n.project, n.name AS subject, 'module_without_spec' AS rule, 'INFO' AS severity FROM now n
WHERE NOT EXISTS (SELECT 1 FROM noted k WHERE k.project = n.project AND k.name = n.name)""")
def modules_without_note(spark: SparkSession, sf: str) -> DataFrame:
    """Modules that came after the last notes were written."""
    return C.modules_without_note(*_names(spark, sf))


# --------------------------------------------------------------------------- C6 C8 C9

def _code(spark, sf):
    """(l_orderkey, line_no, line): one line of code per line of an order."""
    li = I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    key = F.when(F.length(supp) >= 2, F.lpad(supp, 6, "0")).otherwise(supp)  # shorter ones make a key too short to count
    line = (F.when(F.col("l_returnflag") == "R", F.concat(F.lit("  parts.push(p"), part, F.lit(");")))
            .when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 25),
                  F.concat(F.lit('q = "SELECT * FROM lots WHERE part = " + p'), part))
            .when(F.col("l_linestatus") == "O", F.concat(F.lit('const API_KEY = "s-'), key, F.lit('"')))
            .otherwise(F.concat(F.lit("let n = "), part)))
    return li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line_no"), line.alias("line"))


@query("code_rules", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line_no, 'mutation_call' AS rule, 'HIGH' AS severity, 'WARN' AS action
FROM lineitem WHERE l_returnflag = 'R'
UNION ALL
SELECT l_orderkey, l_linenumber, 'sql_concatenation', 'CRITICAL', 'BLOCK' FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 25
UNION ALL  -- a key of at least eight characters: s- and six digits
SELECT l_orderkey, l_linenumber, 'hardcoded_secret', 'CRITICAL', 'BLOCK' FROM lineitem
WHERE l_linestatus = 'O' AND (l_returnflag = 'N' OR l_returnflag = 'A' AND l_quantity <= 25) AND length(CAST(l_suppkey AS VARCHAR)) >= 2""")
def code_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The review's line rules on code of which the attributes of the lines
    tell which rule must fire."""
    return C.line_findings(_code(spark, sf), ["l_orderkey"])


@query("checklists", """
WITH items AS (SELECT l_orderkey, l_linestatus = 'F' AS done FROM lineitem WHERE l_returnflag <> 'N')
SELECT l_orderkey, count(*) AS n_tasks, count(*) FILTER (WHERE done) AS n_done, bool_and(done) AS complete FROM items GROUP BY l_orderkey""")
def checklists(spark: SparkSession, sf: str) -> DataFrame:
    """Checklist lines of every order: a task for each line that is returned
    or accepted, checked when the line is final; other lines are prose."""
    li = I.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
    box = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_linenumber") % 2 == 0, "  - [x] ").otherwise("- [X] ")).otherwise("- [ ] ")
    line = F.concat(F.when(F.col("l_returnflag") == "N", "- part [x] ").otherwise(box), F.col("l_partkey").cast("string"))
    return C.checklist_completion(li.select("l_orderkey", line.alias("line")), ["l_orderkey"])


@query("month_members", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey AS name,
       row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate, o_orderkey) AS position FROM orders""")
def month_members(spark: SparkSession, sf: str) -> DataFrame:
    return C.month_members(I.table(spark, sf, "orders"), "o_orderdate", "o_orderkey")
