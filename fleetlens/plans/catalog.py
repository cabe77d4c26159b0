"""Query catalogue: every implemented operator as a query over the driver's
tables, each with its DuckDB SQL twin (the correctness oracle).

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``.
Every output column is aliased identically on both sides; lists are emitted
as sorted, joined strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize, written
from ..operators import conform as C
from ..operators import impact as imp
from ..operators import snapshot as snap
from ..operators.mentions import contains_join
from ..operators.runs import RunStore, approaching, compare_runs, files_digest
from . import inputs as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --------------------------------------------------------------------------- shared pieces

def _changes(spark, sf):
    # the change set feeds several branches (renames, symbols, specs): written once
    return materialize(snap.diff_snapshots(I.old_files(spark, sf), I.new_files(spark, sf)))


def _renamed(spark, sf):
    # the reconciled change set feeds symbols, specs and reports: written once
    return materialize(snap.pair_renames(_changes(spark, sf)))


def _symbols(spark, sf):
    return snap.symbols_from_changes(_renamed(spark, sf))


SQL_RENAMED = I.SQL_SNAPSHOTS + """,
rem AS (SELECT project, old_hash AS h, min(path) AS previous_path FROM changes
        WHERE status = 'removed' GROUP BY project, old_hash HAVING count(*) = 1),
addd AS (SELECT project, new_hash AS h, min(path) AS path FROM changes
         WHERE status = 'added' GROUP BY project, new_hash HAVING count(*) = 1),
pairs AS (SELECT r.project, a.path, r.previous_path, r.h FROM rem r JOIN addd a ON r.project = a.project AND r.h = a.h),
renamed AS (
  SELECT c.project, c.path, c.status, CAST(NULL AS VARCHAR) AS previous_path, c.old_hash, c.new_hash
  FROM changes c
  WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.project = c.project
                    AND ((c.status = 'added' AND p.path = c.path) OR (c.status = 'removed' AND p.previous_path = c.path)))
  UNION ALL
  SELECT project, path, 'renamed', previous_path, h, h FROM pairs),
symbols AS (
  SELECT project, path, status AS type, """ + I.SQL_MODULE + """ AS module, """ + I.SQL_SYMBOL + """ AS name
  FROM renamed)
"""


# --------------------------------------------------------------------------- J1 F1

@query("snapshot_diff", "WITH " + I.SQL_SNAPSHOTS + " SELECT project, path, status FROM changes")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return snap.diff_snapshots(I.old_files(spark, sf), I.new_files(spark, sf)).select("project", "path", "status")


@query("filtered_diff", "WITH " + I.SQL_SNAPSHOTS + """
SELECT project, path, status FROM changes WHERE contains(path, 'src/src1') OR contains(path, 'src/src2')""")
def filtered_diff(spark: SparkSession, sf: str) -> DataFrame:
    return (snap.diff_snapshots(I.old_files(spark, sf), I.new_files(spark, sf),
                                path_filter=["src/src1", "src/src2"])
            .select("project", "path", "status"))


# --------------------------------------------------------------------------- J13

@query("rename_pairs", "WITH " + SQL_RENAMED + " SELECT project, path, status, previous_path FROM renamed")
def rename_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _renamed(spark, sf).select("project", "path", "status", "previous_path")


# --------------------------------------------------------------------------- A2 P7

@query("change_classes", "WITH " + SQL_RENAMED + """
SELECT project, count(*) FILTER (WHERE type = 'added') AS n_added,
       count(*) FILTER (WHERE type = 'modified') AS n_modified,
       count(*) FILTER (WHERE type = 'removed') AS n_removed,
       count(*) FILTER (WHERE type = 'renamed') AS n_renamed
FROM symbols GROUP BY project""")
def change_classes(spark: SparkSession, sf: str) -> DataFrame:
    return imp.classify_changes(_symbols(spark, sf))


@query("symbol_changes", "WITH " + SQL_RENAMED + """
SELECT project, path, name, type, module, type || ' file ' || path AS summary,
       CASE WHEN length(name) > 0 AND substr(name, 1, 1) = upper(substr(name, 1, 1)) THEN 'high' ELSE 'low' END
         AS impact_level
FROM symbols""")
def symbol_changes(spark: SparkSession, sf: str) -> DataFrame:
    return imp.rate_symbols(_symbols(spark, sf)).select(
        "project", "path", "name", "type", "module", "summary", "impact_level")


# --------------------------------------------------------------------------- P8 A3 A4 per module

@query("impact_by_module", "WITH " + SQL_RENAMED + """
SELECT project, module, count(*) AS n_changes,
       CASE max(CASE WHEN length(name) > 0 AND substr(name, 1, 1) = upper(substr(name, 1, 1)) THEN 2 ELSE 0 END)
         WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS impact_level,
       min(name) AS first_symbol
FROM symbols WHERE module <> '' GROUP BY project, module""")
def impact_by_module(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import impact_level, level_from_rank, level_rank
    s = _symbols(spark, sf).where(F.col("module") != "")
    return (s.groupBy("project", "module")
            .agg(F.count(F.lit(1)).alias("n_changes"),
                 F.max(level_rank(impact_level("name", "affected_modules"))).alias("_r"),
                 F.min("name").alias("first_symbol"))
            .select("project", "module", "n_changes", level_from_rank("_r").alias("impact_level"),
                    "first_symbol"))


# --------------------------------------------------------------------------- J5 A4 R1

SQL_SPECS = SQL_RENAMED + """,
old_state AS (SELECT project, """ + I.SQL_MODULE + """ AS key FROM old_f GROUP BY 1, 2),
spec_docs AS (SELECT lang AS project, 'doc-' || CAST(doc_id AS VARCHAR) || '.md' AS name, text FROM documents),
mods AS (SELECT DISTINCT project, module FROM symbols),
specs AS (
  SELECT m.project, m.module, 'spec-' || m.module || '.md' AS spec
  FROM mods m JOIN old_state s ON s.project = m.project AND s.key = m.module
  UNION
  SELECT m.project, m.module, d.name AS spec
  FROM mods m JOIN spec_docs d ON d.project = m.project AND contains(lower(d.text), lower(m.module))
  WHERE d.name LIKE '%.md'),
report AS (
  SELECT s.project,
         CASE max(CASE WHEN length(s.name) > 0 AND substr(s.name, 1, 1) = upper(substr(s.name, 1, 1)) THEN 2 ELSE 0 END)
           WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS impact_level,
         count(*) AS n_changes,
         count(DISTINCT CASE WHEN s.module <> '' THEN s.module END) AS n_modules
  FROM symbols s GROUP BY s.project),
spec_agg AS (SELECT project, count(DISTINCT spec) AS n_specs FROM specs GROUP BY project),
full_report AS (
  SELECT r.project, r.impact_level, r.n_changes, r.n_modules, coalesce(a.n_specs, 0) AS n_specs,
         upper(substr(r.impact_level, 1, 1)) || substr(r.impact_level, 2) || ' impact: ' || r.n_changes
           || ' symbol change(s) across ' || r.n_modules || ' module(s). ' || coalesce(a.n_specs, 0)
           || ' spec(s) potentially affected.' AS summary
  FROM report r LEFT JOIN spec_agg a ON a.project = r.project)
"""


def _report_parts(spark, sf):
    sym = _symbols(spark, sf)
    old_state = I.module_state(I.old_files(spark, sf), I.T_OLD)
    specs = materialize(imp.map_documents(sym, docs=I.spec_docs(spark, sf), state=old_state))
    return sym, specs, imp.impact_report(sym, specs)


@query("impact_report", "WITH " + SQL_SPECS + " SELECT * FROM full_report")
def impact_report(spark: SparkSession, sf: str) -> DataFrame:
    return _report_parts(spark, sf)[2]


@query("impact_modules", "WITH " + SQL_RENAMED + " SELECT DISTINCT project, module FROM symbols WHERE module <> ''")
def impact_modules(spark: SparkSession, sf: str) -> DataFrame:
    return imp.impact_modules(_symbols(spark, sf))


@query("change_report", "WITH " + SQL_SPECS + """
SELECT project, 'summary' AS section, summary AS item FROM full_report
UNION ALL SELECT project, 'level', impact_level FROM full_report
UNION ALL SELECT DISTINCT project, 'modules', module FROM symbols WHERE module <> ''
UNION ALL SELECT project, 'modules', '(none)' FROM full_report WHERE n_modules = 0
UNION ALL SELECT project, 'changes', '- **' || name || '** (' || type || '): ' || type || ' file ' || path FROM symbols
UNION ALL SELECT project, 'changes', '(none)' FROM full_report WHERE n_changes = 0
UNION ALL SELECT DISTINCT project, 'specs', spec FROM specs
UNION ALL SELECT project, 'specs', '(none)' FROM full_report WHERE n_specs = 0""")
def change_report(spark: SparkSession, sf: str) -> DataFrame:
    sym, specs, report = _report_parts(spark, sf)
    return imp.change_report(report, sym, specs)


@query("change_lines", "WITH " + SQL_RENAMED + """
SELECT project, name, type, '- **' || name || '** (' || type || '): ' || type || ' file ' || path AS line
FROM symbols""")
def change_lines(spark: SparkSession, sf: str) -> DataFrame:
    return imp.change_lines(_symbols(spark, sf))


@query("document_mentions", """
SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))""")
def document_mentions(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    bench = I.table(spark, sf, "benchmark").select("item_id", "text")
    return contains_join(docs, bench, "text", "text", text_keys=["doc_id"], needle_keys=["item_id"])


@query("module_mentions", "WITH " + SQL_SPECS + " SELECT project, module, spec FROM specs")
def module_mentions(spark: SparkSession, sf: str) -> DataFrame:
    sym = _symbols(spark, sf)
    old_state = I.module_state(I.old_files(spark, sf), I.T_OLD)
    return imp.map_documents(sym, docs=I.spec_docs(spark, sf), state=old_state)


# --------------------------------------------------------------------------- J2 A11 J8

SQL_STATES = I.SQL_SNAPSHOTS + """,
old_state AS (SELECT project, """ + I.SQL_MODULE + """ AS key, max(content_hash) AS last_hash FROM old_f GROUP BY 1, 2),
new_state AS (SELECT project, """ + I.SQL_MODULE + """ AS key, max(content_hash) AS last_hash FROM new_f GROUP BY 1, 2)
"""


@query("state_diff", "WITH " + SQL_STATES + """
SELECT coalesce(o.project, n.project) AS project, coalesce(o.key, n.key) AS key,
       CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'modified' END AS status
FROM old_state o FULL OUTER JOIN new_state n ON o.project = n.project AND o.key = n.key
WHERE o.key IS NULL OR n.key IS NULL OR o.last_hash <> n.last_hash""")
def state_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = I.module_state(I.old_files(spark, sf), I.T_OLD)
    n = I.module_state(I.new_files(spark, sf), I.T_NEW)
    return snap.diff_state(o, n)


@query("state_upsert", "WITH " + SQL_RENAMED + """,
old_state AS (SELECT project, """ + I.SQL_MODULE + """ AS key, max(content_hash) AS last_hash FROM old_f GROUP BY 1, 2),
children AS (
  SELECT project, split_part(path, '/', 2) AS module, path AS source_path,
         regexp_replace(split_part(path, '/', 3), '^(.+)\\.[^.]*$', '\\1') AS stem,
         regexp_extract(split_part(path, '/', 3), '(\\.[^.]*)$', 1) AS ext
  FROM new_f WHERE split_part(path, '/', 1) = 'src' AND len(string_split(path, '/')) = 3),
cands AS (
  SELECT s.project, s.path, s.module, 0 AS rnk, f.path AS source_path
  FROM symbols s JOIN new_f f ON f.project = s.project AND f.path = 'src/' || s.module
  UNION ALL
  SELECT s.project, s.path, s.module, list_position(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs'], c.ext), c.source_path
  FROM symbols s JOIN children c ON c.project = s.project AND c.module = s.module AND c.stem = lower(s.name)
  WHERE c.ext IN ('.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs')
  UNION ALL
  SELECT s.project, s.path, s.module, 100, c.source_path
  FROM symbols s JOIN children c ON c.project = s.project AND c.module = s.module
   AND array_to_string(list_transform(regexp_split_to_array(c.stem, '[-_]'), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), '') = s.name
  WHERE c.ext IN ('.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs')),
best AS (SELECT project, path, module, arg_min(source_path, (rnk, source_path)) AS source_path
         FROM cands WHERE module <> '' GROUP BY project, path, module),
upd AS (SELECT b.project, b.module AS key, arg_max(f.content_hash, b.path) AS hash
        FROM best b JOIN new_f f ON f.project = b.project AND f.path = b.source_path GROUP BY b.project, b.module)
SELECT coalesce(o.project, u.project) AS project, coalesce(o.key, u.key) AS key,
       coalesce(u.hash, o.last_hash) AS last_hash,
       CASE WHEN u.hash IS NOT NULL THEN '""" + I.T_NEW + """' ELSE '""" + I.T_OLD + """' END AS last_synced_at,
       CASE WHEN o.key IS NULL THEN '' ELSE 'spec-' || o.key || '.md' END AS mapped_specs
FROM old_state o FULL OUTER JOIN upd u ON o.project = u.project AND o.key = u.key""")
def state_upsert(spark: SparkSession, sf: str) -> DataFrame:
    sym = _symbols(spark, sf)
    new = I.new_files(spark, sf)
    src = snap.infer_source_files(sym, new)
    upd = (src.join(new.select("project", F.col("path").alias("source_path"), "content_hash"),
                    ["project", "source_path"])
           .select("project", F.col("module").alias("key"), F.col("content_hash").alias("hash"),
                   F.col("path").alias("ordinal")))
    state = I.module_state(I.old_files(spark, sf), I.T_OLD)
    out = snap.upsert_state(state, upd, I.T_NEW)
    return out.select("project", "key", "last_hash",
                      F.date_format("last_synced_at", "yyyy-MM-dd HH:mm:ss").alias("last_synced_at"),
                      F.array_join(F.array_sort("mapped_specs"), ", ").alias("mapped_specs"))


@query("stale_state", "WITH " + I.SQL_SNAPSHOTS + """
SELECT o.project, o.path AS key FROM old_f o
WHERE NOT EXISTS (SELECT 1 FROM new_f n WHERE n.project = o.project AND n.path = o.path)""")
def stale_state(spark: SparkSession, sf: str) -> DataFrame:
    state = I.old_files(spark, sf).select("project", F.col("path").alias("key"))
    return snap.stale_entries(state, I.new_files(spark, sf), key="key", present_key="path")


# --------------------------------------------------------------------------- J6 F9 A12 S9

MARKER = "License"  # the driver's documents carry license lines; they play the generated marker


def _changed_specs(spark, sf):
    ch = _renamed(spark, sf).where(F.col("status") != "removed")
    return ch.select("project", F.concat(F.lit("doc-"), F.regexp_extract("path", r"-(\d+)\.ts$", 1),
                                         F.lit(".md")).alias("spec"))


SQL_CHANGED_SPECS = SQL_RENAMED + """,
spec_docs AS (SELECT lang AS project, 'doc-' || CAST(doc_id AS VARCHAR) || '.md' AS name, text FROM documents),
changed_specs AS (SELECT DISTINCT project, 'doc-' || regexp_extract(path, '-(\\d+)\\.ts$', 1) || '.md' AS spec
                  FROM renamed WHERE status <> 'removed')
"""


@query("conflicts", "WITH " + SQL_CHANGED_SPECS + """
SELECT c.project, c.spec, 'Spec "' || c.spec || '" contains manual edits (not auto-generated)' AS reason
FROM changed_specs c JOIN spec_docs d ON d.project = c.project AND d.name = c.spec
WHERE NOT contains(d.text, '""" + MARKER + """')""")
def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return imp.detect_conflicts(_changed_specs(spark, sf), I.spec_docs(spark, sf), marker=MARKER)


@query("conflict_flags", "WITH " + SQL_CHANGED_SPECS + """,
conf AS (SELECT c.project, count(*) AS n FROM changed_specs c JOIN spec_docs d ON d.project = c.project AND d.name = c.spec
         WHERE NOT contains(d.text, '""" + MARKER + """') GROUP BY c.project),
projects AS (SELECT DISTINCT lang AS project FROM documents)
SELECT p.project, coalesce(c.n, 0) > 0 AS has_conflict, coalesce(c.n, 0) AS n_conflicts
FROM projects p LEFT JOIN conf c ON c.project = p.project""")
def conflict_flags(spark: SparkSession, sf: str) -> DataFrame:
    c = imp.detect_conflicts(_changed_specs(spark, sf), I.spec_docs(spark, sf), marker=MARKER)
    projects = I.table(spark, sf, "documents").select(F.col("lang").alias("project"))
    return imp.conflict_flags(c, projects)


@query("guarded_overwrite", "WITH " + SQL_CHANGED_SPECS + """,
cands AS (SELECT project, spec AS name FROM changed_specs
          UNION SELECT DISTINCT project, 'module-' || module || '.md' FROM symbols)
SELECT c.project, c.name,
       CASE WHEN d.text IS NULL OR contains(d.text, '""" + MARKER + """') THEN 'written' ELSE 'skipped' END AS action
FROM cands c LEFT JOIN spec_docs d ON d.project = c.project AND d.name = c.name""")
def guarded_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    sym = _symbols(spark, sf)
    cands = (_changed_specs(spark, sf).select("project", F.col("spec").alias("name"))
             .unionByName(sym.select("project", F.concat(F.lit("module-"), "module", F.lit(".md")).alias("name")))
             .distinct())
    return imp.guarded_overwrite(cands, I.spec_docs(spark, sf), marker=MARKER).select("project", "name", "action")


# --------------------------------------------------------------------------- A1 J3 G4 J4 F6 F5 F7

from ..operators import graph as G  # noqa: E402
from ..operators import structure as S  # noqa: E402

SQL_GRAPH = I.SQL_EDGES + "," + I.SQL_MODULES + """,
bnd AS (SELECT project, name, path,
          CASE WHEN split_part(path, '/', 1) IN ('src', 'lib', 'app', 'source', 'sources') THEN
                 CASE WHEN len(string_split(path, '/')) >= 3 THEN split_part(path, '/', 2)
                      WHEN len(string_split(path, '/')) = 2 AND regexp_matches(split_part(path, '/', 2), '\\.[^.]+$') THEN 'root'
                      WHEN len(string_split(path, '/')) = 2 THEN split_part(path, '/', 2) ELSE 'root' END
               WHEN len(string_split(path, '/')) >= 2 THEN split_part(path, '/', 1) ELSE 'root' END AS boundary
        FROM modules),
nb AS (SELECT project, name, max(boundary) AS boundary FROM bnd GROUP BY project, name),
core AS (
  SELECT e.project, e.target AS name, CAST(e.source AS VARCHAR) || ' → ' || CAST(e.target AS VARCHAR) AS route,
         'export' AS method, t.boundary AS module, s.boundary AS source_boundary
  FROM edges e JOIN nb s ON s.project = e.project AND s.name = e.source
  JOIN nb t ON t.project = e.project AND t.name = e.target
  WHERE s.boundary <> t.boundary)
"""


def _modules(spark, sf):
    # read by several rules of one query (boundaries, oversized, orphans, projects): written once
    return written(I.supplier_modules(spark, sf), "modules")


def _edges(spark, sf):
    return written(I.handoff_edges(spark, sf), "edges")


@query("boundaries", "WITH " + SQL_GRAPH + """
SELECT project, boundary, count(*) AS n_modules, min(name) AS first_module, max(name) AS last_module
FROM bnd GROUP BY project, boundary""")
def boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return S.boundaries(I.supplier_modules(spark, sf))


@query("boundary_members", "WITH " + SQL_GRAPH + " SELECT project, name, path, boundary FROM bnd")
def boundary_members(spark: SparkSession, sf: str) -> DataFrame:
    return S.module_boundaries(I.supplier_modules(spark, sf))


@query("core_edges", "WITH " + SQL_GRAPH + " SELECT * FROM core")
def core_edges(spark: SparkSession, sf: str) -> DataFrame:
    return S.core_apis(_modules(spark, sf), _edges(spark, sf))


@query("boundary_matrix", "WITH " + SQL_GRAPH + """
SELECT project, source_boundary, module AS target_boundary, count(*) AS n_edges
FROM core GROUP BY project, source_boundary, module""")
def boundary_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return S.boundary_matrix(S.core_apis(_modules(spark, sf), _edges(spark, sf)))


@query("module_dependencies", "WITH " + SQL_GRAPH + """,
deps AS (SELECT DISTINCT project, source AS name, target AS dependency FROM edges)
SELECT m.project, m.name, d.dependency
FROM modules m LEFT JOIN deps d ON d.project = m.project AND d.name = m.name""")
def module_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return S.module_dependencies(_modules(spark, sf), _edges(spark, sf))


@query("orphans", "WITH " + SQL_GRAPH + """
SELECT m.project, m.name FROM modules m
WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.project = m.project AND (e.source = m.name OR e.target = m.name))""")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    return S.orphans(_modules(spark, sf), _edges(spark, sf))


@query("oversized", "WITH " + SQL_GRAPH + f"""
SELECT project, name, n_exports FROM modules WHERE n_exports > {I.GOD_THRESHOLD}""")
def oversized(spark: SparkSession, sf: str) -> DataFrame:
    return S.god_modules(I.supplier_modules(spark, sf), I.GOD_THRESHOLD)


SQL_DEPTH = ("(len(string_split(file, '/')) - CASE WHEN split_part(file, '/', 1) IN "
             "('src', 'lib', 'app', 'source', 'sources') THEN 2 ELSE 1 END)")


@query("deep_paths", "WITH " + I.SQL_EDGES + "," + I.SQL_FILES + f"""
SELECT project, file, {SQL_DEPTH} AS depth FROM module_files WHERE {SQL_DEPTH} > 4""")
def deep_paths(spark: SparkSession, sf: str) -> DataFrame:
    return S.deep_files(I.module_files(spark, sf)).select("project", "file", F.col("depth").cast("long"))


@query("entry_points", "WITH " + I.SQL_PAGE_FILES + f"""
SELECT project, file FROM page_files
WHERE regexp_matches(string_split(file, '/')[-1], '^(index|main|app|server|cli|bin)\\.') AND {SQL_DEPTH} <= 1""")
def entry_points(spark: SparkSession, sf: str) -> DataFrame:
    return S.entry_points(I.page_files(spark, sf)).select("project", "file")


# --------------------------------------------------------------------------- G1 G2 A5

SQL_SCC = "WITH RECURSIVE " + I.SQL_EDGES + """,
e AS (SELECT DISTINCT project, source AS src, target AS dst FROM edges WHERE source <> target),
reach(project, a, b) AS (
  SELECT project, src, dst FROM e
  UNION
  SELECT r.project, r.a, e.dst FROM reach r JOIN e ON e.project = r.project AND e.src = r.b),
mutual AS (SELECT r1.project, r1.a AS node, r1.b AS other FROM reach r1
           JOIN reach r2 ON r1.project = r2.project AND r1.a = r2.b AND r1.b = r2.a WHERE r1.a <> r1.b),
scc AS (SELECT project, node, least(node, min(other)) AS component, count(DISTINCT other) + 1 AS component_size
        FROM mutual GROUP BY project, node)
"""


@query("cyclic_components", SQL_SCC + " SELECT project, node, component, component_size FROM scc")
def cyclic_components(spark: SparkSession, sf: str) -> DataFrame:
    return G.cyclic_components(_edges(spark, sf))


@query("bounded_cycles", "WITH " + I.SQL_EDGES + """,
e AS (SELECT DISTINCT project, source AS src, target AS dst FROM edges WHERE source <> target)
SELECT e1.project, 2 AS length,
       CAST(e1.src AS VARCHAR) || ' → ' || CAST(e1.dst AS VARCHAR) || ' → ' || CAST(e1.src AS VARCHAR) AS cycle
FROM e e1 JOIN e e2 ON e2.project = e1.project AND e2.src = e1.dst AND e2.dst = e1.src
WHERE e1.src < e1.dst
UNION ALL
SELECT e1.project, 3 AS length,
       CAST(e1.src AS VARCHAR) || ' → ' || CAST(e1.dst AS VARCHAR) || ' → ' || CAST(e2.dst AS VARCHAR)
         || ' → ' || CAST(e1.src AS VARCHAR) AS cycle
FROM e e1 JOIN e e2 ON e2.project = e1.project AND e2.src = e1.dst
JOIN e e3 ON e3.project = e1.project AND e3.src = e2.dst AND e3.dst = e1.src
WHERE e1.src < e1.dst AND e2.dst > e1.src AND e2.dst <> e1.dst""")
def bounded_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return G.bounded_cycles(_edges(spark, sf), max_len=3)


# shortest way from a component's smallest module back to it: all of them, the first by its modules is kept
SQL_WITNESS = SQL_SCC + """,
inside AS (SELECT e.project, s.component, e.src, e.dst FROM e
           JOIN scc s ON s.project = e.project AND s.node = e.src
           JOIN scc t ON t.project = e.project AND t.node = e.dst WHERE s.component = t.component),
walk(project, component, node, path) AS (
  SELECT DISTINCT project, component, component, [component] FROM scc
  UNION ALL
  SELECT w.project, w.component, i.dst, list_append(w.path, i.dst) FROM walk w
  JOIN inside i ON i.project = w.project AND i.component = w.component AND i.src = w.node
  WHERE (len(w.path) = 1 OR w.node <> w.component) AND (i.dst = w.component OR NOT list_contains(w.path, i.dst))),
witness AS (
  SELECT project, component, arg_min(path, (len(path), path)) AS path FROM walk
  WHERE len(path) > 1 AND node = component GROUP BY project, component),
witness_text AS (
  SELECT w.project, w.component, CAST(len(w.path) - 1 AS INTEGER) AS length,
         array_to_string(list_transform(w.path, lambda x: CAST(x AS VARCHAR)), ' → ') AS path,
         (SELECT max(component_size) FROM scc s WHERE s.project = w.project AND s.component = w.component) AS component_size
  FROM witness w)
"""


@query("witness_cycles", SQL_WITNESS + " SELECT project, component, component_size, length, path FROM witness_text")
def witness_cycles(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf)
    return G.witness_cycles(written(G.cyclic_components(e), "components"), e, most=None)


@query("cycle_modules", SQL_WITNESS + """
SELECT project, component, CAST(i - 1 AS BIGINT) AS position, path[i] AS module
FROM (SELECT project, component, path, unnest(range(1, len(path))) AS i FROM witness)""")
def cycle_modules(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf)
    return G.cycle_modules(written(G.cyclic_components(e), "components"), e)


SQL_ISSUES = SQL_WITNESS + "," + I.SQL_MODULES + "," + I.SQL_FILES + f""",
issues AS (
  SELECT project, 'cycle' AS rule, CAST(component AS VARCHAR) AS subject, 'circular dependency: ' || path AS issue,
         20 AS penalty FROM witness_text
  UNION ALL
  SELECT project, 'god_module', CAST(name AS VARCHAR),
         'god module "' || CAST(name AS VARCHAR) || '" has >{I.GOD_THRESHOLD} exports', 15
  FROM modules WHERE n_exports > {I.GOD_THRESHOLD}
  UNION ALL
  SELECT m.project, 'orphan', CAST(m.name AS VARCHAR),
         'orphan module "' || CAST(m.name AS VARCHAR) || '" has no incoming or outgoing dependencies', 10 FROM modules m
  WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.project = m.project AND (x.source = m.name OR x.target = m.name))
  UNION ALL
  SELECT project, 'deep_file', file, 'deep-nested file "' || file || '" is more than 4 levels deep', 5
  FROM module_files WHERE {SQL_DEPTH} > 4),
findings AS (
  SELECT project, rule, subject, issue, penalty,
         CASE rule WHEN 'cycle' THEN 'BLOCK' WHEN 'god_module' THEN 'WARN' WHEN 'deep_file' THEN 'WARN'
                   WHEN 'orphan' THEN 'INFO' END AS severity FROM issues)
"""


# A run writes its findings and measures once; what follows from them reads
# the stored run. The run before is the fleet as of a day.
BEFORE = "2000-07-01"
RUN_BEFORE, RUN_NOW = 0, 1


def _dated(spark, sf, store: RunStore) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(modules, edges, deep files), each with whether the run before has it:
    what both runs are made of, derived and stored once."""
    if not store.committed(0):
        store.commit(0, {"modules": I.dated_modules(spark, sf, BEFORE).drop("path"), "edges": I.dated_edges(spark, sf, BEFORE),
                         "deep": S.deep_files(I.dated_files(spark, sf, BEFORE))})
    return store.read("modules", 0), store.read("edges", 0), store.read("deep", 0)


def _run(spark, sf, run: int = RUN_NOW):
    """(findings, measures) of a stored run, computed when it is not there."""
    tables = [f"{sf}/{t}.parquet" for t in ("lineitem", "orders", "supplier", "nation")]
    store = RunStore(spark, f"{ensure_checkpoint_dir(spark)}/runs-{files_digest(spark, tables)}")
    if not store.committed(run):
        m, e, deep = _dated(spark, sf, RunStore(spark, f"{store.path}/dated"))
        if run == RUN_BEFORE:
            m, e, deep = m.where("early").withColumn("n_exports", F.col("n_before")), e.where("early"), deep.where("early")
        issues = S.issue_rows(cycles=G.witness_cycles(written(G.cyclic_components(e), "run-components"), e, most=None),
                              gods=S.god_modules(m, I.GOD_THRESHOLD), orphan_mods=S.orphans(m, e), deep=deep, god_threshold=I.GOD_THRESHOLD)
        store.commit(run, {"findings": C.with_severity(issues), "measures": m.select("project", "name", "n_exports")})
    return store.read("findings", run), store.read("measures", run)


@query("health", SQL_ISSUES + """
SELECT p.project, CAST(greatest(0, 100 - coalesce(sum(i.penalty), 0)) AS INTEGER) AS score,
       count(*) FILTER (WHERE i.rule = 'cycle') AS n_cycle, count(*) FILTER (WHERE i.rule = 'god_module') AS n_god_module,
       count(*) FILTER (WHERE i.rule = 'orphan') AS n_orphan, count(*) FILTER (WHERE i.rule = 'deep_file') AS n_deep_file
FROM (SELECT DISTINCT project FROM modules) p LEFT JOIN issues i ON i.project = p.project GROUP BY p.project""")
def health(spark: SparkSession, sf: str) -> DataFrame:
    return S.health(*_run(spark, sf))


@query("impact_levels", "WITH " + I.SQL_EDGES + "," + I.SQL_MODULES + """,
aff AS (SELECT project, source AS name, count(DISTINCT target) AS n FROM edges WHERE source <> target
        GROUP BY project, source),
sym AS (SELECT m.project, m.name, lower(s.s_name) AS symbol, coalesce(a.n, 0) AS n_affected
        FROM modules m JOIN supplier s ON s.s_suppkey = m.name
        LEFT JOIN aff a ON a.project = m.project AND a.name = m.name)
SELECT project, name, symbol, n_affected,
       CASE WHEN (length(symbol) > 0 AND substr(symbol, 1, 1) = upper(substr(symbol, 1, 1))) OR n_affected > 3 THEN 'high'
            WHEN n_affected >= 1 THEN 'medium' ELSE 'low' END AS impact_level
FROM sym""")
def impact_levels(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import impact_level_n
    m = _modules(spark, sf)
    e = _edges(spark, sf).where(F.col("source") != F.col("target"))
    # the number of affected modules is all the rule needs: a distinct count, no per-module list
    aff = e.groupBy("project", F.col("source").alias("name")).agg(F.countDistinct("target").alias("_n"))
    s = I.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("name"), F.lower("s_name").alias("symbol"))
    j = m.join(s, "name").join(aff, ["project", "name"], "left")
    n = F.coalesce("_n", F.lit(0)).cast("long")
    return j.select("project", "name", "symbol", n.alias("n_affected"), impact_level_n("symbol", n).alias("impact_level"))


# --------------------------------------------------------------------------- C1 C2 C3 C4 C10

@query("severity_findings", SQL_ISSUES + " SELECT project, rule, subject, severity, issue FROM findings")
def severity_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf)[0].select("project", "rule", "subject", "severity", "issue")


def _sql_before(sql: str) -> str:
    """The same derivation on the orders before the day of the last run."""
    return sql.replace("FROM orders)", f"FROM orders WHERE o_orderdate < DATE '{BEFORE}')")


SQL_RUNS = ("WITH now AS (" + SQL_ISSUES + " SELECT project, rule, subject, severity FROM findings), before AS ("
            + _sql_before(SQL_ISSUES) + " SELECT project, rule, subject, severity FROM findings)")


@query("new_findings", SQL_RUNS + """
SELECT n.* FROM now n WHERE NOT EXISTS (
  SELECT 1 FROM before b WHERE b.project = n.project AND b.rule = n.rule AND b.subject = n.subject)""")
def new_findings(spark: SparkSession, sf: str) -> DataFrame:
    return C.new_findings(_run(spark, sf)[0], _run(spark, sf, RUN_BEFORE)[0]).select("project", "rule", "subject", "severity")


@query("finding_changes", SQL_RUNS + """
SELECT coalesce(n.project, b.project) AS project, coalesce(n.rule, b.rule) AS rule, coalesce(n.subject, b.subject) AS subject,
       coalesce(n.severity, b.severity) AS severity,
       CASE WHEN b.rule IS NULL THEN 'new' WHEN n.rule IS NULL THEN 'resolved' ELSE 'kept' END AS state
FROM now n FULL OUTER JOIN before b ON b.project = n.project AND b.rule = n.rule AND b.subject = n.subject""")
def finding_changes(spark: SparkSession, sf: str) -> DataFrame:
    return compare_runs(_run(spark, sf)[0], _run(spark, sf, RUN_BEFORE)[0])


NEAR_THRESHOLD = 2  # exports

SQL_MODULES_NOW = "WITH " + I.SQL_EDGES + "," + I.SQL_MODULES + " SELECT project, name, n_exports FROM modules"


@query("approaching_threshold", "WITH now AS (" + SQL_MODULES_NOW + "), before AS (" + _sql_before(SQL_MODULES_NOW) + f""")
SELECT n.project, n.name, n.n_exports AS now, coalesce(b.n_exports, 0) AS before
FROM now n LEFT JOIN before b ON b.project = n.project AND b.name = n.name
WHERE n.n_exports <= {NEAR_THRESHOLD} AND 10 * n.n_exports >= 8 * {NEAR_THRESHOLD} AND n.n_exports > coalesce(b.n_exports, 0)""")
def approaching_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return approaching(_run(spark, sf)[1], _run(spark, sf, RUN_BEFORE)[1], "n_exports", NEAR_THRESHOLD)


@query("verdict", SQL_ISSUES + """
SELECT p.project, CAST(coalesce(sum(CASE WHEN f.severity = 'INFO' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_info,
       CAST(coalesce(sum(CASE WHEN f.severity = 'WARN' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_warn,
       CAST(coalesce(sum(CASE WHEN f.severity = 'BLOCK' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_block,
       CASE WHEN sum(CASE WHEN f.severity = 'BLOCK' THEN 1 ELSE 0 END) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict
FROM (SELECT DISTINCT project FROM modules) p LEFT JOIN findings f ON f.project = p.project
GROUP BY p.project""")
def verdict(spark: SparkSession, sf: str) -> DataFrame:
    v = C.verdict(*_run(spark, sf))
    return v.select("project", *[F.col(c).cast("long").alias(c) for c in ("n_info", "n_warn", "n_block")], "verdict")


@query("doc_vs_actual", "WITH " + I.SQL_EDGES + """,
lines AS (SELECT p.project, l.l_suppkey AS module, l.l_partkey AS name, l.l_quantity
          FROM lineitem l JOIN order_project p ON p.l_orderkey = l.l_orderkey),
d AS (SELECT DISTINCT project, module, name FROM lines WHERE l_quantity > 25),
a AS (SELECT DISTINCT project, module, name FROM lines WHERE l_quantity <= 25)
SELECT coalesce(d.project, a.project) AS project, coalesce(d.module, a.module) AS module, 'export' AS kind,
       coalesce(d.name, a.name) AS name,
       CASE WHEN a.name IS NULL THEN 'GAP' WHEN d.name IS NULL THEN 'DRIFT' ELSE 'MATCH' END AS status
FROM d FULL OUTER JOIN a ON d.project = a.project AND d.module = a.module AND d.name = a.name""")
def doc_vs_actual(spark: SparkSession, sf: str) -> DataFrame:
    li = I.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity")
    lines = li.join(I.order_project(spark, sf), "l_orderkey").select(
        "project", F.col("l_suppkey").alias("module"), F.lit("export").alias("kind"),
        F.col("l_partkey").alias("name"), "l_quantity")
    return C.documented_vs_actual(lines.where(F.col("l_quantity") > 25), lines.where(F.col("l_quantity") <= 25))


CUTOFF = "1997-01-01"  # exports shipped before the cutoff form the old interface


@query("removed_exports", "WITH " + I.SQL_EDGES + f""",
lines AS (SELECT p.project, l.l_suppkey AS module, l.l_partkey AS export, l.l_shipdate
          FROM lineitem l JOIN order_project p ON p.l_orderkey = l.l_orderkey),
old AS (SELECT DISTINCT project, module, export FROM lines WHERE l_shipdate < TIMESTAMP '{CUTOFF}'),
new AS (SELECT DISTINCT project, module, export FROM lines WHERE l_shipdate >= TIMESTAMP '{CUTOFF}')
SELECT o.project, o.module, o.export FROM old o
WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.project = o.project AND n.module = o.module AND n.export = o.export)
  AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = o.export AND p.p_size > 25)""")
def removed_exports(spark: SparkSession, sf: str) -> DataFrame:
    li = I.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("module"),
                                               F.col("l_partkey").alias("export"), "l_shipdate")
    lines = li.join(I.order_project(spark, sf), "l_orderkey")
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    old, new = lines.where(F.col("l_shipdate") < cut), lines.where(F.col("l_shipdate") >= cut)
    part = I.table(spark, sf, "part").where(F.col("p_size") > 25).select(F.col("p_partkey").alias("export"))
    deprecated = lines.select("project", "module", "export").join(part, "export")
    return C.removed_without_deprecation(old, new, deprecated)


HREF = 'href="([^"]*)"'


@query("broken_links", f"""
WITH links AS (SELECT DISTINCT page_id, lower(replace(h, '/', '')) AS target
               FROM (SELECT page_id, unnest(regexp_extract_all(html, '{HREF}', 1)) AS h FROM pages)),
notes AS (SELECT DISTINCT w AS name FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w
                                          FROM benchmark) WHERE w <> '')
SELECT page_id, target FROM links WHERE target NOT IN (SELECT name FROM notes)""")
def broken_links(spark: SparkSession, sf: str) -> DataFrame:
    pages = I.table(spark, sf, "pages").select("page_id", "html")
    links = C.extract_links(pages, text_col="html", pattern=HREF, keys=["page_id"])
    links = links.select("page_id", F.lower(F.regexp_replace("target", "/", "")).alias("target")).distinct()
    notes = (I.table(spark, sf, "benchmark")
             .select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("name")).where(F.col("name") != ""))
    return C.broken_links(links, notes, group=[], note_col="name")


# --------------------------------------------------------------------------- C5 C6 C7 C8 C9

SQL_LINES = """
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
"""


@query("copied_blocks", "WITH " + SQL_LINES + """,
blocks AS (
  SELECT doc_id, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w || chr(10)
           || lead(line, 3) OVER w || chr(10) || lead(line, 4) OVER w || chr(10) || lead(line, 5) OVER w AS block,
         lead(line, 5) OVER w AS l5
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT sha256(block) AS block_hash, count(DISTINCT doc_id) AS n_docs, count(*) AS n_places
FROM blocks WHERE l5 IS NOT NULL GROUP BY block HAVING count(DISTINCT doc_id) >= 2""")
def copied_blocks(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    return C.copied_blocks(docs, ["doc_id"])


@query("copied_ranges", "WITH " + SQL_LINES + """,
blocks AS (
  SELECT doc_id, line_no, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w || chr(10)
           || lead(line, 3) OVER w || chr(10) || lead(line, 4) OVER w || chr(10) || lead(line, 5) OVER w AS block
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
rep AS (SELECT block, min(doc_id) AS d, arg_min(line_no, (doc_id, line_no)) AS l FROM blocks
        WHERE block IS NOT NULL GROUP BY block HAVING count(DISTINCT doc_id) >= 2),
places AS (SELECT b.doc_id, r.d AS representative, b.line_no, b.line_no - r.l AS diagonal
           FROM blocks b JOIN rep r ON r.block = b.block WHERE b.doc_id <> r.d),
islands AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, representative, diagonal ORDER BY line_no) AS island FROM places)
SELECT doc_id, representative, CAST(min(line_no) AS BIGINT) AS first_line, CAST(max(line_no) + 5 AS BIGINT) AS last_line,
       CAST(min(line_no) - diagonal AS BIGINT) AS first_line_there
FROM islands GROUP BY doc_id, representative, diagonal, island""")
def copied_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return C.copied_ranges(I.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query("repeated_lines", "WITH " + SQL_LINES + """
SELECT sha256(line) AS line_hash, count(DISTINCT doc_id) AS n_docs, count(*) AS n_places
FROM lines WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 3""")
def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    return C.repeated_lines(C.text_lines(docs, ["doc_id"]), ["doc_id"])


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL_RULE_UNION = " UNION ALL ".join(
    f"SELECT doc_id, line_no, '{name}' AS rule, '{sev}' AS severity, '{C.REVIEW_ACTION[sev]}' AS action "
    f"FROM lines WHERE regexp_matches(line, {_sql_str(p)})"
    for name, (p, sev) in C.LINE_RULES.items())


@query("line_rules", "WITH " + SQL_LINES + " " + SQL_RULE_UNION)
def line_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    return C.line_findings(C.text_lines(docs, ["doc_id"]), ["doc_id"]).select(
        "doc_id", F.col("line_no").cast("long"), "rule", "severity", "action")


LONG_TEXT_LINES = 50  # the driver's documents have at most ~100 lines; the review default is 800


@query("long_texts", f"""
SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents
WHERE len(string_split(text, chr(10))) > {LONG_TEXT_LINES}""")
def long_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    return C.long_texts(docs, ["doc_id"], max_lines=LONG_TEXT_LINES).select(
        "doc_id", F.col("n_lines").cast("long"))


@query("task_completion", """
SELECT o_custkey, count(*) AS n_tasks, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done,
       bool_and(o_orderstatus = 'F') AS complete
FROM orders GROUP BY o_custkey""")
def task_completion(spark: SparkSession, sf: str) -> DataFrame:
    o = I.table(spark, sf, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("done"))
    return C.task_completion(o, ["o_custkey"], "done")


@query("month_index", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_items, min(o_orderkey) AS first_item,
       max(o_orderkey) AS last_item
FROM orders GROUP BY 1""")
def month_index(spark: SparkSession, sf: str) -> DataFrame:
    return C.month_index(I.table(spark, sf, "orders"), "o_orderdate", "o_orderkey")


# --------------------------------------------------------------------------- A6 A7 A8 A9 A10 P12

from ..operators import inventory as INV  # noqa: E402
from ..operators import quality as Q  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

SQL_STATUS = SQL_RENAMED + """,
spec_docs AS (SELECT lang AS project, 'doc-' || CAST(doc_id AS VARCHAR) || '.md' AS name, text FROM documents),
st AS (SELECT project, count(*) AS n_specs, CAST(sum(strlen(text)) AS BIGINT) AS index_size FROM spec_docs GROUP BY project),
ch AS (SELECT project, count(*) AS active_changes FROM renamed GROUP BY project),
tr AS (SELECT project, count(DISTINCT """ + I.SQL_MODULE + """) AS tracked_entries FROM old_f GROUP BY project),
stale AS (SELECT o.project, count(*) AS n_stale FROM old_f o
          WHERE NOT EXISTS (SELECT 1 FROM new_f n WHERE n.project = o.project AND n.path = o.path) GROUP BY o.project),
conf AS (SELECT c.project, count(*) AS n_conflicts
         FROM (SELECT DISTINCT project, 'doc-' || regexp_extract(path, '-(\\d+)\\.ts$', 1) || '.md' AS spec
               FROM renamed WHERE status <> 'removed') c
         JOIN spec_docs d ON d.project = c.project AND d.name = c.spec
         WHERE NOT contains(d.text, '""" + MARKER + """') GROUP BY c.project),
status AS (
  SELECT st.project, st.n_specs, coalesce(ch.active_changes, 0) AS active_changes,
         coalesce(tr.tracked_entries, 0) AS tracked_entries, st.index_size,
         '(never)' AS last_ref,
         CASE WHEN tr.tracked_entries IS NULL THEN '(never)' ELSE '""" + I.T_OLD.replace(" ", "T") + """.000Z' END AS last_at,
         coalesce(stale.n_stale, 0) AS n_stale, coalesce(conf.n_conflicts, 0) AS n_conflicts
  FROM st LEFT JOIN ch ON ch.project = st.project LEFT JOIN tr ON tr.project = st.project
  LEFT JOIN stale ON stale.project = st.project LEFT JOIN conf ON conf.project = st.project)
"""


def _status(spark, sf):
    docs = I.spec_docs(spark, sf)
    old, new = I.old_files(spark, sf), I.new_files(spark, sf)
    state = I.module_state(old, I.T_OLD)
    changes = _renamed(spark, sf)
    stale = snap.stale_entries(old.select("project", F.col("path").alias("key")), new, present_key="path")
    conf = imp.detect_conflicts(_changed_specs(spark, sf), docs, marker=MARKER)
    parts = [
        docs.groupBy("project").agg(F.count(F.lit(1)).alias("n_specs"), F.sum(F.octet_length("text")).alias("index_size")),
        Q.count_by(changes, "active_changes"),
        Q.count_by(state, "tracked_entries"),
        Q.last_sync(state),
        Q.count_by(stale, "n_stale"),
        Q.count_by(conf, "n_conflicts"),
    ]
    out = Q.status_rollup(docs, parts, ["active_changes", "tracked_entries", "n_stale", "n_conflicts"])
    return out.withColumn("last_ref", F.coalesce("last_ref", F.lit("(never)"))) \
        .withColumn("last_at", F.coalesce("last_at", F.lit("(never)")))


@query("status_rollup", "WITH " + SQL_STATUS + """
SELECT project, n_specs, active_changes, tracked_entries, index_size, last_ref, last_at FROM status""")
def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _status(spark, sf).select("project", "n_specs", "active_changes", "tracked_entries",
                                     F.col("index_size").cast("long"), "last_ref", "last_at")


@query("check_tally", "WITH " + SQL_STATUS + """,
checks AS (
  SELECT project, CASE WHEN n_specs > 0 THEN 'pass' ELSE 'warn' END AS level FROM status
  UNION ALL SELECT project, CASE WHEN tracked_entries > 0 THEN 'pass' ELSE 'warn' END FROM status
  UNION ALL SELECT project, CASE WHEN n_stale = 0 THEN 'pass' ELSE 'warn' END FROM status
  UNION ALL SELECT project, CASE WHEN n_conflicts = 0 THEN 'pass' ELSE 'fail' END FROM status)
SELECT project, count(*) FILTER (WHERE level = 'pass') AS passed, count(*) FILTER (WHERE level = 'warn') AS warnings,
       count(*) FILTER (WHERE level = 'fail') AS failures
FROM checks GROUP BY project""")
def check_tally(spark: SparkSession, sf: str) -> DataFrame:
    s = _status(spark, sf)
    checks = (Q.check_rows(s, "specs_present", F.when(F.col("n_specs") > 0, "pass").otherwise("warn"))
              .unionByName(Q.check_rows(s, "state_present",
                                        F.when(F.col("tracked_entries") > 0, "pass").otherwise("warn")))
              .unionByName(Q.check_rows(s, "state_consistent", F.when(F.col("n_stale") == 0, "pass").otherwise("warn"),
                                        F.format_string("%d stale sync entries", F.col("n_stale"))))
              .unionByName(Q.check_rows(s, "no_conflicts", F.when(F.col("n_conflicts") == 0, "pass").otherwise("fail"))))
    return Q.check_tally(checks)


ORDER_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]  # "4-NOT SPECIFIED" is no priority
ORDER_STATUSES = ["F", "P"]  # open orders are not settled


@query("row_validation", """
WITH v AS (SELECT o_orderkey,
  CASE WHEN o_orderpriority IS NULL OR o_orderpriority NOT IN ('""" + "', '".join(ORDER_PRIORITIES) + """') THEN 1 ELSE 0 END AS bad_priority,
  CASE WHEN o_orderstatus IS NULL OR o_orderstatus NOT IN ('""" + "', '".join(ORDER_STATUSES) + """') THEN 1 ELSE 0 END AS bad_status,
  CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END AS no_customer FROM orders)
SELECT 'o_orderpriority' AS field, CAST(sum(bad_priority) AS BIGINT) AS n_issues FROM v
UNION ALL SELECT 'o_orderstatus', CAST(sum(bad_status) AS BIGINT) FROM v
UNION ALL SELECT 'o_custkey', CAST(sum(no_customer) AS BIGINT) FROM v""")
def row_validation(spark: SparkSession, sf: str) -> DataFrame:
    rules = [Q.one_of("o_orderpriority", ORDER_PRIORITIES, "o_orderpriority"),
             Q.one_of("o_orderstatus", ORDER_STATUSES, "o_orderstatus"),
             F.when(F.col("o_custkey").isNull(), F.lit("o_custkey"))]
    v = Q.validate_rows(I.table(spark, sf, "orders"), rules)
    agg = v.agg(*[F.count(F.when(F.array_contains("issues", f), 1)).alias(f) for f in
                  ("o_orderpriority", "o_orderstatus", "o_custkey")])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n_issues"))
                                          for f in ("o_orderpriority", "o_orderstatus", "o_custkey")])).alias("r")) \
        .select("r.field", "r.n_issues")


PROPS_TYPE = T.StructType([T.StructField("k", T.LongType()), T.StructField("channel", T.StringType()),
                           T.StructField("flags", T.StructType([T.StructField("beta", T.BooleanType())]))])
PROPS_DEFAULTS = {"k": -1, "channel": "web", "flags": {"beta": False}}


@query("event_defaults", """
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k,
       coalesce(json_extract_string(props, '$.channel'), 'web') AS channel,
       coalesce(TRY_CAST(json_extract_string(props, '$.flags.beta') AS BOOLEAN), false) AS beta
FROM events""")
def event_defaults(spark: SparkSession, sf: str) -> DataFrame:
    ev = I.table(spark, sf, "events").select("event_id", F.from_json("props", PROPS_TYPE).alias("cfg"))
    r = Q.with_defaults(ev, "cfg", PROPS_DEFAULTS, PROPS_TYPE)
    return r.select("event_id", "cfg.k", "cfg.channel", F.col("cfg.flags.beta").alias("beta"))


# --------------------------------------------------------------------------- S2 J12

@query("inventory_modules", "WITH " + I.SQL_DOC_FILES + """
SELECT project, split_part(path, '/', 2) AS name, 'src/' || split_part(path, '/', 2) AS path, count(*) AS n_files
FROM doc_files WHERE len(string_split(path, '/')) >= 3 GROUP BY 1, 2, 3""")
def inventory_modules(spark: SparkSession, sf: str) -> DataFrame:
    return INV.modules_from_files(I.doc_files(spark, sf))


SQL_ALL_FILES = "WITH " + I.SQL_DOC_FILES + "," + I.SQL_EDGES + "," + I.SQL_FILES + "," + I.SQL_PAGE_FILES + """,
files AS (SELECT project, path FROM doc_files UNION ALL SELECT project, file FROM module_files
          UNION ALL SELECT project, file FROM page_files)
"""


def _all_files(spark, sf):
    return (I.doc_files(spark, sf)
            .unionByName(I.module_files(spark, sf).select("project", F.col("file").alias("path")))
            .unionByName(I.page_files(spark, sf).select("project", F.col("file").alias("path"))))


@query("source_dir", SQL_ALL_FILES + """,
dirs AS (SELECT DISTINCT project, split_part(path, '/', 1) AS d FROM files WHERE len(string_split(path, '/')) >= 2),
ranked AS (SELECT project, arg_min(d, list_position(['src', 'lib', 'app', 'main'], d)) AS src_dir
           FROM dirs WHERE d IN ('src', 'lib', 'app', 'main') GROUP BY project)
SELECT p.project, coalesce(r.src_dir, '.') AS src_dir
FROM (SELECT DISTINCT project FROM files) p LEFT JOIN ranked r ON r.project = p.project""")
def source_dir(spark: SparkSession, sf: str) -> DataFrame:
    return INV.source_dir(spark, _all_files(spark, sf))


@query("folder_sizes", "WITH " + I.SQL_EDGES + "," + I.SQL_FILES + "," + I.SQL_PAGE_FILES + "," + I.SQL_SIZED_FILES + """,
up AS (SELECT project, size, string_split(path, '/') AS parts FROM sized_files),
each AS (SELECT project, size, array_to_string(parts[1:i], '/') AS folder FROM up, LATERAL (SELECT unnest(range(0, len(parts))) AS i))
SELECT project, folder, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes FROM each GROUP BY project, folder""")
def folder_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return INV.folder_sizes(I.sized_files(spark, sf))


# --------------------------------------------------------------------------- O1 O2

from ..operators import ordered as O  # noqa: E402


@query("ordered_paths", "WITH " + I.SQL_SNAPSHOTS + """
SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY path) AS position FROM new_f""")
def ordered_paths(spark: SparkSession, sf: str) -> DataFrame:
    return O.with_positions(I.new_files(spark, sf).select("project", "path"), ["path"])


WORD = "[A-Za-zÀ-ÖØ-öø-ÿ_]+"


@query("ordered_names", f"""
WITH names AS (SELECT DISTINCT lang AS project, unnest(regexp_extract_all(text, '{WORD}')) AS name FROM documents)
SELECT project, name, row_number() OVER (PARTITION BY project ORDER BY name COLLATE en_us, name) AS position FROM names""")
def ordered_names(spark: SparkSession, sf: str) -> DataFrame:
    """The words of each project's documents in locale order."""
    d = I.table(spark, sf, "documents")
    names = d.select(F.col("lang").alias("project"), F.explode(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("name"))
    return O.with_positions(names.distinct(), [O.by_locale("name"), "name"])


# --------------------------------------------------------------------------- P12 on documents of any shape

CONFIG_DEFAULTS = {"k": -1, "channel": "web", "flags": {"beta": False, "limit": {"rows": 10, "tags": ["a"]}}}
# what an event of each type sets beside its own properties
CONFIG_SET = {"view": "{}", "click": '{"channel": null, "flags": {"beta": true, "own": {"x": 1}}}',
              "purchase": '{"flags": {"limit": {"rows": 5}}, "extra": [1, null]}',
              "error": '{"flags": null, "channel": "app"}', "signup": '{"flags": {"limit": {"tags": [], "more": {}}}, "k": null}'}


@query("config_defaults", """
WITH c AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CASE event_type
  WHEN 'view' THEN '{"channel":"web","flags":{"beta":false,"limit":{"rows":10,"tags":["a"]}},"k":' || k || '}'
  WHEN 'click' THEN '{"channel":null,"flags":{"beta":true,"limit":{"rows":10,"tags":["a"]},"own":{"x":1}},"k":' || k || '}'
  WHEN 'purchase' THEN '{"channel":"web","extra":[1,null],"flags":{"beta":false,"limit":{"rows":5,"tags":["a"]}},"k":' || k || '}'
  WHEN 'error' THEN '{"channel":"app","flags":null,"k":' || k || '}'
  WHEN 'signup' THEN '{"channel":"web","flags":{"beta":false,"limit":{"more":{},"rows":10,"tags":[]}},"k":null}' END AS config
FROM c""")
def config_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Every event's configuration: what its type sets over its properties
    over the defaults; an explicit null stays."""
    ev = I.table(spark, sf, "events").select("event_id", "event_type", "props")
    sets = F.create_map(*[F.lit(x) for kv in CONFIG_SET.items() for x in kv])[F.col("event_type")]
    base = F.try_variant_get(F.parse_json("props"), "$", "map<string,variant>")
    over = F.try_variant_get(F.parse_json(sets), "$", "map<string,variant>")
    given = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)
    merged = Q.merge_defaults(F.to_variant_object(given), CONFIG_DEFAULTS)
    return ev.select("event_id", F.to_json(merged).alias("config"))


# --------------------------------------------------------------------------- T1-T5

from ..streaming import debounce as D  # noqa: E402

SESSION_GAP_S = 7200
TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_SESSIONS = f"""
WITH ev AS (SELECT user_id, ts, event_type,
                   CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL {SESSION_GAP_S} SECOND
                        THEN 0 ELSE 1 END AS new_s, event_id FROM events),
g AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM ev)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS n_events
FROM g GROUP BY user_id, sid"""


@query("sessions", SQL_SESSIONS)
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    ev = I.table(spark, sf, "events").select("user_id", "ts")
    s = D.sessionize(ev, ["user_id"], "ts", SESSION_GAP_S)
    return s.select("user_id", F.date_format("session_start", TS_FMT).alias("session_start"),
                    F.date_format("session_end", TS_FMT).alias("session_end"), "n_events")


# The watched streams: batches of file events per project, closed by the
# watermark; their SQL twins follow from the rule "no later cell can reach it".

import os  # noqa: E402
import uuid  # noqa: E402

from ..streaming import sync as SY  # noqa: E402
from ..streaming import watcher as W  # noqa: E402

WATCH_GAP_S = 1200
WATCH_DELAY_S = 3600
STREAM_PARTS = 3  # arrivals in which the derived events are delivered


def _sql_batches(source: str, key: str, item: str, gap: int) -> str:
    """CTEs ``sess`` (events with their batch), ``batches``, ``closed``."""
    return f"""
ev AS (SELECT {key} AS key, {item} AS item, ts, event_id FROM {source}),
mark AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts, event_id) <= INTERVAL {gap} SECOND
                        THEN 0 ELSE 1 END AS new_s FROM ev),
num AS (SELECT *, sum(new_s) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM mark),
sess AS (SELECT *, min(ts) OVER (PARTITION BY key, sid) AS batch_start, max(ts) OVER (PARTITION BY key, sid) AS batch_end FROM num),
batches AS (SELECT key, batch_start, batch_end, count(*) AS n_events FROM sess GROUP BY ALL),
reached AS (SELECT max(cell) AS newest FROM (SELECT epoch_us(ts) // {gap * 1_000_000} AS cell FROM ev)
            WHERE (cell + 1) * {gap * 1_000_000} <= (SELECT epoch_us(max(ts)) FROM ev) - {WATCH_DELAY_S * 1_000_000}),
closed AS (SELECT * FROM batches WHERE epoch_us(batch_end) + {gap * 1_000_000} < (SELECT newest + 1 FROM reached) * {gap * 1_000_000})
"""


def _sql_ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def _stream_dir(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")


def _arrivals(events: DataFrame, folder: str):
    """Write ``events`` below ``folder`` in time order, part by part, as
    they would arrive; yields after each part."""
    low, high = events.select(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    step = ((high or 0) - (low or 0)) // STREAM_PARTS + 1
    part = F.least(F.expr(f"(unix_micros(ts) - {low or 0}) div {step}"), F.lit(STREAM_PARTS - 1))
    for i in range(STREAM_PARTS):
        events.where(part == i).write.parquet(f"{folder}/part-{i}")
        yield i


def _watch_all(spark: SparkSession, events: DataFrame, name: str, gap: int, key: str, item: str, on_batches=None,
               rules: bool = True) -> str:
    """Run the watcher over ``events`` as they arrive; each arrival is taken
    by a new run on the same checkpoint. Returns the output folder."""
    base = _stream_dir(spark, name)
    events = written(events, f"{name}-events")
    for _ in _arrivals(events, f"{base}/in"):
        if rules:
            stream = W.watch_source(spark, f"{base}/in", events.schema, path_col=item)
        else:
            stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(f"{base}/in")
        W.watch(stream, f"{base}/out", gap, f"{WATCH_DELAY_S} seconds", f"{base}/checkpoint", key=key, item=item,
                on_batches=on_batches).awaitTermination()
    return f"{base}/out"


@query("sessions_stream", "WITH " + _sql_batches("events", "user_id", "event_type", SESSION_GAP_S) + f"""
SELECT key AS user_id, {_sql_ts("batch_start")} AS session_start, {_sql_ts("batch_end")} AS session_end, n_events FROM closed""")
def sessions_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The sessions that the watermark has closed, in append mode."""
    ev = I.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = _watch_all(spark, ev, "sessions", SESSION_GAP_S, "user_id", "event_type", rules=False)
    return W.watched(spark, out, "batches").select(
        F.col("key").cast("long").alias("user_id"), F.date_format("batch_start", TS_FMT).alias("session_start"),
        F.date_format("batch_end", TS_FMT).alias("session_end"), "n_events")


SQL_WATCHED = I.SQL_SNAPSHOTS + "," + I.SQL_FILE_EVENTS + """,
watched_events AS (SELECT * FROM file_events WHERE path LIKE 'src/%.ts' AND NOT contains(path, '/dist/'))
"""
SQL_WATCHED_BATCHES = SQL_WATCHED + "," + _sql_batches("watched_events", "project", "path", WATCH_GAP_S)
SQL_ITEMS = f"""
SELECT s.key AS project, {_sql_ts("s.batch_start")} AS batch_start, s.item, {_sql_ts("min(s.ts)")} AS first_seen,
       count(*) AS n_events
FROM sess s JOIN {{0}} b ON b.key = s.key AND b.batch_start = s.batch_start GROUP BY s.key, s.batch_start, s.item"""


def _item_rows(items: DataFrame) -> DataFrame:
    return items.select(F.col("key").alias("project"), F.date_format("batch_start", TS_FMT).alias("batch_start"), "item",
                        F.date_format("first_seen", TS_FMT).alias("first_seen"), "n_events")


@query("batch_items", "WITH " + SQL_WATCHED_BATCHES + SQL_ITEMS.format("batches"))
def batch_items(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct items of every batch of file events, as a batch job."""
    ev = D.file_events(I.file_events(spark, sf))
    cells = written(W.item_cells(ev, WATCH_GAP_S, None), "cells")
    return _item_rows(W.batch_items(W.batch_spans(cells, WATCH_GAP_S), cells, WATCH_GAP_S))


@query("batch_items_stream", "WITH " + SQL_WATCHED_BATCHES + SQL_ITEMS.format("closed"))
def batch_items_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same from the stream, for the batches the watermark has closed."""
    out = _watch_all(spark, I.file_events(spark, sf), "items", WATCH_GAP_S, "project", "path")
    return _item_rows(W.watched(spark, out, "items"))


WATCH_FROM = "2024-01-11 00:00:00"


@query("watch_start", "WITH " + SQL_WATCHED + f"""
SELECT project, path, count(*) AS n_events FROM watched_events WHERE ts >= TIMESTAMP '{WATCH_FROM}' GROUP BY project, path""")
def watch_start(spark: SparkSession, sf: str) -> DataFrame:
    """A watcher that starts when event files are already there: what they
    hold is no event, only what arrives later."""
    base = _stream_dir(spark, "start")
    events = written(I.file_events(spark, sf), "start-events")
    early = F.col("ts") < F.lit(WATCH_FROM).cast("timestamp")
    events.where(early).write.parquet(f"{base}/in/backlog")
    since = W.start_position(spark, f"{base}/in")
    events.where(~early).write.parquet(f"{base}/in/later")
    stream = W.watch_source(spark, f"{base}/in", events.schema, since)
    q = (stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    seen = spark.read.schema(events.schema).parquet(f"{base}/out")
    return seen.groupBy("project", "path").agg(F.count(F.lit(1)).alias("n_events"))


SQL_SYNC = SQL_WATCHED_BATCHES + """,
items AS (SELECT DISTINCT s.key AS project, s.batch_start, s.batch_end, s.item AS path
          FROM sess s JOIN closed c ON c.key = s.key AND c.batch_start = s.batch_start),
ch AS (SELECT i.project, i.batch_start, i.path, c.status, c.old_hash, c.new_hash
       FROM items i JOIN changes c ON c.project = i.project AND c.path = i.path),
rem AS (SELECT project, batch_start, old_hash AS h, min(path) AS path FROM ch WHERE status = 'removed' GROUP BY ALL HAVING count(*) = 1),
addd AS (SELECT project, batch_start, new_hash AS h, min(path) AS path FROM ch WHERE status = 'added' GROUP BY ALL HAVING count(*) = 1),
pairs AS (SELECT a.project, a.batch_start, a.path, r.path AS previous_path
          FROM rem r JOIN addd a ON a.project = r.project AND a.batch_start = r.batch_start AND a.h = r.h),
symbols AS (
  SELECT project, batch_start, path, """ + I.SQL_MODULE + """ AS module, """ + I.SQL_SYMBOL + """ AS name
  FROM (SELECT c.project, c.batch_start, c.path FROM ch c
        WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.project = c.project AND p.batch_start = c.batch_start
                          AND ((c.status = 'added' AND p.path = c.path) OR (c.status = 'removed' AND p.previous_path = c.path)))
        UNION ALL SELECT project, batch_start, path FROM pairs)),
found AS (
  SELECT s.project, s.batch_start, s.path, s.module, arg_min(f.path, (f.rnk, f.path)) AS source_path
  FROM symbols s JOIN (
    SELECT project, path, module, sym, lstem, unnest([1, 100]) AS rnk
    FROM (SELECT project, path, """ + I.SQL_MODULE + """ AS module, """ + I.SQL_SYMBOL + """ AS sym,
                 regexp_replace(split_part(path, '/', 3), '^(.+)\\.[^.]*$', '\\1') AS lstem FROM new_f)) f
  ON f.project = s.project AND f.module = s.module
   AND ((f.rnk = 1 AND f.lstem = lower(s.name)) OR (f.rnk = 100 AND f.sym = s.name))
  GROUP BY ALL),
upd AS (
  SELECT s.project, s.module AS key, arg_max(n.content_hash, (s.batch_start, s.path)) AS hash,
         arg_max(b.batch_end, (s.batch_start, s.path)) AS at
  FROM found s JOIN new_f n ON n.project = s.project AND n.path = s.source_path
  JOIN closed b ON b.key = s.project AND b.batch_start = s.batch_start GROUP BY ALL),
old_state AS (SELECT project, """ + I.SQL_MODULE + """ AS key, max(content_hash) AS last_hash FROM old_f GROUP BY 1, 2),
reports AS (
  SELECT c.key AS project, c.batch_start, count(s.path) AS n_changes, count(DISTINCT s.module) AS n_modules,
         CASE WHEN coalesce(max(CASE WHEN length(s.name) > 0 AND substr(s.name, 1, 1) = upper(substr(s.name, 1, 1)) THEN 2 ELSE 0 END), 0) = 2
              THEN 'high' ELSE 'low' END AS impact_level
  FROM closed c LEFT JOIN symbols s ON s.project = c.key AND s.batch_start = c.batch_start GROUP BY ALL)
"""


@query("sync_stream", "WITH " + SQL_SYNC + f"""
SELECT 'report' AS kind, project, '' AS key, {_sql_ts("batch_start")} AS at, impact_level AS value, n_changes, n_modules FROM reports
UNION ALL
SELECT 'state', coalesce(o.project, u.project), coalesce(o.key, u.key),
       CASE WHEN u.at IS NULL THEN '{I.T_OLD}.000000' ELSE {_sql_ts("u.at")} END, coalesce(u.hash, o.last_hash), NULL, NULL
FROM old_state o FULL OUTER JOIN upd u ON u.project = o.project AND u.key = o.key""")
def sync_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A sync run per closed batch of file events: the report of each batch
    and the state after the last."""
    old = written(I.old_files(spark, sf).select("project", "path", "content_hash"), "sync-old")
    new = written(I.new_files(spark, sf).select("project", "path", "content_hash"), "sync-new")
    state = I.module_state(old, I.T_OLD)
    out = _stream_dir(spark, "sync-run")
    _watch_all(spark, I.file_events(spark, sf), "sync", WATCH_GAP_S, "project", "path",
               on_batches=SY.sync_handler(old, new, state, out))
    report = SY.sync_reports(spark, out).select(
        F.lit("report").alias("kind"), "project", F.lit("").alias("key"), F.date_format("batch_start", TS_FMT).alias("at"),
        F.col("impact_level").alias("value"), "n_changes", "n_modules")
    now = SY.sync_state(state, out).select(
        F.lit("state").alias("kind"), "project", "key", F.date_format("last_synced_at", TS_FMT).alias("at"),
        F.col("last_hash").alias("value"), F.lit(None).cast("long").alias("n_changes"), F.lit(None).cast("long").alias("n_modules"))
    return report.unionByName(now)


# --------------------------------------------------------------------------- S11 G6 F3 A14

from ..sources import sinks as SK  # noqa: E402


@query("status_json", "WITH " + SQL_STATUS + """
SELECT project, CAST(to_json({'project': project, 'n_specs': n_specs, 'active_changes': active_changes,
                         'tracked_entries': tracked_entries, 'last_ref': last_ref, 'last_at': last_at}) AS VARCHAR) AS json
FROM status""")
def status_json(spark: SparkSession, sf: str) -> DataFrame:
    s = _status(spark, sf).select("project", "n_specs", "active_changes", "tracked_entries", "last_ref", "last_at")
    return SK.status_json(s)


@query("call_edges", "WITH " + I.SQL_EDGES + "," + I.SQL_MODULES + f""",
god AS (SELECT project, name FROM modules WHERE n_exports > {I.GOD_THRESHOLD})
SELECT e.project, e.source, e.target, g.name AS symbol FROM edges e JOIN god g ON g.project = e.project AND e.source = g.name
UNION
SELECT e.project, e.source, e.target, g.name FROM edges e JOIN god g ON g.project = e.project AND e.target = g.name""")
def call_edges(spark: SparkSession, sf: str) -> DataFrame:
    m = _modules(spark, sf)
    gods = m.where(F.col("n_exports") > I.GOD_THRESHOLD).select("project", "name")
    return S.call_edges(_edges(spark, sf), gods).select("project", "source", "target", "symbol")


@query("watched_files", "WITH " + I.SQL_SNAPSHOTS + """
SELECT project, path, status FROM changes WHERE path LIKE 'src/%.ts' AND NOT contains(path, '/dist/')""")
def watched_files(spark: SparkSession, sf: str) -> DataFrame:
    changes = snap.diff_snapshots(I.old_files(spark, sf), I.new_files(spark, sf))
    return D.file_events(changes).select("project", "path", "status")


@query("note_counts", """
SELECT lang AS project, source AS kind, count(*) AS n_notes FROM documents GROUP BY 1, 2""")
def note_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = I.table(spark, sf, "documents").select(F.col("lang").alias("project"), F.col("source").alias("kind"))
    return Q.count_by(d, "n_notes", group=["project", "kind"])


@query("forbidden_crossings", "WITH " + SQL_GRAPH + """,
zone AS (SELECT n.n_name AS boundary, r.r_name AS zone FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey)
SELECT c.project, c.route, c.source_boundary, c.module AS target_boundary, 'forbidden_boundary' AS rule,
       'BLOCK' AS severity
FROM core c JOIN zone s ON s.boundary = c.source_boundary JOIN zone t ON t.boundary = c.module
WHERE s.zone <> t.zone""")
def forbidden_crossings(spark: SparkSession, sf: str) -> DataFrame:
    core = S.core_apis(_modules(spark, sf), _edges(spark, sf))
    n = I.table(spark, sf, "nation").select(F.col("n_name").alias("boundary"), "n_regionkey")
    r = I.table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("zone"))
    zones = F.broadcast(n.join(F.broadcast(r), "n_regionkey").select("boundary", "zone"))  # fixed 25-row dimension
    return C.forbidden_crossings(core, zones)


# --------------------------------------------------------------------------- J9 (by extension) J10

@query("languages", SQL_ALL_FILES + """,
ext(ext, language, linter, formatter, style_guide) AS (VALUES
  ('.ts', 'typescript', 'eslint', 'prettier', 'typescript/coding-style.md'),
  ('.py', 'python', 'ruff', 'black', 'python/coding-style.md'),
  ('.go', 'go', 'golangci-lint', 'gofmt', 'go/coding-style.md'),
  ('.rb', 'ruby', 'rubocop', 'standardrb', 'ruby/coding-style.md'),
  ('.java', 'java', 'checkstyle', 'google-java-format', 'java/coding-style.md'))
SELECT f.project, x.language, count(*) AS n_files, x.linter, x.formatter, x.style_guide
FROM files f JOIN ext x ON x.ext = lower(regexp_extract(string_split(f.path, '/')[-1], '(\\.[^.]+)$', 1))
GROUP BY ALL""")
def languages(spark: SparkSession, sf: str) -> DataFrame:
    langs = INV.languages_by_extension(spark, _all_files(spark, sf))
    return INV.language_tools(spark, langs).select("project", "language", "n_files", "linter", "formatter",
                                                   "style_guide")


from . import catalog_projects  # noqa: E402, F401  (registers its queries)
