"""Inputs derived from the driver's tables.

Each derived input exists twice: as a Spark builder (used by the catalogue)
and as SQL text (used by the DuckDB oracle). Both read whole tables; the
rules below only decide which version of a record a snapshot holds.

* Snapshots from ``documents`` (project = ``lang``): every document is a file
  ``src/<source>/<lang>-<doc_id>.ts``. The old snapshot lacks documents with
  ``doc_id % 11 = 0``, the new one those with ``doc_id % 11 = 1`` (so both
  sides have added and removed files, and every document is in one of them at
  least), appends ' v2' to documents with ``doc_id % 7 = 0`` (modified) and
  moves documents with ``doc_id % 17 = 0`` to ``src/dist/`` (renames into a
  folder a watcher ignores).
* Dependency graph from ``lineitem``: within an order, the supplier of each
  line depends on the supplier of the next line (lines ordered by
  line number, part, supplier, ship date, price, quantity); the project is
  the ordering customer. All lines of all orders are used.
* Modules: each (project, supplier) seen in that project's lines; its path is
  ``src/<supplier nation>/<supplier name>`` so the boundary is the supplier's
  nation; its exports are the distinct parts it shipped in that project.
* Module files: one per line, ``<root>/<supplier name>/[lots/<line number>/
  <status>/bulk/]part-<part><extension>``: the root folder follows the return
  flag, lines of more than 45 pieces lie deep, and the extension follows the
  part, one of them of no known language.
* File events from ``events``: event e touches document e / 10 of the new
  snapshot (of the old one if it was removed).
* Page files: the project is host and first path segment, the file the rest of
  the url's path, ``index.html`` for a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Fixed parameters of the derived snapshots and sync runs.
T_OLD = "2024-01-01 00:00:00"
T_NEW = "2024-06-01 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PIECE = 8 << 20  # bytes of Parquet


def pieces(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """Number of partitions that hold about ``PIECE`` bytes of the tables
    each: Spark joins small partitions to some size of compressed shuffle
    data, of which lines take so little that a task would sort millions."""
    size = 0
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(spark.sparkContext.defaultParallelism, size // PIECE + 1)


# --------------------------------------------------------------------------- snapshots

def _doc_path(moved):
    folder = F.when(moved, F.lit("dist")).otherwise(F.col("source"))
    return F.concat(F.lit("src/"), folder, F.lit("/"), F.col("lang"), F.lit("-"),
                    F.col("doc_id").cast("string"), F.lit(".ts"))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path) of every document."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("project"), _doc_path(F.lit(False)).alias("path"))


def old_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("doc_id") % 11 != 0)
    return d.select(F.col("lang").alias("project"), _doc_path(F.lit(False)).alias("path"),
                    F.sha2("text", 256).alias("content_hash"), F.col("doc_id"))


def new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("doc_id") % 11 != 1)
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text"))
    return d.select(F.col("lang").alias("project"), _doc_path(F.col("doc_id") % 17 == 0).alias("path"),
                    F.sha2(text, 256).alias("content_hash"), F.col("doc_id"))


def spec_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the fleet's spec documents: (project, name, text)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("project"),
                    F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"),
                    "text")


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, ts, event_id): every event that touches a document."""
    gone = old_files(spark, sf_dir).where(F.col("doc_id") % 11 == 1)
    files = new_files(spark, sf_dir).unionByName(gone).select("doc_id", "project", "path")
    ev = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                                            F.expr("event_id div 10").alias("doc_id"))
    return ev.join(files, "doc_id").select("project", "path", "ts", "event_id")


SQL_FILE_EVENTS = """
touched AS (SELECT doc_id, project, path FROM new_f UNION ALL SELECT doc_id, project, path FROM old_f WHERE doc_id % 11 = 1),
file_events AS (SELECT d.project, d.path, e.ts, e.event_id FROM events e JOIN touched d ON d.doc_id = e.event_id // 10)
"""


def module_state(files: DataFrame, ts: str) -> DataFrame:
    """Sync state keyed by module: a module's hash is the largest file hash
    in it; every module maps to its spec ``spec-<module>.md``."""
    from ..functions import module_of
    return (files.groupBy("project", module_of("path").alias("key"))
            .agg(F.max("content_hash").alias("last_hash"))
            .select("project", "key", "last_hash", F.lit(ts).cast("timestamp").alias("last_synced_at"),
                    F.array(F.concat(F.lit("spec-"), F.col("key"), F.lit(".md"))).alias("mapped_specs"),
                    F.array().cast("array<string>").alias("mapped_nodes")))


SQL_SNAPSHOTS = """
old_f AS (
  SELECT lang AS project, 'src/' || source || '/' || lang || '-' || CAST(doc_id AS VARCHAR) || '.ts' AS path,
         sha256(text) AS content_hash, doc_id
  FROM documents WHERE doc_id % 11 <> 0),
new_f AS (
  SELECT lang AS project,
         'src/' || CASE WHEN doc_id % 17 = 0 THEN 'dist' ELSE source END || '/' || lang || '-'
           || CAST(doc_id AS VARCHAR) || '.ts' AS path,
         sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' v2' ELSE text END) AS content_hash, doc_id
  FROM documents WHERE doc_id % 11 <> 1),
diff AS (
  SELECT coalesce(o.project, n.project) AS project, coalesce(o.path, n.path) AS path,
         CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
              WHEN o.content_hash <> n.content_hash THEN 'modified' END AS status,
         o.content_hash AS old_hash, n.content_hash AS new_hash
  FROM old_f o FULL OUTER JOIN new_f n ON o.project = n.project AND o.path = n.path),
changes AS (SELECT * FROM diff WHERE status IS NOT NULL)
"""

SQL_DOC_FILES = """
doc_files AS (SELECT lang AS project, 'src/' || source || '/' || lang || '-' || CAST(doc_id AS VARCHAR) || '.ts' AS path
              FROM documents)
"""

# P1 (module of a path) and P2 (symbol of a path) in DuckDB for paths of the
# form used above: the segment after 'src', extension stripped.
SQL_MODULE = "split_part(path, '/', 2)"
SQL_SYMBOL = ("array_to_string(list_transform(regexp_split_to_array(regexp_replace(split_part(path, '/', 3), "
              "'^(.+)\\.[^.]*$', '\\1'), '[-_]'), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), '')")


# --------------------------------------------------------------------------- graph

def handoff_edges(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """Distinct (project, source, target) supplier handoffs, project = the
    ordering customer. Self-loops included (a supplier that
    ships two consecutive lines). ``until``: as of a day, here and below."""
    return _handoffs(spark, sf_dir, until).select("project", "source", "target").distinct()


def _handoffs(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    # lines that tie have the same supplier: what follows in the lines' order cannot change who comes next
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    n = pieces(spark, sf_dir, "lineitem", "orders")
    pairs = (li.repartition(n, "l_orderkey").select("l_orderkey", F.col("l_suppkey").alias("source"),
                                                    F.lead("l_suppkey").over(w).alias("target"))
             .where(F.col("target").isNotNull()))
    return pairs.join(order_days(spark, sf_dir, until).repartition(n, "l_orderkey"), "l_orderkey")


def _with_orders(spark: SparkSession, sf_dir: str, li: DataFrame, until: str | None = None) -> DataFrame:
    """Lines with the project and day of their order."""
    n = pieces(spark, sf_dir, "lineitem", "orders")
    return li.repartition(n, "l_orderkey").join(order_days(spark, sf_dir, until).repartition(n, "l_orderkey"), "l_orderkey")


def order_days(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """(l_orderkey, project, day): every order's customer and date."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("project"),
        F.col("o_orderdate").alias("day"))
    return orders.where(before(until)) if until else orders


def order_project(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """(l_orderkey, project): every order's customer."""
    return order_days(spark, sf_dir, until).select("l_orderkey", "project")


def before(until: str):
    return F.col("day") < F.lit(until).cast("date")


# What is derived once for two runs, now and as of a day: rows with ``early``,
# whether an order before the day has them.

def _early(until: str):
    return F.max(F.coalesce(before(until), F.lit(False))).alias("early")


def dated_edges(spark: SparkSession, sf_dir: str, until: str) -> DataFrame:
    """The edges of ``handoff_edges``: (project, source, target, early)."""
    return _handoffs(spark, sf_dir).groupBy("project", "source", "target").agg(_early(until))


def dated_files(spark: SparkSession, sf_dir: str, until: str) -> DataFrame:
    """The files of ``module_files``: (project, file, early)."""
    return module_file_lines(spark, sf_dir).groupBy("project", "file").agg(_early(until))


def dated_names(spark: SparkSession, sf_dir: str, until: str) -> DataFrame:
    """The modules of ``supplier_modules`` by name: (project, name, early)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    per = _with_orders(spark, sf_dir, li).groupBy("project", F.col("l_suppkey").alias("name")).agg(_early(until))
    return _located(spark, sf_dir, per).drop("path")


def dated_modules(spark: SparkSession, sf_dir: str, until: str) -> DataFrame:
    """The modules of ``supplier_modules``, and their exports as of the day:
    (project, name, path, n_exports, n_before, early)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    parts = (_with_orders(spark, sf_dir, li)
             .groupBy("project", F.col("l_suppkey").alias("name"), "l_partkey").agg(_early(until)))
    per = parts.groupBy("project", "name").agg(
        F.count("l_partkey").alias("n_exports"), F.count(F.when(F.col("early"), F.col("l_partkey"))).alias("n_before"),
        F.max("early").alias("early"))
    return _located(spark, sf_dir, per)


SQL_EDGES = """
order_project AS (
  SELECT o_orderkey AS l_orderkey, 'customer-' || CAST(o_custkey AS VARCHAR) AS project FROM orders),
handoffs AS (
  SELECT l_orderkey, l_suppkey AS source,
         lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                               l_shipdate, l_extendedprice, l_quantity) AS target
  FROM lineitem),
edges AS (
  SELECT DISTINCT p.project, h.source, h.target
  FROM handoffs h JOIN order_project p ON p.l_orderkey = h.l_orderkey
  WHERE h.target IS NOT NULL)
"""


# --------------------------------------------------------------------------- modules

GOD_THRESHOLD = 1  # exports above which a supplier module counts as oversized here


def supplier_modules(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """(project, name, path, n_exports): one module per supplier seen in a
    project's lines; exports = distinct parts it shipped there."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    per = (_with_orders(spark, sf_dir, li, until)
           .groupBy("project", F.col("l_suppkey").alias("name"))
           .agg(F.countDistinct("l_partkey").alias("n_exports")))
    return _located(spark, sf_dir, per)


def _located(spark: SparkSession, sf_dir: str, per: DataFrame) -> DataFrame:
    """Modules with their path: (project, name, path, ...)."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), "s_name", "s_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    sn = s.join(F.broadcast(n), "s_nationkey")
    return per.join(sn, "name").select("project", "name", F.concat_ws("/", F.lit("src"), "n_name", "s_name").alias("path"),
                                       *[c for c in per.columns if c not in ("project", "name")])


SQL_MODULES = """
modules AS (
  SELECT p.project, l.l_suppkey AS name, 'src/' || n.n_name || '/' || s.s_name AS path,
         count(DISTINCT l.l_partkey) AS n_exports
  FROM lineitem l JOIN order_project p ON p.l_orderkey = l.l_orderkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey
  GROUP BY p.project, l.l_suppkey, n.n_name, s.s_name)
"""


# Fixed choices of the derived module files.
ROOTS = {"A": "lib", "N": "src", "R": "app"}
EXTENSIONS = [".ts", ".py", ".go", ".rb", ".java", ".xyz"]


def module_files(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """Distinct (project, file): one file per line of an order."""
    return module_file_lines(spark, sf_dir, until).select("project", "file").distinct()


def module_file_lines(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                                 "l_returnflag", "l_linestatus")
    root = F.create_map(*[F.lit(x) for kv in ROOTS.items() for x in kv])[F.col("l_returnflag")]
    ext = F.array(*[F.lit(x) for x in EXTENSIONS])[F.pmod(F.col("l_partkey"), F.lit(len(EXTENSIONS))).cast("int")]
    deep = F.concat(F.lit("lots/"), F.col("l_linenumber").cast("string"), F.lit("/"), "l_linestatus", F.lit("/bulk/"))
    folder = F.when(F.col("l_quantity") > 45, deep).otherwise("")
    file = F.concat(root, F.lit("/supplier-"), F.col("l_suppkey").cast("string"), F.lit("/"), folder, F.lit("part-"),
                    F.col("l_partkey").cast("string"), ext)
    return _with_orders(spark, sf_dir, li, until).select("project", file.alias("file"), "l_quantity", "day")


SQL_FILES = """
module_file_lines AS (
  SELECT l.l_quantity, p.project,
         CASE l.l_returnflag WHEN 'A' THEN 'lib' WHEN 'N' THEN 'src' WHEN 'R' THEN 'app' END
           || '/supplier-' || CAST(l.l_suppkey AS VARCHAR) || '/'
           || CASE WHEN l.l_quantity > 45
                   THEN 'lots/' || CAST(l.l_linenumber AS VARCHAR) || '/' || l.l_linestatus || '/bulk/' ELSE '' END
           || 'part-' || CAST(l.l_partkey AS VARCHAR)
           || CASE l.l_partkey % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' WHEN 3 THEN '.rb'
                                   WHEN 4 THEN '.java' ELSE '.xyz' END AS file
  FROM lineitem l JOIN order_project p ON p.l_orderkey = l.l_orderkey),
module_files AS (SELECT DISTINCT project, file FROM module_file_lines)
"""


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as file trees: (project = host/first segment, file = rest of
    the URL path, 'index.html' for a folder), query and fragment dropped."""
    return table(spark, sf_dir, "pages").select(*_page_parts()).withColumnRenamed("path", "file").distinct()


def _page_parts():
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    first = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^/?#]*)", 1)
    rest = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/[^/?#]*/?([^?#]*)", 1)
    rest = F.when(rest.endswith("/") | (rest == ""), F.concat(rest, F.lit("index.html"))).otherwise(rest)
    return F.concat(host, F.lit("/"), first).alias("project"), rest.alias("path")


SQL_PAGE_FILES = """
page_parts AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/' || regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1) AS project,
         regexp_extract(url, '^[a-z]+://[^/?#]+/[^/?#]*/?([^?#]*)', 1) AS rest, strlen(html) AS bytes FROM pages),
page_files AS (
  SELECT DISTINCT project, CASE WHEN ends_with(rest, '/') OR rest = '' THEN rest || 'index.html' ELSE rest END AS file
  FROM page_parts)
"""


def sized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, size): page files with the bytes of their pages, and
    module files with the pieces on their lines."""
    p = table(spark, sf_dir, "pages")
    pages = (p.select(*_page_parts(), F.octet_length("html").cast("long").alias("size"))
             .groupBy("project", "path").agg(F.sum("size").alias("size")))
    lines = module_file_lines(spark, sf_dir).repartition(pieces(spark, sf_dir, "lineitem", "orders"), "project", "file")
    lines = lines.groupBy("project", F.col("file").alias("path")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("size"))
    return pages.unionByName(lines)


SQL_SIZED_FILES = """
sized_files AS (
  SELECT project, CASE WHEN ends_with(rest, '/') OR rest = '' THEN rest || 'index.html' ELSE rest END AS path,
         CAST(sum(bytes) AS BIGINT) AS size FROM page_parts GROUP BY 1, 2
  UNION ALL
  SELECT project, file, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) FROM module_file_lines GROUP BY 1, 2)
"""
