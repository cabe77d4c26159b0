"""File-tree and document readers.

``read_tree`` lists and hashes a tree of project folders with the
``binaryFile`` source (distributed listing and reading); only the hash and
size leave the scan, so content never reaches a shuffle. For large fleets
the usual input is a snapshot table (parquet, bucketed or partitioned by
project) with the same columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Source roots scanned for modules.
SCAN_ROOTS = ["src", "lib", "app", "source"]


def read_tree(spark: SparkSession, root: str, ref: str | None = None, roots: Sequence[str] | None = None,
              glob: str | None = None) -> DataFrame:
    """S1: files below ``root/<project>/...`` as (project, ref, path,
    content_hash, size). Unreadable or missing folders give no rows.
    ``roots`` keeps only paths whose first folder is one of them."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root)
    base = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^file:", ""), "^" + _re_escape(base.replace("file:", "")), "")
    parts = F.split(rel, "/", 2)
    out = df.select(F.try_element_at(parts, F.lit(1)).alias("project"), F.lit(ref).cast("string").alias("ref"),
                    F.try_element_at(parts, F.lit(2)).alias("path"), F.sha2("content", 256).alias("content_hash"),
                    F.col("length").alias("size"))
    out = out.where(F.col("path").isNotNull())
    if roots:
        out = out.where(F.try_element_at(F.split("path", "/"), F.lit(1)).isin(list(roots)))
    return out


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def read_docs(spark: SparkSession, folder: str, kind: str, project: str | None = None,
              glob: str = "*.md", strip_extension: bool = False) -> DataFrame:
    """S3/S4: whole-text documents of a folder (not recursive) as (project,
    kind, name, text); a missing folder gives an empty table."""
    schema = "project string, kind string, name string, text string"
    try:
        df = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(folder)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise
    name = F.try_element_at(F.split(F.col("_metadata.file_path"), "/"), F.lit(-1))
    if strip_extension:
        name = F.regexp_replace(name, r"\.md$", "")
    return df.select(F.lit(project).cast("string").alias("project"), F.lit(kind).alias("kind"),
                     name.alias("name"), F.col("value").alias("text"))


def write_snapshot(df: DataFrame, table_name: str, buckets: int, keys: Sequence[str] = ("project", "path"),
                   mode: str = "overwrite") -> None:
    """Save a snapshot (project, path, content_hash, ...) as a table bucketed
    and sorted on ``keys``. Two snapshots saved with the same bucket count
    are diffed by a sort-merge join without any shuffle: every later diff
    reads the buckets side by side."""
    keys = list(keys)
    (df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table_name))
