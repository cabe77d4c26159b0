"""Report, guarded-document and status sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_reports(report: DataFrame, lines: DataFrame, path: str, run_id: str, fmt: str = "json") -> None:
    """S8: one report header per project plus its change lines, partitioned by
    run. Every run keeps its own report; repeating a run replaces that run's
    only. Rows are ordered by project over the run's files, so the number of
    files follows from the size of the run and not from that of the fleet, and
    a project is found in one file, or in a few neighbours if it is large."""
    for name, rows in (("header", report), ("lines", lines)):
        order = ["project", *[c for c in rows.columns if c != "project"]]
        (rows.withColumn("run", F.lit(run_id)).orderBy(*order).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("run").format(fmt).save(f"{path}/{name}"))


def write_guarded(decisions: DataFrame, path: str, version: int, content_col: str = "content") -> DataFrame:
    """S9: append the documents whose action is 'written' as rows of a
    version; nothing that stands in the table is touched, so a skipped
    document and a document outside the run stay as they are. Repeating a
    version replaces that version's rows. Returns the (project, name, action)
    report, read from what was decided, which is stored beside the documents."""
    report = f"{path}/decisions"
    (decisions.select("project", "name", "action", content_col).withColumn("version", F.lit(version))
     .hint("rebalance", "project").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("version").parquet(report))
    mine = decisions.sparkSession.read.parquet(report).where(F.col("version") == version)
    (mine.where(F.col("action") == "written").select("project", "name", content_col, "version")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("version").parquet(f"{path}/documents"))
    return mine.select("project", "name", "action")


def latest_documents(documents: DataFrame, content_col: str = "content") -> DataFrame:
    """The newest version of every document of a table of versions
    (project, name, content, version); one aggregation per document."""
    newest = F.max(F.struct("version", content_col))[content_col].alias(content_col)
    return documents.groupBy("project", "name").agg(newest)


def status_json(status: DataFrame) -> DataFrame:
    """S11: one JSON text per project row."""
    return status.select("project", F.to_json(F.struct(*[F.col(c) for c in status.columns])).alias("json"))
