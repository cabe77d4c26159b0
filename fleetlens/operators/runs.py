"""Findings and measures kept per run, and compared between runs.

A run writes its tables below ``<path>/<table>/run=<n>`` and is committed by a
marker behind all of them; a run that failed half-way is none. Whatever is
derived from a run (health, verdict, reports, comparison with the run before)
reads the stored tables, so the graph is searched once a run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.buckets import child_names, path_exists


def files_digest(spark: SparkSession, paths: Sequence[str]) -> str:
    """Digest of the names, sizes and times of the files at ``paths``: equal
    as long as the tables are the same."""
    seen = []
    for path in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(jpath, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


class RunStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def committed(self, run: int) -> bool:
        return path_exists(self.spark, f"{self.path}/_runs/{run}/_SUCCESS")

    def last(self, before: int | None = None) -> int | None:
        """The newest committed run, or the newest before one."""
        runs = [int(n) for n in child_names(self.spark, f"{self.path}/_runs") if n.isdigit()]
        return max((r for r in runs if (before is None or r < before) and self.committed(r)), default=None)

    def commit(self, run: int, tables: dict[str, DataFrame]) -> None:
        """Write a run; writing it again replaces it."""
        for name, df in tables.items():
            (df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{self.path}/{name}/run={run}"))
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_runs/{run}")

    def read(self, name: str, run: int) -> DataFrame:
        if not self.committed(run):
            raise ValueError(f"run {run} is not committed")
        return self.spark.read.parquet(f"{self.path}/{name}/run={run}")


def compare_runs(now: DataFrame, before: DataFrame, keys: Sequence[str] = ("project", "rule", "subject"),
                 carry: Sequence[str] = ("severity",)) -> DataFrame:
    """Every finding of either run with ``state``: new, resolved or kept.
    One aggregation over both runs (no join); ``carry`` comes from the newest
    run that has the finding."""
    keys, carry = list(keys), list(carry)
    both = (now.select(*keys, F.struct(F.lit(1).alias("run"), *carry).alias("f"))
            .unionByName(before.select(*keys, F.struct(F.lit(0).alias("run"), *carry).alias("f"))))
    state = (F.when(F.col("oldest") == 1, "new").when(F.col("newest.run") == 0, "resolved").otherwise("kept"))
    return (both.groupBy(*keys).agg(F.max("f").alias("newest"), F.min("f.run").alias("oldest"))
            .select(*keys, *[F.col(f"newest.{c}").alias(c) for c in carry], state.alias("state")))


def approaching(now: DataFrame, before: DataFrame, measure: str, threshold: int, near: float = 0.8,
                keys: Sequence[str] = ("project", "name")) -> DataFrame:
    """What has not passed ``threshold`` but lies within its last part and has
    grown since the run before: (keys, now, before). A key that the run before
    did not have had 0."""
    keys = list(keys)
    close = now.where((F.col(measure) <= threshold) & (F.col(measure) >= near * threshold)).select(*keys, F.col(measure).alias("now"))
    was = before.select(*keys, F.col(measure).alias("before"))
    j = close.join(was, keys, "left").withColumn("before", F.coalesce("before", F.lit(0)))
    return j.where(F.col("now") > F.col("before"))
