"""A keyed table in hash buckets with copy-on-write versions.

A row's bucket is a hash of its bucket columns, so the number of files
follows from the number of buckets and not from the number of projects. A
version rewrites the buckets it touches and no other: it reads their rows,
writes them anew below its own folder, and ends with a small pointer table
that names the version each bucket is to be read from. A reader looks at one
pointer table and at one file per bucket, however many versions there are. A
version that is written again (a replayed micro-batch) starts from the same
version before it and gives the same table.

Layout: ``<path>/version=<v>/bucket=<b>/...`` and ``<path>/_pointers/<v>``. A
crowded bucket, as of a project with a third of all rows, is split into
several files when it is written (rebalance); it is still one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store; none if it is missing."""
    fs, jpath = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(jpath)] if fs.exists(jpath) else []


class BucketTable:
    """``schema`` without the columns ``bucket`` and ``version``. ``by``:
    columns whose hash is the bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: Sequence[str] = ("project",),
                 buckets: int = 64):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.by, self.buckets = list(by), buckets

    # --- versions

    def _done(self, version: int) -> bool:
        return path_exists(self.spark, f"{self.path}/_pointers/{version}/_SUCCESS")

    def versions(self) -> list[int]:
        names = child_names(self.spark, f"{self.path}/_pointers")
        return sorted(int(n) for n in names if n.isdigit() and self._done(int(n)))

    def latest(self, before: int | None = None) -> int | None:
        """The newest version, or the newest before one: looked for step by
        step, so the folder of all versions is not listed."""
        if before is None:
            return max(self.versions(), default=None)
        return next((v for v in range(before - 1, -1, -1) if self._done(v)), None)

    def _pointers(self, version: int | None) -> dict[int, int]:
        if version is None:
            return {}
        rows = self.spark.read.schema("bucket int, version long, buckets int").parquet(f"{self.path}/_pointers/{version}").collect()
        if any(r["buckets"] != self.buckets for r in rows):
            raise ValueError(f"{self.path} has {rows[0]['buckets']} buckets, not {self.buckets}")
        return {r["bucket"]: r["version"] for r in rows if r["bucket"] >= 0}

    # --- rows

    def bucket(self):
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The rows as of a version (default: the newest), of all buckets or
        of some."""
        version = self.latest() if version is None else version
        found = self._pointers(version)
        paths = [f"{self.path}/version={v}/bucket={b}" for b, v in sorted(found.items()) if only is None or b in set(only)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _write(self, rows: DataFrame, version: int, pointers: dict[int, int]) -> None:
        names = self.schema.names
        (rows.select(*names, self.bucket().alias("bucket")).hint("rebalance", "bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/version={version}"))
        there = [n.removeprefix("bucket=") for n in child_names(self.spark, f"{self.path}/version={version}")]
        pointers |= {int(n): version for n in there if n.isdigit()}
        lines = [(b, v, self.buckets) for b, v in sorted(pointers.items())] or [(-1, version, self.buckets)]
        (self.spark.createDataFrame(lines, "bucket int, version long, buckets int").coalesce(1).write.mode("overwrite")
         .parquet(f"{self.path}/_pointers/{version}"))

    def write(self, rows: DataFrame, version: int) -> None:
        """Full replace."""
        self._write(rows, version, {})

    def merge(self, updates: DataFrame, version: int, how: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """A new version in which the buckets that ``updates`` touch (rows
        with the bucket columns) hold ``how(their rows, updates)``. Returns
        these buckets; at most ``buckets`` numbers come to the driver."""
        base = self.latest(before=version)
        touched = sorted(r[0] for r in updates.select(self.bucket()).distinct().collect())
        pointers = {b: v for b, v in self._pointers(base).items() if b not in set(touched)}
        current = self.read(base, touched) if base is not None else self.spark.createDataFrame([], self.schema)
        self._write(how(current, updates), version, pointers)
        return touched

    def vacuum(self, keep: int) -> list[int]:
        """Delete the versions that none of the newest ``keep`` needs; returns
        them."""
        versions = self.versions()
        needed = set(versions[-keep:]) | {v for n in versions[-keep:] for v in self._pointers(n).values()}
        gone = [v for v in versions if v not in needed]
        for v in versions[:-keep]:
            fs, jpath = _fs(self.spark, f"{self.path}/_pointers/{v}")
            fs.delete(jpath, True)
        for v in gone:
            fs, jpath = _fs(self.spark, f"{self.path}/version={v}")
            fs.delete(jpath, True)
        return gone
