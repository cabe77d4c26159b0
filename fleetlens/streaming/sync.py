"""T4: a sync run per debounced batch.

``sync_handler`` builds the function that the watcher calls with the items of
the batches a micro-batch has closed: each batch's paths are looked up in both
snapshots, then symbols, the impact report and the state upsert run on just
those changes, for all batches of the micro-batch in one job.

Per epoch the report (``report/epoch=<n>``) and the entries that changed
(``state/epoch=<n>``) are written with overwrite semantics, so a replayed
batch rewrites the same result. The state itself is a table in hash buckets of
(project, key) with copy-on-write versions (``table``): an epoch reads one
pointer table and the buckets its entries fall into, and rewrites those;
neither grows with the number of epochs. A new handler on the same folder, as
after a restart, goes on where the last one stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import impact as imp
from ..operators import snapshot as snap
from ..sources.buckets import BucketTable, path_exists
from ..sources.state import state_table

KEYS = ["project", "key"]


def _table(like: DataFrame, out_dir: str, buckets: int) -> BucketTable:
    table = state_table(like.sparkSession, f"{out_dir}/table", buckets, by=tuple(KEYS))
    table.schema = like.select(*KEYS, *[c for c in like.columns if c not in KEYS]).schema
    return table


def sync_state(initial: DataFrame, out_dir: str, before_epoch: int | None = None, buckets: int = 64) -> DataFrame:
    """The sync state after all epochs, or after those before one. Version 0
    of the table is the initial state, version n + 1 that after epoch n."""
    table = _table(initial, out_dir, buckets)
    version = table.latest(None if before_epoch is None else before_epoch + 1)
    return initial if version is None else table.read(version).select(*initial.columns)


REPORT = ("project string, batch_start timestamp, impact_level string, n_changes long, n_modules long, n_specs long, "
          "summary string, epoch int")


def sync_reports(spark: SparkSession, out_dir: str) -> DataFrame:
    """The reports of all epochs of batches so far; none when no batch has
    been closed yet, as while no project was ever quiet."""
    if not path_exists(spark, f"{out_dir}/report"):
        return spark.createDataFrame([], REPORT)
    return spark.read.schema(REPORT).parquet(f"{out_dir}/report")


def sync_handler(old: DataFrame | Callable[[], DataFrame], new: DataFrame | Callable[[], DataFrame],
                 state: DataFrame, out_dir: str, run_ts: str | None = None,
                 buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """``old``/``new``: snapshots (project, path, content_hash), or functions
    that return the ones to compare when a batch arrives - a table read once
    keeps the files it was read with, so a long-running watcher passes
    functions. ``state``: the module-keyed sync state before the first epoch.
    Batch rows are (project, batch_start, batch_end, path), one row per path;
    or (project, items array of paths), one batch per project and call, synced
    at ``run_ts``."""
    def latest(snapshot):
        return snapshot() if callable(snapshot) else snapshot

    def handle(batch: DataFrame, epoch: int) -> None:
        before, after = latest(old), latest(new)
        per_batch = "batch_start" in batch.columns
        own = ["batch_start"] if per_batch else []
        group = ["project", *own]
        paths = batch if "path" in batch.columns else batch.withColumn("path", F.explode("items"))
        paths = paths.select(*group, "path", *(["batch_end"] if per_batch else [])).distinct()
        changes = snap.diff_at(paths.select(*group, "path"), before, after)
        symbols = snap.symbols_from_changes(snap.pair_renames(changes, group), extra=own)
        report = imp.impact_report(symbols, projects=paths, group=group)
        src = snap.infer_source_files(symbols, after.select("project", "path"), extra=own)
        upd = src.join(after.select("project", F.col("path").alias("source_path"), "content_hash"), ["project", "source_path"])
        if per_batch:
            ends = paths.select(*group, "batch_end").distinct()
            upd = upd.join(ends, group)
        upd = upd.select("project", F.col("module").alias("key"), F.col("content_hash").alias("hash"),
                         F.struct(*own, "path").alias("ordinal"),
                         (F.col("batch_end") if per_batch else F.lit(run_ts).cast("timestamp")).alias("synced_at"))
        report.write.mode("overwrite").parquet(f"{out_dir}/report/epoch={epoch}")

        table = _table(state, out_dir, buckets)
        if table.latest(before=epoch + 1) is None:
            table.write(state, 0)
        spark = state.sparkSession
        changed = f"{out_dir}/state/epoch={epoch}"
        names = table.schema.names

        def upserted(current: DataFrame, updates: DataFrame) -> DataFrame:
            touched = current.join(updates.select(*KEYS).distinct(), KEYS, "left_semi")
            snap.upsert_state(touched, updates, None).select(*names).write.mode("overwrite").parquet(changed)
            entries = spark.read.schema(table.schema).parquet(changed)
            return current.join(entries.select(*KEYS), KEYS, "left_anti").select(*names).unionByName(entries)
        table.merge(upd, epoch + 1, upserted)
    return handle
