"""The watcher as an append-only stream: events -> cells -> batches -> items.

``watch_source`` reads event files as they arrive, from a start position on
(what lay there before is no event), through the include and ignore rules.

A debounced batch ends when its key has been quiet for longer than the gap.
Nothing in the stream's state holds a batch or its items: the state has one
row per (key, item, cell of one gap's width), which the watermark closes and
drops, so a key that is never quiet holds no more rows than its items within
the watermark's delay. All events of a key in one cell are less than a gap
apart, hence in one batch, so whole cells are what a batch is made of. Each
micro-batch of closed cells

1. is written to the cell log, ``cells/epoch=<n>``;
2. is merged with the open batches that the micro-batch before it left, one
   row per key (``spans/epoch=<n>/done=false``);
3. closes the batches that no later cell can reach, which is known from the
   newest complete cell of any key (``spans/epoch=<n>/done=true``);
4. gives their items, from the log of the epochs they spread over, by an equi
   join on (key, cell): ``items/epoch=<n>``, one row per batch and item with
   the time it was first seen and the number of its events;
5. is handed to the caller, e.g. a sync run (``sync.sync_handler``).

Every write names its epoch and overwrites it, so a replayed micro-batch
gives the same tables. A hot key is split by item and cell everywhere; its
batches are merged per day first. Events later than the watermark allows are
dropped, as in any windowed stream.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.buckets import path_exists
from .debounce import keep_failures, merge_spans, source_filter

DAY = 86_400 * 1_000_000


# --- T1 -------------------------------------------------------------------

def start_position(spark: SparkSession, folder: str) -> datetime | None:
    """The newest modification time of the files in ``folder``: a stream that
    starts behind it takes them as known."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.agg(F.max("modificationTime")).first()[0]


def watch_source(spark: SparkSession, folder: str, schema: T.StructType | str, since: datetime | None = None,
                 files_per_trigger: int | None = None, path_col: str = "path", **rules) -> DataFrame:
    """T1: the stream of watched file events (Parquet event files below
    ``folder``), without those in files up to ``since``. Include and ignore
    rules hold before anything is kept in state."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    events = reader.parquet(folder)
    if since is not None:
        events = events.where(F.col("_metadata.file_modification_time") > F.lit(since))
    return events.where(source_filter(path_col, **rules))


# --- T2, T3 ---------------------------------------------------------------

def item_cells(events: DataFrame, gap_seconds: int, watermark: str | None, key: str = "project", item: str = "path",
               ts: str = "ts") -> DataFrame:
    """(key, item, cell, first_seen, last_seen, n_events) per key, item and
    cell of ``gap_seconds``. On a stream with a watermark, in append mode, a
    cell appears once, when it is complete."""
    events = events.select(F.col(key).alias("key"), F.col(item).alias("item"), F.col(ts).cast("timestamp").alias("ts"))
    events = events.where(F.col("ts").isNotNull())
    if watermark:
        events = events.withWatermark("ts", watermark)
    cells = events.groupBy(F.window("ts", f"{gap_seconds} seconds").alias("w"), "key", "item").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n_events"))
    at = F.floor(F.unix_micros("w.start") / (gap_seconds * 1_000_000))
    return cells.select("key", "item", at.alias("cell"), "first_seen", "last_seen", "n_events")


def batch_spans(cells: DataFrame, gap_seconds: int, before: DataFrame | None = None, epoch: int = 0) -> DataFrame:
    """(key, batch_start, batch_end, n_events, first_epoch): the batches that
    ``cells`` and the open batches ``before`` make. The spans of ``before``
    must end before the first of the cells."""
    spans = cells.groupBy("key", "cell").agg(
        F.min("first_seen").alias("_start"), F.max("last_seen").alias("_end"), F.sum("n_events").alias("_n"),
        F.lit(epoch).cast("long").alias("first_epoch")).drop("cell")
    spans = spans.withColumns({"_first": F.unix_micros("_start"), "_last": F.unix_micros("_end")})
    if before is not None:  # all of an open batch lies where it ends
        spans = spans.unionByName(before.select(
            "key", F.col("batch_start").alias("_start"), F.col("batch_end").alias("_end"), F.col("n_events").alias("_n"),
            "first_epoch", F.unix_micros("batch_end").alias("_first"), F.unix_micros("batch_end").alias("_last")))
    whole = merge_spans(spans, ["key"], gap_seconds * 1_000_000, more={"first_epoch": F.min("first_epoch")})
    return whole.select("key", F.col("_start").alias("batch_start"), F.col("_end").alias("batch_end"),
                        F.col("_n").alias("n_events"), "first_epoch")


def batch_items(batches: DataFrame, cells: DataFrame, gap_seconds: int) -> DataFrame:
    """T3: (key, batch_start, batch_end, item, first_seen, n_events): the
    distinct items of each batch. A batch is laid out over its cells, a day's
    worth at a time, at most two for each that has events, and meets them by
    an equi join."""
    gap = gap_seconds * 1_000_000
    piece = max(1, DAY // gap)  # cells of a day

    def number(ts: str):
        return F.floor(F.unix_micros(ts) / gap)

    laid = batches.select("key", "batch_start", "batch_end", number("batch_start").alias("_low"), number("batch_end").alias("_high"))
    laid = laid.withColumn("_piece", F.explode(F.sequence(F.floor(F.col("_low") / piece), F.floor(F.col("_high") / piece))))
    laid = laid.select(F.col("key").alias("_key"), "batch_start", "batch_end", F.explode(F.sequence(
        F.greatest("_low", F.col("_piece") * piece), F.least("_high", (F.col("_piece") + 1) * piece - 1))).alias("_cell"))
    met = cells.join(laid, F.col("key").eqNullSafe(F.col("_key")) & (F.col("cell") == F.col("_cell")))
    return met.groupBy("key", "batch_start", "batch_end", "item").agg(
        F.min("first_seen").alias("first_seen"), F.sum("n_events").alias("n_events"))


# --- the stream -----------------------------------------------------------

CELLS = "key string, item string, cell long, first_seen timestamp, last_seen timestamp, n_events long"
SPANS = "key string, batch_start timestamp, batch_end timestamp, n_events long, first_epoch long"
ITEMS = "key string, batch_start timestamp, batch_end timestamp, item string, first_seen timestamp, n_events long"


def _epoch_before(spark: SparkSession, path: str, epoch: int) -> int | None:
    return next((e for e in range(epoch - 1, -1, -1) if path_exists(spark, f"{path}/epoch={e}/_SUCCESS")), None)


def close_batches(cells: DataFrame, epoch: int, out_dir: str, gap_seconds: int) -> tuple[DataFrame, DataFrame]:
    """One micro-batch of complete cells: returns the (batches, items) that it
    closes. Three jobs, one for each table it writes; a micro-batch without
    cells leaves everything as it is."""
    spark, gap = cells.sparkSession, gap_seconds * 1_000_000
    nothing = spark.createDataFrame([], SPANS), spark.createDataFrame([], ITEMS)

    def written(df: DataFrame, name: str, metric, *by: str):
        """Write an epoch's table and take a number on the way."""
        obs, path = Observation(), f"{out_dir}/{name}/epoch={epoch}"
        (df.observe(obs, metric.alias("m")).write.mode("overwrite").option("partitionOverwriteMode", "static")
         .partitionBy(*by).parquet(path))
        return obs.get["m"], path

    newest, path = written(cells.select("key", "item", "cell", "first_seen", "last_seen", "n_events"), "cells", F.max("cell"))
    if newest is None:
        return nothing
    cells = spark.read.schema(CELLS).parquet(path)
    last = _epoch_before(spark, f"{out_dir}/spans", epoch)
    before = None if last is None else _spans(spark, f"{out_dir}/spans/epoch={last}", False)
    done = F.unix_micros("batch_end") + gap < (newest + 1) * gap  # later cells start there or after
    spans = batch_spans(cells, gap_seconds, before, epoch).withColumn("done", done)
    first, path = written(spans, "spans", F.min(F.when(F.col("done"), F.col("first_epoch"))), "done")
    if first is None:
        return nothing
    batches = _spans(spark, path, True)
    log = [f"{out_dir}/cells/epoch={e}" for e in range(first, epoch + 1) if path_exists(spark, f"{out_dir}/cells/epoch={e}")]
    items = batch_items(batches, spark.read.schema(CELLS).parquet(*log), gap_seconds)
    _, path = written(items, "items", F.count(F.lit(1)))
    return batches, spark.read.schema(ITEMS).parquet(path)


def _spans(spark: SparkSession, path: str, done: bool) -> DataFrame:
    """The closed or the open batches of an epoch (or of all)."""
    return spark.read.schema(f"{SPANS}, epoch long, done boolean").parquet(path).where(F.col("done") == done).drop("done")


def watch(events: DataFrame, out_dir: str, gap_seconds: int, watermark: str, checkpoint: str, key: str = "project",
          item: str = "path", ts: str = "ts", on_batches: Callable[[DataFrame, int], None] | None = None,
          trigger: dict | None = None) -> StreamingQuery:
    """T2 to T5: run the watcher on a stream of events. ``on_batches`` gets
    the items of the batches that a micro-batch closed, with ``key`` and
    ``item`` under their own names, and the epoch; a batch on which it fails
    is kept below ``<checkpoint>-failures`` and does not stop the watcher."""
    guarded = on_batches and keep_failures(on_batches, f"{checkpoint.rstrip('/')}-failures")

    def handle(cells: DataFrame, epoch: int) -> None:
        _, items = close_batches(cells, epoch, out_dir, gap_seconds)
        if guarded and not items.isEmpty():
            guarded(items.withColumnsRenamed({"key": key, "item": item}), epoch)

    cells = item_cells(events, gap_seconds, watermark, key, item, ts)
    cells = cells.withColumns({"key": F.col("key").cast("string"), "item": F.col("item").cast("string")})
    return (cells.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle)
            .trigger(**(trigger or {"availableNow": True})).start())


def watched(spark: SparkSession, out_dir: str, name: str = "items") -> DataFrame:
    """The closed ``batches`` of all epochs so far, or their ``items``."""
    path, schema = (f"{out_dir}/spans", SPANS) if name == "batches" else (f"{out_dir}/items", ITEMS)
    if not path_exists(spark, path):  # nothing has been written yet
        return spark.createDataFrame([], f"{schema}, epoch long")
    return _spans(spark, path, True) if name == "batches" else spark.read.schema(f"{schema}, epoch long").parquet(path)
