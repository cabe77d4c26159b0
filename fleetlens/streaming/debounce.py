"""Debounced change batches from a file-event stream.

A batch closes after a quiet period: every event restarts the timer. In
event time that is a session window with the quiet period as gap, which
Structured Streaming runs with a watermark and keeps in its state store
(a RocksDB provider is advised for long gaps on a cluster). Micro-batches
run one after the other, so two sync runs never overlap.

``sessionize`` is the batch twin. It does not put a hot key's events in one
task: events are first counted per (key, cell of one gap's width), cells are
sessionized per (key, time bucket), and only the partial sessions that touch a
bucket border (at most two per bucket) are merged.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import ensure_checkpoint_dir

# Watched source extensions, ignored folders, default quiet
# period. The tool's own state, vault and spec folders are parameters.
SOURCE_EXTENSIONS = ["ts", "tsx", "js", "jsx", "py", "go", "rs", "java", "kt", "rb", "php", "cs", "swift", "c",
                     "cpp", "h", "hpp"]
IGNORED_DIRS = ["node_modules", ".git", "dist", "build"]
DEBOUNCE = "500 milliseconds"


def source_filter(path_col: str = "path", extra_ignored_dirs: Sequence[str] = (),
                  extra_patterns: Sequence[str] = ()):
    """Column predicate: a file below ``src/`` with a watched extension and
    no ignored folder on its path. ``extra_patterns`` are regexes that also
    exclude a path."""
    include = r"^src/(.+/)?[^/]+\.(" + "|".join(SOURCE_EXTENSIONS) + r")$"
    dirs = [d.replace(".", r"\.") for d in list(IGNORED_DIRS) + list(extra_ignored_dirs)]
    exclude = r"(^|/)(" + "|".join(dirs) + r")(/|$)"
    cond = F.col(path_col).rlike(include) & ~F.col(path_col).rlike(exclude)
    for p in extra_patterns:
        cond = cond & ~F.col(path_col).rlike(p)
    return cond


def file_events(events: DataFrame, path_col: str = "path", **kw) -> DataFrame:
    """T1: the events of watched files (any event kind)."""
    return events.where(source_filter(path_col, **kw))


def debounced_batches(events: DataFrame, gap: str = DEBOUNCE, watermark: str | None = None,
                      keys: Sequence[str] = ("project",), ts_col: str = "ts", item_col: str = "path") -> DataFrame:
    """T2/T3: one row per batch (session of events with quiet periods shorter
    than or equal to ``gap``): keys, first and last event time, number of
    events and the sorted distinct items. Works on batch and streaming
    DataFrames; a streaming input needs ``watermark``."""
    ev = events.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    if watermark:
        ev = ev.withWatermark(ts_col, watermark)
    return (ev.groupBy(F.session_window(ts_col, gap).alias("batch"), *keys)
            .agg(F.min(ts_col).alias("first_ts"), F.max(ts_col).alias("last_ts"),
                 F.count(F.lit(1)).alias("n_events"),
                 F.array_sort(F.collect_set(item_col)).alias("items")))


def keep_failures(handler: Callable[[DataFrame, int], None], store: str) -> Callable[[DataFrame, int], None]:
    """``handler``, but a batch on which it fails is written to ``store``."""
    def guarded(df, epoch):
        try:
            handler(df, epoch)
        except (Py4JError, SparkRuntimeException):
            raise
        except Exception as e:  # noqa: BLE001 - a bad batch must not stop the watcher
            (df.withColumn("error", F.lit(f"{type(e).__name__}: {e}")).write.mode("overwrite")
             .parquet(f"{store}/epoch={epoch}"))
    return guarded


def run_on_batches(batches: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str,
                   trigger: dict | None = None, output_mode: str = "append",
                   failures: str | None = None) -> StreamingQuery:
    """T4: run ``handler(batch_df, epoch)`` on every micro-batch of closed
    batches (T5: stop with ``query.stop()``). A batch whose handler fails does
    not stop the watcher and is not lost: its rows go to the table
    ``failures`` (default: beside the checkpoint) with epoch and error, from
    where ``replay_failed`` runs it again. An error of the engine itself (lost
    storage, out of memory) or of that write fails the query, so the
    micro-batch is not committed."""
    guarded = keep_failures(handler, failures or f"{checkpoint.rstrip('/')}-failures")
    w = batches.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(guarded)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def replay_failed(spark: SparkSession, failures: str, handler: Callable[[DataFrame, int], None]) -> list[int]:
    """Run ``handler`` on every stored failed batch, oldest first; returns
    the epochs. The stored rows stay: handlers write by epoch, so a batch that
    is replayed twice gives the same result."""
    stored = spark.read.parquet(failures)
    epochs = sorted(r["epoch"] for r in stored.select("epoch").distinct().collect())
    for epoch in epochs:
        handler(stored.where(F.col("epoch") == epoch).drop("epoch", "error"), epoch)
    return epochs


def stream_to_table(spark: SparkSession, batches: DataFrame, name: str, output_mode: str = "complete") -> str:
    """Run a streaming aggregate to completion (available data) and keep the
    result as parquet in the session's checkpoint folder; returns the path.
    Writes are idempotent, so a micro-batch replayed after a failure does not
    duplicate rows: complete mode overwrites the folder, append mode
    overwrites the micro-batch's own ``epoch=<id>`` sub-folder."""
    base = os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")
    out, ckpt = os.path.join(base, "data"), os.path.join(base, "state")

    def write(df, epoch):
        target = out if output_mode == "complete" else os.path.join(out, f"epoch={epoch}")
        df.write.mode("overwrite").parquet(target)
    q = (batches.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt)
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def sessionize(events: DataFrame, keys: Sequence[str], ts_col: str, gap_seconds: float,
               bucket_seconds: int = 86_400) -> DataFrame:
    """Batch sessions: a new session starts when the time since the previous
    event of the same key exceeds ``gap_seconds``, in whole microseconds.
    Returns keys, session start, session end (last event), number of events.

    Events of one key less than a gap apart are one session, so all events in
    the same cell of one gap's width are. They are counted per (key, cell)
    first, with map-side sums: a hot key leaves one row per cell, whatever its
    number of events. Cells are then sessionized inside (key, time bucket)
    windows; only the first and the last partial session of a bucket can
    touch its border, and those, at most two per bucket, are merged.
    """
    keys = list(keys)
    gap = max(1, round(gap_seconds * 1_000_000))
    t = F.col(ts_col).cast("timestamp")
    cell = F.floor(F.col("_us") / gap)
    cells = (events.select(*keys, t.alias("_ts"), F.unix_micros(t).alias("_us")).where(F.col("_us").isNotNull())
             .groupBy(*keys, cell.alias("_cell"))
             .agg(F.min("_ts").alias("_start"), F.max("_ts").alias("_end"), F.min("_us").alias("_first"),
                  F.max("_us").alias("_last"), F.count(F.lit(1)).alias("_n")))
    whole = merge_spans(cells, keys, gap, bucket_seconds)
    return whole.select(*keys, F.col("_start").alias("session_start"), F.col("_end").alias("session_end"),
                        F.col("_n").alias("n_events"))


def merge_spans(spans: DataFrame, keys: Sequence[str], gap: int, bucket_seconds: int = 86_400,
                more: dict | None = None) -> DataFrame:
    """Spans (keys, _start, _end, _first, _last, _n) that lie at most ``gap``
    microseconds apart, put together. ``_first`` and ``_last`` order them: a
    span that reaches over several buckets must not overlap another, and
    counts in the bucket of its ``_first``. ``more``: further aggregates by
    name. A hot key is merged per time bucket first, and then only at most two
    spans a bucket across the borders."""
    keys, more = list(keys), more or {}
    spans = spans.withColumn("_b", F.floor(F.col("_first") / (bucket_seconds * 1_000_000)))

    def merged(rows, by):
        """Rows of one session put together, numbered within ``by``."""
        w = Window.partitionBy(*by).orderBy("_first")
        new = F.coalesce((F.col("_first") - F.lag("_last").over(w)) > gap, F.lit(True)).cast("int")
        return (rows.withColumn("_sid", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
                .groupBy(*by, "_sid")
                .agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"), F.min("_first").alias("_first"),
                     F.max("_last").alias("_last"), F.sum("_n").alias("_n"), *[a.alias(n) for n, a in more.items()]))

    part = merged(spans, [*keys, "_b"])
    part = part.withColumn("_edge", (F.col("_sid") == 1)
                           | (F.col("_sid") == F.max("_sid").over(Window.partitionBy(*keys, "_b"))))
    whole = part.where(~F.col("_edge")).unionByName(merged(part.where("_edge").drop("_sid"), keys), allowMissingColumns=True)
    return whole.drop("_sid", "_b", "_edge")
