"""Structured Streaming jobs: file events -> debounced batches -> sync runs."""

from .debounce import (debounced_batches, file_events, run_on_batches, sessionize, source_filter,
                       stream_to_table)
from .sync import sync_handler, sync_state
from .watcher import start_position, watch, watch_source, watched

__all__ = ["debounced_batches", "file_events", "run_on_batches", "sessionize", "source_filter", "start_position",
           "stream_to_table", "sync_handler", "sync_state", "watch", "watch_source", "watched"]
