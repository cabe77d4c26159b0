"""Benchmark decontamination (operator 8).

The test set's windows (13 consecutive normalised words, or a whole shorter
item) form a hash set that is broadcast. A training text is scanned once:
words outside the test vocabulary rule out every window over them, the other
windows are hashed and probed, and a hash hit counts only after the words
themselves compare equal. Texts are never shuffled.

The test set is bounded in practice; here it is bounded by construction. Its
bytes are summed first, and beyond ``MAX_BLOCK_BYTES`` it is cut into blocks
by item, each collected, broadcast and scanned on its own; the hit words of a
text are united over the blocks. A block holds its words as one array of
numbers and every window as a hash and an offset into it, sorted by hash.

Defined cases: null or wordless texts have no words and are never
contaminated; null or wordless items have no window; items that share an id
count once and an item without an id marks words but is not listed; repeated
rows are judged alike; an empty test set hits nothing. An added column
replaces one of the same name.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TYPES, keeps_names, replace_columns, struct_of, text_bytes

WINDOW = 13
MAX_BLOCK_BYTES = 8_000_000

# words are runs of digits, letters and everything beyond ASCII
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TO_BLANK = bytes(b if WORD.fullmatch(bytes([b])) else 32 for b in bytes(range(256)).lower())
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_BLANK).split()


def _hash(ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    for k in range(length):
        h = h * _PRIME + ids[starts + k].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    return h


class WindowSet:
    """Windows of a block of test items, by hash and by exact words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        parts = [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)], np.int32) for _, text in items]
        lengths = np.array([len(p) for p in parts], np.int64)
        self.tokens = np.concatenate([np.empty(0, np.int32), *parts])
        self.first = np.concatenate(([0], np.cumsum(lengths)))  # of each item, and the end
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # length: hashes in order, offsets
        sizes = np.minimum(lengths, window)
        for size in np.unique(sizes[sizes > 0]).tolist():
            at = np.concatenate([np.arange(self.first[i], self.first[i + 1] - size + 1) for i in np.flatnonzero(sizes == size)])
            hashes = _hash(self.tokens, at, size)
            order = np.argsort(hashes, kind="stable")
            self.windows[size] = hashes[order], at[order]

    def scan(self, text: bytes) -> tuple[int, np.ndarray | None, set[str]]:
        """Number of words, mask of hit words (None: no hit), items hit."""
        words = words_of(text)
        n = len(words)
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int32, n)
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        mask, found = None, set()
        for size, (hashes, offsets) in self.windows.items():
            if n < size:
                continue
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            h = _hash(ids, starts, size)
            low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            for k in np.flatnonzero(low < high).tolist():
                at, places = starts[k], offsets[low[k]:high[k]]
                # a hit counts once the words themselves are the same
                places = places[(self.tokens[places[:, None] + np.arange(size)] == ids[at:at + size]).all(axis=1)]
                if len(places):
                    mask = np.zeros(n, bool) if mask is None else mask
                    mask[at:at + size] = True
                    found.update(self.names[i] for i in np.searchsorted(self.first, places, "right") - 1)
        return n, mask, found - {None}


def _scanner(windows):
    """UDF that scans a text and adds its hits to those found before."""
    @F.pandas_udf(struct_of(n_words="long", n_hit="long", mask="binary", items="string[]"))
    def scan(body: pd.Series, before: pd.Series, items_before: pd.Series) -> pd.DataFrame:
        out = []
        for text, old, had in zip(body, before, items_before):
            n, mask, found = windows.value.scan(text)
            if old is not None:
                old = np.unpackbits(np.frombuffer(old, np.uint8), count=n).astype(bool)
                mask = old if mask is None else mask | old
                found |= set(had)
            out.append((n, 0 if mask is None else int(mask.sum()),
                        None if mask is None else np.packbits(mask).tobytes(), sorted(found)))
        return pd.DataFrame(out, columns=["n_words", "n_hit", "mask", "items"])
    return scan.asNondeterministic()  # a filter on its result must not evaluate it again


@F.pandas_udf(TYPES["binary"])
def _without_hits(body: pd.Series, mask: pd.Series) -> pd.Series:
    out = []
    for text, hits in zip(body, mask):
        if hits is not None:
            hits = np.unpackbits(np.frombuffer(hits, np.uint8))
            kept, at, inside = [], 0, False
            for word, hit in zip(WORD.finditer(text.lower()), hits):
                if hit:  # what stands between two hit words goes with them
                    kept.append(b"" if inside else text[at:word.start()])
                    at = word.end()
                inside = hit
            text = b"".join([*kept, text[at:]])
        out.append(text)
    return pd.Series(out, dtype="object")


def scan_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text",
                       max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """``docs`` with the struct ``_scan``: n_words, n_hit, mask (packed bits,
    one per word; null without hits) and the sorted ids of the items hit."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), text_bytes(item_text_col).alias("body"))
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, math.ceil(total / max_block_bytes))
    block = F.pmod(F.xxhash64("item", "body"), F.lit(blocks))
    sc = docs.sparkSession.sparkContext
    out = docs.withColumn("_scan", F.struct(F.lit(None).cast("binary").alias("mask"),
                                            F.lit(None).cast("array<string>").alias("items")))
    for b in range(blocks):
        rows = items.where(block == b) if blocks > 1 else items
        windows = sc.broadcast(WindowSet([(r["item"], bytes(r["body"])) for r in rows.collect()], window))
        out = out.withColumn("_scan", _scanner(windows)(text_bytes(text_col), F.col("_scan.mask"), F.col("_scan.items")))
    return out


@keeps_names
def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", window: int = WINDOW,
                  words_per_hit: int = 20, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the columns n_words, n_hit, items (sorted ids of the
    test items whose windows occur) and contaminated (at least one word in
    ``words_per_hit`` is hit). ``remove``: ``"documents"`` leaves out
    contaminated documents, ``"spans"`` cuts the hit words out of the texts
    and keeps every document, ``"nothing"`` only reports."""
    marked = scan_contamination(docs, benchmark, window=window, text_col=text_col, **options)
    scan = F.col("_scan")
    cols = {
        "n_words": scan["n_words"], "n_hit": scan["n_hit"], "items": scan["items"],
        "contaminated": (scan["n_hit"] > 0) & (scan["n_hit"] * words_per_hit >= scan["n_words"]),
    }
    if remove == "spans":
        cut = _without_hits(text_bytes(text_col), scan["mask"]).cast("string")
        cols[text_col] = F.when(F.col(text_col).isNotNull(), cut)
    out = replace_columns(marked, cols).drop("_scan")
    return out.where(~F.col("contaminated")) if remove == "documents" else out
