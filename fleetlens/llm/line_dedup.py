"""Line deduplication (operator 10).

Lines are exploded as 128-bit digests of their normalised form, one row per
distinct (line, document). One aggregation per digest gives the documents it
is found in; the digests a document loses are gathered per document, and the
document is put together again from its remaining lines by position. Line
texts never leave their document; a line that a third of all documents hold
is reduced by map-side aggregation, and its rows meet it by a broadcast of at
most ``HOT_KEYS`` such lines and are dealt by document after that.

Defined cases: a null or empty text is one empty line (a null text stays
null); a document that loses all lines becomes the empty text; rows with the
same id are one document, so a line repeated only among them stays; a row
without an id sorts after every id. An added column replaces one of the same
name. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps_names, replace_columns, split_hot, stage, struct_of, text_bytes

SPACE = b" \t\n\x0b\x0c\r"
LAST_ID = 2**63 - 1
SALTS = 4096  # parts that the rows of a hot line are dealt to


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """16-byte digest of the normalised line; None if it is shorter than
    ``min_chars`` code points."""
    key = line.strip(SPACE).lower()  # bytes.lower() only touches A-Z
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, key): the distinct line keys of each row."""
    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, keys = [], []
            for i, text in zip(f["doc"], f["body"]):
                found = {line_key(x, min_chars) for x in text.split(b"\n")}
                found.discard(None)
                ids.extend([i] * len(found))
                keys.extend(found)
            yield pd.DataFrame({"doc": pd.Series(ids, dtype="int64"), "key": pd.Series(keys, dtype="object")})

    rows = docs.select(F.coalesce(F.col(id_col), F.lit(LAST_ID)).cast("long").alias("doc"),
                       text_bytes(text_col).alias("body"))
    return rows.mapInPandas(explode, "doc long, key binary")


def dropped_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(doc, keys): the line keys each document loses, for those that lose
    any. A key found in ``min_docs`` documents stays in the smallest only."""
    if min_docs == 2:  # found in two documents: the smallest is not the largest
        found = lines.groupBy("key").agg(F.min("doc").alias("keep"), F.max("doc").alias("last"), F.count("*").alias("n"))
        found = found.where("keep < last").select("key", "keep", "n")
    else:
        found = (lines.distinct().groupBy("key").agg(F.min("doc").alias("keep"), F.count("*").alias("n"))
                 .where(F.col("n") >= min_docs).select("key", "keep", "n"))
    hot, cold = split_hot(stage(found, "line-keys"), "n")
    lines = lines.join(F.broadcast(hot.select("key", F.col("keep").alias("hot_keep"))), "key", "left")
    lines = lines.where("hot_keep IS NULL OR doc > hot_keep").withColumn(
        "salt", F.when(F.col("hot_keep").isNotNull(), 1 + F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(0).cast("long"))
    return (lines.join(cold.select("key", F.lit(0).cast("long").alias("salt"), "keep"), ["key", "salt"], "left")
            .where(F.coalesce("hot_keep", "keep") < F.col("doc"))
            .groupBy("doc").agg(F.collect_set("key").alias("keys")))


@F.pandas_udf(struct_of(kept="binary", n_lines="long", n_dropped="long"))
def _reassemble(body: pd.Series, keys: pd.Series, min_chars: pd.Series) -> pd.DataFrame:
    out = []
    for text, drop, least in zip(body, keys, min_chars):
        lines = text.split(b"\n")
        if drop is None:
            out.append((text, len(lines), 0))
            continue
        drop = set(drop)
        stay = [x for x in lines if line_key(x, least) not in drop]
        out.append((b"\n".join(stay), len(lines), len(lines) - len(stay)))
    return pd.DataFrame(out, columns=["kept", "n_lines", "n_dropped"])


@keeps_names
def drop_repeated_lines(docs: DataFrame, *, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """``docs`` with the text freed of repeated lines, ``n_lines`` (before)
    and ``n_dropped``. Lines whose normalised form (blanks stripped, A-Z
    lower-cased) has at least ``min_chars`` code points and is found in at
    least ``min_docs`` documents stay in the document with the smallest id
    only."""
    drops = dropped_keys(line_keys(docs, id_col, text_col, min_chars), min_docs)
    drops = drops.select(F.col("doc").alias("_drop_doc"), F.col("keys").alias("_drop_keys"))
    at = F.coalesce(F.col(id_col), F.lit(LAST_ID)).cast("long") == F.col("_drop_doc")
    done = docs.join(drops, at, "left").withColumn(
        "_line_result", _reassemble(text_bytes(text_col), "_drop_keys", F.lit(min_chars)))
    kept = F.col("_line_result.kept").cast("string")
    return replace_columns(done, {
        text_col: F.when(F.col(text_col).isNotNull(), kept),
        "n_lines": F.col("_line_result.n_lines"),
        "n_dropped": F.col("_line_result.n_dropped"),
    }).drop("_line_result", "_drop_doc", "_drop_keys")
