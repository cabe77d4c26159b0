"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

# A key that holds at least one row in HOT_KEYS (and HOT_ROWS rows) is hot: at
# most HOT_KEYS keys of a table can be.
HOT_KEYS = 10_000
HOT_ROWS = 1_000

# Largest number of ids that a join may broadcast (about 16 bytes each in
# memory); above it the same join runs as a shuffle join.
BROADCAST_IDS = 2_000_000


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(),
         "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def struct_of(**fields: str) -> T.StructType:
    """Struct type from names; needs no running session, unlike DDL text.
    ``long[]`` is an array of long."""
    return T.StructType([T.StructField(n, T.ArrayType(TYPES[t[:-2]]) if t.endswith("[]") else TYPES[t])
                         for n, t in fields.items()])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the session's shared checkpoint folder
    and return the re-read table. It cuts the lineage, keeps columns
    prunable, and survives the loss of an executor. The shuffle files behind
    it are deleted once it is written: nothing reads them again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(text: str | Column = "text") -> Column:
    """UTF-8 bytes of a text column, empty for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("binary"), F.lit("").cast("binary"))


def crc_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """True for rows no model may learn from: those with the given remainder
    and those without an id."""
    return F.coalesce(crc_bucket(id_col, modulus) == remainder, F.lit(True))


def keeps_names(operator):
    """For operators that add columns to the caller's: their helper columns
    start with an underscore, so the caller's columns of such names go under
    fresh names meanwhile, arguments that name them included."""
    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        aside = {c: f"own_{uuid.uuid4().hex}" for c in docs.columns if c.startswith("_")}
        if not aside:
            return operator(docs, *args, **options)
        options = {k: aside.get(v, v) if isinstance(v, str) else v for k, v in options.items()}
        out = operator(docs.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in docs.columns]), *args, **options)
        back = {new: c for c, new in aside.items()}
        return out.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in out.columns])
    return run


def replace_columns(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns; one of the same name (whatever its case) is replaced."""
    low = {c.lower() for c in cols}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low],
                     *[c.alias(n) for n, c in cols.items()])


def sized_broadcast(ids: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table of ids whose row count has been measured
    and is small enough; otherwise the table as it is."""
    return F.broadcast(ids) if rows <= BROADCAST_IDS else ids


def split_hot(table: DataFrame, weight: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``table`` (one per key) whose ``weight``, the rows that
    hold the key, makes them hot - at most HOT_KEYS rows, small enough to be
    broadcast - and all others."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) >= max(HOT_ROWS, total / HOT_KEYS)
    return table.where(hot), table.where(~hot)


def lookup(rows: DataFrame, table: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row per key) where a few
    keys may hold most rows: rows of hot keys meet them by a broadcast and are
    not shuffled, all others by a shuffle on keys that are all small. Both
    tables are read twice, so they should be written ones. No key may be null."""
    hot, cold = split_hot(table, weight)
    hot, cold = F.broadcast(hot.drop(weight)), cold.drop(weight)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on, "left"))
