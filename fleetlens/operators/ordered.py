"""Globally ordered results with a position, by code unit or by locale.

Rows are range-partitioned and sorted, written, and counted per partition; a
row's position is its place in its partition plus what the partitions before
it hold. No task sorts a whole group, however large it is: only the counts,
one per partition and group, are summed in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

LOCALE = "UNICODE"  # root collation: punctuation, then letters whatever their case, accents last


def by_locale(col: str | Column) -> Column:
    """Sort key in locale order; ties are told apart by code unit."""
    c = F.col(col) if isinstance(col, str) else col
    return F.collate(c, LOCALE)


def with_positions(df: DataFrame, order: Sequence[str | Column], group: Sequence[str] = ("project",),
                   name: str = "position") -> DataFrame:
    """``df`` with each row's place in its group, from 1, in the order given.
    Rows that the order does not tell apart are placed as they come."""
    group = list(group)
    line = written(df.orderBy(*group, *order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = (line.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], part.alias("_p"))
              .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(*[f"_g{i}" for i in range(len(group))] or [F.lit(0)]).orderBy("_p")
    counts = written(counts.withColumn("_before", F.sum("_n").over(before) - F.col("_n")), "ordered-counts")
    same = part == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return line.join(counts, same).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))


def write_ordered(df: DataFrame, path: str, order: Sequence[str | Column], group: Sequence[str] = ("project",),
                  name: str = "position", fmt: str = "parquet") -> None:
    """Write ``df`` with its positions; the files follow each other in order."""
    with_positions(df, order, group, name).orderBy(*group, name).write.mode("overwrite").format(fmt).save(path)
