"""Sharding (operator 9): consistent-hash ring with virtual nodes and bounded
loads, in DataFrame operations only.

The ring is cut into cells by the leading bits of a hash. Every shard owns
``VIRTUAL_NODES`` points of the ring; a document belongs to the first point
clockwise of its cell. No shard takes more than its bound: keys that find
their shard full go on clockwise to the next point whose shard has room.

Only counts decide where the overflow goes. Rows are counted per cell and
summed per arc (the cells before a point); the flow between arcs is settled
on those counts - shards x VIRTUAL_NODES numbers, whatever the corpus - as
ranges of ranks per arc. A document then needs its rank in its arc: the rows
in the cells before its own, and its position within its cell. Cells are made
so small that ordering one is a small task, and a hash spreads rows evenly
over them, so hot sources do not matter. Rows equal in id and text share a
place; places that hold a large part of all rows (at most ``HOT_KEYS``) come
after the other rows of their cell, dealt to parts by a hash of all columns.
Rows alike in every column are interchangeable: they are counted into one
before they are shuffled, take a run of ranks, and are restored in pieces.

With ``load=1`` (the default) bounds are exact: shard sizes differ by one row
at most. A larger ``load`` lets a shard exceed the mean by that factor and
moves fewer keys when a shard is added.

Defined cases: a document without an id is placed by its text; rows that are
equal in id and text are ranked by their other columns; null texts count as empty; an empty
table gives an empty table. An added column replaces one of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, keeps_names, replace_columns, stage, text_bytes

VIRTUAL_NODES = 64
ROWS_PER_CELL = 2_000
LEAST_BITS, MOST_BITS = 16, 26
HOT_PARTS = 256  # parts of a place that holds many rows


def ring(docs: DataFrame, shards: int, virtual_nodes: int, bits: int) -> DataFrame:
    """(cell, arc, at): every cell with the arc it lies in and its place in
    the arc, and the shard that owns the arc's point."""
    spark = docs.sparkSession
    points = (spark.range(shards * virtual_nodes)
              .select(F.floor(F.col("id") / virtual_nodes).cast("int").alias("shard"), F.col("id").alias("point")))
    # a shard's points do not depend on the number of shards
    points = points.withColumn("cell", F.shiftrightunsigned(
        F.xxhash64(F.lit("point"), "shard", F.col("point") % virtual_nodes), 64 - bits))
    order = Window.orderBy("cell", "point")  # shards x virtual nodes rows
    arcs = points.select("shard", (F.row_number().over(order) - 1).alias("arc"), "cell",
                         F.lag("cell").over(order).alias("prior"), F.max("cell").over(Window.partitionBy()).alias("top"))
    # the first arc also takes the cells beyond the last point: the ring is closed
    start = F.coalesce(F.col("prior"), F.col("top") - F.lit(1 << bits)) + 1
    return arcs.select("shard", "arc", start.alias("start"), F.col("cell").alias("stop"))


def settle(counts: list[int], owners: list[int], shards: int, load: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, first rank, end rank, shard, first slot). Arcs fill their
    own shard first; what does not fit goes on clockwise, one point a round."""
    total = sum(counts)
    if load <= 1:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    else:
        room = [math.ceil(load * total / shards)] * shards
    held, done, pieces = [0] * shards, [0] * len(counts), []
    waiting = [a for a, n in enumerate(counts) if n]
    for step in range(len(counts)):
        for a in waiting:
            s = owners[(a + step) % len(counts)]
            take = min(counts[a] - done[a], room[s] - held[s])
            if take > 0:
                pieces.append((a, done[a], done[a] + take, s, held[s]))
                done[a] += take
                held[s] += take
        waiting = [a for a in waiting if done[a] < counts[a]]
        if not waiting:
            break
    return pieces


def _hashed(docs: DataFrame) -> list[Column]:
    """The columns that a hash can be taken of."""
    return [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]


def _rank_alike(rows: DataFrame, columns: list[str], counted: DataFrame) -> DataFrame:
    """``rows`` with their line of ``counted`` and ``_nth``, their rank in
    (``_cell``, ``_part``). Rows that are alike are one row with their number
    until they are ranked."""
    keys = [*columns, "_place", "_cell", "_part"]
    alike = rows.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.count("*").alias("_alike"))
    # taken before the join, so that the join exchanges no column that only the order needs
    alike = alike.withColumn("_order", F.xxhash64(*_hashed(rows)))
    # joined by the keys of the window, so one shuffle serves both
    alike = alike.join(counted, (F.col("_cell") == F.col("_c_cell")) & (F.col("_part") == F.col("_c_part")))
    order = Window.partitionBy("_cell", "_part").orderBy("_place", "_order")
    alike = alike.withColumn("_end", F.sum("_alike").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    alike = alike.withColumn("_start", F.col("_end") - F.col("_alike"))
    # pieces of a long run are restored by different tasks
    pieces = alike.withColumn("_from", F.explode(F.sequence("_start", F.col("_end") - 1, F.lit(ROWS_PER_CELL).cast("long"))))
    pieces = pieces.repartition("_cell", "_part", "_from")
    stop = F.least(F.col("_end"), F.col("_from") + ROWS_PER_CELL) - 1
    return pieces.withColumn("_nth", F.explode(F.sequence("_from", stop))).drop("_alike", "_order", "_end", "_start", "_from")


@keeps_names
def shard_documents(docs: DataFrame, shards: int, *, load: float = 1.0, virtual_nodes: int = VIRTUAL_NODES,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each
    shard)."""
    spark = docs.sparkSession
    crc = F.crc32(text_bytes(text_col))
    place = F.xxhash64(F.col(id_col), crc)

    total = docs.count()
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, total / ROWS_PER_CELL)))))

    def cell(of: Column) -> Column:
        return F.shiftrightunsigned(of, 64 - bits)

    # at most HOT_KEYS places can hold that many rows
    hot = (docs.select(place.alias("_hot_place")).groupBy("_hot_place").count()
           .where(F.col("count") >= max(ROWS_PER_CELL, total / HOT_KEYS)).select("_hot_place"))
    hot = stage(hot, "hot-places")
    part = F.when(F.col("_hot_place").isNotNull(), 1 + F.pmod(
        F.xxhash64(F.lit("part"), *_hashed(docs)), F.lit(HOT_PARTS))).otherwise(F.lit(0)).cast("int")
    # the order in a cell needs the checksum alone: taken before any shuffle, which then carries texts only where the
    # caller keeps them
    dealt = docs.withColumns({"_place": place, "_crc": crc})
    dealt = (dealt.join(F.broadcast(hot), F.col("_place") == F.col("_hot_place"), "left")
             .withColumns({"_cell": cell(F.col("_place")), "_part": part}).drop("_hot_place"))

    points = ring(docs, shards, virtual_nodes, bits)
    arcs = points.collect()  # shards x virtual nodes rows
    cells = points.where("start <= stop").select(
        "arc", F.posexplode(F.sequence("start", "stop")).alias("at", "place")).select(
        "arc", "at", F.pmod("place", F.lit(1 << bits)).alias("cell"))
    counted = dealt.groupBy(F.col("_cell").alias("cell"), "_part").agg(F.count("*").alias("n")).join(cells, "cell")
    before = Window.partitionBy("arc").orderBy("at", "_part").rowsBetween(Window.unboundedPreceding, -1)
    counted = stage(counted.select(F.col("cell").alias("_c_cell"), F.col("_part").alias("_c_part"),
                                   F.col("arc").alias("_arc"), "n",
                                   F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")), "cells")
    per_arc = {r["_arc"]: r["n"] for r in counted.groupBy("_arc").agg(F.sum("n").alias("n")).collect()}
    owners = {r["arc"]: r["shard"] for r in arcs}
    pieces = settle([per_arc.get(a, 0) for a in range(len(arcs))], [owners[a] for a in range(len(arcs))], shards, load)
    plan = spark.createDataFrame(pieces, "_p_arc int, _first long, _end long, _shard int, _slot long")

    # joined first and by the cell alone, the key of the window: the rows, texts and all, are shuffled once for both
    rank = Window.partitionBy("_cell").orderBy("_place", F.col(id_col), "_crc")
    counted = counted.drop("n")
    ranked = (dealt.where("_part = 0").join(counted.where("_c_part = 0"), F.col("_cell") == F.col("_c_cell"))
              .withColumn("_nth", F.row_number().over(rank) - 1)).drop("_crc")
    if hot.count():
        ranked = ranked.unionByName(_rank_alike(dealt.drop("_crc").where("_part > 0"), docs.columns,
                                                counted.where("_c_part > 0")))
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_nth"))
    # the plan has a few rows per arc, whatever the corpus
    placed = ranked.join(F.broadcast(plan), (F.col("_arc") == F.col("_p_arc"))
                         & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    out = replace_columns(placed, {"shard": F.col("_shard"),
                                   "slot": F.col("_slot") + F.col("_rank") - F.col("_first")})
    return out.drop("_place", "_cell", "_part", "_nth", "_c_cell", "_c_part", "_arc", "_before", "_rank", "_p_arc", "_first", "_end",
                    "_shard", "_slot")
