"""Sync-state read and write.

The state is one JSON document per project: ``{"entries": {key: {lastHash,
lastSyncedAt, mappedSpecs, mappedObsidianNodes}}}``. It is read with a fixed
schema (a map of structs) and exploded into rows; it is written back as a
table in hash buckets of the project, of which a run rewrites those that it
touches (``sources.buckets``): a million projects are no more files than
buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import BucketTable

ENTRY = T.StructType([
    T.StructField("lastHash", T.StringType()),
    T.StructField("lastSyncedAt", T.StringType()),
    T.StructField("mappedSpecs", T.ArrayType(T.StringType())),
    T.StructField("mappedObsidianNodes", T.ArrayType(T.StringType())),
])
STATE_SCHEMA = T.StructType([T.StructField("entries", T.MapType(T.StringType(), ENTRY))])


def read_state(spark: SparkSession, path: str, project_from_path: bool = True) -> DataFrame:
    """S5: rows (project, key, last_hash, last_synced_at, mapped_specs,
    mapped_nodes). A missing file gives no rows, a document without
    ``entries`` gives no rows, malformed JSON fails the read."""
    schema = ("project string, key string, last_hash string, last_synced_at timestamp, "
              "mapped_specs array<string>, mapped_nodes array<string>")
    try:
        raw = (spark.read.schema(STATE_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
               .withColumn("_file", F.col("_metadata.file_path")))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise
    project = (F.try_element_at(F.split("_file", "/"), F.lit(-2)) if project_from_path else F.lit(None).cast("string"))
    e = raw.select(project.alias("project"), F.explode(F.coalesce("entries", F.create_map().cast(
        T.MapType(T.StringType(), ENTRY)))).alias("key", "v"))
    return e.select("project", "key", F.col("v.lastHash").alias("last_hash"),
                    F.to_timestamp("v.lastSyncedAt").alias("last_synced_at"),
                    F.coalesce("v.mappedSpecs", F.array().cast("array<string>")).alias("mapped_specs"),
                    F.coalesce("v.mappedObsidianNodes", F.array().cast("array<string>")).alias("mapped_nodes"))


STATE_TABLE = T.StructType([
    T.StructField("project", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("last_hash", T.StringType()), T.StructField("last_synced_at", T.TimestampType()),
    T.StructField("mapped_specs", T.ArrayType(T.StringType())), T.StructField("mapped_nodes", T.ArrayType(T.StringType())),
])


def state_table(spark: SparkSession, path: str, buckets: int = 64, by: tuple[str, ...] = ("project",)) -> BucketTable:
    return BucketTable(spark, path, STATE_TABLE, by, buckets)


def write_state(state: DataFrame, path: str, buckets: int = 64) -> list[int]:
    """S6: full replace of the touched projects' state, as a new version of
    the table; returns the buckets that were rewritten. Entries of other
    projects stay as they are."""
    table = state_table(state.sparkSession, path, buckets)
    newest = table.latest()

    def replaced(current: DataFrame, rows: DataFrame) -> DataFrame:
        names = STATE_TABLE.names
        stay = current.join(rows.select("project").distinct(), current["project"].eqNullSafe(rows["project"]), "left_anti")
        return stay.select(*names).unionByName(rows.select(*names))
    return table.merge(state, 0 if newest is None else newest + 1, replaced)


def read_state_table(spark: SparkSession, path: str, buckets: int = 64) -> DataFrame:
    """The newest version of the state that ``write_state`` wrote."""
    return state_table(spark, path, buckets).read()
