"""The training-data pipeline: documents in, a deduplicated, decontaminated,
mixed and sharded corpus out.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept, and returns a DataFrame that is written as Parquet and read again for
the next one. All but the last return the columns of ``documents``; the last
adds ``shard`` and ``slot``. A document the mix takes twice is two rows.

An empty table goes through every stage. What a stage does with nulls, ties,
repeated rows and clashing names is defined by its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import held_out, read, stage
from fleetlens.llm.decontaminate import decontaminate
from fleetlens.llm.mixing import mix
from fleetlens.llm.near_dedup import drop_near_duplicates
from fleetlens.llm.quality import fit_voting, score_quality
from fleetlens.llm.sharding import shard_documents

SHARDS = 40
NEAR_COPY = 80  # percent of common shingles from which a document is a near copy


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = fit_voting(docs.where(~held_out("doc_id", 3, 1)), read(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, out_col="_quality")
    return scored.where("_quality >= 0.5").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return drop_near_duplicates(docs, threshold=NEAR_COPY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    kept = decontaminate(docs, read(spark, sf_dir, "benchmark"), remove="documents")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row in one of SHARDS shards of equal size."""
    return shard_documents(docs, SHARDS)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# the classifier, the sampling keys and the ring are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
