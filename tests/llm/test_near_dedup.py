"""Near duplicates among many relatives below the threshold."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm.near_dedup import near_duplicates

from .conftest import prose


def test_partners_are_found_among_relatives_below_the_threshold(spark):
    """50,400 form pages: any two have a similarity of 41/53, the 400 planted
    pairs one of 44/50."""
    form, pairs = prose(1, 45), 400

    def page(doc, k):
        return " ".join([form, *[f"own{k}x{j}" for j in range(3)], *[f"field{doc}x{j}" for j in range(3)]])

    rows = [(d, page(d, d)) for d in range(50_000)] + [(50_000 + k, page(50_000 + k, 100 * k)) for k in range(pairs)]
    random.Random(1).shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    got = {r.doc: r.component for r in got.where(F.col("component") != F.col("doc")).collect()}
    assert got == {50_000 + k: 100 * k for k in range(pairs)}


def test_links_with_unlucky_signatures_are_confirmed(spark):
    """Pairs of similarity 34/40 whose signatures agree in 88 to 91 of 128 values."""
    rows = []
    for seed in (27351, 217362, 308510, 373221, 3867, 89271, 155954, 47466, 49132):
        words = [f"w{seed}x{j}" for j in range(41)]
        rows += [(2 * seed, " ".join(words)), (2 * seed + 1, " ".join(words[:38] + ["new1", "new2", "new3"]))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc: r.component for r in got} == {d: d - d % 2 for d, _ in rows}


def test_pipeline_drops_copies_from_80_percent(spark):
    """Copies of similarity 266/326 and 33/41 go, one of 32/42 stays."""
    rows = []
    for d in range(0, 60, 3):
        words = [f"w{d}x{j}" for j in range(300)]
        copy = list(words)
        for k in range(6):
            copy[20 + 45 * k] = f"changed{k}"
        rows += [(d, " ".join(words)), (d + 1, " ".join(copy))]
        rows += [(100 + d, " ".join(words[:41])), (101 + d, " ".join(words[:37] + ["a", "b", "c", "d"])),
                 (102 + d, " ".join(["e", "f", "g", "h", "i"] + words[5:41]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert left == {d for d, _ in rows if d % 3 == (0 if d < 100 else 1)} | {102 + d for d in range(0, 60, 3)}
