"""What is exchanged, and how often."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import elias_fano, lm_score, sharding
from fleetlens.llm.elias_fano import EliasFano
from fleetlens.llm.sharding import shard_documents

from .test_texts import brute_lm


def exchanges_of(df, column: str) -> int:
    """Shuffles of the plan through which the column goes."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    rows = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
    return sum(any(c.strip().split("#")[0] == column for c in row.split(",")) for row in rows)


def test_sharding_exchanges_texts_once(spark, monkeypatch):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"),
                                   F.lit("a").alias("source"))
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with counts too large to broadcast
    try:
        out = shard_documents(rows, 7)
        assert exchanges_of(out, "text") == 1
        slots = {(r.shard, r.slot) for r in out.collect()}
        assert len(slots) == 500 and {sum(s == k for s, _ in slots) for k in range(7)} == {71, 72}
        # places of many rows: counted, ranked, restored
        hot = rows.unionByName(spark.range(200).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one").alias("text"),
                                                       F.col("id").cast("string").alias("source")))
        out = shard_documents(hot, 7)
        assert exchanges_of(out, "text") == 4
        slots = {(r.shard, r.slot) for r in out.collect()}
        assert len(slots) == 700 and {sum(s == k for s, _ in slots) for k in range(7)} == {100}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sharding_exchanges_no_texts_that_are_dropped(spark, monkeypatch):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"),
                                   F.lit("a").alias("source"))
    hot = rows.unionByName(spark.range(200).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one").alias("text"),
                                                   F.col("id").cast("string").alias("source")))
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 50)
    key = lambda out: sorted(map(tuple, out.select("doc_id", "source", "shard", "slot").collect()))
    whole = [key(shard_documents(df, 7)) for df in (rows, hot)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with counts too large to broadcast
    try:
        out = shard_documents(rows, 7).drop("text")
        assert exchanges_of(out, "text") == 0 and key(out) == whole[0]
        # places of many rows: the text tells which of them are alike
        out = shard_documents(hot, 7).drop("text")
        assert exchanges_of(out, "text") == 1 and key(out) == whole[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ngrams_of_one_chunk_are_not_exchanged(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 100)  # a chunk per text
    tables, stage = {}, lm_score.stage
    monkeypatch.setattr(lm_score, "stage", lambda df, name: tables.setdefault(name, stage(df, name)))
    texts = [" ".join(f"own{i}word{(k * k + i) % 7} common" if k % 3 else f"own{i}word{k % 5}" for k in range(40)) for i in range(6)]
    texts.append("common common own0word1 common unheard")  # not learned; a context of two chunks
    rows = [(i, t, i not in (2, 6)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(7, "doc_id")
    got = {r.id: r for r in lm_score.score_texts(docs, learn_col="learn").collect()}
    want = list(brute_lm([t.encode().split() for t in texts], [r[2] for r in rows], 3))
    for i, (known, base, score, total) in enumerate(want):
        assert (got[i].n_known, got[i].train_tokens) == (known, total)
        assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(score, rel=2e-3, abs=0.11)
    assert tables["chunks"].count() == 7
    # of three words, only chunks 0 and 6 share a context
    assert {r.chunk for r in tables["order-3"].collect()} <= {
        r.chunk for r in tables["chunks"].collect() if {0, 6} & set(np.frombuffer(r.ids, np.int64).tolist())}


def test_a_bit_vector_read_as_a_whole_tells_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    for n, u in ((1, 1), (6, 5), (500, 10 ** 6), (3000, 2 ** 40), (300, 40), (2000, 90)):
        v = np.sort(rng.integers(0, u, n, dtype=np.uint64))
        e = EliasFano.encode(v, u)
        x = np.concatenate((v, rng.integers(0, 2 * u, 500, dtype=np.uint64)))
        low = rng.integers(0, n, len(x))
        found = []
        for many in (0, 1 << 40):
            monkeypatch.setattr(elias_fano, "MANY", many)
            found.append([e.get(np.arange(n)), *e.successor(x, low, np.minimum(low + 50, n))])
        assert all((a == b).all() for a, b in zip(*found))


def test_distinct_keys():
    rng = np.random.default_rng(4)
    for n, bound in ((0, 5), (1, 1), (1000, 50), (1000, 1 << 60)):
        keys = rng.integers(0, bound, n)
        got, want = lm_score.distinct(keys, bound), np.unique(keys, return_inverse=True)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
