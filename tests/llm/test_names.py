"""Whatever a caller's columns are called, operators give them back."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import fleetlens.llm as package
from fleetlens.llm.decontaminate import decontaminate
from fleetlens.llm.language_id import identify_language
from fleetlens.llm.line_dedup import drop_repeated_lines
from fleetlens.llm.mixing import mix
from fleetlens.llm.near_dedup import drop_near_duplicates
from fleetlens.llm.quality import VotingModel, feature_counts, fit_voting, score_quality
from fleetlens.llm.sharding import shard_documents
from fleetlens.llm.url_filter import Rule, filter_urls

from .conftest import prose

FOLDER = Path(package.__file__).parent
HELPERS = sorted({n for p in FOLDER.glob("*.py") for n in re.findall(r"""["'`.](_[a-z][a-z_]*)\b""", p.read_text())}
                 | {"_vote", "_dot.ted", "_l_host", "_l_prefix", "_l_segment", "w_doc", "w_digest", "w_crowded", "group", "row", "id", "doc"})


def documents(spark):
    rows = [(d, prose(d % 5, 30) + f"\na line that all of them hold {d % 2}", "en" if d % 2 else "de", "ab"[d % 2],
             f"http://h{d % 2}.net/en/{d}") for d in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string")


OPERATORS = {
    "quality": lambda s, d: score_quality(d, fit_voting(d, s.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))),
    "mix": lambda s, d: mix(d),
    "language": lambda s, d: identify_language(d, d),
    "near": lambda s, d: drop_near_duplicates(d),
    "urls": lambda s, d: filter_urls(d, [Rule("net", "/", "block")]),
    "benchmark": lambda s, d: decontaminate(d, s.createDataFrame([("x", prose(1, 20))], "item_id string, text string"), remove="nothing"),
    "shards": lambda s, d: shard_documents(d, 3),
    "lines": lambda s, d: drop_repeated_lines(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_come_back(spark, name):
    base = documents(spark)
    extra = base.withColumns({h: F.concat(F.lit(h), F.col("doc_id").cast("string")) for h in HELPERS})
    assert len(HELPERS) > 60 and {"_gone", "_cell", "_scan", "_l_host", "_size", "_language"} <= set(HELPERS)
    plain, got = OPERATORS[name](spark, base), OPERATORS[name](spark, extra)
    assert set(got.columns) == set(plain.columns) | set(HELPERS)
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.collect()) and rows
    assert all(r[h] == f"{h}{r.doc_id}" for r in rows for h in HELPERS)


def test_columns_may_be_named_like_helpers_and_used(spark):
    docs = documents(spark).withColumnsRenamed({"doc_id": "_row", "text": "_cell"})
    out = shard_documents(docs, 3, id_col="_row", text_col="_cell")
    assert sorted(r.slot for r in out.where("shard = 0").collect()) == [0, 1, 2, 3] and "_cell" in out.columns


def test_urls_without_rules(spark):
    rows = filter_urls(documents(spark), []).collect()
    assert len(rows) == 12 and {(r.rule, r.verdict) for r in rows} == {(None, "allow")}


def test_features_do_not_depend_on_the_next_text():
    texts = [b"one two", b"", b"\n\n", b"three", "é".encode(), b"x" * 50]
    alone = [feature_counts([t])[0].tolist() for t in texts]
    assert feature_counts(texts).tolist() == alone and feature_counts(texts[::-1]).tolist() == alone[::-1]


def test_scores_are_the_same_alone_reversed_and_dealt_anew(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(d, d % 2) for d in range(12)], "doc_id long, quality int")
    model: VotingModel = fit_voting(docs, labels)
    one = {r.doc_id: r.score for r in score_quality(docs.coalesce(1), model).collect()}
    assert one == {r.doc_id: r.score for r in score_quality(docs.coalesce(1).orderBy(F.desc("doc_id")), model).collect()}
    assert one == {r.doc_id: r.score for r in score_quality(docs.repartition(12, "doc_id"), model).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(abs(model.scores([texts[d]])[0] - s) < 1e-6 for d, s in one.items())
