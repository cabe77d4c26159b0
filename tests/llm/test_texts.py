"""Operators on texts against brute force: quality, language model, language,
decontamination, line deduplication."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm.common import held_out
from fleetlens.llm.decontaminate import decontaminate
from fleetlens.llm.elias_fano import EliasFano, Trie, probability, quantise
from fleetlens.llm.language_id import fit_language_model, identify_language
from fleetlens.llm.line_dedup import drop_repeated_lines
from fleetlens.llm import lm_score
from fleetlens.llm.lm_score import score_texts
from fleetlens.llm.quality import fit_voting, score_quality

from .conftest import prose


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ------------------------------------------------------------------ quality

def test_quality_separates_and_covers_edge_cases(spark, docs, no_docs):
    good = [(100 + i, prose(i, 80), "en", "a") for i in range(40)]
    bad = [(200 + i, " ".join(w.upper() + "!!" for w in prose(i + 50, 80).split()), "en", "a") for i in range(20)]
    schema = "doc_id long, text string, lang string, source string"
    train = spark.createDataFrame(good + bad, schema)
    labels = spark.createDataFrame([(100 + i, 1) for i in range(30)] + [(200 + i, 0) for i in range(15)]
                                   + [(100, 0), (None, 1), (101, None)], "doc_id long, quality int")
    model = fit_voting(train, labels)
    assert (model.labels == 1).sum() == 30  # a repeated label counts once, the larger
    out = {r.doc_id: r.score for r in score_quality(train, model).collect()}
    assert all(out[100 + i] > 0.9 for i in range(40)) and all(out[200 + i] < 0.1 for i in range(20))

    scored = score_quality(docs, model)
    assert scored.columns.count("score") == 1 and set(scored.columns) == set(docs.columns)
    got = scored.select("text", "score").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    empty = [r.score for r in got if not r.text]
    assert empty and all(s == pytest.approx(30 / 45) for s in empty)

    assert score_quality(no_docs, fit_voting(no_docs, labels)).count() == 0
    unlabelled = score_quality(docs, fit_voting(docs, labels.limit(0))).select("score").distinct()
    assert rows_of(unlabelled) == [(0.5,)]


# ------------------------------------------------------------------ language model

def test_elias_fano_and_trie():
    rng = np.random.default_rng(1)
    for n, u in ((1, 1), (1, 1000), (6, 5), (500, 10 ** 6), (3000, 2 ** 40), (300, 40)):
        v = np.sort(rng.integers(0, u, n, dtype=np.uint64))
        e = EliasFano.encode(v, u)
        assert (e.get(np.arange(n)) == v).all()
        x = np.concatenate((v, rng.integers(0, u, 500, dtype=np.uint64)))
        at, same = e.successor(x, np.zeros(len(x), np.int64), np.full(len(x), n))
        assert (at == np.searchsorted(v, x)).all() and (same == np.isin(x, v)).all()
    assert EliasFano.encode(np.arange(1000) * 1000, 10 ** 6).low.nbytes * 8 < 1000 * 12  # compact


@pytest.mark.parametrize("order", [1, 2, 3])
def test_trie_round_trip(order, tmp_path):
    rng = np.random.default_rng(order)
    grams = np.unique(np.minimum(rng.zipf(1.4, (4000, order)), 999), axis=0)
    codes = rng.integers(1, 65535, len(grams)).astype(np.uint16)
    Trie.build(grams, codes, 1000).save(str(tmp_path))
    trie = Trie.open(str(tmp_path))
    assert isinstance(trie.codes, np.memmap)
    asked = np.unique(np.concatenate((grams, np.minimum(rng.zipf(1.4, (3000, order)), 999))), axis=0)
    held = dict(zip(map(tuple, grams.tolist()), codes.tolist()))
    assert trie.find(asked).tolist() == [held.get(tuple(g), 0) for g in asked.tolist()]
    empty = Trie.build(grams[:0], codes[:0], 1000)
    assert empty.find(asked).sum() == 0


def test_quantised_probabilities_are_close_and_never_above():
    p = np.geomspace(1e-11, 1, 1000)
    q = probability(quantise(p))
    assert (q <= p * (1 + 1e-12)).all() and (q >= p * 0.9995).all()


def brute_lm(texts, learn, order):
    """texts: lists of words; yields (n_known, base, score)."""
    tokens = [t + [None] for t in texts]
    grams = [Counter() for _ in range(order + 1)]
    for t, on in zip(tokens, learn):
        if on:
            grams[1].update((w,) for w in t)
            for n in range(2, order + 1):
                t_ = ["<s>"] + t
                grams[n].update(tuple(t_[i:i + n]) for i in range(len(t_) - n + 1))
    total, known, starts = sum(grams[1].values()), len(grams[1]), sum(learn)
    for t in tokens:
        base = score = seen = 0
        s = ["<s>"] + t
        for i, w in enumerate(t, 1):
            p = (grams[1][(w,)] + 1) / (total + known + 1)
            base += math.log10(p)
            seen += grams[1][(w,)] > 0
            for n in range(2, order + 1):
                if i - n + 1 < 0:
                    break
                h = tuple(s[i - n + 1:i])
                c = starts if h == ("<s>",) else grams[n - 1][h]
                if c:
                    m = lm_score.PRIOR[n] * c ** lm_score.GROWTH
                    p = grams[n][(*h, w)] / (c + m) + m / (c + m) * p
            score += math.log10(p)
        yield seen, base, score, total


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_matches_brute_force(spark, docs, order, monkeypatch):
    rows = docs.select("doc_id", "text", (~held_out("doc_id", 7, 2)).alias("learn"))
    if order == 4:
        monkeypatch.setattr(lm_score, "CHUNK_BYTES", 500)  # many chunks and shards
    got = score_texts(rows, learn_col="learn", order=order).collect()
    plain = rows.collect()
    texts = [(r.text or "").encode().lower().split() for r in plain]
    want = [(r.doc_id, r.learn, len(t) + 1, known, total, round(base, 4), round(score, 1) if len(t) < 1000 else None)
            for r, t, (known, base, score, total) in zip(plain, texts, brute_lm(texts, [r.learn for r in plain], order))]
    have = [(r.id, r.learned, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4),
             round(r.score, 1) if r.n_tokens < 1000 else None) for r in got]
    key = lambda x: tuple(str(v) for v in x[:4])
    for a, b in zip(sorted(want, key=key), sorted(have, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-6)
        assert a[6] is None or a[6] == pytest.approx(b[6], rel=2e-3, abs=0.11)


def test_lm_without_rows_or_learning(docs, no_docs):
    assert score_texts(no_docs.withColumn("learn", F.lit(True)), learn_col="learn").count() == 0
    alone = score_texts(docs.withColumn("learn", F.lit(False)), learn_col="learn").collect()
    assert len(alone) == docs.count() and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in alone)


# ------------------------------------------------------------------ language

def test_language_accuracy_and_edge_cases(spark, docs, no_docs):
    de = "der die das und ist nicht ein eine auf dem weg nach haus über schön".split()
    en = "the and is not a one on way to house over nice with that this".split()
    rows = [(i, " ".join(words[(i * 7 + k * 3 + k * k) % len(words)] for k in range(30)), lang)
            for i, (words, lang) in enumerate([(de, "de"), (en, "en")] * 30)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = identify_language(train.where("doc_id >= 40").drop("lang"), train.where("doc_id < 40")).collect()
    truth = {i: lang for i, _, lang in rows}
    assert len(out) == 20 and all(r.lang_pred == truth[r.doc_id] and 0.5 < r.score <= 1 for r in out)

    done = identify_language(docs, train)
    assert set(done.columns) == {*docs.columns, "lang_pred"}
    for r in done.select("text", "lang_pred", "score").collect():
        lettered = bool(r.text) and any(c.isalpha() for c in r.text)
        assert (r.lang_pred in ("de", "en")) == lettered and (r.lang_pred == "und") == (not lettered)
        assert 0 <= r.score <= 1
    assert {r.lang_pred for r in identify_language(docs, no_docs).collect()} == {"und"}
    assert identify_language(no_docs, train).count() == 0


def test_language_model_matches_counts(spark):
    train = spark.createDataFrame([("ab ab", "x"), ("ab", "x"), ("ba", "y"), (None, "y"), ("zz", None)],
                                  "text string, lang string")
    model = fit_language_model(train)
    assert model.languages == ["x", "y"]
    assert np.exp(model.log_prior) == pytest.approx([2 / 3, 1 / 3])  # null texts are not learned from
    assert np.exp(model.log_prob.astype(float)).sum(axis=1) == pytest.approx([1, 1], rel=1e-3)
    again = fit_language_model(train.repartition(5))
    assert (again.log_prob == model.log_prob).all()


# ------------------------------------------------------------------ decontamination

BYTE_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, window=13):
    words = BYTE_WORD.findall((text or "").encode().lower())
    hit, found = set(), set()
    for item, body in items:
        ws = BYTE_WORD.findall((body or "").encode().lower())
        n = min(window, len(ws))
        for k in range(len(ws) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at:at + n] == ws[k:k + n]:
                    hit |= set(range(at, at + n))
                    if item is not None:
                        found.add(str(item))
    return len(words), hit, sorted(found)


@pytest.fixture(scope="module")
def bench(spark):
    items = [(1, prose(90, 30)), (2, prose(91, 13)), (10, "tiny item"), (3, None), (4, " .,- "), (None, prose(92, 20)),
             (1, prose(93, 15)), (5, "é-É ünï")]
    return items, spark.createDataFrame(items, "item_id long, text string")


def dirty(docs, spark):
    extra = [(50, "Start " + prose(90, 30).upper().replace(" ", " , ") + " end"), (51, prose(91, 13)), (52, "a TINY--item!"),
             (53, prose(8, 400) + " " + prose(91, 13)), (54, prose(90, 30)[:80]), (55, prose(92, 20)),
             (56, prose(93, 15) + " " + prose(90, 30)), (57, "x é É ünï y"), (58, prose(9, 300) + " tiny item")]
    return docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))


@pytest.mark.parametrize("block", [1 << 30, 200])
def test_decontamination_matches_brute_force(spark, docs, bench, block):
    items, table = bench
    rows = dirty(docs, spark)
    out = decontaminate(rows, table, remove="nothing", max_block_bytes=block).collect()
    want = []
    for r in rows.collect():
        n, hit, found = brute_hits(r.text, items) if r.doc_id != 11 else (60_000, set(), [])
        want.append((r.doc_id, n, len(hit), found, bool(hit) and 20 * len(hit) >= n))
    have = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in out]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_decontamination_removes_documents_or_spans(spark, docs, no_docs, bench):
    items, table = bench
    rows = dirty(docs, spark)
    kept = {r.doc_id for r in decontaminate(rows, table).collect()}
    assert kept.isdisjoint({50, 51, 52, 55, 56, 57}) and {1, 2, 11, 53, 54, 58, None} <= kept
    cut = {r.doc_id: r.text for r in decontaminate(rows, table, remove="spans").collect()}
    assert cut[51] == "" and cut[52] == "a !" and cut[50].split()[0] == "Start" and cut[50].split()[-1] == "end"
    assert cut[1] == prose(1, 60) and cut[5] is None and cut[6] == ""
    assert not brute_hits(cut[56], items)[1]
    whole = decontaminate(docs, table, remove="nothing")
    assert whole.columns.count("n_words") == 1 and whole.count() == docs.count()
    assert decontaminate(no_docs, table).count() == 0
    assert decontaminate(rows, table.limit(0), remove="nothing").where("n_hit > 0 OR contaminated").count() == 0


# ------------------------------------------------------------------ lines

def brute_lines(rows, min_chars, min_docs):
    strip = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    last = 2 ** 63 - 1
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[strip(x)].add(last if i is None else i)
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(strip(x)) < min_chars or len(holders[strip(x)]) < min_docs
                or min(holders[strip(x)]) == (last if i is None else i)]
        yield i, None if t is None else "\n".join(stay), len(lines), len(lines) - len(stay)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_match_brute_force(spark, docs, no_docs, min_docs):
    more = [(60, "first shared line here\nfirst shared line here"), (61, "tenletters"), (62, "tenletters"),
            (63, "nineletrs"), (64, "nineletrs"), (65, "éééééééééé\nA"), (66, "éééééééééé\nÉÉÉÉÉÉÉÉÉÉ"), (61, "tenletters\nother"),
            (None, "first shared line here"), (67, "tenletters\n\n\n")]
    rows = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    out = drop_repeated_lines(rows, min_docs=min_docs)
    assert set(out.columns) == {*docs.columns, "n_lines", "n_dropped"}
    have = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()]
    want = list(brute_lines([(r.doc_id, r.text) for r in rows.collect()], 10, min_docs))
    assert sorted(have, key=str) == sorted(want, key=str)
    assert sum(r[3] for r in have) > 0
    assert drop_repeated_lines(no_docs).count() == 0


def test_held_out_rule(spark, docs):
    for r in docs.select("doc_id", held_out("doc_id", 3, 1).alias("h")).collect():
        assert r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
