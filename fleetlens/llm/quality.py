"""Quality classifier (operator 1): nearest-neighbour voting.

A text becomes a tf-idf vector over hashed byte trigrams and two counts of
repetition (words equal to the word before, lines equal to an earlier line);
document frequencies are counted over all training rows. A bounded sample of labelled
rows (``SAMPLE_PER_LABEL`` of each label, smallest hash of the id first)
gives the latent space: a truncated singular value decomposition of their
vectors. The sample's latent vectors and labels are broadcast - their number
is a parameter, so their size does not grow with the corpus. Every document
is projected, its cosines to all sample vectors are taken block by block as
matrix products, and its nearest neighbours vote with their similarity,
corrected for how much each label was thinned by the sample.

Texts are never shuffled, whole texts are read.

Defined cases: null and empty texts, and texts like no sample row, get the
share of good labels in training; without any label every score is 0.5;
neighbours of equal similarity are taken in sample order; repeated label rows
of one document count once (the larger label); label rows with a null are
left out. An added column replaces one of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps_names, replace_columns, struct_of, text_bytes

SAMPLE_PER_LABEL = 2048
BUCKET_BITS = 13
LATENT = 64
NEIGHBOURS = 25
SHARPNESS = 6
BLOCK = 256  # documents per matrix product
WIDTH = (1 << BUCKET_BITS) + 2  # buckets of trigrams, repeated words, repeated lines
REPEAT_WEIGHT = 4


def feature_counts(texts: list[bytes]) -> np.ndarray:
    """documents x WIDTH: counts of hashed byte trigrams and repetitions. A
    text's trigrams end with its own two line feeds: those that start there
    would run into the next text and are left out."""
    buf = np.frombuffer(b"".join(t + b"\n\n" for t in texts), np.uint8).astype(np.uint32)
    sizes = [len(t) + 2 for t in texts]
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * WIDTH, sizes)
    ends = np.cumsum(sizes)
    row[ends - 1] = row[ends - 2] = -1
    row = row[:-2]
    h = (buf[:-2] * np.uint32(0x9E3779B1)) ^ (buf[1:-1] * np.uint32(0x85EBCA77)) ^ (buf[2:] * np.uint32(0xC2B2AE3D))
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS)
    own = row >= 0
    counts = np.bincount(row[own] + h[own], minlength=len(texts) * WIDTH).reshape(len(texts), WIDTH)
    for k, text in enumerate(texts):
        words, lines = text.split(), text.split(b"\n")
        counts[k, -2] = sum(map(eq, words, words[1:]))
        counts[k, -1] = len(lines) - len(set(lines))
    return counts


def blocks(texts: list[bytes], rows: int = BLOCK, size: int = 4_000_000) -> Iterator[list[bytes]]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if len(part) >= rows or held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit tf-idf rows, term frequencies damped by the square root; 32-bit
    counts are overwritten."""
    x = counts if counts.dtype == np.float32 else counts.astype(np.float32)
    np.sqrt(x, out=x)
    x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    x /= np.where(norm > 0, norm, 1)
    return x


def latent_space(parts: list[Callable[[], np.ndarray]], k: int, steps: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors (buckets x k) of a matrix given as
    functions that make its blocks of rows, and the rows in that space; by
    subspace iteration from a fixed start. The matrix is never held whole."""
    q = np.random.default_rng(0).standard_normal((WIDTH, k + 16)).astype(np.float32)
    for _ in range(steps):
        total = np.zeros_like(q)
        for make in parts:
            x = make()
            total += x.T @ (x @ q)
        q, _ = np.linalg.qr(total)
    y = np.concatenate([make() @ q for make in parts])
    _, vectors = np.linalg.eigh((y.T @ y).astype(np.float64))
    turn = vectors[:, ::-1][:, :k].astype(np.float32)
    return q @ turn, y @ turn


class VotingModel:
    """Latent space, the sample's unit vectors, their labels and weights."""

    def __init__(self, idf, space, points, labels, weights, prior):
        self.idf = idf
        self.space, self.points = (None if x is None else x.astype(np.float64) for x in (space, points))
        self.labels, self.weights, self.prior = labels, weights, prior

    def latent(self, texts: list[bytes]) -> np.ndarray:
        # products in double precision: what a row gets does not depend on the rows beside it, to the last rounding
        y = weighted(feature_counts(texts), self.idf).astype(np.float64) @ self.space
        norm = np.linalg.norm(y, axis=1, keepdims=True)
        return np.where(norm > 1e-6, y / np.where(norm > 1e-6, norm, 1), 0)

    def scores(self, texts: list[bytes]) -> list[float]:
        out: list[float] = []
        for part in blocks(texts) if self.points is not None else ():
            cosine = self.latent(part) @ self.points.T
            k = min(NEIGHBOURS, cosine.shape[1])
            near = np.sort(np.argpartition(-cosine, k - 1, axis=1)[:, :k], axis=1)
            vote = np.clip(np.take_along_axis(cosine, near, axis=1), 0, None).astype(np.float64) ** SHARPNESS
            vote *= self.weights[near]
            total = vote.sum(axis=1)
            good = (vote * self.labels[near]).sum(axis=1)
            told = np.array([bool(t) for t in part]) & (total > 1e-9)
            out += np.clip(np.where(told, good / np.where(total > 0, total, 1), self.prior), 0, 1).round(9).tolist()
        return out if self.points is not None else [self.prior] * len(texts)


def document_frequency(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Number of rows of ``docs`` and of those that hold each bucket."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(WIDTH, np.int64), 0
        for f in frames:
            for part in blocks(f["body"].tolist()):
                total += (feature_counts(part) > 0).sum(axis=0)
                rows += len(part)
        yield pd.DataFrame({"bucket": np.append(np.arange(len(total)), -1), "n": np.append(total, rows)})

    sums = (docs.select(text_bytes(text_col).alias("body")).mapInPandas(count, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # one row per bucket
    df, rows = np.zeros(WIDTH), 0
    for r in sums:
        if r["bucket"] < 0:
            rows = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return rows, df


def fit_voting(training: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "quality", sample_per_label: int = SAMPLE_PER_LABEL) -> VotingModel:
    """Learn from the rows of ``training``; labels of other ids are not used."""
    spark = training.sparkSession
    rows, df = document_frequency(training, text_col)
    idf = np.log((1 + rows) / (1 + df)).astype(np.float32) + np.float32(1)
    idf[-2:] *= REPEAT_WEIGHT

    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
             .join(training.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return VotingModel(idf, None, None, None, None, 0.5)
    picked = [known.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(sample_per_label).collect()
              for v in sorted(totals)]
    sample = spark.createDataFrame([(r["id"], r["label"]) for p in picked for r in p], known.schema)
    # rows of one id: its first text by order
    found = (training.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("body"))
             .join(F.broadcast(sample), "id").groupBy("id").agg(F.min("body").alias("body"), F.first("label").alias("label")))

    def sparse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            counts = [feature_counts([t])[0] for t in f["body"]]
            at = [np.flatnonzero(c) for c in counts]
            yield pd.DataFrame({"id": f["id"], "label": f["label"],
                                "at": [a.astype(np.uint16).tobytes() for a in at],
                                "n": [c[a].astype(np.uint32).tobytes() for c, a in zip(counts, at)]})

    got = sorted(found.mapInPandas(sparse, "id long, label int, at binary, n binary").collect(), key=lambda r: r["id"])

    def block(rows):
        def make() -> np.ndarray:
            x = np.zeros((len(rows), WIDTH), np.float32)
            for k, r in enumerate(rows):
                x[k, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.uint32)
            return weighted(x, idf)
        return make

    space, points = latent_space([block(got[k:k + BLOCK]) for k in range(0, len(got), BLOCK)], LATENT)
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-6)
    y = np.array([r["label"] for r in got], np.float64)
    taken = {v: max(1, int((y == v).sum())) for v in totals}
    weights = np.array([totals[int(v)] / taken[int(v)] for v in y])
    prior = totals.get(1, 0) / sum(totals.values())
    return VotingModel(idf, space, points, y, weights, prior)


@keeps_names
def score_quality(docs: DataFrame, model: VotingModel, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``: how likely label 1 is, 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(struct_of(score="double"))
    def vote(body: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"score": sent.value.scores(body.tolist())}, dtype="float64")
    # a filter on the score must not evaluate it a second time
    done = docs.withColumn("_vote", vote.asNondeterministic()(text_bytes(text_col)))
    return replace_columns(done, {out_col: F.col("_vote.score")}).drop("_vote")
