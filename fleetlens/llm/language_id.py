"""Language identification (operator 5).

Multinomial naive Bayes over hashed character bigrams and trigrams of the
lower-cased letters, words padded by one blank. Counts per language and
bucket are summed over all training texts by Spark (each task sends one
partial matrix); the smoothed log-probability matrix, languages x buckets, is
broadcast and texts are scored batch by batch: the grams of a batch are the
entries of a sparse document x bucket matrix whose product with the model is
taken by gathering and segment sums.

The matrix has ``MAX_LANGUAGES`` rows at most, whatever the corpus.

Defined cases: null texts and texts without a letter are ``und`` with score
0, as is every text when there is nothing to learn from; ties go to the
language first by code point; repeated rows count as often as they stand; a
null language is not learned from. An added column replaces one of the same
name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keeps_names, replace_columns, struct_of

BUCKET_BITS = 16
MAX_LANGUAGES = 1000
CHUNK_CHARS = 4_000_000
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Code point -> is a letter; made once per process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def chunks(texts: pd.Series) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about CHUNK_CHARS characters."""
    first, size, part = 0, 0, []
    for n, t in enumerate(texts):
        part.append(t if isinstance(t, str) else "")
        size += len(part[-1])
        if size >= CHUNK_CHARS:
            yield first, part
            first, size, part = n + 1, 0, []
    if part:
        yield first, part


def grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of every gram, rows ascending, and per row whether it
    has a letter."""
    low = [t.lower() for t in texts]
    code = np.frombuffer(("\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) + 1 for t in low])
    code = np.where(letters()[code], code, np.uint32(0))
    keep = code != 0
    lettered = np.zeros(len(low), bool)
    lettered[row[keep]] = True
    keep[1:] |= code[:-1] != 0
    code, row = np.concatenate((np.zeros(1, np.uint32), code[keep])), row[keep]
    # row[i] belongs to code[i + 1]; a gram that starts at i counts for the row of its second character
    two = code[:-1] * _MULTIPLIERS[0] + code[1:] * _MULTIPLIERS[1]
    three = two[:-1] + code[2:] * _MULTIPLIERS[2]
    whole = code[1:-1] != 0  # no blank in the middle
    shift = np.uint32(32 - bits)
    mix = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift
    buckets = np.empty((len(two), 2), np.int32)
    buckets[:, 0] = mix(two)
    buckets[:, 1] = -1
    buckets[:-1, 1] = np.where(whole, mix(three ^ np.uint32(0x5BD1E995)).astype(np.int32), -1)
    flat, rows = buckets.ravel(), np.repeat(row, 2)
    some = flat >= 0
    return flat[some], rows[some], lettered


class LanguageModel:
    def __init__(self, languages: list[str], log_prior: np.ndarray, log_prob: np.ndarray, bits: int):
        self.languages, self.log_prior, self.log_prob, self.bits = languages, log_prior, log_prob, bits

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        for _, part in chunks(texts):
            if not self.languages:
                names += ["und"] * len(part)
                scores += [0.0] * len(part)
                continue
            bucket, row, lettered = grams(part, self.bits)
            total = np.tile(self.log_prior, (len(part), 1))
            if len(row):
                starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                for k in range(len(self.languages)):
                    total[row[starts], k] += np.add.reduceat(self.log_prob[k][bucket], starts)
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            names += [self.languages[b] if ok else "und" for b, ok in zip(best, lettered)]
            scores += np.where(lettered, share, 0.0).tolist()
        return pd.DataFrame({"lang": pd.Series(names, dtype="object"), "score": pd.Series(scores, dtype="float64")})


def fit_language_model(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", bits: int = BUCKET_BITS,
                       smoothing: float = 0.5) -> LanguageModel:
    """Count grams per language over all rows of ``docs`` with a language."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for f in frames:
            for first, part in chunks(f["body"]):
                own = f["lang"].iloc[first:first + len(part)]
                code, known = pd.factorize(own)
                bucket, row, _ = grams(part, bits)
                table = np.bincount((code[row].astype(np.int64) << bits) + bucket, minlength=len(known) << bits)
                for k, lang in enumerate(known):
                    sums[lang] = sums.get(lang, 0) + table[k << bits:(k + 1) << bits]
                    rows[lang] = rows.get(lang, 0) + int((code == k).sum())
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1), "n": np.append(s[at], rows[lang])})

    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    found = (known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("body"))
             .mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    counts: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for r in found.toLocalIterator():
        if r["bucket"] < 0:
            rows[r["lang"]] = r["n"]
            if len(rows) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
        else:
            counts.setdefault(r["lang"], np.zeros(1 << bits))[r["bucket"]] = r["n"]
    languages = sorted(rows)
    total = sum(rows.values())
    prior = np.array([np.log(rows[x] / total) for x in languages])
    table = np.array([counts.get(x, np.zeros(1 << bits)) for x in languages]).reshape(len(languages), 1 << bits)
    table += smoothing
    prob = np.log(table / table.sum(axis=1, keepdims=True)) if languages else table
    return LanguageModel(languages, prior, prob.astype(np.float32), bits)


def predict_language(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> Column:
    """Struct column (lang, score) for ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(struct_of(lang="string", score="double"))
    def predict(body: pd.Series) -> pd.DataFrame:
        return sent.value.predict(body)
    return predict(F.col(text_col))


@keeps_names
def identify_language(docs: DataFrame, training: DataFrame, *, text_col: str = "text", lang_col: str = "lang",
                      out_col: str = "lang_pred") -> DataFrame:
    """``docs`` with ``out_col`` and ``score``, learned from ``training``."""
    model = fit_language_model(training, text_col=text_col, lang_col=lang_col)
    done = docs.withColumn("_language", predict_language(docs, model, text_col=text_col))
    return replace_columns(done, {out_col: F.col("_language.lang"), "score": F.col("_language.score")}).drop("_language")
