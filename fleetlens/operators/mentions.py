"""Exact case-insensitive substring containment join without all pairs.

A needle can only be inside a text if the text holds every *key* the needle
implies. Two kinds of keys are used:

* word keys - an interior word of the needle (a run of letters, digits or
  '_' with a non-word character on both sides inside the needle) is a whole
  word of any text that contains the needle;
* gram keys - every character n-gram of the needle is in the text (needles
  shorter than n use themselves as the gram).

Needles with an interior word use word keys (rarer, and far fewer per text),
the others gram keys. Each needle picks its rarest key (fewest texts holding
it, counted on the data), texts are equi-joined to needles on that key, and
only those candidate pairs are checked with ``contains``. The empty needle is
in every text of its group (as ``contains(x, '')``); those pairs are the
answer, not a shortcut. No group is paired with all of another.

Keys that no needle wants are dropped inside the text's array, by a bitmap of
fixed size, before they become rows; the rest are written, since their counts
and the candidates both read them. Texts take part in one join only, the
last: candidate pairs bring their needle along, meet the text by the
document's key and are checked right there; texts without a candidate are
dropped before that exchange by the same kind of bitmap.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

GRAM = 3
FILTER_BITS = 1 << 18
EMPTY_SALTS = 64
W = r"\p{L}\p{N}_"
WORD = f"[{W}]+"
INTERIOR = f"(?<=[^{W}])[{W}]+(?=[^{W}])"


def _grams(text_col: str, n: int):
    """Distinct substrings of length n of a text column (array), found in one
    linear regex pass (a zero-width lookahead yields every overlapping gram)."""
    return F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(f"(?s)(?=(.{{{n}}}))"), 1))


def _words(text_col: str):
    return F.array_distinct(F.split(F.col(text_col), f"[^{W}]+"))


def _bit_filter(hashes: DataFrame):
    """A test on a hash that is true for all of ``hashes`` (column h) and for
    few others, as a column function: a bitmap of fixed size, whose set bits
    are all that comes to the driver. With very many hashes it lets more
    through, never less."""
    places = hashes.select((F.col("h").bitwiseAND(FILTER_BITS - 1)).alias("b")).distinct()
    words = places.groupBy(F.shiftright("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 AS INT)))").alias("m"))
    bits = dict(words.collect())
    table = F.expr("array(" + ",".join(f"{bits.get(w, 0)}L" if bits.get(w, 0) > -(1 << 63) else "-9223372036854775807L - 1L"
                                       for w in range(FILTER_BITS // 64)) + ")")

    def fits(h):
        b = h.bitwiseAND(FILTER_BITS - 1)
        word = F.get(table, F.shiftright(b, 6).cast("int"))
        return F.call_function("shiftrightunsigned", word, b.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    return fits


def contains_join(texts: DataFrame, needles: DataFrame, text_col: str, needle_col: str,
                  group: Sequence[str] = (), text_keys: Sequence[str] = (), needle_keys: Sequence[str] = (),
                  case_insensitive: bool = True, n: int = GRAM) -> DataFrame:
    """Pairs (group, text_keys, needle_keys) where the needle is a substring
    of the text (after lower-casing both when ``case_insensitive``).
    ``texts`` must be unique on ``group + text_keys`` and ``needles`` on
    ``group + needle_keys``."""
    group, tk, nk = list(group), list(text_keys), list(needle_keys)
    low = F.lower if case_insensitive else (lambda c: c)
    t = texts.select(*group, *tk, low(F.col(text_col)).alias("_text"))
    nd = needles.select(*group, *nk, low(F.col(needle_col)).alias("_needle"))
    nd = written(nd.withColumn("_words", F.array_distinct(
        F.regexp_extract_all("_needle", F.lit(INTERIOR), 0))), "needles")

    glen = F.least(F.length("_needle"), F.lit(n))
    stats = nd.agg(F.count(F.when(F.length("_needle") == 0, 1)).alias("empty"),
                   F.count(F.when(F.size("_words") > 0, 1)).alias("w"),
                   F.count(F.when((F.length("_needle") > 0) & (F.size("_words") == 0), 1)).alias("g"),
                   F.count(F.when((F.length("_needle") > 0) & (F.size("_words") == 0) & (glen < n), 1)).alias("s")).first()
    # an empty needle is in every text of its group: that is the answer, dealt over salts so that no group is one task
    salts = F.explode(F.sequence(F.lit(0), F.lit(EMPTY_SALTS - 1)))
    empty = nd.where(F.length("_needle") == 0).select(*group, *nk, salts.alias("_salt"))
    dealt = t.select(*group, *tk, F.pmod(F.xxhash64(*group, *tk), F.lit(EMPTY_SALTS)).cast("int").alias("_salt"))
    pairs_empty = (empty if stats["empty"] else empty.limit(0)).join(dealt, [*group, "_salt"]).select(*group, *tk, *nk)

    nz = nd.where(F.length("_needle") > 0)
    by_word = nz.where(F.size("_words") > 0).select(*group, *nk, F.lit("w").alias("_kind"),
                                                     F.explode("_words").alias("_k"))
    gram_needles = nz.where(F.size("_words") == 0)
    glen = F.least(F.length("_needle"), F.lit(n))
    by_gram = gram_needles.select(*group, *nk, F.lit("g").alias("_kind"), F.explode(
        F.when(F.length("_needle") < n, F.array("_needle")).otherwise(_grams("_needle", n))).alias("_k"))
    nkeys = written(by_word.unionByName(by_gram), "needle-keys")
    use_words, use_grams, short = stats["w"] > 0, stats["g"] > 0, stats["s"] > 0
    if not use_words and not use_grams:
        return pairs_empty

    # the wanted keys of each text; others are dropped inside the text's array and never become rows
    fits = _bit_filter(nkeys.select(F.xxhash64("_k").alias("h")))
    arrays = []
    if use_words:
        arrays.append((F.lit("w"), _words("_text")))
    if use_grams:
        lens = list(range(1, n + 1)) if short else [n]
        arrays.append((F.lit("g"), F.array_distinct(F.concat(*[_grams("_text", k) for k in lens])) if short else _grams("_text", n)))
    parts = [t.select(*group, *tk, kind.alias("_kind"), F.explode(F.filter(a, lambda k: fits(F.xxhash64(k)))).alias("_k"))
             for kind, a in arrays]
    tkeys = written(reduce(DataFrame.unionByName, parts), "text-keys")
    freq = tkeys.groupBy(*group, "_kind", "_k").agg(F.count(F.lit(1)).alias("_df"))
    chosen = (nkeys.join(freq, [*group, "_kind", "_k"])
              .groupBy(*group, *nk)
              .agg(F.min(F.struct("_df", "_kind", "_k")).alias("_c"))
              .select(*group, *nk, F.col("_c._kind").alias("_kind"), F.col("_c._k").alias("_k")))
    cand = written(tkeys.join(chosen, [*group, "_kind", "_k"]).select(*group, *tk, *nk), "candidates")
    has = _bit_filter(cand.select(F.xxhash64(*group, *tk).alias("h")))
    needed = cand.join(nz.select(*group, *nk, "_needle"), [*group, *nk])
    checked = (t.where(has(F.xxhash64(*group, *tk))).join(needed, [*group, *tk])
               .where(F.col("_text").contains(F.col("_needle"))).select(*group, *tk, *nk))
    return checked.unionByName(pairs_empty) if stats["empty"] else checked
