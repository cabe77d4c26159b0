"""Language-model scoring (operator 2): an Elias-Fano n-gram trie.

Model. With c(.) counted over all training texts, N tokens and V distinct
ones, the base probability is p1(w) = (c(w) + 1) / (N + V + 1), and each
order adds p(w | h) = c(h w) / (c(h) + m) + m / (c(h) + m) p(w | h'), where h'
is h without its first word and m = PRIOR c(h)^GROWTH follows the number of
different words after a context, which grows as a power of its count; contexts
seen less than ``min_context`` times (by default: never) pass through to h'. A text starts after one start mark and ends with one end
token. Every order is a proper distribution; the first term of each order is
stored quantised (rounded down) in a trie, see ``elias_fano``.

Spark. The model grows with the corpus, so it is never held in one place.
Texts are tokenised once into a table of chunks (a few megabytes of text each,
words numbered within the chunk). Order by order, each chunk sends its
distinct n-grams, with its own training counts, to shards by a hash of their
context; a shard adds the counts of all chunks, writes its trie, opens it
memory-mapped, looks all requested n-grams up and answers each chunk. The
first order numbers the words and returns their counts. Requests and answers
are packed arrays, one row per (chunk, shard). A frequent n-gram is one entry
per chunk, whatever its count. The n-grams of a context stand together, which
makes requests short and the search in the trie relative to one context after
another; a frequent context is split over shards by its last word, so no word,
pair or passage makes a shard hot. A shard also tells which n-grams only one
chunk has asked for: what follows such a context stands in that chunk alone,
so the chunk keeps those n-grams in a trie of its own and sends none of them.
Chunks and shards are of bounded
size; their numbers grow with the input.

Defined cases: null and empty texts consist of the end token; rows without an
id are not learned from and are scored; repeated rows count and are scored
each; with nothing to learn from every token has probability 1; an empty
table gives an empty table.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_bytes
from .elias_fano import Trie, probability, quantise

ORDER = 3
PRIOR = (0.0, 0.0, 10.0, 2.0, 2.0, 2.0)  # by order
GROWTH = 0.75
MIN_CONTEXT = 1
CHUNK_BYTES = 8_000_000
WORD_SHARD_CHUNKS = 4  # chunks per shard of words
SPLITS = 4  # a context with more than so small a part of a shard's tokens is split
END = b"\n"  # no word holds a line feed

_CHUNK = "chunk long, ids binary, nameless binary, learn binary, sizes binary, tokens binary, words binary"
_REQUEST = "shard int, chunk long, a binary, b binary, c binary"
_ANSWER = "chunk long, level int, shard int, a binary, b binary, tokens long, words long, numbers long"

_SCORES = ("id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
           "score double")


def prior_weight(context: np.ndarray, order: int) -> np.ndarray:
    """m of the module's formula, by the count of the context."""
    return PRIOR[order] * context.astype(np.float64) ** GROWTH


def pack(x: np.ndarray) -> bytes:
    """Compressed bytes of an array, one plane per byte of its items."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.compress(x.dtype.char.encode() + planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    kind = np.dtype(raw[:1].decode())
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def narrow(x: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds the items."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack_grams(grams: np.ndarray) -> bytes:
    """Compressed rows of n-grams in order: each column as the step from the
    row before wherever the columns to its left are the same."""
    out, same = [], np.zeros(len(grams), bool)
    same[1:] = True
    for k in range(grams.shape[1]):
        column = grams[:, k]
        step = column.copy()
        step[1:] -= np.where(same[1:], column[:-1], 0)
        out.append(_framed(pack(narrow(step))))
        same[1:] &= column[1:] == column[:-1]
    return b"".join(out)


def unpack_grams(data: bytes) -> np.ndarray:
    columns, first = [], None
    for part in _frames(data):
        column = np.cumsum(unpack(part).astype(np.int64))
        if first is None:
            first = np.zeros(len(column), bool)
            first[:1] = True
        else:  # the sums start again with each run of equal columns to the left
            runs = np.flatnonzero(first)
            before = np.concatenate(([0], column[runs[1:] - 1]))
            column -= np.repeat(before, np.diff(np.append(runs, len(column))))
        columns.append(column)
        first[1:] |= column[1:] != column[:-1]
    return np.stack(columns, axis=1)


def _framed(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + data


def _frames(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        size = int.from_bytes(data[at:at + 4], "little")
        yield data[at + 4:at + 4 + size]
        at += 4 + size


def row_order(grams: np.ndarray, bound: int) -> np.ndarray:
    """Positions of the rows in order; items are below ``bound``."""
    key = grams[:, 0]
    for k in range(1, grams.shape[1]):
        if (int(key.max(initial=0)) + 1) * bound >= 1 << 63:
            key = np.unique(key, return_inverse=True)[1]
        key = key * bound + grams[:, k]
    return np.argsort(key, kind="stable")  # the rows are a few runs, each in order


def distinct(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them; keys
    are below ``bound``. Key and position are sorted as one number."""
    bits = len(keys).bit_length()
    if bound << bits >= 1 << 63:
        return np.unique(keys, return_inverse=True)
    both = np.sort((keys << bits) | np.arange(len(keys)))
    at = both & ((1 << bits) - 1)
    both >>= bits
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    inverse = np.empty(len(both), np.int64)
    inverse[at] = np.cumsum(new) - 1
    return both[new], inverse


def numbered() -> defaultdict:
    """A dict that numbers its keys in the order in which they are asked for."""
    numbers = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def encode(docs: DataFrame, *, id_col: str, text_col: str, learn_col: str) -> DataFrame:
    """The table of chunks."""
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def chunk():
            nonlocal number, held, size
            vocab, tokens, sizes = numbered(), [], []
            vocab[END]  # 0
            for _, _, _, body in held:
                words = body.lower().split()  # bytes: A-Z and ASCII blanks only
                sizes.append(len(words) + 1)
                tokens.append(np.fromiter(map(vocab.__getitem__, words), np.uint32, len(words)))
                tokens.append(np.zeros(1, np.uint32))
            ids, nameless, learn, _ = zip(*held)
            row = (number, np.array(ids, np.int64).tobytes(), np.array(nameless, bool).tobytes(),
                   np.array(learn, bool).tobytes(), np.array(sizes, np.int32).tobytes(),
                   pack(narrow(np.concatenate(tokens))), zstandard.compress(b" ".join(vocab), 1))
            number, held, size = number + 1, [], 0
            return pd.DataFrame([row], columns=["chunk", "ids", "nameless", "learn", "sizes", "tokens", "words"])

        for f in frames:
            for row in zip(f["id"], f["nameless"], f["learn"], f["body"]):
                held.append(row)
                size += len(row[3])
                if size >= CHUNK_BYTES:
                    yield chunk()
        if held:
            yield chunk()

    narrowed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
                           F.col(id_col).isNull().alias("nameless"), text_bytes(text_col).alias("body"),
                           F.col(learn_col).alias("learn"))
    return stage(narrowed.mapInPandas(rows, _CHUNK), "chunks")


class Chunk:
    """A chunk's texts as arrays: tokens, their documents, what is learned."""

    def __init__(self, row):
        self.ids = pd.array(np.frombuffer(row.ids, np.int64), dtype="Int64")
        self.ids[np.frombuffer(row.nameless, bool)] = pd.NA
        self.learn = np.frombuffer(row.learn, bool)
        self.sizes = np.frombuffer(row.sizes, np.int32)
        self.tokens = unpack(row.tokens).astype(np.int64)
        self.learned = np.repeat(self.learn, self.sizes)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)


def _word_shard(words: list[bytes], shards: int) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(shards)).astype(np.int64)


def _gram_shard(grams: np.ndarray, count: np.ndarray, shards: int, split: int) -> np.ndarray:
    """Shards of n-grams: by the context, so that a context's n-grams stand
    together in one trie. A context that was learned more than ``split`` times
    is dealt over more shards, by the last word."""
    def mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
        h = (h ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(32))

    parts = count // split + 1
    part = np.where(parts > 1, mixed(np.zeros(len(grams), np.uint64), grams[:, -1] + 1) % parts.astype(np.uint64), 0)
    h = np.zeros(len(grams), np.uint64)
    for k in range(grams.shape[1] - 1):
        h = mixed(h, grams[:, k])
    return (mixed(h, part) % np.uint64(shards)).astype(np.int64)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, rows in order) for each shard that has rows."""
    order = np.argsort(narrow(shard), kind="stable")  # small types are sorted by their digits
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(shard[part[0]]), part


# ------------------------------------------------------------------ first order: words

def _word_requests(chunks: DataFrame, shards: int) -> DataFrame:
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                c, words = Chunk(r), zstandard.decompress(r.words).split(b" ")
                counts = np.bincount(c.tokens[c.learned], minlength=len(words))
                out = [(s, r.chunk, zstandard.compress(b" ".join(map(words.__getitem__, part.tolist())), 1), pack(narrow(counts[part])),
                        pack(narrow(np.diff(part, prepend=0)))) for s, part in _by_shard(_word_shard(words, shards))]
                yield pd.DataFrame(out, columns=["shard", "chunk", "a", "b", "c"])

    return chunks.mapInPandas(rows, _REQUEST)


def _word_answers(requests: DataFrame, shards: int) -> DataFrame:
    """Place in its chunk, number and training count of every requested word
    (the count doubled, and one more if no other chunk has the word); word numbers start at 1, 0 is the start mark."""
    def answer(f: pd.DataFrame) -> pd.DataFrame:
        numbers = numbered()
        asked, shard = [], int(f["shard"].iloc[0])
        for words in f["a"]:
            words = zstandard.decompress(words).split(b" ")
            asked.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        total, times = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        for own, counts in zip(asked, f["b"]):
            total[own] += unpack(counts).astype(np.int64)  # words are distinct within a request
            times[own] += 1
        out = [(chunk, 1, shard, _framed(places) + _framed(pack(narrow(own * shards + shard + 1))),
                pack(narrow(total[own] * 2 + (times[own] == 1))), 0, 0, 0) for chunk, places, own in zip(f["chunk"], f["c"], asked)]
        # a shard's sums, for the corpus' totals
        out.append((-1, 1, shard, b"", b"", int(total.sum()), int((total > 0).sum()), len(numbers)))
        return pd.DataFrame(out, columns=_columns(_ANSWER))

    return requests.groupBy("shard").applyInPandas(answer, _ANSWER)


# ------------------------------------------------------------------ all orders, seen from a chunk

def look_up(grams: np.ndarray, count: np.ndarray, above: np.ndarray, order: int, words: int) -> np.ndarray:
    """Codes of distinct n-grams in order, by their training counts and those
    of their contexts: the ones that were learned are stored as a trie, which
    is opened memory-mapped and searched for all."""
    seen = np.flatnonzero(count > 0)
    share = count[seen] / (above[seen] + prior_weight(above[seen], order))
    with tempfile.TemporaryDirectory() as folder:
        Trie.build(grams[seen], quantise(share), words).save(folder)
        return Trie.open(folder).find(grams)


class Levels:
    """The n-grams of a chunk, order by order, with the answers up to an
    order. A node is a distinct n-gram of the chunk; ``node`` gives the one
    that ends at each token, -1 if there is none."""

    def __init__(self, chunk: Chunk, answers: pd.DataFrame, upto: int, gram_shards: int, split: int, min_context: int,
                 words: int):
        self.chunk, self.gram_shards, self.split, self.min_context = chunk, gram_shards, split, min_context
        self.words = words
        n = int(chunk.tokens.max()) + 1
        number, count, alone = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for r in answers[answers["level"] == 1].itertuples():
            steps, numbers = map(unpack, _frames(r.a))
            places = np.cumsum(steps.astype(np.int64))
            number[places] = numbers.astype(np.int64)
            told = unpack(r.b).astype(np.int64)
            count[places], alone[places] = told >> 1, (told & 1).astype(bool)
        self.first = np.zeros(len(chunk.tokens), bool)
        self.first[chunk.starts] = True
        # words in the order of their numbers, so that n-grams come out in order; node 0 is the start mark, which
        # stands before every learned text as the end stands after it
        order = np.argsort(number)
        place = np.empty(n, np.int64)
        place[order] = np.arange(1, n + 1)
        self.number = np.append(0, number[order])
        self.word_count = np.append(count[0], count[order])
        self.token = place[chunk.tokens]
        self.order, self.node = 1, self.token
        self.paths, self.count = self.number[:, None], self.word_count
        self.alone = np.append(False, alone[order])  # no other chunk has it
        self.terms: list[tuple[np.ndarray, np.ndarray]] = []  # per order: code and context count of each token
        for level in range(2, upto + 1):
            self.extend()
            codes, told = np.zeros(len(self.grams), np.uint16), np.zeros(len(self.grams), np.int64)
            parts = dict(_by_shard(self.shard()))
            for r in answers[answers["level"] == level].itertuples():
                codes[self.asked[parts[r.shard]]] = unpack(r.a)
                if r.b:  # the last order has nothing to follow
                    told[self.asked[parts[r.shard]]] = unpack(r.b).astype(np.int64)
            k = self.kept
            codes[k] = look_up(self.grams[k], self.own[k], self.context[k], level, self.words)
            told[k] = self.own[k] * 2 + 1
            self.answered(codes, told >> 1, (told & 1).astype(bool))

    def extend(self) -> None:
        """Form the n-grams of the next order: the context that ends before a
        token, and the token. A first token has the start mark before it and
        nothing in higher orders."""
        self.order += 1
        before = np.concatenate(([-1], self.node[:-1]))
        before[self.first] = 0 if self.order == 2 else -1
        self.has = np.flatnonzero(before >= 0)
        words = len(self.number)
        keys, self.inverse = distinct(before[self.has] * words + self.token[self.has], len(self.count) * words)
        context = keys // words
        self.grams = np.concatenate((self.paths[context], self.number[keys % words][:, None]), axis=1)
        self.context = self.count[context]
        rare = self.context < (self.min_context if self.order > 2 else 0)
        self.context[rare] = 0
        self.own = np.bincount(self.inverse[self.chunk.learned[self.has]], minlength=len(self.grams))
        alone = self.alone[context]
        self.asked, self.kept = np.flatnonzero(~rare & ~alone), np.flatnonzero(~rare & alone)

    def shard(self) -> np.ndarray:
        return _gram_shard(self.grams[self.asked], self.context[self.asked], self.gram_shards, self.split)

    def requests(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(shard, n-grams, own training counts, context counts)."""
        for s, part in _by_shard(self.shard()):
            rows = self.asked[part]
            yield s, pack_grams(self.grams[rows]), pack(narrow(self.own[rows])), pack(narrow(self.context[rows]))

    def answered(self, codes: np.ndarray, counts: np.ndarray, alone: np.ndarray) -> None:
        code, seen = np.zeros(len(self.node), np.uint16), np.zeros(len(self.node), np.int64)
        code[self.has], seen[self.has] = codes[self.inverse], self.context[self.inverse]
        self.terms.append((code, seen))
        self.node = np.full(len(self.node), -1)
        self.node[self.has] = self.inverse
        self.paths, self.count, self.alone = self.grams, counts, alone


def _columns(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _gram_requests(chunks: DataFrame, answers: DataFrame, upto: int, shape: tuple) -> DataFrame:
    def rows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in left.itertuples():
            levels = Levels(Chunk(r), right, upto, *shape)
            levels.extend()
            out += [(s, r.chunk, a, b, c) for s, a, b, c in levels.requests()]
        return pd.DataFrame(out, columns=["shard", "chunk", "a", "b", "c"])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(rows, _REQUEST)


def _gram_answers(requests: DataFrame, order: int, words: int, last: bool) -> DataFrame:
    """Add up a shard's n-grams, store them as a trie, and look up what each
    chunk asked for. Counts are told doubled, and one more if no other chunk
    has asked; not for the last order, which is no context."""
    def answer(f: pd.DataFrame) -> pd.DataFrame:
        shard = int(f["shard"].iloc[0])
        asked = [unpack_grams(a) for a in f["a"]]
        own = np.concatenate([unpack(b).astype(np.int64) for b in f["b"]])
        context = np.concatenate([unpack(c).astype(np.int64) for c in f["c"]])
        grams = np.concatenate(asked)
        order_ = row_order(grams, words)
        ordered = grams[order_]
        new = np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(axis=1)))
        first = np.flatnonzero(new)
        count = np.add.reduceat(own[order_], first)
        back = np.empty(len(grams), np.int64)
        back[order_] = np.cumsum(new) - 1
        codes = look_up(ordered[first], count, context[order_[first]], order, words)
        told = count * 2 + (np.diff(first, append=len(grams)) == 1)  # n-grams are distinct within a request
        out, at = [], 0
        for chunk, rows in zip(f["chunk"], asked):
            mine = back[at:at + len(rows)]
            at += len(rows)
            out.append((chunk, order, shard, pack(codes[mine]), b"" if last else pack(narrow(told[mine])), 0, 0, 0))
        return pd.DataFrame(out, columns=_columns(_ANSWER))

    return requests.groupBy("shard").applyInPandas(answer, _ANSWER)


def score_texts(docs: DataFrame, *, learn_col: str, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                min_context: int = MIN_CONTEXT) -> DataFrame:
    """Score every row of ``docs`` with the model of the rows whose
    ``learn_col`` is true: (id, learned, n_tokens, n_known, train_tokens,
    base_score, score), scores as log10 probabilities."""
    chunks = encode(docs, id_col=id_col, text_col=text_col, learn_col=learn_col)
    n_chunks = chunks.count()
    word_shards, gram_shards = max(1, n_chunks // WORD_SHARD_CHUNKS), max(1, n_chunks)
    answers = stage(_word_answers(_word_requests(chunks, word_shards), word_shards), "words")
    sums = answers.where("chunk = -1").agg(F.sum("tokens"), F.sum("words"), F.max("numbers")).first()
    tokens, known, numbers = (x or 0 for x in sums)
    answers = answers.where("chunk >= 0").select("chunk", "level", "shard", "a", "b")
    words = numbers * word_shards + 1
    shape = (gram_shards, max(1, tokens // (SPLITS * gram_shards)), min_context, words)
    chunks = chunks.drop("words")
    for level in range(2, order + 1):
        found = stage(_gram_answers(_gram_requests(chunks, answers, level - 1, shape), level, words,
                                    level == order), f"order-{level}")
        answers = answers.unionByName(found.select("chunk", "level", "shard", "a", "b"))
    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in left.itertuples():
            c = Chunk(r)
            levels = Levels(c, right, order, *shape)
            count = levels.word_count[levels.token]
            p = (count + 1) / (tokens + known + 1)
            base = np.add.reduceat(np.log10(p), c.starts)
            for level, (code, seen) in enumerate(levels.terms, 2):
                # a context that was never seen, or is too rare, passes through
                rest = prior_weight(seen, level)
                p = probability(code) + np.where(seen > 0, rest / np.maximum(seen + rest, 1.0), 1.0) * p
            out.append(pd.DataFrame({
                "id": c.ids, "learned": c.learn, "n_tokens": c.sizes.astype(np.int64),
                "n_known": np.add.reduceat((count > 0).astype(np.int64), c.starts), "train_tokens": tokens,
                "base_score": base, "score": np.add.reduceat(np.log10(p), c.starts)}))
        return pd.concat(out) if out else pd.DataFrame(columns=_columns(_SCORES))

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, _SCORES)
