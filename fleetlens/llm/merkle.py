"""Merkle dataset manifest (operator 13): a tree of SHA-256 midstates.

Every row is a leaf, the digest of its fields. Per group (a source) the
leaves stand in order of a key; 16 consecutive nodes become one parent, the
digest of their digests as hex text, until one node, the group's subroot, is
left. The subroots, in order of their groups, are folded likewise into the
root. A digest as hex text is 64 bytes, one whole SHA-256 block, so the hash
state of a parent before a child's slot is eight words without any pending
byte: the parent keeps a copy of it for each of its slots. When a child
changes, the parent's new digest is computed from the state before its slot,
the new digest and the siblings to its right only; those to the left are not
hashed again. States are columns of a written table (hashlib's own copies
could not leave their process), resumed for all rows of a batch at once in
numpy.

Rows are placed without a single-task sort: one global range sort over
digests, counts per (partition, group), and a running sum over those counts.
Texts are read in the scan only; what is shuffled is a digest per row. A level
is one grouping by (tree, position / 16), so a group with a third of all rows
is no larger task than any other. Everything that leads from a run of leaves
up to the root (siblings, slots, states) is handed down level by level, once
per run and not once per row.

Defined cases: rows without an order key come first; rows that share group
and key are ordered by their leaf, equal rows are interchangeable; a null
group is a group of its own, the first; a group of one row has that leaf as
its subroot, a single group's subroot is the root; a null field counts as
``-``, unlike the empty text, ``0:``. Only the named columns are carried, so
other columns of any name do no harm. An empty table has no root and gives no
rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, struct_of

FANOUT = 16
CHUNK = 256  # runs that are folded at once


# --- SHA-256 on arrays ----------------------------------------------------

def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _cube_root(x: int) -> int:
    r = round(x ** (1 / 3))
    while r ** 3 > x:
        r -= 1
    while (r + 1) ** 3 <= x:
        r += 1
    return r


# fractional parts of the square and cube roots of the first primes, 32 bits each
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
_HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), np.uint16)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8, n) after one more block (16, n) of big-endian words."""
    w = list(block)
    for i in range(16, 64):
        s0 = _turn(w[i - 15], 7) ^ _turn(w[i - 15], 18) ^ (w[i - 15] >> np.uint32(3))
        s1 = _turn(w[i - 2], 17) ^ _turn(w[i - 2], 19) ^ (w[i - 2] >> np.uint32(10))
        w.append(w[i - 16] + s0 + w[i - 7] + s1)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        t1 = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + ROUND[i] + w[i]
        t2 = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = t1 + t2, a, b, c, d + t1, e, f, g
    return state + np.stack((a, b, c, d, e, f, g, h))


def hex_block(digests: np.ndarray) -> np.ndarray:
    """(16, n) words of the hex texts of ``digests``, (n, 32) bytes."""
    return _HEX[digests].view(">u4").astype(np.uint32).T


def last_block(n_blocks: np.ndarray) -> np.ndarray:
    """(16, n): the closing block of messages of so many whole blocks."""
    out = np.zeros((16, len(n_blocks)), np.uint32)
    out[0], out[15] = 0x80000000, n_blocks * 512
    return out


def _bytes(state: np.ndarray) -> np.ndarray:
    """(n, 32) bytes of states (8, n)."""
    return np.ascontiguousarray(state.T).astype(">u4").view(np.uint8).reshape(-1, 32)


@F.pandas_udf(struct_of(digest="binary", states="binary"))
def _parent(kids: pd.Series) -> pd.DataFrame:
    """Digest of the hex texts of a run's digests, and the hash states before
    each of its slots."""
    digests, states = [None] * len(kids), [b""] * len(kids)
    sizes = np.array([len(k) // 32 for k in kids])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for part in np.split(rows, range(4096, len(rows), 4096)):
            nodes = np.frombuffer(b"".join(kids.iloc[part]), np.uint8).reshape(len(part), size, 32)
            state, before = np.repeat(START[:, None], len(part), axis=1), []
            for slot in range(size):
                before.append(_bytes(state))
                state = compress(state, hex_block(nodes[:, slot]))
            ends = _bytes(compress(state, last_block(np.full(len(part), size))))
            kept = np.stack(before, axis=1)
            for i, row in enumerate(part):
                digests[row], states[row] = ends[i].tobytes(), kept[i].tobytes()
    return pd.DataFrame({"digest": digests, "states": states})


_parent = _parent.asNondeterministic()


def _padded(parts: list[bytes]) -> np.ndarray:
    """(n, FANOUT, 32) bytes."""
    return np.frombuffer(b"".join(x.ljust(32 * FANOUT, b"\0") for x in parts), np.uint8).reshape(-1, FANOUT, 32)


def resume(states: np.ndarray, nodes: np.ndarray, slots: np.ndarray, sizes: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """New digests (n, 32) of parents with ``nodes`` (n, FANOUT, 32), of which
    ``sizes`` count, when the child at ``slots`` becomes ``digests``: each
    parent's state before that slot is resumed with the new child and the
    siblings on its right."""
    state = states.reshape(-1, 32).copy().view(">u4").astype(np.uint32).T.copy()
    nodes = nodes.copy()
    nodes[np.arange(len(nodes)), slots] = digests
    for at in range(slots.min(), sizes.max()):
        on = np.flatnonzero((slots <= at) & (at < sizes))
        if len(on):
            state[:, on] = compress(state[:, on], hex_block(nodes[on, at]))
    return _bytes(compress(state, last_block(sizes)))


# --- leaves and places ----------------------------------------------------

def record_digest(*fields: Column) -> Column:
    """Hex SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte
    count, ``:`` and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


def _placed(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``tree`` (a number per group, ascending with the groups),
    ``n`` (rows of the group) and ``pos`` (place in it, from 0). ``order``
    must leave no ties."""
    line = stage(rows.orderBy(group, *order).withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", 33).alias("_part")
    runs = Window.partitionBy("_group")
    pieces = (line.groupBy(F.col(group).alias("_group"), part)
              .agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
              .select("_group", "_part", "_first", F.min("_first").over(runs).alias("tree"),
                      F.sum("_n").over(runs).alias("n"),
                      (F.sum("_n").over(runs.orderBy("_part")) - F.col("_n")).alias("_before")))
    pieces = stage(pieces, f"{label}-pieces").withColumnRenamed("_part", "_piece")
    met = line.withColumn("_part", part).join(
        pieces, (F.col("_part") == F.col("_piece")) & F.col(group).eqNullSafe(F.col("_group")))
    return met.select(*rows.columns, "tree", "n", (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"))


# --- the tree -------------------------------------------------------------

_UP = {"up_slot": "array<int>", "up_kids": "array<binary>", "up_state": "array<binary>"}


def _runs(nodes: DataFrame) -> DataFrame:
    """One row per run of nodes: (tree, n_up, run, lone, items, kids, digest,
    states). A lone leaf is a run of itself."""
    n_up, run = F.ceil(F.col("n") / FANOUT).cast("long"), F.floor(F.col("pos") / FANOUT).cast("long")
    rest = [c for c in nodes.columns if c not in ("tree", "n")]  # pos, digest and, for leaves, item
    got = (nodes.groupBy("tree", n_up.alias("n_up"), run.alias("run"), (F.col("n") == 1).alias("lone"))
           .agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("v")))
    got = got.select("tree", "n_up", "run", "lone", *([F.col("v.item").alias("items")] if "item" in rest else []),
                     F.aggregate("v", F.lit(b""), lambda a, x: F.concat(a, x["digest"])).alias("kids"))
    return (got.withColumn("_p", _parent("kids"))
            .select(*got.columns, F.col("_p.digest").alias("digest"), F.col("_p.states").alias("states")))


def _climb(nodes: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level of all trees, each level a written table, and
    the trees' last nodes (tree, digest)."""
    levels: list[DataFrame] = []
    while True:
        runs = stage(_runs(nodes), f"{label}-{len(levels)}")
        levels.append(runs)
        if runs.agg(F.max("n_up")).first()[0] in (None, 1):
            break
        nodes = runs.where("n_up > 1").select("tree", F.col("n_up").alias("n"), F.col("run").alias("pos"), "digest")
    last = F.when(F.col("lone"), F.col("kids")).otherwise(F.col("digest")).alias("digest")
    tops = [runs.where("n_up = 1").select("tree", last) for runs in levels]
    return levels, reduce(DataFrame.unionByName, tops)


def _under(lower: DataFrame, upper: DataFrame, pos: str) -> DataFrame:
    """``lower``, nodes at ``pos`` of their trees, with the way up through
    their runs ``upper``: that run's siblings, slot and state, then its way."""
    above = upper.select(*[F.col(c).alias(f"_{c}") for c in ("tree", "run", "lone", "kids", "states", "subroot", *_UP)])
    met = lower.join(above, (F.col("tree") == F.col("_tree")) & (F.floor(F.col(pos) / FANOUT).cast("long") == F.col("_run")))
    slot = (F.col(pos) % FANOUT).cast("int")
    own = {"up_slot": slot, "up_kids": F.col("_kids"), "up_state": F.substr("_states", slot * 32 + 1, F.lit(32))}
    return met.select(*lower.columns, F.col("_subroot").alias("subroot"),
                      *[F.when(F.col("_lone"), F.col(f"_{c}")).otherwise(F.concat(F.array(x), f"_{c}")).alias(c)
                        for c, x in own.items()])


def _ways(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest runs with their way to the root, handed down from
    ``tops``, the way of each tree's last node."""
    upper = None
    for runs in reversed(levels):
        ends = runs.where("n_up = 1").join(tops, "tree")
        upper = ends if upper is None else ends.unionByName(_under(runs.where("n_up > 1"), upper, "run"))
    return upper


@dataclass
class Manifest:
    """``root``: hex digest, None without rows. ``runs``: a written table of
    the runs of leaves with their items, retained states, subroot, and the
    siblings, slots and states on their way to the root."""

    root: str | None
    runs: DataFrame


def build_manifest(rows: DataFrame, *, group_col: str, order_col: str, leaf: Column, changed: Column | None = None,
                   keep: list[str] = ()) -> Manifest:
    """The manifest of ``rows``: their ``leaf`` digests (hex) in order of
    ``order_col`` within ``group_col``, and the trees above. ``changed`` is
    the digest of a row's present content where that is to be checked against
    the manifest, null elsewhere. ``keep``: columns to carry with a leaf."""
    new = F.lit(None).cast("binary") if changed is None else F.unhex(changed)
    leaves = rows.select(F.col(group_col).alias("group"), F.col(order_col).alias("at"), F.unhex(leaf).alias("digest"),
                         F.struct(F.monotonically_increasing_id().alias("row"), new.alias("changed"),
                                  *[F.col(c).alias(f"keep_{c}") for c in keep]).alias("item"))
    leaves = stage(leaves.withColumn("row", F.col("item.row")), "merkle-leaves")
    placed = _placed(leaves, "group", ["at", "digest", "row"], "merkle-order")
    levels, subroots = _climb(placed.select("tree", "n", "pos", "digest", "item"), "merkle-level")
    subroots = subroots.select(F.lit(0).alias("all"), F.col("tree").alias("of"), "digest")
    subroots = stage(_placed(subroots, "all", ["of"], "merkle-subroots"), "merkle-subroots")
    top_levels, last = _climb(subroots.select("tree", "n", "pos", "digest"), "merkle-top")
    root = last.first()
    nothing = last.select("tree", F.lit(None).cast("binary").alias("subroot"),
                          *[F.array().cast(t).alias(c) for c, t in _UP.items()])
    tops = _under(subroots.select("tree", "pos", "of", F.col("digest").alias("own")), _ways(top_levels, nothing), "pos")
    tops = stage(tops.select(F.col("of").alias("tree"), F.col("own").alias("subroot"), *_UP), "merkle-tops")
    return Manifest(root and root["digest"].hex(), stage(_ways(levels, tops), "merkle-manifest"))


# --- proofs ---------------------------------------------------------------

def _proofs(kids: bytes, lone: bool, up_slot, up_kids) -> list[str]:
    """Per child the digest of all siblings on its way to the root."""
    above = b"".join(k[:32 * s] + k[32 * s + 32:] for s, k in zip(up_slot, up_kids)).hex().encode()
    out = []
    for at in range(0, len(kids), 32):
        own = b"" if lone else kids[:at] + kids[at + 32:]
        h = hashlib.sha256(own.hex().encode())
        h.update(above)
        out.append(h.hexdigest())
    return out


def _fold(f: pd.DataFrame) -> list[list[str]]:
    """Per run and child the root that follows from the child's digest, or
    the one in ``changed``, and the recorded siblings."""
    sizes = np.array([len(k) // 32 for k in f["kids"]])
    owner = np.repeat(np.arange(len(f)), sizes)
    slots = np.concatenate([np.arange(n) for n in sizes])
    nodes, states = _padded(list(f["kids"])), _padded(list(f["states"]))
    now = nodes[owner, slots]
    for row, new in enumerate(x for part in f["changed"] for x in part):
        if new is not None:
            now[row] = np.frombuffer(new, np.uint8)
    up = np.flatnonzero(~f["lone"].to_numpy(bool)[owner])
    if len(up):
        o, s = owner[up], slots[up]
        now[up] = resume(states[o, s], nodes[o], s, sizes[o], now[up])
    # children that leave their run's digest as it is go on as one
    same = np.concatenate((owner.astype(">u4")[:, None].view(np.uint8), now), axis=1)
    _, first, back = np.unique(np.ascontiguousarray(same).view("V36").ravel(), return_index=True, return_inverse=True)
    owner, now = owner[first], now[first]
    for level in range(max(map(len, f["up_slot"]))):
        have = [i for i, p in enumerate(f["up_slot"]) if len(p) > level]
        place = np.full(len(f), -1)
        place[have] = np.arange(len(have))
        kids = [f["up_kids"].iloc[i][level] for i in have]
        nodes, count = _padded(kids), np.array([len(k) // 32 for k in kids])
        state = np.frombuffer(b"".join(f["up_state"].iloc[i][level] for i in have), np.uint8).reshape(-1, 32)
        slot = np.array([f["up_slot"].iloc[i][level] for i in have])
        up = np.flatnonzero(place[owner] >= 0)
        o = place[owner[up]]
        now[up] = resume(state[o], nodes[o], slot[o], count[o], now[up])
    roots = [x.tobytes().hex() for x in now]
    ends = np.cumsum(sizes)
    back = back.ravel()
    return [[roots[i] for i in back[end - n:end]] for n, end in zip(sizes, ends)]


@F.pandas_udf(struct_of(**{"proof": "string[]", "folded": "string[]"}))
def _check(kids: pd.Series, states: pd.Series, lone: pd.Series, changed: pd.Series, up_slot: pd.Series,
           up_kids: pd.Series, up_state: pd.Series) -> pd.DataFrame:
    f = pd.DataFrame({"kids": kids, "states": states, "lone": lone, "changed": changed, "up_slot": up_slot,
                      "up_kids": up_kids, "up_state": up_state})
    proofs = [_proofs(*x) for x in zip(kids, lone, up_slot, up_kids)]
    folded = [x for at in range(0, len(f), CHUNK) for x in _fold(f.iloc[at:at + CHUNK])]
    return pd.DataFrame({"proof": proofs, "folded": folded})


_check = _check.asNondeterministic()


def verify_manifest(manifest: Manifest) -> DataFrame:
    """Every leaf with the columns it carries, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256`` (digest of all siblings on its way up), ``folded_root``
    (from its changed digest, if any, else its own) and ``verified``."""
    runs = manifest.runs
    checked = runs.select("kids", "items", "subroot", _check(
        "kids", "states", "lone", F.col("items.changed"), "up_slot", "up_kids", "up_state").alias("c"))
    slots = F.sequence(F.lit(0), F.size("items") - 1)
    rows = checked.select("subroot", F.explode(F.transform(slots, lambda i: F.struct(
        F.get("items", i).alias("item"), F.substr("kids", i * 32 + 1, F.lit(32)).alias("leaf"),
        F.get("c.proof", i).alias("proof"), F.get("c.folded", i).alias("folded")))).alias("r"))
    kept = [c for c in runs.schema["items"].dataType.elementType.names if c.startswith("keep_")]
    hexed = lambda c: F.lower(F.hex(c))
    root = F.lit(manifest.root).cast("string")
    return rows.select(*[F.col(f"r.item.`{c}`").alias(c.removeprefix("keep_")) for c in kept],
                       hexed("r.leaf").alias("leaf"), hexed("subroot").alias("subroot"), root.alias("root"),
                       F.col("r.proof").alias("proof_sha256"), F.col("r.folded").alias("folded_root"),
                       (F.col("r.folded") == root).alias("verified"))
