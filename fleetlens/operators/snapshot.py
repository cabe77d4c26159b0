"""Snapshot and state comparison.

Two snapshots of a file or record set are compared by key and content hash.
Only (key, hash) pairs are shuffled: content never enters a join. Both sides
are keyed on ``project`` plus the entity key, so a snapshot table bucketed
(or partitioned) on those columns joins without an exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import module_of, symbol_of, basename

# Extensions probed, in this order, when a symbol's source file
# is looked up inside its module folder.
SOURCE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]


def _path_filter(df: DataFrame, column: str, patterns: Sequence[str] | None) -> DataFrame:
    if not patterns:
        return df
    cond: Column | None = None
    for p in patterns:
        c = F.col(column).contains(p)
        cond = c if cond is None else (cond | c)
    return df.where(cond)


def diff_snapshots(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("project", "path"),
                   hash_col: str = "content_hash", path_filter: Sequence[str] | None = None,
                   filter_column: str | None = None) -> DataFrame:
    """Full outer join of two snapshots on ``keys``.

    Returns ``keys + [status, old_hash, new_hash]`` with status ``added``
    (only new), ``removed`` (only old) or ``modified`` (both, hash differs).
    Equal hashes give no row. ``path_filter`` keeps keys containing any of
    the substrings; it is applied to both inputs before the join because
    Catalyst does not push a filter on the coalesced key through a full
    outer join.
    """
    keys = list(keys)
    fcol = filter_column or keys[-1]
    o = _path_filter(old.select(*keys, F.col(hash_col).alias("old_hash"), F.lit(True).alias("_in_old")),
                     fcol, path_filter)
    n = _path_filter(new.select(*keys, F.col(hash_col).alias("new_hash"), F.lit(True).alias("_in_new")),
                     fcol, path_filter)
    j = o.join(n, keys, "full_outer")
    status = (F.when(F.col("_in_old").isNull(), F.lit("added"))
              .when(F.col("_in_new").isNull(), F.lit("removed"))
              .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), F.lit("modified")))
    return (j.select(*keys, status.alias("status"), "old_hash", "new_hash")
            .where(F.col("status").isNotNull()))


def diff_at(paths: DataFrame, old: DataFrame, new: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """The changes at given paths: ``paths`` (project, path, any further
    columns) looked up in both snapshots; columns and rules as
    ``diff_snapshots``. Two joins from the few paths to the snapshots, which
    the planner may broadcast; a path that neither snapshot has gives no row."""
    o = old.select("project", "path", F.col(hash_col).alias("old_hash"), F.lit(True).alias("_in_old"))
    n = new.select("project", "path", F.col(hash_col).alias("new_hash"), F.lit(True).alias("_in_new"))
    j = paths.join(o, ["project", "path"], "left").join(n, ["project", "path"], "left")
    status = (F.when(F.col("_in_old") & F.col("_in_new"), F.when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), F.lit("modified")))
              .when(F.col("_in_old"), F.lit("removed")).when(F.col("_in_new"), F.lit("added")))
    return j.select(*paths.columns, status.alias("status"), "old_hash", "new_hash").where(F.col("status").isNotNull())


def filter_paths(changes: DataFrame, patterns: DataFrame, key: str = "path", pattern_col: str = "pattern",
                 group: Sequence[str] = ("project",)) -> DataFrame:
    """Keep the rows whose ``key`` contains any pattern of its group
    (case-sensitive substring, as the file filter of a sync run). For a
    pattern *table*; a short Python list is better served by
    ``diff_snapshots(path_filter=...)``, which filters both inputs first."""
    from .mentions import contains_join
    group = list(group)
    keys = changes.select(*group, key).distinct()
    pats = patterns.select(*group, pattern_col).distinct()
    hits = contains_join(keys, pats, key, pattern_col, group=group, text_keys=[key], needle_keys=[pattern_col],
                         case_insensitive=False).select(*group, key).distinct()
    return changes.join(hits, group + [key], "left_semi")


def pair_renames(changes: DataFrame, group: Sequence[str] = ("project",), key: str = "path") -> DataFrame:
    """Turn a removed and an added entry with the same content hash into one
    ``renamed`` row (``key`` = new key, ``previous_<key>`` = old key).

    A hash must occur exactly once among the removed and exactly once among
    the added entries of its group; other rows are left as they are. One
    aggregation on (group, hash) with map-side combine finds the pairs, so a
    hot hash (an empty file repeated a million times) collapses before the
    shuffle and is dropped; the paired rows are then removed with an anti
    join on (group, key, status), which is uniformly distributed.
    """
    group = list(group)
    prev = f"previous_{key}"
    is_rem, is_add = F.col("status") == "removed", F.col("status") == "added"
    cand = changes.where(is_rem | is_add).select(
        *group, F.when(is_rem, F.col("old_hash")).otherwise(F.col("new_hash")).alias("_h"),
        F.when(is_rem, F.col(key)).alias("_old"), F.when(is_add, F.col(key)).alias("_new"))
    pairs = (cand.groupBy(*group, "_h")
             .agg(F.count("_old").alias("_nr"), F.count("_new").alias("_na"),
                  F.min("_old").alias(prev), F.min("_new").alias(key))
             .where((F.col("_nr") == 1) & (F.col("_na") == 1)))
    renamed = pairs.select(*group, key, F.lit("renamed").alias("status"), prev,
                           F.col("_h").alias("old_hash"), F.col("_h").alias("new_hash"))
    gone = pairs.select(*group, F.explode(F.array(
        F.struct(F.col(key).alias(key), F.lit("added").alias("status")),
        F.struct(F.col(prev).alias(key), F.lit("removed").alias("status")))).alias("_g")) \
        .select(*group, F.col(f"_g.{key}").alias(key), F.col("_g.status").alias("status"))
    rest = (changes.join(gone, group + [key, "status"], "left_anti")
            .withColumn(prev, F.lit(None).cast("string")))
    return rest.unionByName(renamed.select(*rest.columns))


def diff_state(old_state: DataFrame, new_state: DataFrame, key: str = "key",
               group: Sequence[str] = ("project",), hash_col: str = "last_hash") -> DataFrame:
    """Key-level difference of two sync states on ``hash_col`` only: a change
    of the mapped lists alone is no change."""
    return (diff_snapshots(old_state, new_state, list(group) + [key], hash_col)
            .select(*group, key, "status"))


def infer_source_files(symbols: DataFrame, files: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Source file of each symbol change, looked up in ``files`` (one
    snapshot: project, path).

    ``src/<module>`` itself when it is a file; otherwise among the direct
    children of ``src/<module>/``: first ``<lower(name)><ext>`` in extension
    order, then a file with a known extension whose symbol name equals the
    change's name (smallest path first). Changes without a match get no row.
    ``extra``: columns that tell one occurrence of a change from another.
    Returns ``symbols`` columns plus ``source_path``.
    """
    parts = F.split("path", "/")
    f = files.select("project", "path")
    as_file = f.select("project", F.regexp_replace("path", "^src/", "").alias("module"),
                       F.col("path").alias("source_path"), F.lit(0).alias("_rank"),
                       F.lit(None).cast("string").alias("_stem"), F.lit(None).cast("string").alias("_sym"))
    as_file = as_file.where(~F.col("module").contains("/") & F.col("source_path").startswith("src/"))
    child = f.where((F.try_element_at(parts, F.lit(1)) == "src") & (F.size(parts) == 3)).select(
        "project", F.try_element_at(parts, F.lit(2)).alias("module"), F.col("path").alias("source_path"),
        basename("path").alias("_base"))
    ext = F.regexp_extract("_base", r"(\.[^.]*)$", 1)
    ext_rank = F.array_position(F.array(*[F.lit(e) for e in SOURCE_EXTENSIONS]), ext)
    child = child.withColumn("_ext_rank", ext_rank).where(F.col("_ext_rank") > 0)
    # rule 1: exact lower-case name plus extension, ranked by extension order
    by_stem = child.select("project", "module", "source_path", F.col("_ext_rank").cast("int").alias("_rank"),
                           F.regexp_replace("_base", r"\.[^.]*$", "").alias("_lname"))
    # rule 2: symbol name of the file equals the change's name
    by_sym = child.select("project", "module", "source_path", F.lit(100).alias("_rank"),
                          symbol_of("source_path").alias("name"))
    sym = symbols.where(F.col("module") != "").withColumn("_lname", F.lower("name"))
    m_file = sym.join(as_file.drop("_stem", "_sym"), ["project", "module"])
    m_stem = sym.join(by_stem, ["project", "module", "_lname"])
    m_sym = sym.join(by_sym, ["project", "module", "name"])
    cands = m_file.unionByName(m_stem).unionByName(m_sym)
    keys = [c for c in ("project", *extra, "path", "name", "type", "module") if c in symbols.columns]
    best = cands.groupBy(*keys).agg(
        F.min(F.struct("_rank", "source_path")).getField("source_path").alias("source_path"))
    return best


def upsert_state(state: DataFrame, updates: DataFrame, run_ts, key: str = "key",
                 group: Sequence[str] = ("project",), order_col: str = "ordinal") -> DataFrame:
    """Upsert new hashes into a sync state.

    ``updates(project, key, hash, ordinal)``: the update with the largest
    ordinal wins per key. Updated keys get the new hash and ``run_ts``, or
    the update's own ``synced_at`` where ``run_ts`` is None;
    their mapped lists are kept (empty when the key is new). Keys without an
    update stay unchanged.
    """
    group = list(group)
    last = (updates.groupBy(*group, key)
            .agg(F.max_by("hash", order_col).alias("_new_hash"),
                 *([F.max_by("synced_at", order_col).alias("_ts")] if run_ts is None else [])))
    s = state.withColumn("_in_state", F.lit(True))
    j = s.join(last, group + [key], "full_outer")
    ts = F.col("_ts") if run_ts is None else run_ts if isinstance(run_ts, Column) else F.lit(run_ts).cast("timestamp")
    upd = F.col("_new_hash").isNotNull()
    empty = F.array().cast("array<string>")
    return j.select(
        *group, key,
        F.when(upd, F.col("_new_hash")).otherwise(F.col("last_hash")).alias("last_hash"),
        F.when(upd, ts).otherwise(F.col("last_synced_at")).alias("last_synced_at"),
        F.coalesce(F.col("mapped_specs"), empty).alias("mapped_specs"),
        F.coalesce(F.col("mapped_nodes"), empty).alias("mapped_nodes"),
    )


def stale_entries(state: DataFrame, present: DataFrame, key: str = "key",
                  present_key: str | None = None, group: Sequence[str] = ("project",)) -> DataFrame:
    """State entries whose key no longer exists among ``present`` keys."""
    pk = present_key or key
    ref = present.select(*group, F.col(pk).alias(key)).distinct()
    return state.join(ref, list(group) + [key], "left_anti")


def symbols_from_changes(changes: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One symbol row per changed file: name from the file name, module from
    the path, summary '<status> file <path>', empty dependency lists.
    ``extra``: further columns to keep."""
    empty = F.array().cast("array<string>")
    return changes.select(
        "project", *extra, "path",
        symbol_of("path").alias("name"),
        F.col("status").alias("type"),
        module_of("path").alias("module"),
        F.concat_ws(" ", F.col("status"), F.lit("file"), F.col("path")).alias("summary"),
        empty.alias("affected_apis"),
        empty.alias("affected_modules"),
    )
