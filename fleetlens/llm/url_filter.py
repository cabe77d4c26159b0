"""URL filters (operator 7): a path-template tree per host, in DataFrame
operations only.

Host and path rules decide the urls they fit. What they decide also labels
the tree. Rows are counted per distinct (host, path), and the paths form a
tree of segments, built level by level. Whether a segment is variable follows
from counts of its own branch: one that leads to at least ``min_paths``
distinct paths is a section and stays a literal, an identifier that leads to
fewer becomes a wildcard (with its file extension). Neither the number of
other sections nor repeated rows matter. Literal siblings whose rows carry
the same mix of blocked and allowed urls, as far as a two-proportion test can
tell, are merged into one branch. The leaves are the templates, and a url
without a rule is rejected if its template's purity - the share of its rows
that are labelled blocked, smoothed towards the host's and the host's towards
the overall share - reaches a threshold.

The levels follow the data: they end once no node is left that could hold a
literal, and the rest of every path is wild. Each level reads only the paths
that reach it. Siblings are compared as cells of a grid of their shares (at
most 64 x 64 a parent), so a parent with millions of literals is no single
task, and keys that hold many rows meet their literals, templates and paths
by a broadcast of bounded size (``common.lookup``).

Defined cases: urls that are null or without ``://`` have an empty host and
path, fit no rule and form one template; repeated rows count each; an empty
table gives an empty table. An added column replaces one of the same name.
The pages themselves are read twice and joined once with their paths.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keeps_names, lookup, replace_columns, stage

GRID = 64  # steps of a share, on the scale on which its variance depends on its count only
NAMED = 8  # a merged branch of more segments is named by its first and their number
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # block or allow

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (length, rule, verdict) of the longest rule that fits, or null."""
    if not rules:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    fits = [F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
                   F.struct(F.lit(len(r.text)).alias("length"), F.lit(r.text).alias("rule"),
                            F.lit(r.verdict).alias("verdict"))) for r in rules]
    return F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull()))


def _segments(path: Column) -> Column:
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(path, "^/", ""), "/"))


def _wild(segment: Column) -> Column:
    return F.concat(F.lit("*"), F.regexp_extract(segment, r"\.[A-Za-z0-9]{1,5}$", 0))


def _literals(here: DataFrame, min_paths: int, z: float) -> DataFrame:
    """(_host, _prefix, _segment, _name, p): the segments that stay literal
    with the name of their merged branch and their number of paths."""
    found = (here.groupBy("_host", "_prefix", "_segment")
             .agg(F.count("*").alias("p"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("a").alias("a"))
             .where(F.col("p") >= min_paths))

    def at(c: str) -> Column:
        share = (F.col(c) + 0.5) / (F.col("n") + 1.0)
        return F.least(F.floor(F.asin(F.sqrt(share)) * (2 * GRID / math.pi)), F.lit(GRID - 1)).cast("int")

    found = stage(found.withColumns({"_gb": at("b"), "_ga": at("a")}), "url-literals")
    cells = (found.groupBy("_host", "_prefix", "_gb", "_ga")
             .agg(*[F.sum(c).alias(c) for c in "nba"], F.count("*").alias("m"), F.min("_segment").alias("first")))
    # cells in order of their shares; a new branch starts where a share differs significantly from the cell before
    order = Window.partitionBy("_host", "_prefix").orderBy("_gb", "_ga")
    cells = cells.withColumns({f"p{c}": (F.col(c) + 0.5) / (F.col("n") + 1.0) for c in "ba"})

    def near(p: str) -> Column:
        before, n_before = F.lag(p).over(order), F.lag("n").over(order)
        return F.abs(F.col(p) - before) <= z * F.sqrt(
            F.col(p) * (1 - F.col(p)) / F.col("n") + before * (1 - before) / n_before)

    cells = cells.withColumn("_new", F.when(near("pb") & near("pa"), 0).otherwise(1))
    cells = cells.withColumn("_branch", F.sum("_new").over(order))
    branch = Window.partitionBy("_host", "_prefix", "_branch")
    cells = stage(cells.select("_host", "_prefix", "_gb", "_ga", "m", "_branch", F.sum("m").over(branch).alias("_members"),
                               F.min("first").over(branch).alias("_first")), "url-branches")
    named = lookup(found.select("_host", "_prefix", "_segment", "p", "_gb", "_ga"), cells,
                   ["_host", "_prefix", "_gb", "_ga"], "m")
    # a number sign is in no segment, so the name of a large branch is no segment's
    large = named.where(F.col("_members") > NAMED).withColumn("_name", F.concat("_first", F.lit("|#"), "_members"))
    small = named.where(F.col("_members") <= NAMED).withColumn(
        "_name", F.array_join(F.sort_array(F.collect_list("_segment").over(branch)), "|"))
    return stage(large.unionByName(small).select("_host", "_prefix", "_segment", "_name", "p"), "url-names")


def path_templates(paths: DataFrame, *, min_paths: int, z: float) -> DataFrame:
    """Of (_host, _path, n, b, a), one row per distinct path with the number
    of its rows, blocked and allowed ones: the same with its ``_prefix``, the
    template below the host."""
    open_ = paths.withColumns({"_segments": _segments(F.col("_path")), "_prefix": F.lit("")})
    done, level = [], 0
    while True:
        here = open_.where(F.size("_segments") > level).withColumn("_segment", F.get("_segments", F.lit(level)))
        done.append(open_.where(F.size("_segments") <= level))
        most = here.groupBy("_host", "_prefix").count().agg(F.max("count")).first()[0]
        if most is None:
            break
        if most < min_paths:  # no node left can hold a literal
            rest = F.transform(F.expr(f"slice(_segments, {level + 1}, size(_segments))"), _wild)
            done.append(here.withColumn("_prefix", F.concat("_prefix", F.lit("/"), F.array_join(rest, "/"))))
            break
        literals = _literals(here, min_paths, z)
        step = F.concat("_prefix", F.lit("/"), F.coalesce("_name", _wild(F.col("_segment"))))
        open_ = stage(lookup(here, literals, ["_host", "_prefix", "_segment"], "p")
                      .withColumn("_prefix", step).drop("_segment", "_name"), f"url-paths-{level}")
        level += 1
    columns = ["_host", "_path", "n", "b", "a", "_prefix"]
    return reduce(DataFrame.unionByName, [d.select(*columns) for d in done])


@keeps_names
def filter_urls(pages: DataFrame, rules: list[Rule], *, url_col: str = "url", min_paths: int = 5, z: float = 1.96,
                smoothing: float = 10.0, threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule (null without one), verdict, template
    and purity (smoothed share of blocked rows of the template)."""
    host, path = host_and_path(url_col)
    rows = pages.withColumns({"_host": host, "_path": path})
    paths = rows.groupBy("_host", "_path").agg(F.count("*").alias("n"))
    verdict = rule_of(F.col("_host"), F.col("_path"), rules)["verdict"]
    paths = stage(paths.withColumns({c: F.when(verdict == v, F.col("n")).otherwise(F.lit(0).cast("long"))
                                     for c, v in (("b", "block"), ("a", "allow"))}), "url-paths")
    paths = stage(path_templates(paths, min_paths=min_paths, z=z), "url-templated")
    templates = stage(paths.groupBy("_host", "_prefix").agg(
        F.count("*").alias("p"), F.sum("n").alias("n"), F.sum("b").alias("b")), "url-templates")
    hosts = templates.groupBy("_host").agg(F.count("*").alias("m"), F.sum("n").alias("hn"), F.sum("b").alias("hb"))
    whole = templates.agg(F.sum("b") / F.sum("n")).first()[0] or 0.0
    host_share = (F.col("hb") + smoothing * whole) / (F.col("hn") + smoothing)
    purity = (F.col("b") + smoothing * host_share) / (F.col("n") + smoothing)
    judged = stage(lookup(templates, stage(hosts, "url-hosts"), ["_host"], "m")
                   .select("_host", "_prefix", "p", purity.alias("_purity")), "url-judged")
    known = stage(lookup(paths.select("_host", "_path", "_prefix", "n"), judged, ["_host", "_prefix"], "p"), "url-known")
    out = lookup(rows, known, ["_host", "_path"], "n").withColumn(
        "_rule", rule_of(F.col("_host"), F.col("_path"), rules))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("_purity") >= threshold, "block").otherwise("allow"))
    return replace_columns(out, {
        "host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_rule.rule"), "verdict": verdict,
        "template": F.concat("_host", "_prefix"), "purity": F.col("_purity"),
    }).drop("_host", "_path", "_rule", "_prefix", "_purity")
