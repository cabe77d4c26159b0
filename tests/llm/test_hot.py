"""Templates against a plain tree, and keys that hold most rows: urls,
lines, rows equal in id and text, edge buckets of a mix."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import common, mixing, sharding
from fleetlens.llm.decontaminate import WindowSet
from fleetlens.llm.line_dedup import drop_repeated_lines
from fleetlens.llm.mixing import mix_table
from fleetlens.llm.sharding import shard_documents
from fleetlens.llm.url_filter import Rule, filter_urls


def pages_of(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


@pytest.mark.parametrize("sections", [3, 30])
def test_unrelated_sections_do_not_change_a_verdict(spark, sections):
    spam = [f"http://h.com/spam/{k}" for k in range(60)]
    other = [f"http://h.com/s{s}/{k}" for s in range(sections) for k in range(60)]
    rules = [Rule("h.com", f"/spam/{d}", "block") for d in range(1, 10)]
    got = {r.url: r for r in filter_urls(pages_of(spark, spam + other), rules).collect()}
    assert got["http://h.com/spam/0"].template == "h.com/spam/*" and got["http://h.com/spam/0"].verdict == "block"
    assert got["http://h.com/s1/7"].verdict == "allow"
    names = "s0|s1|s2" if sections == 3 else "s0|#30"
    assert got["http://h.com/s1/7"].template.startswith(f"h.com/{names}/")


def plain_templates(urls, min_paths):
    """Templates of a tree held in memory, for urls without labels: all
    literal siblings are alike and form one branch."""
    paths = defaultdict(set)
    for u in urls:
        host, _, path = u.split("://", 1)[1].partition("/")
        paths[host].add(tuple(path.split("/")))
    out = {}

    def walk(host, prefix, rest):  # rest: (path, segments left)
        by = defaultdict(list)
        for path, left in rest:
            if left:
                by[left[0]].append((path, left[1:]))
            else:
                out[host, path] = prefix
        literal = sorted(s for s, below in by.items() if len(below) >= min_paths)
        name = "|".join(literal) if len(literal) <= 8 else f"{literal[0]}|#{len(literal)}"
        nodes = defaultdict(list)
        for s, below in by.items():
            ext = re.search(r"\.[A-Za-z0-9]{1,5}$", s)
            nodes[name if s in literal else "*" + (ext[0] if ext else "")] += below
        for step, below in nodes.items():
            walk(host, f"{prefix}/{step}", below)

    for host, all_ in paths.items():
        walk(host, "", [(p, p) for p in all_])
    return {f"http://{host}/" + "/".join(path): host + t for (host, path), t in out.items()}


def test_templates_match_a_plain_tree_at_any_depth(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    rnd = random.Random(4)
    urls = [f"http://h{rnd.choice('aaaab')}.com/" + "/".join(rnd.choice(("x", "y.html", str(rnd.randrange(40))))
                                                          for _ in range(rnd.randrange(1, 14))) for _ in range(600)]
    urls += [f"http://ha.com/{k % 12}/list/{k}" for k in range(200)] + ["http://ha.com/one/page"] * 50
    urls += ["http://deep.com/" + "/".join(map(str, range(200)))]
    got = {r.url: r.template for r in filter_urls(pages_of(spark, urls), []).collect()}
    assert got == plain_templates(set(urls), 5)


def test_a_line_of_every_document(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("a line of every document\nown line "), F.col("id"), F.lit("\na line of two "), F.floor(F.col("id") / 2)).alias("text"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in drop_repeated_lines(docs).collect()}
    for i in range(400):
        lines = [f"own line {i}"] + ([f"a line of two {i // 2}"] if i % 2 == 0 else [])
        lines = ["a line of every document"] * (i == 0) + lines
        assert got[i] == ("\n".join(lines), 3, 3 - len(lines))


def test_rows_equal_in_id_and_text_are_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 50)
    one = F.lit("the same text").alias("text")
    alike = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), one, F.lit(1).alias("extra"))
    near = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), one, F.col("id").cast("int").alias("extra"))
    rest = spark.range(100, 1100).select(F.col("id").alias("doc_id"), one, F.lit(None).cast("int").alias("extra"))
    rows = alike.unionByName(near).unionByName(rest)
    got = shard_documents(rows, 7).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {len(s) for s in slots.values()} == {714, 715}
    assert Counter((r.doc_id, r.extra) for r in got) == Counter((r.doc_id, r.extra) for r in rows.collect())
    assert {r.text for r in got} == {"the same text"}
    again = shard_documents(rows.repartition(5), 7).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_the_edge_of_a_mix_is_cut_until_it_is_small(spark, monkeypatch):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, "one two three").otherwise(
        "12 34 56 78").alias("text"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    whole = sorted(map(str, mix_table(rows).collect()))  # 70% of the keys in the last of the quantiles
    monkeypatch.setattr(mixing, "EDGE_ROWS", 20)
    monkeypatch.setattr(mixing, "CUTS", 4)
    cut = mix_table(rows).collect()
    assert sorted(map(str, cut)) == whole
    base = mixing._base(rows, "doc_id", "text", "source", None).collect()
    plan = {r.id: r for r in cut}
    for s in "ab":  # what a plain sort by key takes
        mine = sorted((r for r in base if r.source == s), key=lambda r: (r.key, r.tie))
        size, target = sum(r.size for r in mine), plan[mine[0].id].target
        epochs, words = min(2, int(target // size)), 0
        rest, want = target - epochs * size, set()
        for r in mine:
            if words + r.size - rest <= rest - words:
                want.add(r.id)
                words += r.size
            else:
                break
        assert {r.id for r in mine if plan[r.id].copies > epochs} == want and (want or rest < 4)


def test_window_sets_are_compact():
    rnd = random.Random(2)
    items = [(str(i), " ".join(f"w{rnd.randrange(5000)}" for _ in range(400)).encode()) for i in range(500)]
    windows = WindowSet(items)
    arrays = sum(h.nbytes + o.nbytes for h, o in windows.windows.values()) + windows.tokens.nbytes
    assert arrays <= 20 * len(windows.tokens) < 4_000_001
    text = b"other words " + b" ".join(items[3][1].split()[5:18]) + b" and more"
    n, mask, found = windows.scan(text)
    assert (n, int(mask.sum()), found) == (17, 13, {"3"})
