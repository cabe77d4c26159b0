"""Registered queries of the training-data operators and their DuckDB SQL.

Every query applies its operator with production parameters to the whole
table it is meant for. SQL is given where SQL can express the result; the
other queries are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, held_out, read, text_bytes
from .decontaminate import decontaminate
from .exact_search import integer_vectors, top_k
from .hard_negatives import labelled_vectors, mine_hard_negatives
from .language_id import identify_language
from .line_dedup import drop_repeated_lines
from .lm_score import score_texts
from .merkle import build_manifest, record_digest, verify_manifest
from .mixing import mix_table
from .multi_index import nearest
from .near_dedup import near_duplicates
from .quality import fit_voting, score_quality
from .sharding import shard_documents
from .url_filter import Rule, filter_urls

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from two thirds of the labels."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 3, 1).alias("held_out"))
    model = fit_voting(docs.where("NOT held_out"), read(spark, sf_dir, "labels"))
    return (score_quality(docs, model)
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, learned from six sevenths."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (~held_out("doc_id", 7, 2)).alias("learn"))
    return (score_texts(docs, learn_col="learn")
            .select(F.col("id").alias("doc_id"), (~F.col("learned")).alias("held_out"), "n_tokens", "n_known",
                    "train_tokens", "base_score", "score"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all sources takes of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_table(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every hundredth vector among all others."""
    vectors = integer_vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    return top_k(vectors, vectors.where(F.col("id") % 100 == 0), 10)


SQL_OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * v.x[i])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(q.x) = len(v.x)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", 3, 1).alias("held_out"))
    return (identify_language(docs.drop("lang"), docs.where("NOT held_out"))
            .select("doc_id", "held_out", "lang_pred", "score"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, threshold=85).select(F.col("doc").alias("doc_id"), "n_shingles",
                                                      F.col("component").alias("component_id"), "kept")


SQL_OP6 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM words, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS origin, doc_id AS node FROM documents
  UNION
  SELECT r.origin, e.b FROM reach r JOIN both_ways e ON e.a = r.node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT origin, min(node) AS component_id FROM reach GROUP BY origin) m ON m.origin = d.doc_id
"""


PAGE_RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"),
              Rule("org", "/fr/", "allow")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page url."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, PAGE_RULES).drop("url")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, read(spark, sf_dir, "benchmark"), remove="nothing")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL_OP8 = f"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bench_windows AS (
  SELECT DISTINCT item_id, ws[i:i + least(len(ws), 13) - 1] AS win
  FROM item, LATERAL (SELECT unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT len(win) AS size FROM bench_windows),
doc_windows AS (
  SELECT doc_id, size, i, ws[i:i + size - 1] AS win
  FROM doc, sizes, LATERAL (SELECT unnest(range(1, len(ws) - size + 2)) AS i) WHERE len(ws) >= size),
hits AS (
  SELECT d.doc_id, d.size, d.i, b.item_id FROM doc_windows d JOIN bench_windows b ON d.win = b.win),
positions AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM hits, LATERAL (SELECT unnest(range(i, i + size)) AS p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.ws) AS contaminated
FROM doc d LEFT JOIN positions p ON p.doc_id = d.doc_id LEFT JOIN items t ON t.doc_id = d.doc_id
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of equal row counts."""
    body = text_bytes("text")
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), "text")
    out = shard_documents(docs, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in several documents, dropped from all but the first."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


SQL_OP10 = f"""
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
       LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS pos)),
keyed AS (
  SELECT doc_id, pos, line,
         {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
found AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.first_doc AS gone
  FROM keyed k LEFT JOIN found f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = labelled_vectors(read(spark, sf_dir, "embeddings"), id_col="vec_id", vector_col="embedding",
                               label=label, scale=256)
    return mine_hard_negatives(vectors, F.col("id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


SQL_OP11 = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row AS a, a.vec_id AS anchor_id, o.row, o.vec_id, a.label = o.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * o.x[i])) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id % 50 = 0 AND a.row <> o.row AND len(a.x) = len(o.x)),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS p FROM scored WHERE same)
  WHERE p <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.a, p.p ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same
   AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows, by cosine, of every fiftieth vector."""
    return nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, id_col="vec_id", vector_col="embedding", k=5)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, proof and folded root of every document; a fifth of the
    documents is tampered with."""
    docs = read(spark, sf_dir, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(crc_bucket("doc_id", 5) == 0, record_digest(*fields, F.translate("text", upper, lower)))
    manifest = build_manifest(docs, group_col="source", order_col="doc_id", leaf=record_digest(*fields, F.col("text")),
                              changed=tampered, keep=["doc_id"])
    return verify_manifest(manifest)


def _sql_record(text: str) -> str:
    one = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(one.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# crc32 of a decimal number, bit by bit
_SQL_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
      list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [CAST(0 AS BIGINT) for i in range(8)]),
      lambda d, z: xor(d >> 1, CAST(3988292384 AS BIGINT) * (d & 1)))), CAST(4294967295 AS BIGINT))"""

SQL_OP13 = f"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS k, doc_id, source, {_sql_record("text")} AS leaf,
         CASE WHEN {_SQL_CRC} % 5 = 0 THEN {_sql_record(LOWER.format("text"))} END AS changed FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n FROM doc),
nodes(lvl, source, n, pos, digest) AS (
  SELECT CAST(0 AS BIGINT), source, n, pos, leaf FROM placed
  UNION ALL
  SELECT lvl + 1, source, (n + 15) // 16, pos // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY lvl, source, n, pos // 16),
tops AS (
  SELECT source, lvl AS height, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
top_nodes(lvl, n, pos, digest) AS (
  SELECT CAST(0 AS BIGINT), n, pos, digest FROM tops
  UNION ALL
  SELECT lvl + 1, (n + 15) // 16, pos // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM top_nodes WHERE n > 1 GROUP BY lvl, n, pos // 16),
beside AS (
  SELECT d.k, x.lvl AS step, x.pos - (d.pos >> (4 * x.lvl)) AS side, x.digest
  FROM placed d JOIN nodes x ON x.source IS NOT DISTINCT FROM d.source AND x.n > 1
   AND x.pos // 16 = (d.pos >> (4 * x.lvl)) // 16
  UNION ALL
  SELECT d.k, t.height + x.lvl, x.pos - (t.pos >> (4 * x.lvl)), x.digest
  FROM placed d JOIN tops t ON t.source IS NOT DISTINCT FROM d.source
  JOIN top_nodes x ON x.n > 1 AND x.pos // 16 = (t.pos >> (4 * x.lvl)) // 16),
steps AS (
  SELECT k, step, coalesce(string_agg(digest, '' ORDER BY side) FILTER (WHERE side < 0), '') AS before,
         coalesce(string_agg(digest, '' ORDER BY side) FILTER (WHERE side > 0), '') AS after
  FROM beside GROUP BY k, step),
folds(k, step, digest) AS (
  SELECT k, CAST(0 AS BIGINT), coalesce(changed, leaf) FROM placed
  UNION ALL
  SELECT f.k, f.step + 1, sha256(s.before || f.digest || s.after) FROM folds f JOIN steps s ON s.k = f.k AND s.step = f.step),
folded AS (SELECT k, max_by(digest, step) AS folded_root FROM folds GROUP BY k),
proofs AS (SELECT k, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY k),
root AS (SELECT digest AS root FROM top_nodes WHERE n = 1)
SELECT d.doc_id, d.leaf, t.digest AS subroot, r.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
       f.folded_root, f.folded_root = r.root AS verified
FROM placed d JOIN tops t ON t.source IS NOT DISTINCT FROM d.source JOIN folded f ON f.k = d.k
LEFT JOIN proofs p ON p.k = d.k CROSS JOIN root r
"""

QUERIES = {
    "op1_quality": op1_quality,
    "op2_lm_score": op2_lm_score,
    "op3_mixing": op3_mixing,
    "op4_exact_search": op4_exact_search,
    "op5_language_id": op5_language_id,
    "op6_near_dedup": op6_near_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_decontaminate": op8_decontaminate,
    "op9_sharding": op9_sharding,
    "op10_line_dedup": op10_line_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_multi_index": op12_multi_index,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE = {
    "op4_exact_search": SQL_OP4,
    "op6_near_dedup": SQL_OP6,
    "op8_decontaminate": SQL_OP8,
    "op10_line_dedup": SQL_OP10,
    "op11_hard_negatives": SQL_OP11,
    "op13_merkle_manifest": SQL_OP13,
}
