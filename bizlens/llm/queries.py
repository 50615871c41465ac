"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.llm import centroids, embedding_tiles, exact_stream, langid, line_alignment, mixing, ngram_trie, order_minhash, pieces, secret_scan, sharding, token_alignment, url_rules
from bizlens.llm.common import batch_rows, read_table
from bizlens.llm.registry import ORACLE, QUERIES, register

__all__ = ["ORACLE", "QUERIES"]

SHARDS = 40
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MIX_WEIGHTS, MIX_MAX_REPEATS = (5, 2, 1), 3.0


@register("op1_secret_novelty")
def op1(spark, sf_dir):
    batch_rows(spark)
    return secret_scan.span_digests(secret_scan.scan_documents(read_table(spark, sf_dir, "documents")))


@register("op2_line_alignment")
def op2(spark, sf_dir):
    batch_rows(spark)
    docs = read_table(spark, sf_dir, "documents")
    cut = line_alignment.delete_repeated_blocks(docs.select("doc_id", "text"), count="deleted_lines")
    return cut.select("doc_id", "deleted_lines", "text")


@register("op3_order_minhash")
def op3(spark, sf_dir):
    batch_rows(spark)
    return order_minhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


@register("op4_word_first_language")
def op4(spark, sf_dir):
    batch_rows(spark)
    return langid.identify(read_table(spark, sf_dir, "documents"))


@register("op5_exact_stream", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op5(spark, sf_dir):
    batch_rows(spark)
    out = exact_stream.streaming_dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op6_piece_chunks")
def op6(spark, sf_dir):
    batch_rows(spark)
    return pieces.encode_digests(read_table(spark, sf_dir, "documents"))


@register("op7_rendezvous_shards")
def op7(spark, sf_dir):
    batch_rows(spark)
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), SHARDS)


@register("op8_embedding_tiles", """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
       least(e.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS kept
FROM embeddings e""")
def op8(spark, sf_dir):
    batch_rows(spark)
    return embedding_tiles.near_vectors(read_table(spark, sf_dir, "embeddings"))


@register("op9_url_rules", r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
urls AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fits AS (
  SELECT r, arg_max(rules.host || rules.path, length(rules.host) + length(rules.path)) AS rule,
         arg_max(verdict, length(rules.host) + length(rules.path)) AS verdict
  FROM urls JOIN rules ON (urls.host = rules.host OR ends_with(urls.host, '.' || rules.host)) AND starts_with(urls.path, rules.path)
  GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fits USING (r)""")
def op9(spark, sf_dir):
    batch_rows(spark)
    return url_rules.apply_rules(read_table(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))


_MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 AS one FROM docs GROUP BY source),
weighted AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS weight FROM sizes),
levels AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS ratio,
         (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM weighted WINDOW b AS (ORDER BY 3.0::DOUBLE * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT arg_min(level, (ratio, -level)) AS level FROM levels WHERE level <= ratio),
targets AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, common.level * weight) AS target,
         CASE WHEN source_size > 0 THEN CAST(floor(least(3.0::DOUBLE * source_size, common.level * weight) / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM levels, common),
ends AS (
  SELECT d.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY hash) AS upto,
         sum(size) OVER (PARTITION BY d.source, hash) AS here
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE least(3, whole + CASE WHEN upto <= rest OR 2 * upto - here <= 2 * rest THEN 1 ELSE 0 END) END * size AS taken
FROM ends"""


@register("op10_mix_sources", _MIX_SQL)
def op10(spark, sf_dir):
    batch_rows(spark)
    plan = mixing.mix_plan(read_table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_MAX_REPEATS)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def _cluster_sql(clusters: int, rounds: int) -> str:
    """Plain Lloyd rounds, one pair of CTEs each."""
    steps = [f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS cluster, v FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id), v) <= {clusters})"""]
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS (
  SELECT k.r, c.cluster, CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM kept k, c{i} c),
a{i} AS (SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM d{i} GROUP BY r),
s{i} AS (
  SELECT cluster, i, sum(x) AS s, count(*) AS n
  FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i} JOIN kept USING (r)) GROUP BY cluster, i),
m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{i} GROUP BY cluster),
c{i + 1} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (cluster))""")
    return ",".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} c USING (cluster)"""


@register("op11_centroid_clusters", _cluster_sql(centroids.CLUSTERS, centroids.ROUNDS))
def op11(spark, sf_dir):
    batch_rows(spark)
    return centroids.cluster_report(spark, read_table(spark, sf_dir, "embeddings"))


@register("op12_ngram_trie")
def op12(spark, sf_dir):
    batch_rows(spark)
    return ngram_trie.score_documents(read_table(spark, sf_dir, "documents"))


@register("op13_merge_path_alignment")
def op13(spark, sf_dir):
    batch_rows(spark)
    return token_alignment.align_documents(read_table(spark, sf_dir, "documents"))
