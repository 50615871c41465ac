"""URL allow / block rules by hashed host-suffix and path-prefix expressions.

Method: a URL expands into every (host suffix, path prefix) expression that a rule
could name; expressions equi-join the rule table on the first ``PREFIX_HEX``
hex digits of their SHA-256; full digests confirm the short hits, and the longest
confirmed rule decides.

Only suffixes with as many labels, and prefixes as long, as some rule has are
expanded, which loses nothing and bounds the expansion by the rule table (both
lists hold a few numbers, not rules). What a URL expands into depends only on its
last labels and the head of its path, so each distinct (host tail, path head) is
expanded once however many pages share it.

Defined results: the host starts after the first ``://`` and ends at ``/ ? #`` or
the end, A-Z lower-cased, port and user part kept; the path runs on to ``?`` or
``#``. NULL URLs and URLs without ``://`` have an empty host and path and no
rule. A rule fits its host and every subdomain when the path starts with the rule's
path; of several, the longest expression wins, then the longer host, then block.
Without a rule the verdict is the ``default``. Repeated pages give repeated rows;
empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.common import materialize

PREFIX_HEX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) tuples as a rule table."""
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def apply_rules(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (NULL if none) and verdict for every page.

    ``rules`` has the columns verdict (allow / block), host and path and may be of any size.
    """
    rules = rules.select(
        F.col("verdict").alias("rule_verdict"), F.translate(F.col("host"), _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"),
    ).where(F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull() & F.col("rule_verdict").isin("allow", "block"))
    shape = rules.agg(
        F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"),
    ).first()
    labels, lengths = list(shape["labels"]), list(shape["lengths"])

    urls = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if not labels:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = urls.withColumns({
        "host_tail": F.substring_index("host", ".", -(max(labels) + 1)),
        "path_head": F.col("path").substr(F.lit(1), F.lit(max(lengths))),
    })
    sites = keyed.where("host <> ''").select("host_tail", "path_head").distinct()
    parts = F.size(F.split("host_tail", r"\."))
    expressions = (
        sites.withColumn("n", F.explode(F.array(*[F.lit(n) for n in labels]))).where(F.col("n") <= parts)
        .withColumn("suffix", F.expr("substring_index(host_tail, '.', -n)"))
        .withColumn("length", F.explode(F.array(*[F.lit(n) for n in lengths]))).where(F.col("length") <= F.length("path_head"))
        .withColumn("digest", _digest(F.col("suffix"), F.expr("substring(path_head, 1, length)")))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
        .select("host_tail", "path_head", "suffix", "length", "digest", "short")
    )
    hashed = rules.withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX))
    confirmed = expressions.join(hashed, "short").where(
        (F.col("digest") == F.col("rule_digest")) & (F.col("suffix") == F.col("rule_host")) & (F.col("length") == F.length("rule_path")))
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("total"), F.length("rule_host").alias("host_length"),
        F.col("rule_verdict").alias("verdict"), F.concat("rule_host", "rule_path").alias("rule"))
    decided = materialize(confirmed.groupBy("host_tail", "path_head").agg(F.max(rank).alias("best")))
    return keyed.join(decided, ["host_tail", "path_head"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
