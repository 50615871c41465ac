"""Rendezvous hashing of record keys over weighted shards.

Method: every (key, shard) pair gets a uniform hash u in (0, 1) and the score
``-ln(u) / weight``; the record goes to the shard with the smallest score. The
score of a pair does not depend on the other shards, so adding a shard moves
records only into the new one and a shard's share is proportional to its
weight. One map over the rows, no shuffle.

Slots number the rows of a shard without gaps. A window over a whole shard would
put 1/n of the corpus into one task, so rows are cut into buckets along the order
hash, counted per (shard, bucket), and numbered inside the buckets; a bucket's
offset is the running sum of those counts.

Defined results: a NULL key is a key of its own (all such rows share a shard);
equal keys always share a shard; equal rows get neighbouring slots; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.llm.common import materialize, row_key, unused

#: Rows that one numbering bucket holds on average.
BUCKET_ROWS = 20_000
_BITS = 52


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Shard (0-based int) of ``key`` among ``len(weights)`` weighted shards."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a positive weight")

    def score(shard: Column, weight: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key.isNull(), key, shard), 64 - _BITS)
        return F.struct((-F.log((bits + F.lit(0.5)) / F.lit(float(2**_BITS))) / weight).alias("score"), shard.alias("shard"))

    shards = F.array(*[F.lit(i) for i in range(len(weights))])
    by_weight = F.array(*[F.lit(float(w)) for w in weights])
    scored = F.transform(shards, lambda s: score(s, F.element_at(by_weight, s + 1)))
    return F.array_min(scored)["shard"]


def number_rows(df: DataFrame, group: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """Gapless 0-based numbers per ``group`` in an order that is hashed from ``order``."""
    h, bucket, offset, n = (unused(df, x) for x in ("order_hash", "order_bucket", "bucket_offset", "bucket_rows"))
    buckets = max(1, df.count() // BUCKET_ROWS)
    hashed = df.withColumn(h, F.shiftrightunsigned(F.xxhash64(*order), 11))
    rows = hashed.withColumn(bucket, F.floor(F.col(h) / F.lit(float(2**53)) * buckets).cast("int"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(group, bucket).agg(F.count(F.lit(1)).alias(n)).select(
        group, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset))
    inside = Window.partitionBy(group, bucket).orderBy(h, *order)
    return (
        rows.withColumn(slot, F.row_number().over(inside)).join(offsets, [group, bucket])
        .withColumn(slot, (F.col(slot) - 1 + F.col(offset)).cast("long")).drop(h, bucket, offset)
    )


def shard_documents(docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 16), text_crc32 (0 for NULL), law, shard, slot and
    grown_shard (with one more shard of the mean weight)."""
    weights = list(weights) if weights else [1.0] * shards
    if len(weights) != shards:
        raise ValueError("one weight per shard is needed")
    key = F.col(id_col)
    rows = docs.select(
        key.alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col)), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(key, weights).alias("shard"),
        rendezvous_shard(key, [*weights, sum(weights) / len(weights)]).alias("grown_shard"),
    )
    numbered = number_rows(materialize(rows), "shard", ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 40, weights: Sequence[float] | None = None,
                 id_col: str = "doc_id", files_per_shard: int = 8) -> None:
    """Write ``docs`` with all its columns as one folder per shard below ``path``; a shard
    is written by up to ``files_per_shard`` tasks."""
    shard, part = unused(docs, "shard"), unused(docs, "shard_part")
    weights = list(weights) if weights else [1.0] * shards
    placed = docs.withColumn(shard, rendezvous_shard(F.col(id_col), weights))
    placed = placed.withColumn(part, F.pmod(F.conv(F.substring(row_key(F.col(id_col)), 1, 8), 16, 10).cast("long"), F.lit(files_per_shard)))
    placed.repartition(shards * files_per_shard, shard, part).drop(part).write.partitionBy(shard).mode("errorifexists").parquet(path)
