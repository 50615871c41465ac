"""Small building blocks shared by the business operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.functions.expr import col_ref, to_number


def amount(df: DataFrame, name: str | None, fill_zero: bool = True) -> Column:
    """Money/number column: decimals stay decimal (exact sums), other types are
    coerced with ``to_number``; missing becomes 0 unless ``fill_zero`` is off."""
    if name is None:
        return F.lit(0)
    dtype = df.schema[name].dataType
    c = col_ref(name) if isinstance(dtype, T.DecimalType) else to_number(df, name)
    return F.coalesce(c, F.lit(0)) if fill_zero else c


def as_double(c: Column) -> Column:
    return c.cast("double")


def group_sum(df: DataFrame, key: str, value: Column, alias: str) -> DataFrame:
    """Sum of ``value`` per non-NULL ``key`` (pandas drops NULL keys)."""
    return df.where(col_ref(key).isNotNull()).groupBy(col_ref(key).alias(key)).agg(F.sum(value).alias(alias))


def top_k(df: DataFrame, value: str, key: str, n: int, descending: bool = True) -> DataFrame:
    """First ``n`` rows by ``value`` with the key as ascending tie-break."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    return df.orderBy(order, col_ref(key).asc()).limit(n)


def first_by_hash(df: DataFrame, hashed: Column, ties: list[Column], k: int, n: int) -> DataFrame:
    """The ``k`` rows of ``df`` (``n`` rows) that come first by the 64-bit hash ``hashed``, then ``ties``.

    A plain top-k keeps k rows of every task for the one that merges them. Here only rows
    below the hash value under which somewhat more than k are expected go on; where rows
    with few distinct hashes leave fewer than k there, all go on. The result is the same.
    """
    share = (k + 10 * math.sqrt(k) + 100) / max(n, 1)
    rows = df
    if share < 1:
        near = materialize(df.where(hashed < F.lit(int(share * 2**64) - 2**63)))
        if near.count() >= k:
            rows = near
    return rows.orderBy(hashed, *ties).limit(k)


def widen(df: DataFrame) -> DataFrame:
    """Deal rows round-robin over the cores where the input has fewer files than cores, so
    that heavy Python work on one small file is not one task. Decided from the file list
    alone: nothing runs, and tables of many files get no extra shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def materialize(df: DataFrame) -> DataFrame:
    """Compute a (typically aggregated) intermediate once and cut its lineage.

    For small tables referenced several times in one plan with different
    projections, where exchange reuse does not apply. Written with a reliable
    checkpoint to the shared ``spark.checkpoint.dir``, so it also survives the
    loss of the executors that computed it.
    """
    from bizlens.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
