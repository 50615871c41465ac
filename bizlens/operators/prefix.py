"""Distributed running totals and exact quantiles.

A global running sum written as ``sum(x) OVER (ORDER BY k)`` makes Spark move
every row into one partition. ``running_total`` instead

1. range-partitions the rows on (groups, order keys) and sorts each partition,
2. computes a partition-local running sum with ``mapInPandas`` (carrying the
   sum across Arrow batches of the same partition),
3. checkpoints that result to the shared checkpoint folder, so partition ids
   and local sums stay fixed if a task or executor is lost and recomputed,
4. sums each (partition, group) slice -- at most partitions + groups rows --
   and turns those slice totals into offsets with a small window, and
5. adds the offset of its slice to every row.

``exact_quantiles`` builds on it: values are first reduced to
(group, value, count), the running count then gives every distinct value its
rank interval, and the two values around rank ``p * (n - 1)`` are picked with
conditional aggregates. No step gathers a whole group or the whole column in
one task, and no join fans out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.session import ensure_checkpoint_dir

PID = "_slice_pid"
LOCAL = "_slice_local"


def _group_ids(keys: pd.DataFrame) -> np.ndarray:
    """Consecutive-run ids of the (sorted) key columns, NULLs comparing equal."""
    change = np.zeros(len(keys), dtype=bool)
    change[0] = True
    for c in keys.columns:
        col = keys[c]
        isna = col.isna().to_numpy()
        vals = col.to_numpy()
        prev_na = np.roll(isna, 1)
        same = np.zeros(len(keys), dtype=bool)
        same[1:] = (vals[1:] == vals[:-1]) & ~isna[1:] & ~prev_na[1:]
        same[1:] |= isna[1:] & prev_na[1:]
        change |= ~same
    return np.cumsum(change)


def _local_cumsum(group_cols: list[str], value: str):
    def run(batches):
        pid = TaskContext.get().partitionId()
        carry_key = None
        carry = 0
        for pdf in batches:
            if pdf.empty:
                continue
            vals = pdf[value].fillna(0)
            if group_cols:
                gid = _group_ids(pdf[group_cols])
                local = vals.groupby(gid, sort=False).cumsum().to_numpy()
                first_key = tuple(None if pd.isna(v) else v for v in pdf[group_cols].iloc[0])
                if carry_key is not None and first_key == carry_key:
                    local = local + np.where(gid == gid[0], carry, 0)
                carry_key = tuple(None if pd.isna(v) else v for v in pdf[group_cols].iloc[-1])
            else:
                local = vals.cumsum().to_numpy() + carry
            pdf[LOCAL] = local
            pdf[PID] = pid
            carry = pdf[LOCAL].iloc[-1]
            yield pdf

    return run


def running_total(
    df: DataFrame,
    order_by: Sequence[str | Column],
    value: str,
    out: str = "running_total",
    partition_by: Sequence[str] = (),
    num_partitions: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order_by`` order, per ``partition_by`` group.

    ``value`` must be an integral or floating column; decimal money should be
    passed as integral cents for exact sums. Without ``num_partitions`` the ranges
    start from the session's shuffle partitions and AQE joins them by their size.
    """
    group_cols = list(partition_by)
    ranges = [num_partitions] if num_partitions else []
    value_type = df.schema[value].dataType
    integral = isinstance(value_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    local_type = T.LongType() if integral else T.DoubleType()
    base = df.withColumn(value, F.col(value).cast(local_type))

    ordered = base.repartitionByRange(*ranges, *group_cols, *order_by).sortWithinPartitions(*group_cols, *order_by)
    schema = T.StructType(base.schema.fields + [T.StructField(LOCAL, local_type), T.StructField(PID, T.IntegerType())])
    ensure_checkpoint_dir(df.sparkSession)
    local = ordered.mapInPandas(_local_cumsum(group_cols, value), schema).checkpoint(eager=True)

    keys = [PID, *group_cols]
    slice_totals = local.groupBy(*keys).agg(F.sum(F.coalesce(value, F.lit(0))).alias("_slice_total"))
    before = Window.partitionBy(*group_cols).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = slice_totals.select(*keys, F.coalesce(F.sum("_slice_total").over(before), F.lit(0)).alias("_slice_offset"))
    if not group_cols:
        # one row per range partition: bounded by the partition count
        offsets = F.broadcast(offsets)
    # NULL groups are groups like any other
    left, right = local.alias("l"), offsets.alias("o")
    same = F.col(f"l.{PID}") == F.col(f"o.{PID}")
    for g in group_cols:
        same = same & F.col(f"l.`{g}`").eqNullSafe(F.col(f"o.`{g}`"))
    joined = left.join(right, same, "left").select("l.*", "o._slice_offset")
    return joined.withColumn(out, F.col(LOCAL) + F.coalesce(F.col("_slice_offset"), F.lit(0))).drop(LOCAL, PID, "_slice_offset")


def exact_quantiles(
    df: DataFrame,
    value: str | Column,
    probs: Sequence[float],
    group_by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles (pandas / numpy / ``quantile_cont``).

    Returns one row per group with one double column per probability
    (``q0``, ``q1``, ... unless ``names`` is given). NULL values are ignored; a
    group with no values is absent, and without groups the single row holds
    NULLs.
    """
    group_cols = list(group_by)
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    vcol = F.col(value) if isinstance(value, str) else value
    counts = (
        df.select(*[F.col(g) for g in group_cols], vcol.cast("double").alias("_qv"))
        .where(F.col("_qv").isNotNull() & ~F.isnan("_qv"))
        .groupBy(*group_cols, "_qv")
        .agg(F.count(F.lit(1)).alias("_qn"))
    )
    ranked = running_total(counts, ["_qv"], "_qn", out="_qend", partition_by=group_cols, num_partitions=num_partitions)
    ranked = ranked.withColumn("_qstart", F.col("_qend") - F.col("_qn"))

    if group_cols:
        totals = ranked.groupBy(*group_cols).agg(F.max("_qend").alias("_qtotal"))
        same = F.lit(True)
        for g in group_cols:
            same = same & F.col(f"r.`{g}`").eqNullSafe(F.col(f"t.`{g}`"))
        ranked = ranked.alias("r").join(totals.alias("t"), same).select("r.*", "t._qtotal")
        total = F.col("_qtotal")
    else:
        total = ranked.select(F.max("_qend")).scalar()

    aggs = []
    for p, name in zip(probs, names):
        pos = F.lit(float(p)) * (total - F.lit(1)).cast("double")
        lo = F.floor(pos)
        hi = F.ceil(pos)
        at_lo = F.max(F.when((F.col("_qstart") <= lo) & (lo < F.col("_qend")), F.col("_qv")))
        at_hi = F.max(F.when((F.col("_qstart") <= hi) & (hi < F.col("_qend")), F.col("_qv")))
        frac_expr = F.max(pos - lo)
        aggs.append((at_lo + (at_hi - at_lo) * frac_expr).alias(name))
    if group_cols:
        return ranked.groupBy(*group_cols).agg(*aggs)
    return ranked.agg(*aggs)
