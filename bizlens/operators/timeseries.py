"""Calendar series: daily and monthly sums with gaps filled by 0.

pandas ``resample`` fills every missing bin between the first and last one.
Here the bins come from ``sequence(min, max)`` exploded into a spine (one row
per calendar day or month, bounded by the calendar span, not by the data) and
the per-bin sums are joined onto it; the join strategy is left to AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.expr import col_ref, is_date_type
from bizlens.operators.typing import choose_date_patterns, parse_timestamp


def date_value(df: DataFrame, date_col: str) -> Column:
    """The column itself if it is a date or timestamp; text is parsed with the pattern that
    parses most of its values (day first), NULL where it does not fit."""
    if is_date_type(df.schema[date_col].dataType):
        return col_ref(date_col)
    text = col_ref(date_col).cast("string")
    pattern = choose_date_patterns(df.select(text.alias("date")), min_share=0.0).get("date")
    return parse_timestamp(text, pattern) if pattern else F.lit(None).cast("timestamp")


def day_of(df: DataFrame, date_col: str) -> Column:
    return F.to_date(date_value(df, date_col))


def _spine(bins: DataFrame, key: str, step: str) -> DataFrame:
    bounds = bins.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    return bounds.where(F.col("lo").isNotNull()).select(
        F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL 1 {step}"))).alias(key)
    )


def gap_fill_daily(sums: DataFrame, key: str = "ds", value: str = "y") -> DataFrame:
    """Dense daily series from a (day, value) table with at most one row per day."""
    spine = _spine(sums, key, "DAY")
    return spine.join(sums, key, "left").select(key, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias(value))


def daily_sum(df: DataFrame, date_col: str, value: Column, key: str = "ds", out: str = "y") -> DataFrame:
    """Sum of ``value`` per calendar day, gaps 0; rows without a date are dropped.

    Rows whose value is NULL count as 0 here; callers that must drop them
    (pandas ``dropna`` before ``resample``) filter first.
    """
    day = day_of(df, date_col)
    sums = df.where(day.isNotNull()).groupBy(day.alias(key)).agg(F.sum(value).alias(out))
    return gap_fill_daily(sums, key, out)


def monthly_sum(df: DataFrame, date_col: str, value: Column, key: str = "month_end", out: str = "y") -> DataFrame:
    """Sum per calendar month labelled by the month's last day, gaps 0."""
    day = day_of(df, date_col)
    sums = df.where(day.isNotNull()).groupBy(F.trunc(day, "month").alias("_m")).agg(F.sum(value).alias(out))
    spine = _spine(sums, "_m", "MONTH")
    return spine.join(sums, "_m", "left").select(
        F.last_day("_m").alias(key), F.coalesce(F.col(out).cast("double"), F.lit(0.0)).alias(out)
    )


def series_stats(series: DataFrame, key: str = "ds", value: str = "y") -> DataFrame:
    """n days, mean of the first n//2 days and of the rest (dense series)."""
    first = series.agg(F.min(key)).scalar()
    n = series.agg(F.count(F.lit(1))).scalar()
    pos = F.datediff(F.col(key), first)
    half = F.floor(n / 2)
    return series.agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg(F.when(pos < half, F.col(value))).alias("first_half_mean"),
        F.avg(F.when(pos >= half, F.col(value))).alias("second_half_mean"),
    )
