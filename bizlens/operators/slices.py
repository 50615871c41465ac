"""Dashboard slices: category and date filters and what is shown on a slice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.functions.expr import col_ref
from bizlens.operators.common import amount, group_sum, materialize, top_k
from bizlens.operators.sales import order_count
from bizlens.operators.timeseries import date_value


def category_options(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Distinct category values as text, sorted."""
    c = col_ref(roles["category"]).cast("string")
    return df.where(c.isNotNull()).select(c.alias("category")).distinct().orderBy("category")


def filter_categories(df: DataFrame, roles: dict[str, str], selected: Sequence[str]) -> DataFrame:
    """Rows whose category text is selected; an empty selection keeps everything."""
    if not selected or "category" not in roles:
        return df
    return df.where(col_ref(roles["category"]).cast("string").isin(list(selected)))


def date_bounds(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    d = F.to_date(date_value(df, roles["date"]))
    return df.agg(F.min(d).alias("min_date"), F.max(d).alias("max_date"))


def filter_dates(df: DataFrame, roles: dict[str, str], start: str, end: str) -> DataFrame:
    """Rows whose day lies in [start, end]; rows without a date are dropped."""
    if "date" not in roles:
        return df
    d = F.to_date(date_value(df, roles["date"]))
    return df.where(d.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def slice_kpis(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """rows, revenue, orders, average_check (NULL without revenue or orders)."""
    rev = F.sum(amount(df, roles["revenue"])).cast("double") if "revenue" in roles else F.lit(None).cast("double")
    k = df.agg(F.count(F.lit(1)).alias("rows"), rev.alias("revenue"), order_count(df, roles).alias("orders"))
    return k.select("rows", "revenue", "orders", F.when(F.col("orders") > 0, F.col("revenue") / F.col("orders")).alias("average_check"))


def timeline(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Revenue per exact timestamp, no gap filling."""
    ds = date_value(df, roles["date"])
    return (
        df.where(ds.isNotNull())
        .groupBy(ds.alias("ds"))
        .agg(F.sum(amount(df, roles["revenue"])).cast("double").alias("revenue"))
    )


def top_products(df: DataFrame, roles: dict[str, str], n: int = 20) -> DataFrame:
    key = roles["product"]
    per = group_sum(df, key, amount(df, roles["revenue"]), "revenue").withColumn("revenue", F.col("revenue").cast("double"))
    return top_k(per, "revenue", key, n)


def category_share(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(category, revenue, share): revenue per category and its share of the slice total."""
    key = roles["category"]
    per = materialize(group_sum(df, key, amount(df, roles["revenue"]), "revenue"))
    total = per.agg(F.sum("revenue")).scalar()
    return per.select(
        key,
        F.col("revenue").cast("double").alias("revenue"),
        (F.col("revenue").cast("double") / total.cast("double")).alias("share"),
    )


def preview(df: DataFrame, order_by: Sequence[str], n: int = 12, width: int = 80) -> DataFrame:
    """First ``n`` rows by ``order_by`` with every cell as text cut to ``width`` characters plus ``...``."""
    head = df.orderBy(*[col_ref(c) for c in order_by]).limit(n)
    cells = []
    for c in df.columns:
        text = F.coalesce(col_ref(c).cast("string"), F.lit("None"))
        cells.append(F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text).alias(c))
    return head.select(*cells)
