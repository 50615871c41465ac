"""Inventory mode: stock per product, low stock, best and worst sellers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.functions.expr import col_ref
from bizlens.operators.common import amount, group_sum, materialize
from bizlens.operators.prefix import exact_quantiles
from bizlens.operators.sales import require


def stock_by_product(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(product, stock): summed stock per product, missing counted as 0."""
    require(roles, "product", "stock")
    out = group_sum(df, roles["product"], amount(df, roles["stock"]), "stock")
    return out.withColumn("stock", F.col("stock").cast("double"))


def stock_top(df: DataFrame, roles: dict[str, str], n: int = 30) -> DataFrame:
    key = roles["product"]
    return stock_by_product(df, roles).orderBy(F.col("stock").desc(), col_ref(key).asc()).limit(n)


def stock_total(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    require(roles, "stock")
    return df.agg(F.sum(amount(df, roles["stock"])).cast("double").alias("stock_total"))


def low_stock(df: DataFrame, roles: dict[str, str], n: int = 20) -> DataFrame:
    """Products with stock <= max(0.25 * median product stock, 1), lowest first, first ``n``."""
    key = roles["product"]
    per_product = materialize(stock_by_product(df, roles))
    median = exact_quantiles(per_product, "stock", [0.5], names=["m"]).select("m").scalar()
    threshold = F.greatest(median * F.lit(0.25), F.lit(1.0))
    return per_product.where(F.col("stock") <= threshold).orderBy(F.col("stock").asc(), col_ref(key).asc()).limit(n)


def low_stock_kpis(df: DataFrame, roles: dict[str, str], n: int = 20) -> DataFrame:
    """Stock total, the low-stock count as listed (after the cut to ``n``) and the full count."""
    per_product = materialize(stock_by_product(df, roles))
    median = exact_quantiles(per_product, "stock", [0.5], names=["m"]).select("m").scalar()
    is_low = F.col("stock") <= F.greatest(median * F.lit(0.25), F.lit(1.0))
    return per_product.agg(
        F.coalesce(F.sum("stock"), F.lit(0.0)).alias("stock_total"),
        F.least(F.count(F.when(is_low, 1)), F.lit(n)).alias("low_stock_count"),
        F.count(F.when(is_low, 1)).alias("low_stock_total"),
    )


def sold_by_product(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    require(roles, "product", "quantity")
    out = group_sum(df, roles["product"], amount(df, roles["quantity"]), "sold")
    return out.withColumn("sold", F.col("sold").cast("double"))


def best_sellers(df: DataFrame, roles: dict[str, str], n: int = 10) -> DataFrame:
    key = roles["product"]
    return sold_by_product(df, roles).orderBy(F.col("sold").desc(), col_ref(key).asc()).limit(n)


def worst_sellers(df: DataFrame, roles: dict[str, str], n: int = 10) -> DataFrame:
    key = roles["product"]
    return sold_by_product(df, roles).orderBy(F.col("sold").asc(), col_ref(key).desc()).limit(n)
