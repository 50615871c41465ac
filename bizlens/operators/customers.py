"""Customer mode: customer KPIs, top customers, high-LTV customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.functions.expr import col_ref
from bizlens.operators.common import amount, materialize
from bizlens.operators.prefix import exact_quantiles
from bizlens.operators.sales import require


def per_customer(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(customer, revenue, orders): one row per non-NULL customer; orders are
    distinct order ids when the table has them, else rows."""
    require(roles, "customer", "revenue")
    key = roles["customer"]
    rev = amount(df, roles["revenue"])
    orders = F.count_distinct(col_ref(roles["order_id"])) if "order_id" in roles else F.count(F.lit(1))
    return (
        df.where(col_ref(key).isNotNull())
        .groupBy(col_ref(key).alias(key))
        .agg(F.sum(rev).cast("double").alias("revenue"), orders.alias("orders"))
    )


def customer_kpis(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """customers, average_check, repeat_customers.

    The average check divides the revenue of all rows (customer missing or
    not) by the summed per-customer order counts, as the reference does.
    """
    per = per_customer(df, roles)
    total = df.agg(F.sum(amount(df, roles["revenue"])).cast("double")).scalar()
    return per.agg(
        F.count(F.lit(1)).alias("customers"),
        (F.coalesce(total, F.lit(0.0)) / F.greatest(F.coalesce(F.sum("orders"), F.lit(0)), F.lit(1))).alias("average_check"),
        F.count(F.when(F.col("orders") > 1, 1)).alias("repeat_customers"),
    )


def top_customers(df: DataFrame, roles: dict[str, str], n: int = 10) -> DataFrame:
    key = roles["customer"]
    return per_customer(df, roles).select(key, "revenue").orderBy(F.col("revenue").desc(), col_ref(key).asc()).limit(n)


def high_ltv(df: DataFrame, roles: dict[str, str], q: float = 0.9, n: int = 30) -> DataFrame:
    """Customers at or above the exact ``q`` quantile of customer revenue, first ``n`` by revenue."""
    key = roles["customer"]
    per = materialize(per_customer(df, roles).select(key, "revenue"))
    threshold = exact_quantiles(per, "revenue", [q], names=["t"]).select("t").scalar()
    return (
        per.where(F.col("revenue") >= F.coalesce(threshold, F.lit(0.0)))
        .orderBy(F.col("revenue").desc(), col_ref(key).asc())
        .limit(n)
        .withColumnRenamed("revenue", "ltv")
    )
