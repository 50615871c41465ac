"""Marketplace mode: returns, commissions, profit, low sellers, Pareto core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.functions.expr import col_ref
from bizlens.operators.common import amount
from bizlens.operators.prefix import running_total
from bizlens.operators.sales import require, revenue_by, sales_kpis


def returns_amount(df: DataFrame, roles: dict[str, str]) -> Column:
    """Returned money per row: with a boolean flag the row's revenue, else abs(number)."""
    name = roles.get("returns")
    if name is None:
        return F.lit(0)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        rev = amount(df, roles.get("revenue"))
        return F.when(col_ref(name), rev).otherwise(F.lit(0))
    return F.abs(amount(df, name))


def marketplace_kpis(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Sales KPIs plus returns, commissions and profit = revenue - commission - returns,
    all sums in the same pass over the table. Without a revenue column only returns and
    commissions are summed and the profit is 0."""
    rev = amount(df, roles.get("revenue"))
    commission = amount(df, roles.get("commission"))
    returns = returns_amount(df, roles)
    if "revenue" not in roles:
        return df.agg(
            F.coalesce(F.sum(returns).cast("double"), F.lit(0.0)).alias("returns_total"),
            F.coalesce(F.sum(commission).cast("double"), F.lit(0.0)).alias("commissions"),
        ).withColumn("profit", F.lit(0.0))
    kpis = sales_kpis(df, roles, extra={
        "returns_total": F.sum(returns).cast("double"),
        "commissions": F.sum(commission).cast("double"),
        "profit": F.sum(rev - commission - returns).cast("double"),
    })
    return kpis.select("total_revenue", "orders", "average_check", "median_check", "returns_total", "commissions", "profit")


def low_sellers(df: DataFrame, roles: dict[str, str], n: int = 10) -> DataFrame:
    """The last ``n`` products of the revenue-descending list."""
    key = roles["product"]
    by_product = revenue_by(df, roles, "product")
    return by_product.orderBy(F.col("revenue").asc(), col_ref(key).desc()).limit(n)


def pareto_core(df: DataFrame, roles: dict[str, str], share: float = 0.8) -> DataFrame:
    """Products whose cumulative revenue share (revenue descending) stays within ``share``.

    Revenue is summed exactly in the column's own type first: decimals then run as
    integral units of their scale through the distributed ``running_total``, other
    types as doubles. No row is rounded and no step needs a single partition.
    """
    require(roles, "revenue", "product")
    key = roles["product"]
    dtype = df.schema[roles["revenue"]].dataType
    scale = dtype.scale if isinstance(dtype, T.DecimalType) else None
    revenue = F.sum(amount(df, roles["revenue"]))
    units = (revenue * F.lit(10**scale)).cast("decimal(38,0)").cast("long") if scale is not None else revenue.cast("double")
    divisor = float(10**scale) if scale is not None else 1.0
    per_product = df.where(col_ref(key).isNotNull()).groupBy(col_ref(key).alias(key)).agg(units.alias("units"))
    ranked = running_total(per_product, [F.col("units").desc(), F.col(key).asc()], "units", out="cum_units")
    total = per_product.select(F.sum("units")).scalar()
    limit = F.greatest(total.cast("double") / divisor, F.lit(1.0))
    return ranked.where((F.col("cum_units").cast("double") / divisor) / limit <= F.lit(share)).select(
        F.col(key), (F.col("units").cast("double") / divisor).alias("revenue")
    )


def recommendations() -> list[str]:
    # Recommendation texts added by the marketplace mode.
    return [
        "Проверьте товары с низкими продажами: для них нужны промо, изменение цены или вывод из ассортимента.",
        "Следите за комиссией и возвратами: они напрямую уменьшают прибыль даже при росте выручки.",
    ]
