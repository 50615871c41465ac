"""Sales mode: KPIs, top products and categories, daily and monthly revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.functions.expr import col_ref
from bizlens.operators.common import amount, group_sum, top_k
from bizlens.operators.prefix import exact_quantiles


class MissingRoles(ValueError):
    """The table lacks a column role the analysis needs."""

    def __init__(self, roles: list[str]):
        super().__init__("missing required columns: " + ", ".join(roles))
        self.roles = roles


def require(roles: dict[str, str], *needed: str) -> None:
    missing = [r for r in needed if r not in roles]
    if missing:
        raise MissingRoles(missing)


def order_count(df: DataFrame, roles: dict[str, str]):
    """Distinct order ids when the table has them, else the row count."""
    if "order_id" in roles:
        return F.count_distinct(col_ref(roles["order_id"]))
    return F.count(F.lit(1))


def sales_kpis(df: DataFrame, roles: dict[str, str], extra: dict | None = None) -> DataFrame:
    """total_revenue, orders, average_check, median_check (median of positive revenue, 0 if none).

    ``extra`` adds more aggregate columns to the same pass over the table.
    """
    require(roles, "revenue")
    rev = amount(df, roles["revenue"])
    extra = extra or {}
    base = df.agg(
        F.sum(rev).cast("double").alias("total_revenue"),
        order_count(df, roles).alias("orders"),
        *[c.alias(name) for name, c in extra.items()],
    )
    positive = df.select(rev.cast("double").alias("r")).where("r > 0")
    median = exact_quantiles(positive, "r", [0.5], names=["m"]).select("m").scalar()
    return base.select(
        "total_revenue",
        "orders",
        *extra.keys(),
        F.when(F.col("orders") > 0, F.col("total_revenue") / F.col("orders")).otherwise(F.lit(0.0)).alias("average_check"),
        F.coalesce(median, F.lit(0.0)).alias("median_check"),
    )


def revenue_by(df: DataFrame, roles: dict[str, str], role: str, alias: str = "revenue") -> DataFrame:
    require(roles, "revenue", role)
    key = roles[role]
    return group_sum(df, key, amount(df, roles["revenue"]), alias).withColumn(alias, F.col(alias).cast("double"))


def top_products(df: DataFrame, roles: dict[str, str], n: int = 10) -> DataFrame:
    return top_k(revenue_by(df, roles, "product"), "revenue", roles["product"], n)


def top_categories(df: DataFrame, roles: dict[str, str], n: int = 10) -> DataFrame:
    return top_k(revenue_by(df, roles, "category"), "revenue", roles["category"], n)


def recommendations(has_daily: bool) -> list[str]:
    # Recommendation texts of the sales mode.
    lines = ["Контролируйте вклад топ-товаров и категорий, чтобы снижать зависимость от единичных позиций."]
    if has_daily:
        lines.append("Используйте дневную динамику для планирования закупок, промо и нагрузки на операционные команды.")
    return lines
