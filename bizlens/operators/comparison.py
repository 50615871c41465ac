"""Two-report comparison: KPI changes, per-dimension changes, summary sentences.

Roles are detected per table, so the two reports may name their columns
differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.functions.expr import col_ref, pct_change
from bizlens.operators.common import amount
from bizlens.operators.roles import detect_roles


def _totals(df: DataFrame, roles: dict[str, str], suffix: str) -> DataFrame:
    rev = amount(df, roles.get("revenue")) if "revenue" in roles else F.lit(0)
    orders = F.count_distinct(col_ref(roles["order_id"])) if "order_id" in roles else F.count(F.lit(1))
    return df.agg(
        F.coalesce(F.sum(rev).cast("double"), F.lit(0.0)).alias(f"revenue_{suffix}"),
        orders.alias(f"orders_{suffix}"),
    )


def compare_kpis(first: DataFrame, second: DataFrame) -> DataFrame:
    """revenue/orders/average check of both reports and their percent changes."""
    a = _totals(first, detect_roles(first), "1")
    b = _totals(second, detect_roles(second), "2")
    s = b.select(F.struct("revenue_2", "orders_2")).scalar()
    both = a.select("*", s.getField("revenue_2").alias("revenue_2"), s.getField("orders_2").alias("orders_2"))
    avg1 = F.when(F.col("orders_1") > 0, F.col("revenue_1") / F.col("orders_1")).otherwise(F.lit(0.0))
    avg2 = F.when(F.col("orders_2") > 0, F.col("revenue_2") / F.col("orders_2")).otherwise(F.lit(0.0))
    return both.select(
        "revenue_1",
        "revenue_2",
        "orders_1",
        "orders_2",
        avg1.alias("average_check_1"),
        avg2.alias("average_check_2"),
        pct_change(F.col("revenue_2"), F.col("revenue_1")).alias("revenue_change_pct"),
        pct_change(F.col("orders_2").cast("double"), F.col("orders_1").cast("double")).alias("orders_change_pct"),
        pct_change(avg2, avg1).alias("average_check_change_pct"),
    )


def compare_dimension(first: DataFrame, second: DataFrame, role: str) -> DataFrame | None:
    """(position, report_1, report_2, change, change_pct) aligned by a full outer join on the key,
    the largest change first."""
    r1, r2 = detect_roles(first), detect_roles(second)
    if not all(role in r and "revenue" in r for r in (r1, r2)):
        return None

    def side(df: DataFrame, roles: dict[str, str], alias: str) -> DataFrame:
        key = col_ref(roles[role])
        return (
            df.where(key.isNotNull())
            .groupBy(key.cast("string").alias("position"))
            .agg(F.sum(amount(df, roles["revenue"])).cast("double").alias(alias))
        )

    left = side(first, r1, "report_1")
    right = side(second, r2, "report_2")
    joined = left.join(right, "position", "full_outer")
    r1c = F.coalesce(F.col("report_1"), F.lit(0.0))
    r2c = F.coalesce(F.col("report_2"), F.lit(0.0))
    return joined.select(
        "position",
        r1c.alias("report_1"),
        r2c.alias("report_2"),
        (r2c - r1c).alias("change"),
        pct_change(r2c, r1c).alias("change_pct"),
    ).orderBy(F.col("change").desc(), "position")


def compare_summary(kpis: DataFrame) -> DataFrame:
    """One sentence per compared figure (revenue, orders)."""

    def sentence(label: str, first: str, second: str):
        change = pct_change(F.col(second).cast("double"), F.col(first).cast("double"))
        direction = F.when(change >= 0, F.lit("вырос")).otherwise(F.lit("снизился"))
        return F.when(
            change.isNull(),
            F.lit(f"Нельзя корректно рассчитать изменение показателя «{label}»: в первом отчете значение равно нулю."),
        ).otherwise(F.format_string(f"Показатель «{label}» %s на %.1f%%.", direction, F.abs(change)))

    return kpis.select(
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("line"), sentence("выручка", "revenue_1", "revenue_2").alias("text")),
                F.struct(F.lit(2).alias("line"), sentence("количество заказов", "orders_1", "orders_2").alias("text")),
            )
        ).alias("s")
    ).select("s.line", "s.text")
