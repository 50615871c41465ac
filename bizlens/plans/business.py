"""Registered queries of the business modes (sales, marketplace, inventory,
customers, comparison) and their rules, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.functions.expr import money_text, percent_text
from bizlens.operators import comparison, customers, inventory, marketplace, rules, sales
from bizlens.operators.roles import detect_roles
from bizlens.plans.oracle import with_views as W
from bizlens.plans.registry import register
from bizlens.sources import views


def _sales(spark, sf):
    df = views.sales(spark, sf)
    return df, detect_roles(df)


# ---------------------------------------------------------------- sales mode

@register("sales_kpis", W("sales") + """
SELECT CAST(sum(revenue) AS DOUBLE) AS total_revenue, count(DISTINCT order_id) AS orders,
       CAST(sum(revenue) AS DOUBLE) / count(DISTINCT order_id) AS average_check,
       coalesce((SELECT quantile_cont(CAST(revenue AS DOUBLE), 0.5) FROM sales WHERE revenue > 0), 0) AS median_check
FROM sales""")
def q_sales_kpis(spark, sf):
    df, roles = _sales(spark, sf)
    return sales.sales_kpis(df, roles)


@register("sales_top_products", W("sales") + """
SELECT product, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales WHERE product IS NOT NULL
GROUP BY product ORDER BY sum(revenue) DESC, product LIMIT 10""")
def q_sales_top_products(spark, sf):
    df, roles = _sales(spark, sf)
    return sales.top_products(df, roles)


@register("sales_top_categories", W("sales") + """
SELECT category, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales WHERE category IS NOT NULL
GROUP BY category ORDER BY sum(revenue) DESC, category LIMIT 10""")
def q_sales_top_categories(spark, sf):
    df, roles = _sales(spark, sf)
    return sales.top_categories(df, roles)


@register("rule_category_dependency", W("sales") + """
SELECT 2 AS rank, 'category_dependency' AS rule,
       'Компания сильно зависит от одной категории товаров. Это повышает риск просадки при изменении спроса.' AS text
FROM (SELECT max(s) AS top, sum(s) AS total FROM
      (SELECT category, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS s FROM sales WHERE category IS NOT NULL GROUP BY category))
WHERE total > 0 AND top / total > 0.5""")
def q_rule_category_dependency(spark, sf):
    df, roles = _sales(spark, sf)
    return rules.rule_category_dependency(df, roles)


@register("rule_product_dependency", W("sales") + """
SELECT 3 AS rank, 'product_dependency' AS rule,
       'Высокая зависимость от одного товара: один продукт приносит более 40% выручки.' AS text
FROM (SELECT max(s) AS top, sum(s) AS total FROM
      (SELECT product, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS s FROM sales WHERE product IS NOT NULL GROUP BY product))
WHERE total > 0 AND top / total > 0.4""")
def q_rule_product_dependency(spark, sf):
    df, roles = _sales(spark, sf)
    return rules.rule_product_dependency(df, roles)


@register("rule_category_dependency_promo", W("sales_promo") + """
SELECT 2 AS rank, 'category_dependency' AS rule,
       'Компания сильно зависит от одной категории товаров. Это повышает риск просадки при изменении спроса.' AS text
FROM (SELECT max(s) AS top, sum(s) AS total FROM
      (SELECT category, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS s FROM sales_promo WHERE category IS NOT NULL GROUP BY category))
WHERE total > 0 AND top / total > 0.5""")
def q_rule_category_dependency_promo(spark, sf):
    df = views.sales_promo(spark, sf)
    return rules.rule_category_dependency(df, detect_roles(df))


@register("rule_product_dependency_promo", W("sales_promo") + """
SELECT 3 AS rank, 'product_dependency' AS rule,
       'Высокая зависимость от одного товара: один продукт приносит более 40% выручки.' AS text
FROM (SELECT max(s) AS top, sum(s) AS total FROM
      (SELECT product, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS s FROM sales_promo WHERE product IS NOT NULL GROUP BY product))
WHERE total > 0 AND top / total > 0.4""")
def q_rule_product_dependency_promo(spark, sf):
    df = views.sales_promo(spark, sf)
    return rules.rule_product_dependency(df, detect_roles(df))


TREND_SQL = """
d AS (SELECT order_date AS ds, sum(revenue) AS y FROM sales WHERE order_date IS NOT NULL AND revenue IS NOT NULL GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(CAST((SELECT min(ds) FROM d) AS TIMESTAMP),
                                             CAST((SELECT max(ds) FROM d) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds),
series AS (SELECT spine.ds, CAST(coalesce(d.y, 0) AS DOUBLE) AS y FROM spine LEFT JOIN d ON spine.ds = d.ds),
st AS (SELECT count(*) AS n_days,
              avg(y) FILTER (WHERE date_diff('day', (SELECT min(ds) FROM series), ds) < floor((SELECT count(*) FROM series) / 2)) AS f,
              avg(y) FILTER (WHERE date_diff('day', (SELECT min(ds) FROM series), ds) >= floor((SELECT count(*) FROM series) / 2)) AS s
       FROM series)"""


@register("rule_sales_trend", W("sales") + "," + TREND_SQL + """
SELECT 4 AS rank, 'sales_trend' AS rule,
       CASE WHEN s > f * 1.05 THEN 'Наблюдается положительная динамика продаж. Последний период в среднем сильнее предыдущего.'
            WHEN s < f * 0.95 THEN 'Зафиксировано снижение продаж. Нужна проверка причин падения спроса или доступности товара.'
            ELSE 'Продажи выглядят стабильными: существенного роста или падения по периоду не видно.' END AS text
FROM st WHERE n_days >= 4""")
def q_rule_sales_trend(spark, sf):
    df, roles = _sales(spark, sf)
    return rules.rule_sales_trend(df, roles)


@register("business_insights", W("sales") + "," + TREND_SQL + """,
cat AS (SELECT max(s) AS top, sum(s) AS total FROM
        (SELECT category, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS s FROM sales WHERE category IS NOT NULL GROUP BY category)),
prod AS (SELECT max(s) AS top, sum(s) AS total FROM
        (SELECT product, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS s FROM sales WHERE product IS NOT NULL GROUP BY product)),
fired AS (
  SELECT 2 AS rank, 'category_dependency' AS rule,
         'Компания сильно зависит от одной категории товаров. Это повышает риск просадки при изменении спроса.' AS text
  FROM cat WHERE total > 0 AND top / total > 0.5
  UNION ALL
  SELECT 3, 'product_dependency', 'Высокая зависимость от одного товара: один продукт приносит более 40% выручки.'
  FROM prod WHERE total > 0 AND top / total > 0.4
  UNION ALL
  SELECT 4, 'sales_trend',
         CASE WHEN s > f * 1.05 THEN 'Наблюдается положительная динамика продаж. Последний период в среднем сильнее предыдущего.'
              WHEN s < f * 0.95 THEN 'Зафиксировано снижение продаж. Нужна проверка причин падения спроса или доступности товара.'
              ELSE 'Продажи выглядят стабильными: существенного роста или падения по периоду не видно.' END
  FROM st WHERE n_days >= 4)
SELECT * FROM fired
UNION ALL
SELECT 9, 'default', 'Данные не содержат явных бизнес-рисков по базовым правилам.' WHERE (SELECT count(*) FROM fired) = 0""")
def q_business_insights(spark, sf):
    df, roles = _sales(spark, sf)
    return rules.business_insights(df, roles)


# ---------------------------------------------------------- marketplace mode

@register("marketplace_kpis", W("sales") + """
SELECT CAST(sum(revenue) AS DOUBLE) AS total_revenue, count(DISTINCT order_id) AS orders,
       CAST(sum(revenue) AS DOUBLE) / count(DISTINCT order_id) AS average_check,
       coalesce((SELECT quantile_cont(CAST(revenue AS DOUBLE), 0.5) FROM sales WHERE revenue > 0), 0) AS median_check,
       CAST(sum(CASE WHEN returns THEN revenue ELSE 0 END) AS DOUBLE) AS returns_total,
       CAST(sum(commission) AS DOUBLE) AS commissions,
       CAST(sum(revenue - commission - CASE WHEN returns THEN revenue ELSE 0 END) AS DOUBLE) AS profit
FROM sales""")
def q_marketplace_kpis(spark, sf):
    df, roles = _sales(spark, sf)
    return marketplace.marketplace_kpis(df, roles)


@register("marketplace_low_sellers", W("sales") + """
SELECT product, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales WHERE product IS NOT NULL
GROUP BY product ORDER BY sum(revenue) ASC, product DESC LIMIT 10""")
def q_marketplace_low_sellers(spark, sf):
    df, roles = _sales(spark, sf)
    return marketplace.low_sellers(df, roles)


@register("marketplace_pareto", W("sales") + """,
p AS (SELECT product, sum(revenue) AS r FROM sales WHERE product IS NOT NULL GROUP BY product),
c AS (SELECT product, r, sum(r) OVER (ORDER BY r DESC, product ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(r) OVER () AS total FROM p)
SELECT product, CAST(r AS DOUBLE) AS revenue FROM c
WHERE CAST(cum AS DOUBLE) / greatest(CAST(total AS DOUBLE), 1.0) <= 0.8""")
def q_marketplace_pareto(spark, sf):
    df, roles = _sales(spark, sf)
    return marketplace.pareto_core(df, roles)


# ------------------------------------------------------------ inventory mode

def _inventory(spark, sf):
    df = views.inventory(spark, sf)
    return df, detect_roles(df)


INV_STOCK = """,
p AS (SELECT product, CAST(sum(coalesce(stock, 0)) AS DOUBLE) AS stock FROM inventory WHERE product IS NOT NULL GROUP BY product)"""


@register("inventory_stock", W("inventory") + INV_STOCK + """
SELECT product, stock FROM p ORDER BY stock DESC, product LIMIT 30""")
def q_inventory_stock(spark, sf):
    df, roles = _inventory(spark, sf)
    return inventory.stock_top(df, roles)


@register("inventory_low_stock", W("inventory") + INV_STOCK + """
SELECT product, stock FROM p WHERE stock <= greatest(0.25 * (SELECT quantile_cont(stock, 0.5) FROM p), 1)
ORDER BY stock, product LIMIT 20""")
def q_inventory_low_stock(spark, sf):
    df, roles = _inventory(spark, sf)
    return inventory.low_stock(df, roles)


@register("inventory_kpis", W("inventory") + INV_STOCK + """,
low AS (SELECT count(*) AS c FROM p WHERE stock <= greatest(0.25 * (SELECT quantile_cont(stock, 0.5) FROM p), 1))
SELECT coalesce(sum(stock), 0) AS stock_total, least((SELECT c FROM low), 20) AS low_stock_count,
       (SELECT c FROM low) AS low_stock_total FROM p""")
def q_inventory_kpis(spark, sf):
    df, roles = _inventory(spark, sf)
    return inventory.low_stock_kpis(df, roles)


INV_SOLD = """,
s AS (SELECT product, CAST(sum(coalesce(quantity, 0)) AS DOUBLE) AS sold FROM inventory WHERE product IS NOT NULL GROUP BY product)"""


@register("inventory_best_sellers", W("inventory") + INV_SOLD + """
SELECT product, sold FROM s ORDER BY sold DESC, product LIMIT 10""")
def q_inventory_best_sellers(spark, sf):
    df, roles = _inventory(spark, sf)
    return inventory.best_sellers(df, roles)


@register("inventory_worst_sellers", W("inventory") + INV_SOLD + """
SELECT product, sold FROM s ORDER BY sold ASC, product DESC LIMIT 10""")
def q_inventory_worst_sellers(spark, sf):
    df, roles = _inventory(spark, sf)
    return inventory.worst_sellers(df, roles)


# ------------------------------------------------------------ customer mode

CUST = """,
pc AS (SELECT customer, CAST(sum(revenue) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders
       FROM sales WHERE customer IS NOT NULL GROUP BY customer)"""


@register("customer_kpis", W("sales") + CUST + """
SELECT count(*) AS customers,
       (SELECT CAST(sum(revenue) AS DOUBLE) FROM sales) / greatest(sum(orders), 1) AS average_check,
       count(*) FILTER (WHERE orders > 1) AS repeat_customers
FROM pc""")
def q_customer_kpis(spark, sf):
    df, roles = _sales(spark, sf)
    return customers.customer_kpis(df, roles)


@register("customer_top", W("sales") + CUST + """
SELECT customer, revenue FROM pc ORDER BY revenue DESC, customer LIMIT 10""")
def q_customer_top(spark, sf):
    df, roles = _sales(spark, sf)
    return customers.top_customers(df, roles)


@register("customer_high_ltv", W("sales") + CUST + """
SELECT customer, revenue AS ltv FROM pc WHERE revenue >= (SELECT quantile_cont(revenue, 0.9) FROM pc)
ORDER BY revenue DESC, customer LIMIT 30""")
def q_customer_high_ltv(spark, sf):
    df, roles = _sales(spark, sf)
    return customers.high_ltv(df, roles)


# ------------------------------------------------------------ comparison mode

def _reports(spark, sf):
    return views.sales_a(spark, sf), views.sales_b(spark, sf)


CMP_KPIS = """,
k AS (SELECT (SELECT CAST(sum(revenue) AS DOUBLE) FROM sales_a) AS revenue_1,
             (SELECT CAST(sum(revenue) AS DOUBLE) FROM sales_b) AS revenue_2,
             (SELECT count(DISTINCT order_id) FROM sales_a) AS orders_1,
             (SELECT count(DISTINCT order_id) FROM sales_b) AS orders_2)"""


@register("compare_kpis", W("sales_a", "sales_b") + CMP_KPIS + """
SELECT revenue_1, revenue_2, orders_1, orders_2,
       CASE WHEN orders_1 > 0 THEN revenue_1 / orders_1 ELSE 0 END AS average_check_1,
       CASE WHEN orders_2 > 0 THEN revenue_2 / orders_2 ELSE 0 END AS average_check_2,
       CASE WHEN revenue_1 <> 0 THEN (revenue_2 - revenue_1) / revenue_1 * 100 END AS revenue_change_pct,
       CASE WHEN orders_1 <> 0 THEN (CAST(orders_2 AS DOUBLE) - orders_1) / orders_1 * 100 END AS orders_change_pct,
       CASE WHEN orders_1 > 0 AND revenue_1 / orders_1 <> 0
            THEN ((CASE WHEN orders_2 > 0 THEN revenue_2 / orders_2 ELSE 0 END) - revenue_1 / orders_1) / (revenue_1 / orders_1) * 100
       END AS average_check_change_pct
FROM k""")
def q_compare_kpis(spark, sf):
    a, b = _reports(spark, sf)
    return comparison.compare_kpis(a, b)


def _cmp_dim_sql(col: str) -> str:
    return W("sales_a", "sales_b") + f""",
l AS (SELECT CAST({col} AS VARCHAR) AS position, CAST(sum(revenue) AS DOUBLE) AS r FROM sales_a WHERE {col} IS NOT NULL GROUP BY 1),
r AS (SELECT CAST({col} AS VARCHAR) AS position, CAST(sum(revenue) AS DOUBLE) AS r FROM sales_b WHERE {col} IS NOT NULL GROUP BY 1)
SELECT coalesce(l.position, r.position) AS position, coalesce(l.r, 0) AS report_1, coalesce(r.r, 0) AS report_2,
       coalesce(r.r, 0) - coalesce(l.r, 0) AS change,
       CASE WHEN coalesce(l.r, 0) <> 0 THEN (coalesce(r.r, 0) - coalesce(l.r, 0)) / coalesce(l.r, 0) * 100 END AS change_pct
FROM l FULL OUTER JOIN r ON l.position = r.position"""


@register("compare_category", _cmp_dim_sql("category"))
def q_compare_category(spark, sf):
    a, b = _reports(spark, sf)
    return comparison.compare_dimension(a, b, "category")


@register("compare_product", _cmp_dim_sql("product"))
def q_compare_product(spark, sf):
    a, b = _reports(spark, sf)
    return comparison.compare_dimension(a, b, "product")


@register("compare_summary", W("sales_a", "sales_b") + CMP_KPIS + """
SELECT 1 AS line,
       CASE WHEN revenue_1 = 0 THEN 'Нельзя корректно рассчитать изменение показателя «выручка»: в первом отчете значение равно нулю.'
            ELSE printf('Показатель «выручка» %s на %.1f%%.', CASE WHEN revenue_2 >= revenue_1 THEN 'вырос' ELSE 'снизился' END,
                        abs((revenue_2 - revenue_1) / revenue_1 * 100)) END AS text FROM k
UNION ALL
SELECT 2,
       CASE WHEN orders_1 = 0 THEN 'Нельзя корректно рассчитать изменение показателя «количество заказов»: в первом отчете значение равно нулю.'
            ELSE printf('Показатель «количество заказов» %s на %.1f%%.', CASE WHEN orders_2 >= orders_1 THEN 'вырос' ELSE 'снизился' END,
                        abs((CAST(orders_2 AS DOUBLE) - orders_1) / orders_1 * 100)) END FROM k""")
def q_compare_summary(spark, sf):
    a, b = _reports(spark, sf)
    return comparison.compare_summary(comparison.compare_kpis(a, b))


@register("format_kpis", W("sales") + """
SELECT replace(format('{:,.2f}', CAST(sum(revenue) AS DOUBLE)), ',', ' ') AS total_revenue_text,
       replace(format('{:,.2f}', CAST(sum(revenue) AS DOUBLE) / count(DISTINCT order_id)), ',', ' ') AS average_check_text,
       printf('%.1f%%', 100.0 * count(*) FILTER (WHERE returns) / count(*)) AS returns_share_text,
       '-' AS missing_text
FROM sales""")
def q_format_kpis(spark, sf):
    df, roles = _sales(spark, sf)
    k = df.agg(
        F.sum("revenue").cast("double").alias("t"),
        F.count_distinct("order_id").alias("o"),
        (F.lit(100.0) * F.count(F.when(F.col("returns"), 1)) / F.count(F.lit(1))).alias("r"),
    )
    return k.select(
        money_text(F.col("t")).alias("total_revenue_text"),
        money_text(F.col("t") / F.col("o")).alias("average_check_text"),
        percent_text(F.col("r")).alias("returns_share_text"),
        money_text(F.lit(None)).alias("missing_text"),
    )
