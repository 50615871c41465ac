"""Registered chart-data and dashboard-slice queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.functions.expr import NUMBER_TEXT
from bizlens.operators import charts, rules, slices
from bizlens.operators.charts import ChartSpec
from bizlens.operators.roles import detect_roles
from bizlens.plans.business import TREND_SQL
from bizlens.plans.oracle import with_views as W
from bizlens.plans.registry import register
from bizlens.sources import views

# the slice a dashboard user picks (fixed values of the fixture)
SLICE_CATEGORIES = ["ECONOMY", "PROMO"]
SLICE_START, SLICE_END = "1996-01-01", "1997-12-31"


def _sales(spark, sf):
    df = views.sales(spark, sf)
    return df, detect_roles(df)


def _doubles(df):
    """Decimals as doubles, for comparable row output."""
    return df.select(*[F.col(f.name).cast("double") if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema.fields])


# ------------------------------------------------------------- aggregations

def _agg_sql(how: str) -> str:
    def one(y: str) -> str:
        v = f"CAST({y} AS DOUBLE)"
        return {
            "sum": f"CAST(coalesce(sum({y}), 0) AS DOUBLE)",
            "mean": f"CAST(sum({y}) AS DOUBLE) / count({y})",
            "median": f"quantile_cont({v}, 0.5)",
            "count": f"CAST(count({y}) AS DOUBLE)",
            "min": f"CAST(min({y}) AS DOUBLE)",
            "max": f"CAST(max({y}) AS DOUBLE)",
        }[how] + f" AS {y}"

    return W("sales") + f"""
SELECT category, {one('revenue')}, {one('quantity')} FROM sales WHERE category IS NOT NULL GROUP BY category"""


def _register_agg(how: str) -> None:
    @register(f"chart_agg_{how}", _agg_sql(how))
    def q(spark, sf):
        df, _ = _sales(spark, sf)
        return charts.chart_data(df, ChartSpec("bar", "category", ["revenue", "quantity"], aggregation=how))


for _how in charts.AGGREGATIONS:
    _register_agg(_how)


@register("chart_sorted", W("sales") + """
SELECT brand, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales WHERE brand IS NOT NULL GROUP BY brand""")
def q_chart_sorted(spark, sf):
    df, _ = _sales(spark, sf)
    return charts.chart_data(df, ChartSpec("bar", "brand", ["revenue"], aggregation="sum", sorting="desc"))


@register("chart_top_n", W("sales") + """
SELECT brand, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales WHERE brand IS NOT NULL GROUP BY brand
ORDER BY sum(revenue) DESC, brand LIMIT 5""")
def q_chart_top_n(spark, sf):
    df, _ = _sales(spark, sf)
    return charts.chart_data(df, ChartSpec("horizontal_bar", "brand", ["revenue"], aggregation="sum", sorting="desc", top_n=5))


@register("chart_pie_other", W("sales") + """,
a AS (SELECT brand, sum(revenue) AS revenue FROM sales WHERE brand IS NOT NULL GROUP BY brand),
r AS (SELECT brand, revenue, row_number() OVER (ORDER BY revenue DESC, brand) AS rn FROM a)
SELECT brand, CAST(revenue AS DOUBLE) AS revenue FROM r WHERE rn <= 10
UNION ALL
SELECT 'Другое', CAST(sum(revenue) AS DOUBLE) FROM r WHERE rn > 10 HAVING count(*) > 0""")
def q_chart_pie_other(spark, sf):
    df, _ = _sales(spark, sf)
    return charts.chart_data(df, ChartSpec("pie", "brand", ["revenue"], aggregation="sum", top_n=10))


def _duck_number(name: str, kind: str) -> str:
    if kind == "date":
        return f"CAST(epoch({name}) AS DOUBLE)"
    if kind == "bool":
        return f"CAST(CAST({name} AS INTEGER) AS DOUBLE)"
    if kind == "text":
        pat = NUMBER_TEXT.replace("'", "''")
        return f"CASE WHEN regexp_full_match({name}, '{pat}') THEN TRY_CAST(trim({name}) AS DOUBLE) END"
    return f"CAST({name} AS DOUBLE)"


SALES_KINDS = [
    ("order_date", "date"), ("customer", "text"), ("product", "text"), ("category", "text"), ("brand", "text"),
    ("revenue", "num"), ("quantity", "num"), ("price", "num"), ("commission", "num"), ("returns", "bool"),
]


def _heatmap_sql() -> str:
    cols = SALES_KINDS
    conv = ", ".join(f"{_duck_number(c, k)} AS {c}" for c, k in cols)
    sel = []
    for i, (a, _) in enumerate(cols):
        sel.append(f"stddev_samp({a}) > 0 AS d{i}")
        for j, (b, _) in enumerate(cols):
            if j > i:
                sel.append(f"corr(CASE WHEN {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL THEN {b} END) AS c_{i}_{j}")
    rows = []
    for i, (a, _) in enumerate(cols):
        for j, (b, _) in enumerate(cols):
            val = f"CASE WHEN coalesce(d{i}, false) THEN 1.0 END" if i == j else f"c_{min(i, j)}_{max(i, j)}"
            rows.append(f"SELECT {i} AS i, {j} AS j, '{a}' AS row_name, '{b}' AS col_name, CAST({val} AS DOUBLE) AS corr FROM w")
    return W("sales") + f""",
n AS (SELECT {conv} FROM sales),
w AS (SELECT {', '.join(sel)} FROM n),
m0 AS ({' UNION ALL '.join(rows)}),
m AS (SELECT i, j, row_name, col_name, CASE WHEN isnan(corr) THEN NULL ELSE corr END AS corr FROM m0),
ok AS (SELECT row_name FROM m GROUP BY row_name HAVING count(corr) > 0)
SELECT i, j, row_name, col_name, round(corr, 9) AS corr FROM m
WHERE row_name IN (SELECT row_name FROM ok) AND col_name IN (SELECT row_name FROM ok)"""


@register("chart_heatmap", _heatmap_sql())
def q_chart_heatmap(spark, sf):
    df, _ = _sales(spark, sf)
    m = charts.chart_data(df, ChartSpec("heatmap", excluded_columns=["order_id"]))
    return m.withColumn("corr", F.round("corr", 9))


@register("chart_scatter_rows", W("sales") + """
SELECT price, CAST(revenue AS DOUBLE) AS revenue, category, quantity FROM sales
WHERE price IS NOT NULL AND revenue IS NOT NULL""")
def q_chart_scatter_rows(spark, sf):
    df, _ = _sales(spark, sf)
    return charts.chart_data(df, ChartSpec("scatter", "price", ["revenue"], hue="category", size="quantity"))


@register("chart_histogram", W("numeric_mix") + """,
v AS (SELECT CAST(amount AS DOUBLE) AS v FROM numeric_mix WHERE amount IS NOT NULL AND NOT isnan(amount)),
r0 AS (SELECT min(v) AS lo0, max(v) AS hi0 FROM v),
r AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM r0),
e AS (SELECT v, lo, hi, (hi - lo) / 30.0 AS step, least(CAST(floor((v - lo) * (30.0 / (hi - lo))) AS INTEGER), 29) AS raw FROM v, r),
e1 AS (SELECT v, lo, hi, step, CASE WHEN v < (CASE WHEN raw >= 30 THEN hi ELSE lo + CAST(raw AS DOUBLE) * step END) THEN raw - 1 ELSE raw END AS i1 FROM e),
e2 AS (SELECT CASE WHEN v >= (CASE WHEN i1 + 1 >= 30 THEN hi ELSE lo + CAST(i1 + 1 AS DOUBLE) * step END) AND i1 <> 29 THEN i1 + 1 ELSE i1 END AS idx FROM e1),
c AS (SELECT idx + 1 AS bin, count(*) AS n FROM e2 GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(1, 30)) AS INTEGER) AS bin)
SELECT s.bin, CASE WHEN s.bin - 1 >= 30 THEN hi ELSE lo + CAST(s.bin - 1 AS DOUBLE) * ((hi - lo) / 30.0) END AS bin_start,
       CASE WHEN s.bin >= 30 THEN hi ELSE lo + CAST(s.bin AS DOUBLE) * ((hi - lo) / 30.0) END AS bin_end,
       coalesce(c.n, 0) AS count
FROM s CROSS JOIN r LEFT JOIN c ON s.bin = c.bin""")
def q_chart_histogram(spark, sf):
    return charts.histogram(views.numeric_mix(spark, sf), "amount", 30)


@register("chart_box_stats", W("numeric_mix") + """,
b AS (SELECT segment, CAST(amount AS DOUBLE) AS v FROM numeric_mix WHERE segment IS NOT NULL AND amount IS NOT NULL),
q AS (SELECT segment, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM b GROUP BY 1)
SELECT b.segment, count(*) AS count, q1, median, q3,
       min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
       max(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
       count(*) FILTER (WHERE NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS outliers
FROM b JOIN q ON b.segment = q.segment GROUP BY b.segment, q1, median, q3""")
def q_chart_box_stats(spark, sf):
    return charts.box_stats(views.numeric_mix(spark, sf), "amount", "segment")


@register("chart_value_counts", W("sales") + "\nUNION ALL\n".join(
    f"""SELECT * FROM (SELECT '{c}' AS column_name, value, count,
               CAST(row_number() OVER (ORDER BY count DESC, value) AS INTEGER) AS rank
        FROM (SELECT coalesce(CAST({c} AS VARCHAR), 'nan') AS value, count(*) AS count FROM sales GROUP BY 1)) WHERE rank <= 10"""
    for c in ("customer", "product", "category")))
def q_chart_value_counts(spark, sf):
    df, _ = _sales(spark, sf)
    return charts.value_counts(df)


@register("chart_multi_series", W("sales") + """
SELECT brand, 'revenue' AS series, CAST(sum(revenue) AS DOUBLE) AS value FROM sales WHERE brand IS NOT NULL GROUP BY brand
UNION ALL
SELECT brand, 'quantity', CAST(sum(quantity) AS DOUBLE) FROM sales WHERE brand IS NOT NULL GROUP BY brand""")
def q_chart_multi_series(spark, sf):
    df, _ = _sales(spark, sf)
    return charts.multi_series(df, ChartSpec("multi", "brand", ["revenue", "quantity"], aggregation="sum"))


@register("chart_combo", W("sales") + """
SELECT category, 1 AS slot, 'revenue' AS series, CAST(sum(revenue) AS DOUBLE) AS value, 'bar' AS kind, 'primary' AS axis
FROM sales WHERE category IS NOT NULL GROUP BY category
UNION ALL
SELECT category, 2, 'quantity', CAST(sum(quantity) AS DOUBLE), 'line', 'secondary' FROM sales WHERE category IS NOT NULL GROUP BY category""")
def q_chart_combo(spark, sf):
    df, _ = _sales(spark, sf)
    return charts.combo(df, ChartSpec("combo", "category", ["revenue", "quantity"], aggregation="sum", use_secondary_y=True))


# -------------------------------------------------------------------- slices

SLICE_WHERE = f"category IN ({', '.join(repr(c) for c in SLICE_CATEGORIES)}) AND order_date BETWEEN DATE '{SLICE_START}' AND DATE '{SLICE_END}'"


def _slice(spark, sf):
    df, roles = _sales(spark, sf)
    return slices.filter_dates(slices.filter_categories(df, roles, SLICE_CATEGORIES), roles, SLICE_START, SLICE_END), roles


SALES_AS_DOUBLES = """order_date, order_id, customer, product, category, brand, CAST(revenue AS DOUBLE) AS revenue, quantity, price,
       CAST(commission AS DOUBLE) AS commission, returns"""


@register("slice_category", W("sales") + f"""
SELECT {SALES_AS_DOUBLES} FROM sales WHERE category IN ({', '.join(repr(c) for c in SLICE_CATEGORIES)})""")
def q_slice_category(spark, sf):
    df, roles = _sales(spark, sf)
    return _doubles(slices.filter_categories(df, roles, SLICE_CATEGORIES))


@register("slice_category_options", W("sales") + """
SELECT DISTINCT CAST(category AS VARCHAR) AS category FROM sales WHERE category IS NOT NULL""")
def q_slice_category_options(spark, sf):
    df, roles = _sales(spark, sf)
    return slices.category_options(df, roles)


@register("slice_dates", W("sales") + f"""
SELECT {SALES_AS_DOUBLES} FROM sales WHERE order_date BETWEEN DATE '{SLICE_START}' AND DATE '{SLICE_END}'""")
def q_slice_dates(spark, sf):
    df, roles = _sales(spark, sf)
    return _doubles(slices.filter_dates(df, roles, SLICE_START, SLICE_END))


@register("slice_date_bounds", W("sales") + """
SELECT min(order_date) AS min_date, max(order_date) AS max_date FROM sales""")
def q_slice_date_bounds(spark, sf):
    df, roles = _sales(spark, sf)
    return slices.date_bounds(df, roles)


@register("slice_kpis", W("sales") + f"""
SELECT count(*) AS rows, CAST(sum(revenue) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders,
       CASE WHEN count(DISTINCT order_id) > 0 THEN CAST(sum(revenue) AS DOUBLE) / count(DISTINCT order_id) END AS average_check
FROM sales WHERE {SLICE_WHERE}""")
def q_slice_kpis(spark, sf):
    df, roles = _slice(spark, sf)
    return slices.slice_kpis(df, roles)


@register("slice_timeline", W("sales") + f"""
SELECT order_date AS ds, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales WHERE {SLICE_WHERE} GROUP BY 1""")
def q_slice_timeline(spark, sf):
    df, roles = _slice(spark, sf)
    return slices.timeline(df, roles)


@register("slice_top20", W("sales") + f"""
SELECT product, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales WHERE {SLICE_WHERE}
GROUP BY product ORDER BY sum(revenue) DESC, product LIMIT 20""")
def q_slice_top20(spark, sf):
    df, roles = _slice(spark, sf)
    return slices.top_products(df, roles)


@register("slice_category_share", W("sales") + f""",
c AS (SELECT category, sum(revenue) AS r FROM sales WHERE {SLICE_WHERE} AND category IS NOT NULL GROUP BY 1)
SELECT category, CAST(r AS DOUBLE) AS revenue, CAST(r AS DOUBLE) / CAST((SELECT sum(r) FROM c) AS DOUBLE) AS share FROM c""")
def q_slice_category_share(spark, sf):
    df, roles = _slice(spark, sf)
    return slices.category_share(df, roles)


@register("slice_insights", W("sales").replace("JOIN customer ON o_custkey = c_custkey)",
                                                f"JOIN customer ON o_custkey = c_custkey),\nsl AS (SELECT * FROM sales WHERE {SLICE_WHERE})")
          .replace("WITH sales AS (", "WITH sales0 AS (").replace(f"sl AS (SELECT * FROM sales WHERE", f"sales AS (SELECT * FROM sales0 WHERE")
          + "," + TREND_SQL + """,
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
def q_slice_insights(spark, sf):
    df, roles = _slice(spark, sf)
    return rules.business_insights(df, roles)


@register("preview_cells", """
SELECT * FROM (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id,
         CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS text,
         lang, source, CAST(n_chars AS VARCHAR) AS n_chars
  FROM documents ORDER BY documents.doc_id LIMIT 12)""")
def q_preview_cells(spark, sf):
    return slices.preview(views.table(spark, sf, "documents"), ["doc_id"], 12, 80)


@register("slice_anomalies", W("sales") + f""",
d AS (SELECT order_date AS ds, sum(revenue) AS y FROM sales
      WHERE {SLICE_WHERE} AND order_date IS NOT NULL AND revenue IS NOT NULL GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(CAST((SELECT min(ds) FROM d) AS TIMESTAMP),
                                             CAST((SELECT max(ds) FROM d) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds),
s AS (SELECT spine.ds, CAST(coalesce(d.y, 0) AS DOUBLE) AS y FROM spine LEFT JOIN d ON spine.ds = d.ds),
q AS (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, count(*) AS n FROM s)
SELECT s.ds, s.y FROM s, q WHERE n >= 7 AND (y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1))""")
def q_slice_anomalies(spark, sf):
    from bizlens.operators import anomaly

    df, roles = _slice(spark, sf)
    return anomaly.daily_iqr_outliers(df, roles)


@register("slice_forecast", W("sales") + f""",
h AS (SELECT order_date AS ds, sum(revenue) AS y FROM sales
      WHERE {SLICE_WHERE} AND order_date IS NOT NULL AND revenue IS NOT NULL GROUP BY 1),
hist AS (SELECT * FROM h WHERE (SELECT count(*) FROM h) >= 10),
ma AS (SELECT CAST(sum(y) AS DOUBLE) / count(*) AS a FROM (SELECT y FROM hist ORDER BY ds DESC LIMIT 7))
SELECT CAST(step AS INTEGER) AS step, CAST((SELECT max(ds) FROM hist) + CAST(step AS INTEGER) AS DATE) AS ds,
       a AS yhat, a * 0.85 AS yhat_lower, a * 1.15 AS yhat_upper
FROM ma, (SELECT unnest(generate_series(1, 30)) AS step) WHERE a IS NOT NULL""")
def q_slice_forecast(spark, sf):
    from bizlens.operators import forecast

    df, roles = _slice(spark, sf)
    return forecast.moving_average(forecast.history(df, roles))
