"""Registered time-series, forecast and daily-anomaly queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.operators import anomaly, forecast
from bizlens.operators.common import amount
from bizlens.operators.roles import detect_roles
from bizlens.operators.timeseries import daily_sum, monthly_sum
from bizlens.operators.typing import choose_value_column, column_kinds
from bizlens.plans.oracle import with_views as W
from bizlens.plans.registry import register
from bizlens.sources import views


def _sales(spark, sf):
    df = views.sales(spark, sf)
    return df, detect_roles(df)


def _spine_sql(src: str, key: str = "ds") -> str:
    return f"""CAST(unnest(generate_series(CAST((SELECT min({key}) FROM {src}) AS TIMESTAMP),
                                      CAST((SELECT max({key}) FROM {src}) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE)"""


@register("sales_daily", W("sales") + """,
d AS (SELECT order_date AS ds, sum(coalesce(revenue, 0)) AS y FROM sales WHERE order_date IS NOT NULL GROUP BY 1),
spine AS (SELECT """ + _spine_sql("d") + """ AS ds)
SELECT spine.ds, CAST(coalesce(d.y, 0) AS DOUBLE) AS y FROM spine LEFT JOIN d ON spine.ds = d.ds""")
def q_sales_daily(spark, sf):
    df, roles = _sales(spark, sf)
    return daily_sum(df, roles["date"], amount(df, roles["revenue"]))


@register("sales_monthly", W("sales") + """,
d AS (SELECT date_trunc('month', order_date) AS m, sum(coalesce(revenue, 0)) AS y FROM sales WHERE order_date IS NOT NULL GROUP BY 1),
spine AS (SELECT unnest(generate_series((SELECT min(m) FROM d), (SELECT max(m) FROM d), INTERVAL 1 MONTH)) AS m)
SELECT CAST(last_day(spine.m) AS DATE) AS month_end, CAST(coalesce(d.y, 0) AS DOUBLE) AS y
FROM spine LEFT JOIN d ON CAST(spine.m AS DATE) = CAST(d.m AS DATE)""")
def q_sales_monthly(spark, sf):
    df, roles = _sales(spark, sf)
    return monthly_sum(df, roles["date"], amount(df, roles["revenue"]))


@register("daily_value_series", W("dirty") + """,
d AS (SELECT day AS ds, sum(revenue) AS y FROM dirty WHERE day IS NOT NULL AND revenue IS NOT NULL GROUP BY 1),
spine AS (SELECT """ + _spine_sql("d") + """ AS ds)
SELECT spine.ds, CAST(coalesce(d.y, 0) AS DOUBLE) AS y FROM spine LEFT JOIN d ON spine.ds = d.ds""")
def q_daily_value_series(spark, sf):
    df = views.dirty(spark, sf)
    kinds = column_kinds(df)
    date_col, value_col = kinds.date[0], choose_value_column(kinds.numeric)
    rows = df.where(F.col(date_col).isNotNull() & F.col(value_col).isNotNull())
    return daily_sum(rows, date_col, amount(rows, value_col, fill_zero=False))


@register("anomaly_daily_iqr", W("sales") + """,
d AS (SELECT order_date AS ds, sum(revenue) AS y FROM sales WHERE order_date IS NOT NULL AND revenue IS NOT NULL GROUP BY 1),
spine AS (SELECT """ + _spine_sql("d") + """ AS ds),
s AS (SELECT spine.ds, CAST(coalesce(d.y, 0) AS DOUBLE) AS y FROM spine LEFT JOIN d ON spine.ds = d.ds),
q AS (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, count(*) AS n FROM s)
SELECT s.ds, s.y FROM s, q WHERE n >= 7 AND (y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1))""")
def q_anomaly_daily_iqr(spark, sf):
    df, roles = _sales(spark, sf)
    return anomaly.daily_iqr_outliers(df, roles)


HIST_SQL = """,
h AS (SELECT order_date AS ds, sum(revenue) AS y FROM sales WHERE order_date IS NOT NULL AND revenue IS NOT NULL GROUP BY 1),
hist AS (SELECT * FROM h WHERE (SELECT count(*) FROM h) >= 10),
ma AS (SELECT CAST(sum(y) AS DOUBLE) / count(*) AS a FROM (SELECT y FROM hist ORDER BY ds DESC LIMIT 7)),
fc AS (SELECT step, CAST((SELECT max(ds) FROM hist) + CAST(step AS INTEGER) AS DATE) AS ds, a AS yhat, a * 0.85 AS yhat_lower, a * 1.15 AS yhat_upper
       FROM ma, (SELECT unnest(generate_series(1, 30)) AS step) WHERE a IS NOT NULL)"""


@register("forecast_history", W("sales") + HIST_SQL + "\nSELECT ds, CAST(y AS DOUBLE) AS y FROM hist")
def q_forecast_history(spark, sf):
    df, roles = _sales(spark, sf)
    return forecast.history(df, roles).withColumn("y", F.col("y").cast("double"))


@register("forecast_moving_average", W("sales") + HIST_SQL + "\nSELECT CAST(step AS INTEGER) AS step, ds, yhat, yhat_lower, yhat_upper FROM fc")
def q_forecast_moving_average(spark, sf):
    df, roles = _sales(spark, sf)
    return forecast.moving_average(forecast.history(df, roles))


@register("forecast_kpis", W("sales") + HIST_SQL + """
SELECT round(sum(yhat) FILTER (WHERE step <= 7), 6) AS forecast_7, round(sum(yhat) FILTER (WHERE step <= 14), 6) AS forecast_14,
       round(sum(yhat), 6) AS forecast_30, 'скользящее среднее' AS method
FROM fc HAVING count(*) > 0""")
def q_forecast_kpis(spark, sf):
    df, roles = _sales(spark, sf)
    return forecast.forecast_kpis(forecast.moving_average(forecast.history(df, roles)))


@register("forecast_series", W("sales") + HIST_SQL + """
SELECT 'history' AS part, ds, CAST(y AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS yhat, CAST(NULL AS DOUBLE) AS yhat_lower,
       CAST(NULL AS DOUBLE) AS yhat_upper FROM hist
UNION ALL
SELECT 'forecast', ds, NULL, yhat, yhat_lower, yhat_upper FROM fc""")
def q_forecast_series(spark, sf):
    df, roles = _sales(spark, sf)
    h = forecast.history(df, roles)
    return forecast.forecast_series(h, forecast.moving_average(h))


@register("forecast_seasonal")
def q_forecast_seasonal(spark, sf):
    """Trend + weekly seasonality per order-priority series (many series, one job)."""
    o = views.table(spark, sf, "orders")
    series = o.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("ds")).agg(F.sum("o_totalprice").alias("y"))
    return forecast.seasonal_forecast(series, ["o_orderpriority"])
