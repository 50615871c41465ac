"""Sales forecasting: history, moving-average forecast, trend + weekly
seasonality model, horizon KPIs.

The seasonal model is ordinary least squares on
``[1, t, sin(2πk·d/7), cos(2πk·d/7) for k = 1..3]`` (t = days since the
series start, d = days since 1970-01-01). It is fitted from sufficient
statistics: one grouped aggregate computes X'X and X'y per series, so any
number of series of any length is fitted in one job and no series is ever
gathered into one task. Only the 8x8 systems (one row per series) are solved
in pandas. The 80% band is ±1.2816 residual standard deviations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.operators.common import amount
from bizlens.operators.sales import require
from bizlens.operators.timeseries import date_value

MIN_HISTORY = 10
HORIZON = 30
FOURIER_ORDER = 3
SEASONAL_WEEKS = 3
Z80 = 1.2815515655446004
METHOD_MA = "скользящее среднее"
METHOD_SEASONAL = "тренд и недельная сезонность"


def history(df: DataFrame, roles: dict[str, str], min_points: int = MIN_HISTORY) -> DataFrame:
    """(ds, y): revenue summed per exact timestamp over rows with both values;
    empty when fewer than ``min_points`` timestamps exist."""
    require(roles, "date", "revenue")
    ds = date_value(df, roles["date"])
    y = amount(df, roles["revenue"], fill_zero=False)
    h = df.select(ds.alias("ds"), y.alias("y")).where(F.col("ds").isNotNull() & F.col("y").isNotNull())
    h = h.groupBy("ds").agg(F.sum("y").alias("y"))
    n = h.agg(F.count(F.lit(1))).scalar()
    return h.where(n >= min_points)


def _shift(ds_type: T.DataType, base: Column, days: Column) -> Column:
    if isinstance(ds_type, T.DateType):
        return F.date_add(base, days)
    return base + F.make_dt_interval(days=days)


def moving_average(hist: DataFrame, window: int = 7, horizon: int = HORIZON) -> DataFrame:
    """(step, ds, yhat, yhat_lower, yhat_upper): the mean of the last ``window``
    points repeated for ``horizon`` days after the last date; bounds x0.85 / x1.15."""
    last = hist.orderBy(F.col("ds").desc()).limit(window)
    stats = last.agg((F.sum("y").cast("double") / F.count(F.lit(1))).alias("a"))
    end = hist.agg(F.max("ds")).scalar()
    ds_type = hist.schema["ds"].dataType
    steps = stats.where(F.col("a").isNotNull()).select("a", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return steps.select(
        "step",
        _shift(ds_type, end, F.col("step")).alias("ds"),
        F.col("a").alias("yhat"),
        (F.col("a") * 0.85).alias("yhat_lower"),
        (F.col("a") * 1.15).alias("yhat_upper"),
    )


def _design(day_number: Column, t: Column) -> list[Column]:
    cols = [F.lit(1.0), t]
    for k in range(1, FOURIER_ORDER + 1):
        angle = F.lit(2.0 * math.pi * k / 7.0) * day_number
        cols += [F.sin(angle), F.cos(angle)]
    return cols


def seasonal_forecast(series: DataFrame, key_cols: list[str] | None = None, horizon: int = HORIZON) -> DataFrame:
    """Trend + weekly seasonality forecast for every series of a (keys..., ds, y) table.

    Returns (keys..., step, ds, yhat, yhat_lower, yhat_upper).
    """
    keys = list(key_cols or [])
    s = series.select(*keys, F.to_date("ds").alias("ds"), F.col("y").cast("double").alias("y")).where(
        F.col("ds").isNotNull() & F.col("y").isNotNull()
    )
    start = s.groupBy(*keys).agg(F.min("ds").alias("start"), F.max("ds").alias("end"))
    if keys:
        s = s.join(start, keys)
    else:
        se = start.select(F.struct("start", "end")).scalar()
        s = s.select("*", se.getField("start").alias("start"), se.getField("end").alias("end"))
    day_number = F.datediff(F.col("ds"), F.lit("1970-01-01").cast("date")).cast("double")
    t = F.datediff(F.col("ds"), F.col("start")).cast("double")
    x = _design(day_number, t)
    p = len(x)
    xs = s.select(*keys, "start", "end", "y", *[c.alias(f"x{i}") for i, c in enumerate(x)])
    sums = [F.count(F.lit(1)).alias("n")]
    for i in range(p):
        for j in range(i, p):
            sums.append(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"xx_{i}_{j}"))
        sums.append(F.sum(F.col(f"x{i}") * F.col("y")).alias(f"xy_{i}"))
    sums.append(F.sum(F.col("y") * F.col("y")).alias("yy"))
    stats = xs.groupBy(*keys, "start", "end").agg(*sums)

    coef_fields = [T.StructField(f"b{i}", T.DoubleType()) for i in range(p)]
    out_schema = T.StructType(
        [f for f in stats.schema.fields if f.name in (*keys, "start", "end")] + coef_fields + [T.StructField("sigma", T.DoubleType())]
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            xtx = np.zeros((p, p))
            xty = np.zeros(p)
            for i in range(p):
                xty[i] = r[f"xy_{i}"]
                for j in range(i, p):
                    xtx[i, j] = xtx[j, i] = r[f"xx_{i}_{j}"]
            beta, *_ = np.linalg.lstsq(xtx, xty, rcond=None)
            n = float(r["n"])
            sse = float(r["yy"] - 2 * beta @ xty + beta @ xtx @ beta)
            sigma = math.sqrt(max(sse, 0.0) / max(n - p, 1.0))
            rows.append({**{k: r[k] for k in (*keys, "start", "end")}, **{f"b{i}": float(beta[i]) for i in range(p)}, "sigma": sigma})
        return pd.DataFrame(rows, columns=[f.name for f in out_schema.fields])

    # one row per series: the grouped frames are bounded by construction
    coefs = stats.groupBy(*keys).applyInPandas(solve, out_schema) if keys else stats.mapInPandas(lambda it: (solve(b) for b in it), out_schema)
    future = coefs.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    fds = F.date_add(F.col("end"), F.col("step"))
    fx = _design(F.datediff(fds, F.lit("1970-01-01").cast("date")).cast("double"), F.datediff(fds, F.col("start")).cast("double"))
    yhat = sum((F.col(f"b{i}") * fx[i] for i in range(p)), F.lit(0.0))
    band = F.lit(Z80) * F.col("sigma")
    return future.select(
        *keys,
        "step",
        fds.alias("ds"),
        yhat.alias("yhat"),
        (yhat - band).alias("yhat_lower"),
        (yhat + band).alias("yhat_upper"),
    )


def best_forecast(hist: DataFrame, horizon: int = HORIZON) -> tuple[DataFrame, str]:
    """(forecast, method): the seasonal model when the history spans ``SEASONAL_WEEKS``
    whole weeks, which its weekly terms need, else the moving average."""
    span = hist.agg(F.datediff(F.max("ds"), F.min("ds"))).first()[0]
    if span is not None and span >= 7 * SEASONAL_WEEKS:
        return seasonal_forecast(hist.groupBy(F.to_date("ds").alias("ds")).agg(F.sum("y").alias("y")), horizon=horizon), METHOD_SEASONAL
    return moving_average(hist, horizon=horizon), METHOD_MA


def forecast_kpis(forecast: DataFrame, method: str = METHOD_MA) -> DataFrame:
    """Sums of the first 7, 14 and all 30 predicted days."""
    return forecast.agg(
        F.round(F.sum(F.when(F.col("step") <= 7, F.col("yhat"))), 6).alias("forecast_7"),
        F.round(F.sum(F.when(F.col("step") <= 14, F.col("yhat"))), 6).alias("forecast_14"),
        F.round(F.sum(F.when(F.col("step") <= 30, F.col("yhat"))), 6).alias("forecast_30"),
    ).where(F.col("forecast_30").isNotNull()).select("*", F.lit(method).alias("method"))


def forecast_series(hist: DataFrame, forecast: DataFrame) -> DataFrame:
    """History and forecast in one table (part, ds, y, yhat, yhat_lower, yhat_upper)."""
    h = hist.select(F.lit("history").alias("part"), "ds", F.col("y").cast("double").alias("y"))
    f = forecast.select(F.lit("forecast").alias("part"), "ds", "yhat", "yhat_lower", "yhat_upper")
    return h.unionByName(f, allowMissingColumns=True)
