"""Anomaly detection: daily revenue outside the IQR fences.

The isolation forest over table rows lives in ``bizlens.operators.ml.iforest``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.operators.prefix import exact_quantiles
from bizlens.operators.rules import trend_series

MIN_DAYS = 7

# Recommendation texts of the anomaly detectors.
TEXT_ROWS = "Найдены нетипичные числовые значения. Проверьте эти строки на ошибки загрузки, возвраты или разовые крупные сделки."
TEXT_DAYS = "В продажах есть дни с аномально высокой или низкой выручкой. Их стоит сверить с акциями, сбоями или остатками."


def daily_iqr_outliers(df: DataFrame, roles: dict[str, str], k: float = 1.5) -> DataFrame:
    """(ds, y): gap-filled daily revenue outside [q1 - k*iqr, q3 + k*iqr]; needs >= 7 days."""
    if "date" not in roles or "revenue" not in roles:
        return df.sparkSession.createDataFrame([], "ds date, y double")
    series = trend_series(df, roles)
    q = exact_quantiles(series, "y", [0.25, 0.75], names=["q1", "q3"])
    fences = q.select(F.struct((F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lo"),
                               (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("hi"))).scalar()
    n = series.agg(F.count(F.lit(1))).scalar()
    return series.where((n >= MIN_DAYS) & ((F.col("y") < fences.getField("lo")) | (F.col("y") > fences.getField("hi"))))
