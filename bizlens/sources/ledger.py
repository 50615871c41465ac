"""Run ledger: one Parquet table of analysis, upload, chart and map runs.

Appends are plain ``write.mode("append")``; new payload fields may appear in
later runs and are read back with ``mergeSchema``. The newest N runs per user
are picked with ``row_number`` under a ``<= n`` filter, which Spark plans with
a partial per-partition group limit before the shuffle, so even a user with a
third of all runs sends at most n rows per partition to the final window.
"""

from __future__ import annotations

import json
import math
import numbers
from collections.abc import Mapping
from datetime import datetime
from functools import singledispatch
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Run kinds and the summary text used when a run has no KPIs.
KINDS = ("analysis", "upload", "chart", "map")
NO_KPI = "без KPI"

LEDGER_SCHEMA = "run_id long, user_id long, created_at string, file_name string, kind string, payload string, report_id string"


@singledispatch
def payload_value(value: Any) -> Any:
    """What the ledger stores for a value: JSON kinds as they are, frames as records,
    numbers without a JSON form (NaN, infinities) as null, anything else as its text."""
    return str(value)


for _kind in (str, int, bool, type(None)):
    payload_value.register(_kind, lambda v: v)


@payload_value.register
def _(value: numbers.Real) -> float | None:
    return float(value) if math.isfinite(value) else None


@payload_value.register
def _(value: Mapping) -> dict[str, Any]:
    return dict(zip(map(str, value), map(payload_value, value.values())))


@payload_value.register(list)
@payload_value.register(tuple)
@payload_value.register(set)
def _(value) -> list[Any]:
    return [*map(payload_value, value)]


@payload_value.register
def _(value: pd.DataFrame) -> list[Any]:
    return payload_value(value.to_dict(orient="records"))


def append_runs(spark: SparkSession, path: str, runs: list[dict[str, Any]]) -> None:
    """Append run rows; ``payload`` (any JSON-safe object) is stored as JSON text.
    Keys beyond the base columns become extra text columns (schema evolution)."""
    base = ("run_id", "user_id", "created_at", "file_name", "kind", "payload", "report_id")
    extra = sorted({k for r in runs for k in r} - set(base))
    rows = []
    for r in runs:
        rows.append((
            int(r["run_id"] if r.get("run_id") is not None else datetime.now().timestamp() * 1_000_000),
            int(r["user_id"]),
            r.get("created_at") or datetime.now().isoformat(timespec="seconds"),
            r["file_name"],
            r.get("kind", "analysis"),
            json.dumps(payload_value(r.get("payload", {})), ensure_ascii=False),
            r.get("report_id"),
            *[None if r.get(k) is None else str(r[k]) for k in extra],
        ))
    schema = LEDGER_SCHEMA + "".join(f", `{k}` string" for k in extra)
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)


def append_frame(runs: DataFrame, path: str) -> None:
    """Append a DataFrame of runs (e.g. produced by a streaming micro-batch)."""
    runs.write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All runs; columns added by later appends are merged in (older rows get NULL)."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def kpi_summary(payload_json: Column, field: str = "kpis") -> Column:
    """``"k: v; k: v"`` from the payload's KPI object, ``без KPI`` when empty."""
    kpis = F.from_json(F.get_json_object(payload_json, f"$.{field}"), "map<string,string>")
    text = F.array_join(F.transform(F.map_entries(kpis), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return F.when(F.coalesce(F.size(kpis), F.lit(0)) > 0, text).otherwise(F.lit(NO_KPI))


def flat_summary(json_text: Column) -> Column:
    """``"k: v; k: v"`` of a flat JSON object, ``без KPI`` when it is empty."""
    m = F.from_json(json_text, "map<string,string>")
    text = F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return F.when(F.coalesce(F.size(m), F.lit(0)) > 0, text).otherwise(F.lit(NO_KPI))


def latest_n(runs: DataFrame, user_col: str, order_cols: list[str], n: int = 5) -> DataFrame:
    """The newest ``n`` rows per user (descending ``order_cols``), with their rank."""
    w = Window.partitionBy(user_col).orderBy(*[F.col(c).desc() for c in order_cols])
    return runs.withColumn("recent_rank", F.row_number().over(w)).where(F.col("recent_rank") <= n)


def recent_runs(spark: SparkSession, path: str, user_id: int, n: int = 5, kind: str | None = None) -> DataFrame:
    """The newest ``n`` runs of one user with a flattened KPI summary."""
    runs = read_ledger(spark, path).where(F.col("user_id") == user_id)
    if kind:
        runs = runs.where(F.col("kind") == kind)
    return latest_n(runs, "user_id", ["run_id"], n).select(
        "created_at", "file_name", "kind", kpi_summary(F.col("payload")).alias("summary"), "report_id", "recent_rank"
    )
