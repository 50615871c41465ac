"""Result records: the first rows of a result table as JSON objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.functions.expr import col_ref


def records(df: DataFrame, order_by: Sequence[str], limit: int = 20) -> DataFrame:
    """(position, record): the first ``limit`` rows by ``order_by`` as JSON text;
    NaN becomes null like a missing value."""
    cleaned = df.select(*[
        F.when(~F.isnan(col_ref(f.name)), col_ref(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else col_ref(f.name)
        for f in df.schema.fields
    ])
    head = cleaned.orderBy(*[col_ref(c) for c in order_by]).limit(limit)
    return head.select(*[col_ref(c) for c in order_by], F.to_json(F.struct(*[col_ref(c) for c in df.columns])).alias("record"))
