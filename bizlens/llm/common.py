"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.operators.common import materialize
from bizlens.session import ensure_checkpoint_dir, prepare_session

__all__ = ["batch_rows", "drop_folder", "materialize", "read_table", "row_key", "scratch", "unused"]

#: Rows per Arrow batch handed to Python: whole texts travel in these batches,
#: so the default of 10,000 rows would hold gigabytes of long documents.
ARROW_ROWS = 1000


def batch_rows(spark: SparkSession) -> None:
    """Ship the package to the workers and bound the Arrow batches by rows."""
    prepare_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more, wherever the shared folder lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores appended, so that it is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*columns: Column) -> Column:
    """128-bit key (32 hex characters) of the given columns, NULLs included."""
    flags = [c.isNull() for c in columns]
    first = F.xxhash64(*flags, *columns)
    second = F.xxhash64(F.lit("second"), *flags, *columns)
    return F.concat(F.lpad(F.hex(first), 16, "0"), F.lpad(F.hex(second), 16, "0"))
