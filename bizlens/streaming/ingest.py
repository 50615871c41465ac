"""Arriving-file ingest with Structured Streaming.

Files dropped into a folder are picked up by the file source; each
micro-batch is profiled per source file (rows, columns, missing cells, size
cap check) with one grouped aggregate and the results are appended to the run
ledger as ``upload`` runs. ``trigger(availableNow=True)`` processes everything
present and stops, which suits scheduled jobs; the checkpoint folder makes a
restart resume after the last committed batch. Each batch overwrites its own
``ingest_batch=<id>`` sub-folder of the ledger, so a replayed batch replaces
its earlier attempt instead of duplicating rows (exactly-once output).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.functions.expr import col_ref

MAX_FILE_MB = 25  # the reference's default upload cap
MAX_FILES_PER_BATCH = 100


def _missing_per_row(schema: T.StructType):
    parts = []
    for f in schema.fields:
        c = col_ref(f.name)
        miss = c.isNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(c)
        parts.append(miss.cast("int"))
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0)


def profile_batch(batch: DataFrame, user_id: int, batch_id: int) -> DataFrame:
    """One ledger row per source file of the batch."""
    cols = [c for c in batch.columns if c != "_file"]
    per_file = batch.groupBy("_file").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(_missing_per_row(T.StructType([batch.schema[c] for c in cols]))).alias("missing"),
        F.max("_size").alias("size"),
    )
    payload = F.to_json(F.struct(
        F.struct(
            F.col("rows").alias("rows"),
            F.lit(len(cols)).alias("columns"),
            F.coalesce(F.col("missing"), F.lit(0)).alias("missing_total"),
        ).alias("kpis"),
        (F.col("size") > F.lit(MAX_FILE_MB * 1024 * 1024)).alias("over_size_cap"),
    ))
    return per_file.select(
        # files per batch are capped by maxFilesPerTrigger: the numbering window is bounded
        (F.lit(batch_id).cast("long") * F.lit(1_000_000) + F.row_number().over(Window.orderBy("_file"))).alias("run_id"),
        F.lit(user_id).cast("long").alias("user_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.col("_file").alias("file_name"),
        F.lit("upload").alias("kind"),
        payload.alias("payload"),
        F.lit(None).cast("string").alias("report_id"),
    )


def start_ingest(spark: SparkSession, source_dir: str, schema: T.StructType, ledger_path: str, checkpoint_dir: str,
                 user_id: int = 0, fmt: str = "parquet", available_now: bool = True):
    """Start the ingest query; returns the ``StreamingQuery``."""
    stream = (
        spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", MAX_FILES_PER_BATCH).load(source_dir)
        .withColumn("_file", F.col("_metadata.file_path"))
        .withColumn("_size", F.col("_metadata.file_size"))
    )

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = profile_batch(batch, user_id, batch_id)
        out.write.mode("overwrite").parquet(f"{ledger_path.rstrip('/')}/ingest_batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
