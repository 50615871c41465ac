"""Exact dedup as a stateful stream over the document files.

Method: the files arrive as a Structured Streaming source; the keyed state is a
streaming aggregation in the RocksDB (disk-backed) state store, with no
watermark and therefore no expiry. Per digest the state retains the number of
rows seen and, for the row that stays, its stable identifier and its content
locator (file and row index inside the file), never the text. Every
micro-batch writes the groups it changed; a later batch only raises a group's
count, so the largest count per digest is its final state.

Hits are then checked on full bytes: the texts of all rows whose digest was hit
are fetched by locator and compared with the text at the keeper's locator. Large
groups are compared in salted slices of ``SLICE`` rows, so no task holds a
whole group of copies. Texts that share a digest without being equal (never
seen with SHA-256; a weak digest is used in the tests) are regrouped by text.

Only DataFrame functions run here; the stream survives lost executors through
its checkpoint in the shared folder.

Defined results: a NULL text counts as empty; equal texts need equal bytes;
the row with the largest ``doc_id`` stays (NULL ids lose, equal ids are decided by
file and row index, so exactly one row of a group is kept); every input row
gives one output row, repeated rows too; an empty table gives no rows; further
columns of the input are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.common import materialize, scratch

#: Copies compared against one replica of the kept text.
SLICE = 10_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _located(reader, path: str, id_col: str, text_col: str, digest) -> DataFrame:
    """(doc_id, digest, text, file, row) of a batch or streaming reader."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return reader.parquet(path).select(
        F.col(id_col).alias("doc_id"),
        digest(text).alias("digest"),
        text.alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def stream_groups(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                  digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None,
                  folder: str | None = None) -> DataFrame:
    """Run the stateful stream over the files below ``path`` and return the final
    state: (digest, group_size, keep_id, keep_file, keep_row).

    ``folder`` holds the stream's checkpoint and may be given again later: files
    already seen are then in the state and only new ones are read.
    """
    folder = folder or scratch(spark, "exact-stream")
    session = spark.newSession()
    for key, value in {
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        # one store per shuffle partition: without preallocation a small store takes little disk
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }.items():
        session.conf.set(key, value)
    # a pattern instead of the plain path: the source may be one file or a folder of files
    source = session.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    state = _located(source, pattern, id_col, text_col, digest).groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct("doc_id", "file", "row")).alias("keeper"),
    )

    def write_changes(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    query = (
        state.writeStream.outputMode("update").foreachBatch(write_changes)
        .option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return (
        spark.read.schema(state.schema).parquet(f"{folder}/changes/batch=*")
        .groupBy("digest").agg(F.max(F.struct("group_size", "keeper")).alias("last"))
        .select("digest", F.col("last.group_size").alias("group_size"), F.col("last.keeper.doc_id").alias("keep_id"),
                F.col("last.keeper.file").alias("keep_file"), F.col("last.keeper.row").alias("keep_row"))
    )


def _mismatches(rows: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of hit digests with their texts, and those unequal to the kept text."""
    hit = rows.where(F.col("group_size") > 1).join(texts, ["file", "row"])
    slices = F.ceil(F.col("group_size") / F.lit(SLICE)).cast("int")
    members = hit.where(~F.col("kept")).withColumn("slice", F.pmod(F.xxhash64("file", "row"), slices).cast("int"))
    keepers = hit.where("kept").select("digest", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    unequal = members.join(keepers, ["digest", "slice"]).where(F.col("text") != F.col("kept_text"))
    return hit, unequal.select("digest").distinct()


def streaming_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                    digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, file, row."""
    if not spark.read.parquet(path).head(1):
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, file string, row long")
    groups = stream_groups(spark, path, id_col, text_col, digest, files_per_batch)
    located = _located(spark.read, path, id_col, text_col, digest)
    same = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    rows = materialize(
        located.withColumn("text_sha256", sha256(F.col("text"))).drop("text")
        .join(groups, "digest").withColumn("kept", same).drop("keep_file", "keep_row")
    )
    hit, unequal = _mismatches(rows, located.select("file", "row", "text"))
    unequal = materialize(unequal)
    if unequal.head(1):
        again = hit.join(unequal, "digest")
        by_text = again.groupBy("digest", "text").agg(
            F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "file", "row")).alias("keeper"))
        mended = again.drop("group_size", "keep_id", "kept").join(by_text, ["digest", "text"]).withColumns({
            "keep_id": F.col("keeper.doc_id"),
            "kept": (F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row")),
        })
        rows = rows.join(unequal, "digest", "left_anti").unionByName(mended.select(*rows.columns))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "file", "row")
