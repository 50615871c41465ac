"""Arriving files of any schema: typed, profiled and recorded one by one.

The stream names the files that arrive (CSV and workbooks, up to ``MAX_FILES_PER_BATCH`` a batch); each
micro-batch reads them whole with the ``binaryFile`` source, every file with its own delimiter and header. Rows become
(file, values) records, so files of different columns share one job: column kinds are elected per file and
column by grouped aggregates, by the rules of ``sources.csv.infer_types`` and the date patterns of ``operators.typing``. A file
within the cap is ``MAX_FILE_MB`` at most, which bounds the rows a task holds.

Each file ends in one of two places, both written per batch so that a replayed batch replaces its
earlier attempt: a ledger row of kind ``upload`` with its counts and column kinds, or a row (file, size, reason) of the rejected
table: unreadable, no columns, a row with more fields than the header, a size over the cap (not read) or another kind of file.
Files of no bytes are not seen by Spark's file sources and leave no row.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlens.functions.expr import NUMBER_TEXT
from bizlens.operators.common import materialize
from bizlens.operators.typing import DATE_NAME_HINTS, DATE_PATTERNS, parse_timestamp
from bizlens.session import prepare_session
from bizlens.sources.csv import BOOLEAN_TEXT, INTEGER_TEXT, NA_TOKENS, SNIFF_LINES, header_names, sniff_delimiter
from bizlens.sources.workbook import sheet_names, sheet_rows
from bizlens.streaming.ingest import MAX_FILE_MB, MAX_FILES_PER_BATCH

RECORD = "file string, size long, names array<string>, vals array<string>, reason string"
#: Records handed to Spark at a time.
BATCH_RECORDS = 5000
STAMP = "yyyy-MM-dd HH:mm:ss"


def csv_rows(content: bytes) -> Iterator[list[str | None]]:
    """Header names, then the rows of a delimited file; blank lines are skipped."""
    text = content.decode("utf-8-sig")
    head = text.split("\n", SNIFF_LINES)[:SNIFF_LINES]
    sep = sniff_delimiter(*[line.rstrip("\r") for line in head if line.strip()])
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=sep, strict=True)
    header = next((r for r in reader if r), [])
    quoted = io.StringIO()
    csv.writer(quoted).writerow(header)
    yield header_names(quoted.getvalue(), ",") if header else []
    yield from (r for r in reader if r)


def workbook_rows(content: bytes) -> Iterator[list[str | None]]:
    rows = sheet_rows(content)
    yield sheet_names(next(rows, []))
    yield from rows


# How a file is read, by the end of its name.
READERS = {".csv": csv_rows, ".xlsx": workbook_rows}


def file_records(path: str, size: int, content: bytes | None, cap: int) -> Iterator[tuple]:
    """One record with the names, one per row, and one with a reason where the file is refused."""
    suffix = re.search(r"\.[^./]*$", path.lower())
    reader = READERS.get(suffix.group(0) if suffix else "")
    if reader is None:
        yield path, size, None, None, "unsupported kind of file"
        return
    if size > cap:
        yield path, size, None, None, f"larger than {cap} bytes"
        return
    try:
        rows = reader(content)
        names = next(rows)
        if not names:
            raise ValueError("no columns")
        yield path, size, names, None, None
        for i, row in enumerate(rows, start=1):
            if len(row) > len(names):
                raise ValueError(f"row {i} has {len(row)} fields, the header {len(names)}")
            yield path, size, None, [*row, *[None] * (len(names) - len(row))], None
    except Exception as e:  # whatever a broken file raises is its reason; the other files go on
        yield path, size, None, None, f"{type(e).__name__}: {e}"


def _records(cap: int):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "size", "names", "vals", "reason"]
        for pdf in batches:
            for path, size, content in zip(pdf["path"], pdf["length"], pdf["content"]):
                out = []
                for record in file_records(path, int(size), content, cap):
                    out.append(record)
                    if len(out) == BATCH_RECORDS:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                yield pd.DataFrame(out, columns=columns)

    return parse


def read_files(spark: SparkSession, paths: list[str], cap: int = MAX_FILE_MB * 1024 * 1024) -> DataFrame:
    """Records of the named files; the bytes of files over the cap are not read."""
    plain = [re.sub(r"([*?\[\]{}\\])", r"\\\1", p) for p in paths]
    files = spark.read.format("binaryFile").load(plain)
    within = files.where(F.col("length") <= cap).select("path", "length", "content")
    over = files.where(F.col("length") > cap).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return within.unionByName(over).mapInPandas(_records(cap), RECORD)


def _hits(value: Column, test: Column) -> Column:
    return F.count(F.when(test, value))


def column_kinds(records: DataFrame) -> DataFrame:
    """(file, pos, name, kind, missing) of every column; kind is boolean, long, double, date or text."""
    headers = records.where(F.col("names").isNotNull()).select("file", F.posexplode("names").alias("pos", "name"))
    cells = records.where(F.col("vals").isNotNull()).select("file", F.posexplode("vals").alias("pos", "value"))
    v = F.when(~F.trim("value").isin(*NA_TOKENS), F.col("value"))
    cells = cells.select("file", "pos", v.alias("v"))
    value, by_file = F.col("v"), F.lower("file").endswith(".xlsx")
    counts = cells.groupBy("file", "pos").agg(
        F.count(F.lit(1)).alias("rows"), F.count(value).alias("n"),
        _hits(value, value.rlike(BOOLEAN_TEXT)).alias("booleans"),
        _hits(value, value.rlike(NUMBER_TEXT)).alias("numbers"),
        _hits(value, value.rlike(INTEGER_TEXT)).alias("integers"),
        _hits(value, value.rlike(INTEGER_TEXT) & F.trim(value).try_cast("bigint").isNotNull()).alias("longs"),
        _hits(value, by_file & F.try_to_timestamp(value, F.lit(STAMP)).isNotNull()).alias("stamps"))
    hinted = reduce(lambda x, y: x | y, [F.lower("name").contains(h) for h in DATE_NAME_HINTS])
    dates = cells.join(headers.where(hinted).select("file", "pos"), ["file", "pos"]).groupBy("file", "pos").agg(
        F.greatest(*[F.count(parse_timestamp(value, p)) for p in DATE_PATTERNS]).alias("dates"))
    n, rows = F.coalesce("n", F.lit(0)), F.coalesce("rows", F.lit(0))
    dated = F.coalesce("dates", F.lit(0)) >= F.greatest(F.lit(3), F.floor(rows * 0.5))
    kind = (
        F.when(n == 0, F.lit("text")).when(F.col("booleans") == rows, F.lit("boolean")).when(F.col("longs") == n, F.lit("long"))
        .when((F.col("numbers") == n) & (F.col("integers") < n), F.lit("double"))
        .when((F.col("stamps") == n) | dated, F.lit("date")).otherwise(F.lit("text")))
    return headers.join(counts, ["file", "pos"], "left").join(dates, ["file", "pos"], "left").select(
        "file", "pos", "name", kind.alias("kind"), (rows - n).alias("missing"))


def profile_files(records: DataFrame) -> DataFrame:
    """(file, payload): counts and column names by kind of every file that was read to its end."""
    refused = records.where(F.col("reason").isNotNull()).select("file")
    good = records.join(refused, "file", "left_anti")
    whole = good.where(F.col("vals").isNotNull())
    copies = whole.groupBy("file", "vals").agg(F.count(F.lit(1)).alias("n"))
    rows = copies.groupBy("file").agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"))

    def of_kind(*kinds: str) -> Column:
        named = F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), F.struct("pos", "name"))))
        return F.transform(named, lambda x: x["name"])

    columns = column_kinds(good).groupBy("file").agg(
        F.count(F.lit(1)).alias("columns"), F.sum("missing").alias("missing_total"),
        of_kind("boolean", "long", "double").alias("numeric_columns"), of_kind("date").alias("date_columns"), of_kind("text").alias("categorical_columns"))
    zero = F.lit(0).cast("long")
    payload = F.to_json(F.struct(
        F.struct(F.coalesce("rows", zero).alias("rows"), "columns", "missing_total", F.coalesce("duplicates", zero).alias("duplicates")).alias("kpis"),
        "numeric_columns", "date_columns", "categorical_columns"))
    return columns.join(rows, "file", "left").select("file", payload.alias("payload"))


def record_files(spark: SparkSession, paths: list[str], batch_id: int, ledger_path: str, rejected_path: str, user_id: int = 0,
                 cap: int = MAX_FILE_MB * 1024 * 1024) -> None:
    """Write the ledger rows and the rejections of one batch of files, in place of an earlier attempt's."""
    records = materialize(read_files(spark, paths, cap))
    in_order = Window.orderBy("file")  # at most MAX_FILES_PER_BATCH rows
    runs = profile_files(records).select(
        (F.lit(batch_id).cast("long") * 1_000_000 + F.row_number().over(in_order)).alias("run_id"), F.lit(user_id).cast("long").alias("user_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.col("file").alias("file_name"),
        F.lit("upload").alias("kind"), "payload", F.lit(None).cast("string").alias("report_id"))
    runs.write.mode("overwrite").parquet(f"{ledger_path.rstrip('/')}/ingest_batch={batch_id}")
    refused = records.where(F.col("reason").isNotNull()).select("file", "size", "reason")
    refused.write.mode("overwrite").parquet(f"{rejected_path.rstrip('/')}/ingest_batch={batch_id}")


def start_file_ingest(spark: SparkSession, source_dir: str, ledger_path: str, rejected_path: str, checkpoint_dir: str, user_id: int = 0,
                      cap: int = MAX_FILE_MB * 1024 * 1024, available_now: bool = True):
    """Start the ingest of a folder of files; returns the ``StreamingQuery``."""
    prepare_session(spark)
    schema = "path string, modificationTime timestamp, length long, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", MAX_FILES_PER_BATCH).load(source_dir).select("path")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # names of at most MAX_FILES_PER_BATCH files; Spark lists some twice where a name of the batch looks like a pattern
        paths = sorted({r["path"] for r in batch.collect()})
        if paths:
            record_files(batch.sparkSession, paths, batch_id, ledger_path, rejected_path, user_id, cap)

    writer = arriving.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
