"""CSV scan with delimiter detection, pandas-style headers and missing tokens,
and a typing pass (booleans, numbers, then day-first dates).

The headers and a few lines are read first, the delimiter of each kind of file is chosen from
``, ; tab |`` by how evenly it cuts them, and the body is read by Spark's CSV source as text with that delimiter, so the scan is
split across tasks like any CSV read. Files in which quoted fields run over lines are split as well:
``quoted_records`` finds where their records begin (see there). Column types are decided from one
aggregate over the whole file.
"""

from __future__ import annotations

import csv
import io
import re
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.functions.expr import NUMBER_TEXT, col_ref
from bizlens.operators.typing import coerce_date_columns

DELIMITERS = (",", ";", "\t", "|")

# Text that pandas reads as missing by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
BOOLEAN_TEXT = r"^(True|TRUE|true|False|FALSE|false)$"
SNIFF_LINES = 20
INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"


def sniff_delimiter(*lines: str) -> str:
    """The delimiter that cuts the first line into several fields and most of the given
    lines into as many, quoted delimiters not counted; a comma where none does."""

    def fit(d: str) -> tuple[bool, int, int]:
        widths = [len(r) for r in csv.reader(lines, delimiter=d)] or [0]
        return widths[0] > 1, widths.count(widths[0]), widths[0]

    best = max(DELIMITERS, key=fit)
    return best if fit(best)[0] else ","


def file_layouts(spark: SparkSession, path: str) -> list[tuple[str, bool, list[str]]]:
    """(header line, whether quoted fields run over lines, files) per kind of file below ``path``.

    One pass over the text: the first line of each file, and whether some line holds an odd number
    of quotes, so that a record goes on in the next. The driver gets the file names, which it lists for any scan."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    odd = (F.length("value") - F.length(F.translate("value", '"', ""))) % 2 == 1
    first = F.struct("start", "at")  # lines of one split keep their order
    files = lines.groupBy("file").agg(F.min_by("value", first).alias("header"), F.max(odd).alias("quoted"))
    kinds = files.groupBy("header", "quoted").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    found = [(r["header"].lstrip("\ufeff"), r["quoted"], [_plain_path(f) for f in r["files"]]) for r in kinds]
    return sorted(found, key=lambda kind: kind[2][0])


def _plain_path(uri: str) -> str:
    """A file's URI as a path for a reader: decoded, and not taken as a pattern."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", unquote(uri))


def ends_quoted(line: str, quoted: bool, sep: str) -> bool:
    """Whether a line that begins inside a quoted field (or outside) ends inside one.

    A quote opens a field only where the field begins, a doubled quote stands for itself, and a
    closing quote that no delimiter follows makes the rest of the field plain, as in Spark's CSV reader."""
    at = 0
    while True:
        if not quoted:
            if not line.startswith('"', at):
                at = line.find(sep, at) + 1
                if not at:
                    return False
                continue
            at += 1
        close = line.find('"', at)
        if close < 0:
            return True
        after = line[close + 1:close + 2]
        quoted = after == '"'
        if after in ("", "\r"):
            return False
        at = close + 2 if quoted or after == sep else line.find(sep, close) + 1
        if not at:
            return False


def _split_ends(sep: str):
    """Per split: does it end inside quotes when it begins outside, and when it begins inside."""

    def run(batches):
        key, ends = None, [False, True]
        for pdf in batches:
            for file, start, line in zip(pdf["file"], pdf["start"], pdf["value"]):
                if (file, start) != key:
                    if key is not None:
                        yield pd.DataFrame([(*key, *ends)], columns=["file", "start", "from_plain", "from_quoted"])
                    key, ends = (file, start), [False, True]
                if '"' in line:
                    ends = [ends_quoted(line, q, sep) for q in ends]
        if key is not None:
            yield pd.DataFrame([(*key, *ends)], columns=["file", "start", "from_plain", "from_quoted"])

    return run


WHOLE, HEAD, TAIL = 0, 1, 2


def _cut_records(sep: str):
    """Records of each split: whole ones, the rest of a record begun before, and the begin of one that goes on."""

    def run(batches):
        key, quoted, held, kind, out = None, False, [], WHOLE, []

        def put(k):
            out.append((*key, k, "\n".join(held)))
            held.clear()

        for pdf in batches:
            for file, start, inside, line in zip(pdf["file"], pdf["start"], pdf["inside"], pdf["value"]):
                if (file, start) != key:
                    if held:
                        put(kind or TAIL)
                    key, quoted, kind, first = (file, start), inside, HEAD if inside else WHOLE, start == 0
                held.append(line)
                if '"' in line:
                    quoted = ends_quoted(line, quoted, sep)
                if not quoted:
                    if first:
                        held.clear()  # the header
                    else:
                        put(kind)
                    kind, first = WHOLE, False
            yield pd.DataFrame(out, columns=["file", "start", "kind", "record"])
            out.clear()
        if held:
            put(kind or TAIL)
            yield pd.DataFrame(out, columns=["file", "start", "kind", "record"])

    return run


def quoted_records(spark: SparkSession, files: list[str], sep: str) -> DataFrame:
    """(record): the records of CSV files without their headers, quoted line ends kept, read split by split.

    Whether a split begins inside a quoted field depends on all before it. So every split is first
    reduced to two bits, how it ends from either begin; a window over these (one small row per split)
    gives the true begins. Then every split cuts its lines into records, and
    what the edge of a split cut (at most two pieces a split) is put together again by the split that
    the record began in. A record must fit into a task's memory, and a quote never closed makes all that follows one record.
    """
    lines = spark.read.text(files, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    ends = lines.select("file", "start", "value").mapInPandas(_split_ends(sep), "file string, start long, from_plain boolean, from_quoted boolean")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.count_if(F.col("from_plain") & ~F.col("from_quoted")).over(before), F.lit(0))
    fixed = F.when(F.col("from_plain") == F.col("from_quoted"), F.struct(F.col("from_plain").cast("int").alias("end"), F.col("swaps").alias("swaps")))
    # the last split that ends alike from either begin, and how many since then turn the state over
    known_end = F.coalesce(F.last(fixed, ignorenulls=True).over(before), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("swaps")))
    begins = ends.withColumn("swaps", swaps).withColumn("known", known_end).where((F.col("known.end") + F.col("swaps") - F.col("known.swaps")) % 2 == 1)
    begins = begins.select("file", "start", F.lit(True).alias("inside"))
    # rows of splits that begin inside a field: fewer than the splits that the driver plans
    known = lines.join(F.broadcast(begins), ["file", "start"], "left").select("file", "start", F.coalesce("inside", F.lit(False)).alias("inside"), "value")
    cut = known.mapInPandas(_cut_records(sep), "file string, start long, kind int, record string")
    order = Window.partitionBy("file").orderBy("start", "kind")
    begun = F.last(F.when(F.col("kind") == TAIL, F.col("start")), ignorenulls=True).over(order)
    pieces = cut.where(F.col("kind") != WHOLE).withColumn("begun", begun)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "kind", "record"))), lambda x: x["record"]), "\n")
    joined = pieces.groupBy("file", "begun").agg(text.alias("record")).select("record")
    return cut.where(F.col("kind") == WHOLE).select("record").unionByName(joined).where(F.trim(F.translate("record", "\r\t", "")) != "")


def _parsed(records: DataFrame, names: list[str], sep: str) -> DataFrame:
    """The fields of records as text columns; a carriage return before a record's end is no part of it."""
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    row = F.from_csv(F.regexp_replace("record", r"\r\z", ""), fields, {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"})
    return records.select(row.alias("r")).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def header_names(header_line: str, sep: str) -> list[str]:
    """Column names as pandas makes them: ``Unnamed: i`` for blanks, ``a.1`` for
    repeats, then stripped, with ``column_{i+1}`` for names that end up empty."""
    raw = next(csv.reader(io.StringIO(header_line), delimiter=sep)) if header_line else []
    names: list[str] = []
    seen: dict[str, int] = {}
    for i, name in enumerate(raw):
        name = name if name != "" else f"Unnamed: {i}"
        base = name
        while name in seen:
            seen[base] += 1
            name = f"{base}.{seen[base]}"
        seen.setdefault(name, 0)
        names.append(name)
    return [n.strip() or f"column_{i + 1}" for i, n in enumerate(names)]


def read_csv(spark: SparkSession, path: str, coerce_dates: bool = True) -> DataFrame:
    """Typed DataFrame of a delimited text file (or folder of them).

    Files are told apart by their header and put together by column name, in whatever order a file has its
    columns; a column that a file lacks is missing there. Files are split across tasks, also where quoted fields run
    over several lines; only such a file with lone carriage returns as line ends is read by one task.
    """
    parts = []
    layouts = file_layouts(spark, path)
    for header, quoted, files in layouts:
        lines = [r[0].lstrip("\ufeff") for r in spark.read.text(files[0]).limit(SNIFF_LINES).collect()]
        sep = sniff_delimiter(*lines)
        names = header_names(header, sep)
        if not names:
            continue
        if quoted and any("\n" in r[0] for r in spark.read.text(files, lineSep="\r").limit(SNIFF_LINES).collect()):
            raw = _parsed(quoted_records(spark, files, sep), names, sep)
        else:
            schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
            raw = spark.read.csv(path if len(layouts) == 1 else files, schema=schema, sep=sep, header=True, quote='"', escape='"', multiLine=quoted)
        parts.append(raw.select(*[F.when(F.trim(col_ref(c)).isin(*NA_TOKENS) | col_ref(c).isNull(), None).otherwise(col_ref(c)).alias(c) for c in raw.columns]))
    if not parts:
        parts = [spark.read.csv(path, header=True, inferSchema=False)]
    typed = infer_types(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts))
    return coerce_date_columns(typed, min_share=0.5) if coerce_dates else typed


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns by one aggregate over the whole table: to boolean where every
    row is a true/false text (none missing), to long where every value is an integer of
    at most 64 bits, to double where every value is a number. Columns of integers of which
    some are longer stay text, with all their digits; so do all others."""
    if not df.columns:
        return df
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        v = col_ref(c)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count(F.when(v.rlike(BOOLEAN_TEXT), 1)).alias(f"bool{i}"),
            F.count(F.when(v.rlike(NUMBER_TEXT), 1)).alias(f"num{i}"),
            F.count(F.when(v.rlike(INTEGER_TEXT), 1)).alias(f"int{i}"),
            F.count(F.when(v.rlike(INTEGER_TEXT), F.trim(v).try_cast("bigint"))).alias(f"long{i}"),
        ]
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(df.columns):
        n, v = row[f"n{i}"], col_ref(c)
        if n and row[f"bool{i}"] == row["rows"]:
            out.append(v.try_cast("boolean").alias(c))
        elif n and row[f"long{i}"] == n:
            out.append(F.trim(v).try_cast("bigint").alias(c))
        elif n and row[f"num{i}"] == n and row[f"int{i}"] < n:
            out.append(F.trim(v).try_cast("double").alias(c))
        else:
            out.append(v.alias(c))
    return df.select(*out)
