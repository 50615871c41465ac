"""Workbook scan: the first sheet of many ``.xlsx`` files, whole files per task.

The files are read by Spark's ``binaryFile`` source, so they may lie on any storage Spark reads; only tasks see their
bytes. A workbook is a zip of XML parts; its sheet is parsed row by row with the standard library. Cells come back
as text (shared strings resolved, inline strings and numbers as written, numbers under a date number format as
``yyyy-MM-dd HH:mm:ss``); the first row is the header, named pandas-style. Types are then inferred with the same pass
as the CSV reader, and columns of date cells become timestamps.

Memory of a task: the bytes of the files of its split (``spark.sql.files.maxPartitionBytes``, or one larger file), the
shared strings of one workbook and ``BATCH_ROWS`` rows. The header pass stops after the first row of each sheet.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from bizlens.functions.expr import col_ref

#: Rows handed to Spark at a time.
BATCH_ROWS = 5000
NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
# Built-in number formats that show dates or times (ECMA-376 numFmtId).
DATE_FORMAT_IDS = frozenset(range(14, 23)) | frozenset(range(45, 48))
EPOCH_1900 = datetime.datetime(1899, 12, 30)
EPOCH_1904 = datetime.datetime(1904, 1, 1)
REL_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet_name(z: zipfile.ZipFile) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = wb.find("m:sheets/m:sheet", NS)
    rid = sheet.get(REL_NS) if sheet is not None else None
    if rid and "xl/_rels/workbook.xml.rels" in z.namelist():
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        for rel in rels:
            if rel.get("Id") == rid:
                target = rel.get("Target").lstrip("/")
                return target if target.startswith("xl/") else "xl/" + target
    return "xl/worksheets/sheet1.xml"


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Cell style indexes whose number format shows a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    styles = ET.fromstring(z.read("xl/styles.xml"))
    custom = set()
    for fmt in styles.findall("m:numFmts/m:numFmt", NS):
        code = re.sub(r'"[^"]*"|\\.|\[[^]]*\]', "", fmt.get("formatCode", "")).lower()
        if any(ch in code for ch in "dyhs") or ("m" in code and "0" not in code):
            custom.add(int(fmt.get("numFmtId")))
    out = set()
    for i, xf in enumerate(styles.findall("m:cellXfs/m:xf", NS)):
        fid = int(xf.get("numFmtId", "0"))
        if fid in DATE_FORMAT_IDS or fid in custom:
            out.add(i)
    return out


def _serial_to_text(value: str, epoch: datetime.datetime) -> str:
    moment = epoch + datetime.timedelta(days=float(value))
    return moment.replace(microsecond=0).strftime("%Y-%m-%d %H:%M:%S")


def _parts(z: zipfile.ZipFile, part: str, tag: str) -> Iterator[ET.Element]:
    """The elements ``tag`` of an XML part one by one, each dropped after its use."""
    with z.open(part) as f:
        path: list[ET.Element] = []
        for event, e in ET.iterparse(f, events=("start", "end")):
            if event == "start":
                path.append(e)
                continue
            path.pop()
            if e.tag == tag:
                yield e
                path[-1].remove(e)


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """The rows of a workbook's first sheet as text cells, read on as they are taken."""
    main = f"{{{NS['m']}}}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        date_styles = _date_styles(z)
        pr = ET.fromstring(z.read("xl/workbook.xml")).find("m:workbookPr", NS)
        epoch = EPOCH_1904 if pr is not None and pr.get("date1904") in ("1", "true") else EPOCH_1900
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(main + "t")) for si in _parts(z, "xl/sharedStrings.xml", main + "si")]

        def text_of(c: ET.Element) -> str | None:
            kind, v = c.get("t"), c.find("m:v", NS)
            if kind == "inlineStr":
                return "".join(t.text or "" for t in c.iter(main + "t"))
            if v is None or v.text is None:
                return None
            if kind == "s":
                return shared[int(v.text)]
            if kind == "b":
                return "True" if v.text.strip() == "1" else "False"
            if kind in (None, "n") and int(c.get("s", "0")) in date_styles:
                return _serial_to_text(v.text, epoch)
            return v.text

        for row in _parts(z, _first_sheet_name(z), main + "row"):
            values: list[str | None] = []
            for c in row.findall("m:c", NS):
                at = _col_index(c.get("r")) if c.get("r") else len(values)
                values += [None] * (at + 1 - len(values))
                values[at] = text_of(c)
            yield values


def sheet_names(header: list[str | None]) -> list[str]:
    """Column names of a header row, made as the CSV reader makes them."""
    from bizlens.sources.csv import header_names

    return header_names(",".join('"' + (h or "").replace('"', '""') + '"' for h in header), ",") if header else []


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the workbooks at ``path``: a folder, a file or a pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")


def workbook_schema(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in dict.fromkeys(names)])


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            names = sheet_names(next(sheet_rows(content), []))
            if names:
                yield pd.DataFrame({"path": path, "pos": range(len(names)), "name": names})


def _reader(columns: list[str]):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = sheet_rows(content)
                at = {name: i for i, name in enumerate(sheet_names(next(rows, [])))}
                places = [at.get(c, -1) for c in columns]
                out = []
                for r in rows:
                    out.append([(r[i] or None) if 0 <= i < len(r) else None for i in places])
                    if len(out) == BATCH_ROWS:
                        yield pd.DataFrame(out, columns=columns, dtype=object)
                        out = []
                yield pd.DataFrame(out, columns=columns, dtype=object)

    return read


def union_schema(files: DataFrame) -> StructType:
    """Columns of all workbooks in the order of their first appearance by path: headers are read by
    tasks, one row per distinct name comes back."""
    names = files.mapInPandas(_headers, "path string, pos long, name string").groupBy("name").agg(F.min(F.struct("path", "pos")).alias("first"))
    return workbook_schema([r["name"] for r in names.orderBy("first").collect()])


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Typed DataFrame of the first sheets of all workbooks under ``path``, columns by name; a
    workbook without a column gives NULLs there. No column at all gives an empty frame."""
    from bizlens.session import prepare_session
    from bizlens.sources.csv import NA_TOKENS, infer_types

    prepare_session(spark)
    files = workbook_files(spark, path)
    schema = union_schema(files)
    if not schema.names:
        return spark.createDataFrame([], schema)
    raw = files.mapInPandas(_reader(schema.names), schema)
    cleaned = raw.select(*[F.when(F.trim(col_ref(c)).isin(*NA_TOKENS), None).otherwise(col_ref(c)).alias(c) for c in raw.columns])
    typed = infer_types(cleaned)
    # date-formatted cells arrive as "yyyy-MM-dd HH:mm:ss": such columns become timestamps (one aggregate)
    text_cols = [f.name for f in typed.schema.fields if f.dataType.typeName() == "string"]
    if not text_cols:
        return typed
    stamp = "yyyy-MM-dd HH:mm:ss"
    row = typed.agg(*[F.count(col_ref(c)).alias(f"n{i}") for i, c in enumerate(text_cols)],
                    *[F.count(F.try_to_timestamp(col_ref(c), F.lit(stamp))).alias(f"t{i}") for i, c in enumerate(text_cols)]).first()
    dated = [c for i, c in enumerate(text_cols) if row[f"n{i}"] and row[f"n{i}"] == row[f"t{i}"]]
    return typed.withColumns({c: F.try_to_timestamp(col_ref(c), F.lit(stamp)) for c in dated}) if dated else typed
