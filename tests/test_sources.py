import os
import random
import tempfile
import zipfile

import pytest

from bizlens.sources import csv as csv_source
from bizlens.sources import ledger
from bizlens.sources.csv import header_names, read_csv, sniff_delimiter
from bizlens.sources.workbook import read_workbooks


def test_header_rules():
    assert header_names("a;a;;b", ";") == ["a", "a.1", "Unnamed: 2", "b"]
    assert sniff_delimiter("x;y;z") == ";" and sniff_delimiter("x\ty") == "\t" and sniff_delimiter("x|y|z") == "|"


def test_read_csv_na_tokens_and_types(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("date;amount;a;a;name\n31/12/2024;10;1;NA;x\n01/01/2025;N/A;2;3;\n02/01/2025;12.5;3;4;z\n03/01/2025;7;4;5;w\n")
    df = read_csv(spark, path)
    assert df.columns == ["date", "amount", "a", "a.1", "name"]
    types = dict(df.dtypes)
    assert types["amount"] == "double" and types["a"] == "bigint" and types["date"].startswith("timestamp")
    rows = df.orderBy("a").collect()
    assert rows[1]["amount"] is None and rows[0]["a.1"] is None and rows[1]["name"] is None


def _write_xlsx(path, rows):
    shared = sorted({c for r in rows for c in r if isinstance(c, str)})
    idx = {s: i for i, s in enumerate(shared)}
    cells = []
    for ri, r in enumerate(rows, start=1):
        cs = []
        for ci, v in enumerate(r):
            ref = chr(65 + ci) + str(ri)
            if isinstance(v, str):
                cs.append(f'<c r="{ref}" t="s"><v>{idx[v]}</v></c>')
            else:
                cs.append(f'<c r="{ref}"><v>{v}</v></c>')
        cells.append(f'<row r="{ri}">{"".join(cs)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}>' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(cells)}</sheetData></worksheet>')


def test_workbooks_one_task_per_file(spark, tmp_dir):
    for i in range(3):
        _write_xlsx(os.path.join(tmp_dir, f"w{i}.xlsx"), [["product", "revenue"], [f"p{i}", 10 * i], ["q", 1.5]])
    df = read_workbooks(spark, tmp_dir)
    assert df.rdd.getNumPartitions() == 3
    assert dict(df.dtypes)["revenue"] == "double"
    assert sorted(r["product"] for r in df.collect()) == ["p0", "p1", "p2", "q", "q", "q"]


def test_ledger_append_evolve_latest(spark, tmp_dir):
    path = os.path.join(tmp_dir, "ledger")
    ledger.append_runs(spark, path, [{"run_id": i, "user_id": 1, "file_name": f"f{i}", "payload": {"kpis": {"rows": i}}} for i in range(7)])
    ledger.append_runs(spark, path, [{"run_id": 10, "user_id": 1, "file_name": "g", "payload": {}, "media_type": "png"}])
    runs = ledger.read_ledger(spark, path)
    assert "media_type" in runs.columns and runs.count() == 8
    recent = ledger.recent_runs(spark, path, 1, 5).orderBy("recent_rank").collect()
    assert [r["file_name"] for r in recent] == ["g", "f6", "f5", "f4", "f3"]
    assert recent[0]["summary"] == "без KPI" and recent[1]["summary"] == "rows: 6"


def test_stream_ingest(spark, tmp_dir):
    from bizlens.streaming.ingest import start_ingest

    src = os.path.join(tmp_dir, "in")
    for i in range(2):
        spark.createDataFrame([(j, None if j == i else float(j)) for j in range(5)], "k long, v double").coalesce(1).write.parquet(os.path.join(src, f"f{i}"))
    os.makedirs(os.path.join(src, "flat"), exist_ok=True)
    schema = spark.read.parquet(os.path.join(src, "f0")).schema
    out = os.path.join(tmp_dir, "ledger")
    for i in range(2):
        for name in os.listdir(os.path.join(src, f"f{i}")):
            if name.endswith(".parquet"):
                os.rename(os.path.join(src, f"f{i}", name), os.path.join(src, "flat", f"part{i}.parquet"))
    q = start_ingest(spark, os.path.join(src, "flat"), schema, out, os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(120)
    runs = spark.read.parquet(out).collect()
    assert len(runs) == 2 and all('"missing_total":1' in r["payload"] for r in runs)


def test_file_ingest_types_each_file(spark, tmp_dir):
    import json

    from bizlens.streaming.files import start_file_ingest

    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)

    def put(name, text):
        with open(os.path.join(src, name), "w", encoding="utf-8", newline="") as f:
            f.write(text)

    put("a [1].csv", 'date;amount;note\r\n01/02/2024;1,5;"x\ny"\r\n02/02/2024;2;NA\r\n03/02/2024;;z\r\n03/02/2024;;z\r\n')
    put("b.csv", "id,flag,price\n1,true,2.5\n2,false,3\n")
    put("broken.csv", "a,b\n1,2\n1,2,3\n")
    put("empty.csv", "\n\n")
    put("huge.csv", "a\n" + "1\n" * 5000)
    put("notes.txt", "hello")
    _write_xlsx(os.path.join(src, "w.xlsx"), [["product", "revenue"], ["p", 10], ["q", 1.5]])
    with open(os.path.join(src, "bad.xlsx"), "wb") as f:
        f.write(b"no zip")
    paths = [os.path.join(tmp_dir, x) for x in ("ledger", "rejected", "ckpt")]

    def run():
        start_file_ingest(spark, src, *paths, cap=5000).awaitTermination(200)
        runs = {os.path.basename(r["file_name"]): json.loads(r["payload"]) for r in spark.read.parquet(paths[0]).collect()}
        refused = [os.path.basename(r["file"]) for r in spark.read.parquet(paths[1]).collect()]
        return runs, sorted(refused), spark.read.parquet(paths[0]).count()

    runs, refused, n = run()
    assert n == 3 and refused == ["bad.xlsx", "broken.csv", "empty.csv", "huge.csv", "notes.txt"]
    a = runs["a [1].csv"]
    assert a["kpis"] == {"rows": 4, "columns": 3, "missing_total": 3, "duplicates": 1}
    assert (a["numeric_columns"], a["date_columns"], a["categorical_columns"]) == ([], ["date"], ["amount", "note"])
    assert runs["b.csv"]["numeric_columns"] == ["id", "flag", "price"] and runs["w.xlsx"]["numeric_columns"] == ["revenue"]
    put("late.csv", "k\tv\n1\tx\n")
    runs, refused, n = run()  # a restart takes only what is new
    assert n == 4 and len(refused) == 5 and runs["late.csv"]["categorical_columns"] == ["v"]


def test_workbooks_of_several_batches_and_loose_cells(spark, tmp_dir, monkeypatch):
    from bizlens.sources import workbook

    _write_xlsx(os.path.join(tmp_dir, "long [x].xlsx"), [["k"], *[[i] for i in range(12_001)]])
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(os.path.join(tmp_dir, "z.xlsx"), "w") as z:  # cells without places
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="inlineStr"><is><t>k</t></is></c><c t="inlineStr"><is><t>x</t></is></c></row>'
                   '<row><c><v>-1</v></c><c t="b"><v>1</v></c></row><row/></sheetData></worksheet>')
    got = read_workbooks(spark, tmp_dir)
    assert got.columns == ["k", "x"] and dict(got.dtypes)["k"] == "bigint"
    assert got.agg({"k": "sum"}).first()[0] == sum(range(12_001)) - 1 and got.count() == 12_003
    os.makedirs(os.path.join(tmp_dir, "none"))
    _write_xlsx(os.path.join(tmp_dir, "none", "e.xlsx"), [])
    assert read_workbooks(spark, os.path.join(tmp_dir, "none")).count() == 0
    assert next(workbook.sheet_rows(open(os.path.join(tmp_dir, "z.xlsx"), "rb").read())) == ["k", "x"]


def test_workbook_date_cells(spark, tmp_dir):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path = os.path.join(tmp_dir, "d.xlsx")
    sheet = (f'<worksheet {ns}><sheetData>'
             '<row r="1"><c r="A1" t="inlineStr"><is><t>when</t></is></c><c r="B1" t="inlineStr"><is><t>qty</t></is></c></row>'
             '<row r="2"><c r="A2" s="1"><v>45292</v></c><c r="B2"><v>3</v></c></row>'
             '<row r="3"><c r="A3" s="1"><v>45293.5</v></c><c r="B3"><v>4</v></c></row>'
             '</sheetData></worksheet>')
    styles = f'<styleSheet {ns}><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    df = read_workbooks(spark, path)
    types = dict(df.dtypes)
    assert types["when"].startswith("timestamp") and types["qty"] == "bigint"
    got = sorted(str(r["when"]) for r in df.collect())
    assert got == ["2024-01-01 00:00:00", "2024-01-02 12:00:00"]


def _random_csv(rng, rows, newline):
    fields = ["x", "", "12", "a b", '"q,r"', '"two\nlines"', '"say ""hi"" \n\n, now"', '5" pipe', '"', '""', '"a""\n"', "tail\"", '"' + "long\n" * 30 + '"']
    weights = [12, 3, 6, 6, 3, 3, 2, 1, 0, 2, 1, 1, 1]
    lines = [",".join(rng.choices(fields, weights, k=3)) for _ in range(rows)]
    return "k,v,w" + newline + newline.join(lines) + newline


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_quoted_records_of_many_splits_equal_the_whole_file_reader(spark, tmp_dir, newline):
    rng = random.Random(7)
    for i in range(3):
        with open(os.path.join(tmp_dir, f"f {i}.csv"), "w", encoding="utf-8", newline="") as f:
            f.write(_random_csv(rng, 160, newline))
    names = ["k", "v", "w"]
    want = spark.read.csv(tmp_dir, schema="k string, v string, w string", header=True, quote='"', escape='"', multiLine=True)
    split = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "0"}
    files = [os.path.join(tmp_dir, f"f {i}.csv") for i in range(3)]
    before = {k: spark.conf.get(k) for k in split}
    for k, v in split.items():
        spark.conf.set(k, v)
    try:
        got_rows = csv_source._parsed(csv_source.quoted_records(spark, files, ","), names, ",")
        tasks = spark.read.text(files, lineSep="\n").rdd.getNumPartitions()
        got = [tuple(r) for r in got_rows.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    key = lambda r: tuple((x is None, x or "") for x in r)
    assert tasks > 60 and sorted(got, key=key) == sorted((tuple(r) for r in want.collect()), key=key)


def test_quoted_records_edges(spark, tmp_dir):
    def read(text):
        path = os.path.join(tempfile.mkdtemp(dir=tmp_dir), "a.csv")
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        return [tuple(r) for r in csv_source._parsed(csv_source.quoted_records(spark, [path], ","), ["a", "b"], ",").collect()]

    assert read("a,b\n") == []
    assert read("a,b") == []
    assert read('a,b\n\n  \n1,"x\ny"') == [("1", "x\ny")]
    assert read('"a\nb",c\n1,2\n') == [("1", "2")]  # a header over two lines is one record
    assert [r[0] for r in read('a,b\n1,2\n3,"never closed\n4,5\n')] == ["1", "3"]
