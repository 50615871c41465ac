"""One case per wrong answer found in review."""

from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bizlens.operators import charts, forecast, modes
from bizlens.operators.common import first_by_hash, materialize
from bizlens.operators.comparison import compare_dimension
from bizlens.operators.marketplace import marketplace_kpis, pareto_core
from bizlens.operators.ml import cluster
from bizlens.operators.ml.iforest import isolation_forest
from bizlens.operators.prefix import running_total
from bizlens.operators.profile import corr_matrix
from bizlens.operators.roles import normalize_column, normalize_name
from bizlens.operators.timeseries import daily_sum
from bizlens.sources.csv import read_csv, sniff_delimiter
from bizlens.sources.ledger import payload_value
from bizlens.sources.workbook import read_workbooks
from test_sources import _write_xlsx


@pytest.mark.parametrize("partitions", [1, 4, 8, 64])
def test_correlation_with_a_constant_is_undefined(spark, partitions):
    df = spark.range(1000).select(F.lit(0.1).alias("c"), (F.col("id") * 0.37).alias("x"), (F.col("id") % 7 * 1.3).alias("y"))
    got = {(r["row_name"], r["col_name"]): r["corr"] for r in corr_matrix(df.repartition(partitions), ["c", "x", "y"]).collect()}
    assert got["c", "x"] is None and got["c", "c"] is None and got["x", "c"] is None
    assert got["x", "x"] == 1.0 and got["x", "y"] is not None


def test_pareto_core_does_not_round_rows(spark):
    rows = [("a", 0.004)] * 1000 + [("b", 0.0005)] * 500 + [("c", 0.0005)] * 500
    df = spark.createDataFrame(rows, "product string, revenue double")
    got = pareto_core(df, {"product": "product", "revenue": "revenue"}).collect()
    assert [r["product"] for r in got] == [] or all(r["revenue"] > 0 for r in got)
    big = spark.createDataFrame([("a", Decimal("700.005")), ("b", Decimal("100.000")), ("c", Decimal("199.995"))], "product string, revenue decimal(18,3)")
    core = {r["product"]: r["revenue"] for r in pareto_core(big, {"product": "product", "revenue": "revenue"}).collect()}
    assert core == {"a": 700.005}


def test_running_total_keeps_null_groups(spark):
    df = spark.range(1000).select(F.lit(None).cast("string").alias("g"), F.col("id"), F.lit(1).cast("long").alias("n"))
    out = running_total(df, ["id"], "n", partition_by=["g"], num_partitions=4)
    assert out.agg(F.max("running_total")).first()[0] == 1000


def test_identical_outliers_do_not_multiply(spark):
    rows = [(float(i % 10), float(i % 7)) for i in range(200)] + [(900.0, -900.0)] * 4
    df = spark.createDataFrame(rows, "x double, y double")
    got = isolation_forest(df)
    assert got.where("x = 900").count() == 4


def test_text_dates_in_the_daily_series(spark):
    df = spark.createDataFrame([("01/02/2024", 1.0), ("03/02/2024", 2.0), ("25/02/2024", 4.0)], "day string, v double")
    got = daily_sum(df, "day", F.col("v")).orderBy("ds").collect()
    assert str(got[0]["ds"]) == "2024-02-01" and len(got) == 25 and sum(r["y"] for r in got) == 7.0


def _csv(tmp_path, text):
    path = tmp_path / "t.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_booleans_quoted_newlines_and_long_integers(spark, tmp_path):
    df = read_csv(spark, _csv(tmp_path, 'id;revenue;returned;long;note\n1;40;True;1;"two\nlines; one"\n2;7;False;123456789012345678901234;x\n'))
    assert dict(df.dtypes) == {"id": "bigint", "revenue": "bigint", "returned": "boolean", "long": "string", "note": "string"}
    rows = df.orderBy("id").collect()
    assert rows[0]["note"] == "two\nlines; one" and rows[1]["long"] == "123456789012345678901234"
    kpis = marketplace_kpis(df, {"revenue": "revenue", "returns": "returned"}).first()
    assert kpis["returns_total"] == 40.0


def test_csv_missing_booleans_stay_text_and_backticks_in_names(spark, tmp_path):
    df = read_csv(spark, _csv(tmp_path, "a`b,flag\n1,true\n2,\n"))
    assert df.dtypes == [("a`b", "bigint"), ("flag", "string")]


def test_delimiter_from_several_lines():
    assert sniff_delimiter('"a,b,c";d', "1;2", "3;4") == ";"
    assert sniff_delimiter("a b, c;d", "1,2;3", "4,4;5,5") in (",", ";")
    assert sniff_delimiter() == "," and sniff_delimiter("one", "two") == ","


def test_workbook_columns_by_name(spark, tmp_path):
    _write_xlsx(str(tmp_path / "a.xlsx"), [["product", "revenue"], ["p", 10]])
    _write_xlsx(str(tmp_path / "b.xlsx"), [["revenue", "city", "product"], [20, "x", "q"]])
    df = read_workbooks(spark, str(tmp_path))
    assert df.columns == ["product", "revenue", "city"]
    assert sorted(map(tuple, df.collect()), key=str) == [("p", 10, None), ("q", 20, "x")]


def test_marketplace_without_revenue(spark):
    df = spark.createDataFrame([(5.0, 2.0), (-1.0, 3.0)], "returns double, commission double")
    res = modes.analyze(df, "marketplace")
    assert res.kpis.first().asDict() == {"returns_total": 6.0, "commissions": 5.0, "profit": 0.0}
    assert res.recommendations[0] == modes.MISSING_TEXT["marketplace"]


def test_forecast_prefers_the_seasonal_model(spark):
    rows = [(date(2024, 1, 1) + timedelta(days=i), 100.0 + 2 * i) for i in range(60)]
    res = modes.analyze(spark.createDataFrame(rows, "date date, revenue double"), "forecast")
    k = res.kpis.first()
    assert k["method"] == forecast.METHOD_SEASONAL
    assert k["forecast_7"] == pytest.approx(sum(100.0 + 2 * i for i in range(60, 67)), rel=1e-6)


def test_comparison_is_ordered_by_change(spark):
    schema = "category string, revenue double"
    a = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 2.0)], schema)
    b = spark.createDataFrame([("a", 4.0), ("b", 1.0), ("d", 9.0)], schema)
    assert [r["position"] for r in compare_dimension(a, b, "category").collect()] == ["d", "a", "c", "b"]


def test_chart_without_rows_left_is_an_error(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "k string, v double")
    with pytest.raises(ValueError, match="После подготовки"):
        charts.chart_data(df, charts.ChartSpec("bar", "k", ["v"]))


@pytest.mark.parametrize("spec, expected", [
    (("bar", None, []), ["no x", "no y"]),
    (("pie", "k", ["k"]), ["Для круговой диаграммы колонка значений должна быть числовой."]),
    (("heatmap", None, []), ["heatmap"]),
    (("radar", None, []), ["type"]),
])
def test_chart_messages(spark, spec, expected):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    assert charts.validate(df, charts.ChartSpec(*spec)) == [charts.MESSAGES.get(e, e) for e in expected]


def test_map_notes_follow_the_flags(spark):
    points = spark.createDataFrame([(0.1 * i, 0.1) for i in range(10)], "x double, y double")
    notes = cluster.map_notes(cluster.map_diagnostics(points, "x", "y"), grouped=True)
    assert [r["text"] for r in notes.orderBy("line").collect()] == [cluster.MAP_LINES[k] for k in ("compact", "grouped", "caution")]
    few = cluster.map_notes(cluster.map_diagnostics(points.limit(2), "x", "y"), grouped=False)
    assert [r["text"] for r in few.collect()] == [cluster.MAP_LINES["few"]]


def test_ledger_payload_values():
    frame = pd.DataFrame({"a": [1.5, float("nan")]})
    got = payload_value({1: frame, "t": (date(2024, 1, 2), True, None, float("inf")), "s": "x"})
    assert got == {"1": [{"a": 1.5}, {"a": None}], "t": ["2024-01-02", True, None, None], "s": "x"}


def test_name_normalisation_is_the_same_in_python_and_spark(spark):
    names = ["  Unit Price (₽)", "__a--b__", "Дата заказа", "ёж", "", "№1"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", normalize_column(F.col("n")).alias("s"))
    assert all(normalize_name(r["n"]) == r["s"] for r in df.collect())


def test_correlation_over_gaps_and_partitions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1e4, 3.0, (500, 4))
    x[:, 3] += x[:, 0]
    x[rng.random(x.shape) < 0.2] = np.nan
    frame = pd.DataFrame(x, columns=list("abcd"))
    want = frame.corr()
    df = spark.createDataFrame(frame).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in "abcd"])
    for n in (1, 7, 64):
        got = corr_matrix(df.repartition(n), list("abcd")).collect()
        assert len(got) == 16
        for r in got:
            assert r["corr"] == pytest.approx(want.loc[r["row_name"], r["col_name"]], abs=1e-9)


def test_correlation_with_an_infinite_value_is_undefined_for_its_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 3.0), (float("inf"), 5.0, None), (3.0, 7.0, 2.0)], "a double, b double, c double")
    got = {(r["row_name"], r["col_name"]): r["corr"] for r in corr_matrix(df.coalesce(1), ["a", "b", "c"]).collect()}
    assert got["a", "b"] is None and got["a", "c"] == pytest.approx(0.5) and got["b", "c"] is not None


@pytest.mark.parametrize("distinct", [3, 20_000])
def test_first_by_hash_equals_the_plain_top_k(spark, distinct):
    df = spark.range(20_000).select("id", F.xxhash64(F.col("id") % distinct).alias("h"))
    want = [r["id"] for r in df.orderBy("h", "id").limit(50).collect()]
    assert [r["id"] for r in first_by_hash(df, F.col("h"), [F.col("id")], 50, 20_000).collect()] == want


@pytest.mark.parametrize("ranges", [1, 4, 8, 64])
def test_running_total_with_signs(spark, ranges):
    rng = np.random.default_rng(ranges)
    v = np.r_[np.full(300, 3), np.full(400, -2), rng.integers(-9, 9, 300)]
    df = spark.createDataFrame([(i, int(x) if i % 50 else None, "g" if i % 3 else None) for i, x in enumerate(v)], "k int, v int, g string")
    want = np.cumsum([0 if i % 50 == 0 else x for i, x in enumerate(v)])
    got = running_total(df, ["k"], "v", num_partitions=ranges).orderBy("k").toPandas()["running_total"].to_numpy()
    assert (got == want).all()
    per = running_total(df, ["k"], "v", partition_by=["g"], num_partitions=ranges).toPandas()
    for g, rows in per.sort_values("k").groupby("g", dropna=False):
        assert (rows["running_total"].to_numpy() == rows["v"].fillna(0).cumsum().to_numpy()).all()


def test_pareto_core_with_negative_products(spark):
    names = [(f"p{i:04d}", float(i % 97 + 1) if i % 2 else -float(i % 89 + 1)) for i in range(1200)]
    df = spark.createDataFrame(names, "product string, revenue double")
    rows = sorted(names, key=lambda r: (-r[1], r[0]))
    whole = sum(r[1] for r in rows)
    assert whole != 0
    roles = {"product": "product", "revenue": "revenue"}
    one = pareto_core(df.coalesce(1), roles)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = pareto_core(df.repartition(8), roles)
        assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
        running = np.cumsum([r[1] for r in rows]) / whole
        assert many.count() == int((running <= 0.8).sum())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_csv_folder_by_column_name(spark, tmp_path):
    (tmp_path / "a b{1}.csv").write_text('id,price,note\n1,10.5,x\n2,20,"two\nlines"\n')
    (tmp_path / "b.csv").write_text("price;id\n99.5;3\n1;4\n")
    (tmp_path / "c.csv").write_text("id,price,note\n5,7,plain\n")
    got = {r["id"]: (r["price"], r["note"]) for r in read_csv(spark, str(tmp_path)).collect()}
    assert got == {1: (10.5, "x"), 2: (20.0, "two\nlines"), 3: (99.5, None), 4: (1.0, None), 5: (7.0, "plain")}


def test_correlation_of_many_columns_stores_few_rows(spark, monkeypatch):
    from bizlens.operators import profile

    rng = np.random.default_rng(2)
    x = rng.normal(1e6, 1, (300, 60)) + rng.normal(0, 1, (300, 1))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[:290, 9] = 4.0, np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(60)])
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns)).repartition(40)
    stored = []
    monkeypatch.setattr(profile, "materialize", lambda d: stored.append(materialize(d)) or stored[-1])
    got = profile.corr_matrix(df, list(pdf.columns)).toPandas().pivot(index="i", columns="j", values="corr").to_numpy(dtype=float)
    want = pdf.corr(min_periods=2).to_numpy()
    assert stored[-1].count() <= profile.MERGERS * 60 * 61 / 2
    assert np.isnan(got[7]).all() and (np.isnan(got) == np.isnan(want)).all() and np.nanmax(np.abs(got - want)) < 1e-6
