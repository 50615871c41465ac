import pandas as pd
from pyspark.sql import functions as F

from bizlens.functions.expr import money_text, pct_change, percent_text, to_number


def test_to_number_like_pandas(spark):
    texts = [" 12.5 ", "1 000", "1,5", "1d", "1e3", "True", "", None, "-.5", "+7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(to_number(df, "t")).collect()]
    want = pd.to_numeric(pd.Series(texts, dtype=object), errors="coerce").tolist()
    for g, w in zip(got, want):
        assert (g is None and pd.isna(w)) or g == w


def test_to_number_types(spark):
    df = spark.createDataFrame([(True, 3, 2.5)], "b boolean, i int, d double")
    assert df.select(to_number(df, "b"), to_number(df, "i"), to_number(df, "d")).first() == (1.0, 3.0, 2.5)


def test_texts(spark):
    df = spark.createDataFrame([(1234.5, 12.34), (None, None), (-1234567.891, -5.0)], "m double, p double")
    rows = df.select(money_text(F.col("m")), percent_text(F.col("p"))).collect()
    assert rows[0] == ("1 234.50", "12.3%")
    assert rows[1] == ("-", "-")
    assert rows[2][0] == "-1 234 567.89"


def test_pct_change(spark):
    df = spark.createDataFrame([(110.0, 100.0), (5.0, 0.0)], "c double, p double")
    got = [r[0] for r in df.select(pct_change(F.col("c"), F.col("p"))).collect()]
    assert abs(got[0] - 10.0) < 1e-9 and got[1] is None
