import numpy as np
import pandas as pd
import pytest

from bizlens.operators.prefix import exact_quantiles, running_total


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({
        "g": rng.choice(["hot", "b", "c"], 3000, p=[0.8, 0.15, 0.05]),
        "v": rng.integers(0, 50, 3000).astype(float),
        "k": np.arange(3000),
    })
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("parts", [1, 8])
def test_running_total_global(frame, parts):
    pdf, df = frame
    got = running_total(df, ["k"], "v", out="c", num_partitions=parts).toPandas().sort_values("k")
    assert np.allclose(got["c"], pdf.sort_values("k")["v"].cumsum())


def test_running_total_grouped(frame):
    pdf, df = frame
    got = running_total(df, ["k"], "v", out="c", partition_by=["g"], num_partitions=5).toPandas().sort_values(["g", "k"])
    want = pdf.sort_values(["g", "k"]).groupby("g")["v"].cumsum()
    assert np.allclose(got["c"].to_numpy(), want.to_numpy())


def test_quantiles_match_pandas(frame):
    pdf, df = frame
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    row = exact_quantiles(df, "v", probs).first()
    assert np.allclose(list(row), pdf["v"].quantile(probs).to_list())
    grouped = exact_quantiles(df, "v", [0.25, 0.75], group_by=["g"]).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["v"].quantile([0.25, 0.75]).unstack().sort_index()
    assert np.allclose(grouped.to_numpy(), want.to_numpy())


def test_quantile_edges(spark):
    one = spark.createDataFrame([(5.0,)], "v double")
    assert exact_quantiles(one, "v", [0.5]).first()[0] == 5.0
    empty = spark.createDataFrame([], "v double")
    assert exact_quantiles(empty, "v", [0.5]).first()[0] is None
    nulls = spark.createDataFrame([(None,), (1.0,), (3.0,)], "v double")
    assert exact_quantiles(nulls, "v", [0.5]).first()[0] == 2.0
