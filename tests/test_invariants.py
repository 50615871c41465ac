"""Determinism and partition-count independence (the R-class invariants)."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from bizlens.operators.ml import iforest
from bizlens.operators.ml.prep import bounded_sample, with_row_key
from bizlens.operators.prefix import exact_quantiles, running_total
from bizlens.operators.marketplace import pareto_core
from bizlens.operators.roles import detect_roles


def _frame(spark, n=2000):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], n), "x": rng.normal(size=n), "y": rng.normal(size=n), "z": rng.normal(size=n)})
    return spark.createDataFrame(pdf)


def test_sample_independent_of_partitioning(spark):
    df = with_row_key(_frame(spark))
    a = bounded_sample(df.repartition(1), 500).select("sample_id", "x").toPandas().sort_values("sample_id")
    b = bounded_sample(df.repartition(8), 500).select("sample_id", "x").toPandas().sort_values("sample_id")
    assert a["x"].tolist() == b["x"].tolist()


def test_forest_same_seed_same_output(spark):
    df = _frame(spark, 600)
    one = iforest.isolation_forest(df.repartition(1), top=10).select("x", "score").toPandas().sort_values("x")
    two = iforest.isolation_forest(df.repartition(5), top=10).select("x", "score").toPandas().sort_values("x")
    assert np.allclose(one["score"], two["score"]) and one["x"].tolist() == two["x"].tolist()


def test_grouped_quantiles_independent_of_partitions(spark):
    df = _frame(spark)
    got = [exact_quantiles(df, "x", [0.1, 0.5, 0.9], group_by=["g"], num_partitions=n).orderBy("g").toPandas() for n in (1, 3, 8)]
    for g in got[1:]:
        assert np.allclose(g[["q0", "q1", "q2"]].to_numpy(), got[0][["q0", "q1", "q2"]].to_numpy())


def test_running_total_hot_group_split(spark):
    # one group holds 90% of the rows; with 8 range partitions it must span several slices
    pdf = pd.DataFrame({"g": ["hot"] * 900 + ["cold"] * 100, "k": range(1000), "v": 1})
    df = spark.createDataFrame(pdf)
    out = running_total(df, ["k"], "v", out="c", partition_by=["g"], num_partitions=8).toPandas()
    hot = out[out.g == "hot"].sort_values("k")["c"].tolist()
    assert hot == list(range(1, 901))


def test_pareto_independent_of_shuffle_partitions(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"product": [f"p{i}" for i in range(300)], "revenue": rng.integers(1, 1000, 300).astype(float)})
    df = spark.createDataFrame(pdf)
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        res = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            res.append(sorted(r[0] for r in pareto_core(df, detect_roles(df)).collect()))
        assert res[0] == res[1]
        srt = pdf.sort_values(["revenue", "product"], ascending=[False, True])
        want = srt[srt["revenue"].cumsum() / srt["revenue"].sum() <= 0.8]["product"].tolist()
        assert res[0] == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
