import numpy as np
import pytest
from pyspark.sql import functions as F

from bizlens.operators import quantiles
from bizlens.operators.profile import profile_describe

PROBS = [0.0, 0.0001, 0.25, 0.5, 0.75, 0.9, 0.9999, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    n = 6000
    cols = {
        "even": rng.normal(0, 1, n), "skewed": rng.pareto(1.1, n) * 1e6, "ties": rng.integers(0, 4, n).astype(float),
        "hot": np.where(rng.random(n) < 0.4, 7.5, rng.normal(0, 100, n)), "signs": rng.normal(-5, 1e-9, n), "one": np.full(n, 3.25),
    }
    rows = [tuple(None if (i + k) % 11 == 0 else float("nan") if (i + k) % 13 == 0 else float(v) for k, v in enumerate(r)) for i, r in enumerate(zip(*cols.values()))]
    df = spark.createDataFrame([(*r, None) for r in rows], ", ".join(f"{c} double" for c in [*cols, "empty"]))
    kept = {c: np.array([r[k] for r in rows if r[k] is not None and r[k] == r[k]]) for k, c in enumerate(cols)}
    return df.repartition(5), kept


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_exact_at_any_accuracy(table, accuracy):
    df, kept = table
    got, also = quantiles.column_quantiles(df, {c: F.col(c) for c in df.columns}, PROBS, accuracy=accuracy, also={"n": F.count("even")})
    assert also["n"] >= len(kept["even"]) and got.pop("empty") == [None] * len(PROBS)
    for c, v in kept.items():
        assert got[c] == pytest.approx(np.quantile(v, PROBS).tolist(), rel=1e-12, abs=1e-300)


def test_wrong_brackets_are_noticed(table, monkeypatch):
    """A sketch that answers wrongly costs a pass over the range, never the result."""
    df, kept = table
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda v, listed, accuracy: F.transform(listed, lambda q: q * 0 + F.max(v)))
    got, _ = quantiles.column_quantiles(df, {"even": F.col("even")}, [0.3, 0.5])
    assert got["even"] == pytest.approx(np.quantile(kept["even"], [0.3, 0.5]).tolist(), rel=1e-12)


@pytest.mark.parametrize("accuracy", [20, 500])
def test_rank_error_of_the_sketch(table, accuracy):
    df, kept = table
    got, _ = quantiles.column_quantiles(df, {c: F.col(c) for c in kept}, PROBS, approx=True, accuracy=accuracy)
    for c, v in kept.items():
        v = np.sort(v)
        for p, q in zip(PROBS, got[c]):
            below, upto = np.searchsorted(v, q, "left"), np.searchsorted(v, q, "right")
            assert upto > below  # a value of the column
            assert below - len(v) / accuracy - 1 <= p * len(v) <= upto + len(v) / accuracy + 1


def test_describe(spark, table):
    df, kept = table
    for approx in (False, True):
        got = {r["column_name"]: r for r in profile_describe(df, digits=12, approx=approx).collect()}
        assert got["empty"]["count"] == 0 if "empty" in got else True
        for c, v in kept.items():
            r = got[c]
            assert r["count"] == len(v) and r["mean"] == pytest.approx(v.mean()) and r["std"] == pytest.approx(v.std(ddof=1), rel=1e-6, abs=1e-9)
            assert (r["min"], r["max"]) == pytest.approx((v.min(), v.max()))
            if not approx:
                assert [r["q25"], r["q50"], r["q75"]] == pytest.approx(np.quantile(v, [0.25, 0.5, 0.75]).tolist())
    assert profile_describe(spark.createDataFrame([("x",)], "a string")).count() == 0
    assert profile_describe(df.limit(0)).count() == 0
