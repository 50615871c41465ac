from datetime import date

import pytest
from pyspark.sql import functions as F

from bizlens.operators import comparison, customers, inventory, marketplace, rules, sales
from bizlens.operators.charts import ChartSpec, aggregate
from bizlens.operators.roles import detect_roles


def test_null_keys_and_empty_sums(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), (None, 2.0)], "k string, v double")
    got = {r["k"]: r["v"] for r in aggregate(df, "k", ["v"], "sum").collect()}
    assert got == {"a": 0.0, "b": 1.0}
    mean = {r["k"]: r["v"] for r in aggregate(df, "k", ["v"], "mean").collect()}
    assert mean == {"b": 1.0}  # all-missing group dropped for mean


@pytest.fixture()
def shop(spark):
    rows = [
        (date(2024, 1, d), f"o{d}", "c1" if d % 2 else "c2", "p1" if d < 4 else "p2", "A", 100.0 * d, 1.0, 5.0, d % 3 == 0)
        for d in range(1, 9)
    ]
    return spark.createDataFrame(rows, "date date, order_id string, customer string, product string, category string, "
                                       "revenue double, quantity double, commission double, returns boolean")


def test_sales_kpis(shop):
    roles = detect_roles(shop)
    k = sales.sales_kpis(shop, roles).first()
    assert k["total_revenue"] == 3600.0 and k["orders"] == 8 and k["average_check"] == 450.0 and k["median_check"] == 450.0
    top = sales.top_products(shop, roles).collect()
    assert [r["product"] for r in top] == ["p2", "p1"]


def test_marketplace(shop):
    roles = detect_roles(shop)
    k = marketplace.marketplace_kpis(shop, roles).first()
    assert k["returns_total"] == 300.0 + 600.0 and k["commissions"] == 40.0
    assert k["profit"] == 3600.0 - 40.0 - 900.0


def test_pareto_empty_when_first_product_dominates(spark):
    df = spark.createDataFrame([("p1", 900.0), ("p2", 50.0), ("p3", 50.0)], "product string, revenue double")
    assert marketplace.pareto_core(df, detect_roles(df)).count() == 0
    df2 = spark.createDataFrame([("p1", 50.0), ("p2", 30.0), ("p3", 20.0)], "product string, revenue double")
    assert sorted(r[0] for r in marketplace.pareto_core(df2, detect_roles(df2)).collect()) == ["p1", "p2"]


def test_customers(shop):
    roles = detect_roles(shop)
    k = customers.customer_kpis(shop, roles).first()
    assert k["customers"] == 2 and k["repeat_customers"] == 2 and k["average_check"] == 450.0
    assert customers.high_ltv(shop, roles).count() == 1


def test_inventory(spark):
    df = spark.createDataFrame([(f"p{i}", float(i), float(10 - i)) for i in range(10)], "product string, stock double, quantity double")
    roles = detect_roles(df)
    low = inventory.low_stock(df, roles).collect()
    assert [r["product"] for r in low] == ["p0", "p1"]  # <= max(0.25 * 4.5, 1)
    assert inventory.best_sellers(df, roles).first()["product"] == "p0"


def test_comparison_zero_base(spark):
    a = spark.createDataFrame([("x", 0.0)], "product string, revenue double")
    b = spark.createDataFrame([("x", 10.0), ("y", 5.0)], "product string, revenue double")
    k = comparison.compare_kpis(a, b).first()
    assert k["revenue_change_pct"] is None and k["orders_change_pct"] == 100.0
    lines = [r["text"] for r in comparison.compare_summary(comparison.compare_kpis(a, b)).orderBy("line").collect()]
    assert lines[0].startswith("Нельзя корректно") and "вырос на 100.0%" in lines[1]
    dim = {r["position"]: r for r in comparison.compare_dimension(a, b, "product").collect()}
    assert dim["y"]["report_1"] == 0.0 and dim["y"]["change_pct"] is None


def test_trend_rule_needs_four_days(spark):
    three = spark.createDataFrame([(date(2024, 1, d), 1.0) for d in (1, 2, 3)], "date date, revenue double")
    assert rules.rule_sales_trend(three, detect_roles(three)).count() == 0
    grow = spark.createDataFrame([(date(2024, 1, d), float(d)) for d in (1, 2, 3, 4)], "date date, revenue double")
    assert rules.rule_sales_trend(grow, detect_roles(grow)).first()["rule"] == "sales_trend"
    text = rules.business_insights(grow, detect_roles(grow)).collect()
    assert any("положительная" in r["text"] for r in text)


def test_default_insight(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    out = rules.business_insights(df, {}).collect()
    assert len(out) == 1 and out[0]["rule"] == "default"


def test_profile_constant_and_single_row(spark):
    from bizlens.operators import profile

    df = spark.createDataFrame([(1.0, 2.0, "x")] * 5, "a double, b double, c string")
    sk = profile.skew_flags(df).collect()
    assert all(r["direction"] is None for r in sk)
    d = profile.profile_describe(df).collect()
    assert {r["column_name"] for r in d} == {"a", "b"} and all(r["std"] == 0.0 for r in d)
    assert all(r["corr"] is None for r in profile.corr_matrix(df).collect())
    one = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert profile.profile_describe(one).first()["std"] is None
    assert profile.insights_all(one).count() == 1


def test_rules_read_the_table_once(spark, tmp_path):
    rows = [("a", "p", f"2024-01-0{d}", 10.0 * d) for d in range(1, 7)] + [(None, "q", None, 1.0), ("b", None, "2024-01-09", None)]
    spark.createDataFrame(rows, "category string, product string, date string, revenue double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = rules.business_insights(df, detect_roles(df))
    assert out.inputFiles() == []
    single = [rules.rule_missing_share(df), *[f(df, detect_roles(df)) for f in (rules.rule_category_dependency, rules.rule_product_dependency, rules.rule_sales_trend)]]
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r) for part in single for r in part.collect())
