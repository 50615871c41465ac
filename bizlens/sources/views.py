"""Canonical business views derived from the driver's TPC-H-like tables.

Each view is a lazy DataFrame over whole base tables; joins are left to
Catalyst and AQE (no broadcast hints on tables that grow with the scale
factor). The same definitions exist as SQL in ``bizlens.plans.oracle`` so the
DuckDB oracle runs on identical inputs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# the date separating the two comparison reports (fixed value of the fixture)
SPLIT_DATE = "1998-04-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with the business columns a sales export has."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_tax", "l_returnflag"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_retailprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    revenue = F.col("l_extendedprice").cast("decimal(18,2)")
    return (
        li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.to_date("o_orderdate").alias("order_date"),
            F.col("o_orderkey").alias("order_id"),
            F.col("c_name").alias("customer"),
            F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("product"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            revenue.alias("revenue"),
            F.col("l_quantity").alias("quantity"),
            F.col("p_retailprice").alias("price"),
            (revenue * F.col("l_tax").cast("decimal(4,2)")).alias("commission"),
            (F.col("l_returnflag") == F.lit("R")).alias("returns"),
        )
    )


def sales_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir)
    return s.where((F.col("order_date") < F.lit(SPLIT_DATE).cast("date")) & (F.col("category") != "PROMO"))


def sales_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir)
    return s.where((F.col("order_date") >= F.lit(SPLIT_DATE).cast("date")) & (F.col("category") != "ECONOMY"))


def sales_promo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of a company that lives by one bundle: promo articles count as one product of a hundredfold price."""
    promo = F.col("category") == "PROMO"
    return sales(spark, sf_dir).withColumns({
        "product": F.when(promo, F.lit("PROMO")).otherwise(F.col("product")),
        "revenue": F.when(promo, F.col("revenue") * 100).otherwise(F.col("revenue")),
    })


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with a stock level (part size stands in) and units sold."""
    part = table(spark, sf_dir, "part")
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty"))
    return part.join(sold, part.p_partkey == sold.l_partkey, "left").select(
        F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("product"),
        F.col("p_size").cast("double").alias("stock"),
        F.coalesce(F.col("qty"), F.lit(0.0)).alias("quantity"),
    )


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a messy export: a missing category (error events), missing
    revenue (values below 5; money as DECIMAL(18,2)), and natural duplicate
    rows from the day grain."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.to_date("ts").alias("day"),
        F.col("user_id"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("category"),
        F.when(F.col("value") >= 5, F.col("value").cast("decimal(18,2)")).alias("revenue"),
    )


def numeric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a numeric table: a near-duplicate column, a constant one,
    one with missing values and a low-cardinality segment."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
        (F.col("l_extendedprice") * 1.1 + F.col("l_quantity")).alias("gross"),
        F.col("l_discount").alias("discount"),
        F.lit(1).alias("constant_col"),
        F.when(F.col("l_discount") > 0.01, F.col("l_tax")).alias("tax"),
        F.col("l_returnflag").alias("segment"),
    )


def orders_text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the order date rendered as day-first text, as spreadsheets export it."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_date"),
        F.col("o_totalprice").alias("amount"),
    )
