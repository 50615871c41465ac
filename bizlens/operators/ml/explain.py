"""Cluster explanation: size, share and the features that set a cluster apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizlens.functions.expr import col_ref, to_number

TOP_FEATURES = 5

# Texts of the cluster descriptions and hints.
TEXT_PLAIN = "Кластер %s: группа из %d объектов (%.1f%%), без ярко выраженных отличий по числовым признакам."
TEXT_LEAD = "Кластер %s: группа из %d объектов (%.1f%%), похоже, отличается %s значениями по признаку %s."
WORD_HIGH = "высокими"
WORD_LOW = "низкими"
HINT_CHECK = "Проверьте этот сегмент на бизнес-смысл перед принятием решений."
HINT_REVENUE = "Если выручка выше среднего, сегмент можно рассматривать как приоритетный."
HINT_SMALL = "Небольшой и сильно отличающийся сегмент может быть нишевым или аномальным."
HINT_QUANTITY = "Проверьте причины низкой активности сегмента."


def explain_clusters(df: DataFrame, label_col: str, columns: list[str], noise_label=-1, top: int = TOP_FEATURES) -> DataFrame:
    """(cluster, size, share, rank, feature, diff): per non-noise cluster the
    ``top`` features with the largest |cluster mean - overall mean| of the raw
    values (overall = all rows, noise included). Shares count all rows."""
    lab = col_ref(label_col)
    entries = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("feature"), to_number(df, c).alias("v")) for i, c in enumerate(columns)]
    long = df.select(lab.alias("cluster"), F.explode(F.array(*entries)).alias("e")).select("cluster", "e.*")
    per = long.groupBy("cluster", "ordinal", "feature").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    overall = per.groupBy("ordinal", "feature").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("g"))
    sizes = df.groupBy(lab.alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size")).scalar()
    keep = F.col("cluster").isNotNull() & (F.col("cluster").cast("string") != F.lit(str(noise_label)))
    # one row per (cluster, feature): both sides are bounded by clusters x columns
    diffs = per.where(keep).join(F.broadcast(overall), ["ordinal", "feature"]).select(
        "cluster", "ordinal", "feature", (F.try_divide(F.col("s"), F.col("n")) - F.col("g")).alias("diff")
    )
    rank = Window.partitionBy("cluster").orderBy(F.abs("diff").desc_nulls_last(), "ordinal")
    ranked = diffs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)
    return sizes.where(keep).join(ranked, "cluster", "left").select(
        "cluster",
        "size",
        (F.col("size") / F.greatest(total, F.lit(1)) * 100.0).alias("share"),
        "rank",
        "feature",
        "diff",
    )


def cluster_hints(explained: DataFrame) -> DataFrame:
    """(cluster, line, text): a description sentence and the matching hints per cluster."""
    per = explained.groupBy("cluster", "size", "share").agg(
        F.min_by(F.struct("feature", "diff"), F.when(F.col("rank").isNotNull(), F.col("rank"))).alias("lead"),
        F.max(F.lower("feature").contains("revenue") | F.lower("feature").contains("выруч")).alias("has_revenue"),
        F.max((F.lower("feature").contains("quantity") | F.lower("feature").contains("колич")) & (F.col("diff") < 0)).alias("low_quantity"),
    )
    cid = F.col("cluster").cast("string")
    desc = F.when(
        F.col("lead.feature").isNull(), F.format_string(TEXT_PLAIN, cid, F.col("size"), F.col("share"))
    ).otherwise(
        F.format_string(TEXT_LEAD, cid, F.col("size"), F.col("share"),
                        F.when(F.col("lead.diff") > 0, F.lit(WORD_HIGH)).otherwise(F.lit(WORD_LOW)), F.col("lead.feature"))
    )
    lines = F.array(
        F.struct(F.lit(0).alias("line"), desc.alias("text")),
        F.struct(F.lit(1).alias("line"), F.lit(HINT_CHECK).alias("text")),
        F.struct(F.lit(2).alias("line"), F.when(F.coalesce("has_revenue", F.lit(False)), F.lit(HINT_REVENUE)).alias("text")),
        F.struct(F.lit(3).alias("line"), F.when(F.col("share") < 5, F.lit(HINT_SMALL)).alias("text")),
        F.struct(F.lit(4).alias("line"), F.when(F.coalesce("low_quantity", F.lit(False)), F.lit(HINT_QUANTITY)).alias("text")),
    )
    return per.select("cluster", F.explode(lines).alias("l")).select("cluster", "l.line", "l.text").where(F.col("text").isNotNull())
