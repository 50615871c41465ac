"""Business insight rules. Every rule is a DataFrame of 0 or 1 rows
``(rank, rule, text)`` computed from one aggregate over the table, so the
assembled insight list is a single lazy plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.expr import col_ref
from bizlens.operators.common import amount, materialize
from bizlens.operators.timeseries import daily_sum, day_of, gap_fill_daily, series_stats

# Texts of the business rules.
TEXT_MISSING_HIGH = "Обнаружено значительное количество пропущенных данных. Перед принятием решений стоит проверить качество выгрузки."
TEXT_MISSING_SOME = "В данных есть пропуски. Они не выглядят критичными, но могут влиять на точность расчетов."
TEXT_CATEGORY_REVENUE = "Компания сильно зависит от одной категории товаров. Это повышает риск просадки при изменении спроса."
TEXT_CATEGORY_ROWS = "Более половины записей относится к одной категории. Стоит проверить диверсификацию ассортимента."
TEXT_PRODUCT = "Высокая зависимость от одного товара: один продукт приносит более 40% выручки."
TEXT_GROWTH = "Наблюдается положительная динамика продаж. Последний период в среднем сильнее предыдущего."
TEXT_DECLINE = "Зафиксировано снижение продаж. Нужна проверка причин падения спроса или доступности товара."
TEXT_STABLE = "Продажи выглядят стабильными: существенного роста или падения по периоду не видно."
TEXT_NO_RISK = "Данные не содержат явных бизнес-рисков по базовым правилам."

RULE_COLUMNS = ("rank", "rule", "text")


def _emit(one_row: DataFrame, rank: int, rule: str, text: Column, when: Column) -> DataFrame:
    return one_row.where(when).select(F.lit(rank).alias("rank"), F.lit(rule).alias("rule"), text.alias("text"))


def _missing(df: DataFrame) -> list[Column]:
    """Per column whether its cell is missing (NULL, or NaN in floating columns)."""
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return [col_ref(c).isNull() | F.isnan(col_ref(c)) if c in floating else col_ref(c).isNull() for c in df.columns]


def missing_cells(df: DataFrame) -> Column:
    """Number of missing cells over all columns."""
    parts = [F.count(F.when(miss, 1)) for miss in _missing(df)]
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0)


def rule_missing_share(df: DataFrame) -> DataFrame:
    return _missing_share(df.agg(missing_cells(df).alias("missing"), F.count(F.lit(1)).alias("rows")), len(df.columns))


def _missing_share(agg: DataFrame, columns: int) -> DataFrame:
    n_cols = max(columns, 1)
    share = F.col("missing") / F.greatest(F.col("rows") * F.lit(n_cols), F.lit(1))
    text = F.when(share > 0.1, F.lit(TEXT_MISSING_HIGH)).otherwise(F.lit(TEXT_MISSING_SOME))
    return _emit(agg, 1, "missing_share", text, share > 0)


def _max_share_of_sum(df: DataFrame, key: str, value: Column) -> DataFrame:
    return _top_and_total(df.where(col_ref(key).isNotNull()).groupBy(col_ref(key)).agg(F.sum(value).alias("revenue")))


def _top_and_total(per: DataFrame) -> DataFrame:
    return per.select(F.coalesce("revenue", F.lit(0)).cast("double").alias("s")).agg(F.max("s").alias("top"), F.sum("s").alias("total"))


def rule_category_dependency(df: DataFrame, roles: dict[str, str]) -> DataFrame | None:
    cat = roles.get("category")
    if cat is None:
        return None
    if "revenue" in roles:
        return _category_by_revenue(_max_share_of_sum(df, cat, amount(df, roles["revenue"], fill_zero=False)))
    return _category_by_rows(df.groupBy(_category_text(cat).alias("k")).agg(F.count(F.lit(1)).alias("rows")))


def _category_text(cat: str) -> Column:
    """The text form as ``value_counts`` takes it, missing counted as its own value."""
    return F.coalesce(col_ref(cat).cast("string"), F.lit("nan"))


def _category_by_revenue(agg: DataFrame) -> DataFrame:
    cond = (F.col("total") > 0) & (F.col("top") / F.col("total") > 0.5)
    return _emit(agg, 2, "category_dependency", F.lit(TEXT_CATEGORY_REVENUE), cond)


def _category_by_rows(per: DataFrame) -> DataFrame:
    agg = per.agg(F.max("rows").alias("top"), F.sum("rows").alias("total"))
    cond = F.col("top") / F.col("total") > 0.5
    return _emit(agg, 2, "category_dependency", F.lit(TEXT_CATEGORY_ROWS), cond)


def rule_product_dependency(df: DataFrame, roles: dict[str, str]) -> DataFrame | None:
    if "product" not in roles or "revenue" not in roles:
        return None
    return _product_by_revenue(_max_share_of_sum(df, roles["product"], amount(df, roles["revenue"], fill_zero=False)))


def _product_by_revenue(agg: DataFrame) -> DataFrame:
    cond = (F.col("total") > 0) & (F.col("top") / F.col("total") > 0.4)
    return _emit(agg, 3, "product_dependency", F.lit(TEXT_PRODUCT), cond)


def trend_series(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Gap-filled daily revenue over rows with both a date and a revenue value."""
    rev = amount(df, roles["revenue"], fill_zero=False)
    rows = df.where(rev.isNotNull())
    return daily_sum(rows, roles["date"], amount(rows, roles["revenue"], fill_zero=False))


def rule_sales_trend(df: DataFrame, roles: dict[str, str]) -> DataFrame | None:
    if "date" not in roles or "revenue" not in roles:
        return None
    return _trend(trend_series(df, roles))


def _trend(series: DataFrame) -> DataFrame:
    stats = series_stats(series)
    first, second = F.col("first_half_mean"), F.col("second_half_mean")
    text = (
        F.when(second > first * 1.05, F.lit(TEXT_GROWTH))
        .when(second < first * 0.95, F.lit(TEXT_DECLINE))
        .otherwise(F.lit(TEXT_STABLE))
    )
    return _emit(stats, 4, "sales_trend", text, F.col("n_days") >= 4)


def business_insights(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """All business rules in order; a default line when none fires.

    The table is read once: grouping sets add up the whole table, its categories, products and days
    together, and every rule reads these sums, which are kept (a row per category, product and day)."""
    by_revenue, keys = "revenue" in roles, {}
    if "category" in roles:
        keys["_category"] = col_ref(roles["category"]) if by_revenue else _category_text(roles["category"])
    if "product" in roles and by_revenue:
        keys["_product"] = col_ref(roles["product"])
    if "date" in roles and by_revenue:
        keys["_day"] = day_of(df, roles["date"])
    revenue = amount(df, roles["revenue"], fill_zero=False) if by_revenue else F.lit(None).cast("double")
    cells = reduce(lambda a, b: a + b, [miss.cast("int") for miss in _missing(df)], F.lit(0))
    base = df.select(cells.alias("_cells"), revenue.alias("_revenue"), *[k.alias(name) for name, k in keys.items()])
    sums = [F.sum("_cells").alias("missing"), F.count(F.lit(1)).alias("rows"), F.sum("_revenue").alias("revenue"), F.count("_revenue").alias("with_revenue")]
    if keys:
        grouped = base.groupingSets([[], *[[F.col(k)] for k in keys]], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("_set"), *sums)
    else:
        grouped = base.groupBy(F.lit(0).cast("long").alias("_set")).agg(*sums)
    grouped = materialize(grouped)
    everything = 2 ** len(keys) - 1

    def per(key: str) -> DataFrame:
        return grouped.where(F.col("_set") == everything - 2 ** (len(keys) - 1 - list(keys).index(key))).where(F.col(key).isNotNull())

    zero = F.lit(0).cast("long")
    total = grouped.where(F.col("_set") == everything).agg(F.coalesce(F.sum("missing"), zero).alias("missing"), F.coalesce(F.sum("rows"), zero).alias("rows"))
    parts = [_missing_share(total, len(df.columns))]
    if "_category" in keys:
        parts.append(_category_by_revenue(_top_and_total(per("_category"))) if by_revenue else _category_by_rows(per("_category")))
    if "_product" in keys:
        parts.append(_product_by_revenue(_top_and_total(per("_product"))))
    if "_day" in keys:
        parts.append(_trend(gap_fill_daily(per("_day").where(F.col("with_revenue") > 0).select(F.col("_day").alias("ds"), F.col("revenue").alias("y")))))
    fired = reduce(DataFrame.unionByName, parts)
    n_fired = fired.agg(F.count(F.lit(1))).scalar()
    default = total.where(n_fired == 0).select(
        F.lit(9).alias("rank"), F.lit("default").alias("rule"), F.lit(TEXT_NO_RISK).alias("text")
    )
    return fired.unionByName(default)
