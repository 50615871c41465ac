"""Table profiling (EDA) and the data-quality insight lines.

All per-column statistics of one kind are computed in one aggregate; column
values are unpivoted to (column_name, value) only where a per-column grouping
is needed, and per-column winners are picked with partial-aggregatable
``min(struct(...))`` instead of windows, so a huge column never lands in one
task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.functions.expr import col_ref, is_numeric_type, to_number, unbiased_skew
from bizlens.operators.common import amount, materialize
from bizlens.operators.quantiles import column_quantiles
from bizlens.operators.rules import missing_cells
from bizlens.operators.typing import choose_value_column, column_kinds

# Texts of the profiling insights (placeholders are filled per row).
TEXT_MISSING_TOTAL = "Обнаружено %d пропущенных значений (%.1f%% от всех ячеек)."
TEXT_MISSING_COLUMN = "В столбце «%s» пропущено %d значений (%.1f%%)."
TEXT_DUPLICATES = "Найдено %d полностью повторяющихся строк."
TEXT_TOP_VALUE = "Самое частое значение в «%s» — «%s» (%.1f%% строк)."
TEXT_TOP_CONTRIBUTOR = "«%s» дает %.1f%% суммы по показателю «%s»."
TEXT_SKEW_RIGHT = "Распределение «%s» смещено вправо: есть крупные значения или выбросы."
TEXT_SKEW_LEFT = "Распределение «%s» смещено влево: есть необычно малые значения."
TEXT_CORRELATED = "Показатели «%s» и «%s» сильно связаны (корреляция %.2f)."
TEXT_CLEAN = "Критичных проблем не найдено: данные выглядят пригодными для дальнейшего анализа."


def _is_missing(df: DataFrame, name: str) -> Column:
    c = col_ref(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def profile_shape(df: DataFrame) -> DataFrame:
    """rows, columns, missing_total."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        missing_cells(df).cast("long").alias("missing_total"),
    )


def profile_missing(df: DataFrame) -> DataFrame:
    """(ordinal, column_name, missing) for every column, one aggregate."""
    wide = df.agg(*[F.count(F.when(_is_missing(df, c), 1)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    entries = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(df.columns)]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.ordinal", "e.column_name", "e.missing")


def profile_duplicates(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows, NULLs equal (map-side combined group count)."""
    counts = df.groupBy(*[col_ref(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_c"))
    return counts.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("duplicates"))


def profile_describe(df: DataFrame, digits: int = 2, approx: bool = False) -> DataFrame:
    """count, mean, std (ddof 1), min, 25/50/75% (exact, linear), max per numeric column.

    Booleans are left out, as pandas ``describe`` does, and so are columns without values. One wide aggregate
    takes the moments and brackets the quartiles (``quantiles.column_quantiles``). With ``approx`` the quartiles are
    the sketch's: values of the column whose rank is off by at most 1/10,000 of the rows, in that one pass.
    """
    schema = "column_name string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    values = {f.name: to_number(df, f.name) for f in df.schema.fields if is_numeric_type(f.dataType, include_bool=False)}
    if not values:
        return df.sparkSession.createDataFrame([], schema)
    moments = {}
    for i, v in enumerate(values.values()):
        kept = F.when(~F.isnan(v.cast("double")), v.cast("double"))
        moments[f"m{i}"] = F.struct(F.count(kept).alias("count"), F.avg(kept).alias("mean"), F.stddev_samp(kept).alias("std"), F.min(kept).alias("min"), F.max(kept).alias("max"))
    found, of = column_quantiles(df, values, [0.25, 0.5, 0.75], approx, also=moments)
    rows = [(name, m["count"], m["mean"], m["std"], m["min"], *found[name], m["max"]) for i, name in enumerate(values) if (m := of[f"m{i}"])["count"]]
    out = df.sparkSession.createDataFrame(rows, schema)
    return out.select("column_name", "count", *[F.round(c, digits).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def top_value_share(df: DataFrame, n_columns: int = 3) -> DataFrame:
    """Most frequent text value (missing counted as ``nan``) and its share of rows,
    for the first ``n_columns`` categorical columns."""
    cats = column_kinds(df).categorical[:n_columns]
    if not cats:
        return df.sparkSession.createDataFrame([], "ordinal int, column_name string, value string, share double")
    entries = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), F.coalesce(col_ref(c).cast("string"), F.lit("nan")).alias("value")) for i, c in enumerate(cats)]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.ordinal", "e.column_name", "e.value")
    counts = long.groupBy("ordinal", "column_name", "value").agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy("ordinal", "column_name").agg(
        F.min(F.struct((-F.col("c")).alias("neg"), F.col("value"))).alias("b"), F.sum("c").alias("rows")
    )
    return best.select(
        "ordinal",
        "column_name",
        F.col("b.value").alias("value"),
        (F.lit(100.0) * -F.col("b.neg") / F.col("rows")).alias("share"),
    )


def top_contributor_share(df: DataFrame, n_columns: int = 3) -> DataFrame:
    """For the first categorical column (of the first ``n_columns``) whose value
    total is non-zero: its top key and the key's share of the value column."""
    kinds = column_kinds(df)
    value = choose_value_column(kinds.numeric)
    cats = kinds.categorical[:n_columns]
    schema = "pos int, column_name string, top_value string, share double, value_column string"
    if not value or not cats:
        return df.sparkSession.createDataFrame([], schema)
    v = amount(df, value, fill_zero=False)  # decimals stay exact
    entries = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column_name"), col_ref(c).cast("string").alias("key")) for i, c in enumerate(cats)]
    long = df.select(F.explode(F.array(*entries)).alias("e"), v.alias("v")).select("e.pos", "e.column_name", "e.key", "v")
    sums = long.where(F.col("key").isNotNull()).groupBy("pos", "column_name", "key").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("s"))
    per_col = sums.groupBy("pos", "column_name").agg(
        F.min(F.struct((-F.col("s")).alias("neg"), F.col("key"))).alias("b"), F.sum("s").alias("total")
    )
    first = per_col.where(F.col("total") != 0).agg(F.min(F.struct("pos", "column_name", "b", "total")).alias("w"))
    return first.where(F.col("w").isNotNull()).select(
        F.col("w.pos").alias("pos"),
        F.col("w.column_name").alias("column_name"),
        F.col("w.b.key").alias("top_value"),
        ((-F.col("w.b.neg")).cast("double") / F.col("w.total").cast("double") * 100.0).alias("share"),
        F.lit(value).alias("value_column"),
    )


def skew_flags(df: DataFrame, n_columns: int = 6) -> DataFrame:
    """Bias-corrected skewness of the first ``n_columns`` numeric columns with
    at least 3 values; ``direction`` is right (>1), left (<-1) or NULL."""
    cols = column_kinds(df).numeric[:n_columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, n long, skew double, direction string")
    aggs = []
    for i, c in enumerate(cols):
        v = to_number(df, c)
        aggs += [F.count(v).alias(f"n{i}"), F.skewness(v).alias(f"g{i}")]
    wide = df.agg(*aggs)
    entries = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), unbiased_skew(F.col(f"g{i}"), F.col(f"n{i}")).alias("skew")) for i, c in enumerate(cols)]
    long = wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("n") >= 3)
    return long.select(
        "ordinal",
        "column_name",
        "n",
        "skew",
        F.when(F.col("skew") > 1, F.lit("right")).when(F.col("skew") < -1, F.lit("left")).alias("direction"),
    )


def _batch_moments(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """For a batch of rows, matrices over the column pairs (i, j): number of rows that hold
    both; over these rows, mean, squared deviations, least and largest value of i, and the
    product of the deviations of i and j (NaN where an infinite value takes part)."""
    held = ~np.isnan(x)
    finite = np.isfinite(x)
    m = held.astype(np.float64)
    shift = np.where(finite, x, 0.0).sum(0) / np.maximum(finite.sum(0), 1)
    z = np.where(finite, x - shift, 0.0)
    n = m.T @ m
    some = np.maximum(n, 1.0)
    sums = z.T @ m
    dev = (z * z).T @ m - sums * sums / some
    prod = z.T @ z - sums * sums.T / some
    infinite = (held & ~finite).astype(np.float64).T @ m > 0
    prod[infinite | infinite.T] = np.nan
    low, high = np.where(held, x, np.inf), np.where(held, x, -np.inf)
    both = [held[:, [j]] for j in range(x.shape[1])]
    lo = np.stack([np.where(b, low, np.inf).min(0) for b in both], axis=1)
    hi = np.stack([np.where(b, high, -np.inf).max(0) for b in both], axis=1)
    return n, shift[:, None] + sums / some, dev, prod, lo, hi


def _merge_moments(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Moments of two disjoint sets of rows together."""
    n = a[0] + b[0]
    some = np.maximum(n, 1.0)
    gap = b[1] - a[1]
    weight = a[0] * b[0] / some
    return (n, a[1] + gap * b[0] / some, a[2] + b[2] + gap * gap * weight, a[3] + b[3] + gap * gap.T * weight,
            np.minimum(a[4], b[4]), np.maximum(a[5], b[5]))


MOMENTS = ("n", "mean_a", "mean_b", "dev_a", "dev_b", "prod", "lo_a", "hi_a", "lo_b", "hi_b")
#: Columns per side of a block of pairs; a packed block has at most 5 KB.
PAIR_BLOCK = 8
#: Tasks that may hold moments of one pair after the first merge.
MERGERS = 16


def _packed_moments(batches):
    """One row per block of column pairs (i, j), first column not after the second's block, for all batches of a partition."""
    total = None
    for pdf in batches:
        if len(pdf):
            part = _batch_moments(pdf.to_numpy(dtype=np.float64))
            total = part if total is None else _merge_moments(total, part)
    if total is None:
        return
    n, mean, dev, prod, lo, hi = total
    blocks = [slice(x, x + PAIR_BLOCK) for x in range(0, len(n), PAIR_BLOCK)]
    rows = []
    for bi, i in enumerate(blocks):
        for bj, j in enumerate(blocks[bi:], bi):
            sides = [m for x in (mean, dev, lo, hi) for m in (x[i, j], x[j, i].T)]
            stack = np.stack([n[i, j], *sides[:4], prod[i, j], sides[4], sides[6], sides[5], sides[7]])
            rows.append((bi, bj, stack.tobytes()))
    yield pd.DataFrame(rows, columns=["bi", "bj", "packed"]).assign(merger=TaskContext.get().partitionId() % MERGERS)


def _merge_packed(columns: int):
    """Merge the blocks that a task gets one by one and yield one row per column pair i <= j."""

    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for bi, bj, packed in zip(pdf["bi"], pdf["bj"], pdf["packed"]):
                shape = [min(PAIR_BLOCK, columns - b * PAIR_BLOCK) for b in (bi, bj)]
                b = np.frombuffer(packed).reshape(len(MOMENTS), *shape)
                a = total.get((bi, bj))
                total[bi, bj] = b if a is None else _merge_stacks(a, b)
        for (bi, bj), stack in total.items():
            i, j = (x.ravel() for x in np.indices(stack.shape[1:]))
            rows = pd.DataFrame({"i": i + bi * PAIR_BLOCK, "j": j + bj * PAIR_BLOCK, **{f: m.ravel() for f, m in zip(MOMENTS, stack)}})
            yield rows[(rows["n"] > 0) & (rows["i"] <= rows["j"])]

    return run


def _merge_stacks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The stacked moments (in the order of ``MOMENTS``) of two disjoint sets of rows together."""
    x, y = dict(zip(MOMENTS, a)), dict(zip(MOMENTS, b))
    n = x["n"] + y["n"]
    some = np.maximum(n, 1.0)
    share, weight = y["n"] / some, x["n"] * y["n"] / some
    gap = {s: np.where(x["n"] > 0, y[f"mean_{s}"] - x[f"mean_{s}"], 0) for s in "ab"}
    out = {"n": n, "prod": x["prod"] + y["prod"] + gap["a"] * gap["b"] * weight}
    for s in "ab":
        out[f"mean_{s}"] = np.where(x["n"] > 0, x[f"mean_{s}"] + gap[s] * share, y[f"mean_{s}"])
        out[f"dev_{s}"] = x[f"dev_{s}"] + y[f"dev_{s}"] + gap[s] ** 2 * weight
        out[f"lo_{s}"] = np.minimum(x[f"lo_{s}"], y[f"lo_{s}"])
        out[f"hi_{s}"] = np.maximum(x[f"hi_{s}"], y[f"hi_{s}"])
    return np.stack([out[f] for f in MOMENTS])


def corr_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlation of all column pairs, long form
    (i, j, row_name, col_name, corr); NULL where undefined.

    Every task reduces its rows to moments per pair (matrix products over Arrow batches), packed in
    blocks of pairs. Up to ``MERGERS`` tasks a block merge these one by one, so that what is stored (at most ``MERGERS`` rows a
    pair) does not grow with the number of tasks; the rest is merged around the pair's mean. The
    diagonal is 1 where the column varies.
    """
    cols = columns if columns is not None else column_kinds(df).numeric
    if not cols:
        return df.sparkSession.createDataFrame([], "i int, j int, row_name string, col_name string, corr double")
    numbers = df.select(*[to_number(df, c).alias(f"_n{i}") for i, c in enumerate(cols)])
    packed = numbers.mapInPandas(_packed_moments, "bi int, bj int, packed binary, merger int").repartition("bi", "bj", "merger")
    # read twice below: computed once
    parts = materialize(packed.mapInPandas(_merge_packed(len(cols)), "i int, j int, " + ", ".join(f"{f} double" for f in MOMENTS)))
    means = parts.groupBy("i", "j").agg(*[(F.sum(F.col("n") * F.col(f"mean_{s}")) / F.sum("n")).alias(f"all_{s}") for s in "ab"])
    off = {s: F.col(f"mean_{s}") - F.col(f"all_{s}") for s in "ab"}
    # one row per column pair: bounded by the schema width
    stats = parts.join(F.broadcast(means), ["i", "j"]).groupBy("i", "j").agg(
        F.sum(F.col("prod") + F.col("n") * off["a"] * off["b"]).alias("prod"),
        *[F.sum(F.col(f"dev_{s}") + F.col("n") * off[s] * off[s]).alias(f"dev_{s}") for s in "ab"],
        # exact test for constant sides: merged moments of a constant can differ from 0
        ((F.min("lo_a") < F.max("hi_a")) & (F.min("lo_b") < F.max("hi_b"))).alias("varies"),
    )
    r = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(
        F.try_divide(F.col("prod"), F.sqrt("dev_a") * F.sqrt("dev_b"))
    )
    upper = stats.select("i", "j", F.when(F.col("varies") & ~F.isnan(r), r).alias("corr"))
    # every (i, j) pair, present in the data or not
    grid = df.sparkSession.createDataFrame([(i, j) for i in range(len(cols)) for j in range(len(cols))], "i int, j int")
    names = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(i), F.lit(c))])
    lower = upper.where(F.col("i") != F.col("j")).select(F.col("j").alias("i"), F.col("i").alias("j"), "corr")
    full = grid.join(F.broadcast(upper.unionByName(lower)), ["i", "j"], "left")
    return full.select("i", "j", names[F.col("i")].alias("row_name"), names[F.col("j")].alias("col_name"), "corr")


def corr_strong_pairs(df: DataFrame, threshold: float = 0.8, n: int = 3) -> DataFrame:
    """First ``n`` upper-triangle pairs (column order) with |r| >= threshold."""
    m = corr_matrix(df)
    return (
        m.where((F.col("i") < F.col("j")) & (F.abs("corr") >= threshold))
        .orderBy("i", "j")
        .limit(n)
        .select("i", "j", F.col("row_name").alias("left"), F.col("col_name").alias("right"), F.abs("corr").alias("corr"))
    )


def insight_missing(df: DataFrame, top: int = 5) -> DataFrame:
    """(line, text): the missing total line and up to ``top`` per-column lines."""
    shape = profile_shape(df)
    n_cols = max(len(df.columns), 1)
    total = shape.where(F.col("missing_total") > 0).select(
        F.lit(0).alias("line"),
        F.format_string(TEXT_MISSING_TOTAL, F.col("missing_total"), F.col("missing_total") / F.greatest(F.col("rows") * n_cols, F.lit(1)) * 100.0).alias("text"),
    )
    rows = shape.select("rows").scalar()
    per = profile_missing(df).orderBy(F.col("missing").desc(), F.col("ordinal").asc()).limit(top)
    per_lines = per.where(F.col("missing") > 0).select(
        (F.lit(1) + F.col("ordinal")).alias("line"),
        F.format_string(TEXT_MISSING_COLUMN, F.col("column_name"), F.col("missing"), F.col("missing") / F.greatest(rows, F.lit(1)) * 100.0).alias("text"),
    )
    return total.unionByName(per_lines)


def insights_all(df: DataFrame, limit: int = 12) -> DataFrame:
    """Ordered profiling insights (missing, duplicates, categories, skew,
    correlation), a default line when none applies, at most ``limit`` lines."""
    parts = []
    miss = insight_missing(df).select(F.lit(1).alias("section"), F.col("line").alias("sub"), "text")
    parts.append(miss)
    dup = profile_duplicates(df).where("duplicates > 0").select(
        F.lit(2).alias("section"), F.lit(0).alias("sub"), F.format_string(TEXT_DUPLICATES, "duplicates").alias("text")
    )
    parts.append(dup)
    kinds = column_kinds(df)
    if kinds.categorical[:3]:
        tv = top_value_share(df)
        if choose_value_column(kinds.numeric):
            # the reference stops at the first column whose value total is non-zero
            tc = top_contributor_share(df)
            stop = tc.select("pos").scalar()
            tv = tv.where(stop.isNull() | (F.col("ordinal") <= stop))
            parts.append(tc.select(F.lit(3).alias("section"), (F.col("pos") * 2 + 1).alias("sub"),
                                   F.format_string(TEXT_TOP_CONTRIBUTOR, "top_value", "share", "value_column").alias("text")))
        parts.append(tv.select(F.lit(3).alias("section"), (F.col("ordinal") * 2).alias("sub"),
                               F.format_string(TEXT_TOP_VALUE, "column_name", "value", "share").alias("text")))
    sk = skew_flags(df).where(F.col("direction").isNotNull())
    parts.append(sk.select(F.lit(4).alias("section"), F.col("ordinal").alias("sub"),
                           F.when(F.col("direction") == "right", F.format_string(TEXT_SKEW_RIGHT, "column_name"))
                           .otherwise(F.format_string(TEXT_SKEW_LEFT, "column_name")).alias("text")))
    if len(kinds.numeric) >= 2:
        sp = corr_strong_pairs(df)
        parts.append(sp.select(F.lit(5).alias("section"), (F.col("i") * 1000 + F.col("j")).alias("sub"),
                               F.format_string(TEXT_CORRELATED, "left", "right", "corr").alias("text")))
    parts = [p.select("section", F.col("sub").cast("int").alias("sub"), "text") for p in parts]
    lines = reduce(DataFrame.unionByName, parts)
    n_lines = lines.agg(F.count(F.lit(1))).scalar()
    default = df.agg(F.count(F.lit(1)).alias("_n")).where(n_lines == 0).select(
        F.lit(9).alias("section"), F.lit(0).alias("sub"), F.lit(TEXT_CLEAN).alias("text")
    )
    ordered = lines.unionByName(default).orderBy("section", "sub").limit(limit)
    return ordered.select(F.row_number().over(Window.orderBy("section", "sub")).alias("line"), "text")
