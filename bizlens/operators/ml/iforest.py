"""Isolation forest over table rows (Liu, Ting and Zhou, 2008).

Training data: every tree draws ``min(256, n)`` rows without replacement.
The draws come from a bounded pool (the first ``trees * 256`` rows in hash
order, a distributed top-k); tree ``t`` takes the pool rows with the smallest
``xxhash64(row_key, t)``. Trees are grown in parallel with
``groupBy(tree).applyInPandas`` (256 rows per group), the forest (at most
``trees * 511`` nodes) is broadcast and every row of the full table is scored
by ``mapInPandas`` in Arrow batches.

Score: ``2 ** (-E[h(x)] / c(psi))`` where h is the path length plus
``c(leaf size)`` at the leaf; with contamination "auto" a row is an outlier
when its score exceeds 0.5. Features are all numeric columns (booleans
included) with missing values as 0, unscaled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.functions.expr import to_number
from bizlens.operators.common import first_by_hash, widen
from bizlens.operators.ml.prep import KEY, SAMPLE_SEED, hash_order, with_row_key
from bizlens.operators.typing import column_kinds

TREES = 100
MAX_SAMPLES = 256
MIN_ROWS = 10
EULER = 0.5772156649015329

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size long, depth int"


def c_factor(n: float) -> float:
    """Average unsuccessful-search path length of a binary search tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _grow(pdf: pd.DataFrame, features: list[str], seed: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    x = pdf[features].to_numpy(dtype=np.float64)
    rng = np.random.default_rng([seed, tree])
    limit = int(math.ceil(math.log2(max(len(x), 2))))
    nodes = []

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, -1, -1, len(idx), depth])
        if depth >= limit or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.nonzero(hi > lo)[0]
        if len(usable) == 0:
            return me
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < t]
        right = idx[sub[:, f] >= t]
        nodes[me][2], nodes[me][3] = f, t
        nodes[me][4] = build(left, depth + 1)
        nodes[me][5] = build(right, depth + 1)
        return me

    build(np.arange(len(x)), 0)
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])


def feature_frame(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """row_key + all numeric columns (booleans included) as doubles, missing as 0."""
    cols = column_kinds(df, include_bool=True).numeric
    keyed = df if KEY in df.columns else with_row_key(df)
    return keyed.select("*", *[F.coalesce(to_number(df, c), F.lit(0.0)).alias(f"_f{i}") for i, c in enumerate(cols)]), cols


def fit(features: DataFrame, n_features: int, n_rows: int, trees: int = TREES, max_samples: int = MAX_SAMPLES,
        seed: int = SAMPLE_SEED):
    """Grow the forest; returns (nodes pandas frame, psi).

    The pool is the first ``trees * psi`` rows in hash order. Every tree takes its own draw of
    ``psi`` pool rows (smallest ``xxhash64(row_key, tree)``), whatever the size of the table;
    the pool bounds the per-tree window.
    """
    fcols = [f"_f{i}" for i in range(n_features)]
    psi = min(max_samples, n_rows)
    keyed = features.select(KEY, *fcols).withColumn("_h", hash_order(KEY, seed))
    pool = first_by_hash(keyed, F.col("_h"), [F.col(KEY)], trees * psi, n_rows)
    per_tree = pool.select(KEY, *fcols, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    pick = Window.partitionBy("tree").orderBy(F.xxhash64(KEY, F.col("tree")), KEY)
    draws = per_tree.withColumn("_r", F.row_number().over(pick)).where(F.col("_r") <= psi).drop("_r")
    grown = draws.select("tree", *fcols).groupBy("tree").applyInPandas(lambda pdf: _grow(pdf, fcols, seed), NODE_SCHEMA)
    nodes = grown.toPandas()  # bounded: trees x (2 * psi - 1) nodes
    return nodes, psi


def score(features: DataFrame, nodes: pd.DataFrame, psi: int, n_features: int) -> DataFrame:
    """row_key + anomaly score for every row (full table, Arrow batches).

    The forest is flattened into arrays (node -> feature, threshold, children,
    leaf path length) and all trees are walked together: one vectorised step
    per depth level over a (rows x trees) index matrix.
    """
    spark = features.sparkSession
    fcols = [f"_f{i}" for i in range(n_features)]
    flat = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    offset = flat.groupby("tree")["node"].transform("size").groupby(flat["tree"]).first().cumsum().shift(fill_value=0)
    base = flat["tree"].map(offset).to_numpy()
    feat = flat["feature"].to_numpy()
    left = np.where(flat["left"] >= 0, flat["left"] + base, -1)
    right = np.where(flat["right"] >= 0, flat["right"] + base, -1)
    leaf_len = flat["depth"].to_numpy() + np.array([c_factor(s) for s in flat["size"]])
    roots = offset.sort_index().to_numpy()
    forest = spark.sparkContext.broadcast((feat, flat["threshold"].to_numpy(), left, right, leaf_len, roots, c_factor(psi)))
    def run(batches):
        feat_a, thr_a, left_a, right_a, leaf_a, roots_a, cpsi = forest.value
        for pdf in batches:
            if pdf.empty:
                continue
            x = pdf[fcols].to_numpy(dtype=np.float64)
            node = np.broadcast_to(roots_a, (len(x), len(roots_a))).copy()
            rows = np.arange(len(x))[:, None]
            while True:
                f = feat_a[node]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = x[rows, np.where(inner, f, 0)] < thr_a[node]
                node = np.where(inner, np.where(go_left, left_a[node], right_a[node]), node)
            mean_path = leaf_a[node].mean(axis=1)
            s = np.power(2.0, -mean_path / cpsi) if cpsi > 0 else np.full(len(x), 0.5)
            yield pd.DataFrame({"_k1": pdf["_k1"], "_k2": pdf["_k2"], "score": s})

    # the key travels as two plain longs: struct columns are slow through Arrow/pandas
    flat_key = widen(features.select(F.col(KEY).getField("h1").alias("_k1"), F.col(KEY).getField("h2").alias("_k2"), *fcols))
    scored = flat_key.mapInPandas(run, "_k1 long, _k2 long, score double")
    return scored.select(F.struct(F.col("_k1").alias("h1"), F.col("_k2").alias("h2")).alias(KEY), "score")


def isolation_forest(df: DataFrame, top: int = 30, trees: int = TREES, seed: int = SAMPLE_SEED) -> DataFrame:
    """Rows scored as outliers (score > 0.5), highest score first, first ``top``;
    empty below 10 rows or without numeric columns. Three passes over the
    table (pool, scoring, fetching the flagged rows); nothing is cached."""
    feats, cols = feature_frame(df)
    empty = feats.limit(0).select("*", F.lit(0.0).alias("score")).drop(*[f"_f{i}" for i in range(len(cols))])
    if not cols:
        return empty
    n = df.count()
    if n < MIN_ROWS:
        return empty
    nodes, psi = fit(feats, len(cols), n, trees=trees, seed=seed)
    scored = score(feats, nodes, psi, len(cols))
    flagged = scored.where(F.col("score") > 0.5).orderBy(F.col("score").desc(), F.col(KEY)).limit(top)
    # identical rows share a key: count the flagged ones per key (at most ``top`` keys), fetch
    # each key once and repeat it as often as it was flagged
    counted = flagged.groupBy(KEY, "score").agg(F.count(F.lit(1)).alias("_copies"))
    rows = feats.join(F.broadcast(counted), KEY).dropDuplicates([KEY])
    rows = rows.withColumn("_copies", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))).drop("_copies")
    return rows.drop(*[f"_f{i}" for i in range(len(cols))])
