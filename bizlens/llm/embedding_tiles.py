"""Embedding near-duplicates by int8 tile products with exact error bounds.

Method: vectors are compared only within a label. Equal vectors are one node with a
multiplicity. The nodes of a label are cut into blocks of about ``BLOCK``; every pair of blocks
is one tile, compared in one task: unit vectors are quantised to int8 with a scale per vector, the
tile product of the codes approximates all cosines, and with the quantisation error e = |x - s q|
of each vector ``|x.y - s_x q_x . s_y q_y| <= e_x + (1 + e_x) e_y`` bounds each from above. Only pairs whose
bound reaches the threshold are computed again in double precision. A tile returns one row per
linked node (its number of links and one representative of its local component), never the pairs.
Components of those rows are the components of all links.

Defined results: NULL labels and vectors that are NULL, empty, zero, or hold NULL or
non-finite components link with nothing (n_links 0, a component of their own); vectors of different
length do not link; repeated rows are further vectors; the component id is the smallest vec_id (NULL ids are
skipped); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import materialize, row_key
from bizlens.llm.components import connected_components

THRESHOLD = 0.93
BLOCK = 1024
#: Slack for the float rounding of the bound itself.
_SLACK = 1e-6


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision (first by their largest entry, so nothing overflows)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms of unit rows."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of unit rows with cosine >= threshold."""
    qa, sa, ea = quantise(a)
    qb, sb, eb = quantise(b)
    # products of int8 codes are exact in float32 up to 1,000 components, in float64 far beyond
    kind = np.float32 if a.shape[1] <= 1000 else np.float64
    approx = (qa.astype(kind) @ qb.astype(kind).T) * sa[:, None] * sb[None, :]
    bound = approx + ea[:, None] + (1 + ea)[:, None] * eb[None, :]
    i, j = np.nonzero(bound >= threshold - _SLACK)
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 200_000):
        part = slice(at, at + 200_000)
        keep[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]]) >= threshold
    return i[keep], j[keep]


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index per node."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if np.array_equal(label, before):
            return label


def _tile(threshold: float):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low_block"].iat[0], pdf["high_block"].iat[0]
        rows = pdf.sort_values("block", kind="stable").reset_index(drop=True)
        unit = unit_rows(np.stack(rows["vector"].to_numpy()).astype(np.float64))
        cut = len(rows) if low == high else int((rows["block"] == low).sum())
        if low == high:
            i, j = linked_pairs(unit, unit, threshold)
            i, j = i[i < j], j[i < j]
        else:
            i, j = linked_pairs(unit[:cut], unit[cut:], threshold)
            j = j + cut
        copies = rows["copies"].to_numpy()
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root = local_components(len(rows), i, j)
        some = links > 0
        return pd.DataFrame({"node": rows["node"][some], "links": links[some], "root": rows["node"].to_numpy()[root[some]]})

    return compare


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    usable = _usable(F.col("vector")) & F.col("label").isNotNull()
    keyed = materialize(rows.withColumn("node", F.when(usable, row_key(F.col("label"), F.col("vector")))))
    nodes = materialize(keyed.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.first(F.struct("label", "vector")).alias("f")).select(
        "node", "copies", "f.label", F.col("f.vector").cast("array<double>").alias("vector"), F.size("f.vector").alias("size")))
    blocks = nodes.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    placed = nodes.join(blocks, ["label", "size"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "size", F.least("block", "other").alias("low_block"), F.greatest("block", "other").alias("high_block"), "block", "node", "copies", "vector")
    linked = materialize(tiles.groupBy("label", "size", "low_block", "high_block").applyInPandas(_tile(threshold), "node string, links long, root string"))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.select("node", "copies").join(links, "node", "left").join(components, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    named = materialize(named)
    placed_rows = keyed.select("vec_id", "node").join(named, "node", "left")
    smallest = placed_rows.where(F.col("node").isNotNull()).groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return placed_rows.join(smallest, "component", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
