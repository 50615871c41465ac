"""Centroid clustering with ns-bounds (exact Lloyd rounds, few distances).

Method: every vector keeps its cluster, its last exact distance to that cluster's centroid
and, per centroid, a lower bound with the round in which that distance was evaluated. All
centroids of all rounds are retained (rounds x clusters x size numbers: parameters, not data), so a
bound of round r is loosened in round t by ``|C_t(k) - C_r(k)|``, the norm of the total
displacement since, not by the sum of the drifts of every round between. A vector whose loosened
upper bound stays below all its loosened lower bounds keeps its cluster; otherwise its own
distance is evaluated, and then exactly those centroids whose bounds still fail.

Vectors are integers, ``floor(256 x)``; all distances that decide are exact integers, and
bounds are rounded away from the decision, so the result equals plain Lloyd rounds, ties to the
smaller number included. A round is one pass over the state table in the shared folder; sums are
kept from round to round and changed by the vectors that moved.

Defined results: vectors that are NULL, of another size, or hold NULL or non-finite components are
left out; integer components saturate at +-2^26 (x beyond +-262,144), which keeps squared distances in a long;
fewer kept vectors than clusters give fewer clusters; a NULL id hashes as the empty number; repeated
rows are further vectors, and equal ids start in the order of their vectors; an inertia beyond a long is
NULL; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.llm.common import drop_folder, scratch

CLUSTERS, ROUNDS, SIZE, SCALE = 40, 5, 64, 256
LIMIT = 2**26
#: Bounds must differ by more than this share to decide: float rounding can then not decide wrongly.
_MARGIN = 1e-6
_STATE = "vec_id {id}, v array<int>, cluster int, before int, upper double, seen int, lower array<float>, rounds array<short>"


def integer_vector(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, saturating at ``LIMIT``."""
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double"), F.lit(LIMIT / scale)), F.lit(-LIMIT / scale)) * scale).cast("int")
    return F.transform(vector, whole)


def usable(vector: Column, size: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def squared_distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of matching rows of two int64 arrays."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def all_squared_distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every centroid; by a product in double precision where that is exact."""
    top = int(max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)))
    if v.shape[1] * (2 * top) ** 2 < 2**53:
        x, c = v.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (x @ c.T)).astype(np.int64)
    return np.stack([squared_distances(v, c[None, :]) for c in centroids], axis=1)


def _below(root: np.ndarray) -> np.ndarray:
    """float32 numbers not above the given ones."""
    return np.nextafter(root.astype(np.float32), np.float32(-np.inf))


def first_assignment(v: np.ndarray, centroids: np.ndarray):
    d = all_squared_distances(v, centroids)
    cluster = d.argmin(axis=1)
    root = np.sqrt(d.astype(np.float64))
    return cluster.astype(np.int32), np.take_along_axis(root, cluster[:, None], 1)[:, 0], _below(root)


def reassign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, seen: np.ndarray, lower: np.ndarray, rounds: np.ndarray, history: np.ndarray):
    """One round of ns-bounds against the last centroids of ``history`` (rounds x clusters x size).

    Returns the new cluster, upper, seen, lower, rounds and the number of distances evaluated."""
    now = len(history) - 1
    centroids, k = history[now], np.arange(history.shape[1])
    moved = np.sqrt(((history - centroids[None]).astype(np.float64) ** 2).sum(axis=2)) * (1 + _MARGIN)
    cluster, upper, seen, lower, rounds = cluster.copy(), upper.copy(), seen.copy(), lower.copy(), rounds.copy()
    loose = lower - moved[rounds, k[None, :]]
    own = upper + moved[seen, cluster]
    others = k[None, :] != cluster[:, None]
    at = np.flatnonzero((others & (loose <= own[:, None] * (1 + _MARGIN) + _MARGIN)).any(axis=1))
    if not len(at):
        return cluster, upper, seen, lower, rounds, 0
    best = squared_distances(v[at], centroids[cluster[at]])
    upper[at], seen[at] = np.sqrt(best.astype(np.float64)), now
    lower[at, cluster[at]], rounds[at, cluster[at]] = _below(upper[at]), now
    fails = others[at] & (loose[at] <= upper[at][:, None] * (1 + _MARGIN) + _MARGIN)
    row, rival = np.nonzero(fails)
    found = np.empty(len(row), np.int64)
    for start in range(0, len(row), 65536):
        part = slice(start, start + 65536)
        found[part] = squared_distances(v[at[row[part]]], centroids[rival[part]])
    lower[at[row], rival], rounds[at[row], rival] = _below(np.sqrt(found.astype(np.float64))), now
    # the smallest (distance, centroid) of every row, its present one included
    rows = np.concatenate([np.arange(len(at)), row])
    names = np.concatenate([cluster[at], rival.astype(np.int32)])
    dist = np.concatenate([best, found])
    order = np.lexsort((names, dist, rows))
    first = order[np.r_[True, rows[order][1:] != rows[order][:-1]]]
    cluster[at], upper[at] = names[first], np.sqrt(dist[first].astype(np.float64))
    return cluster, upper, seen, lower, rounds, len(at) + len(row)


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def _state_batch(ids, v, cluster, before, upper, seen, lower, rounds) -> pa.RecordBatch:
    lists = lambda m, kind: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel(), kind))
    return pa.RecordBatch.from_arrays([
        ids, lists(v.astype(np.int32), pa.int32()), pa.array(cluster.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(upper),
        pa.array(seen.astype(np.int32)), lists(lower.astype(np.float32), pa.float32()), lists(rounds.astype(np.int16), pa.int16())],
        names=["vec_id", "v", "cluster", "before", "upper", "seen", "lower", "rounds"])


def _first_pass(centroids: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"), centroids.shape[1], np.int64)
                cluster, upper, lower = first_assignment(v, centroids)
                zero = np.zeros(len(v), np.int32)
                yield _state_batch(b.column("vec_id"), v, cluster, zero - 1, upper, zero, lower, np.zeros(lower.shape, np.int16))

    return assign


def _next_pass(history: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = history.shape[1:]
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"), size, np.int64)
                before = b.column("cluster").to_numpy()
                out = reassign(v, before, b.column("upper").to_numpy(), b.column("seen").to_numpy(), _matrix(b.column("lower"), k, np.float32),
                               _matrix(b.column("rounds"), k, np.int16), history)
                yield _state_batch(b.column("vec_id"), v, out[0], before, *out[1:5])

    return assign


def _distances(centroids: np.ndarray):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cluster = b.column("cluster").to_numpy()
                d = squared_distances(_matrix(b.column("v"), centroids.shape[1], np.int64), centroids[cluster])
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return measure


def start_vectors(rows: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors whose id hashes lowest; at most ``clusters`` rows come to the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r["v"] for r in rows.orderBy(key, "v").limit(clusters).select("v").collect()]


def _moved_sums(state: DataFrame, size: int) -> list:
    """Per cluster: rows and component sums gained, less those lost, by the vectors that moved."""
    sides = state.where("cluster <> before").select("v", F.explode(F.array(
        F.struct(F.col("cluster"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("cluster"), F.lit(-1).alias("sign")))).alias("s"))
    sums = [F.sum(F.col("v")[i].cast("long") * F.col("s.sign")).alias(f"c{i}") for i in range(size)]
    return sides.where("s.cluster >= 0").groupBy("s.cluster").agg(F.sum(F.col("s.sign").cast("long")).alias("n"), *sums).collect()


def cluster_vectors(spark: SparkSession, vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE,
                    id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every kept vector; the final centroids)."""
    kept = vectors.where(usable(F.col(vector_col), size)).select(F.col(id_col).alias("vec_id"), integer_vector(F.col(vector_col)).alias("v"))
    start = start_vectors(kept, clusters, seed)
    kind = vectors.schema[id_col].dataType
    out_schema = T.StructType([T.StructField("vec_id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not start:
        return spark.createDataFrame([], out_schema), np.zeros((0, size), np.int64)
    history = np.array([start], np.int64)
    schema = _STATE.format(id=kind.simpleString())
    counts, sums = [0] * len(start), [[0] * size for _ in start]
    state, path = kept.mapInArrow(_first_pass(history[0]), schema), None
    for _ in range(rounds):
        written = scratch(spark, "clusters")
        state.write.parquet(written)
        if path:
            drop_folder(spark, path)
        path, state = written, spark.read.parquet(written)
        centroids = history[-1].copy()
        for r in _moved_sums(state, size):
            counts[r["cluster"]] += r["n"]
            sums[r["cluster"]] = [a + r[f"c{i}"] for i, a in enumerate(sums[r["cluster"]])]
        for k, n in enumerate(counts):
            if n:
                centroids[k] = [s // n for s in sums[k]]
        history = np.concatenate([history, centroids[None]])
        state = state.mapInArrow(_next_pass(history), schema)
    written = scratch(spark, "clusters")
    state.select("vec_id", "v", "cluster").mapInArrow(_distances(history[-1]), out_schema).write.parquet(written)
    if path:
        drop_folder(spark, path)
    return spark.read.parquet(written), history[-1]


def cluster_report(spark: SparkSession, vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    rows, centroids = cluster_vectors(spark, vectors, **options)
    shas = spark.createDataFrame([(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())],
                                 "cluster int, centroid_sha256 string")
    inertia = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))
    as_long = lambda c: F.expr(f"try_cast({c} AS bigint)")
    whole = inertia.agg(F.sum("part").alias("whole")).scalar()
    per_cluster = inertia.join(shas, "cluster").withColumn("whole", whole).select(
        "cluster", as_long("part").alias("cluster_inertia"), as_long("whole").alias("inertia"), "centroid_sha256")
    # one row per cluster: its size is a parameter
    return rows.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
