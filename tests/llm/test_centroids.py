import hashlib
import math
import random

import numpy as np

from bizlens.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, v string"


def lloyd(rows, clusters, rounds, size):
    """Plain rounds in Python integers: [(id, vector, cluster, distance)] and the centroids."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in start[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), k) for k, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for k in range(len(c)):
            own = [v for (_, v), a in zip(kept, at) if a == k]
            if own:
                c[k] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, *reversed(near(v))) for i, v in kept], c


def table(n, size, seed, spread):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        centre = rng.randrange(6)
        rows.append((i, [centre * spread + rng.gauss(0, 0.3) for _ in range(size)]))
    return rows


def test_against_plain_rounds(spark):
    for seed, spread, rounds in ((1, 0.4, 5), (2, 0.0, 7), (3, 5.0, 3), (4, 0.4, 0)):
        rows = table(400, 5, seed, spread)
        rows += [(1000 + i, [0.25, 0.5, -0.25, 0.0, 1.0]) for i in range(60)]  # ties and copies
        rows += [(7, rows[7][1]), (None, rows[3][1]), (2000, None), (2001, [1.0]), (2002, [1.0, None, 0.0, 0.0, 0.0]),
                 (2003, [float("nan")] * 5), (2004, [float("inf")] * 5), (2005, [])]
        df = spark.createDataFrame([(i, v, None, "mine", None) for i, v in rows], SCHEMA)
        got, c = centroids.cluster_vectors(spark, df.repartition(3), clusters=9, rounds=rounds, size=5)
        want, want_c = lloyd(rows, 9, rounds, 5)
        assert c.tolist() == want_c
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        report = centroids.cluster_report(spark, df, clusters=9, rounds=rounds, size=5).collect()
        assert len(report) == len(want) and {r["inertia"] for r in report} == {sum(w[2] for w in want)}
        for r in report:
            assert r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"])
            assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, want_c[r["cluster"]])).encode()).hexdigest()


def test_edges(spark):
    df = spark.createDataFrame([(1, [0.5, 2.0], None, "a", None), (1, [0.5, 2.0], None, "a", None)], SCHEMA)
    assert [(r["cluster"], r["distance"]) for r in centroids.cluster_report(spark, df, size=2).collect()] == [(0, 0)] * 2
    assert centroids.cluster_report(spark, df.limit(0), size=2).count() == 0
    assert centroids.cluster_report(spark, df, size=3).count() == 0
    far = spark.createDataFrame([(i, [1e30 if i % 2 else -1e30, 5e5], None, "a", None) for i in range(9)], SCHEMA)
    got = centroids.cluster_report(spark, far, size=2, clusters=1).collect()
    assert len(got) == 9 and min(r["distance"] for r in got) > 0


def test_bounds_save_distances():
    """Loosened bounds never decide wrongly and leave most distances unevaluated."""
    rng = np.random.default_rng(5)
    v = np.floor(256 * (rng.normal(0, 0.05, (3000, 16)) + rng.integers(0, 12, (3000, 1)))).astype(np.int64)
    history = v[rng.permutation(3000)[:20]][None]
    cluster, upper, lower = centroids.first_assignment(v, history[0])
    seen, rounds, evaluated = np.zeros(3000, np.int32), np.zeros((3000, 20), np.int16), 0
    for _ in range(6):
        c = history[-1].copy()
        for k in range(20):
            if (cluster == k).any():
                c[k] = v[cluster == k].sum(0) // (cluster == k).sum()
        history = np.concatenate([history, c[None]])
        cluster, upper, seen, lower, rounds, n = centroids.reassign(v, cluster, upper, seen, lower, rounds, history)
        evaluated += n
        assert np.array_equal(cluster, centroids.all_squared_distances(v, c).argmin(1))
    assert evaluated < 0.25 * 6 * v.shape[0] * 20


def test_large_integers_are_exact():
    rng = np.random.default_rng(6)
    v = rng.integers(-centroids.LIMIT, centroids.LIMIT, (50, 64))
    c = rng.integers(-centroids.LIMIT, centroids.LIMIT, (7, 64))
    got = centroids.all_squared_distances(v, c)
    assert all(int(got[i, k]) == sum((int(a) - int(b)) ** 2 for a, b in zip(v[i], c[k])) for i in range(50) for k in range(7))
