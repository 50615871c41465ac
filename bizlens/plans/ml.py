"""Registered feature-preparation, projection, clustering and isolation-forest
queries; DuckDB oracles where SQL can express the result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from bizlens.operators.common import materialize
from bizlens.operators.ml import balls, cluster, explain, iforest, kmeans
from bizlens.operators.ml import neighbors as nb
from bizlens.operators.ml.prep import KEY, bounded_sample, numeric_matrix, scale
from bizlens.plans.oracle import with_views as W
from bizlens.plans.registry import register
from bizlens.sources import views

MATRIX_COLS = ["l_orderkey", "l_linenumber", "quantity", "amount", "gross", "discount", "tax"]
EXPLAIN_COLS = ["quantity", "amount", "gross", "discount", "tax"]
EPS = 1.2
DIGITS = 9


def _matrix_sql() -> str:
    parts = [f"CAST({c} AS DOUBLE) AS {c}" for c in MATRIX_COLS if c != "tax"]
    parts.append("coalesce(tax, (SELECT quantile_cont(tax, 0.5) FROM numeric_mix)) AS tax")
    return W("numeric_mix") + ",\nm AS (SELECT " + ", ".join(parts) + " FROM numeric_mix)\n"


@register("ml_matrix", _matrix_sql() + "SELECT * FROM m")
def q_ml_matrix(spark, sf):
    return numeric_matrix(views.numeric_mix(spark, sf)).df.drop(KEY)


@register("ml_scaled", _matrix_sql() + "SELECT " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM m)) / (SELECT stddev_pop({c}) FROM m), {DIGITS}) AS {c}" for c in MATRIX_COLS) + " FROM m")
def q_ml_scaled(spark, sf):
    m = numeric_matrix(views.numeric_mix(spark, sf))
    s = scale(m.df, m.columns)
    return s.select(*[F.round(c, DIGITS).alias(c) for c in m.columns])


@register("ml_sample")
def q_ml_sample(spark, sf):
    m = numeric_matrix(views.numeric_mix(spark, sf))
    return bounded_sample(m.df).select("sample_id", *m.columns)


@register("pca_2d")
def q_pca_2d(spark, sf):
    prep = cluster.prepare(views.numeric_mix(spark, sf))
    proj, _ = cluster.pca_2d(prep.scaled, prep.columns)
    return proj.select(F.col(KEY).getField("h1").alias("row_id"), "pc1", "pc2")


@register("pca_variance")
def q_pca_variance(spark, sf):
    prep = cluster.prepare(views.numeric_mix(spark, sf))
    _, ratios = cluster.pca_2d(prep.scaled, prep.columns)
    return spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(ratios)], "component int, ratio double")


@register("kmeans_best_k")
def q_kmeans_best_k(spark, sf):
    prep = cluster.prepare(views.numeric_mix(spark, sf))
    res = cluster.kmeans_best_k(cluster.numbered(prep.scaled))
    rows = [(k, s, k == res.k) for k, s in sorted(res.scores.items())]
    return spark.createDataFrame(rows, "k int, silhouette double, chosen boolean")


def _embedding_points(spark, sf):
    return nb.to_points(views.table(spark, sf, "embeddings"), "vec_id", F.col("embedding"))


EMB_SQL = """
WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, list_distance(a.v, b.v) AS dist FROM p a, p b)"""


@register("knn_distance", EMB_SQL + """,
r AS (SELECT vec_id, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist) AS rn FROM d),
k AS (SELECT greatest(5, CAST(floor(ln(count(*))) AS INTEGER)) AS k FROM p)
SELECT vec_id AS id, round(dist, 9) AS kth_distance FROM r WHERE rn = (SELECT k FROM k)""")
def q_knn_distance(spark, sf):
    """Exact k-distance (k = max(5, int(ln n)), self included) of every embedding, whole table."""
    points = _embedding_points(spark, sf)
    k = nb.min_samples_for(points.count())
    out = balls.kth_distance(points, k)
    return out.withColumn("kth_distance", F.round("kth_distance", DIGITS))


@register("eps_neighbor_counts", EMB_SQL + f"""
SELECT vec_id AS id, count(*) AS neighbors FROM d WHERE dist <= {EPS} GROUP BY vec_id""")
def q_eps_neighbor_counts(spark, sf):
    """Exact eps-neighbour counts over the whole embeddings table (distributed ball tree)."""
    points = nb.to_points(views.table(spark, sf, "embeddings"), "vec_id", F.col("embedding"))
    return balls.eps_neighbor_counts(points, EPS)


@register("dbscan_labels")
def q_dbscan_labels(spark, sf):
    """DBSCAN over the whole embeddings table, eps from the k-distance of all its rows."""
    points = _embedding_points(spark, sf)
    return balls.dbscan(points, *nb.choose_eps(points))


DBSCAN_EPS, DBSCAN_MIN = 1.1, 4


@register("dbscan_fixed", f"""
WITH RECURSIVE p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (SELECT x.vec_id AS a, y.vec_id AS b FROM p x JOIN p y ON list_distance(x.v, y.v) <= {DBSCAN_EPS}),
core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= {DBSCAN_MIN}),
linked AS (SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
reach(a, b) AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
members AS (
  SELECT a AS id, min(b) AS component, true AS is_core FROM reach GROUP BY a
  UNION ALL
  SELECT n.a, min(r.b), false FROM near n JOIN reach r ON n.b = r.a WHERE n.a NOT IN (SELECT a FROM core) GROUP BY n.a)
SELECT p.vec_id AS id, coalesce(dense_rank() OVER (PARTITION BY component IS NULL ORDER BY component) - 1, -1) * CASE WHEN component IS NULL THEN 0 ELSE 1 END
         - CASE WHEN component IS NULL THEN 1 ELSE 0 END AS label, coalesce(is_core, false) AS is_core
FROM p LEFT JOIN members m ON m.id = p.vec_id""")
def q_dbscan_fixed(spark, sf):
    """DBSCAN at a fixed radius over the whole embeddings table."""
    return balls.dbscan(_embedding_points(spark, sf), DBSCAN_EPS, DBSCAN_MIN)


@register("silhouette_labels", EMB_SQL + """,
sizes AS (SELECT label, count(*) AS n FROM p GROUP BY label),
m AS (SELECT vec_id, la, lb, sum(dist * dist) AS s FROM d WHERE vec_id IS NOT NULL GROUP BY 1, 2, 3),
per AS (SELECT m.vec_id, m.la,
               max(CASE WHEN m.lb = m.la THEN m.s / greatest(sl.n - 1, 1) END) AS a,
               min(CASE WHEN m.lb <> m.la THEN m.s / so.n END) AS b,
               max(sl.n) AS own_n
        FROM m JOIN sizes sl ON sl.label = m.la JOIN sizes so ON so.label = m.lb GROUP BY 1, 2),
sc AS (SELECT CASE WHEN own_n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END AS s FROM per)
SELECT CASE WHEN (SELECT count(*) FROM sizes) BETWEEN 2 AND (SELECT count(*) FROM p) - 1
            THEN round(avg(s), 9) END AS silhouette FROM sc""")
def q_silhouette_labels(spark, sf):
    e = views.table(spark, sf, "embeddings")
    points = e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    return nb.silhouette(points).select(F.round("silhouette", DIGITS).alias("silhouette"))


# fixed centres in (quantity, discount in percent) for several k
FIXED_CENTRES = {2: [(10, 2), (40, 8)], 3: [(10, 5), (25, 5), (40, 5)], 4: [(5, 1), (20, 9), (33, 3), (48, 7)]}


@register("kmeans_fixed", W("numeric_mix") + f""",
p AS (SELECT row_number() OVER () AS id, CAST(quantity AS DOUBLE) AS x, round(CAST(discount AS DOUBLE) * 100) AS y FROM numeric_mix),
c(k, centre, cx, cy) AS (VALUES {", ".join(f"({k}, {j}, {x}.0, {y}.0)" for k, cs in FIXED_CENTRES.items() for j, (x, y) in enumerate(cs))}),
a AS (SELECT id, k, x, y, min(struct_pack(d := (x - cx) ** 2 + (y - cy) ** 2, centre := centre)) AS near FROM p, c GROUP BY ALL),
s AS (SELECT k, near.centre AS centre, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) + var_pop(y) AS v, sum(near.d) AS inertia FROM a GROUP BY ALL),
d AS (SELECT a.id, a.k, s.n, s.centre = a.near.centre AS own, (x - mx) ** 2 + (y - my) ** 2 + v AS far FROM a JOIN s ON a.k = s.k),
e AS (SELECT id, k, max(CASE WHEN own THEN far * n / greatest(n - 1, 1) END) AS o, min(CASE WHEN NOT own THEN far END) AS b, max(CASE WHEN own THEN n END) AS n FROM d GROUP BY ALL),
t AS (SELECT k, avg(CASE WHEN n > 1 AND greatest(o, b) > 0 THEN (b - o) / greatest(o, b) ELSE 0 END) AS silhouette FROM e GROUP BY k)
SELECT s.k, s.centre, s.n, round(s.inertia, 4) AS inertia, round(t.silhouette, 8) AS silhouette FROM s JOIN t ON s.k = t.k""")
def q_kmeans_fixed(spark, sf):
    """Sizes, squared distances and silhouettes that fixed centres of several k give, in two passes."""
    items = views.numeric_mix(spark, sf)
    vec = F.array(F.col("quantity").cast("double"), F.round(F.col("discount").cast("double") * 100))
    points = items.select(F.monotonically_increasing_id().alias("id"), vec.alias("vec"))
    fits = kmeans.evaluate(points, {k: np.array(c, dtype=float) for k, c in FIXED_CENTRES.items()})
    rows = [(k, j, int(f.sizes[j]), float(f.distances[j]), f.silhouette) for k, f in fits.items() for j in range(k) if f.sizes[j]]
    got = spark.createDataFrame(rows, "k int, centre int, n long, inertia double, silhouette double")
    return got.select("k", "centre", "n", F.round("inertia", 4).alias("inertia"), F.round("silhouette", 8).alias("silhouette"))


@register("cluster_auto")
def q_cluster_auto(spark, sf):
    prep = cluster.prepare(views.numeric_mix(spark, sf))
    res = cluster.choose_clustering(cluster.numbered(prep.scaled))
    return spark.createDataFrame(
        [(res.method, int(res.k), int(res.noise), res.silhouette, res.message, False)],
        "method string, k int, noise int, silhouette double, message string, sampled boolean",
    )


def _explain_sql() -> str:
    long = " UNION ALL ".join(
        f"SELECT segment AS cluster, {i} AS ordinal, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM numeric_mix"
        for i, c in enumerate(EXPLAIN_COLS))
    return W("numeric_mix") + f""",
long AS ({long}),
per AS (SELECT cluster, ordinal, feature, sum(v) AS s, count(v) AS n FROM long GROUP BY 1, 2, 3),
overall AS (SELECT ordinal, feature, sum(s) / sum(n) AS g FROM per GROUP BY 1, 2),
diffs AS (SELECT p.cluster, p.ordinal, p.feature, p.s / p.n - o.g AS diff FROM per p JOIN overall o USING (ordinal, feature)
          WHERE p.cluster IS NOT NULL AND CAST(p.cluster AS VARCHAR) <> '-1'),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY abs(diff) DESC NULLS LAST, ordinal) AS INTEGER) AS rank FROM diffs),
sizes AS (SELECT segment AS cluster, count(*) AS size FROM numeric_mix GROUP BY 1),
ex AS (SELECT s.cluster, s.size, s.size / (SELECT sum(size) FROM sizes) * 100.0 AS share, r.rank, r.feature, r.diff
       FROM sizes s LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r ON s.cluster = r.cluster
       WHERE s.cluster IS NOT NULL AND CAST(s.cluster AS VARCHAR) <> '-1')"""


def _explained(spark, sf):
    return explain.explain_clusters(views.numeric_mix(spark, sf), "segment", EXPLAIN_COLS, noise_label="-1")


@register("cluster_explain", _explain_sql() + "\nSELECT cluster, size, share, rank, feature, round(diff, 6) AS diff FROM ex")
def q_cluster_explain(spark, sf):
    return _explained(spark, sf).withColumn("diff", F.round("diff", 6))


@register("cluster_hints", _explain_sql() + """,
hp AS (SELECT cluster, size, share,
               arg_min(feature, rank) AS lead_feature, arg_min(diff, rank) AS lead_diff,
               bool_or(lower(feature) LIKE '%revenue%' OR lower(feature) LIKE '%выруч%') AS has_revenue,
               bool_or((lower(feature) LIKE '%quantity%' OR lower(feature) LIKE '%колич%') AND diff < 0) AS low_quantity
        FROM ex GROUP BY 1, 2, 3),
lines AS (
  SELECT cluster, 0 AS line, CASE WHEN lead_feature IS NULL
      THEN printf('Кластер %s: группа из %d объектов (%.1f%%), без ярко выраженных отличий по числовым признакам.', CAST(cluster AS VARCHAR), size, share)
      ELSE printf('Кластер %s: группа из %d объектов (%.1f%%), похоже, отличается %s значениями по признаку %s.', CAST(cluster AS VARCHAR), size, share,
                  CASE WHEN lead_diff > 0 THEN 'высокими' ELSE 'низкими' END, lead_feature) END AS text FROM hp
  UNION ALL SELECT cluster, 1, 'Проверьте этот сегмент на бизнес-смысл перед принятием решений.' FROM hp
  UNION ALL SELECT cluster, 2, 'Если выручка выше среднего, сегмент можно рассматривать как приоритетный.' FROM hp WHERE coalesce(has_revenue, false)
  UNION ALL SELECT cluster, 3, 'Небольшой и сильно отличающийся сегмент может быть нишевым или аномальным.' FROM hp WHERE share < 5
  UNION ALL SELECT cluster, 4, 'Проверьте причины низкой активности сегмента.' FROM hp WHERE coalesce(low_quantity, false))
SELECT cluster, line, text FROM lines""")
def q_cluster_hints(spark, sf):
    return explain.cluster_hints(_explained(spark, sf))


@register("map_diagnostics", W("numeric_mix") + f""",
c AS (SELECT avg(quantity) AS cx, avg(discount) AS cy FROM numeric_mix),
d AS (SELECT sqrt((quantity - cx) * (quantity - cx) + (discount - cy) * (discount - cy)) AS d FROM numeric_mix, c),
t AS (SELECT avg(d) + 2 * stddev_pop(d) AS cut, quantile_cont(d, 0.5) AS spread FROM d)
SELECT round(spread, {DIGITS}) AS spread, avg(CASE WHEN d > cut THEN 1.0 ELSE 0.0 END) AS high_share, spread < 2 AS compact,
       avg(CASE WHEN d > cut THEN 1.0 ELSE 0.0 END) > 0.03 AS has_outliers, count(*) AS n
FROM d, t GROUP BY spread, cut""")
def q_map_diagnostics(spark, sf):
    mix = views.numeric_mix(spark, sf)
    out = cluster.map_diagnostics(mix, "quantity", "discount")
    return out.withColumn("spread", F.round("spread", DIGITS))


@register("map_grouped")
def q_map_grouped(spark, sf):
    prep = cluster.prepare(views.numeric_mix(spark, sf))
    proj, _ = cluster.pca_2d(prep.scaled, prep.columns)
    proj = materialize(proj.select("pc1", "pc2"))
    grouped = cluster.looks_grouped(proj, "pc1", "pc2")
    diag = cluster.map_diagnostics(proj, "pc1", "pc2")
    return diag.select("*", F.lit(grouped).alias("grouped"))


@register("anomaly_isolation_forest")
def q_anomaly_isolation_forest(spark, sf):
    out = iforest.isolation_forest(views.numeric_mix(spark, sf))
    return out.select(F.col(KEY).getField("h1").alias("row_id"), *[c for c in out.columns if c != KEY])
