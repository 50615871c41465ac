import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from bizlens.llm import components, embedding_tiles, exact_stream, mixing, sharding, url_rules


def test_exact_stream(spark, stored):
    path = f"{stored}/documents.parquet"
    for options in ({}, {"files_per_batch": 1}, {"digest": lambda t: F.substring(exact_stream.sha256(t), 1, 1)}):
        rows = exact_stream.streaming_dedup(spark, path, **options).collect()
        groups = defaultdict(list)
        for r in spark.read.parquet(path).collect():
            groups[r["text"] or ""].append(r["doc_id"])
        assert len(rows) == 14
        want = {d: (max(x for x in g if x is not None) if any(x is not None for x in g) else None, len(g)) for g in groups.values() for d in g}
        assert all((r["keep_id"], r["group_size"]) == want[r["doc_id"]] for r in rows)
        assert sum(r["kept"] for r in rows) == len(groups)
    spark.read.parquet(path).limit(0).write.parquet(f"{stored}/none.parquet")
    assert exact_stream.streaming_dedup(spark, f"{stored}/none.parquet").count() == 0


def test_shards(spark, docs):
    rows = sharding.shard_documents(docs, 5).collect()
    assert len(rows) == 14
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 5)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    one = {r["doc_id"]: r for r in rows}
    assert one[7]["size"] == 16 and one[11]["size"] == 20 and one[11]["text_crc32"] == zlib.crc32(b"kurz")
    assert sharding.shard_documents(docs.limit(0), 5).count() == 0
    many = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    heavy = Counter(r["shard"] for r in sharding.shard_documents(many, 4, [1, 1, 1, 3]).collect())
    assert abs(heavy[3] / 40_000 - 0.5) < 0.02
    moved = sharding.shard_documents(many, 9).where("grown_shard <> shard")
    assert moved.where("grown_shard <> 9").count() == 0 and abs(moved.count() / 40_000 - 0.1) < 0.02


def test_url_rules(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/fr/"), ("block", "b.net", "/")]
    hosts = ["example.com", "WWW.Example.com", "x.www.example.com", "notexample.com", "a.net", "a.b.net", "com", "", "b.net:80", "u@b.net"]
    paths = ["", "/", "/en/", "/en", "/fr/x", "?/en/", "#a", "/fr/?q://z/en/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "a://b://c/d", "x\n://example.com/en/y"]
    pages = spark.createDataFrame(list(enumerate([*urls, urls[0]])), "page_id long, url string")

    def judge(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fit = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best and best[3], best[2] if best else "allow"

    got = url_rules.apply_rules(pages, url_rules.rule_table(spark, rules)).collect()
    assert len(got) == len(urls) + 1
    assert all((r["host"], r["path"], r["rule"], r["verdict"]) == judge([*urls, urls[0]][r["page_id"]]) for r in got)
    none = url_rules.apply_rules(pages, url_rules.rule_table(spark, rules).limit(0), default="block").collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "block")}
    assert url_rules.apply_rules(pages.limit(0), url_rules.rule_table(spark, rules)).count() == 0


def _targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing(spark, docs):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 30))), rng.choice(["a"] * 5 + ["b", "c", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_plan(df).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = _targets(dict(sizes), (5, 2, 1), 3)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]] + 1e-6
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    assert sorted(map(tuple, mixing.mix_plan(df.repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)
    mixed = mixing.mix_documents(df.withColumn("times", F.lit("mine")))
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == ["doc_id", "text", "source", "times"] and times == Counter({r["doc_id"]: r["times"] for r in got if r["times"]})
    edge = mixing.mix_plan(docs)
    assert edge.count() == 14 and edge.where("size = 0 and taken > 0").count() == 0
    assert mixing.mix_plan(docs.limit(0)).count() == 0


def test_mixing_splits_hot_ids(spark):
    rng = random.Random(7)
    texts = [" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    unlike = [(None, t, s) for t, s in zip(texts, ["a", "b"] * 200)] + [(i, t, s) for i, (t, s) in enumerate(zip(texts, ["a", "b"] * 200))]
    alike = [(5, "one two three", "a")] * 500 + [(i, "one two three", "b") for i in range(10, 300)] + [(None, None, "c")] * 40
    for rows in (unlike, alike):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
        got = mixing.mix_plan(df).collect()
        assert len(got) == len(rows)
        taken, target = Counter(), {}
        for r in got:
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
            assert r["taken"] <= 3 * r["size"]
        assert all(abs(taken[s] - target[s]) <= 30 for s in target)
        mixed = Counter(r["source"] for r in mixing.mix_documents(df).collect())
        assert mixed == Counter({s: n for s in target if (n := sum(r["times"] for r in got if r["source"] == s))})


def _path(n, order):
    return [(order[i], order[i + 1]) for i in range(n - 1)]


def test_components(spark):
    shuffled = list(range(300))
    random.Random(4).shuffle(shuffled)
    for order in (shuffled, [*range(1, 300), 0]):
        got = components.connected_components(spark.createDataFrame(_path(300, order), "a long, b long")).collect()
        assert len(got) == 300 and {r["component"] for r in got} == {0}
    star = spark.createDataFrame([(1, 2), (2, 1), (5, 5), (7, 9), (9, 8)], "a long, b long")
    assert {r["node"]: r["component"] for r in components.connected_components(star).collect()} == {1: 1, 2: 1, 5: 5, 7: 7, 8: 7, 9: 7}
    assert components.connected_components(star.limit(0)).count() == 0


def test_embedding_tiles(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[rng.integers(12)] + rng.normal(scale=0.25, size=16)).tolist(), int(rng.integers(3))) for i in range(300)]
    rows += [(400 + i, rows[i][1], rows[i][2]) for i in range(20)] + [(420 + i, [2.0 * x for x in rows[i][1]], rows[i][2]) for i in range(5)]
    odd = [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [None] + [1.0] * 15, 1), (504, [float("nan")] * 16, 1),
           (505, [float("inf")] + [0.0] * 15, 1), (506, rows[0][1], None), (507, [1e200] * 16, 2), (508, [1e200] * 16, 2), (509, [1.0] * 3, 2)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    usable = [r for r in rows] + [(507, [1.0] * 16, 2), (508, [1.0] * 16, 2)]
    x = np.array([r[1] for r in usable])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([r[2] for r in usable])
    linked = (x @ x.T >= 0.93) & (labels[:, None] == labels[None, :]) & ~np.eye(len(x), dtype=bool)
    comp = [r[0] for r in usable]
    for i, j in zip(*np.nonzero(linked)):
        a, b = sorted((comp[i], comp[j]))
        comp = [a if c == b else c for c in comp]
    want = {r[0]: (int(linked[i].sum()), comp[i]) for i, r in enumerate(usable)}
    for block in (1024, 16):
        got = {r["vec_id"]: r for r in embedding_tiles.near_vectors(df, block=block).collect()}
        assert len(got) == len(rows) + len(odd)
        for v, r in got.items():
            assert (r["n_links"], r["component_id"]) == want.get(v, (0, v)), v
            assert r["kept"] == (r["component_id"] == v)
    assert embedding_tiles.near_vectors(df.limit(0)).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(8)
    a, b = (embedding_tiles.unit_rows(rng.normal(size=(200, 24))) for _ in range(2))
    (qa, sa, ea), (qb, sb, eb) = embedding_tiles.quantise(a), embedding_tiles.quantise(b)
    approx = (qa.astype(float) @ qb.astype(float).T) * sa[:, None] * sb[None, :]
    assert np.all(np.abs(a @ b.T - approx) <= ea[:, None] + (1 + ea)[:, None] * eb[None, :] + 1e-12)
