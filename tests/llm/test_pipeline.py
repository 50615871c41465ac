"""The pipeline's stages one after the other, each against plain Python over its own input."""

from collections import Counter

import corpus_pipeline
from bizlens.llm import langid, order_minhash, pieces


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        before, after = docs.collect(), out.collect()
        if name == "language_id":
            model = langid.Predictor(langid.train(docs))
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if model.predict(r["text"])[0] != "und" and model.predict(r["text"])[1] >= 0.5}
        elif name == "line_dedup":
            old = {r["doc_id"]: r["text"] for r in before}
            assert all(set(r["text"].split("\n")) <= set(old[r["doc_id"]].split("\n")) for r in after)
            lines = {x.strip() for t in old.values() for x in t.split("\n")}
            assert lines == {x.strip() for r in after for x in r["text"].split("\n")} | ({""} & lines)
        elif name == "near_dedup":
            hashes = order_minhash._WordHashes()
            shapes = [order_minhash.short_kmers(r["text"], hashes) for r in after]
            assert not any(order_minhash.aligned_similarity(a, b) >= 0.8 for k, a in enumerate(shapes) for b in shapes[:k])
        elif name == "source_mix":
            assert max(Counter(r["doc_id"] for r in after).values()) <= 3 and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
        else:
            encoder = pieces.ChunkEncoder(pieces.default_model())
            want = Counter((r["doc_id"], len(encoder.model.encode(r["text"]))) for r in before)
            assert Counter((r["doc_id"], r["n_tokens"]) for r in after) == want
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        docs = out
