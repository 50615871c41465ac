import math
import mmap
import random
import re
import zlib
from collections import Counter

import numpy as np

from bizlens.llm import ngram_trie as nt


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1, 10**9), (50, 60), (1000, 10**6), (5000, 2**40), (70_000, 80_000)):
        v = np.sort(rng.integers(0, top, n))
        if n > 100:
            v[10:60] = v[10]
            v.sort()
        ef = nt.EliasFano.build(v)
        if n:
            assert np.array_equal(ef.access(np.arange(n)), v)
            x = np.concatenate([v, v + 1, rng.integers(0, top + 5, 500), [0, top + 7]])
            at, found = ef.successor(x)
            assert np.array_equal(at, np.searchsorted(v, x)) and np.array_equal(found, np.isin(x, v))


def test_mapped_file(tmp_path):
    """A trie is read in place from a mapped file."""
    first, levels = np.array([3, 9, 12]), [(np.array([0, 0, 2]), np.array([1, 7, 7]), np.array([2, 1, 5])), (np.array([1, 2, 2]), np.array([4, 0, 9]), np.array([1, 2, 3]))]
    (tmp_path / "trie").write_bytes(nt.Trie.build(first, np.array([3, 4, 5]), levels))
    with open(tmp_path / "trie", "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as buffer:
        trie = nt.Trie(3, nt.mapped_arrays(buffer))
        assert trie.first(np.array([3, 4, 9, 12, 99])).tolist() == [0, -1, 1, 2, -1]
        assert trie.children(0, np.array([-1, 0, 0, 0, 1, 2, 2]), np.array([1, 1, 7, 8, 7, 7, 6])).tolist() == [-1, 0, 1, -1, -1, 2, -1]
        assert trie.children(1, np.array([0, 1, 2, 2, 2]), np.array([4, 4, 0, 4, 9])).tolist() == [-1, 0, 1, -1, 2]
        del trie


def plain_scores(rows, order, prior):
    """The model over dictionaries of word tuples."""
    cut = [[w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] + ["\n"] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    count, behind, single = Counter(), Counter(), Counter()
    for words, h in zip(cut, held):
        if not h:
            single.update(words)
            for n in range(2, order + 1):
                for i in range(n - 2, len(words)):
                    context = tuple(words[max(0, i - n + 1):i]) if i >= n - 1 else ("", *words[:i])
                    count[context, words[i]] += 1
                    behind[context] += 1
    total, distinct = sum(single.values()), len(single)

    def p(words, i, n):
        if n == 1:
            return (single[words[i]] + 0.5) / (total + 0.5 * (distinct + 1))
        if i < n - 2:
            return p(words, i, n - 1)
        context = tuple(words[max(0, i - n + 1):i]) if i >= n - 1 else ("", *words[:i])
        lower, m = p(words, i, n - 1), prior[min(n - 2, len(prior) - 1)]
        if not behind[context]:
            return lower
        down = lambda x: 10 ** (-math.ceil(-math.log10(x) * nt.STEPS - 1e-9) / nt.STEPS) if x > 0 else 0.0
        return down(count[context, words[i]] / (behind[context] + m)) + down(m / (behind[context] + m)) * lower

    out = []
    for (i, _), words, h in zip(rows, cut, held):
        base = sum(math.log10(p(words, k, 1)) for k in range(len(words)))
        out.append((i, h, len(words), sum(single[w] > 0 for w in words), total, round(base, 6), round(sum(math.log10(p(words, k, order)) for k in range(len(words))), 6)))
    vocabulary = [*single, "never seen"]
    for words in cut[:6]:
        for k in (0, len(words) // 2, len(words) - 1):
            assert 0.85 < sum(p([*words[:k], w], k, order) for w in vocabulary) <= 1 + 1e-9
    return sorted(out, key=str)


def rounded(df):
    return sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in df.collect()), key=str)


def test_scores(spark, docs):
    rng = random.Random(4)
    words = ["The", "a", "of", "Étude", "x-y", "ÀB", "tail", "à", "Å", "…", "\x85", "\u2003", "\x1cq", "u v", *[f"w{i}" for i in range(40)]]
    rows = [(i, "".join(rng.choice(words[:rng.choice([4, 49])]) + rng.choice([" ", "  ", "\n", "\t\x0b", "\r\n"]) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n"), (None, "the a of"), (3, "the a"), (3, "the a"), (503, "the " * 500), (504, "only here " * 3), (506, "new words all around")]
    df = spark.createDataFrame([(i, t, "1", 2) for i, t in rows], "doc_id long, text string, block string, count int")
    for options in ({}, {"block_tokens": 60, "shards": 3}, {"order": 2, "block_tokens": 1}, {"order": 4, "prior": (3.0, 2.0, 1.0), "shards": 1}):
        got = nt.score_documents(df.repartition(3), **options)
        assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        assert rounded(got) == plain_scores(rows, options.get("order", nt.ORDER), options.get("prior", nt.PRIOR))
    assert nt.score_documents(df.limit(0)).count() == 0
    assert rounded(nt.score_documents(docs)) == plain_scores([(r["doc_id"], r["text"]) for r in docs.collect()], nt.ORDER, nt.PRIOR)
    nobody = nt.score_documents(df, held=df["doc_id"].isNull() | df["doc_id"].isNotNull()).collect()
    assert {(r["train_tokens"], r["n_known"], r["score"]) for r in nobody} == {(0, 0, 0.0)}


def test_tries_hold_the_training_ngrams(spark):
    df = spark.createDataFrame([(i, "a b a b c") for i in range(5)], "doc_id long, text string")
    model = nt.corpus_model(df, shards=2)
    tries = [nt.Trie(3, nt.mapped_arrays(r["trie"])) for r in model.tries().collect()]
    assert sum(t.keys[1].size for t in tries) == 5 and sum(t.keys[2].size for t in tries) == 5  # .a ab ba bc c. and .ab aba bab abc bc.


def test_better_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = nt.score_documents(docs).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > 0.97 * got["sum(base_score)"]


def test_tries_of_packed_widths_are_the_same():
    words = np.array([0, 2, 300]), np.array([5, 70_000, 9]), np.array([1, 2, 1]), np.array([2, 4, 2**31, 5]), np.array([1, 0, 3, 300])
    blobs = [nt.pack(list(words)), nt.pack([a.copy() for a in words])]
    narrow = [nt.unpack(b, False) for b in blobs]
    assert [a.itemsize for a in narrow[0]] == [2, 4, 1, 4, 2]
    assert nt.build_trie(narrow) == nt.build_trie([nt.unpack(b) for b in blobs])
