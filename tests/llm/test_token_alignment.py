import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from bizlens.llm import token_alignment as ta


def plain_merge(a, b):
    """Overlaps and groups by holding all pairs of tokens."""
    links = []
    start_b = [0, *b]
    for i, end in enumerate(a):
        start = a[i - 1] if i else 0
        for j in range(len(b)):
            if max(start, start_b[j]) < min(end, b[j]):
                links.append((i, j, sum(1 for x in a if x in b and x <= max(start, start_b[j]))))
    return sorted(links, key=lambda x: (min(a[x[0]], b[x[1]]), x[0]))


def test_merge_path():
    rng = random.Random(1)
    for n in range(200):
        size = rng.randint(1, 60)
        a, b = (sorted({size, *rng.sample(range(1, size + 1), rng.randint(0, size))}) for _ in "ab")
        for piece in (1, 2, 3, 7, 300):
            got = ta.merge_overlaps(np.array(a), np.array(b), piece)
            assert list(zip(*(x.tolist() for x in got))) == plain_merge(a, b), (a, b, piece)


def plain_rows(rows):
    """Whole texts through both libraries, all links in Python."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    symbols = ta.byte_of_symbol()
    docs, count = [], Counter()
    for doc_id, text in rows:
        links, groups, ids_a, ids_b = [], [], [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(symbols[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            whole = (" " + text).encode()
            if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
                ids_a, ids_b = [], []
            else:
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                i = j = at = 0
                open_a, open_b = [0], [0]
                while i < len(ends_a):
                    links.append((ids_a[i], ids_b[j]))
                    at = min(ends_a[i], ends_b[j])
                    di, dj = ends_a[i] == at, ends_b[j] == at
                    i, j = i + di, j + dj
                    if di and dj:
                        groups.append((ids_a[open_a[-1]:i], ids_b[open_b[-1]:j]))
                        open_a.append(i)
                        open_b.append(j)
        count.update(links)
        docs.append((doc_id, ids_a, ids_b, groups, links))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for doc_id, ids_a, ids_b, groups, links in docs:
        joined = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(ids_a), len(ids_b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(joined.encode()).hexdigest() if groups else ""))
    return out


def texts():
    rng = random.Random(3)
    alphabet = ["a", "the", "don't", "’s", "été", "über", "ß", "汉字", "เท", "👍🏽", " ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", " ", "　", " ", "\x0b", "\x1c",
                "\x85", " ", ".", "...", "!!", "12", "3456", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "ﬁ", "é", "_", "A", "supercalifragilistic", "​", "½"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    return [None, "", " ", "\n", "  \n ", " x", "x ", "x  ", "▁", "a▁b", "\x00", "a\x00b", "word " * 3000, "z" * 3000, "aé" * 2000, *made]


def test_documents(spark, docs):
    rows = list(enumerate(texts())) + [(5, "x same"), (5, "x same"), (None, "the end")]
    df = spark.createDataFrame([(i, t, "1", 2) for i, t in rows], "doc_id long, text string, row string, n_a int")
    want = sorted(plain_rows(rows), key=str)
    for limit in (ta.BROADCAST_PAIRS, 0):
        got = ta.align_documents(df.repartition(3), broadcast_pairs=limit)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert ta.align_documents(df.limit(0), broadcast_pairs=limit).count() == 0
    assert sorted(map(tuple, ta.align_documents(docs).collect()), key=str) == sorted(plain_rows([(r["doc_id"], r["text"]) for r in docs.collect()]), key=str)


def test_parts_of_long_texts():
    """A text dealt with in parts, and merged by pieces of any size, has one result."""
    table = ta.segments_for(None, None)
    long_text = " ".join(t for t in texts() if t and "▁" not in t) * 3
    one = ta.align_texts(table, [long_text, "and more"])
    for part, piece in ((1, 5), (7, 64), (1000, 1)):
        for x, y in zip(one, ta.align_texts(table, [long_text, "and more"], part, piece)):
            assert (x.n_a, x.n_b, x.n_groups, x.n_links, x.sha.hexdigest()) == (y.n_a, y.n_b, y.n_groups, y.n_links, y.sha.hexdigest())
            assert [v.tolist() for v in x.pair_times()] == [v.tolist() for v in y.pair_times()]
    keys = np.array([3, 9, 2**40]), np.array([1, 70_000, 2])
    assert [v.tolist() for v in ta.unpack_pairs(ta.pack_pairs(*keys))] == [v.tolist() for v in keys]
