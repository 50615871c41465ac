"""Language-model scores from Elias-Fano n-gram tries.

Model: interpolated n-grams, p(w | context) = a + g * p(w | shorter context), with a = c / (C + m)
for an n-gram seen c times behind a context seen C times and g = m / (C + m); an unseen context has a = 0
and g = 1. The shortest is the base, (c + 0.5) / (N + 0.5 (V + 1)). For every context the probabilities
of all known words and of one unknown word sum to at most 1: a and g are rounded down to eight bits (a g below
1e-7.9 is rounded up to it, so nothing is impossible).

Method: n-grams of training documents are kept in tries. A level holds, per context, the increasing ids of its
successors; each context's ids are shifted by the last value of the context before it, so the level is one
monotone Elias-Fano sequence, and so are the pointers from a context to its successors. Eight-bit a and g
lie beside them. A trie is one flat run of bytes that is mapped in place (from a file or a row's buffer), never unpacked:
a query shifts the wanted id by its context's base and searches the successor of that value,
by one select of zeros and a binary search among the low bits of one bucket.

Work on Spark: texts become blocks of about ``BLOCK_TOKENS`` tokens, in a table bucketed by block, so that what
belongs to a block comes to it without moving it. A block's distinct words go to shards by their hash, which count
and number them. Each block sends its distinct n-grams, with the counts of its training documents, to
shards by the hash of their first two words (the successors of a hot word are so spread over all shards;
its own count travels along). A shard adds the counts up, builds its trie and answers every block's n-grams from it;
blocks turn the answers into scores. Everything that moves is per block and distinct n-gram.

Defined results: NULL text is empty (one token, the end); a NULL id counts as the empty text for the fold; equal rows are
scored alike and each counts in training; without training documents N is 0 and every word unknown; an empty table gives
no rows. A vocabulary of 2^32 words or more is an error.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.llm.common import materialize, scratch

ORDER = 3
#: m of the formula, per order from 2 on (the last one is used beyond).
PRIOR = (300.0, 5.0)
BLOCK_TOKENS = 1_000_000
START, UNKNOWN, FIRST_ID = 0, 1, 2
#: No word holds white space.
END = "\n"
#: Codes 0..254 stand for 10^(-code / STEPS), 255 for zero.
STEPS, ZERO = 32, 255
_VALUE = np.append(10.0 ** (-np.arange(255) / STEPS), 0.0)


def encode_share(x: np.ndarray) -> np.ndarray:
    """Largest code value not above x (0 <= x <= 1)."""
    with np.errstate(divide="ignore"):
        code = np.ceil(-np.log10(x) * STEPS - 1e-9)
    return np.where(x > 0, np.minimum(code, ZERO), ZERO).astype(np.uint8)


# --- Elias-Fano -----------------------------------------------------------------------------------

def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit (from 0) of every 64-bit word."""
    word, k, at = word.copy(), k.astype(np.int64), np.zeros(len(k), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
        up = k >= ones
        k -= np.where(up, ones, 0)
        word = np.where(up, word >> np.uint64(width), word)
        at += np.where(up, width, 0)
    return at


class EliasFano:
    """An increasing sequence: low bits packed, high parts in unary, a running count of ones per word."""

    def __init__(self, size: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.size, self.low_bits, self.low, self.high, self.ones = size, low_bits, low, high, ones
        self.zeros = np.arange(len(ones)) * 64 - ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
        high = (values >> bits) + np.arange(n)
        marks = np.zeros(-(-(n + (top >> bits) + 1) // 64) * 64, bool)
        marks[high] = True
        words = np.packbits(marks, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        low = np.zeros(-(-n * bits // 64) + 1, np.uint64)
        for at in range(0, n if bits else 0, 65536):  # 65,536 fields fill whole words
            part = values[at:at + 65536]
            packed = np.packbits(((part[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()
            packed = np.frombuffer(packed + b"\0" * (-len(packed) % 8), np.uint64)
            low[at * bits // 64:at * bits // 64 + len(packed)] = packed
        return cls(n, bits, low, words, ones)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.size, self.low_bits]), self.low, self.high, self.ones]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        over = np.where(shift > 0, self.low[np.minimum(word + 1, len(self.low) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (((self.low[word] >> shift) | over) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def _select(self, k: np.ndarray, running: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(running, k, side="right") - 1
        bits = self.high[word]
        return (word << 6) + _select_in_word(~bits if flip else bits, k - running[word])

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the given positions."""
        return ((self._select(i, self.ones, False) - i) << self.low_bits) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first value >= x, whether it equals x)."""
        high, low = x >> self.low_bits, x & ((1 << self.low_bits) - 1)
        last = len(self.high) * 64 - int(self.ones[-1]) - 1  # zeros of the unary part
        beyond = high > last
        h = np.minimum(high, last)
        # the bucket's ones stand between the zero before it and the next zero
        start = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, True) + 1, 0)
        word = np.minimum(start >> 6, len(self.high) - 1)
        rest = ~self.high[word] >> (start & 63).astype(np.uint64)
        rest[start >> 6 != word] = 0
        stop = start + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        far = np.flatnonzero(rest == 0)
        stop[far] = self._select(h[far], self.zeros, True)
        begin, end = start - h, np.minimum(stop - h, self.size)
        at, stop = np.where(beyond, self.size, begin), np.where(beyond, self.size, end)
        open_ = np.flatnonzero(at < stop)
        lo, hi = at[open_], stop[open_]
        while len(open_):
            mid = (lo + hi) >> 1
            less = self._low(mid) < low[open_]
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            at[open_] = lo
            more = lo < hi
            open_, lo, hi = open_[more], lo[more], hi[more]
        found = at < stop
        found[found] = self._low(at[found]) == low[found]
        return at, found


# --- one shard's trie ------------------------------------------------------------------------------

def flat_bytes(arrays: list[np.ndarray]) -> bytes:
    """Arrays behind a table of their types and lengths, each at a multiple of 8 bytes."""
    head = np.array([len(arrays), *[x for a in arrays for x in ("buiq".index(a.dtype.char if a.dtype.char in "bq" else a.dtype.kind), a.itemsize, len(a))]], np.int64)
    parts = [head.tobytes()]
    for a in arrays:
        raw = a.tobytes()
        parts.append(raw + b"\0" * (-len(raw) % 8))
    return b"".join(parts)


def mapped_arrays(buffer) -> list[np.ndarray]:
    """The arrays of ``flat_bytes`` in place: views of the buffer, nothing is copied."""
    count = int(np.frombuffer(buffer, np.int64, 1)[0])
    head = np.frombuffer(buffer, np.int64, 3 * count, 8).reshape(count, 3)
    out, at = [], 8 + 24 * count
    for kind, width, n in head.tolist():
        out.append(np.frombuffer(buffer, np.dtype(f"{'iuii'[kind]}{width}"), n, at))
        at += -(-n * width // 8) * 8
    return out


class Trie:
    """Levels of one shard: first words, then successors per context."""

    def __init__(self, order: int, parts: list[np.ndarray]):
        take = iter(parts)
        ef = lambda: EliasFano(*(int(x) for x in next(take)), next(take), next(take), next(take))
        self.words = ef()
        self.keys, self.share, self.back, self.pointers = [self.words], [None], [], []
        for n in range(2, order + 1):
            self.back.append(next(take))
            self.pointers.append(ef())
            self.keys.append(ef())
            self.share.append(next(take))

    @staticmethod
    def build(first: np.ndarray, first_count: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], prior=PRIOR) -> bytes:
        """``levels``: per order from 2 on, (context position, word, count), sorted by context and word."""
        parts, counts = EliasFano.build(first).arrays(), first_count
        for n, (context, word, count) in enumerate(levels):
            m = prior[min(n, len(prior) - 1)]
            ends = np.searchsorted(context, np.arange(len(counts)), side="right")
            some = np.flatnonzero(np.diff(ends, prepend=0))
            shift = np.zeros(len(counts), np.int64)
            shift[some] = word[ends[some] - 1] + 1
            base = np.cumsum(shift) - shift
            parts += [np.minimum(encode_share(m / (counts + m)), ZERO - 1), *EliasFano.build(np.concatenate([[0], ends])).arrays(), *EliasFano.build(base[context] + word + 1).arrays(),
                      encode_share(count / (counts[context] + m))]
            counts = count
        return flat_bytes(parts)

    def children(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Positions in ``level`` (0: successors of first words) of ``word`` behind ``context``; -1: none."""
        out = np.full(len(word), -1, np.int64)
        known = np.flatnonzero(context >= 0)
        if not len(known) or not self.keys[level + 1].size:
            return out
        ctx = context[known]
        new = np.r_[True, ctx[1:] != ctx[:-1]]
        which, distinct = np.cumsum(new) - 1, ctx[new]
        begin, end = self.pointers[level].access(distinct), self.pointers[level].access(distinct + 1)
        keys = self.keys[level + 1]
        base = np.where(begin > 0, keys.access(np.maximum(begin - 1, 0)), 0)
        at, found = keys.successor(base[which] + word[known] + 1)
        found &= at < end[which]
        out[known[found]] = at[found]
        return out

    def first(self, word: np.ndarray) -> np.ndarray:
        if not self.words.size:
            return np.full(len(word), -1, np.int64)
        at, found = self.words.successor(word)
        return np.where(found, at, -1)


# --- blocks ----------------------------------------------------------------------------------------

def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers >= 0 in their smallest width, byte plane by byte plane, compressed."""
    import zstandard

    head, planes = [len(arrays)], []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        width = next(w for w in (1, 2, 4, 8) if top < 256**w)
        head += [len(a), width]
        planes.append(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, np.int64).tobytes() + b"".join(planes))


def unpack(blob: bytes, wide: bool = True) -> list[np.ndarray]:
    """The packed arrays as 64-bit numbers or, if not ``wide``, in the width they are packed in."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * count, 8).reshape(count, 2).tolist(), 8 + 16 * count, []
    for n, width in head:
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        column = np.ascontiguousarray(planes.T).view("<i8" if width == 8 else f"<u{width}").ravel()
        out.append(column.astype(np.int64) if wide else column)
        at += n * width
    return out


#: What separates words becomes a space, A-Z become lower case, other bytes stay.
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[[*range(9, 14)]] = 32
_FOLDED[65:91] += 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (UTF-8) in order and the number of words of every text; A-Z in lower case."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    folded = _FOLDED[np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    solid = folded != 32
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(solid)]
    begins[inner] = solid[inner]  # a text ends a word
    begin = np.flatnonzero(begins)
    ends = np.append(np.cumsum(solid)[begin] - 1, np.count_nonzero(solid)) if len(begin) else np.zeros(1, np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(folded[solid])])
    return words, np.diff(np.searchsorted(begin, offsets))


def _block_batch(block: int, shards: int, ids: list[pa.Array], held: list[pa.Array], words: list[pa.Array], lengths: list[np.ndarray]) -> pa.RecordBatch:
    """The block's row, and a row of distinct words with their training counts for every shard of words."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    held_out, length = pa.concat_arrays(held), np.concatenate(lengths)
    coded = pa.concat_arrays(words).dictionary_encode()
    local, names = coded.indices.to_numpy(), pa.concat_arrays([coded.dictionary, pa.array([END.encode()], pa.large_binary())])
    train = ~held_out.to_numpy(zero_copy_only=False)
    counts = np.bincount(local, weights=np.repeat(train, length), minlength=len(names)).astype(np.int64)
    counts[-1] = train.sum()
    spelled = names.to_pylist()
    home = np.fromiter(map(zlib.crc32, spelled), np.int64, len(spelled)) % shards
    order, ends = np.argsort(home, kind="stable"), np.cumsum(np.bincount(home, minlength=shards))
    some = np.flatnonzero(np.diff(ends, prepend=0))
    parts = [order[e - n:e] for e, n in zip(ends[some], np.diff(ends, prepend=0)[some])]
    n = len(some)
    one = lambda values: pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), pa.nulls(n, pa.list_(values.type))])
    return pa.RecordBatch.from_arrays([
        pa.array([block] * (n + 1)), one(pa.concat_arrays(ids)), one(held_out), pa.array([pack([length, local]), *[None] * n], pa.binary()),
        pa.array([len(names), *[None] * n], pa.int32()), pa.array([None, *some.tolist()], pa.int32()),
        pa.array([None, *[press.compress(b" ".join([spelled[i] for i in x.tolist()])) for x in parts]], pa.binary()),
        pa.array([None, *[pack([x, counts[x]]) for x in parts]], pa.binary())],
        names=["block", "doc_ids", "held", "tokens", "n_words", "shard", "words", "counts"])


def _blocks(block_tokens: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 33, ([], [], [], [])
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            words, lengths = words_of(b.column("text"))
            for part, value in zip(held, (b.column("doc_id"), b.column("held_out"), words, lengths)):
                part.append(value)
            size += len(words) + b.num_rows
            if size >= block_tokens:
                yield _block_batch(block, shards, *held)
                block, held, size = block + 1, ([], [], [], []), 0
        if size:
            yield _block_batch(block, shards, *held)

    return run


def distinct_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (left, right) in order, and the number of every given pair among them."""
    n = len(left)
    bits = [int(x).bit_length() for x in (left.max(initial=0), right.max(initial=0), n)]
    if sum(bits) > 63:
        keys, which = np.unique(left << 32 | right, return_inverse=True)
        return keys >> 32, keys & 0xFFFFFFFF, which
    # pair and position in one number: a plain sort then gives order and places
    numbers = (left << (bits[1] + bits[2])) | (right << bits[2])
    numbers |= np.arange(n)
    numbers.sort()
    keys = numbers >> bits[2]
    first = np.ones(n, bool)
    first[1:] = keys[1:] != keys[:-1]
    which = np.empty(n, np.int64)
    which[numbers & ((1 << bits[2]) - 1)] = np.cumsum(first) - 1
    keys = keys[first]
    return keys >> bits[1], keys & ((1 << bits[1]) - 1), which


class BlockNgrams:
    """The tokens of a block as word ids, and its distinct n-grams per order."""

    def __init__(self, tokens: bytes, n_words: int, at: np.ndarray, ids: np.ndarray, order: int):
        self.lengths, local = unpack(tokens)
        self.ends = np.cumsum(self.lengths + 1)
        # words are numbered within the block in the order of their ids, which keeps the sorts narrow
        names = np.concatenate([[START, UNKNOWN], np.sort(ids)])
        known = np.full(n_words, UNKNOWN, np.int64)
        known[at] = np.searchsorted(names, ids)
        self.local = np.full(int(self.ends[-1]) if len(self.ends) else 0, n_words - 1, np.int64)
        is_word = np.ones(len(self.local), bool)
        is_word[self.ends - 1] = False
        self.local[is_word] = local
        self.word = known[self.local]
        begin = self.ends - self.lengths - 1
        position = np.arange(len(self.word)) - np.repeat(begin, self.lengths + 1)
        before = np.concatenate([[START], self.word[:-1]])
        before[begin] = START
        #: per order from 2 on: tokens that have such a context, their n-gram, and each n-gram's context and word
        self.tokens, self.ngram, self.context, self.last = [], [], [], []
        parent = before
        for n in range(2, order + 1):
            valid = np.flatnonzero((before != UNKNOWN) & (position >= n - 2) & (parent >= 0))
            context, last, which = distinct_pairs(parent[valid], self.word[valid])
            self.tokens.append(valid)
            self.ngram.append(which)
            self.context.append(names[context] if n == 2 else context)
            self.last.append(names[last])
            node = np.full(len(self.word), -1, np.int64)
            node[valid] = which
            parent = np.concatenate([[-1], node[:-1]])

    def shards(self, shards: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per order: the n-grams in shard order, and the ends of the shards in it."""
        shard, out = None, []
        for context, last in zip(self.context, self.last):
            if shard is None:
                mixed = (context.astype(np.uint64) << np.uint64(32) | last.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                shard = ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
            else:
                shard = shard[context]
            narrow = shard.astype(np.uint16) if shards <= 2**16 else shard  # 16 bits are sorted by radix
            out.append((np.argsort(narrow, kind="stable"), np.cumsum(np.bincount(shard, minlength=shards))))
        return out


def _numbered(shards: int):
    """Counts and numbers one shard's words, and tells every block its words' ids and counts."""
    import zstandard

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        home = table.column("shard")[0].as_py()
        words = pa.concat_arrays([pa.array(zstandard.ZstdDecompressor().decompress(w).split(b" "), pa.binary()) for w in table.column("words").to_pylist()])
        which = words.dictionary_encode().indices.to_numpy()
        packed = [unpack(p) for p in table.column("counts").to_pylist()]
        count = np.bincount(which, weights=_spread([p[1] for p in packed])).astype(np.int64)
        known = count > 0
        ids = (np.cumsum(known) - 1) * shards + home + FIRST_ID
        out, at = [], 0
        for place, _ in packed:
            own = which[at:at + len(place)]
            keep = known[own]
            out.append(pack([place[keep], ids[own[keep]], count[own[keep]]]))
            at += len(place)
        end = words.index(END.encode()).as_py() if home == zlib.crc32(END.encode()) % shards else -1
        totals = [int(count.sum()), int(known.sum()), int(ids[known].max(initial=0)), int(count[which[end]]) if end >= 0 else 0]
        rest = [pa.array([x, *[None] * len(out)], pa.int64()) for x in totals]
        return pa.table([pa.array([None, *table.column("block").to_pylist()], pa.int64()), pa.array([None, *out], pa.binary()), *rest],
                        names=["block", "known", "total", "distinct", "top", "starts"])

    return run


def _ids_of(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """Positions, ids and counts of the known words of the batch's n-th block."""
    parts = [unpack(p) for p in batch.column("known")[n].as_py() or []]
    return [_spread([p[c] for p in parts]) for c in range(3)]


def _messages(order: int, shards: int, start_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                at, ids, counts = _ids_of(b, n)
                count_of = np.zeros(int(ids.max(initial=0)) + FIRST_ID, np.int64)
                count_of[ids], count_of[START] = counts, start_count
                grams = BlockNgrams(b.column("tokens")[n].as_py(), b.column("n_words")[n].as_py(), at, ids, order)
                train = np.repeat(~b.column("held")[n].values.to_numpy(zero_copy_only=False), grams.lengths + 1)
                parts: list[list[np.ndarray]] = [[] for _ in range(shards)]
                place = None
                for tokens, which, context, last, (sorted_, ends) in zip(grams.tokens, grams.ngram, grams.context, grams.last, grams.shards(shards)):
                    times = np.bincount(which, weights=train[tokens], minlength=len(last)).astype(np.int64)
                    begin = 0
                    for s, end in enumerate(ends.tolist()):
                        rows, begin = sorted_[begin:end], end
                        if not len(rows) and not parts[s]:
                            continue
                        if place is None:
                            words, runs = np.unique(context[rows], return_counts=True)
                            parts[s] += [words, count_of[words], runs, last[rows], times[rows]]
                        else:
                            children = np.bincount(place[context[rows]], minlength=len(parts[s][-1]))
                            parts[s] += [children, last[rows], times[rows]]
                    starts = np.concatenate([[0], ends[:-1]])
                    place = np.empty(len(last), np.int64)
                    place[sorted_] = np.arange(len(last)) - np.repeat(starts, np.diff(ends, prepend=0))
                some = [s for s in range(shards) if parts[s]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([b.column("block")[n].as_py()] * len(some), pa.int64()),
                                                  pa.array([pack(parts[s]) for s in some], pa.binary())], names=["shard", "block", "payload"])

    return run


def _added(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of the seen ones, their counts, and the place of every key among them (-1: not seen)."""
    seen = np.flatnonzero(times > 0)
    distinct, which = np.unique(keys[seen], return_inverse=True)
    place = np.full(len(keys), -1, np.int64)
    place[seen] = which
    return distinct, np.bincount(which, weights=times[seen], minlength=len(distinct)).astype(np.int64), place


def _spread(lists: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(lists) if lists else np.zeros(0, np.int64)


def build_trie(messages: list[list[np.ndarray]], prior=PRIOR) -> bytes:
    """The flat trie of one shard from the messages of all blocks (arrays of any width)."""
    wide = lambda lists: _spread(lists).astype(np.int64)
    keys = wide([np.repeat(m[0], m[2]) for m in messages])
    keys <<= 32
    keys |= wide([m[3] for m in messages])
    keys, counts, place = _added(keys, _spread([m[4] for m in messages]))
    # all seen first words: the successors of one may lie in other shards, its g is still asked for here
    words, one = np.unique(wide([m[0] for m in messages]), return_index=True)
    word_counts = wide([m[1] for m in messages])[one]
    words, word_counts = words[word_counts > 0], word_counts[word_counts > 0]
    levels = [(np.searchsorted(words, keys >> 32), keys & 0xFFFFFFFF, counts)]
    for at in range(5, len(messages[0]) if messages else 0, 3):
        sizes = [len(m[at]) for m in messages]
        offset = np.cumsum(sizes) - sizes
        keys = place[_spread([np.repeat(np.arange(len(m[at])) + o, m[at]) for m, o in zip(messages, offset)])]
        keys <<= 32
        keys |= wide([m[at + 1] for m in messages])
        keys, counts, place = _added(keys, _spread([m[at + 2] for m in messages]))
        levels.append((keys >> 32, keys & 0xFFFFFFFF, counts))
    return Trie.build(words, word_counts, levels, prior)


def answer(trie: Trie, message: list[np.ndarray]) -> bytes:
    """Per order the codes of a of every n-gram and of g of its context, in the message's order."""
    out = []
    node = np.repeat(trie.first(message[0]), message[2])
    lasts = [message[3], *message[6::3]]
    for level, last in enumerate(lasts):
        if level:
            node = np.repeat(node, message[2 + 3 * level])
        found = trie.children(level, node, last)
        back = trie.back[level]
        out += [np.where(found >= 0, trie.share[level + 1][found] if len(trie.share[level + 1]) else ZERO, ZERO), np.where(node >= 0, back[node] if len(back) else 0, 0)]
        node = found
    return pack(out)


def _answers(order: int, prior):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        packed = table.column("payload")
        # the messages of all blocks are held in their packed widths, and only while the trie is built
        trie = Trie(order, mapped_arrays(build_trie([unpack(p.as_py(), False) for p in packed], prior)))
        return pa.table({"shard": table.column("shard"), "block": table.column("block"), "payload": pa.array([answer(trie, unpack(p.as_py())) for p in packed], pa.binary())})

    return run


def _scores(order: int, shards: int, total: int, distinct: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                at, ids, counts = _ids_of(b, n)
                n_words = b.column("n_words")[n].as_py()
                grams = BlockNgrams(b.column("tokens")[n].as_py(), n_words, at, ids, order)
                count = np.zeros(n_words, np.int64)
                count[at] = counts
                count = count[grams.local]
                base = (count + 0.5) / (total + 0.5 * (distinct + 1))
                p = base.copy()
                answers = b.column("answers")[n].as_py() or []
                codes = {a["shard"]: unpack(a["payload"]) for a in answers}
                for level, (tokens, which, (sorted_, ends)) in enumerate(zip(grams.tokens, grams.ngram, grams.shards(shards))):
                    share, back = np.full(len(sorted_), ZERO), np.zeros(len(sorted_), np.int64)
                    begin = 0
                    for s, end in enumerate(ends.tolist()):
                        if end > begin:
                            share[sorted_[begin:end]], back[sorted_[begin:end]] = codes[s][2 * level], codes[s][2 * level + 1]
                        begin = end
                    p[tokens] = _VALUE[share][which] + _VALUE[back][which] * p[tokens]
                begins = grams.ends - grams.lengths - 1
                sums = lambda x: pa.array(np.add.reduceat(x, begins) if len(begins) else x)
                size = len(grams.ends)
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_ids")[n].values, b.column("held")[n].values, pa.array(grams.lengths + 1), sums((count > 0).astype(np.int64)),
                    pa.array(np.full(size, total)), sums(np.log10(base)), sums(np.log10(p))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


# --- Spark -----------------------------------------------------------------------------------------

def held_out(id_: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit(""))), F.lit(folds)) == fold


class CorpusModel:
    """Blocks of a corpus with their words numbered: what counting and scoring read."""

    def __init__(self, docs: DataFrame, held: Column, id_col: str, text_col: str, order: int, prior, block_tokens: int, shards: int | None):
        self.spark: SparkSession = docs.sparkSession
        self.order, self.prior = order, prior
        self.shards = shards or 2 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.id_type = docs.schema[id_col].dataType
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        schema = T.StructType([
            T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(self.id_type)), T.StructField("held", T.ArrayType(T.BooleanType())),
            T.StructField("tokens", T.BinaryType()), T.StructField("n_words", T.IntegerType()), T.StructField("shard", T.IntegerType()),
            T.StructField("words", T.BinaryType()), T.StructField("counts", T.BinaryType())])
        table = f"ngram_blocks_{uuid.uuid4().hex}"
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out")).mapInArrow(_blocks(block_tokens, self.shards), schema)
        rows.write.bucketBy(buckets, "block").option("path", scratch(self.spark, "ngram-blocks")).saveAsTable(table)
        stored = self.spark.table(table)
        words = stored.where(F.col("shard").isNotNull()).select("block", "shard", "words", "counts")
        longs = ", ".join(f"{c} long" for c in ("total", "distinct", "top", "starts"))
        numbered = materialize(words.groupBy("shard").applyInArrow(_numbered(self.shards), f"block long, known binary, {longs}"))
        of_shards = numbered.where(F.col("block").isNull())
        zero = F.lit(0).cast("long")
        self.total, self.distinct, top, self.starts = of_shards.agg(
            F.coalesce(F.sum("total"), zero), F.coalesce(F.sum("distinct"), zero), F.coalesce(F.max("top"), zero), F.coalesce(F.sum("starts"), zero)).first()
        if top >= 2**32:
            raise ValueError(f"{top} word ids do not fit 32 bits")
        self.known = numbered.where(F.col("block").isNotNull()).groupBy("block").agg(F.collect_list("known").alias("known"))
        self.blocks = stored.where(F.col("shard").isNull())

    def _coded(self, *columns: str) -> DataFrame:
        return self.blocks.select("block", "held", "tokens", "n_words", *columns).join(self.known, "block", "left")

    def messages(self) -> DataFrame:
        """(shard, block, payload): the distinct n-grams of every block with their training counts."""
        return self._coded().mapInArrow(_messages(self.order, self.shards, self.starts), "shard int, block long, payload binary")

    def tries(self) -> DataFrame:
        """(shard, trie): the flat trie of every shard."""
        prior = self.prior

        def build(table: pa.Table) -> pa.Table:
            trie = build_trie([unpack(p.as_py(), False) for p in table.column("payload")], prior)
            return pa.table({"shard": table.column("shard").slice(0, 1), "trie": pa.array([trie], pa.binary())})

        return self.messages().groupBy("shard").applyInArrow(build, "shard int, trie binary")

    def scores(self) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_type

        answers = self.messages().groupBy("shard").applyInArrow(_answers(self.order, self.prior), "shard int, block long, payload binary")
        per_block = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "payload")).alias("answers"))
        out = T.StructType([T.StructField("doc_id", self.id_type), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
                            *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])
        return self._coded("doc_ids").join(per_block, "block", "left").mapInArrow(
            _scores(self.order, self.shards, self.total, self.distinct, to_arrow_type(self.id_type)), out)


def corpus_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, order: int = ORDER, prior=PRIOR,
                 block_tokens: int = BLOCK_TOKENS, shards: int | None = None) -> CorpusModel:
    """A model of the documents that are not held out (default: by the crc32 of the id)."""
    if order < 2:
        raise ValueError("the order of the model is 2 or more")
    return CorpusModel(docs, held_out(F.col(id_col)) if held is None else held, id_col, text_col, order, prior, block_tokens, shards)


def score_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    return corpus_model(docs, **options).scores()
