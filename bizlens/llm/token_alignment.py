"""Alignment of two tokenizers by merge-path partitioning.

Method: the byte offsets where the tokens of A and of B end are two increasing lists. Their merge
is a path of ``len(A) + len(B)`` steps; a binary search along a diagonal of the merge grid finds where
the path crosses it, so the diagonals at every ``PIECE`` steps cut the merge into pieces of equal work
that know nothing of each other. All pieces are merged in lockstep: a step that consumes a token emits the overlap
(A token, B token) it ends, and an end that both lists share closes a group. A group that runs
over a piece's border is stitched by the running number of groups closed by the pieces before.

Both tokenizers are only asked for distinct segments: a text is cut in front of a run of white space
that begins with a space or newline behind another character, where neither tokenizer joins anything (B only
if no piece holds a newline or an inner marker; otherwise a text is one segment). The cuts are also where a very long
text is dealt with in parts of ``PART`` segments. The segment table of a worker is bounded by ``TABLE``.

Corpus-wide counts of (A id, B id) links are summed by Spark from the sums of tasks. Every document keeps its distinct
pairs; their counts come back from a broadcast table where that has at most ``BROADCAST_PAIRS`` rows,
otherwise by a join on the pair.

Defined results: NULL and empty texts, and texts that a tokenizer does not reproduce byte by byte, have no tokens:
zeros and an empty digest; equal rows give equal results and each counts; NULL or repeated ids are only
carried; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.llm.common import materialize, scratch

PIECE = 256
PART = 400_000
TABLE, LONG_SEGMENT = 300_000, 64
STAT_PAIRS = 500_000
BROADCAST_PAIRS = 4_000_000
MARK = "▁"
_SEGMENT = re.compile(r"\s*\S+|\s+\Z")


# --- merge path -----------------------------------------------------------------------------

def diagonal_splits(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """For each diagonal d the number of elements of ``a`` among the first d of the merge (``a`` first on ties)."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (low < high).any():
        open_ = low < high
        mid = (low + high) // 2
        i, j = np.where(open_, mid, 0), np.where(open_, diagonals - mid - 1, 0)
        further = open_ & (a[i] <= b[j])  # a[mid] comes before b[d - mid - 1]: the split lies behind it
        low, high = np.where(further, mid + 1, low), np.where(open_ & ~further, mid, high)
    return low


def merge_overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A index, B index, group) of every overlap of two token lists, in order.

    ``a`` and ``b`` are increasing end offsets with the same last value."""
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return (np.zeros(0, np.int64),) * 3
    starts = np.arange(0, total, piece)
    i = diagonal_splits(a, b, starts)
    j = starts - i
    wide_a, wide_b = np.append(a, np.iinfo(a.dtype).max), np.append(b, np.iinfo(b.dtype).max)
    at_a, at_b = np.empty((piece, len(starts)), np.int32), np.empty((piece, len(starts)), np.int32)
    kind = np.zeros((piece, len(starts)), np.int8)  # 0 no step, 1 overlap, 2 overlap that closes a group, 3 the shared end's second step
    for step in range(min(piece, total)):
        end_a, end_b = wide_a[i], wide_b[j]
        take_a = end_a <= end_b
        second = ~take_a & (wide_a[i - 1] == end_b) & (i > 0)
        at_a[step], at_b[step] = i, j
        kind[step] = np.where(second, 3, 1 + (end_a == end_b))
        i, j = i + take_a, j + ~take_a
        full = i + j > total
        if full.any():  # the last piece is shorter
            kind[step, full] = 0
            i[full], j[full] = len(a), len(b)
    closed = (kind == 2).sum(axis=0)
    before = np.cumsum(closed) - closed  # groups closed by earlier pieces: stitches the open group of a border
    inside = np.cumsum(kind == 2, axis=0) - (kind == 2)
    keep = ((kind == 1) | (kind == 2)).T
    return at_a.T[keep].astype(np.int64), at_b.T[keep].astype(np.int64), (inside + before[None, :]).T[keep]


# --- the two tokenizers over distinct segments ------------------------------------------------

def byte_of_symbol() -> dict[str, int]:
    """The byte behind each printable symbol of a byte-level vocabulary: printable Latin-1 stands for itself,
    the other bytes follow from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteBpe:
    """Tokenizer A: byte-level BPE from its json file, run by the faster library where ids are merge ranks."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        symbol, special = byte_of_symbol(), {t["id"] for t in model["added_tokens"] if t["special"]}
        vocab = {i: bytes(symbol[c] for c in s) for s, i in model["model"]["vocab"].items() if i not in special}
        self.bytes = [vocab.get(i, b"") for i in range(max([*vocab, *special]) + 1)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        ranked = all(self.bytes[256 + n] == bytes(symbol[c] for c in x + y) for n, (x, y) in enumerate(merges))
        split = model["pre_tokenizer"]
        if ranked and split["type"] == "ByteLevel" and split["use_regex"] and not model["normalizer"]:
            import tiktoken

            run = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={s: i for i, s in vocab.items()}, special_tokens={})
            self.encode = run.encode_ordinary
        else:
            from tokenizers import Tokenizer

            run = Tokenizer.from_file(path)
            run.encode_special_tokens = True
            self.encode = lambda text: run.encode(text, add_special_tokens=False).ids


class PieceBpe:
    """Tokenizer B: a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        inner = any(MARK in p.lstrip(MARK) or "\n" in p for i, p in enumerate(names) if not m.is_byte(i))
        newline = m.encode("\n")
        self.separable = not inner and len(newline) == 2 and b"".join(self.bytes[i] for i in newline) == b" \n"

    def encode(self, segment: str) -> list[int]:
        """Ids of a text that begins with the space which the model adds, or stands behind other segments."""
        if segment[0] == " ":
            return self.model.encode(segment[1:])
        return self.model.encode("\n" + segment)[2:]


class Segments:
    """Token ids of distinct segments, kept in flat arrays."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteBpe(path_a), PieceBpe(path_b)
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.name_a, self.name_b = (pa.array([str(i) for i in range(len(t.bytes))]) for t in (self.a, self.b))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = {"a": [np.zeros(0, np.int32)], "b": [np.zeros(0, np.int32)]}
        self.count = {"a": [np.zeros(0, np.int64)], "b": [np.zeros(0, np.int64)]}
        self.bad: list[np.ndarray] = [np.zeros(0, bool)]
        self.rows = 0
        self.starts: tuple[int, dict[str, np.ndarray]] | None = None

    def cut(self, text: str) -> list[str]:
        if not self.b.separable:
            return [text]
        parts = _SEGMENT.findall(text)
        if not all(p[0] in " \n" for p in parts):
            joined = [parts[0]]
            for p in parts[1:]:
                if p[0] in " \n":
                    joined.append(p)
                else:
                    joined[-1] += p
            parts = joined
        return parts

    def _alone(self, segment: str) -> tuple[list[int], list[int], bool]:
        a, b, raw = self.a.encode(segment), self.b.encode(segment), segment.encode()
        same = b"".join(self.a.bytes[i] for i in a) == raw and b"".join(self.b.bytes[i] for i in b) == raw
        return (a, b, False) if same else ([], [], True)

    def _add(self, counts_a, counts_b, ids_a, ids_b, bad) -> None:
        for side, ids, n in (("a", ids_a, counts_a), ("b", ids_b, counts_b)):
            self.flat[side].append(np.asarray(ids, np.int32))
            self.count[side].append(np.asarray(n, np.int64))
        self.bad.append(np.asarray(bad, bool))
        self.rows += len(bad)

    def _encode(self, new: list[str]) -> None:
        """Append the segments to the arrays: joined texts are encoded at once and cut at the segments' ends."""
        chunk: list[str] = []
        size = 0
        for s in [*new, None]:
            if s is not None:
                chunk.append(s)
                size += len(s)
            if chunk and (s is None or size > 200_000 or s[-1].isspace() or len(chunk) == 50_000):
                self._encode_chunk(chunk)
                chunk, size = [], 0

    def _encode_chunk(self, chunk: list[str]) -> None:
        joined = "".join(chunk)
        raw = joined.encode()
        ends = np.cumsum([len(s.encode()) for s in chunk])
        found = []
        for tokenizer, sizes in ((self.a, self.size_a), (self.b, self.size_b)):
            ids = np.array(tokenizer.encode(joined), np.int64)
            at = np.searchsorted(np.cumsum(sizes[ids]), ends)
            if b"".join([tokenizer.bytes[i] for i in ids.tolist()]) != raw or (np.cumsum(sizes[ids])[np.minimum(at, len(ids) - 1)] != ends).any():
                break
            found += [np.diff(at, prepend=-1), ids]
        else:
            self._add(found[0], found[2], found[1], found[3], np.zeros(len(chunk), bool))
            return
        rows = [self._alone(s) for s in chunk]
        self._add([len(r[0]) for r in rows], [len(r[1]) for r in rows], [i for r in rows for i in r[0]], [i for r in rows for i in r[1]], [r[2] for r in rows])

    def tokens(self, texts: list[str]) -> list[np.ndarray | None]:
        """Segment numbers of every text, valid until the next call of ``clear``; None: a text without tokens."""
        if len(self.index) > TABLE:
            self.clear()
        cut = [self.cut(" " + t) if t else [] for t in texts]
        new = list({s: None for parts in cut for s in parts if s not in self.index})
        start = self.rows
        if new:
            self._encode(new)
            self.index.update(zip(new, range(start, start + len(new))))
        for part in (self.flat, self.count):
            for side in part:
                if len(part[side]) > 1:
                    part[side] = [np.concatenate(part[side])]
        self.bad = [np.concatenate(self.bad)]
        number = self.index.__getitem__
        out = []
        for parts in cut:
            rows = np.fromiter(map(number, parts), np.int64, len(parts))
            out.append(rows if len(rows) and not self.bad[0][rows].any() else None)
        for s in new:
            if len(s) > LONG_SEGMENT:
                del self.index[s]
        return out

    def gather(self, rows: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the given segments one after another, and tokens per segment."""
        counts = self.count[side][0]
        if self.starts is None or self.starts[0] != self.rows:
            self.starts = (self.rows, {s: np.cumsum(self.count[s][0]) - self.count[s][0] for s in "ab"})
        n = counts[rows]
        offset = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(self.starts[1][side][rows] - offset, n)
        return self.flat[side][0][at], n


_SEGMENTS: dict[tuple, Segments] = {}


def segments_for(path_a: str | None, path_b: str | None) -> Segments:
    """The worker's segment table; resolved where it is called, so every worker finds its own model files."""
    import public_tokenizers

    key = (path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model"))
    if key not in _SEGMENTS:
        _SEGMENTS[key] = Segments(*key)
    return _SEGMENTS[key]


# --- documents ------------------------------------------------------------------------------------

class Aligned:
    """What one document adds up to over its parts."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.sha = hashlib.sha256()
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, n_a: int, n_b: int, n_groups: int, n_links: int, groups: bytes, pairs: np.ndarray, times: np.ndarray) -> None:
        if self.n_groups:
            self.sha.update(b";")
        self.sha.update(groups)
        self.n_a, self.n_b, self.n_groups, self.n_links = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups, self.n_links + n_links
        self.pairs.append(pairs)
        self.times.append(times)

    def pair_times(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) < 2:
            return (self.pairs[0], self.times[0]) if self.pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return summed(self.pairs, self.times)


def summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their times added up."""
    k, t = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(k, kind="stable")
    k, t = k[order], t[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(t, first) if len(k) else t


def _lists(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def align_parts(table: Segments, parts: list[tuple[Aligned, np.ndarray]], piece: int = PIECE) -> None:
    """Merge the token ends of all parts and add every part's result to its document."""
    rows = np.concatenate([r for _, r in parts])
    ids_a, per_a = table.gather(rows, "a")
    ids_b, per_b = table.gather(rows, "b")
    i, j, group = merge_overlaps(np.cumsum(table.size_a[ids_a]), np.cumsum(table.size_b[ids_b]), piece)
    # parts end at segment ends: both token lists end there, so groups and links end there too
    last = np.cumsum([len(r) for _, r in parts])
    end_a, end_b = np.cumsum(per_a)[last - 1], np.cumsum(per_b)[last - 1]
    end_link = np.searchsorted(i, end_a)
    end_group = group[end_link - 1] + 1
    # a group's tokens: its first link names its first A and B token
    closes = np.flatnonzero(np.diff(group, append=group[-1] + 1))
    joined = pc.binary_join_element_wise(
        pc.binary_join(_lists(table.name_a.take(pa.array(ids_a)), i[closes] + 1), ","),
        pc.binary_join(_lists(table.name_b.take(pa.array(ids_b)), j[closes] + 1), ","), "|")
    texts = pc.binary_join(_lists(joined, end_group), ";")
    pairs = ids_a[i].astype(np.int64) * len(table.b.bytes) + ids_b[j]
    begin = 0, 0, 0, 0
    for n, (doc, _) in enumerate(parts):
        end = end_a[n], end_b[n], end_group[n], end_link[n]
        keys, times = np.unique(pairs[begin[3]:end[3]], return_counts=True)
        doc.add(*(int(y - x) for x, y in zip(begin, end)), texts[n].as_py().encode(), keys, times)
        begin = end


def align_texts(table: Segments, texts: list[str], part: int = PART, piece: int = PIECE) -> list[Aligned]:
    """The alignment of every text; memory is bounded by ``part`` segments at a time besides the texts."""
    docs, waiting, size = [Aligned() for _ in texts], [], 0
    for doc, rows in zip(docs, table.tokens(texts)):
        for start in range(0, 0 if rows is None else len(rows), part):
            waiting.append((doc, rows[start:start + part]))
            size += len(waiting[-1][1])
            if size >= part:
                align_parts(table, waiting, piece)
                waiting, size = [], 0
    if waiting:
        align_parts(table, waiting, piece)
    return docs


def pack_pairs(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Increasing keys as differences and their times, byte plane by byte plane, compressed."""
    import zstandard

    wide = 8 if len(keys) and max(int(keys[-1]), int(times.max())) >= 2**32 else 4
    numbers = np.concatenate([np.diff(keys, prepend=0), times]).astype(f"<u{wide}")
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(numbers.view(np.uint8).reshape(-1, wide).T.tobytes())


def unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    numbers = np.ascontiguousarray(planes.T).view(f"<u{blob[0]}").ravel().astype(np.int64)
    half = len(numbers) // 2
    return np.cumsum(numbers[:half]), numbers[half:]


_SUMS = ("n_a", "n_b", "n_groups", "n_links")


def _align(path_a: str | None, path_b: str | None, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, held, held_size = TaskContext.get().partitionId(), 0, ([], []), 0
        names = ["row", "doc_id", *_SUMS, "groups_sha256", "links", "keys", "times"]

        def stat_rows():
            keys, times = summed(*held)
            for at in range(0, len(keys), STAT_PAIRS):
                part = slice(at, at + STAT_PAIRS)
                none = [pa.nulls(1, t) for t in (pa.int64(), kind, *[pa.int64()] * 4, pa.string(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, pa.array([keys[part]], pa.list_(pa.int64())), pa.array([times[part]], pa.list_(pa.int64()))], names=names)

        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            docs = align_texts(segments_for(path_a, path_b), texts) if texts else []
            pairs = [d.pair_times() for d in docs]
            if docs:
                keys, times = summed([p[0] for p in pairs], [p[1] for p in pairs])
                held[0].append(keys)
                held[1].append(times)
                held_size += len(keys)
                row = pa.array(np.arange(seen, seen + len(docs)) + (task << 33))
                yield pa.RecordBatch.from_arrays([
                    row, b.column("doc_id"), *[pa.array([getattr(d, s) for d in docs], pa.int64()) for s in _SUMS],
                    pa.array([d.sha.hexdigest() if d.n_groups else "" for d in docs]), pa.array([pack_pairs(*p) for p in pairs], pa.binary()),
                    pa.nulls(len(docs), pa.list_(pa.int64())), pa.nulls(len(docs), pa.list_(pa.int64()))], names=names)
                seen += len(docs)
            if held_size > 8 * STAT_PAIRS:
                keys, times = summed(*held)
                if len(keys) > 4 * STAT_PAIRS:
                    yield from stat_rows()
                    keys, times = keys[:0], times[:0]
                held, held_size = ([keys], [times]), len(keys)
        if held_size:
            yield from stat_rows()

    return run


def _score(packed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = packed.value
        for b in batches:
            n_best, total = [], []
            for blob in b.column("links").to_pylist():
                k, t = unpack_pairs(blob)
                at = np.searchsorted(keys, k)
                n_best.append(int(t[best[at]].sum()))
                total.append(int((t * counts[at]).sum()))
            rest = [b.column(c) for c in b.schema.names if c != "links"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n_best, pa.int64()), pa.array(total, pa.int64())],
                                             names=[*[c for c in b.schema.names if c != "links"], "n_best", "count_sum"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, blob in zip(b.column("row").to_pylist(), b.column("links").to_pylist()):
            k, t = unpack_pairs(blob)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), row)), pa.array(k), pa.array(t)], names=["row", "pair", "times"])


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None,
                    broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import public_tokenizers
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    longs = [T.StructField(c, T.LongType()) for c in _SUMS]
    listed = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", kind), *longs, T.StructField("groups_sha256", T.StringType()),
                           T.StructField("links", T.BinaryType()), T.StructField("keys", listed), T.StructField("times", listed)])
    path = scratch(spark, "alignment")
    docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_align(path_a, path_b, to_arrow_type(kind)), schema).write.parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    aligned = stored.where(F.col("row").isNotNull()).drop("keys", "times")
    pairs = stored.where(F.col("row").isNull()).select(F.explode(F.arrays_zip("keys", "times")).alias("p")).groupBy(
        F.col("p.keys").alias("pair")).agg(F.sum("p.times").alias("count"))
    pairs = materialize(pairs)
    pieces = len(PieceBpe(path_b or public_tokenizers.path("piece_bpe_32k.model")).bytes)
    by_b = F.pmod(F.col("pair"), F.lit(pieces))
    most = pairs.groupBy(by_b.alias("b")).agg(F.max("count").alias("most"))
    counted = materialize(pairs.withColumn("b", by_b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")))
    out = ["doc_id", *_SUMS, "n_best", "count_sum", "groups_sha256"]
    if counted.count() <= broadcast_pairs:
        table = counted.orderBy("pair").toArrow()
        packed = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "count", "best")))
        scored = T.StructType([*schema.fields[1:7], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
        return aligned.drop("row").mapInArrow(_score(packed), scored).select(*out)
    links = aligned.select("row", "links").mapInArrow(_unpacked, "row long, pair long, times long").join(counted, "pair")
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return aligned.join(sums, "row", "left").withColumns({c: F.coalesce(c, none) for c in ("n_best", "count_sum")}).select(*out)
