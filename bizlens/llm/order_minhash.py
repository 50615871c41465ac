"""Near-duplicate documents by Order MinHash and banded alignment.

Method: a text is its sequence of word 5-grams, each labelled with its occurrence number. A
sketch takes the ``MINIMA`` k-mers with the smallest hashes and keeps them in text order, so two
texts share it with about similarity ** MINIMA and only if the order agrees. Texts that share one
of ``SKETCHES`` sketches are candidates; a pair is linked when a banded alignment of the labelled
k-mers matches ``SIMILARITY`` or more of them (matched / all distinct). A class is a connected
component of links; its id is the smallest doc_id.

No group is expanded into pairs:

1. texts with equal words are one node, whatever their number of copies;
2. every bucket is compared with one centre, the member that shares most buckets, once over
   all sketches; this alone joins most of a large group;
3. buckets that still hold several components are cut into blocks of ``BLOCK`` texts, the texts outside
   the bucket's largest component into blocks of their own; each of those meets every block in one task, so
   a large component is copied once per block of the others, not per block of its own. The task
   counts shared k-mers by matrix products, aligns only pairs that can reach the threshold and
   returns the links it needed. Every colliding pair is either linked, already connected or
   rejected by a bound or its alignment; none is dropped.

At the threshold itself a pair misses all sketches with a chance of 3e-5 (long texts) to 5e-5 (31
k-mers). It would grow to 1e-2 for fewer k-mers, of which few minima can be drawn, so pairs with a text of
up to ``SHORT`` k-mers do not depend on sketches: their texts also share a bucket per k-mer of a prefix, the
``n - ceil(SIMILARITY * n) + 1`` k-mers that are rarest among short texts. Two texts that reach
``SIMILARITY`` have one in common, so none of these pairs is missed.

Defined results: words are runs of letters, digits and underscores, lower-cased; fewer than
five words make one k-mer; texts without any word are copies when equal and not blank; NULL and
blank texts are classes of their own. Rows with equal text share a class, repeated rows too. A
class keeps the row with the smallest doc_id (NULL last; of repeated rows one). An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizlens.llm.common import materialize, unused
from bizlens.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 20
MINIMA = 4
#: k-mers up to which no pair is missed; the other text of such a pair has at most SHORT / SIMILARITY.
SHORT = 30
#: Word hashes remembered per task.
WORD_CACHE = 300_000
#: Texts on either side of a block comparison, and k-mer columns of one matrix product.
BLOCK = 512
#: Rows of small buckets compared in one call.
PACK_ROWS = 1000
COLUMNS = 4096
_WORD = re.compile(r"\w+")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def kmers(text: str | None, hashes: dict, size: int = SHINGLE) -> np.ndarray:
    """Occurrence-labelled word k-mers of a text, in text order (one k-mer for short texts)."""
    words = [hashes[w] for w in _WORD.findall(text.lower())] if text else []
    if not words:
        return np.zeros(0, _U)
    w = np.array(words, _U)
    n = max(1, len(w) - size + 1)
    h = np.full(n, _U(min(size, len(w))))
    for i in range(min(size, len(w))):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + w[i:i + n])
    order = np.argsort(h, kind="stable")
    s = h[order]
    starts = np.r_[True, s[1:] != s[:-1]]
    at = np.arange(n)
    label = np.empty(n, np.int64)
    label[order] = at - np.maximum.accumulate(np.where(starts, at, 0))
    return _mix(h + label.astype(_U) * _U(0xD6E8FEB86659FD93))


def sketch_seeds(count: int) -> np.ndarray:
    return _mix(np.arange(1, count + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


def order_sketch(x: np.ndarray, seeds: np.ndarray, minima: int = MINIMA) -> np.ndarray:
    """For every seed, the hash of its ``minima`` smallest labelled k-mers in text order."""
    values = _mix(x[None, :] ^ seeds[:, None])
    k = min(minima, len(x))
    if k < len(x):
        picked = np.sort(np.argpartition(values, k - 1, axis=1)[:, :k], axis=1)
    else:
        picked = np.broadcast_to(np.arange(k), (len(seeds), k))
    out = np.full(len(seeds), _U(k))
    for i in range(k):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + x[picked[:, i]])
    return out.view(np.int64)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Share of the labelled k-mers that a banded alignment of both sequences matches:
    matched / (len(a) + len(b) - matched); 0 when that cannot reach ``least``."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    if n == m and np.array_equal(a, b):
        return 1.0
    need = least * (n + m) / (1 + least)  # matches needed
    order = np.argsort(b)
    sorted_b = b[order]
    at = np.searchsorted(sorted_b, a)
    at[at == m] = m - 1
    found = sorted_b[at] == a
    i = np.flatnonzero(found)
    if len(i) < need - 1e-9:
        return 0.0
    j = order[at[i]]
    # an alignment with enough matches leaves at most ``band`` k-mers of either side unmatched
    band = max(n, m) - need + 1e-9
    inside = np.abs(i - j) <= band
    j = j[inside]
    if len(j) < need - 1e-9:
        return 0.0
    if len(j) > 1 and not np.all(j[1:] > j[:-1]):
        tails: list[int] = []
        for v in j.tolist():
            p = bisect_left(tails, v)
            if p == len(tails):
                tails.append(v)
            else:
                tails[p] = v
        matched = len(tails)
    else:
        matched = len(j)
    return matched / (n + m - matched)


def content_key(text: str | None) -> bytes | None:
    """Key shared by texts with the same words; NULL for blank texts."""
    if text is None or not text.strip():
        return None
    words = " ".join(_WORD.findall(text.lower()))
    return hashlib.md5(words.encode() if words else b"\0" + text.encode()).digest()


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes, seeds = _WordHashes(), sketch_seeds(SKETCHES)
    for pdf in batches:
        rows = [kmers(t, hashes) for t in pdf["text"]]
        yield pd.DataFrame({
            "id": pdf["id"], "place": pdf["place"], "key": [content_key(t) for t in pdf["text"]],
            "n": [len(x) for x in rows], "sketch": [order_sketch(x, seeds) if len(x) else None for x in rows],
            "short": [x.view(np.int64) if 0 < len(x) <= SHORT / SIMILARITY else None for x in rows],
        })


def short_kmers(text: str | None, hashes: dict) -> np.ndarray:
    """The labelled k-mers cut to 32 bits, which is enough within a pair of texts and halves what is moved."""
    return (kmers(text, hashes) >> _U(32)).astype(np.uint32).view(np.int32)


def _kmer_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = _WordHashes()
    for pdf in batches:
        yield pd.DataFrame({"key": [content_key(t) for t in pdf["text"]], "kmers": [short_kmers(t, hashes) for t in pdf["text"]]})


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = [aligned_similarity(np.asarray(x), np.asarray(y)) >= SIMILARITY for x, y in zip(pdf["kmers_a"], pdf["kmers_b"])]
        yield pdf.loc[ok, ["a", "b"]]


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of labelled k-mers shared by every (left, right) pair, by products over k-mer columns."""
    out = np.zeros((len(left), len(right)), np.float32)
    kl, kr = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(kl, kr)
    if not len(both):
        return out
    rl = np.repeat(np.arange(len(left)), [len(x) for x in left])
    rr = np.repeat(np.arange(len(right)), [len(x) for x in right])

    def place(k, rows):
        at = np.searchsorted(both, k)
        at[at == len(both)] = 0
        hit = both[at] == k
        return at[hit], rows[hit]

    (cl, rl), (cr, rr) = place(kl, rl), place(kr, rr)
    for start in range(0, len(both), COLUMNS):
        width = min(COLUMNS, len(both) - start)
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        inl, inr = (cl >= start) & (cl < start + width), (cr >= start) & (cr < start + width)
        a[rl[inl], cl[inl] - start] = 1
        b[rr[inr], cr[inr] - start] = 1
        out += a @ b.T
    return out


class _Joined(dict):
    """Union-find over component names."""

    def root(self, x: bytes) -> bytes:
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x


def _cross_links(minor: pd.DataFrame, other: pd.DataFrame, joined: _Joined) -> list[tuple[bytes, bytes]]:
    ka, kb = [np.asarray(x) for x in minor["kmers"]], [np.asarray(x) for x in other["kmers"]]
    na, nb = np.array([len(x) for x in ka]), np.array([len(x) for x in kb])
    possible = shared_counts(ka, kb) >= SIMILARITY * (na[:, None] + nb[None, :]) / (1 + SIMILARITY) - 1e-6
    comp_a, comp_b = minor["component"].to_numpy(), other["component"].to_numpy()
    found = []
    for i, j in zip(*np.nonzero(possible)):
        x, y = joined.root(comp_a[i]), joined.root(comp_b[j])
        if x != y and aligned_similarity(ka[i], kb[j]) >= SIMILARITY:
            joined[x] = y
            found.append((comp_a[i], comp_b[j]))
    return found


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of texts outside the largest component of a bucket and of all
    its texts, for a pair of blocks of one bucket or for a pack of small buckets."""
    joined, found = _Joined(), []
    for _, rows in pdf.groupby(["j", "v"], sort=False):
        side = rows["minor_side"].to_numpy()
        if side.any() and not side.all():
            found += _cross_links(rows[side], rows[~side], joined)
    return pd.DataFrame(found, columns=["a", "b"])


def _components_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(key, component) for every node."""
    found = connected_components(links)
    return materialize(nodes.join(found, nodes["key"] == found["node"], "left").select("key", F.coalesce("component", "key").alias("component")))


def _prefixes(nodes: DataFrame) -> DataFrame:
    """(key, place, n, j, v) of the prefix k-mers of short texts that another short text has too."""
    rows = nodes.where(F.col("short").isNotNull()).select("key", "place", "n", F.explode("short").alias("v"))
    counts = rows.groupBy("v").agg(F.count(F.lit(1)).alias("texts"))
    rarest = Window.partitionBy("key").orderBy("texts", "v")
    length = F.col("n") - F.ceil(F.col("n") * F.lit(SIMILARITY) - F.lit(1e-9)) + 1
    ranked = rows.join(counts, "v").withColumn("rank", F.row_number().over(rarest))
    return ranked.where((F.col("rank") <= length) & (F.col("texts") > 1)).select("key", "place", "n", F.lit(SKETCHES).alias("j"), "v")


def _components(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) of the candidate nodes (key, place, n, sketch, short): linked with the
    centres first, then what the block comparison joins, as links between those components."""
    members = nodes.select("key", "place", "n", F.posexplode("sketch").alias("j", "v")).unionByName(_prefixes(nodes))
    sizes = members.groupBy("j", "v").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(members.join(sizes, ["j", "v"]))
    scores = members.groupBy("key").agg(F.first("place").alias("place"), F.sum("size").alias("score"))
    wanted = materialize(scores.select("key", "place"))
    kmer_rows = materialize(
        texts.join(wanted.select("place").distinct(), "place", "left_semi").select("text").mapInPandas(_kmer_rows, "key binary, kmers array<int>")
        .dropDuplicates(["key"]).join(wanted.select("key"), "key", "left_semi"))

    # one centre per bucket; a pair is compared once however many sketches it shares
    scored = members.join(scores.select("key", "score"), "key")
    centres = scored.groupBy("j", "v").agg(F.max(F.struct("score", "key", "n")).alias("c")).select("j", "v", F.col("c.key").alias("b"), F.col("c.n").alias("n_b"))
    near = F.least("n", "n_b") >= F.greatest("n", "n_b") * SIMILARITY
    pairs = members.join(centres, ["j", "v"]).where((F.col("key") != F.col("b")) & near).select(F.col("key").alias("a"), "b").distinct()
    sided = pairs.join(kmer_rows.select(F.col("key").alias("a"), F.col("kmers").alias("kmers_a")), "a").join(
        kmer_rows.select(F.col("key").alias("b"), F.col("kmers").alias("kmers_b")), "b")
    links = materialize(sided.select("a", "b", "kmers_a", "kmers_b").mapInPandas(_verify, "a binary, b binary"))

    # buckets with several components left
    components = _components_of(wanted.select("key"), links)
    placed = materialize(members.drop("place").join(components, "key"))
    by_component = placed.groupBy("j", "v", "component").agg(F.count(F.lit(1)).alias("here"))
    mixed = by_component.groupBy("j", "v").agg(F.max(F.struct("here", "component")).alias("top"), F.count(F.lit(1)).alias("several")).where("several > 1")
    rows = placed.join(mixed.select("j", "v", F.col("top.component").alias("largest"), F.col("top.here").alias("major")), ["j", "v"])
    blocks, minor_blocks = (F.ceil(n / F.lit(BLOCK)).cast("int") for n in (F.col("size"), F.col("size") - F.col("major")))
    rows = materialize(rows.select("j", "v", "key", "component", "largest", blocks.alias("blocks"), minor_blocks.alias("minor_blocks")))
    sides = rows.select("j", "v", "key", "component", "largest", "blocks", "minor_blocks", F.xxhash64("key").alias("h"))
    block, minor_block = F.pmod("h", "blocks").cast("int"), F.pmod("h", "minor_blocks").cast("int")
    every, every_minor = (F.explode(F.sequence(F.lit(0), F.col(n) - 1)) for n in ("blocks", "minor_blocks"))
    minor = sides.where("component <> largest").select("j", "v", "key", "component", "blocks", F.lit(True).alias("minor_side"), minor_block.alias("minor_block"), every.alias("other_block"))
    other = sides.select("j", "v", "key", "component", "blocks", F.lit(False).alias("minor_side"), every_minor.alias("minor_block"), block.alias("other_block"))
    packs = max(1, rows.count() // PACK_ROWS)
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("j", "v"), F.lit(packs))).otherwise(F.xxhash64("j", "v", "minor_block", "other_block"))
    both = minor.unionByName(other).withColumn("pack", pack).join(kmer_rows, "key")
    more = materialize(both.select("pack", "blocks", "j", "v", "minor_side", "component", "kmers").groupBy("blocks", "pack").applyInPandas(_block_links, "a binary, b binary"))
    merged = connected_components(more).select("node", F.col("component").alias("top"))
    return components.join(merged, F.col("component") == F.col("node"), "left").select(F.col("key").alias("node"), F.coalesce("top", "component").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, place (hash of the text), class_id, class_size, kept."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("place"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    sketches = texts.mapInPandas(_sketch, f"id {id_type}, place long, key binary, n int, sketch array<long>, short array<long>")
    sketched = materialize(sketches.withColumn("row", F.monotonically_increasing_id()))  # numbers fixed by the checkpoint
    worded = sketched.where(F.col("sketch").isNotNull()).groupBy("key").agg(F.first(F.struct("place", "n", "sketch", "short")).alias("r")).select("key", "r.*")
    components = _components(worded, texts.select("place", "text").where(F.col("text").isNotNull()))
    rows = sketched.select("id", "place", "key", "row")
    classed = rows.where(F.col("key").isNotNull()).join(components, F.col("key") == F.col("node"), "left").select("id", "place", "row", F.coalesce("component", "key").alias("class"))
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("place"), F.col("row")))
    classes = classed.groupBy("class").agg(F.count(F.lit(1)).alias("class_size"), first.alias("first"))
    same = F.col("row") == F.col("first.row")
    grouped = classed.join(classes, "class").select(
        F.col("id").alias("doc_id"), "place", F.col("first.id").alias("class_id"), "class_size", same.alias("kept"))
    alone = rows.where(F.col("key").isNull()).select(
        F.col("id").alias("doc_id"), "place", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return grouped.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each class."""
    found = materialize(near_duplicates(docs, id_col, text_col))
    kept = found.where("kept")
    id_, place = unused(docs, "__kept_id"), unused(docs, "__kept_place")
    keys = kept.select(F.col("doc_id").alias(id_), F.col("place").alias(place)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col)) == F.col(place))
    rows = docs.join(keys, same, "left_semi")
    again = found.where("class_size > 1").groupBy("doc_id", "place").agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept")).where("rows > 1 AND kept")
    if again.head(1):  # repeated rows: ids and texts are equal, one row of each stays
        repeated = again.select(F.col("doc_id").alias(id_), F.col("place").alias(place))
        one = rows.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col])
        rows = rows.join(repeated, same, "left_anti").unionByName(one)
    return rows
