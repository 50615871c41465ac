"""Mixing sources to target weights by hash-threshold histograms.

Method: sizes are summed by (source, bucket of a 60-bit hash of the document
id); the running sum over a source's buckets shows in which bucket its budget ends;
only that boundary bucket is summed again by the next 10 bits, until it holds a
single hash value. Buckets nest, so every level reads only rows of the bucket
above it. The result is one threshold per source and the mix is the filter
``hash < threshold``: no sort of documents, the same rows in every run.

A target above a source's size is met by whole repeats of the source plus one
threshold for the rest, so each document is taken ``floor`` or ``floor + 1`` times.

Targets: source weights repeat in source order (code points, NULL last) and share
the total size; a target stops at ``max_repeats`` times its source's size and the
excess is shared again by weight among the others. Sorted by
``cap / weight`` this has a closed form: the first source k whose common level
``(total - caps before k) / (weights from k on)`` does not pass its own ratio sets
the level for all sources from k on. The per-source table (one row per source) is
the only thing sorted.

Defined results: NULL text has size 0; sources of size 0 get target 0; NULL is a
source of its own; an empty table gives no rows. Rows with equal or NULL ids share a hash: where the
budget ends among them, they are told apart by a hash of their text, and rows equal in
that too by a hash of their place in the input, so that a hot id is split like any bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.llm.common import materialize, unused

HASH_BITS = 60
LEVEL_BITS = 10
WORD = r"[^\x20\x09-\x0D]+"
HASHES, CUTS = ("hash", "text_hash", "place_hash"), ("cut", "text_cut", "place_cut")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(key: Column) -> Column:
    """60-bit hash of a document id."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def row_hashes(id_: Column, text: Column) -> dict[str, Column]:
    """The hashes a row is compared by, one after the other: of its id, its text and its place."""
    top = 64 - HASH_BITS
    return {
        "hash": id_hash(id_),
        "text_hash": F.shiftrightunsigned(F.xxhash64(text.isNull(), text), top),
        "place_hash": F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), top),
    }


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeats: float = 3.0) -> DataFrame:
    """Add weight and target to ``sizes`` (source, source_size); one row per source."""
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(max_repeats))
    by_ratio = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = weighted.withColumns({
        "ratio": cap / F.col("weight"),
        "level": (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    })
    common = F.min(F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(whole)
    level = F.max(F.when((F.col("ratio") == F.col("first_ratio")) & (F.col("level") <= F.col("ratio")), F.col("level"))).over(whole)
    leveled = levels.withColumn("first_ratio", common).withColumn("common_level", level)
    target = F.when(F.col("common_level").isNull(), cap).otherwise(F.least(cap, F.col("common_level") * F.col("weight")))
    return leveled.select("source", "source_size", "weight", target.alias("target"))


def _narrow(rows: DataFrame, hash_: str, open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the budgets of ``open_`` (source, rest, before) end in the order of one hash of ``rows``.

    Returns (source, value) of the sources whose boundary is found, and (source, rest, before, value) of those
    whose budget ends among several rows of one hash value."""
    open_ = open_.select("source", "rest", "before", F.lit(0).cast("long").alias("prefix"))
    cuts, ties = [], []
    for used in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        below = HASH_BITS - used
        level = rows.select("source", "size", F.col(hash_).alias("hash"), F.shiftright(hash_, below + LEVEL_BITS).alias("prefix"))
        inside = level.alias("r").join(open_.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.prefix") == F.col("o.prefix")))
        sums = inside.groupBy(F.col("r.source").alias("source"), F.shiftright("hash", below).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("lowest"), F.max("hash").alias("highest"), F.count(F.lit(1)).alias("rows"),
            F.first("rest").alias("rest"), F.first("before").alias("start"))
        upto = Window.partitionBy("source").orderBy("bucket")
        running = sums.withColumn("end", F.col("start") + F.sum("words").over(upto))
        # the first bucket that passes the budget; none: everything is taken
        first = running.where(F.col("end") > F.col("rest")).groupBy("source").agg(
            F.min(F.struct("bucket", "end", "words", "lowest", "highest", "rest", "rows")).alias("b"))
        boundary = materialize(first.select(
            "source", F.col("b.rest").alias("rest"), (F.col("b.end") - F.col("b.words")).alias("before"), F.col("b.bucket").alias("prefix"),
            F.col("b.end").alias("end"), F.col("b.lowest").alias("lowest"), F.col("b.highest").alias("highest"), F.col("b.rows").alias("rows")))
        single = F.col("lowest") == F.col("highest")
        # one row left: take it if that comes nearer to the budget
        nearer = F.col("end") + F.col("before") <= F.col("rest") * 2
        cuts.append(boundary.where(single & (F.col("rows") == 1)).select("source", (F.col("lowest") + nearer.cast("long")).alias("value")))
        ties.append(boundary.where(single & (F.col("rows") > 1)).select("source", "rest", "before", F.col("lowest").alias("value")))
        open_ = boundary.where(~single).select("source", "rest", "before", "prefix")
        if not open_.head(1):
            break
    return reduce(DataFrame.unionByName, cuts), reduce(DataFrame.unionByName, ties)


def _thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, cut, text_cut, place_cut): rows whose hashes come before these, compared one after
    the other, are taken once more. The later two are 0 where an earlier hash decides."""
    # rest: the budget beyond whole repeats; before: words below the open bucket
    open_ = sources.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("before"))
    outer, found, ends = [], [], None
    for i, hash_ in enumerate(HASHES):
        decided, tied = _narrow(rows, hash_, open_)
        pad = [F.lit(0).cast("long").alias(n) for n in CUTS[i + 1:]]
        if outer:
            decided = decided.alias("d").join(ends.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source"))).select("d.source", *[f"e.{n}" for n in outer], "d.value")
        found.append(decided.select("source", *outer, F.col("value").alias(CUTS[i]), *pad))
        if i == 2 or not tied.head(1):
            break
        if outer:
            tied = tied.alias("d").join(ends.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source"))).select(
                "d.source", "d.rest", "d.before", "d.value", *[f"e.{n}" for n in outer])
        ends = tied.withColumnRenamed("value", CUTS[i])
        outer = list(CUTS[:i + 1])
        rows = rows.alias("r").join(ends.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col(f"r.{hash_}") == F.col(f"e.{CUTS[i]}"))).select("r.*")
        open_ = ends.select("source", "rest", "before")
    return reduce(DataFrame.unionByName, found)


def _per_source(rows: DataFrame, weights: Sequence[float], max_repeats: float) -> DataFrame:
    """(mix_source, source_size, target, whole and the cuts) from rows (source, size and the hashes)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = materialize(source_targets(sizes, weights, max_repeats).withColumn("whole", whole))
    s, c = sources.alias("s"), _thresholds(rows, sources).alias("c")
    return materialize(s.join(c, F.col("s.source").eqNullSafe(F.col("c.source")), "left").select(
        F.col("s.source").alias("mix_source"), "source_size", "target", "whole", F.coalesce("cut", F.lit(2**HASH_BITS)).alias("cut"),
        F.coalesce("text_cut", F.lit(0)).alias("text_cut"), F.coalesce("place_cut", F.lit(0)).alias("place_cut")))


def _times(source_size: Column, whole: Column, cuts: Sequence[Column], hashes: Sequence[Column], max_repeats: float) -> Column:
    more = F.struct(*[h.alias(f"h{i}") for i, h in enumerate(hashes)]) < F.struct(*[c.alias(f"h{i}") for i, c in enumerate(cuts)])
    taken = F.least(whole + more.cast("long"), F.lit(int(max_repeats)).cast("long"))
    return F.when(source_size > 0, taken).otherwise(F.lit(0).cast("long"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    hashes = row_hashes(F.col(id_col), F.col(text_col))
    return materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *[c.alias(n) for n, c in hashes.items()]))


def mix_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: float = 3.0, id_col: str = "doc_id",
             text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, times and taken (words)."""
    rows = _sized(docs, id_col, text_col, source_col)
    per_source = _per_source(rows, weights, max_repeats)
    times = _times(F.col("source_size"), F.col("whole"), [F.col(c) for c in CUTS], [F.col(h) for h in HASHES], max_repeats)
    return rows.join(per_source, F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("times", times).select(
        "doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: float = 3.0, id_col: str = "doc_id",
                  text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: the rows of ``docs`` with their columns, each as often as the plan takes it."""
    per_source = _per_source(_sized(docs, id_col, text_col, source_col), weights, max_repeats)
    names = {c: unused(docs, f"__{c}") for c in [*per_source.columns, *HASHES, "copy"]}
    renamed = per_source.select(*[F.col(c).alias(names[c]) for c in per_source.columns])
    keyed = docs.withColumns({names[n]: c for n, c in row_hashes(F.col(id_col), F.col(text_col)).items()})
    times = _times(F.col(names["source_size"]), F.col(names["whole"]), [F.col(names[c]) for c in CUTS], [F.col(names[h]) for h in HASHES], max_repeats)
    return (
        keyed.join(renamed, F.col(source_col).eqNullSafe(F.col(names["mix_source"])))
        .withColumn(names["copy"], F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
