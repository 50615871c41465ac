"""Line dedup by pairwise alignment of overlapping documents.

Method: lines are hashed; every repeated line points from each later document to the first
document that holds it, so a line in a million documents gives a million links, not all
pairs. Only runs of repeated lines of at least ``MIN_BLOCK_WORDS`` words are rare enough
to matter: their documents are paired with the first holders of their lines, the two line
sequences are aligned with patience diff (lines unique to both sides, then the gaps between
them), and the aligned common blocks of that many words are deleted from the later document.
An alignment keeps one order of the lines; common blocks of that many words that stand in another order are then
looked for among the lines it left over, each from a line that occurs there on both sides.

A first holder has no earlier copy, so one copy of every line survives. A run whose lines have
different first holders is aligned with each of them and joined before its length is judged.

Defined results: lines are compared without surrounding spaces; words are runs of characters other
than white space (Unicode's, so tabs and no-break spaces separate too, any number of them once); in
scripts written without spaces every 2 characters (Han, kana, with their punctuation) or 5 characters
(Thai, Lao, Khmer, Myanmar) of a run are a word; lines of white space are blank, belong to no block and
stay; "later" is the larger id; rows with equal ids are
never compared with each other, rows with a NULL id or text pass unchanged and are no
partners; a document that loses every line has an empty text, and ``drop_repeated_lines`` drops it. Further
columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.llm.common import materialize, unused

MIN_BLOCK_WORDS = 20
_PAIRS = r"\p{IsHan}\u3001-\u30FF\uFF01-\uFFEF"
_FIVES = r"\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: One match per word (Java syntax).
WORD = rf"(?U)[{_PAIRS}]{{1,2}}|[{_FIVES}]{{1,5}}|[^\s{_PAIRS}{_FIVES}]+"


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of (i, j), sorted by i, whose j increase."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
        back.append(at[p - 1] if p else -1)
    out = []
    k = at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience_matches(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Aligned (i, j) of equal lines, increasing in both, by patience diff. In a gap without
    lines unique to both sides, the n-th occurrences of a line are aligned."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        ca, cb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        place = {b[j]: j for j in range(blo, bhi) if cb[b[j]] == 1}
        anchors = _increasing([(i, place[a[i]]) for i in range(alo, ahi) if ca[a[i]] == 1 and a[i] in place])
        if not anchors:
            seen: Counter = Counter()
            nth = {}
            for j in range(blo, bhi):
                nth[b[j], seen[b[j]]] = j
                seen[b[j]] += 1
            seen = Counter()
            pairs = []
            for i in range(alo, ahi):
                j = nth.get((a[i], seen[a[i]]))
                seen[a[i]] += 1
                if j is not None:
                    pairs.append((i, j))
            out += _increasing(pairs)
            continue
        i0, j0 = alo, blo
        for i, j in anchors:
            out.append((i, j))
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, ahi, j0, bhi))
    return sorted(out)


def moved_matches(a: Sequence, b: Sequence, words: Sequence[int], matches: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """(i, j) of the blocks of ``least`` words or more that ``matches`` left over on both sides, in whatever
    order they stand. ``words`` are those of the lines of ``b``."""
    used_a, used_b = {i for i, _ in matches}, {j for _, j in matches}
    out: list[tuple[int, int]] = []

    def free(i: int, j: int) -> bool:
        return 0 <= i < len(a) and 0 <= j < len(b) and a[i] == b[j] and i not in used_a and j not in used_b

    while True:
        places: dict = {}
        for i in range(len(a)):
            if i not in used_a:
                places.setdefault(a[i], []).append(i)
        nth: Counter = Counter()
        anchors = []
        for j in range(len(b)):
            if j not in used_b and nth[b[j]] < len(places.get(b[j], ())):
                anchors.append((places[b[j]][nth[b[j]]], j))
                nth[b[j]] += 1
        before, judged = len(out), set()
        for i, j in anchors:
            if (i, j) in judged or not free(i, j):
                continue
            back = 0
            while free(i - back - 1, j - back - 1):
                back += 1
            block = []
            while free(i - back, j - back):
                block.append((i - back, j - back))
                back -= 1
            judged.update(block)
            if sum(words[y] for _, y in block) >= least:
                out += block
                used_a.update(x for x, _ in block)
                used_b.update(y for _, y in block)
        if len(out) == before:
            return out


def _aligner(least: int):
    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hit = []
            for first, own, words in zip(pdf["first_lines"], pdf["own_lines"], pdf["own_words"]):
                a, b = first.tolist(), own.tolist()
                matches = patience_matches(a, b)
                hit.append([j for _, j in matches + moved_matches(a, b, words.tolist(), matches, least)])
            yield pd.DataFrame({"id": pdf["id"], "place": pdf["place"], "aligned": hit})

    return align


def _hashed_lines(text: Column) -> Column:
    """Non-blank lines as structs of position, two hashes and words."""
    def one(line: Column, pos: Column) -> Column:
        bare = F.trim(F.rtrim(line, F.lit("\r ")))
        words = F.regexp_count(bare, F.lit(WORD))
        return F.struct(pos.alias("pos"), F.xxhash64(bare).alias("h"), F.hash(bare).alias("h2"), words.alias("words"))

    return F.filter(F.transform(F.split(text, "\n"), one), lambda x: x["words"] > 0)


def _long_runs(rows: DataFrame, least: int) -> DataFrame:
    """Rows (id, place, idx, words, ...) in runs of consecutive idx of at least ``least`` words."""
    doc = Window.partitionBy("id", "place")
    numbered = rows.withColumn("run", F.col("idx") - F.row_number().over(doc.orderBy("idx")))
    return numbered.withColumn("run_words", F.sum("words").over(Window.partitionBy("id", "place", "run"))).where(F.col("run_words") >= least).drop("run", "run_words")


def repeated_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(id, place, deleted, words): the line positions to delete per document that loses any;
    ``place`` is the hash of its text."""
    lines = materialize(docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("place"), _hashed_lines(F.col(text_col)).alias("lines")))
    found = lines.select("id", "place", F.posexplode("lines").alias("idx", "l")).select("id", "place", "idx", "l.*")
    firsts = found.groupBy("h", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    repeated = found.join(firsts, ["h", "h2"]).where("first < id")
    # one row per position even when a repeated row has brought it twice
    repeated = repeated.groupBy("id", "place", "idx").agg(F.first("words").alias("words"), F.first("first").alias("first"))
    pairs = _long_runs(repeated, min_block_words).select("id", "place", "first").distinct()
    hashes = lines.select("id", "place", F.col("lines.h").alias("own_lines"), F.col("lines.words").alias("own_words")).dropDuplicates(["id", "place"])
    partners = hashes.select(F.col("id").alias("first"), F.col("own_lines").alias("first_lines"))
    aligned = (
        pairs.join(hashes, ["id", "place"]).join(partners, "first").select("id", "place", "first_lines", "own_lines", "own_words")
        .mapInPandas(_aligner(min_block_words), f"id {docs.schema[id_col].dataType.simpleString()}, place long, aligned array<int>")
    )
    marked = aligned.select("id", "place", F.explode("aligned").alias("idx")).distinct()
    where = lines.select("id", "place", "lines").dropDuplicates(["id", "place"])
    spots = marked.groupBy("id", "place").agg(F.collect_set("idx").alias("marked")).join(where, ["id", "place"]).select(
        "id", "place", F.explode("marked").alias("idx"), "lines").select(
        "id", "place", "idx", F.col("lines")[F.col("idx")]["pos"].alias("pos"), F.col("lines")[F.col("idx")]["words"].alias("words"))
    return materialize(_long_runs(spots, min_block_words).groupBy("id", "place").agg(
        F.collect_set("pos").alias("deleted"), F.sum("words").alias("words")))


def delete_repeated_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_block_words: int = MIN_BLOCK_WORDS,
                           count: str | None = None) -> DataFrame:
    """``docs`` with the aligned common blocks taken out of the texts of later documents.

    ``count`` names a further column with the number of deleted lines."""
    blocks = repeated_blocks(docs, id_col, text_col, min_block_words)
    names = {c: unused(docs, f"__{c}") for c in blocks.columns}
    blocks = blocks.select(*[F.col(c).alias(names[c]) for c in blocks.columns])
    joined = docs.join(blocks, (F.col(id_col) == F.col(names["id"])) & (F.xxhash64(F.col(text_col)) == F.col(names["place"])), "left")
    gone = F.col(names["deleted"])
    rest = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(gone.isNull(), F.col(text_col)).otherwise(rest)
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if count:
        columns.append(F.coalesce(F.size(gone), F.lit(0)).alias(count))
    return joined.select(*columns)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``delete_repeated_blocks`` without the documents that lose all they had."""
    n = unused(docs, "__deleted_lines")
    cut = delete_repeated_blocks(docs, id_col, text_col, min_block_words, count=n)
    return cut.where((F.col(n) == 0) | F.col(text_col).isNull() | F.col(text_col).rlike(r"(?U)\S")).drop(n)
