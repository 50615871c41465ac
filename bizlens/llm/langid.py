"""Language identification by words first, then shorter and shorter n-grams.

Method: a known word adds its per-language log frequency; an unseen word is scored by the
longest order of its character n-grams (with word boundaries) of which the model knows
any, from ``ORDERS[0]`` down to single characters, as the mean of their log frequencies. The
language with the largest sum wins.

The classifier is fitted on a bounded sample of labelled rows: about ``sample_docs`` whole
documents per language, chosen by a hash of the id (all documents of a language that has
fewer). Words and n-grams are counted by Spark over that sample, and all of them make the
broadcast model: the sample bounds its size, no entry is left out. Rows with
``crc32(id) mod 5 = 0`` are held out of training.

Defined results: NULL text and text without a letter give ``und`` with score 0, as does
everything when there is no labelled row; ties go to the first language in code point order;
a NULL id counts as held out; the score is the winner's posterior under equal priors.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import materialize, unused

SAMPLE_DOCS = 2_000
ORDERS = (5, 4, 3, 2, 1)
FOLDS = 5
UNDETERMINED = "und"
#: Unseen words remembered per task.
CACHE_WORDS = 200_000
_SMOOTH = 0.5
_WORD = re.compile(r"[^\W\d_]+")
#: Numerals that are no decimal digits, as in squares and halves: word characters, but no letters.
_NUMERALS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and unicodedata.category(c) in ("No", "Nl"))


def words_of(text: str) -> list[str]:
    text = text.lower()
    if not _NUMERALS.isdisjoint(text):
        text = "".join(" " if c in _NUMERALS else c for c in text)
    return _WORD.findall(text)


def grams_of(word: str, order: int) -> list[str]:
    """n-grams of ``word`` with a boundary mark on either side; single characters without."""
    if order == 1:
        return list(word)
    w = f"<{word}>"
    return [w[i:i + order] for i in range(len(w) - order + 1)]


@dataclass
class Table:
    """Items with one row of smoothed log frequencies (a column per language). The items stay one Arrow array, on the
    driver and on the way; their places are looked up where the model is used."""

    items: pa.Array
    rows: np.ndarray

    @cached_property
    def place(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.items.to_pylist())}


@dataclass
class Model:
    """Words, and n-grams of all orders in one table (their length tells the order)."""

    langs: list[str]
    words: Table
    grams: Table

    def backoff(self, words: list[str]) -> np.ndarray:
        """Rows of unseen words: each by its longest order with a known n-gram."""
        flat, counts = [], []
        get = self.grams.place.get
        for word in words:
            known: list[int] = []
            for order in ORDERS:
                known = [i for i in map(get, grams_of(word, order)) if i is not None]
                if known:
                    break
            flat += known
            counts.append(len(known))
        out = np.zeros((len(words), len(self.langs)), np.float32)
        n = np.array(counts)
        some = n > 0
        if some.any():
            ends = np.cumsum(n[some])
            out[some] = np.add.reduceat(self.grams.rows[flat], ends - n[some], axis=0) / n[some][:, None]
        return out


class Predictor:
    """A model with the rows of the unseen words that one task has met."""

    def __init__(self, model: Model, cache_words: int = CACHE_WORDS):
        self.model, self.limit = model, cache_words
        self.known = len(model.words.place)
        self.place = dict(model.words.place)
        self.rows = np.zeros((self.known + cache_words, len(model.langs)), np.float32)
        if self.known:
            self.rows[:self.known] = model.words.rows

    def total(self, text: str) -> np.ndarray | None:
        """Summed log frequencies, None for a text without words."""
        found = Counter(words_of(text))
        if not found:
            return None
        index = list(map(self.place.get, found))
        counts = np.fromiter(found.values(), np.float64, len(found))
        if None not in index:
            return counts @ self.rows[index]
        unseen = [w for w, i in zip(found, index) if i is None]
        rows = self.model.backoff(unseen)
        seen = np.array([i is not None for i in index])
        total = counts[~seen] @ rows
        if seen.any():
            total = total + counts[seen] @ self.rows[[i for i in index if i is not None]]
        if len(unseen) <= self.limit:
            if len(self.place) + len(unseen) > len(self.rows):
                self.place = dict(self.model.words.place)
            at = len(self.place)
            self.rows[at:at + len(unseen)] = rows
            self.place.update(zip(unseen, range(at, at + len(unseen))))
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        total = self.total(text) if text and self.model.langs else None
        if total is None:
            return UNDETERMINED, 0.0
        best = int(np.argmax(total))
        return self.model.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def fold(key: Column) -> Column:
    return F.pmod(F.coalesce(F.crc32(key.cast("string")), F.lit(0)), F.lit(FOLDS))


def _rows(found: dict[str, Counter]) -> Iterator[pd.DataFrame]:
    for lang, items in found.items():
        yield pd.DataFrame({"lang": lang, "item": list(items), "n": list(items.values())})


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found: dict[str, Counter] = {}
        for lang, text in zip(pdf["lang"], pdf["text"]):
            found.setdefault(lang, Counter()).update(words_of(text))
        yield from _rows(found)


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found: dict[str, Counter] = {}
        for lang, word, n in zip(pdf["lang"], pdf["item"], pdf["n"]):
            counts = found.setdefault(lang, Counter())
            for order in ORDERS:
                for g in grams_of(word, order):
                    counts[g] += n
        yield from _rows(found)


def _table(counts: pa.Table, langs: list[str], sizes: dict[int, dict[str, float]], order_of) -> Table:
    """Smoothed log frequencies; ``sizes``: items counted per order and language."""
    coded = counts.column("item").combine_chunks().dictionary_encode()
    items = coded.dictionary
    out = np.zeros((len(items), len(langs)))
    column = pc.index_in(counts.column("lang").combine_chunks(), pa.array(langs, pa.string())).to_numpy()
    np.add.at(out, (coded.indices.to_numpy(), column), counts.column("n").to_numpy())
    out += _SMOOTH
    np.log(out, out=out)
    orders = order_of(items)
    for o in np.unique(orders).tolist():
        here = orders == o
        out[here] -= np.log([sizes[o].get(lang, 0.0) + _SMOOTH * here.sum() for lang in langs])
    return Table(items, out.astype(np.float32))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS) -> Model:
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("id")) != 0))
    per_lang = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(per_lang)
    if not langs:
        return Model([], *[Table(pa.array([], pa.string()), np.zeros((0, 0), np.float32)) for _ in range(2)])
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample_docs / per_lang[lang]))])
    draw = F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit("langid")), 11) / F.lit(float(2**53))
    sample = labelled.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")
    words = materialize(sample.mapInPandas(_count_words, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")))
    grams = materialize(words.mapInPandas(_count_grams, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")))
    word_sizes = {r["lang"]: float(r["n"]) for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # counts of a bounded sample: the model itself, one row per language and item
    known = _table(words.toArrow(), langs, {1: word_sizes}, lambda items: np.ones(len(items), int))
    order = F.length("item")
    sums = grams.groupBy(order.alias("gram_order"), "lang").agg(F.sum("n").alias("n")).collect()
    gram_sizes: dict[int, dict[str, float]] = {o: {} for o in ORDERS}
    for r in sums:
        gram_sizes[r["gram_order"]][r["lang"]] = float(r["n"])
    return Model(langs, known, _table(grams.toArrow(), langs, gram_sizes, lambda items: pc.utf8_length(items).to_numpy()))


def predict_column(docs: DataFrame, text: Column, model: Model) -> Column:
    """struct(lang_pred, score) of a text column; the model is broadcast once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(shared.value)
        for texts in batches:
            yield pd.DataFrame([predictor.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = model or train(docs, id_col, text_col, lang_col)
    out = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col)) == 0).alias("held_out"),
                      predict_column(docs, F.col(text_col), model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, least_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language is undetermined or scores below ``least_score``."""
    if not math.isfinite(least_score):
        raise ValueError("least_score must be a number")
    model = train(docs, id_col, text_col, lang_col)
    p = unused(docs, "__language")
    tagged = docs.withColumn(p, predict_column(docs, F.col(text_col), model))
    kept = tagged.where((F.col(f"{p}.lang_pred") != UNDETERMINED) & (F.col(f"{p}.score") >= least_score))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
