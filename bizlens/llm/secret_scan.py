"""Secret scan: fixed patterns plus dictionary-primed compression novelty.

Method: candidates are all runs of key-like characters that follow a
sensitive word within ``REACH`` characters, however many there are; a rejected run hides no later one. A zstandard dictionary is primed with the
identifiers of the corpus; a candidate's marginal bytes are the compressed size of its
surroundings with the candidate minus the size without it (other copies of the
candidate are taken out of the surroundings first). Identifiers, paths and repeated text
shrink against the dictionary or the surroundings; a secret does not: spans whose marginal bytes
reach a share of their length are reported as ``novel`` unless they overlap a base span.
No code goes below the entropy of a run's alphabet (upper-case hex: 0.5 bytes), so a run is judged by its own: the share is
``EVEN`` of the entropy of its characters plus what a code needs to start (``START_UP`` characters), at most ``NOVELTY``.
That holds for runs that mix kinds of characters as random keys do: digits alone, capitals with digits, or a change between lower case, upper
case and digits at ``MIXED`` of the positions or more, with at least ``LEAST_BITS`` of entropy. Names and paths change kind
seldom and are never reported; a key of one case of letters alone is not told from them.

Base spans, leftmost and non-overlapping per kind (ASCII letters in either case for
``assign``): assigned values of 6+ characters, access keys of 20+, hex runs of 24+.

The dictionary counts identifiers (names before ``:`` or ``=``) over all documents and holds the
most frequent ones up to ``DICTIONARY`` names after the fixed list of common names; zstandard
dictionaries are small by design. Only these counts pass the shuffle.

Defined results: a NULL or empty text has no spans (empty ``spans``, digest of the empty string);
spans count code points, end exclusive, of the whole match; equal rows give equal rows; an
empty table gives none; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import materialize

KINDS = ("assign", "access", "hex", "novel")
#: Fixed values of the base patterns: pattern, group that is measured, least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
#: Common names that any code shares; they open the dictionary.
COMMON_NAMES = (
    "name value index count length result config options default return function class import string number "
    "object array list dict map key password passwd secret token api_key apikey access_key private_key client_id "
    "client_secret username user_id session authorization bearer content_type application json https http host port "
    "url path file version data status message error timeout self this null none true false"
).split()
DICTIONARY = 2_000
REACH = 48
SURROUNDING = 256
LEAST = 16
NOVELTY = 0.75
EVEN = 0.92
START_UP = 10
MIXED = 0.15
LEAST_BITS = 2.5
_CUE = re.compile(r"pass(?:word|wd|phrase)|secret|token|api[_ -]?key|credential|bearer|private[_ -]?key|access[_ -]?key|authorization", re.I | re.A)
_RUN = re.compile(r"[A-Za-z0-9+/_=.\-]{%d,}" % LEAST)
_NAME_END = re.compile(r"""([A-Za-z_][A-Za-z0-9_]{2,40})["']?\x20*$""")
_SIGN = re.compile(r"[:=]")
_CAPITAL = re.compile("U(?=ll)")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in no order."""
    out = []
    for kind, pattern, group, least in BASE:
        if (kind == "access" and "AKIA" not in text) or (kind == "assign" and ":" not in text and "=" not in text):
            continue
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Every key-like run that starts within ``REACH`` of a sensitive word, whole and once."""
    last = 0
    for cue in _CUE.finditer(text):
        for m in _RUN.finditer(text, max(last, cue.end()), min(len(text), cue.end() + REACH + LEAST)):
            last = _RUN.match(text, m.start()).end()  # the whole run, beyond the reach too
            yield m.start(), last


class Taken:
    """Answers whether a span overlaps one of the given ones, by their sorted union."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts, self.ends = [], []
        for start, end in sorted((s, e) for s, e, _ in spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at < len(self.starts) and self.starts[at] < end


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: Novelty) -> Iterator[tuple[int, int]]:
    """Novel candidates that overlap no span in ``taken``. Of a run that is
    not, the parts after sensitive words inside it are judged: ``x_credential=...`` is one run."""
    covered = Taken(taken)

    def novel(start: int, end: int) -> bool:
        return not covered.overlaps(start, end) and novelty.reached(text, start, end)

    for start, end in candidates(text):
        if novel(start, end):
            yield start, end
            continue
        cues = list(_CUE.finditer(text, start, end))
        for cue, stop in zip(cues, [*(c.start() for c in cues[1:]), end]):
            if stop - cue.end() >= LEAST and novel(cue.end(), stop):
                yield cue.end(), stop


class Novelty:
    """Marginal compressed bytes against a primed dictionary."""

    def __init__(self, names: list[str]):
        import zstandard

        # zstandard reaches the end of a dictionary first: rare names lead, common ones close it
        primed = zstandard.ZstdCompressionDict("\n".join(reversed(names)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode()))

    def ratio(self, text: str, start: int, end: int) -> float:
        run = text[start:end]
        before = text[max(0, start - SURROUNDING):start].replace(run, "")
        after = text[end:end + SURROUNDING].replace(run, "")
        return (self.size(before + run + after) - self.size(before + after)) / len(run.encode())

    def reached(self, text: str, start: int, end: int) -> bool:
        least = least_ratio(text[start:end])
        return least is not None and self.ratio(text, start, end) >= least


def looks_mixed(run: str) -> bool:
    """Digits alone, or a change of kind at ``MIXED`` of the positions (a capital before two small letters opens a word),
    or capitals and digits with nothing between them."""
    kinds = "".join("d" if c.isdigit() else "U" if c.isupper() else "l" if c.islower() else "" for c in run)
    if not kinds.strip("d"):
        return len(kinds) >= 0.9 * len(run)
    if "l" not in kinds and "d" in kinds and len(kinds) == len(run):
        return True
    kinds = _CAPITAL.sub("l", kinds)
    return sum(x != y for x, y in zip(kinds, kinds[1:])) >= MIXED * (len(run) - 1)


def least_ratio(run: str) -> float | None:
    """Marginal bytes per character from which a run is novel; None: never."""
    bits = sum(n * math.log2(len(run) / n) for n in Counter(run).values()) / len(run)
    if bits < LEAST_BITS or not looks_mixed(run):
        return None
    return min(NOVELTY, EVEN * bits / 8 * (1 + START_UP / len(run)))


def find_spans(text: str | None, novelty: Novelty) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start, then kind as listed."""
    if not text:
        return [], []
    base = base_spans(text)
    more = [(s, e, "novel") for s, e in novel_spans(text, base, novelty)]
    order = lambda x: (x[0], KINDS.index(x[2]))
    return sorted(base, key=order), sorted(base + more, key=order)


def _count_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found: Counter = Counter()
        for text in pdf["text"]:
            if text:
                for sign in _SIGN.finditer(text):
                    m = _NAME_END.search(text[max(0, sign.start() - 48):sign.start()])
                    if m and not (len(m[1]) >= LEAST and looks_mixed(m[1])):  # a value before padding is no name
                        found[m[1]] += 1
        if found:
            yield pd.DataFrame(list(found.items()), columns=["name", "n"])


def identifier_dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> list[str]:
    """The fixed names, then the corpus's identifiers, most frequent first: at most ``size``
    of them, all names of one count in or out."""
    counts = materialize(docs.select(F.col(text_col).alias("text")).mapInPandas(_count_names, "name string, n long")
                         .groupBy("name").agg(F.sum("n").alias("n")))
    least, room = None, size
    for row in counts.groupBy("n").agg(F.count(F.lit(1)).alias("names")).orderBy(F.desc("n")).toLocalIterator():
        room -= row["names"]
        if room < 0:
            break
        least = row["n"]
    learned = [] if least is None else [r["name"] for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "name").collect()]
    return list(dict.fromkeys([*COMMON_NAMES, *learned]))


def spans_column(text: Column, names: list[str]) -> Column:
    """struct(base array, spans array) of "kind:start:end" texts."""

    @F.pandas_udf("base array<string>, spans array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        novelty = Novelty(names)
        show = lambda spans: [f"{k}:{s}:{e}" for s, e, k in spans]
        for texts in batches:
            found = [find_spans(t, novelty) for t in texts]
            yield pd.DataFrame({"base": [show(b) for b, _ in found], "spans": [show(a) for _, a in found]})

    return scan(text)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: list[str] | None = None) -> DataFrame:
    """doc_id, base (array) and spans (array) of every document."""
    names = names if names is not None else identifier_dictionary(docs, text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), spans_column(F.col(text_col), names).alias("s"))
    return out.select("doc_id", "s.base", "s.spans")


def span_digests(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans joined by commas."""
    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: F.startswith(x, F.lit(f"{kind}:")))).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", n("assign"), n("access"), n("hex"),
                          F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


def redact(docs: DataFrame, mask: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every reported span replaced by ``mask`` (overlapping spans by one mask)."""
    names = identifier_dictionary(docs, text_col)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        novelty = Novelty(names)

        def one(text):
            out, at = [], 0
            for start, end, _ in find_spans(text, novelty)[1]:
                if start >= at:
                    out += [text[at:start], mask]
                at = max(at, end)
            return text if not out else "".join([*out, text[at:]])

        for texts in batches:
            yield texts.map(one, na_action="ignore")

    return docs.withColumn(text_col, clean(F.col(text_col)))


def sha256_of(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
