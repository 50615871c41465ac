"""SentencePiece encoding and decoding through a distinct-chunk table.

Method: when no piece of the model crosses a whitespace marker (a marker only
opens a piece) or holds a newline, the segmentation of a marked word does not
depend on its neighbours. Every text is cut into marked words (the markers and the
characters up to the next marker or newline) and newline runs, and a word is cut again behind its
letters where no piece joins a letter to the next character; each distinct chunk is
segmented once by the library and the ids are joined back by position. Decoding
joins the pieces' texts the same way.

The chunk table lives in the task: a table over the whole corpus would have to
shuffle every word occurrence, which is many times the input. It holds at most
``TABLE_CHUNKS`` chunks and starts anew beyond that, so memory is bounded and results do not
depend on it; chunks longer than ``LONG_CHUNK`` characters are segmented without
being stored. A model without the property (``separable`` is false) encodes whole texts.

Defined results: NULL is treated as empty; empty texts have no ids and decode to the
empty text; U+2581 in a text is a marker, as in the library; equal rows give equal
results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_CHUNKS = 300_000
LONG_CHUNK = 64
MARK = "▁"
_LETTER = re.compile(r"[^\W\d_]")


class ChunkEncoder:
    """ids and texts of marked words for one model."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.separable = self._separable()
        #: chunk -> decimal ids joined by commas; strings only, so the collector has nothing to walk
        self.table: dict[str, str] = {}
        #: chunk -> its decoded text where that is not the chunk itself
        self.other: dict[str, str] = {}
        if self.separable:
            self.mark = self.model.piece_to_id(MARK)
            self.newline = tuple(self.model.encode("\n"))
            self.chunk = re.compile(self._chunk_pattern())
            ids = range(self.model.get_piece_size())
            self.text_of = [None if self.model.is_byte(i) else self.model.id_to_piece(i).replace(MARK, " ") for i in ids]

    def _pieces(self) -> list[str]:
        m = self.model
        return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not m.is_byte(i)]

    def _separable(self) -> bool:
        m, pieces = self.model, self._pieces()
        inner = any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        probe = " a  béﬁ\n\n"
        identity = m.normalize(probe) == MARK + probe.replace(" ", MARK)
        newline = m.encode("\n")
        return (not inner and identity and MARK in pieces and len(newline) == 2 and newline[0] == m.piece_to_id(MARK)
                and not m.is_unknown(newline[1]) and m.decode(newline) == "\n")

    def _chunk_pattern(self) -> str:
        """A marked word ends before a newline or marker, and after its letters unless some
        piece holds a letter followed by the next character."""
        joined = {b for p in self._pieces() for a, b in zip(p, p[1:]) if _LETTER.match(a) and not _LETTER.match(b) and b != MARK}
        rest = f"(?:[{re.escape(''.join(sorted(joined)))}][^ \\n]*)?" if joined else ""
        return rf" *[^\W\d_]+{rest}| *[^ \n]+| +|\n+"

    def _segment(self, chunks: list[str]) -> dict[str, str]:
        """chunk -> decimal ids, by one call of the library; texts that differ go to ``other``."""
        # a chunk without a marker is encoded behind a newline, whose two ids are then cut off
        sources = [c[1:] if c[0] == " " else f"\n{c}" for c in chunks]
        encoded = self.model.encode(sources, num_threads=1)
        rows = []
        for c, ids in zip(chunks, encoded):
            if c == " ":
                ids = [self.mark]
            elif c[0] == "\n":
                ids = [self.newline[1]] * len(c)
            elif c[0] != " ":
                ids = ids[2:]
            rows.append(ids)
        for c, ids in zip(chunks, rows):
            try:
                text = "".join([self.text_of[i] for i in ids])
            except TypeError:  # byte pieces; behind a newline the library drops no leading marker
                text = self.model.decode([*self.newline, *ids])[1:]
            if text != c:
                self.other[c] = text
        return {c: ",".join(map(str, ids)) for c, ids in zip(chunks, rows)}

    def encode_batch(self, texts: list[str]) -> list[tuple[str, str]]:
        """(decimal ids joined by commas, decoded text) of every text."""
        if not self.separable:
            ids = self.model.encode(texts, num_threads=1)
            return [(",".join(map(str, i)), d) for i, d in zip(ids, self.model.decode(ids, num_threads=1))] if texts else []
        out = []
        for text in texts:
            chunks = self.chunk.findall(" " + text.replace(MARK, " ")) if text else []
            ids = list(map(self.table.get, chunks))
            if None in ids:
                new = self._segment(list({c for c, i in zip(chunks, ids) if i is None}))
                ids = [new[c] if i is None else i for c, i in zip(chunks, ids)]
                if len(self.table) + len(new) > TABLE_CHUNKS:
                    self.table.clear()
                self.table.update((c, i) for c, i in new.items() if len(c) <= LONG_CHUNK)
            if self.other:
                decoded = "".join([self.other.get(c, c) for c in chunks])
                self.other = {c: d for c, d in self.other.items() if c in self.table}
            else:
                decoded = "".join(chunks)
            out.append((",".join(ids), decoded[1:]))
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder_for(model_path: str | None) -> ChunkEncoder:
    """The worker's encoder; a reused worker keeps its chunk table between tasks."""
    path = model_path or default_model()
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def default_model() -> str:
    """The public 32k model; resolved where it is called, so every worker finds its own copy."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_column(text: Column, model_path: str | None = None) -> Column:
    """struct(ids array<int>, decoded string) of a text column."""

    @F.pandas_udf("ids array<int>, decoded string")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(model_path)
        for texts in batches:
            out = encoder.encode_batch([t or "" for t in texts])
            yield pd.DataFrame({"ids": [[int(i) for i in ids.split(",")] if ids else [] for ids, _ in out], "decoded": [d for _, d in out]})

    return encode(text)


def digest_column(text: Column, model_path: str | None = None) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256): the ids stay in the task."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(model_path)
        sha = hashlib.sha256
        for texts in batches:
            out = encoder.encode_batch([t or "" for t in texts])
            yield pd.DataFrame({
                "n_tokens": [ids.count(",") + 1 if ids else 0 for ids, _ in out],
                "ids_sha256": [sha(ids.encode()).hexdigest() for ids, _ in out],
                "decoded_sha256": [sha(d.encode()).hexdigest() for _, d in out],
            })

    return digest(text)


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    out = docs.select(F.col(id_col).alias("doc_id"), digest_column(F.coalesce(F.col(text_col), F.lit("")), model_path).alias("d"))
    return out.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
