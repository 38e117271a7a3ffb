"""Encoding and decoding with the pieces of a SentencePiece vocabulary.

An Aho-Corasick automaton over all pieces reads a text once. At each position it reports every piece that ends
there, by its output links, and each relaxes the best score of a segmentation up to that position (Viterbi).
A character that no one-character piece covers costs ``UNKNOWN`` below the least score and becomes byte pieces.
Among equal scores the longest last piece wins.

White space is as in the vocabulary: a space becomes U+2581, one is put before the text, nothing else changes.
No piece has U+2581 after another character, so a text falls into units (U+2581s and what follows up to the next)
that can be encoded one by one; a bounded memory keeps short ones. Where a vocabulary has other pieces, the whole
text is one unit.

Null and empty texts give no pieces and decode to an empty text. U+2581 in a text decodes to a space. A text of any
length is taken whole. Repeated rows give repeated results, an empty table an empty one. Other columns are kept whatever
their names, but one that is called as the new column is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN = 10.0
MEMO_UNITS = 300_000
MEMO_CHARS = 48


class Codec:
    _open: dict[str, Codec] = {}

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], plain: list[bool], unk_id: int = 0) -> None:
        """plain: which ids are pieces of text (not control, unknown or byte pieces)."""
        self.pieces, self.byte_ids, self.unk_id = pieces, byte_ids, unk_id
        self.bytes_of = {i: b for b, i in byte_ids.items()}
        self.plain = plain
        self.automaton = ahocorasick.Automaton()
        kept = [i for i, ok in enumerate(plain) if ok and pieces[i]]
        for i in kept:
            self.automaton.add_word(pieces[i], (len(pieces[i]), scores[i], i))
        self.automaton.make_automaton()
        self.singles = {pieces[i] for i in kept if len(pieces[i]) == 1}
        self.unknown = min((scores[i] for i in kept), default=0.0) - UNKNOWN
        inner = any(MARK in pieces[i].lstrip(MARK) for i in kept)
        self.units = re.compile(r"[\s\S]+") if inner else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        """One for each worker process, from a model file."""
        if path not in cls._open:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            n = range(sp.get_piece_size())
            byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in n if sp.is_byte(i)}
            plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in n]
            cls._open[path] = cls([sp.id_to_piece(i) for i in n], [sp.get_score(i) for i in n], byte_ids, plain, sp.unk_id())
        return cls._open[path]

    def viterbi(self, s: str) -> list[int]:
        size, singles = len(s), self.singles
        best, came = [0.0] + [-np.inf] * size, [(0, -1)] * (size + 1)
        at = 0
        for last, (length, score, piece) in self.automaton.iter(s):
            stop = last + 1
            while at < stop:
                at += 1
                if s[at - 1] not in singles:
                    best[at], came[at] = best[at - 1] + self.unknown, (at - 1, -1)
            value = best[stop - length] + score
            if value > best[stop]:
                best[stop], came[stop] = value, (stop - length, piece)
        while at < size:
            at += 1
            if s[at - 1] not in singles:
                best[at], came[at] = best[at - 1] + self.unknown, (at - 1, -1)
        out: list[int] = []
        while size:
            start, piece = came[size]
            if piece >= 0:
                out.append(piece)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(s[start:size].encode("utf-8", "surrogatepass")))
            else:
                out.append(self.unk_id)
            size = start
        return out[::-1]

    def _unit(self, s: str) -> bytes:
        ids = np.array(self.viterbi(s), "<i4").tobytes()
        if len(s) <= MEMO_CHARS:
            self.known[s] = ids
        return ids

    def encode_raw(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if len(self.known) > MEMO_UNITS:
            self.known.clear()
        known = self.known
        return b"".join([known.get(u) or self._unit(u) for u in self.units.findall(MARK + text.replace(" ", MARK))])

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_raw(text or ""), "<i4")

    def decode(self, ids: Iterable[int]) -> str:
        parts: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.bytes_of:
                held.append(self.bytes_of[i])
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held.clear()
            if self.plain[i]:
                parts.append(self.pieces[i])
            elif i == self.unk_id:
                parts.append(" ⁇ ")
        parts.append(held.decode("utf-8", "replace"))
        return "".join(parts).replace(MARK, " ").removeprefix(" ")


def encode(df: DataFrame, model: str, *, text_col: str = "text", out_col: str = "piece_ids") -> DataFrame:
    """All columns and ``piece_ids array<int>``. A column of that name is replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema

    base = df.drop(out_col)
    schema = base.select("*", F.lit(None).cast("array<int>").alias(out_col)).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model)
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 512):
                batch = whole.slice(at, 512)
                raw = [codec.encode_raw(t or "") for t in batch.column(text_col).to_pylist()]
                starts = np.zeros(len(raw) + 1, np.int32)
                np.cumsum([len(r) // 4 for r in raw], out=starts[1:])
                ids = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow)), ids.cast(arrow[-1].type)], schema=arrow)

    return base.mapInArrow(run, schema)


def decode(df: DataFrame, model: str, *, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """All columns and the decoded text."""
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec.of(model)
        for part in parts:
            yield part.map(lambda ids: codec.decode(() if ids is None else ids.tolist()))

    return df.withColumn(out_col, run(F.col(ids_col)))


def digests(df: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 of the ids, and decoded_chars and decoded_crc32 of the text decoded from them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                raw = [codec.encode_raw(t or "") for t in batch.column(1).to_pylist()]
                ids = [np.frombuffer(r, "<i4") for r in raw]
                back = [codec.decode(i.tolist()) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(pa.int64()),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                        pa.array([len(b) for b in back], pa.int64()),
                        pa.array([zlib.crc32(b.encode("utf-8", "surrogatepass")) for b in back], pa.int64()),
                    ],
                    names=["doc_id", "n_pieces", "ids_crc32", "decoded_chars", "decoded_crc32"],
                )

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_chars long, decoded_crc32 long")
