"""Token ids of documents as bit-packed blocks.

Each id takes the fewest bits that the vocabulary needs. A block is self-describing:

    magic "TFB1", width u8, 3 bytes of zero, documents u32, ids u64   (little-endian, 20 bytes)
    (documents + 1) x u64: where each document's ids begin in the block
    ids packed from the low bit of 64-bit words on

so numpy unpacks a whole block at once, and any document alone. Blocks are rows of a Parquet table, which any
store that Spark reaches can hold, and lost tasks are written anew by Spark's own commit protocol.

Null texts count as empty. Rows with equal ids are ordered by text; a null id comes first. Columns other than the
two named are ignored. A text of any length stays in one block. An empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.text import slices, tidy, utf8

BLOCK_IDS = 1 << 18
SLICE_BYTES = 4 << 20
MEMO_UNITS = 1_000_000
MEMO_CHARS = 64
JOINED_UNITS = 64
_HEAD = struct.Struct("<4sB3xIQ")

# What the tokenizer's pattern takes as white space, and classes of bytes.
_SPACE = "\t-\r \x85\xa0  -     　"
_WHITE, _PUNCT, _QUOTE, _LETTER, _LEAD, _RARE = (1 << i for i in range(6))
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _WHITE
_CLASS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _PUNCT
_CLASS[0x27] = _PUNCT | _QUOTE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0xC3:0xC9] = _LEAD  # with any second byte but those of the signs U+00D7 and U+00F7 a Latin letter
_CLASS[[0xC2, 0xE1, 0xE2, 0xE3]] = _RARE  # begins all white space beyond ASCII
_WIDE_SPACES = [c.encode() for c in re.findall(f"[{_SPACE}]", "".join(map(chr, range(0x80, 0x3001))))]


def pack(ids: np.ndarray, width: int) -> bytes:
    """64 ids fill ``width`` words of 64 bits, so each of the 64 places has a fixed word and shift."""
    rows = -(-len(ids) // 64)
    grid = np.zeros((rows, 64), np.uint64)
    grid.reshape(-1)[: len(ids)] = ids
    out = np.zeros((rows, width), np.uint64)
    for place in range(64):
        word, shift = divmod(place * width, 64)
        out[:, word] |= grid[:, place] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= grid[:, place] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(packed: np.ndarray, width: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of the packed words."""
    low, high = start // 64, -(-stop // 64)
    rows = packed[low * width : high * width].reshape(-1, width)
    out, mask = np.empty((len(rows), 64), np.uint32), np.uint64((1 << width) - 1)
    for place in range(64):
        word, shift = divmod(place * width, 64)
        value = rows[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (rows[:, word + 1] << np.uint64(64 - shift))
        out[:, place] = value & mask
    return out.reshape(-1)[start - low * 64 : stop - low * 64]


def block(documents: list[np.ndarray], width: int) -> bytes:
    starts = np.zeros(len(documents) + 1, "<u8")
    np.cumsum([len(d) for d in documents], out=starts[1:])
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {ids.max()} doesn't fit in {width} bits")
    return _HEAD.pack(b"TFB1", width, len(documents), len(ids)) + starts.tobytes() + pack(ids, width)


class Block:
    """A block's documents, by their place in it."""

    def __init__(self, raw: bytes) -> None:
        magic, self.width, self.documents, self.ids = _HEAD.unpack_from(raw)
        if magic != b"TFB1":
            raise ValueError("not a token block")
        self.starts = np.frombuffer(raw, "<u8", self.documents + 1, _HEAD.size).astype(np.int64)
        self._packed = np.frombuffer(raw, "<u8", offset=_HEAD.size + 8 * (self.documents + 1))

    def all(self) -> np.ndarray:
        return unpack(self._packed, self.width, 0, self.ids)

    def __getitem__(self, i: int) -> np.ndarray:
        return unpack(self._packed, self.width, int(self.starts[i]), int(self.starts[i + 1]))


def unit_starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Marks bytes before which the pattern of byte-level BPE always parts a text, so that what lies between is encoded alike alone and in the text.

    ``rows``: where texts begin, and the end of the last. The pattern parts before white space; before the last sign of white space and, if that is no
    blank, after it, where other text follows; between a letter and a sign after it; and between a sign, but for the apostrophe of ``'s``, and a letter after it.
    """
    kind = _CLASS[data]
    white = (kind & _WHITE) > 0
    wide = np.flatnonzero(kind & _RARE)
    if len(wide):
        first, second, third = (data[np.minimum(wide + i, len(data) - 1)].astype(np.uint32) for i in range(3))
        for c in _WIDE_SPACES:
            code = first << 8 | second if len(c) == 2 else first << 16 | second << 8 | third
            at = wide[code == int.from_bytes(c, "big")]
            for i in range(len(c)):
                white[at + i] = True
    letter, sign = (kind & _LETTER) > 0, (kind & _PUNCT) > 0
    letter_ends = letter.copy()
    second = np.flatnonzero(kind[:-1] & _LEAD) + 1
    letter_ends[second] = (data[second] != 0x97) & (data[second] != 0xB7)
    starts = np.zeros(len(data) + 1, bool)
    starts[rows] = True
    other = np.flatnonzero(white[:-1] & ~white[1:] & ~starts[1:-1]) + 1  # follows white space of its text
    starts[1:-1] |= (white[1:] & ~white[:-1]) | (letter_ends[:-1] & sign[1:]) | (sign[:-1] & ((kind[:-1] & _QUOTE) == 0) & letter[1:])
    starts[other] = data[other - 1] != 0x20
    starts[other - np.where(data[other - 1] < 0x80, 1, np.where(data[other - 2] == 0xC2, 2, 3))] = True
    return starts[:-1]


def _distinct(data: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct units, and for each unit which of them it is."""
    if not len(starts):
        return [], np.zeros(0, np.int32)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
    _, offsets, raw = coded.dictionary.buffers()
    at, raw = np.frombuffer(offsets, np.int64, len(coded.dictionary) + 1).tolist(), raw.to_pybytes()
    return [raw[x:y] for x, y in zip(at, at[1:])], coded.indices.to_numpy()


class Encoder:
    """The tokenizers library behind a bounded memory of the units that it has encoded."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        pieces = json.loads(self.tokenizer.to_str())
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.by_units = (
            pieces["normalizer"] is None
            and pieces["post_processor"] is None
            and plain.items() <= (pieces["pre_tokenizer"] or {}).items()
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in pieces["added_tokens"])
        )
        added = "|".join(re.escape(t["content"]) for t in pieces["added_tokens"])
        self.added = re.compile(added) if added else None
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker process."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    @property
    def width(self) -> int:
        return max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, units: list[str]) -> list[bytes]:
        """As ``_plain`` for units that hold no white space but a first blank: many in a text, parted by line ends."""
        if self.line is None:
            return self._plain(units)
        out: list[bytes] = []
        parts = [units[i : i + JOINED_UNITS] for i in range(0, len(units), JOINED_UNITS)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(["\n".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array([*e.ids, self.line], "<u4")
            ends = np.flatnonzero(ids == self.line).tolist()
            if len(ends) != len(part):
                out += self._plain(part)
                continue
            raw, at = ids.tobytes(), 0
            for end in ends:
                out.append(raw[4 * at : 4 * end])
                at = end + 1
        return out

    def _of_units(self, units: list[bytes], special: bool) -> list[bytes]:
        """Each unit's ids. ``special``: an added token may be in one."""
        if len(self.known) > MEMO_UNITS:
            self.known.clear()
        found = list(map(self.known.get, units))
        odd, usual = [], []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            u = units[i].decode()
            (odd if len(u) > MEMO_CHARS or u.isspace() or special and self.added.search(u) else usual).append((i, u))
        for some, encode in ((odd, self._plain), (usual, self._joined)):
            for (i, u), ids in zip(some, encode([u for _, u in some])):
                found[i] = ids
                if len(u) <= MEMO_CHARS:
                    self.known[units[i]] = ids
        return found

    def flat(self, texts: pa.Array, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``last`` behind it, and where each text's begin; a null counts as empty."""
        end = b"" if last is None else np.array([last], "<u4").tobytes()
        if self.by_units:
            data, rows = utf8(texts)
            cut, special = unit_starts(data, rows), np.zeros(0, np.int64)
            if self.added is not None:
                special = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, self.added.pattern), False))
            for i in special.tolist():  # such a text is one unit
                cut[rows[i] + 1 : rows[i + 1]] = False
            starts = np.flatnonzero(cut)
            units, unit = _distinct(data, starts)
            ids = self._of_units(units, len(special) > 0)
            first = np.searchsorted(starts, rows)
        else:
            ids = self._plain([t or "" for t in texts.to_pylist()])
            unit, first = np.arange(len(ids)), np.arange(len(ids) + 1)
        unit = np.insert(unit, first[1:], len(ids))  # the last id is one more unit of each text
        first += np.arange(len(first))
        _, offsets, raw = pa.array([*ids, end], pa.large_binary()).take(pa.array(unit)).buffers()
        at = np.frombuffer(offsets, np.int64, len(unit) + 1)[first] // 4 if len(unit) else first
        return np.frombuffer(raw, "<u4", at[-1]) if at[-1] else np.zeros(0, "<u4"), at

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        ids, starts = self.flat(pa.array(texts, pa.large_string()))
        raw = ids.tobytes()
        return [raw[4 * x : 4 * y] for x, y in zip(starts.tolist(), starts[1:].tolist())]


def write_blocks(df: DataFrame, tokenizer: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None) -> None:
    """Encodes all rows and writes them as blocks at ``path``, in ascending order of id over shards and blocks."""
    schema = "shard int, block int, n_ids long, doc_ids array<bigint>, data binary"
    arrow = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("data", pa.binary())])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        width = max(encoder.width, (end_id or 0).bit_length())
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([held]), pa.array([keys], pa.list_(pa.int64())), pa.array([block(ids, width)], pa.binary())], schema=arrow)

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                flat, starts = encoder.flat(part.column(1), end_id)
                starts = starts.tolist()
                for key, x, y in zip(part.column(0).to_pylist(), starts, starts[1:]):
                    keys.append(key)
                    ids.append(flat[x:y])
                    held += y - x
                    if held >= BLOCK_IDS:
                        yield made()
                        keys, ids, held, number = [], [], 0, number + 1
        if keys:
            yield made()

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(tidy(encode), schema).write.mode("overwrite").parquet(path)


def read_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, ids array<int>, start (ids before it in all blocks), shard, block, slot."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row["data"])
                ids = pa.ListArray.from_arrays(pa.array(b.starts, pa.int32()), pa.array(b.all().astype(np.int32)))
                n = b.documents
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), ids, pa.array(b.starts[:-1]), *(pa.array(np.full(n, row[k], np.int32)) for k in ("shard", "block")), pa.array(np.arange(n, dtype=np.int32))], names=["doc_id", "ids", "inside", "shard", "block", "slot"])

    return _placed(blocks, blocks.select("shard", "block", "doc_ids", "data").mapInArrow(decode, "doc_id long, ids array<int>, inside long, shard int, block int, slot int"))


def digests(blocks: DataFrame) -> DataFrame:
    """As ``read_blocks``, with n_tokens and ids_crc32 in place of the ids."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row["data"])
                ids, starts, n = b.all().astype("<u4"), b.starts.tolist(), b.documents
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(b.starts)), pa.array(crc, pa.int64()), pa.array(b.starts[:-1]), *(pa.array(np.full(n, row[k], np.int32)) for k in ("shard", "block"))], names=["doc_id", "n_tokens", "ids_crc32", "inside", "shard", "block"])

    return _placed(blocks, blocks.select("shard", "block", "doc_ids", "data").mapInArrow(decode, "doc_id long, n_tokens long, ids_crc32 long, inside long, shard int, block int"))


def _placed(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds ``start`` from the blocks' own counts: a running sum within each shard, and one over the shards."""
    before = lambda w: F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1))
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    shards = shards.select("shard", F.coalesce(before(Window.orderBy("shard")), F.lit(0)).alias("shard_start"))
    starts = blocks.select("shard", "block", F.coalesce(before(Window.partitionBy("shard").orderBy("block")), F.lit(0)).alias("block_start")).join(shards, "shard")
    return rows.join(starts, ["shard", "block"]).withColumn("start", F.col("shard_start") + F.col("block_start") + F.col("inside")).drop("shard_start", "block_start", "inside")
