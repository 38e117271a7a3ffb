"""Stupid-backoff scores of documents under the n-gram counts of a corpus.

For the word w after words h (at most ``order`` - 1, from the same document),

    S(w | h) = count(h w) / count(h)             if the table has h w
             = ``alpha`` S(w | h without its first word)    otherwise, at last count(w) / number of words

The tables hold words of any count and longer n-grams from ``least`` occurrences on. A document's score is the sum of
log S over its words; A-Z count as small letters. Counts cover all documents.

All of it is relational:

1. Count tables. Documents are exploded into n-grams, each distinct one of a batch of texts once with its number there
   (so a frequent one is few, however often it occurs); sums by n-gram are the table of that length, a row for each
   n-gram. The table of every length is Parquet, partitioned by the n-gram's hash (``part=0`` and so on) into as many parts
   as the corpus has times ``BUCKET`` words; a part is one file for each pass over the corpus (see ``passes_of``).
2. Gains. log S of a whole document is a sum of terms that each depend on one n-gram: every word gives log S by words
   alone and log ``alpha`` for each longer history that it has, and each n-gram of a table adds what S is better than
   the backoff from it, ``gain = log S(n-gram) - log alpha - log S(its suffix)``. (An n-gram of a table has its prefix and
   its suffix in the tables, as ``least`` occurrences of it are as many of them.) So a count table joined to that
   of the next shorter n-grams, by prefix and by suffix, has each n-gram's gain: each bucket of counts asks the parts in
   which its prefixes and suffixes lie, with arrays of them, and gets arrays of numbers and log S back.
3. Scores. The n-grams of each document, distinct, with their numbers, are dealt by the same hash, each joined to its
   part of the table, and summed for each document, partly before the shuffle.

Exploded n-grams go through a shuffle by buckets of their hash (the table's parts), those of a batch and a bucket as one row of arrays (at any
size of a corpus no more rows than n-grams); a task adds or joins the ``BUCKET`` or so n-grams of a bucket with numpy,
which takes a fifth of the time of a row each. The ``SENT`` most frequent n-grams of each length don't go through the
joins: their gains, numbers and log S are sent to all tasks. If the next one is still so frequent that its bucket would be large, buckets are
split by batches and the part of the table is copied to each.

An n-gram's key is a hash of 64 bits; from two words on, counts go by the hashes of prefix and suffix, 128 bits. A
document's key is a hash of 64 bits of its id and text.

Null texts and texts without words have no words and a score of 0. Rows with equal ids are documents by their text;
repeated rows (id and text) count as often as they stand there, and each has the score. Other columns are ignored,
whatever their names. A text of any length is taken whole. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import text as T
from tallyforge.llm.store import Scratch

#: So many of the most frequent n-grams of a length are sent to all tasks, with gains, numbers and log S: 32 bytes each, whatever the corpus.
SENT = 1 << 16
#: About so many n-grams are in a bucket.
BUCKET = 2_000_000
#: So many n-grams of a part of a table are one row on the way to the join, at most.
PACKED = 1 << 19
#: About so many bytes of text are exploded at once.
HELD = 4 << 20
#: Columns of a table of n-grams, and of what is counted, asked and answered before it is one.
TABLE = ["gram", "n", "score", "gain", "part"]
COUNTS = ["bucket", "a", "b", "c", "d", "source", "kind"]


def passes_of(n: int) -> int:
    """So many times the corpus is read for the table of ``n`` words, each time for n-grams of other hashes, so that those of long ones never lie on disk all at once."""
    return max(1, n - 1)


# The primes of XXH64 and the seed of Spark's xxhash64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SEED = np.uint64(42)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _long_hash(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """XXH64 of eight bytes."""
    h = (seed + _P5 + np.uint64(8)) ^ (_turned(x * _P2, 31) * _P1)
    h = _turned(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def joined(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64(prefix, suffix)`` gives."""
    with np.errstate(over="ignore"):
        return _long_hash(suffix, _long_hash(prefix, _SEED))


def grams(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From hashes of words those of the ``n``-grams from each place on, and of their prefixes and suffixes (of words: the words thrice)."""
    prefix = suffix = h
    for _ in range(n - 1):
        prefix, suffix = h[:-1], h[1:]
        h = joined(prefix, suffix)
    return h, prefix, suffix


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    """The table's part, by the hash's high bits (its low ones tell the pass)."""
    return ((gram >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _dealt(bucket: np.ndarray, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket, with its parts of the arrays as bytes; ``bucket`` is sorted."""
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(begin[1:], len(bucket))
    columns = [pa.array([x[a:b].tobytes() for a, b in zip(begin.tolist(), ends.tolist())], pa.binary()) for x in arrays.values()]
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin]), *columns], names=["bucket", *arrays])


def _gathered(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[column]]) if len(table) else np.zeros(0, kind)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _wide(x: pa.Scalar, count: int) -> np.ndarray:
    """``count`` numbers that ``_narrow`` made."""
    raw = x.as_buffer()
    return np.frombuffer(raw, f"u{raw.size // count if count else 1}")


def _halved(gram: np.ndarray) -> list[np.ndarray]:
    """The high 16 bits, the next 16 and the others of sorted hashes: the first repeat, so that they nearly vanish when they are compressed."""
    return [(gram >> np.uint64(48)).astype(np.uint16), (gram >> np.uint64(32)).astype(np.uint16), gram.astype(np.uint32)]


def _whole(x: pa.Scalar) -> np.ndarray:
    """The hashes of which ``_halved`` made bytes."""
    raw = x.as_buffer()
    n = raw.size // 8
    high, middle = np.frombuffer(raw, np.uint16, 2 * n).astype(np.uint64).reshape(2, n)
    return (high << np.uint64(48)) | (middle << np.uint64(32)) | np.frombuffer(raw, np.uint32, n, 4 * n)


def together(key: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
    """An order by the high bits of ``key``, in which equal rows of ``own`` (they have equal keys) stand together, as they came.

    One sort of numbers that hold a key's high bits and a place (a fourth of the time of a sort of places); rows that
    differ though these bits agree are then sorted by all columns. At least 32 bits count.
    """
    low = np.uint64((1 << len(key).bit_length()) - 1)
    order = (np.sort((key & ~low) | np.arange(len(key), dtype=np.uint64)) & low).astype(np.int64)
    high = (key & ~low)[order]
    same = high[1:] == high[:-1]
    mixed = same & reduce(np.logical_or, ((x := c[order])[1:] != x[:-1] for c in own))
    if mixed.any():
        group = np.cumsum(np.append(0, ~same))
        at = np.flatnonzero(np.isin(group, group[1:][mixed]))
        part = order[at]
        order[at] = part[np.lexsort((part, *(c[part] for c in own), group[at]))]
    return order


def _starts(own: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before."""
    return np.flatnonzero(np.append(True, reduce(np.logical_or, (x[1:] != x[:-1] for x in own)))) if len(own[0]) else np.zeros(0, np.int64)


def _held(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Slices of batches, until they have about ``HELD`` bytes of text: the fewer and larger, the fewer distinct n-grams and rows of arrays."""
    held, size = [], 0
    for batch in batches:
        for piece in T.slices(batch, "text"):
            held.append(piece)
            size += piece.column("text").nbytes
            if size >= HELD:
                yield held
                held, size = [], 0
    if held:
        yield held


def _counted(n: int, turn: int, passes: int, buckets: int):
    """Each distinct n-gram of some texts, with its number there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _held(batches):
            found = []
            for piece in pieces:
                w = T.words(piece.column("text"))
                gram, prefix, suffix = grams(w.hashes(lower=True), n) if len(w.starts) >= n else [np.zeros(0, np.uint64)] * 3
                here = w.whole(n)[: len(gram)]
                if passes > 1:
                    here &= gram % np.uint64(passes) == turn
                at = np.flatnonzero(here)
                found.append([x[at] for x in ((gram,) if n == 1 else (gram, prefix, suffix))])
            own = [np.concatenate(x) for x in zip(*found)]
            order = together(own[0], own[:1])
            gram = own[0][order]
            first = _starts([gram])
            number = np.diff(first, append=len(gram))
            keys = {"gram": gram[first]} if n == 1 else {"prefix": own[1][order[first]], "suffix": own[2][order[first]]}
            yield _dealt(bucket_of(gram[first], buckets), keys | {"n": number.astype(np.int32)})

    return run


def _summed(table: pa.Table, keys: list[str], least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The keys of the distinct n-grams of a bucket that occur ``least`` times, and their sums."""
    own = [_gathered(table, k, np.uint64) for k in keys]
    with np.errstate(over="ignore"):
        mixed = reduce(lambda a, b: a * _P1 + b, own) * _P2  # those of a bucket have equal high bits, but not here
    order = together(mixed, own)
    own = [x[order] for x in own]
    new = _starts(own)
    total = np.add.reduceat(_gathered(table, "n", np.int32)[order].astype(np.int64), new) if len(order) else order
    keep = total >= least
    return [x[new[keep]] for x in own], total[keep]


def _words_added(words: int):
    """The table of single words, from a bucket's counts."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        (gram,), total = _summed(table, ["gram"], 1)
        score = np.log(total / max(1, words))
        return pa.table([pa.array(gram.view(np.int64)), pa.array(total), pa.array(score), pa.array(score), pa.array(np.full(len(gram), key[0].as_py(), np.int32))], names=TABLE)

    return run


def _place(known: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Places among the sorted ``known``, -1 for others."""
    if not len(known):
        return np.full(len(gram), -1, np.int32)
    at = np.minimum(np.searchsorted(known, gram), len(known) - 1).astype(np.int32)
    return np.where(known[at] == gram, at, np.int32(-1))


def _added(least: int, buckets: int, copies: int, sent):
    """A bucket's n-grams as a row of arrays, with the places of prefix and suffix among those that were sent, and for each other prefix and suffix what is asked of its part of the shorter n-grams' table."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        known, bucket = sent.value[0], key[0].as_py()
        (prefix, suffix), total = _summed(table, ["prefix", "suffix"], least)
        gram = joined(prefix, suffix)
        places, asked = {}, []
        for kind, x in (("prefix", prefix), ("suffix", suffix)):
            order = together(x, [x])
            place = np.empty(len(x), np.int32)
            place[order] = _place(known, x[order])
            places[kind] = place
            at = order[place[order] < 0]
            to = bucket_of(x[at], buckets) * np.int32(copies) + np.int32(bucket % copies)
            asked.append(_tagged(_dealt(to, {"a": x[at], "b": at.astype(np.int32)}), bucket, kind))
        one = pa.array([bucket], pa.int32())
        own = pa.RecordBatch.from_arrays([one, *(pa.array([x.tobytes()], pa.binary()) for x in (gram, total, places["prefix"], places["suffix"])), one, pa.array(["gram"])], names=COUNTS)
        return pa.Table.from_batches([own, *asked])

    return run


def _tagged(dealt: pa.RecordBatch, source: int, kind: str) -> pa.RecordBatch:
    n = dealt.num_rows
    return pa.RecordBatch.from_arrays([*dealt.columns, *[pa.nulls(n, pa.binary())] * 2, pa.array(np.full(n, source, np.int32)), pa.array([kind] * n, pa.string())], names=COUNTS)


def _answered(asked: pa.Table, table: pa.Table) -> pa.Table:
    """What a part of a table has of the prefixes (how often they occur) and suffixes (log S) that buckets of longer n-grams ask for."""
    own = _gathered(table, "gram", np.uint64)
    order = np.argsort(own)
    own, n, score = own[order], _gathered(table, "n", np.int64)[order], _gathered(table, "score", np.float64)[order]
    out = []
    for row in asked.to_batches():
        for key, at, source, kind in zip(row["a"], row["b"], row["source"].to_pylist(), row["kind"].to_pylist()):
            place = np.searchsorted(own, np.frombuffer(key.as_buffer(), np.uint64))
            answer = n[place].astype(np.float64) if kind == "prefix" else score[place]
            out.append((source, at.as_py(), answer.tobytes(), kind))
    columns = list(zip(*out)) or [()] * 4
    none = pa.nulls(len(out), pa.binary())
    where = pa.array(columns[0], pa.int32())
    return pa.table([where, pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary()), none, none, where, pa.array(columns[3], pa.string())], names=COUNTS)


def _finished(alpha: float, sent):
    """Rows of the table, from a bucket's n-grams and the answers about their prefixes and suffixes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, _, often, scores = sent.value
        own = table.filter(pa.compute.equal(table["kind"], "gram"))
        gram, total = _gathered(own, "a", np.int64), _gathered(own, "b", np.int64)
        values = {}
        for kind, column, known in (("prefix", "c", often), ("suffix", "d", scores)):
            place = _gathered(own, column, np.int32)
            value = np.full(len(gram), np.nan)
            here = place >= 0
            value[here] = known[place[here]]
            answers = table.filter(pa.compute.equal(table["kind"], kind))
            value[_gathered(answers, "a", np.int32)] = _gathered(answers, "b", np.float64)
            values[kind] = value
        score = np.log(total / values["prefix"])
        gain = score - np.log(alpha) - values["suffix"]
        return pa.table([pa.array(gram), pa.array(total), pa.array(score), pa.array(gain), pa.array(np.full(len(gram), key[0].as_py(), np.int32))], names=TABLE)

    return run


def _packed(columns: dict[str, type]):
    """The rows of a table's part as arrays, ``PACKED`` at most in a row."""

    def parted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part, *own = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("part", *columns))
        if not len(part) or part[0] == part[-1] == part.max() == part.min():
            return _dealt(part, dict(zip(columns, own)))
        order = np.argsort(part, kind="stable")
        return _dealt(part[order], {c: x[order] for c, x in zip(columns, own)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PACKED:
                yield parted(held)
                held, size = [], 0
        if size:
            yield parted(held)

    return run


def _exploded(n: int, buckets: int, copies: int, sent):
    """Each document's distinct n-grams with their numbers; those that were sent are summed at once, in a row of their own (any bucket's, without ``k``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gains = sent.value[:2]
        for i, pieces in enumerate(_held(batches)):
            found, rows, keys, before = [], [], [], 0
            for piece in pieces:
                w = T.words(piece.column("text"))
                gram = grams(w.hashes(lower=True), n)[0] if len(w.starts) >= n else np.zeros(0, np.uint64)
                at = np.flatnonzero(w.whole(n)[: len(gram)])
                found.append(gram[at])
                rows.append(np.repeat(np.arange(before, before + piece.num_rows, dtype=np.int32), w.counts)[at])
                keys.append(piece.column("row").to_numpy())
                before += piece.num_rows
            every, row, key = np.concatenate(found), np.concatenate(rows), np.concatenate(keys)
            order = together(every, [every])  # equal n-grams as they came, so by document
            every, row = every[order], row[order]
            first = _starts([every, row])
            every, row, number = every[first], row[first], np.diff(first, append=len(every))
            place = _place(known, every)
            here = place >= 0
            if here.any():
                sums = np.bincount(row[here], number[here] * gains[place[here]], minlength=len(key))
                every, row, number = every[~here], row[~here], number[~here]
                to = int(every[0]) % (buckets * copies) if len(every) else 0
                yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([sums.tobytes()]), pa.array([b""]), pa.array([key.tobytes()]), pa.nulls(1, pa.binary())], names=["bucket", "gram", "row", "keys", "k"])
            copy = (TaskContext.get().partitionId() + i) % copies
            yield _of_documents(bucket_of(every, buckets) * np.int32(copies) + np.int32(copy), every, row, number, key)

    return run


def _of_documents(bucket: np.ndarray, gram: np.ndarray, row: np.ndarray, number: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket: n-grams, each with its document's place among ``keys`` and its number. Keys are all documents' or, where these are more than the n-grams, those of the documents that have any."""
    begin = _starts([bucket])
    columns: list[list[bytes]] = [[], [], [], []]
    halves = _halved(gram)
    for a, b in zip(begin.tolist(), np.append(begin[1:], len(bucket)).tolist()):
        some, at = (np.arange(len(key)), row[a:b]) if len(key) < b - a else np.unique(row[a:b], return_inverse=True)
        for column, x in zip(columns, (b"".join(x[a:b].tobytes() for x in halves), *(x.tobytes() for x in (_narrow(at), key[some], _narrow(number[a:b]))))):
            column.append(x)
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin]), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "gram", "row", "keys", "k"])


def _told(buckets: int):
    def run(exploded: pa.Table, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_gains_of(exploded, table, buckets)])

    return run


def _gains_of(exploded: pa.Table, table: pa.Table, buckets: int) -> pa.RecordBatch:
    """Sums by document of a bucket: the gains of the n-grams that the table has, and what was summed before."""
    own = _gathered(table, "gram", np.uint64)
    order = np.argsort(own)
    own, gains = own[order], _gathered(table, "gain", np.float64)[order]
    each, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
    for batch in exploded.to_batches():
        for grams_, rows, keys, k in zip(batch["gram"], batch["row"], batch["keys"], batch["k"]):
            key = np.frombuffer(keys.as_buffer(), np.int64)
            if not k.is_valid:
                own_sums = np.frombuffer(grams_.as_buffer(), np.float64)
            else:
                gram = _whole(grams_)
                place = _place(own, gram)
                hit = place >= 0
                own_sums = np.bincount(_wide(rows, len(gram))[hit], _wide(k, len(gram))[hit] * gains[place[hit]], minlength=len(key))
            some = own_sums != 0
            each.append(key[some])
            sums.append(own_sums[some])
    return _by_document(np.concatenate(each), np.concatenate(sums), buckets)


def _by_document(row: np.ndarray, s: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket of documents, with their keys and sums."""
    order = together(T.mix(row.view(np.uint64)), [row])
    row, s = row[order], s[order]
    return _dealt(bucket_of(T.mix(row.view(np.uint64)), buckets), {"row": row, "s": s})


def _scored(table: pa.Table) -> pa.Table:
    """row and s of the documents of a bucket."""
    row, s = _gathered(table, "row", np.int64), _gathered(table, "s", np.float64)
    order = together(row.view(np.uint64) * _P1, [row])
    row = row[order]
    first = _starts([row])
    return pa.table({"row": pa.array(row[first]), "s": pa.array(np.add.reduceat(s[order], first) if len(row) else s)})


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in T.slices(batch, "text"):
            counts = T.words(piece.column("text")).counts
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("row"), pa.array(counts.astype(np.int64))], names=["doc_id", "row", "words"])


class LanguageModel:
    """The tables of a corpus, and the scores of its documents: ``table(n)`` has gram, n (how often), score (log S of its last word after the others), gain and part."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = 0.4, least: int = 2, sent: int = SENT, bucket: int = BUCKET) -> None:
        if order < 1 or least < 1 or sent < 0 or bucket < 1 or not 0 < alpha <= 1:
            raise ValueError("order and least are 1 or more, alpha is above 0 and at most 1")
        self.spark, self.order, self.alpha, self.least, self.sent = docs.sparkSession, order, alpha, least, sent
        self.scratch = Scratch(self.spark, "lm")
        self.docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
        self.sizes = self.scratch.save(self.docs.mapInArrow(T.tidy(_words), "doc_id long, row long, words long"), "words")
        self.words = self.sizes.agg(F.sum("words")).first()[0] or 0
        self.bucket, self.buckets = bucket, max(1, -(-self.words // bucket))
        self.texts = self.docs.where("text is not null")
        self.tops: dict[int, tuple[Broadcast, int]] = {}

    def _build(self, n: int) -> None:
        keys = ["gram"] if n == 1 else ["prefix", "suffix"]
        row = "gram long, n long, score double, gain double, part int"
        for turn in range(passes_of(n)):
            packed = self.texts.select("text").mapInArrow(T.tidy(_counted(n, turn, passes_of(n), self.buckets)), f"bucket int, {', '.join(f'{k} binary' for k in keys)}, n binary").groupBy("bucket")
            if n == 1:
                own = packed.applyInArrow(_words_added(self.words), row)
            else:
                sent, copies = self._top(n - 1)
                kinds = "bucket int, a binary, b binary, c binary, d binary, source int, kind string"
                counts = self.scratch.save(packed.applyInArrow(_added(self.least, self.buckets, copies, sent), kinds), "counts")
                asked = counts.where("kind <> 'gram'").groupBy("bucket").cogroup(self._parts(n - 1, {"gram": np.int64, "n": np.int64, "score": np.float64}, copies).groupBy("bucket"))
                answers = asked.applyInArrow(_answered, kinds)
                own = counts.where("kind = 'gram'").union(answers).groupBy("bucket").applyInArrow(_finished(self.alpha, sent), row)
            self.scratch.save(own, f"table-{n}", by="part", more=turn > 0)  # whole parts: a task writes each as one file
            self.scratch.drop("counts")

    def table(self, n: int) -> DataFrame:
        """A row for each n-gram, in the part (of ``buckets``) that its hash tells."""
        return self.spark.read.schema("gram long, n long, score double, gain double, part int").parquet(self.scratch.path(f"table-{n}"))

    def _parts(self, n: int, columns: dict[str, type], copies: int) -> DataFrame:
        """The table's parts as arrays, each ``copies`` times."""
        packed = self.table(n).select("part", *columns).mapInArrow(T.tidy(_packed(columns)), f"bucket int, {', '.join(f'{c} binary' for c in columns)}")
        first = F.col("bucket") * copies
        return packed.select(F.explode(F.sequence(first, first + (copies - 1))).alias("bucket"), *columns)

    def _top(self, n: int) -> tuple[Broadcast, int]:
        """The most frequent n-grams in order, with gain, number and score, sent to all tasks; into how many each bucket of the others is split."""
        if n not in self.tops:
            table = self.table(n)
            # The n-grams from so many occurrences on that there are at most ``sent``; how many have 1, 2, 4 ... is a row each.
            power = F.floor(F.log2("n")).cast("int")
            sizes = sorted(((r["power"], r["k"]) for r in table.groupBy(power.alias("power")).agg(F.count("*").alias("k")).collect()), reverse=True)
            least, total = (sizes[0][0] + 1 if sizes else 0), 0
            for x, k in sizes:
                if (total := total + k) > self.sent:
                    break
                least = x
            top = table.where(power >= least).select("gram", "gain", "n", "score").toPandas()  # at most ``sent`` rows
            copies = max(1, -(-(2**least) // self.bucket)) if total > self.sent else 1  # no n-gram that isn't sent has more rows than a bucket
            known = top["gram"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(known)
            self.tops[n] = self.spark.sparkContext.broadcast((known[order], *(top[c].to_numpy(float)[order] for c in ("gain", "n", "score")))), copies
        return self.tops[n]

    def _sums(self, n: int) -> DataFrame:
        """row and s: what the n-grams of ``n`` words add to each document."""
        sent, copies = self._top(n)
        rows = self.texts.select("row", "text").mapInArrow(T.tidy(_exploded(n, self.buckets, copies, sent)), "bucket int, gram binary, row binary, keys binary, k binary")
        gains = self._parts(n, {"gram": np.int64, "gain": np.float64}, copies)
        found = rows.groupBy("bucket").cogroup(gains.groupBy("bucket")).applyInArrow(_told(self.buckets), "bucket int, row binary, s binary")
        return self.scratch.save(found.groupBy("bucket").applyInArrow(_scored, "row long, s double"), f"sums-{n}")

    def scores(self, keep: bool = False) -> DataFrame:
        """doc_id, n_words, log_score, mean_log_score. A table that no longer n-grams need is dropped, but with ``keep``."""
        sums = []
        for n in range(1, self.order + 1):
            self._build(n)
            if not keep and n > 1:
                self.tops.pop(n - 1)
                self.scratch.drop(f"table-{n - 1}")
            sums.append(self._sums(n))
        if not keep:
            self.scratch.drop(f"table-{self.order}")
        total = reduce(DataFrame.union, sums).groupBy("row").agg(F.sum("s").alias("s"))
        copies = self.sizes.groupBy("row").agg(F.count("*").alias("copies"), F.first("words").alias("words"))
        steps = reduce(lambda a, b: a + b, (F.greatest(F.lit(0), F.col("words") - j) for j in range(1, self.order)), F.lit(0))
        score = F.coalesce(F.col("s") / F.col("copies"), F.lit(0.0)) + steps * F.lit(float(np.log(self.alpha)))
        each = copies.join(total, "row", "left").select("row", score.alias("log_score"))
        rows = self.sizes.join(each, "row")  # a row for each row, repeated ones too
        return rows.select("doc_id", F.col("words").alias("n_words"), "log_score", (F.col("log_score") / F.greatest(F.lit(1), F.col("words"))).alias("mean_log_score"))


def scores(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score of a corpus under its own counts."""
    return LanguageModel(docs, **options).scores()
