"""Passages of at least ``length`` words that stand at more than one place of a corpus, by relative Lempel-Ziv parsing.

Documents are parsed against reference blocks, which hold the corpus itself: a block is all passages around one set of
content-chosen anchors. A window of ``length`` words has as its anchor the least hash among its runs of ``ANCHOR`` words,
so equal windows have equal anchors wherever they stand, and a document need be parsed only against the blocks that
its anchors name. Successive windows with one anchor are a run, the unit that is parsed:

1. Anchors that stand at one place only are put aside (their counts combine before the shuffle).
2. Of runs whose whole word sequence stands elsewhere too, a block gets the first; the copies are factors at once.
3. Blocks are written as a table: each different run of a shared anchor, with its words. A task takes about ``BLOCK_ROWS``
   of them, indexes them (a suffix array over exact word numbers, with the length of what neighbours share) and
   parses each run greedily from its first word on: a factor is the longest match that begins there at another place.
   A factor of ``length`` words or more is a duplicate span. Windows over a factor's end are looked up one by one.
4. A run ends where its anchor does, a factor need not: what touches or overlaps in a document is one span.

An anchor with over ``HOT`` different runs (a passage that very many documents share has such at its edges) would make a
block of any size. Its runs are dealt by window instead, each with a hash of 128 bits, and equal windows are counted.

A span is a ``first`` one if no equal passage stands at a lower place (by document id, text hash and word). ``digests`` removes
all places of a passage, ``dedup`` all or, with ``keep_first``, all but the first.

Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged. Runs that are whole copies are known by a hash of
128 bits, others by their words. Null texts have none, and null ids are below all others. Equal texts are parsed once for each
batch and counted as often as they stand there; with ``keep_first`` a row counts for itself, and rows that are equal in
id and text are one place. Other columns are kept as they are, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import text as T
from tallyforge.llm.store import Scratch

ANCHOR = 8
PLACES = 1024
"""A power of two over the number of anchors in a window."""


HOT = 256
BLOCK_ROWS = 4096


def _unique_texts(batch: pa.RecordBatch, merge: bool) -> tuple[pa.RecordBatch, np.ndarray]:
    """One row for each text hash and length, and how many rows had it."""
    if not merge:
        return batch, np.ones(batch.num_rows, np.int64)
    keys = np.rec.fromarrays([batch.column(c).to_numpy(zero_copy_only=False) for c in ("th", "tl")])
    _, first, counts = np.unique(keys, return_index=True, return_counts=True)
    order = np.argsort(first)
    return batch.take(pa.array(first[order])), counts[order]


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` successive values, by doubling."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[: len(values) - span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _runs(w: T.Words, h: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of the runs of a slice: anchor, row, first window, hash of the whole run, number of windows, second hash."""
    starts = np.flatnonzero(w.whole(length))
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none.view(np.uint64), none, none, none.view(np.uint64), none, none.view(np.uint64)
    # The place, in the low bits, goes with its hash through the minima; equal hashes have one anchor wherever they stand.
    grams = T.rolling(h, ANCHOR) & ~np.uint64(PLACES - 1)
    places = np.arange(len(grams), dtype=np.uint64) & np.uint64(PLACES - 1)
    at = (_sliding_least(grams | places, length - ANCHOR + 1)[starts] & np.uint64(PLACES - 1)).astype(np.int64)
    least = starts + ((at - starts) & (PLACES - 1))
    # Of equal hashes the leftmost counts, also where the low bits begin anew in a window: so two equal windows are never in one run.
    width = length - ANCHOR + 1
    over = np.flatnonzero((starts & (PLACES - 1)) + width > PLACES)
    least[over] = starts[over] + np.argmin(grams[starts[over][:, None] + np.arange(width)], axis=1)
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(starts))
    first, stop = starts[at], starts[ends - 1] + length
    whole = [_stretches(x, first, stop) for x in (h, _other(h))]
    rows = np.searchsorted(w.first, first, "right") - 1
    return grams[least[at]], rows, first - w.first[rows], whole[0], ends - at, whole[1]


def _other(h: np.ndarray) -> np.ndarray:
    """Second hashes of words."""
    return T.mix(h ^ np.uint64(0x5851F42D4C957F2D))


def _stretches(h: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the words from ``first`` to ``stop``."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * T._power(T._BASE, len(h)), out=total[1:])
    return T.mix((total[stop] - total[first]) * T._power(T._BASE_INVERSE, len(h) + 1)[first] + (stop - first).astype(np.uint64))


def _anchor_counts(length: int, merge: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch, copies = _unique_texts(batch, merge)
            at = 0
            for part in T.slices(batch, "text"):
                w = T.words(part.column("text"))
                anchors, rows, *_ = _runs(w, w.hashes(), length)
                # Each run is a place of its own, and no window of it is equal to another of the same run.
                keys, inverse = np.unique(anchors, return_inverse=True)
                n = np.bincount(inverse, copies[at : at + part.num_rows][rows], minlength=len(keys)).astype(np.int64)
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.minimum(n, 2))], names=["anchor", "n"])

    return run


PLACE = ("doc_id", "th", "tl")


def _ranks(ids: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """For each row its place in the order of these columns; equal rows share one."""
    order = np.lexsort((*more[::-1], ids))
    new = np.any([x[order][1:] != x[order][:-1] for x in (ids, *more)], axis=0) if len(ids) else np.zeros(0, bool)
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(np.append(0, new))[: len(ids)]
    return out


def _places(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """The ranks of rows by document, as Spark orders them: null ids first."""
    ids = pa.compute.fill_null(rows["doc_id"], -(1 << 63))
    return _ranks(*(np.asarray(c) for c in (ids, rows["th"], rows["tl"])))


def _run_rows(length: int, merge: bool):
    """The different runs of a slice of texts: the lowest place of each, how many there are, and the other places."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            batch, copies = _unique_texts(batch, merge)
            at = 0
            for part in T.slices(batch, "text"):
                number += 1
                w = T.words(part.column("text"))
                anchors, rows, first, whole, windows, other = _runs(w, w.hashes(), length)
                own = copies[at : at + part.num_rows][rows]
                at += part.num_rows
                order = np.lexsort((first, _places(part)[rows], other, whole, anchors))
                anchors, rows, first, whole, windows, other, own = (x[order] for x in (anchors, rows, first, whole, windows, other, own))
                new = np.ones(len(order), bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (whole[1:] != whole[:-1]) | (other[1:] != other[:-1])
                head, rest = np.flatnonzero(new), np.flatnonzero(~new)
                total = np.add.reduceat(own, head) if len(head) else own
                place = lambda x: [*(part.column(c).take(pa.array(rows[x])) for c in PLACE), pa.array(first[x].astype(np.int32))]
                size = np.diff(np.append(head, len(order))) - 1
                ends = pa.array(np.append(0, np.cumsum(size)).astype(np.int32), mask=np.append(size == 0, False))  # no others: null
                more = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(place(rest), names=[*PLACE, "first"])) if len(head) else pa.nulls(0, MORE)
                columns = [*(pa.array(x[head].view(np.int64)) for x in (anchors, whole, other)), *place(head)]
                columns += [pa.array(total.astype(np.int64)), pa.array(windows[head].astype(np.int32)), more, pa.array(np.full(len(head), number))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "whole", "other", *PLACE, "first", "copies", "windows", "more", "slice"])

    return run


MORE = pa.list_(pa.struct([*((c, pa.int64()) for c in PLACE), ("first", pa.int32())]))
RUNS = "anchor long, whole long, other long, doc_id long, th long, tl long, first int, copies long, windows int, more array<struct<doc_id: bigint, th: bigint, tl: bigint, first: int>>, slice long"
SPAN = ("start", "windows", "first", "source_id", "source_start")
LISTS = "doc_id long, th long, tl long, spans array<struct<start: int, windows: int, first: boolean, source_id: bigint, source_start: int>>"


def _by_text(table: pa.Table) -> pa.Table:
    """From a slice's runs that have copies a row for each text, with its spans in their order."""
    lists = table["more"].combine_chunks()
    more = lists.flatten()
    size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
    row = np.append(np.arange(len(table)), np.repeat(np.arange(len(table)), size))
    own = {c: pa.concat_arrays([table[c].combine_chunks(), more.field(c)]) for c in (*PLACE, "first")}
    pick = pa.array(row)
    of = {c: table[f"source_{c}"].combine_chunks().take(pick) for c in (*PLACE, "first")}
    rank, start = _places(own), own["first"].to_numpy()
    both = _places({c: pa.concat_arrays([own[c], of[c]]) for c in PLACE})
    first = (both[: len(row)] == both[len(row) :]) & (start == of["first"].to_numpy())
    order = np.lexsort((start, rank))
    new = np.flatnonzero(np.append(True, rank[order][1:] != rank[order][:-1])) if len(order) else order
    at = pa.array(order)
    spans = [own["first"].take(at), table["windows"].combine_chunks().take(pick).take(at), pa.array(first).take(at), of["doc_id"].take(at), of["first"].take(at)]
    ends = pa.array(np.append(new, len(order)).astype(np.int32))
    return pa.table([*(own[c].take(pa.array(order[new])) for c in PLACE), pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(spans, names=list(SPAN)))], names=[*PLACE, "spans"])


def _blocks(length: int):
    """The runs that a text is the source of, with their words; of hot anchors their windows, with two hashes."""
    names = ["hot", "anchor", "v", "u", "k", *PLACE, "first", "windows", "words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                w = T.words(part.column("text"))
                h = w.hashes()
                lists = part.column("runs")
                runs, rows = lists.flatten(), np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(lists).to_numpy())
                anchor, first, windows, k = (runs.field(c).to_numpy().astype(np.int64) for c in ("anchor", "first", "windows", "k"))
                hot = runs.field("hot").to_numpy(zero_copy_only=False)
                for some in (False, True):
                    own = np.flatnonzero(hot == some)
                    begin = w.first[rows[own]] + first[own]
                    if some:
                        step = np.arange(windows[own].sum()) - np.repeat(np.cumsum(windows[own]) - windows[own], windows[own])
                        own, begin = np.repeat(own, windows[own]), np.repeat(begin, windows[own]) + step
                        hashes = [pa.array(T.rolling(x, length)[begin].view(np.int64)) for x in (h, _other(h))]
                        words, n, start = pa.nulls(len(own), pa.binary()), np.ones(len(own)), first[own] + step
                    else:
                        hashes = [pa.nulls(len(own), pa.int64())] * 2
                        ends = w.ends[begin + windows[own] + length - 2]
                        words = pa.array([w.data[a:b].tobytes() for a, b in zip(w.starts[begin].tolist(), ends.tolist())], pa.binary())
                        n, start = windows[own], first[own]
                    columns = [pa.array(hot[own]), pa.array(anchor[own]), *hashes, pa.array(k[own]), *(part.column(c).take(pa.array(rows[own])) for c in PLACE)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), words], names=names)

    return run


@dataclass
class Reference:
    """An index of runs: for each window's start, in the order of runs, how many words of it stand at another place."""

    longest: np.ndarray
    kind: np.ndarray
    """Equal for equal windows."""

    @classmethod
    def of(cls, group: np.ndarray, words: pa.Array, windows: np.ndarray, length: int) -> Reference:
        """``group``: runs of different groups don't match. Word numbers come from the words, so nothing hangs on hashes."""
        w = T.words(words)
        sizes = w.ends - w.starts
        inside = np.repeat(w.starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(w.data[inside])])
        number = packed.dictionary_encode().indices.to_numpy().astype(np.int64)
        n = len(number)
        row = np.repeat(np.arange(len(w.counts)), w.counts)
        left = np.repeat(w.first[1:], w.counts) - np.arange(n)
        # Ranks of 1, 2, 4 ... words from each place on; 0 stands for what is behind a run's end.
        rank = np.zeros(n + 1, np.int64)
        rank[:n] = np.unique(group[row] * np.int64(n + 1) + number, return_inverse=True)[1] + 1
        ranks, span, most = [rank], 1, int(w.counts.max(initial=1))

        def after(rank: np.ndarray, step: int) -> np.ndarray:
            return np.where(left > step, rank[np.minimum(np.arange(n) + step, n)], 0)

        while span < most:
            rank = np.zeros(n + 1, np.int64)
            rank[:n] = np.unique(ranks[-1][:n] * np.int64(n + 2) + after(ranks[-1], span), return_inverse=True)[1] + 1
            ranks.append(rank)
            span *= 2
        starts = np.flatnonzero(np.arange(n) - w.first[row] < windows[row])
        order = starts[np.argsort(ranks[-1][starts], kind="stable")]
        # Neighbours in the order share the most; how much is found from long to short.
        x, y = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(len(x), np.int64)
        for i in range(len(ranks) - 1, -1, -1):
            fits = np.minimum(left[x - shared], left[y - shared]) - shared >= 1 << i
            same = fits & (ranks[i][np.minimum(x, n)] == ranks[i][np.minimum(y, n)])
            shared += same << i
            x += same << i
            y += same << i
        near = np.zeros(n, np.int64)
        if len(order) > 1:
            near[order] = np.maximum(np.append(0, shared), np.append(shared, 0))
        kind = np.zeros(n, np.int64)
        kind[order] = np.cumsum(np.append(0, shared < length))[: len(order)]
        return cls(near[starts], kind[starts])


def parse(longest: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of runs, one after the other in ``longest``: row, first word and words of each, in the order of their places.

    A place without a match is a factor of one word. The last factor of a run may go on to the end of its words.
    """
    begin = np.cumsum(windows) - windows
    rows, at = np.arange(len(windows)), np.zeros(len(windows), np.int64)
    found = []
    while len(rows):
        n = np.maximum(1, longest[begin[rows] + at])
        found.append(np.stack([rows, at, n]))
        at = at + n
        more = at < windows[rows]
        rows, at = rows[more], at[more]
    every = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return tuple(every[:, np.lexsort((every[1], every[0]))])


def matched(longest: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which windows stand at another place too: those in long factors, and of those over a boundary the ones that the check finds."""
    row, first, n = parse(longest, windows, length)
    begin = np.cumsum(windows) - windows
    out = np.zeros(len(longest) + 1, np.int64)
    long = n >= length
    np.add.at(out, begin[row[long]] + first[long], 1)
    np.add.at(out, np.minimum(begin[row[long]] + first[long] + n[long] - length + 1, (begin + windows)[row[long]]), -1)
    out = np.cumsum(out[:-1]) > 0
    # Windows that begin in a factor and end behind it.
    a = np.where(long, first + n - length + 1, first + 1)
    b = np.minimum(first + n, windows[row])
    count = np.maximum(0, b - a)
    check = np.repeat(begin[row] + a, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    out[check] |= longest[check] >= length
    return out


SPANS = "doc_id long, th long, tl long, start int, windows int, first boolean, source_id long, source_start int"


def _parsed(length: int):
    """Spans of a block's runs. Of runs that have whole copies only those that aren't first: the others are known."""

    def run(table: pa.Table) -> pa.Table:
        group = np.unique(table["anchor"].to_numpy(), return_inverse=True)[1]
        windows, k, start = (table[c].to_numpy().astype(np.int64) for c in ("windows", "k", "first"))
        words = table["words"].combine_chunks().cast(pa.large_binary())
        text = pa.LargeStringArray.from_buffers(len(words), *words.buffers()[1:], offset=words.offset)
        index = Reference.of(group, text, windows, length)
        hit = matched(index.longest, windows, length)
        row = np.repeat(np.arange(len(windows)), windows)
        place = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        rank = _places(table)
        # The lowest place of each kind of window.
        order = np.lexsort((place, rank[row], index.kind))
        lowest = np.empty(len(row), np.int64)
        if len(row):
            new = np.append(True, index.kind[order][1:] != index.kind[order][:-1])
            lowest[order] = order[new][np.cumsum(new) - 1]
        first = (rank[row] == rank[row[lowest]]) & (place == place[lowest])
        hit &= ~first | (k[row] == 1)
        source = place - place[lowest] + rank[row[lowest]] * np.int64(1 << 32)
        at = np.flatnonzero(hit)
        new = np.ones(len(at), bool)
        if len(at) > 1:
            new[1:] = (at[1:] != at[:-1] + 1) | (row[at][1:] != row[at][:-1]) | (first[at][1:] != first[at][:-1]) | (source[at][1:] != source[at][:-1])
        head = at[new]
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        pick, of = pa.array(row[head]), pa.array(row[lowest[head]])
        columns = [*(table[c].take(pick) for c in PLACE), pa.array(place[head].astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(first[head])]
        return pa.table([*columns, table["doc_id"].take(of), pa.array(place[lowest[head]].astype(np.int32))], names=[*PLACE, "start", "windows", "first", "source_id", "source_start"])

    return run


def duplicate_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 35, each_row: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, th, tl (hash and bytes of the text), and some of its spans: start (the first word), windows (words less ``length`` - 1), first, source_id, source_start.

    ``each_row``: spans are of each row; else of each text, with the id of one of the rows that have it.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "dedup")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.octet_length(text_col).cast("bigint").alias("tl"), F.col(text_col).alias("text")).where("text is not null")
    counted = texts.select("th", "tl", "text").mapInArrow(T.tidy(_anchor_counts(length, not each_row)), "anchor long, n long")
    shared = counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    shared = scratch.save(shared, "anchors")  # aggregates are written before they are joined: only a plain join's hot keys can be split
    rows = texts.mapInArrow(T.tidy(_run_rows(length, not each_row)), RUNS)
    found = scratch.save(rows.join(shared, "anchor"), "runs")

    place = F.struct(*PLACE, "first")
    kinds = ["anchor", "whole", "other"]
    runs = scratch.save(found.groupBy(*kinds).agg(F.sum("copies").alias("k"), F.min(place).alias("source"), F.first("windows").alias("windows")), "sources")
    mixed = scratch.save(runs.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
    source = [F.col("source.doc_id").alias("source_id"), F.col("source.first").alias("source_start")]
    copied = found.join(runs.where("k > 1").drop("windows"), kinds)
    copied = copied.select("slice", *PLACE, "first", "more", "windows", *(F.col(f"source.{c}").alias(f"source_{c}") for c in (*PLACE, "first")))
    wholes = scratch.save(copied.groupBy("slice").applyInArrow(_by_text, LISTS), "wholes")
    # Each different run of an anchor that has another goes to the anchor's block, from its source.
    several = runs.join(mixed, "anchor").withColumn("hot", F.col("kinds") > HOT)
    wanted = several.groupBy(*(F.col(f"source.{c}").alias(f"__{c}") for c in PLACE)).agg(F.collect_set(F.struct("anchor", F.col("source.first").alias("first"), "windows", "k", "hot")).alias("runs"))
    wanted = scratch.save(wanted, "wanted")
    same = texts["doc_id"].eqNullSafe(wanted["__doc_id"]) & (texts["th"] == wanted["__th"]) & (texts["tl"] == wanted["__tl"])
    blocks = texts.join(wanted, same).select(*PLACE, "text", "runs").mapInArrow(T.tidy(_blocks(length)), "hot boolean, anchor long, v long, u long, k long, doc_id long, th long, tl long, first int, windows int, words binary")
    blocks = scratch.save(blocks, "blocks")
    scratch.drop("anchors", "runs", "sources", "mixed", "wanted")
    plain = blocks.where("not hot").drop("hot", "v", "u").dropDuplicates(["anchor", *PLACE, "first"])  # rows that are equal in id and text
    count = -(-blocks.where("not hot").count() // BLOCK_ROWS) or 1
    parsed = plain.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(count))).groupBy("block").applyInArrow(_parsed(length), SPANS)
    parsed = scratch.save(parsed, "parsed")
    hot = blocks.where("hot").select("v", "u", "k", *PLACE, "first")
    hot = scratch.save(hot.dropDuplicates(["v", "u", *PLACE, "first"]), "windows")
    repeated = hot.groupBy("v", "u").agg(F.sum("k").alias("n"), F.min(place).alias("source")).where("n > 1")
    repeated = scratch.save(repeated, "repeated")
    here = place.eqNullSafe(F.col("source"))
    single = hot.join(repeated, ["v", "u"]).where((F.col("k") == 1) | ~here).select(*PLACE, F.col("first").alias("start"), F.lit(1).alias("windows"), here.alias("first"), *source)
    return wholes.union(parsed.union(single).select(*PLACE, F.array(F.struct(*SPAN)).alias("spans")))


def _with_spans(docs: DataFrame, text_col: str, spans: DataFrame, scratch: Scratch, id_col: str | None = None) -> DataFrame:
    """docs with ``__spans``, the starts and numbers of windows; null where there is none. By text, or with ``id_col`` by row."""
    keys = ["th", "tl"] if id_col is None else ["doc_id", "th", "tl"]
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["windows"].alias("windows")))
    lists = spans.select(*keys, plain.alias("spans")).groupBy(*keys).agg(F.flatten(F.collect_set("spans")).alias("__spans"))  # equal texts have equal lists
    spans = scratch.save(lists, "spans")
    spans = spans.withColumnsRenamed({k: f"__{k}" for k in keys})
    of = (F.xxhash64(text_col) == F.col("__th")) & (F.octet_length(text_col) == F.col("__tl"))
    if id_col is not None:
        of &= F.col(id_col).cast("bigint").eqNullSafe(F.col("__doc_id"))
    return docs.join(spans, of, "left").drop(*(f"__{k}" for k in keys))


def _removed(spans: list[dict] | None, n: int, length: int) -> np.ndarray:
    """Which of ``n`` words the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["start"]] += 1
        edge[s["start"] + s["windows"] + length - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space."""
    scratch = Scratch(docs.sparkSession, "dedup")
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digest = [], [], []
            for t, spans in zip(batch.column("text"), batch.column("__spans")):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                gone = _removed(spans.as_py(), len(words), length)
                counts.append(len(words))
                removed.append(int(gone.sum()))
                if removed[-1]:
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    spans = duplicate_spans(docs, length=length, scratch=scratch)
    return _with_spans(docs, "text", spans, scratch).mapInArrow(T.tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 35, keep_first: bool = False) -> DataFrame:
    """The same rows and columns, with the duplicate spans cut out of the text (with ``keep_first`` not at a passage's lowest place); white space between kept words stays."""
    scratch = Scratch(docs.sparkSession, "dedup")
    at = docs.columns.index(text_col)

    def cut(text: str, spans: list[dict]) -> str:
        w = T.words(pa.array([text], pa.large_string()))
        gone = _removed(spans, len(w.starts), length)
        ends = np.append(w.starts[1:], len(w.data))
        edge = np.zeros(len(w.data) + 1, np.int64)
        np.add.at(edge, w.starts[gone], 1)
        np.add.at(edge, ends[gone], -1)
        return w.data[np.cumsum(edge[:-1]) == 0].tobytes().decode("utf-8")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 1)
            texts = [t.as_py() if not s.is_valid else cut(t.as_py(), s.as_py()) for t, s in zip(batch.column(at), spans)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))

    spans = duplicate_spans(docs, id_col=id_col, text_col=text_col, length=length, each_row=keep_first, scratch=scratch)
    spans = spans.withColumn("spans", F.filter("spans", lambda s: ~s["first"])) if keep_first else spans
    return _with_spans(docs, text_col, spans, scratch, id_col if keep_first else None).select(*docs.columns, "__spans").mapInArrow(T.tidy(run), docs.schema)
