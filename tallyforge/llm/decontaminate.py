"""Passages of a benchmark in documents, up to a share of edits.

A document holds an item if a stretch of it, of any length, has a word edit distance (insert, delete, replace) of at
most ``floor(edits * words)`` from the item. That is with ``free_ends``, as op9 and the pipeline have it; without, only
stretches of as many words as the item count (or the whole of a shorter document), so a word dropped from or added to
a copy counts about twice. Case of A-Z and of Latin-1 letters is ignored, and all ASCII signs that are neither letters
nor digits only part words.

Candidates come from the CGK embedding. A walk goes over a window and writes down the word under it; a random bit of
the step and the word says whether it then stays or goes on. Two walks with the same bits over windows that differ by
an edit fall in step again by chance, so an edit distance becomes a Hamming distance of what they wrote. A key is
``SAMPLED`` of these words at times drawn by chance (bit sampling). Each window of the documents, as long as an item's,
from every word on, is looked up under the key of the item; that is repeated with other bits and times.
Bits repeat after ``PERIOD`` steps, so where all walks are after 4, 8, 16 ... steps comes from a few lookups, whatever
the windows' size. How many repeats windows of a size get is found on copies of the items themselves, with as many edits
as are allowed (words replaced, added, dropped, mixed; head or tail gone): the fewest that find the share ``recall`` of each
kind; if ``MOST_REPEATS`` don't, that is an error.
An item of over ``WINDOW`` words has a window for each of its nearly equal parts, one of which has no more than its
share of edits. Items that allow no edit are looked up whole by a hash of their words.

Candidates of an item that overlap are one stretch. If it has all but the allowed number of the item's words, the exact edit
distance decides, row by row over the whole stretch at once, so repetitive texts cost no more than others.

The benchmark is sent to the executors in parts of at most ``ITEMS`` items and ``ITEM_WORDS`` words (a longer item is
alone), each with a pass of its own over the documents. Items that are null or have under ``min_words`` words are
left out. Null and empty texts hold nothing. Repeated rows, of documents or of items, give repeated results; of passages
of an item that overlap, the one of least edits, then of fewest words, then the first is given. Other columns are
ignored, whatever their names. Without documents or items there is no result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import text as T

ITEMS = 20_000
ITEM_WORDS = 1_000_000
WINDOW = 32
PERIOD = 4
SAMPLED = 3
#: Keys that a walk gives, as far as there are times.
KEYS = 2
MOST_REPEATS = 256
#: Copies on which the number of repeats is found, and kinds of edits: of each kind the share must be reached.
TRIED = 480
STYLES = 6
#: Of copies with as many edits as are allowed; those with fewer are found more surely.
RECALL = 0.98
#: Windows whose sizes differ by less than this factor share the times that are sampled.
RATIO = 1.6
HELD = 1 << 20

BETWEEN = np.ones(256, bool)
for _range in (range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100)):
    BETWEEN[list(_range)] = False


def lowered(data: np.ndarray) -> np.ndarray:
    out = T.LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1  # U+00C0 to U+00DE but U+00D7 are 32 below their small letters
    second = data[after]
    out[after] = np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), second + 32, second)
    return out


def symbols(column: pa.Array) -> tuple[T.Words, np.ndarray]:
    w = T.words(column, BETWEEN, lowered)
    return w, w.hashes()


def passages(item: np.ndarray, words: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """Edits, start and end of the best stretch of ``words`` at each end that has one with at most ``most`` edits."""
    m = len(words)
    one = np.int64(1) << np.int64(32)
    row = np.arange(m, -1, -1)  # edits, and in the low 32 bits how far from the end the stretch starts: the shortest of equal ones
    steps = np.arange(m + 1) * one
    for i in range(len(item)):
        new = np.empty(m + 1, np.int64)
        new[0] = (i + 1) * one + m
        new[1:] = np.minimum(row[:-1] + (words != item[i]) * one, row[1:] + one)
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() >> 32 > most:
            return
    for end in np.flatnonzero(row >> 32 <= most).tolist():
        yield int(row[end] >> 32), m - int(row[end] & (one - 1)), end


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance, or ``most + 1`` if it is larger."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    row = np.arange(m + 1)
    steps = np.arange(m + 1)
    for i in range(n):
        new = np.empty(m + 1, np.int64)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (b != a[i]), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > most:
            return most + 1
    return min(int(row[m]), most + 1)


class Walk:
    """The walks of one repeat from every word of ``h`` on; place ``len(h)`` is the end, where walks stay."""

    def __init__(self, h: np.ndarray, repeat: int, longest: int) -> None:
        rng = np.random.default_rng([repeat, 7])
        odd = rng.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        bits = np.zeros(len(h) + 1, np.uint8)
        bits[:-1] = (h * odd) >> np.uint64(64 - 2 * PERIOD)
        bits[:-1] |= bits[:-1] & np.uint8(2**PERIOD - 1) == 0  # each word is left within a period
        here = np.arange(len(h) + 1)
        self.begun = here
        for step in range(int(rng.integers(PERIOD))):  # times are sampled from here on
            self.begun = self.begun + ((bits.take(self.begun) >> np.uint8(PERIOD + step)) & np.uint8(1))
        jump = here
        for step in range(PERIOD):
            jump = jump + ((bits.take(jump) >> np.uint8(step)) & np.uint8(1))
        self.jumps = [jump]
        while 2 ** len(self.jumps) <= longest:
            self.jumps.append(self.jumps[-1].take(self.jumps[-1]))

    def after(self, periods: int, start: np.ndarray | None = None) -> np.ndarray:
        """Where the walks (of those that begin at ``start``) are after so many periods."""
        at = self.begun if start is None else self.begun.take(start)
        for i, jump in enumerate(self.jumps):
            if periods >> i & 1:
                at = jump.take(at)
        return at


@dataclass
class Probe:
    """Keys of the windows of one size in one repeat."""

    size: int
    """The number of the size: its bit in ``Repeat.first``."""
    times: tuple[int, ...]
    second: np.ndarray
    """By a word's low bits: may it be the second that is sampled of a window?"""
    keys: np.ndarray
    of: np.ndarray
    """Windows by sorted keys."""


@dataclass
class Repeat:
    """What all sizes share: the first time, so that most windows are put aside at one look for all of them."""

    time: int
    first: np.ndarray
    """By a word's low bits: of windows of which sizes may it be the first word that is sampled?"""
    probes: list[Probe]


def _periods(words: int) -> int:
    """How many periods a walk over so many words has: it goes on by a little more than half a word a step."""
    return max(SAMPLED, int(1.6 * words / PERIOD))


def _low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(0xFFFF)).astype(np.int64)


def _key(h: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(at[0]), np.uint64)
    for i, x in enumerate(at):
        out += h[x] * T._STEP[i]
    return T.mix(out)


def _edited(item: np.ndarray, edits: int, style: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with so many edits, between other words. Styles: replaced, added, dropped, any of these; the head gone; the tail gone."""
    out = item.tolist()
    new = lambda: int(rng.integers(1 << 63))
    if style >= 4:
        out = out[edits:] if style == 4 else out[:-edits]
    else:
        for kind in rng.integers(3, size=edits).tolist() if style == 3 else [style] * edits:
            at = int(rng.integers(len(out)))
            out[at : at + (kind != 1)] = [] if kind == 2 else [new()]
    return np.array([new() for _ in range(8)] + out + [new() for _ in range(8)], np.uint64)


@dataclass
class Index:
    ids: np.ndarray
    items: list[np.ndarray]
    most: list[int]
    free_ends: bool
    exact: dict[int, tuple[np.ndarray, np.ndarray]]
    """Of items that allow no edit, by number of words: sorted hashes and their items."""
    windows: np.ndarray
    """item, first word, words."""
    repeats: list[Repeat]
    shortest: int
    longest: int

    @classmethod
    def of(cls, ids: list[int], texts: list[str], edits: float, min_words: int, free_ends: bool, recall: float = RECALL) -> Index | None:
        w, h = symbols(pa.array(texts, pa.string()))
        own = [(i, h[a:b]) for i, a, b in zip(ids, w.first[:-1].tolist(), w.first[1:].tolist()) if b - a >= max(1, min_words)]
        if not own:
            return None
        items = [x for _, x in own]
        most = [int(edits * len(x) + 1e-9) for x in items]
        exact: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(x) for x, e in zip(items, most) if not e}:
            of = np.array([k for k, x in enumerate(items) if len(x) == n and not most[k]])
            hashes = np.array([T.rolling(items[k], n)[0] for k in of], np.uint64)
            order = np.argsort(hashes, kind="stable")
            exact[n] = hashes[order], of[order]
        windows = []
        for k, x in enumerate(items):
            if most[k]:
                cuts = np.linspace(0, len(x), -(-len(x) // WINDOW) + 1).astype(int).tolist()
                windows += [(k, a, b - a) for a, b in zip(cuts, cuts[1:])]
        index = cls(np.array([i for i, _ in own]), items, most, free_ends, exact, np.array(windows, np.int64).reshape(-1, 3), [], 0, 0)
        if windows:
            words = index.windows[:, 2]
            index.shortest, index.longest = _periods(words.min()), _periods(words.max())
            sizes = np.unique((np.log(words) / np.log(RATIO)).astype(int), return_inverse=True)[1]
            for size in range(sizes.max() + 1):
                index._fill(size, np.flatnonzero(sizes == size), edits, recall)
        return index

    def _fill(self, size: int, own: np.ndarray, edits: float, recall: float) -> None:
        """Repeats for windows of one size until copies of them are found."""
        words = [self.items[k][a : a + n] for k, a, n in self.windows[own].tolist()]
        first = np.append(0, np.cumsum([len(x) for x in words]))
        h = np.append(np.concatenate(words), np.uint64(0))
        periods = _periods(min(map(len, words)))
        rng = np.random.default_rng(len(words[0]))
        some = rng.choice(len(words), min(TRIED // STYLES, len(words)), replace=False).tolist()
        tried = [i for i in some for _ in range(-(-TRIED // (STYLES * len(some))))]
        tried, style = np.repeat(tried, STYLES), np.tile(np.arange(STYLES), len(tried))
        copies = [_edited(words[i], max(1, int(edits * len(words[i]) + 1e-9)), s, rng) for i, s in zip(tried.tolist(), style.tolist())]
        rows = np.append(0, np.cumsum([len(x) for x in copies]))
        every, wanted = np.append(np.concatenate(copies), np.uint64(0)), own[tried]
        found = np.zeros(len(copies), bool)
        for i in range(MOST_REPEATS):
            if len(self.repeats) <= i:
                self.repeats.append(Repeat(int(np.random.default_rng([i, 3]).integers(self.shortest)), np.zeros(1 << 16, np.uint16), []))
            repeat = self.repeats[i]
            rest = np.random.default_rng([i, periods, 3]).permutation([t for t in range(periods) if t != repeat.time])
            walk = Walk(h[:-1], i, self.longest)
            for pick in range(0, KEYS * (SAMPLED - 1), SAMPLED - 1):
                if pick + SAMPLED - 1 > len(rest):
                    break
                times = (repeat.time, *rest[pick : pick + SAMPLED - 1].tolist())
                at = [walk.after(t, first[:-1]) for t in times]
                inside = np.flatnonzero(np.max(at, axis=0) < first[1:])
                repeat.first[_low(h[at[0][inside]])] |= np.uint16(1 << size)
                second = np.zeros(1 << 16, bool)
                second[_low(h[at[1][inside]])] = True
                keys = _key(h, [x[inside] for x in at])
                order = np.argsort(keys, kind="stable")
                repeat.probes.append(Probe(size, times, second, keys[order], own[inside[order]]))
            for start, window in self._hits(every, _low(every), Walk(every[:-1], i, self.longest), repeat, size):
                row = np.searchsorted(rows, start, "right") - 1
                found[row[window == wanted[row]]] = True
            least = min(found[style == x].mean() for x in range(STYLES))
            if least >= recall:
                return
        raise ValueError(f"{MOST_REPEATS} repeats find {least:.3f} of copies of windows of {len(words[0])} words with a share of {edits} edits, not {recall}")

    @staticmethod
    def _hits(h: np.ndarray, bits: np.ndarray, walk: Walk, repeat: Repeat, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Where windows begin that have the key of an item's window, and which; ``bits``: the low bits of ``h``."""
        begin = walk.after(repeat.time)
        sizes = repeat.first.take(bits).take(begin)
        may = np.flatnonzero(sizes)
        sizes = sizes.take(may)
        last = None
        for probe in repeat.probes:
            if size is not None and probe.size != size:
                continue
            if probe.size != last:
                own, last = may.take(np.flatnonzero(sizes & np.uint16(1 << probe.size))), probe.size
            start = own
            at = walk.after(probe.times[1], start)
            good = np.flatnonzero(probe.second.take(bits.take(at)))
            start, at = start.take(good), at.take(good)
            keys = _key(h, [begin.take(start), at, *(walk.after(t, start) for t in probe.times[2:])])
            low, high = np.searchsorted(probe.keys, keys, "left"), np.searchsorted(probe.keys, keys, "right")
            good = low < high
            start, low, n = start[good], low[good], (high - low)[good]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(start, n), probe.of[np.repeat(low, n) + step]

    def near(self, first: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Stretches of documents of words ``h`` that may hold an item: row, item, from and to (in ``h``)."""
        n = len(h)
        every = np.append(h, np.uint64(0))
        bits = _low(every)
        held: list[np.ndarray] = [np.zeros(0, np.int64)]
        size = 0
        for i, repeat in enumerate(self.repeats):
            for start, window in self._hits(every, bits, Walk(h, i, self.longest), repeat):
                held.append(window * np.int64(n + 1) + start)
                size += len(start)
                if size > HELD:
                    held = [np.unique(np.concatenate(held))]
                    size = 0
        codes = np.unique(np.concatenate(held))
        window, start = codes // (n + 1), codes % (n + 1)
        k, offset = self.windows[window, 0], self.windows[window, 1]
        k, start, offset = [k], [start], [offset]
        for words, (hashes, of) in self.exact.items():
            whole = T.rolling(h, words)
            low, high = np.searchsorted(hashes, whole, "left"), np.searchsorted(hashes, whole, "right")
            at = np.flatnonzero(low < high)
            number = (high - low)[at]
            step = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            k.append(of[np.repeat(low[at], number) + step])
            start.append(np.repeat(at, number))
            offset.append(np.zeros(len(step), np.int64))
        k, start, offset = (np.concatenate(x) for x in (k, start, offset))
        if not len(k):
            return
        e, sizes = np.array(self.most)[k], np.array([len(x) for x in self.items])[k]
        row = np.searchsorted(first, start, "right") - 1
        a = np.maximum(start - offset - 2 * e, first[row])
        b = np.minimum(start - offset + sizes + 3 * e, first[row + 1])
        order = np.lexsort((a, k, row))
        k, row, a, b = k[order], row[order], a[order], b[order]
        pair = np.append(0, np.cumsum((k[1:] != k[:-1]) | (row[1:] != row[:-1])))
        reach = np.maximum.accumulate(pair * (n + 1) + b) - pair * (n + 1)
        begins = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (a[1:] > reach[:-1])))
        yield from zip(row[begins].tolist(), k[begins].tolist(), a[begins].tolist(), reach[np.append(begins[1:], len(a)) - 1].tolist())

    def matches(self, first: np.ndarray, h: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """row, item, start in the row, words, edits: of passages that overlap, the one of least edits, then of fewest words, then the first."""
        out: list[tuple[int, int, int, int, int]] = []
        words: dict[int, list[int]] = {}
        for row, k, a, b in self.near(first, h):
            item, e = self.items[k], self.most[k]
            # All but e words of the item stand in a passage.
            own = words.get(k) or words.setdefault(k, item.tolist())
            if sum(map(set(h[a:b].tolist()).__contains__, own)) < len(own) - e:
                continue
            best: list[tuple[int, int, int, int]] = []
            for d, start, end in passages(item, h[a:b], e) if self.free_ends else self._windows(k, h, a, b, int(first[row]), int(first[row + 1])):
                this = (d, end - start, end, start)
                if best and start < best[-1][2]:
                    best[-1] = min(best[-1], this)
                else:
                    best.append(this)
            out += [(row, k, a + start - int(first[row]), end - start, d) for d, _, end, start in best]
        return sorted(out)

    def _windows(self, k: int, h: np.ndarray, a: int, b: int, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        """As ``passages``, of windows with as many words as the item."""
        item, n = self.items[k], len(self.items[k])
        last = max(begin, end - n)
        for at in range(min(a, last), min(max(a, b - n), last) + 1):
            x = h[at : min(at + n, end)]
            if (d := distance(x, item, self.most[k])) <= self.most[k]:
                yield d, at - a, at - a + len(x)


def _parts(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for row in items.toLocalIterator():
        n = len(row["text"].split())
        if ids and (len(ids) >= ITEMS or size + n > ITEM_WORDS):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += n
    if ids:
        yield ids, texts


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: float = 0.15, min_words: int = 1, free_ends: bool = False, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, start_word, n_words, edits for each passage found."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, start_word long, n_words long, edits long"
    out = None
    for ids, texts in _parts(benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")):
        index = Index.of(ids, texts, edits, min_words, free_ends, recall)
        if index is None:
            continue
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                for part in T.slices(batch, "text"):
                    w, h = symbols(part.column("text"))
                    found = own.matches(w.first, h)
                    if found:
                        row, k, at, n, d = (np.array(c, np.int64) for c in zip(*found))
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(own.ids[k].astype(np.int64)), pa.array(at), pa.array(n), pa.array(d)], names=["doc_id", "item_id", "start_word", "n_words", "edits"])

        part = docs.mapInArrow(T.tidy(run), schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", edits: float = 0.15, min_words: int = 1, free_ends: bool = False, recall: float = RECALL) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for ids, texts in _parts(benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")):
        index = Index.of(ids, texts, edits, min_words, free_ends, recall)
        if index is None:
            continue
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in T.slices(batch, text_col):
                    w, h = symbols(part.column(text_col))
                    keep = np.ones(part.num_rows, bool)
                    keep[[row for row, *_ in sent.value.matches(w.first, h)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(T.tidy(run), docs.schema)
    return docs
