"""Documents whose sets of word n-grams have a Jaccard similarity of at least ``percent`` / 100.

A size-aware join. Sets up to a boundary size are *light*: for each overlap ``c`` that a pair of such sizes needs,
a set puts out all its subsets of size ``c``, and equal subsets are links without more checks. Larger sets are
*heavy*: they meet in inverted lists, of which only a prefix is needed (a set's ``n - ceil(t n) + 1`` rarest
shingles), and the pairs that sizes, places in the lists and parity bitmaps allow are checked on the whole sets. (Of a
set, bit b of its bitmap is the parity of its shingles with hash b, so sets differ in at least as many shingles as their
bitmaps in bits.) The boundary is the largest size at which putting out subsets costs less than scanning lists, given the corpus's mean list.

Equal sets are one node from the start. In a list all nodes are first checked against one of them; afterwards
only pairs that lie in different components so far are checked, so a large group of near copies costs a few
checks for each member, and no link that would join two components is missed.

The order of shingles is free for right results. It goes by their counts in a sketch of ``SKETCH`` cells that is summed
over all documents, so rare ones come first; the sketch, a byte for each cell (the logarithm of its count), is all that
is broadcast, and its size doesn't depend on the corpus.

What is joined are sets: rows with equal sets are one node, whatever their ids, and a node's number comes from its set.
Null and empty texts and texts without words have an empty set, no link, and their own id as component. Rows with equal
ids and different texts are documents of their own, each in the component of its set. A component's id is the least
id that isn't null among its rows (null if there is none); repeated rows give repeated results. Columns other than the
two named are ignored, whatever their names. A text of any length is taken whole. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import text as T
from tallyforge.llm.components import components
from tallyforge.llm.store import Scratch

SKETCH = 1 << 24
SLICE = 1 << 16
SKETCH_ROWS = 1 << 18
FAN = 64
CHECK_COST = 4.0
MAX_LIGHT = 24
LONG = 512
GROUP_ROWS = 8192
BITS = 1024
WIDE_BITS = 16_384
WIDE_FROM = 800


def need(n: int, m: int, percent: int) -> int:
    """The least overlap of sets of these sizes."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def overlaps(n: int, percent: int) -> list[int]:
    """The overlaps that pairs with a set of this size can need."""
    return sorted({c for m in range(-(-percent * n // 100), 100 * n // percent + 1) if (c := need(n, m, percent)) <= n})


def boundary(mean_list: float, percent: int) -> int:
    """The largest size up to which subsets are the cheaper way."""
    x = 0
    for n in range(1, MAX_LIGHT + 1):
        if sum(comb(n, c) for c in overlaps(n, percent)) > prefix(n, percent) * (1 + CHECK_COST * mean_list):
            break
        x = n
    return x


def _parity(items: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits((np.bincount(items.view(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _signature(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def _node(items: np.ndarray) -> int:
    """A set's number: 64 bits of its signature."""
    return xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63)


def _survey(size: int, kmv: int = 256):
    """Each row's node and set size; with them a task's sketch by slices, and its least shingles, which tell how many distinct ones there are."""
    kinds = {"doc_id": pa.int64(), "th": pa.int64(), "node": pa.int64(), "n": pa.int64(), "item": pa.int64(), "cells": pa.binary()}

    def rows(kind: int, length: int, **columns: pa.Array) -> pa.RecordBatch:
        own = [columns.get(k, pa.nulls(length, t)) for k, t in kinds.items()]
        return pa.RecordBatch.from_arrays([*own, pa.array(np.full(length, kind, np.int32))], names=[*kinds, "kind"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total, least, sketch = 0, np.zeros(0, np.uint64), np.zeros(SKETCH, np.uint16)

        def count() -> np.ndarray:
            every = np.concatenate(held)
            cells, counts = np.unique((every & np.uint64(SKETCH - 1)).astype(np.uint32), return_counts=True)
            sketch[cells] = np.minimum(sketch[cells] + counts, 65535)  # it only orders shingles
            few = np.partition(every, min(kmv, len(every) - 1))[:kmv] if len(every) else every
            return np.unique(np.concatenate([least, few]))[:kmv]

        for batch in batches:
            for part in T.slices(batch, "text"):
                sets = list(T.shingle_sets(part.column("text"), size))
                nodes = pa.array([_node(s) if len(s) else None for s in sets], pa.int64())
                yield rows(0, len(sets), doc_id=part.column(0), th=part.column(1), node=nodes, n=pa.array([len(s) for s in sets], pa.int64()))
                held += sets
                total += sum(map(len, sets))
                if total >= SKETCH_ROWS:
                    least = count()
                    held, total = [], 0
        if held:
            least = count()
        yield rows(2, len(least), item=pa.array(least.view(np.int64)))
        for at in range(0, SKETCH, SLICE):
            own = sketch[at : at + SLICE]
            if own.any():
                yield rows(1, 1, item=pa.array([at // SLICE]), cells=pa.array([_pressed(own)], pa.binary()))

    return run


def _pressed(cells: np.ndarray) -> bytes:
    """Counts as planes of their bytes, compressed."""
    planes = np.ascontiguousarray(cells.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _loose(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _summed(table: pa.Table) -> pa.Table:
    """A slice of the sketch over up to ``FAN`` rows."""
    total = np.zeros(SLICE, np.uint64)
    for raw in table["cells"]:
        total += _loose(raw.as_py())
    return pa.table({"item": table["item"][:1], "cells": pa.array([_pressed(total)], pa.binary())})


def _listed(parts: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.asarray(p, kind) for p in parts]), pa.from_numpy_dtype(kind)))


def _lists(size: int, percent: int, light: int, sent):
    """For each set of a slice of texts, its prefix, rarest first, or its subsets, or both."""

    def shape(s: np.ndarray, often: np.ndarray) -> tuple:
        n, first, cs, keys = len(s), s[:0], [], []
        if n > light or 100 * n >= percent * (light + 1):
            first = s[np.lexsort((s, often))][: prefix(n, percent)]
        if n <= light:
            for c in overlaps(n, percent):
                for some in combinations(s.tolist(), c):
                    cs.append(c)
                    keys.append(xxhash.xxh3_64_intdigest(np.array(some, np.uint64).tobytes()) - (1 << 63))
        wide = _parity(s, WIDE_BITS) if n >= WIDE_FROM else first[:0].view(np.int64)
        return _node(s), n, first.view(np.int64), cs, keys, _parity(s, BITS), wide

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = sent.value
        for batch in batches:
            for part in T.slices(batch, "text"):
                sets = {_signature(s): s for s in T.shingle_sets(part.column("text"), size) if len(s)}
                rows = [shape(s, sketch[s & np.uint64(SKETCH - 1)]) for s in sets.values()]
                if not rows:
                    continue
                node, n, items, cs, keys, bits, wide = zip(*rows)
                columns = [pa.array(node, pa.int64()), pa.array(n, pa.int32()), _listed(items, np.int64), _listed(cs, np.int32)]
                columns += [_listed(x, np.int64) for x in (keys, bits, wide)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "items", "cs", "keys", "bits", "wide"])

    return run


def _whole_sets(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                sets = list(T.shingle_sets(part.column("text"), size))
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "items"])

    return run


def _compared(percent: int, light: int):
    """Which rows of a list may be links. Rows of blocks (``own`` of 0 or more) are compared only with those of another."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("item", "ascending"), ("n", "ascending")])
        item, n, place, node, component, own = (table[c].to_numpy().astype(np.int64) for c in ("item", "n", "place", "node", "component", "own"))
        bits = np.asarray(table["bits"].combine_chunks().flatten(), np.int64).view(np.uint64).reshape(len(item), -1)
        ends = np.searchsorted(item, item, "right")
        at, found = np.arange(len(item)), []
        for step in range(1, len(item)):
            at = at[at + step < ends[at]]
            # Sizes ascend within a list, so a row whose partner is too large has none further on.
            at = at[100 * n[at] >= percent * n[at + step]]
            if not len(at):
                break
            x, y = at, at + step
            least = -(-percent * (n[x] + n[y]) // (100 + percent))
            ok = (component[x] != component[y]) & (n[y] > light) & (np.minimum(n[x] - place[x], n[y] - place[y]) >= least) & ((own[x] < 0) | (own[x] != own[y]))
            x, y, least = x[ok], y[ok], least[ok]
            ok = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= n[x] + n[y] - 2 * least
            found.append(np.column_stack([np.minimum(node[x[ok]], node[y[ok]]), np.maximum(node[x[ok]], node[y[ok]])]))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _checked(percent: int):
    """Sets are looked at where they lie in the batch, one pair after the other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            inter, size = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            a, b = batch.column("a_items"), batch.column("b_items")
            for i in range(rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (a, b))
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two sorted runs
                inter[i], size[i] = np.count_nonzero(both[1:] == both[:-1]), len(both)
            keep = 100 * inter >= percent * (size - inter)
            ok = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok), pa.array(inter[keep]), pa.array((size - inter)[keep])], names=["a", "b", "both", "either"])

    return run


class JaccardJoin:
    """The join over one table. ``members`` maps rows to nodes, ``links`` are checked pairs of nodes."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> None:
        self.spark, self.size, self.percent = docs.sparkSession, size, percent
        self.docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
        self.scratch = Scratch(self.spark, "jaccard")
        self._prepare()

    def _prepare(self) -> None:
        survey = self.scratch.save(self.docs.mapInArrow(T.tidy(_survey(self.size)), "doc_id long, th long, node long, n long, item long, cells binary, kind int"), "survey")
        self.rows = survey.where("kind = 0").select("doc_id", "th", "node", "n")
        one = F.min(F.struct("doc_id", "th")).alias("one")
        nodes = self.rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), one).select("node", "least", F.col("one.doc_id").alias("doc_id"), F.col("one.th").alias("th"))
        self.nodes = self.scratch.save(nodes, "nodes")
        sent = self.spark.sparkContext.broadcast(self._sketch(survey.where("kind = 1").select("item", "cells")))
        least = survey.where("kind = 2").select("item").distinct().orderBy(F.when(F.col("item") < 0, 1).otherwise(0), "item").limit(256).toPandas()["item"].to_numpy(np.int64).view(np.uint64)
        total = self.rows.agg(F.sum("n")).first()[0] or 0
        distinct = len(least) if len(least) < 256 else (len(least) - 1) / (float(least.max()) / 2.0**64)
        self.light = boundary(total / max(1.0, distinct), self.percent)
        shapes = self.docs.mapInArrow(T.tidy(_lists(self.size, self.percent, self.light, sent)), "node long, n int, items array<bigint>, cs array<int>, keys array<bigint>, bits array<bigint>, wide array<bigint>")
        self.shapes = self.scratch.save(shapes.groupBy("node").agg(*(F.first(c).alias(c) for c in shapes.columns[1:])), "shapes")

    def _sketch(self, slices: DataFrame) -> np.ndarray:
        """The sum of all tasks' sketches as logarithms: added ``FAN`` slices at a time, so no group grows with the number of tasks."""
        step = 0
        while (slices.groupBy("item").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0) > 1:
            part = F.pmod(F.xxhash64("cells"), F.ceil(F.col("k") / FAN))
            dealt = slices.join(slices.groupBy("item").agg(F.count("*").alias("k")), "item").withColumn("part", part)
            slices = self.scratch.save(dealt.groupBy("item", "part").applyInArrow(_summed, "item long, cells binary"), f"sketch-{step}")
            step += 1
        out = np.zeros(SKETCH, np.uint8)
        for r in slices.toLocalIterator():  # SKETCH cells in all
            out[r["item"] * SLICE : (r["item"] + 1) * SLICE] = np.minimum(255, 8 * np.log2(1.0 + _loose(r["cells"]))).astype(np.uint8)
        return out

    def _light_links(self) -> DataFrame:
        """A subset's least set has every link that the subset gives: all whose sizes need no more than the subset."""
        subsets = self.shapes.where(F.size("keys") > 0).select("node", "n", F.explode(F.arrays_zip("cs", "keys")).alias("k")).select("node", "n", F.col("k.cs").alias("c"), F.col("k.keys").alias("key"))
        least = subsets.groupBy("c", "key").agg(F.min(F.struct("n", "node")).alias("low"), F.count("*").alias("k")).where("k > 1")
        found = subsets.join(least.select("c", "key", F.col("low.n").alias("m"), F.col("low.node").alias("b")), ["c", "key"]).where("node <> b")
        return found.where(self._need("n", "m") <= F.col("c")).select(F.col("node").alias("a"), "b").distinct()

    def _need(self, n: str, m: str) -> F.Column:
        return F.ceil(F.lit(self.percent) * (F.col(n) + F.col(m)) / F.lit(100 + self.percent))

    def _may_link(self, pairs: DataFrame) -> DataFrame:
        """What sizes and places in the order of shingles allow; the sides are n, place, node and m, at, b."""
        rest = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at"))
        sized = (100 * F.least("n", "m") >= self.percent * F.greatest("n", "m")) & (F.greatest("n", "m") > self.light)
        return pairs.where((F.col("node") != F.col("b")) & sized & (rest >= self._need("n", "m")))

    def _near(self, pairs: DataFrame, bitmap: str) -> DataFrame:
        """Pairs whose bitmaps allow a link. Small sets have no wide one; zip_with then gives nulls, which count nothing."""
        side = lambda x: self.shapes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col(bitmap).alias(f"{x}_bits"))
        bits = F.zip_with("a_bits", "b_bits", lambda x, y: F.coalesce(F.bit_count(x.bitwiseXOR(y)), F.lit(0)))
        apart = F.aggregate(bits, F.lit(0), lambda t, x: t + x)
        return pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= F.col("a_n") + F.col("b_n") - 2 * self._need("a_n", "b_n")).select("a", "b")

    def _check(self, pairs: DataFrame, label: str) -> DataFrame:
        """Which pairs of nodes are links: by their bitmaps first, and what is left on the whole sets."""
        may = self.scratch.save(self._near(pairs, "wide").distinct(), f"{label}-pairs")
        wanted = self.nodes.join(may.select(F.col("a").alias("node")).union(may.select(F.col("b").alias("node"))).distinct(), "node").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
        of = self.docs["doc_id"].eqNullSafe(wanted["__id"]) & (self.docs["th"] == wanted["__th"])
        texts = self.docs.where("text is not null").join(wanted, of, "left_semi").select("text")
        sets = texts.mapInArrow(T.tidy(_whole_sets(self.size)), "node long, items binary")
        sets = self.scratch.save(sets.groupBy("node").agg(F.first("items").alias("items")), f"{label}-sets")  # repeated rows give a set once
        side = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"{x}_items"))
        links = may.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_items", "b_items")
        links = self.scratch.save(links.mapInArrow(T.tidy(_checked(self.percent)), "a long, b long, both long, either long"), label)
        self.scratch.drop(f"{label}-pairs", f"{label}-sets")
        return links

    def _postings(self) -> DataFrame:
        """Places in lists of more than one node."""
        postings = self.shapes.select("node", "n", F.posexplode("items").alias("place", "item"))
        shared = postings.groupBy("item").agg(F.count("*").alias("k")).where("k > 1").select("item")
        postings = self.scratch.save(postings.join(shared, "item"), "postings")
        return postings

    def _pairs(self, of: DataFrame) -> DataFrame:
        """Pairs in a list that lie in different components and that sizes, places and bitmaps allow.

        Short lists are dealt to groups of about ``GROUP_ROWS`` rows; a long one is cut into blocks, each pair of which
        is a group. A group gives only the pairs that are left.
        """
        sizes = of.groupBy("item").agg(F.count("*").alias("k"))
        rows = of.select("item", "n", "place", "node", "component").join(sizes, "item").join(self.shapes.select("node", "bits"), "node")
        count = of.count()
        blocks = F.ceil(F.col("k") / LONG).cast("int")
        short = rows.where(F.col("k") <= LONG).withColumn("group", F.pmod(F.xxhash64("item"), F.lit(max(1, -(-count // GROUP_ROWS)))))
        long = rows.where(F.col("k") > LONG).withColumns({"own": F.pmod(F.xxhash64("node"), blocks).cast("int"), "blocks": blocks})
        long = long.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        long = long.withColumn("group", F.xxhash64("item", F.least("own", "other"), F.greatest("own", "other"))).withColumn("own", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")))
        columns = ["group", "item", "n", "place", "node", "component", "bits"]
        every = short.select(*columns, F.lit(-1).alias("own")).union(long.select(*columns, "own"))
        return every.groupBy("group").applyInArrow(_compared(self.percent, self.light), "a long, b long").distinct()

    def _mixed(self, held: DataFrame, found: DataFrame, label: str) -> DataFrame:
        """Places in lists whose nodes lie in more than one component."""
        held = held.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = held.groupBy("item").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("item")
        return self.scratch.save(held.join(mixed, "item"), label)

    def _all_links(self) -> DataFrame:
        """Every link between different sets, as nodes a < b."""
        heavy = self._check(self._pairs(self._postings().withColumn("component", F.col("node"))), "links")
        subsets = self.shapes.where(F.size("keys") > 0).select("node", "n", F.explode(F.arrays_zip("cs", "keys")).alias("k"))
        other = subsets.select(F.col("node").alias("b"), F.col("n").alias("m"), "k")
        light = subsets.join(other, "k").where("node < b").where(self._need("n", "m") <= F.col("k.cs")).select(F.col("node").alias("a"), "b")
        return heavy.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(light).distinct()

    def links(self) -> DataFrame:
        """Every link between different sets: a, b, the least ids of rows with either set (a is not the larger)."""
        side = lambda x: self.nodes.select(F.col("node").alias(x), F.col("least").alias(f"{x}_id"))
        found = self._all_links().join(side("a"), "a").join(side("b"), "b")
        return found.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))

    def _components(self) -> DataFrame:
        """node and component, both nodes, for every node that has a link."""
        postings = self._postings()
        light = self.scratch.save(self._light_links(), "light")
        links, found = light, self.scratch.save(components(light, self.scratch, "cc"), "components")
        held = postings.withColumn("component", F.col("node"))
        # In each list all are checked against one node: that of the rarest rest first, then two by chance.
        for i, order in enumerate((F.col("place"), F.xxhash64("node"), F.xxhash64("node", F.lit(1)))):
            low = held.groupBy("item").agg(F.min(F.struct(order.alias("order"), "node", "n", "place", "component")).alias("low"))
            low = low.select("item", F.col("low.n").alias("m"), F.col("low.node").alias("b"), F.col("low.place").alias("at"), F.col("low.component").alias("other"))
            pairs = self._may_link(held.join(low, "item").where("component <> other")).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
            new = self._check(self._near(pairs, "bits"), f"star-{i}").select("a", "b")
            links = links.union(new)
            if i == 0 or not new.isEmpty():
                found = self.scratch.save(components(links, self.scratch, f"cc-{i}"), f"components-{i}")
                held = self._mixed(held, found, f"held-{i}")
            if held.isEmpty():
                break
        self.scratch.drop("postings")
        if held.isEmpty():
            return found
        rest = self._check(self._pairs(held), "rest").select("a", "b")
        return found if rest.isEmpty() else components(links.union(rest), self.scratch, "cc-rest")

    def documents(self) -> DataFrame:
        """A row for each row: doc_id, n_shingles, component_id, and class_id, the least id among rows with the same set; ``th`` is the hash of its text, ``group`` the component's number."""
        found = self.scratch.save(self._components(), "found")
        nodes = self.nodes.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("group"))
        ids = nodes.groupBy("group").agg(F.min("least").alias("component_id"))
        nodes = self.scratch.save(nodes.join(ids, "group"), "groups")
        out = self.rows.join(nodes, "node", "left")
        own = lambda c: F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col(c))
        return out.select("doc_id", F.col("n").alias("n_shingles"), own("component_id").alias("component_id"), own("least").alias("class_id"), "th", "group")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, class_id."""
    return JaccardJoin(docs, **options).documents().select("doc_id", "n_shingles", "component_id", "class_id")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of linked documents, with all its columns: that of the least id (a null id before all), of equal ones that of the least text hash.

    Rows that are equal in id and text are one document, of which one row stays, also where the text has no words.
    """
    join = JaccardJoin(docs, id_col=id_col, text_col=text_col, **options)
    rows = join.documents()
    key = F.when(F.col("group").isNull(), F.struct(F.lit(1).alias("k"), F.col("th").alias("g"), F.col("doc_id").alias("i"))).otherwise(F.struct(F.lit(0).alias("k"), F.col("group").alias("g"), F.lit(None).cast("bigint").alias("i")))
    kept = rows.groupBy(key.alias("key")).agg(F.min(F.struct("doc_id", "th")).alias("one")).select(F.col("one.doc_id").alias("__id"), F.col("one.th").alias("__th"))
    kept = join.scratch.save(kept, "kept")
    names = [f"__{i}" for i in range(len(docs.columns))]  # whatever the columns' names
    plain = docs.toDF(*names).withColumns({"__doc": F.col(names[docs.columns.index(id_col)]).cast("bigint"), "__text": F.xxhash64(names[docs.columns.index(text_col)])})
    found = plain.join(kept, plain["__doc"].eqNullSafe(kept["__id"]) & (plain["__text"] == kept["__th"]), "left_semi")
    return found.dropDuplicates(["__doc", "__text"]).select(*names).toDF(*docs.columns)
