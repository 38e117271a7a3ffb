"""Shards of nearly equal bytes as leaves of a k-d tree over metadata.

A node is split at the weighted median (bytes) along its widest dimension: the one whose range in the node is the
largest share of the range in the table. Nodes are split, a level at a time, until leaves reach the target bytes.
A median is found by histograms: all rows of a level are counted into ``BINS`` ranges of their node's dimension, the
range that holds the median is taken and counted again, at most until one row is left; equal values are parted by a
hash of the row. Each round is one scan of a narrow table (no texts) whose counts combine before the shuffle; the
driver sees at most ``BINS`` sums for each node.

Null texts have no bytes, and each row weighs one byte more than its text. Null metadata count as 0. Repeated rows
are rows of their own, and an empty table gives none. Which of rows with equal metadata goes left is decided by a hash of
the place where the row is read, once, when the first level is written: another layout of the files deals such ties
differently, a lost executor doesn't. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.store import Scratch

BINS = 1024
TOLERANCE = 2e-4
TIE_BITS = 62


@dataclass
class _Search:
    """Where a node's median lies: among rows with ``low <= value <= high``, or with that value and such a tie."""

    node: int
    dim: int
    low: int
    high: int
    target: float
    below: float = 0.0
    value: int | None = None
    cut: tuple[int, int] | None = None
    """Rows below (value, tie) go left."""


def _narrow(s: _Search, counts: dict[int, tuple[float, int]], tolerance: float) -> None:
    width = -(-(s.high - s.low + 1) // BINS)
    for b in sorted(counts):
        weight, rows = counts[b]
        start, end = s.low + b * width, min(s.high, s.low + (b + 1) * width - 1)
        if s.below + weight < s.target and b != max(counts):
            s.below += weight
            continue
        if weight <= tolerance or rows == 1:
            edge = start if s.target - s.below <= weight / 2 else end + 1
            s.cut = (edge, 0) if s.value is None else (s.value, edge)
        elif start < end:
            s.low, s.high = start, end
        elif s.value is None:
            s.value, s.low, s.high = start, 0, (1 << TIE_BITS) - 1
        else:
            s.cut = (s.value, end + 1)
        return
    s.cut = (s.low, 0)


def assign(docs: DataFrame, dims: dict[str, Column], *, size: Column, keep: dict[str, Column], leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """The columns of ``keep`` with size and shard; ``leaves`` (a power of two), or as many as ``target_bytes`` asks for."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "kd")
    names = list(dims)
    row = docs.select(*(c.alias(k) for k, c in keep.items()), size.cast("bigint").alias("size"), F.array(*(F.coalesce(c.cast("bigint"), F.lit(0)) for c in dims.values())).alias("__dims"))
    row = row.withColumns({"__tie": F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - TIE_BITS), "__node": F.lit(1)})
    rows = scratch.save(row, "level-0")
    ranges = lambda d: [f(F.col("__dims")[i]).alias(f"{k}{i}") for i in range(len(names)) for k, f in (("low", F.min), ("high", F.max))]
    whole = rows.agg(F.sum("size").alias("size"), *ranges(rows)).first()
    total = whole["size"] or 0
    if leaves is None:
        leaves = 1
        while target_bytes and total / leaves > target_bytes:
            leaves *= 2
    depth = leaves.bit_length() - 1
    for level in range(depth):
        nodes = rows.groupBy("__node").agg(F.sum("size").alias("size"), *ranges(rows)).collect()  # at most ``leaves`` rows
        searches = {}
        for x in nodes:
            spread = [(x[f"high{i}"] - x[f"low{i}"]) / max(1, whole[f"high{i}"] - whole[f"low{i}"]) for i in range(len(names))]
            dim = max(range(len(names)), key=lambda i: (spread[i], -i))
            searches[x["__node"]] = _Search(x["__node"], dim, x[f"low{dim}"], x[f"high{dim}"], x["size"] / 2)
        while open_ := [s for s in searches.values() if s.cut is None]:
            state = spark.createDataFrame([(s.node, s.dim, s.low, s.high, s.value) for s in open_], "__node int, dim int, low long, high long, value long")
            here = rows.join(F.broadcast(state), "__node")  # a row for each open node
            place = F.when(F.col("value").isNull(), F.element_at("__dims", F.col("dim") + 1)).otherwise(F.col("__tie"))
            here = here.where(F.col("value").isNull() | (F.element_at("__dims", F.col("dim") + 1) == F.col("value"))).withColumn("place", place).where("place between low and high")
            binned = here.select("__node", F.expr(f"(place - low) div ((high - low) div {BINS} + if((high - low + 1) % {BINS} = 0, 0, 1))").alias("bin"), "size")
            counts: dict[int, dict[int, tuple[float, int]]] = {}
            for node, b, weight, n in binned.groupBy("__node", "bin").agg(F.sum("size"), F.count("*")).collect():  # at most BINS rows a node
                counts.setdefault(node, {})[b] = (weight, n)
            for s in open_:
                _narrow(s, counts.get(s.node, {}), TOLERANCE * 2 * s.target)
        cuts = spark.createDataFrame([(s.node, s.dim, *s.cut) for s in searches.values()], "__node int, dim int, value long, tie long")
        at = F.element_at("__dims", F.col("dim") + 1)
        right = (at > F.col("value")) | ((at == F.col("value")) & (F.col("__tie") >= F.col("tie")))
        rows = rows.join(F.broadcast(cuts), "__node").withColumn("__node", F.col("__node") * 2 + right.cast("int"))
        rows = scratch.save(rows.select(*keep, "size", "__dims", "__tie", "__node"), f"level-{level + 1}")
        scratch.drop(f"level-{level}")
    return rows.withColumn("shard", (F.col("__node") - leaves).cast("int")).select(*keep, "size", "shard", "__tie")


def slots(rows: DataFrame, order: list[str], buckets: int = 256) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard: rows are numbered in ``buckets`` parts of a shard, each after the rows of the parts before."""
    rows = rows.withColumn("__bucket", F.pmod(F.col("__tie"), F.lit(buckets)))
    counts = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "__bucket", F.coalesce(before, F.lit(0)).alias("__start"))
    number = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy(*order, "__tie"))
    return rows.withColumn("__number", number).join(starts, ["shard", "__bucket"]).withColumn("slot", (F.col("__start") + F.col("__number") - 1).cast("bigint")).drop("__bucket", "__start", "__number", "__tie")


def shard_documents(docs: DataFrame, leaves: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for the columns of ``documents``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    code = lambda c: F.crc32(F.coalesce(F.col(c), F.lit("")).cast("binary"))
    dims = {"doc_id": F.col("doc_id"), "size": F.octet_length(text), "source": code("source"), "lang": code("lang")}
    rows = assign(docs, dims, size=F.octet_length(text) + 1, keep={"doc_id": F.col("doc_id"), "text_crc32": F.crc32(text.cast("binary"))}, leaves=leaves)
    return slots(rows, ["doc_id"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes the documents as one folder for each shard."""
    docs.join(shards.select(id_col, "shard", "slot"), id_col).repartition("shard", F.floor(F.col("slot") / 100_000)).write.partitionBy("shard").mode("overwrite").parquet(path)
