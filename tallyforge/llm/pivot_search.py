"""Exact best inner products by an index of distances to pivots.

Inner products become distances: with ``M`` the largest norm, a vector gets one more component sqrt(M^2 - |x|^2) and
a query a zero, so |q - x|^2 = |q|^2 + M^2 - 2 q.x, and the best products are the nearest vectors.

Index: each vector is keyed by its nearest pivot and its distance to it; ``ANNULI`` ranges of that distance cut a
pivot's vectors into annuli. Pivots and ranges are fitted on at most ``SAMPLE`` rows; all rows are indexed, and each
annulus keeps its own least and largest distance. An annulus can hold vectors only from distance
max(d(q,p) - largest, least - d(q,p)) on (triangle inequality).

Search: a query first visits the annuli that can be nearest, until they hold enough vectors; its ``k``-th best product
there bounds the distance, and annuli that begin beyond it are never visited. The rest are, so results are exact.
An annulus is dealt out in chunks, and queries in blocks, so no task holds all of either.

Components become floor(``scale`` * x) as doubles, whose products are exact below 2^53. A vector that is null or has a
null or non-finite component takes no part. A shorter vector counts as filled up with zeros. A query's own row, and any
other with its id, is no result. Ties go to the smaller id. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.store import Scratch

PIVOTS = 24
ANNULI = 12
SAMPLE = 4096
CHUNK = 4096
QUERY_BLOCK = 8192


def _quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    v = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.when(F.col(vector_col).isNotNull() & ~bad, v).alias("v")).where("v is not null and vec_id is not null").withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.float64)
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _lift(m: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([m, np.sqrt(np.maximum(0.0, top - (m * m).sum(axis=1)))])


def _pivots(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """k-means from far-apart beginnings."""
    centres = sample[:1]
    far = ((sample - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(count, len(sample)) and far.max() > 0:
        centres = np.vstack([centres, sample[far.argmax()]])
        far = np.minimum(far, ((sample - centres[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        own = _distances(sample, centres).argmin(axis=1)
        centres = np.array([sample[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centres)])
    return centres


def _distances(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (m * m).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * m @ centres.T))


class PivotIndex:
    def __init__(self, vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> None:
        self.spark = vectors.sparkSession
        self.scratch = Scratch(self.spark, "pivots")
        rows = self.scratch.save(_quantised(vectors, id_col, vector_col, scale), "vectors")
        shape = rows.agg(F.max(F.size("v")), F.max("norm2"), F.count("*")).first()
        self.dim, self.top, self.count = shape[0] or 0, shape[1] or 0.0, shape[2]
        if not self.count:
            return
        dim, top = self.dim, self.top
        some = rows.select("v").orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).toPandas()["v"]
        sample = _lift(_matrix(pa.array(some.tolist(), pa.list_(pa.float64())), dim), top)
        self.pivots = pivots = _pivots(sample, PIVOTS)
        d = _distances(sample, pivots)
        own = d.argmin(axis=1)
        nearest = d[np.arange(len(d)), own]
        cuts = np.array([np.quantile(nearest[own == p], np.arange(1, ANNULI) / ANNULI) if (own == p).any() else np.zeros(ANNULI - 1) for p in range(len(pivots))])

        def key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                away = _distances(_lift(_matrix(batch.column("v"), dim), top), pivots)
                pivot = away.argmin(axis=1)
                near = away[np.arange(len(away)), pivot]
                annulus = (near[:, None] > cuts[pivot]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array((pivot * ANNULI + annulus).astype(np.int32)), pa.array(near)], names=["vec_id", "v", "cell", "distance"])

        self.index = self.scratch.save(rows.select("vec_id", "v").mapInArrow(key, "vec_id long, v array<double>, cell int, distance double"), "index")
        cells = self.index.groupBy("cell").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).orderBy("cell").toPandas()  # at most PIVOTS * ANNULI rows
        self.cells = {k: cells[k].to_numpy() for k in cells}

    def _visits(self, queries: DataFrame, k: int, again: bool) -> DataFrame:
        """query, v, cell: the cells to visit. ``again``: those beyond the first that the bound ``worst`` doesn't rule out."""
        cells, pivots, top, dim = self.cells, self.pivots, self.top, self.dim
        enough = min(self.count, 4 * k + 64)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = _matrix(batch.column("v"), dim)
                away = _distances(np.column_stack([m, np.zeros(len(m))]), pivots)[:, cells["cell"] // ANNULI]
                begin = np.maximum(0.0, np.maximum(away - cells["high"], cells["low"] - away))
                order = np.lexsort((np.broadcast_to(np.arange(begin.shape[1]), begin.shape), np.abs(away - (cells["low"] + cells["high"]) / 2), begin), axis=1)
                held = np.cumsum(cells["n"][order], axis=1)
                first = np.zeros(begin.shape, bool)
                np.put_along_axis(first, order, held - cells["n"][order] < enough, axis=1)
                if again:
                    worst = batch.column("worst").to_numpy(zero_copy_only=False).astype(float)
                    reach = (m * m).sum(axis=1) + top - 2 * worst
                    reach = np.where(np.isnan(reach), np.inf, np.sqrt(np.maximum(0.0, reach)))
                    first = ~first & (begin <= reach[:, None] * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(top)))
                rows, columns = np.nonzero(first)
                pick = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column("query").take(pick), batch.column("v").take(pick), pa.array(cells["cell"][columns].astype(np.int32))], names=["query", "v", "cell"])

        return queries.mapInArrow(run, "query long, v array<double>, cell int")

    def _best(self, visits: DataFrame, k: int, blocks: int) -> DataFrame:
        """The ``k`` best of each chunk visited."""
        dim = self.dim
        chunks = self.spark.createDataFrame([(int(c), -(-int(n) // CHUNK)) for c, n in zip(self.cells["cell"], self.cells["n"])], "cell int, chunks int")
        hashed = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
        left = visits.join(F.broadcast(chunks), "cell").select("query", "v", "cell", hashed("query", F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        right = self.index.join(F.broadcast(chunks), "cell").select("vec_id", "v", "cell", hashed("vec_id", F.col("chunks")).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

        def score(queries: pa.Table, vectors: pa.Table) -> pa.Table:
            out = [(np.zeros(0, np.int64),) * 3]
            if queries.num_rows and vectors.num_rows:
                vectors = vectors.sort_by("vec_id")
                ids, m = vectors["vec_id"].to_numpy(), _matrix(vectors["v"].combine_chunks(), dim)
                names, q = queries["query"].to_numpy(), _matrix(queries["v"].combine_chunks(), dim)
                for at in range(0, len(q), 1024):
                    products = q[at : at + 1024] @ m.T
                    products[names[at : at + 1024, None] == ids] = -np.inf
                    if len(ids) > k:
                        least = np.partition(products, len(ids) - k, axis=1)[:, len(ids) - k]
                    else:
                        least = np.full(len(products), -np.inf)
                    rows, columns = np.nonzero((products >= least[:, None]) & (products > -np.inf))
                    found = products[rows, columns]
                    order = np.lexsort((ids[columns], -found, rows))
                    rows, columns, found = rows[order], columns[order], found[order]
                    start = np.searchsorted(rows, rows)
                    keep = np.arange(len(rows)) - start < k
                    out.append((names[at : at + 1024][rows[keep]], ids[columns[keep]], found[keep].astype(np.int64)))
            columns = [np.concatenate(c) for c in zip(*out)]
            return pa.table(columns, names=["query_id", "vec_id", "score"])

        keys = ["cell", "chunk", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, "query_id long, vec_id long, score long")

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, rank, vec_id, score for the ids in the column ``query``, which are ids of indexed rows."""
        if not self.count:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        wanted = queries.select(F.col("query").cast("bigint").alias("query")).distinct()
        asked = self.index.join(wanted, F.col("vec_id") == F.col("query")).select("query", "v").dropDuplicates(["query", "v"])
        asked = self.scratch.save(asked, "queries")
        blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        first = self.scratch.save(self._best(self._visits(asked, k, False), k, blocks), "first")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        bound = first.withColumn("rank", place).where(F.col("rank") == k).select(F.col("query_id").alias("query"), F.col("score").alias("worst"))
        second = self._best(self._visits(asked.join(bound, "query", "left"), k, True), k, blocks)
        return first.union(second).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, *, every: int = 50, k: int = 5) -> DataFrame:
    """The best ``k`` of all vectors for each whose id is divisible by ``every``."""
    index = PivotIndex(vectors)
    return index.search(vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query")), k)
