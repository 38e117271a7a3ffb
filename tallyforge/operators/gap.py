"""Distances between selections over vectors (GAP-*).

What a distance needs of a selection (GAP-S*) is summed for all selections at once; pairs are joins of these sums.
Kernel distances compare all pairs of rows by definition: rows are packed into tiles, and pairs of tiles meet by an
equi-join on tile numbers, each pair of tiles giving one sum.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.config import DomainGapConfig, HistogramSummaryConfig, KernelParams
from tallyforge.functions import stats
from tallyforge.operators.base import KEYS, GapProcessor, held
from tallyforge.registry import register

FLOOR = 1e-9
TILE = 2048
FOLDS = 5
STRIP = 64
FAN = 256
# Channels of a ResNet-18's layers.
CHANNELS = {"layer1": 64, "layer2": 128, "layer3": 256, "layer4": 512, "avgpool": 512}
PAIR = ("selection_source", "selection_target")
METRICS = ("mmd_linear", "klmvn_diag", "fid", "wasserstein_1d", "mmd_rbf", "mmd_poly", "pad", "cmd")


def vectors(df: DataFrame, column: str) -> DataFrame:
    """Rows with a vector, in double."""
    return df.select(*KEYS, F.transform(f"`{column}`", lambda x: x.cast("double")).alias("v")).where("v is not null")


def moments(rows: DataFrame) -> DataFrame:
    """GAP-S1: n, s, ss of each selection and dimension."""
    x = rows.select(*KEYS, F.posexplode("v").alias("pos", "x"))
    return x.groupBy(*KEYS, "pos").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))


def outer_sums(rows: DataFrame) -> DataFrame:
    """GAP-S2: selection, strip, start, n, s, ss: the sums of products of each selection, ``STRIP`` rows of the matrix to a strip.

    Partitions give matrices, which are added by strips and in two steps, so no task holds more than a strip of ``FAN`` partitions.
    """
    schema = "selection string, strip int, part int, n long, s binary, ss binary"
    arrow = pa.schema([("selection", pa.string()), ("strip", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("s", pa.binary()), ("ss", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            names = np.array(batch.column("selection").to_pylist(), object)
            for name in dict.fromkeys(names.tolist()):
                own = batch.filter(pa.array(names == name)).column("v")
                m = np.asarray(own.flatten()).reshape(len(own), -1)
                n, s, ss = held.get(name, (0, 0.0, 0.0))
                held[name] = [n + len(m), s + m.sum(axis=0), ss + m.T @ m]
        part = TaskContext.get().partitionId()
        for name, (n, s, ss) in held.items():
            for strip, at in enumerate(range(0, len(s), STRIP)):
                yield pa.RecordBatch.from_pylist([{"selection": name, "strip": strip, "part": part // FAN, "n": n, "s": s.tobytes(), "ss": ss[at : at + STRIP].tobytes()}], schema=arrow)

    def add(table: pa.Table) -> pa.Table:
        s, ss = (sum(np.frombuffer(x.as_buffer()) for x in table[c]) for c in ("s", "ss"))
        return pa.table({"selection": table["selection"][:1], "strip": table["strip"][:1], "part": pa.array([0], pa.int32()), "n": pa.array([sum(table["n"].to_pylist())]), "s": pa.array([s.tobytes()]), "ss": pa.array([ss.tobytes()])})

    parts = rows.select("selection", "v").mapInArrow(run, schema)
    for keys in (("selection", "strip", "part"), ("selection", "strip")):
        parts = parts.groupBy(*keys).applyInArrow(add, schema)
    return parts.drop("part")


def histograms(rows: DataFrame, h: HistogramSummaryConfig) -> DataFrame:
    """GAP-S3: counts of each selection, dimension and bin; a value at the upper end is in the last bin, outside in none."""
    low, high = map(float, h.range)
    x = rows.select(*KEYS, F.posexplode(F.slice("v", 1, h.dims)).alias("pos", "x")).where(F.col("x").between(low, high))
    b = F.least(F.lit(h.bins - 1), F.floor((F.col("x") - low) / F.lit((high - low) / h.bins)).cast("int"))
    return x.groupBy(*KEYS, "pos", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def power_sums(rows: DataFrame, channels: int, k: int) -> DataFrame:
    """GAP-S5: means of the powers of sigmoid(x) over rows and cells of each selection and channel."""
    per = F.greatest(F.lit(1), (F.size("v") / channels).cast("int"))
    x = rows.select(*KEYS, per.alias("per"), F.posexplode("v").alias("pos", "x"))
    s = 1 / (1 + F.exp(-F.col("x")))
    x = x.select(*KEYS, F.floor(F.col("pos") / F.col("per")).alias("channel"), s.alias("y"))
    return x.groupBy(*KEYS, "channel").agg(*(F.avg(F.pow("y", F.lit(float(j)))).alias(f"m{j}") for j in range(1, k + 1)))


def paired(summary: DataFrame, on: list[str]) -> DataFrame:
    """Each selection's row with each later one's, by ``on``; columns of the later one end with _t."""
    rest = [c for c in summary.columns if c not in (*KEYS, *on)]
    s = summary.select(F.col("selection").alias(PAIR[0]), F.col("selection_ix").alias("__s"), *on, *rest)
    t = summary.select(F.col("selection").alias(PAIR[1]), F.col("selection_ix").alias("__t"), *on, *(F.col(c).alias(f"{c}_t") for c in rest))
    return s.join(t, on).where("__s < __t").drop("__s", "__t")


def mmd_linear(rows: DataFrame) -> DataFrame:
    mean = moments(rows).withColumn("m", F.col("s") / F.col("n")).select(*KEYS, "pos", "m")
    return paired(mean, ["pos"]).groupBy(*PAIR).agg(F.sum(F.pow(F.col("m") - F.col("m_t"), F.lit(2.0))).alias("value"))


def klmvn_diag(rows: DataFrame, var_eps: float = 0.0) -> DataFrame:
    m = F.col("s") / F.col("n")
    base = moments(rows).select(*KEYS, "pos", m.alias("m"), F.greatest(F.lit(FLOOR), F.col("ss") / F.col("n") - m * m).alias("v"))
    pairs = paired(base, ["pos"])
    if var_eps > 0:
        w = Window.partitionBy(*PAIR)
        extra = F.lit(var_eps) * (F.avg("v").over(w) + F.avg("v_t").over(w)) / 2
        pairs = pairs.withColumn("__e", extra).withColumns({"v": F.col("v") + F.col("__e"), "v_t": F.col("v_t") + F.col("__e")})
    ratio = F.col("v") / F.col("v_t")
    term = ratio - 1 - F.log(ratio) + F.pow(F.col("m_t") - F.col("m"), F.lit(2.0)) / F.col("v_t")
    return pairs.groupBy(*PAIR).agg((F.sum(term) / 2).alias("value"))


def wasserstein_1d(rows: DataFrame, h: HistogramSummaryConfig) -> DataFrame:
    counts = histograms(rows, h)
    bins = counts.sparkSession.range(h.bins).select(F.col("id").cast("int").alias("bin"))
    full = counts.select(*KEYS, "pos").distinct().join(F.broadcast(bins)).join(counts, [*KEYS, "pos", "bin"], "left")  # ``bins`` has h.bins rows
    w = Window.partitionBy(*KEYS, "pos")
    cdf = full.withColumns({"c": F.sum(F.coalesce("n", F.lit(0))).over(w.orderBy("bin")), "all": F.sum(F.coalesce("n", F.lit(0))).over(w)}).select(*KEYS, "pos", "bin", (F.col("c") / F.col("all")).alias("cdf"))
    width = (h.range[1] - h.range[0]) / h.bins
    per = paired(cdf, ["pos", "bin"]).groupBy(*PAIR, "pos").agg((F.sum(F.abs(F.col("cdf") - F.col("cdf_t"))) * width).alias("d"))
    return per.groupBy(*PAIR).agg(F.avg("d").alias("value"))


def kernel_value(kind: str, p: KernelParams, x: np.ndarray, y: np.ndarray) -> float:
    inner = x @ y.T
    if kind == "mmd_poly":
        return float(((p.gamma * inner + p.coefficient0) ** p.degree).sum())
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * inner
    return float(np.exp(-p.gamma * np.sqrt(np.maximum(square, 0.0))).sum())


def mmd_kernel(rows: DataFrame, kind: str, p: KernelParams) -> DataFrame:
    """GAP-5, GAP-6: the biased estimate, not below 0; 0 where a side has one row or none."""
    rows = held(rows)  # dealt by row numbers below, so rows must stay where they are
    sizes = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    # A hash of the row deals it to a tile; tiles of a selection are as many as its rows need.
    many = F.ceil(F.col("n") / TILE).cast("long")
    before = F.sum(many).over(Window.orderBy("selection_ix").rowsBetween(Window.unboundedPreceding, -1))  # a row for each selection
    sizes = sizes.withColumn("begin", F.coalesce(before, F.lit(0)))
    total = sizes.agg(F.sum(many)).first()[0] or 0
    dealt = rows.join(sizes, list(KEYS)).withColumn("id", F.col("begin") + F.pmod(F.xxhash64("v", F.monotonically_increasing_id()), many))

    def pack(table: pa.Table) -> pa.Table:
        own = table["v"].combine_chunks()
        m = np.asarray(own.flatten(), float)
        return pa.table({"selection_ix": table["selection_ix"][:1].cast(pa.int32()), "id": table["id"][:1], "rows": pa.array([len(own)], pa.int32()), "data": pa.array([m.tobytes()], pa.binary())})

    tiles = held(dealt.select("selection_ix", "id", "v").groupBy("id").applyInArrow(pack, "selection_ix int, id long, rows int, data binary"))
    # All pairs of tiles are what a kernel distance is; a tile's number tells which others it meets.
    left = tiles.select(F.col("selection_ix").alias("a"), F.col("rows").alias("a_rows"), F.col("data").alias("a_data"), "id", F.explode(F.sequence("id", F.lit(total - 1).cast("long"))).alias("other"))
    right = tiles.select(F.col("id").alias("other"), F.col("selection_ix").alias("b"), F.col("rows").alias("b_rows"), F.col("data").alias("b_data"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, y = (np.frombuffer(r[f"{s}_data"]).reshape(r[f"{s}_rows"], -1) for s in "ab")
                value = kernel_value(kind, p, x, y) * (2.0 if r["a"] == r["b"] and r["id"] != r["other"] else 1.0)
                yield pa.RecordBatch.from_arrays([pa.array([min(r["a"], r["b"])], pa.int32()), pa.array([max(r["a"], r["b"])], pa.int32()), pa.array([value])], names=["a", "b", "k"])

    sums = left.join(right, "other").mapInArrow(run, "a int, b int, k double").groupBy("a", "b").agg(F.sum("k").alias("k"))
    own = sums.where("a = b").select(F.col("a").alias("ix"), F.col("k").alias("own"))
    side = lambda x, name: sizes.select(F.col("selection_ix").alias(x), F.col("selection").alias(name), F.col("n").alias(f"n_{x}")).join(own.select(F.col("ix").alias(x), F.col("own").alias(f"own_{x}")), x)
    pairs = sums.where("a < b").join(side("a", PAIR[0]), "a").join(side("b", PAIR[1]), "b")
    value = F.col("own_a") / (F.col("n_a") * F.col("n_a")) + F.col("own_b") / (F.col("n_b") * F.col("n_b")) - 2 * F.col("k") / (F.col("n_a") * F.col("n_b"))
    return pairs.select(*PAIR, F.when((F.col("n_a") > 1) & (F.col("n_b") > 1), F.greatest(F.lit(0.0), value)).otherwise(0.0).alias("value"))


def fid(rows: DataFrame, pairs: list[tuple[str, str]], eps: float) -> DataFrame:
    """GAP-3: a row for each selection holds its matrix; pairs meet by joins, and a task has one pair at a time."""

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("strip")
        return pa.table({"selection": table["selection"][:1], "n": table["n"][:1], "s": table["s"][:1], "ss": pa.array([b"".join(table["ss"].to_pylist())])})

    summary = held(outer_sums(rows).groupBy("selection").applyInArrow(whole, "selection string, n long, s binary, ss binary"))
    side = lambda name, x: summary.select(F.col("selection").alias(name), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "s", "ss")))
    wanted = rows.sparkSession.createDataFrame(pairs, f"{PAIR[0]} string, {PAIR[1]} string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = []
                for x in "ab":
                    n = batch.column(f"{x}_n")[i].as_py()
                    mean = np.frombuffer(batch.column(f"{x}_s")[i].as_buffer()) / n
                    found.append((mean, np.frombuffer(batch.column(f"{x}_ss")[i].as_buffer()).reshape(len(mean), -1) / n - np.outer(mean, mean) + eps * np.eye(len(mean))))
                (mu, x), (nu, y) = found
                value = abs(float(((mu - nu) ** 2).sum() + np.trace(x) + np.trace(y) - 2 * stats.root_trace(x, y)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([value])], names=[*PAIR, "value"])

    both = wanted.join(side(PAIR[0], "a"), PAIR[0]).join(side(PAIR[1], "b"), PAIR[1]).select(*PAIR, *(f"{x}_{c}" for x in "ab" for c in ("n", "s", "ss")))
    return both.mapInArrow(run, f"{PAIR[0]} string, {PAIR[1]} string, value double")


def pad(rows: DataFrame, pairs: list[tuple[str, str]], evaluator: str) -> DataFrame:
    """GAP-7: a linear SVM between the two sides; its margins become probabilities by a sigmoid that is fitted on folds that the SVM of a fold hasn't seen."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = []
    for s, t in pairs:
        data = rows.where(F.col("selection").isin(s, t)).select(array_to_vector("v").alias("features"), F.when(F.col("selection") == t, 1.0).otherwise(0.0).alias("label"), F.pmod(F.xxhash64("v"), F.lit(FOLDS)).alias("fold")).persist()
        n = data.count()
        svm = LinearSVC(regParam=1.0 / max(1, n), standardization=False, maxIter=50, rawPredictionCol="raw")
        margin = lambda model, d: model.transform(d).select("label", vector_to_array("raw")[1].alias("m"))
        unseen = None
        for k in range(FOLDS):
            train, test = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
            if train.select("label").distinct().count() == 2:
                part = margin(svm.fit(train), test)
                unseen = part if unseen is None else unseen.union(part)
        if unseen is None or data.select("label").distinct().count() < 2:
            data.unpersist()
            continue
        as_vector = lambda d: d.select("label", array_to_vector(F.array("m")).alias("features"))
        sigmoid = LogisticRegression(maxIter=100).fit(as_vector(unseen))
        p = vector_to_array("probability")[1]
        scored = sigmoid.transform(as_vector(margin(svm.fit(data), data))).select((p - F.col("label")).alias("e"))
        error = scored.agg(F.avg(F.pow("e", F.lit(2.0)) if evaluator == "mse" else F.abs("e"))).first()[0]
        data.unpersist()
        out.append((s, t, 2 * (1 - 2 * float(error))))
    return rows.sparkSession.createDataFrame(out, f"{PAIR[0]} string, {PAIR[1]} string, value double")


def cmd(layers: list[tuple[DataFrame, int, float]], k: int) -> DataFrame:
    """GAP-8: layers as rows, channels and weight."""
    total, weights = None, sum(w for *_, w in layers)
    for rows, channels, weight in layers:
        base = power_sums(rows, channels, k)
        central = {1: F.col("m1")}
        for j in range(2, k + 1):
            terms = [F.lit(float(comb(j, i) * (-1) ** (j - i))) * (F.col(f"m{i}") if i else F.lit(1.0)) * F.pow("m1", F.lit(float(j - i))) for i in range(j + 1)]
            c = terms[0]
            for term in terms[1:]:
                c = c + term
            central[j] = c
        own = base.select(*KEYS, "channel", *(c.alias(f"c{j}") for j, c in central.items()))
        sums = paired(own, ["channel"]).groupBy(*PAIR).agg(*(F.sqrt(F.sum(F.pow(F.col(f"c{j}") - F.col(f"c{j}_t"), F.lit(2.0)))).alias(f"d{j}") for j in range(1, k + 1)))
        value = sum((F.col(f"d{j}") for j in range(1, k + 1)), F.lit(0.0)) / k
        part = sums.select(*PAIR, (value * weight).alias("value"))
        total = part if total is None else total.union(part)
    return total.groupBy(*PAIR).agg((F.sum("value") / weights).alias("value"))


@register("gap", "domain_gap")
class DomainGap(GapProcessor):
    config_model = DomainGapConfig

    def _channels(self, df: DataFrame, column: str) -> int | None:
        """GAP-S6."""
        given = (self.config.summary.channels or {}) if self.config.summary else {}
        if column in given:
            return given[column]
        if f"{column}_channels" in df.columns:
            return df.agg(F.max(f"`{column}_channels`")).first()[0]
        return next((n for layer, n in CHANNELS.items() if column.endswith(layer)), None)

    def compute(self, df: DataFrame) -> DataFrame:
        d = self.config.distance
        metric, params = d.metric, d.kernel_params or KernelParams()
        h = (self.config.summary.histogram if self.config.summary else None) or HistogramSummaryConfig()
        names = [(r["selection"], r["selection_ix"]) for r in df.select(*KEYS).distinct().orderBy("selection_ix").collect()]
        pairs = [(s, t) for i, (s, _) in enumerate(names) for t, _ in names[i + 1 :]]
        columns = [c for c in self.columns(df) if dict(df.dtypes)[c].startswith("array")]
        if metric not in METRICS:
            return self._notes(df, pairs, "unsupported metric or invalid inputs")
        if not columns:
            return self._notes(df, pairs, "missing keys: no column of vectors")
        rows = vectors(df, columns[0])
        if metric == "mmd_linear":
            found = mmd_linear(rows)
        elif metric == "klmvn_diag":
            found = klmvn_diag(rows, d.klmvn_var_eps)
        elif metric == "wasserstein_1d":
            found = wasserstein_1d(rows, h)
        elif metric in ("mmd_rbf", "mmd_poly"):
            found = mmd_kernel(rows, metric, params)
        elif metric == "fid":
            found = fid(rows, pairs, d.epsilon)
        elif metric == "pad":
            found = pad(rows, pairs, d.evaluator or "mae")
        else:
            weights = d.feature_weights if d.feature_weights and len(columns) == len(self.config.columns.input) == len(d.feature_weights) else [1.0] * len(columns)
            layers = []
            for c, w in zip(columns, weights):
                if w == 0:
                    continue
                channels = self._channels(df, c)
                if not channels:
                    raise ValueError(f"{self.name}: the number of channels of {c} isn't known")
                layers.append((vectors(df, c), channels, float(w)))
            if not layers:
                return self._notes(df, pairs, "no valid layers")
            found = cmd(layers, d.k or 5)
        all_ = df.sparkSession.createDataFrame(pairs, f"{PAIR[0]} string, {PAIR[1]} string")
        note = F.when(F.col("value").isNull(), F.lit("empty summaries"))
        return all_.join(found, list(PAIR), "left").select(*PAIR, F.lit(metric).alias("metric"), F.col("value").alias(metric), note.alias("note"))

    def _notes(self, df: DataFrame, pairs: list[tuple[str, str]], note: str) -> DataFrame:
        return df.sparkSession.createDataFrame([(s, t, self.config.distance.metric, note) for s, t in pairs], f"{PAIR[0]} string, {PAIR[1]} string, metric string, note string")
