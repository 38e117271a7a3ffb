"""How values fit a normal or uniform distribution (REP-*).

Two scans: one for the parameters where they aren't given, one that counts all columns of all selections into bins.
Bin edges and counts are small (selections x columns x bins) and go over the driver. The Kolmogorov-Smirnov distance
is exact on all values by default: values are ranked within ranges of values that Spark deals out, so no task sorts a
whole column.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from math import inf, nan

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.config import PLAIN_LABELS, DistributionParams, RepresentativenessConfig
from tallyforge.functions import stats
from tallyforge.operators.base import KEYS, MetricProcessor
from tallyforge.registry import register

Key = tuple[str, str]
#: Selections, and how many rows of each are its first batch, by which column.
Batch = tuple[list[str], int, str | None]


def numeric(df: DataFrame, column: str) -> Column:
    """REP-1: as a number; null where it isn't one. Infinities stay."""
    c = F.col(f"`{column}`").try_cast("double")
    return F.when(~F.isnan(c), c)


def edges_of(distribution: str, bins: int, p: dict[str, float], low: float, high: float, epsilon: float) -> np.ndarray:
    """REP-2, REP-3."""
    if distribution == "normal":
        return np.array([stats.normal_quantile(i / bins, p["mean"], p["std"]) for i in range(bins + 1)])
    low, high = min(p["min"], low), max(p["max"], high)
    return np.linspace(low, high if high > low else low + epsilon, bins + 1)


def expected_counts(distribution: str, method: str, edges: np.ndarray, p: dict[str, float], n: int, seed: int) -> np.ndarray:
    """REP-7, REP-8."""
    f = (lambda x: stats.normal_cdf(x, p["mean"], p["std"])) if distribution == "normal" else (lambda x: stats.uniform_cdf(x, p["min"], p["max"]))
    share = np.diff([f(e) for e in edges])
    if method == "monte_carlo":  # n draws fall into bins as one draw of counts: the same law, whatever n is
        share = np.maximum(share, 0.0)
        return np.random.default_rng(seed).multinomial(n, np.append(share, max(0.0, 1.0 - share.sum())) / max(1.0, share.sum()))[:-1].astype(float)
    return share * n


@register("metrics", "representativeness")
class Representativeness(MetricProcessor):
    config_model = RepresentativenessConfig

    def _given(self) -> dict[str, DistributionParams]:
        return {p.column: p for p in self.config.distribution_params or ()}

    def _long(self, df: DataFrame) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(c).alias("column"), numeric(df, c).alias("v")) for c in self.columns(df)))
        return df.select(*KEYS, F.explode(pairs).alias("p")).select(*KEYS, "p.column", "p.v").where("v is not null")

    def parameters(self, df: DataFrame, batch_size: int = 10_000, order: str | None = None, batches: Sequence[Batch] | None = None) -> tuple[dict[Key, dict[str, float]], dict[Key, dict]]:
        """REP-5, REP-6, REP-16: parameters for each selection and column, and what was counted over all values."""
        c, given = self.config, self._given()
        finite = F.abs("v") < F.lit(inf)
        aggregates = lambda ok: [F.avg(F.when(ok, F.col("v"))).alias("mean"), F.stddev_pop(F.when(ok, F.col("v"))).alias("std"), F.min(F.when(ok, F.col("v"))).alias("min"), F.max(F.when(ok, F.col("v"))).alias("max")]
        whole = self._long(df).groupBy("selection", "column").agg(*aggregates(finite), F.count("v").alias("n"))
        counted = {(r["selection"], r["column"]): r.asDict() for r in whole.collect()}  # a row for each selection and column
        source = counted
        if c.mean_std_estimation in ("from_first_batch", "per_batch"):
            parts = [(df.where(F.col("selection").isin(names)), n, by) for names, n, by in batches] if batches else [(df, batch_size, order)]
            first = reduce(DataFrame.union, (self._first_batch(*x) for x in parts))
            source = {(r["selection"], r["column"]): r.asDict() for r in self._long(first).groupBy("selection", "column").agg(*aggregates(finite)).collect()}
        out = {}
        for key, all_ in counted.items():
            row, own = source.get(key, all_), given.get(key[1])
            if c.mean_std_estimation == "user_provided":
                needed = ("mean", "std") if c.distribution == "normal" else ("min", "max")
                if own is None or any(getattr(own, k) is None for k in needed):
                    raise ValueError(f"{self.name}: {' and '.join(needed)} of {key[1]} aren't given")
            p = {k: (getattr(own, k) if own is not None and getattr(own, k) is not None else row.get(k)) for k in ("mean", "std", "min", "max")}
            p = {k: 0.0 if v is None else float(v) for k, v in p.items()}
            p["std"] = p["std"] if p["std"] > 0 else c.epsilon
            p["max"] = p["max"] if p["max"] > p["min"] else p["min"] + c.epsilon
            out[key] = p
        return out, counted

    def _first_batch(self, df: DataFrame, batch_size: int, order: str | None) -> DataFrame:
        """The first rows of each selection: by ``order``, or as they stand in the files."""
        by = [F.col(f"`{order}`")] if order else [F.col("__file"), F.col("__row")]
        if not order:
            try:
                df = df.withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
                df.schema  # noqa: B018  resolves the columns
            except Exception:  # a table that isn't read from files
                df = df.withColumns({"__file": F.lit(0), "__row": F.monotonically_increasing_id()})
        # Each partition gives at most batch_size rows of a selection before the rows of all meet.
        near = df.withColumn("__part", F.spark_partition_id())
        near = near.withColumn("__n", F.row_number().over(Window.partitionBy("selection", "__part").orderBy(*by))).where(F.col("__n") <= batch_size)
        return near.withColumn("__n", F.row_number().over(Window.partitionBy("selection").orderBy(*by))).where(F.col("__n") <= batch_size).drop("__n", "__part", "__file", "__row")

    def histograms(self, df: DataFrame, edges: dict[Key, np.ndarray]) -> dict[Key, np.ndarray]:
        """One scan; a count for each selection, column and bin."""
        out = {k: np.zeros(len(e) - 1) for k, e in edges.items()}
        table = [(s, c, [float(x) for x in e]) for (s, c), e in edges.items() if np.isfinite(e[1:-1]).all()]
        if table:
            known = df.sparkSession.createDataFrame(table, "selection string, column string, edges array<double>")
            rows = self._long(df).join(known, ["selection", "column"])  # a row for each selection and column: small ones Spark sends by itself
            v, e = F.col("v"), F.col("edges")
            inside = (v >= F.element_at(e, 1)) & (v <= F.element_at(e, -1))
            place = F.least(F.size(e) - 2, F.size(F.filter(e, lambda x: x <= v)) - 1)
            for r in rows.where(inside).groupBy("selection", "column", place.alias("b")).count().collect():  # at most a row for each bin
                out[r["selection"], r["column"]][r["b"]] = r["count"]
        return out

    def _sampled(self, rows: DataFrame) -> DataFrame:
        """REP-10: values of the least hashes. Each partition gives no more than a whole sample before they meet."""
        ks, by = self.config.ks, ["selection", "column"]
        size = F.least(F.lit(ks.sample_size), F.greatest(F.lit(ks.min_sample_size), (F.col("n") / ks.sample_divisor).cast("int")))
        sizes = rows.groupBy(*by).agg(F.count("v").alias("n")).select(*by, size.alias("__size"))
        near = rows.withColumns({"__h": F.xxhash64("v", F.monotonically_increasing_id(), F.lit(self.seed)), "__part": F.spark_partition_id()})
        near = near.withColumn("__rank", F.row_number().over(Window.partitionBy(*by, "__part").orderBy("__h"))).where(F.col("__rank") <= ks.sample_size)
        near = near.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy("__h"))).join(sizes, by)
        return near.where("__rank <= __size").select("selection", "column", "v")

    def distances(self, df: DataFrame, params: dict[Key, dict[str, float]], exact: bool) -> dict[Key, tuple[float, int]]:
        """REP-10, REP-11: the KS distance and the number of values of each selection and column."""
        rows = self._long(df)
        if not exact:
            rows = self._sampled(rows)
        spark = df.sparkSession
        if not params:
            return {}
        table = spark.createDataFrame([(s, c, *(p[k] for k in ("mean", "std", "min", "max"))) for (s, c), p in params.items()], "selection string, column string, mean double, std double, low double, high double")
        counts = rows.groupBy("selection", "column", "v").agg(F.count(F.lit(1)).alias("k"))
        # Ranks: a running sum within ranges of values, after the sums of the ranges before.
        part = counts.repartitionByRange(F.col("selection"), F.col("column"), F.col("v")).withColumn("__part", F.spark_partition_id())
        part = part.withColumn("upto", F.sum("k").over(Window.partitionBy("selection", "column", "__part").orderBy("v")))
        sums = part.groupBy("selection", "column", "__part").agg(F.sum("k").alias("s"))
        w = Window.partitionBy("selection", "column").orderBy("__part")
        sums = sums.withColumns({"before": F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("s").over(Window.partitionBy("selection", "column"))}).drop("s")
        part = part.join(sums, ["selection", "column", "__part"]).join(F.broadcast(table), ["selection", "column"])  # a row for each selection and column
        f = normal_cdf_column((F.col("v") - F.col("mean")) / F.col("std")) if self.config.distribution == "normal" else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))))
        after, below = F.col("before") + F.col("upto"), F.col("before") + F.col("upto") - F.col("k")
        d = F.greatest(after / F.col("n") - F.col("f"), F.col("f") - below / F.col("n"))
        found = part.withColumn("f", f).groupBy("selection", "column").agg(F.max(d).alias("d"), F.max("n").alias("n")).collect()
        return {(r["selection"], r["column"]): (r["d"], r["n"]) for r in found}

    def compute(self, df: DataFrame, batch_size: int = 10_000, order: str | None = None, batches: Sequence[Batch] | None = None) -> DataFrame:
        c = self.config
        labels = c.interpretation.model_dump() if c.interpretation else PLAIN_LABELS
        bins = c.histogram.bins if c.histogram else 10
        columns = self.columns(df)
        selections = [(r["selection"], r["selection_ix"]) for r in df.select(*KEYS).distinct().orderBy("selection_ix").collect()]
        params, counted = self.parameters(df, batch_size, order, batches) if columns else ({}, {})
        source = params
        edges = {k: edges_of(c.distribution, bins, source[k], *(v if v is not None else 0.0 for v in (counted[k]["min"], counted[k]["max"])), c.epsilon) for k in params}
        observed = self.histograms(df, edges) if {"chi-square", "grte"} & set(c.metrics) else {}
        if c.mean_std_estimation == "per_batch":  # edges are of the first batch, expectations of all values
            params = {k: p | {a: float(counted[k][a]) for a in p if counted[k][a] is not None and not self._explicit(k[1], a)} for k, p in params.items()}
            params = {k: p | {"std": p["std"] if p["std"] > 0 else c.epsilon} for k, p in params.items()}
        ks = {}
        if "kolmogorov-smirnov" in c.metrics:
            own = {k: self._ks_parameters(k, p, counted[k]) for k, p in params.items()}
            ks = self.distances(df, own, c.ks is None or c.ks.exact)
        rows = []
        for selection, ix in selections:
            out: dict[str, object] = {"selection": selection, "selection_ix": ix}
            total = 0
            for column in columns:
                key = (selection, column)
                if key not in params:
                    continue
                total += counted[key]["n"]
                out |= {f"{column}_{k}": v for k, v in self._results(edges[key], params[key], observed.get(key), ks.get(key), counted[key]["n"], labels).items()}
            if c.include_metadata:
                out[f"_metadata_{self.name}"] = json.dumps({"bins": bins, "distribution": c.distribution, "metrics_computed": list(c.metrics), "total_samples": total, "columns_analyzed": [x for x in columns if (selection, x) in params]})
            rows.append(out)
        return _table(df, rows)

    def _explicit(self, column: str, name: str) -> bool:
        own = self._given().get(column)
        return own is not None and getattr(own, name) is not None

    def _ks_parameters(self, key: Key, p: dict[str, float], counted: dict) -> dict[str, float]:
        """Given ones, else those of the values."""
        out = {k: p[k] if self._explicit(key[1], k) or counted[k] is None else float(counted[k]) for k in p}
        return out | {"std": out["std"] if out["std"] > 0 else self.config.epsilon, "max": out["max"] if out["max"] > out["min"] else out["min"] + self.config.epsilon}

    def _results(self, edges: np.ndarray, p: dict[str, float], observed: np.ndarray | None, ks: tuple[float, int] | None, n: int, labels: dict[str, str]) -> dict[str, object]:
        c = self.config
        inside = int(observed.sum()) if observed is not None else n
        expected = expected_counts(c.distribution, c.expected_counts_method, edges, p, inside or n, self.seed)
        out: dict[str, object] = {}
        if "chi-square" in c.metrics:
            out |= {f"chi-square_{k}": v for k, v in chi_square(observed, expected, c.alpha, labels).items()}
        if "kolmogorov-smirnov" in c.metrics and ks is not None:
            d, size = ks
            value = stats.kolmogorov_p(d, size)
            follows = labels["follows_distribution" if value >= c.alpha else "does_not_follow_distribution"]
            note = "exact_on_all_values" if c.ks is None or c.ks.exact else "approximated_from_random_samples"
            out |= {"kolmogorov-smirnov_p_value": value, "kolmogorov-smirnov_statistic": d, "kolmogorov-smirnov_interpretation": follows, "kolmogorov-smirnov_sample_size": size, "kolmogorov-smirnov_note": note}
        h = stats.entropy(expected)
        if "shannon-entropy" in c.metrics:
            limit = c.shannon.threshold if c.shannon else 2.0
            out |= {"shannon-entropy_entropy": h, "shannon-entropy_interpretation": labels["high_diversity" if h > limit else "low_diversity"]}
        if "grte" in c.metrics:
            limit, scale = (c.grte.threshold, c.grte.scaling_factor) if c.grte else (0.5, -2.0)
            value = float(np.exp(scale * abs(h - stats.entropy(observed))))
            out |= {"grte_grte_value": value, "grte_interpretation": labels["high_representativeness" if value > limit else "low_representativeness"]}
        return out


def chi_square(observed: np.ndarray, expected: np.ndarray, alpha: float, labels: dict[str, str]) -> dict[str, object]:
    """REP-9."""
    some = expected > 0
    observed, expected = observed[some], expected[some]
    if len(expected) < 2 or not observed.sum():
        return {"p_value": nan, "statistic": nan, "interpretation": "insufficient_bins"}
    expected = expected * observed.sum() / expected.sum()
    statistic = float(((observed - expected) ** 2 / expected).sum())
    p = stats.chi_square_p(statistic, len(expected) - 1)
    return {"p_value": p, "statistic": statistic, "interpretation": labels["follows_distribution" if p >= alpha else "does_not_follow_distribution"]}


def normal_cdf_column(z: Column) -> Column:
    """In the JVM: the series of Marsaglia (2004) near 0, Laplace's continued fraction in the tails; both to about 1e-13."""
    x = F.abs(z)
    near = F.lit(0.0)
    # phi(x) * (x + x^3/3 + x^5/15 + ...) by Horner's rule from the last term on
    for k in range(60, 0, -1):
        near = x * x / F.lit(float(2 * k + 1)) * (F.lit(1.0) + near)
    density = F.exp(-x * x / 2) / F.lit(float(np.sqrt(2 * np.pi)))
    tail = x
    for k in range(40, 0, -1):
        tail = x + F.lit(float(k)) / tail
    upper = F.when(x < 4.0, F.lit(0.5) - density * x * (F.lit(1.0) + near)).otherwise(density / tail)
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def _table(df: DataFrame, rows: list[dict[str, object]]) -> DataFrame:
    """Rows of one for each selection; null where a selection lacks a key."""
    names = list(dict.fromkeys(k for r in rows for k in r)) or list(KEYS)
    sql = {str: "string", float: "double", int: "bigint"}
    rows = [{k: v.item() if isinstance(v, np.generic) else v for k, v in r.items()} for r in rows]
    kinds = {k: next((type(r[k]) for r in rows if r.get(k) is not None), str) for k in names}
    schema = ", ".join(f"`{k}` {'int' if k == 'selection_ix' else sql[kinds[k]]}" for k in names)
    return df.sparkSession.createDataFrame([tuple(r.get(k) for k in names) for r in rows], schema)
