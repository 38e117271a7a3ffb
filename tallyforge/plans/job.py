"""From a configuration to DataFrames (API-3 to API-6).

Selections of all loaders are one table. Feature processors add columns to it in the order in which they need each
other; then each metric is an aggregation over all selections at once, and all completeness processors share one.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import registry
from tallyforge.config import ErrorsConfig, Interface, JobConfig, StorageConfig
from tallyforge.operators import completeness, diversity, embedding, gap, representativeness, visual  # noqa: F401  they register themselves
from tallyforge.operators.base import KEYS, FeatureProcessor, GapProcessor, MetricProcessor, Processor, held
from tallyforge.operators.completeness import Completeness
from tallyforge.operators.representativeness import Batch, Representativeness
from tallyforge.patterns import expand
from tallyforge.sources.readers import Loaded
from tallyforge.sources.sinks import ParquetSink, features_table, gap_table, metrics_table

log = logging.getLogger("tallyforge")


@dataclass
class JobResult:
    """What a job gives; None for an interface that isn't configured."""

    features: DataFrame | None = None
    metrics: DataFrame | None = None
    gap: DataFrame | None = None
    paths: dict[str, str] = field(default_factory=dict)


def ordered(processors: Sequence[FeatureProcessor], df: DataFrame) -> list[FeatureProcessor]:
    """A processor comes after those that generate what it reads; else they stay as they are configured."""
    made = {p.name: set(p.generated(df)) for p in processors}
    needs = {p.name: set(p.config.columns.input) for p in processors}
    out: list[FeatureProcessor] = []
    left = list(processors)
    while left:
        ready = [p for p in left if not any(set(expand(needs[p.name], sorted(made[q.name]))) & made[q.name] for q in left if q is not p)]
        nxt = (ready or left)[0]  # a ring is cut at its first
        out.append(nxt)
        left.remove(nxt)
    return out


def add_features(df: DataFrame, processors: Sequence[FeatureProcessor]) -> tuple[DataFrame, list[str]]:
    generated: list[str] = []
    for p in ordered(processors, df):
        names = p.generated(df)
        df = p.add(df)
        generated += [n for n in names if n not in generated]
    return df, generated


def checked(df: DataFrame, processors: Sequence[FeatureProcessor]) -> DataFrame:
    """The table with its features, computed once, after a look at the rates of failures."""
    if not processors:
        return df
    df = held(df)
    for p in processors:
        p.failures(df)
    return df


def compute_metrics(df: DataFrame, processors: Sequence[MetricProcessor], batch_size: int = 10_000, order: str | None = None, batches: Sequence[Batch] | None = None) -> DataFrame:
    """One row for each selection. ``batches``: first batches by loader, in place of ``batch_size`` and ``order`` for all."""
    shared = [p for p in processors if isinstance(p, Completeness)]
    tables: dict[str, DataFrame] = {}
    if shared:
        parts = {f"{p.name}/{k}": v for p in shared for k, v in p.partials(df).items()}
        counted = df.groupBy(*KEYS).agg(*(v.alias(k) for k, v in parts.items()))
        tables |= {p.name: p.finish(counted, p.columns(df), f"{p.name}/") for p in shared}
    for p in processors:
        if isinstance(p, Representativeness):
            tables[p.name] = p.compute(df, batch_size, order, batches)
        elif p.name not in tables:
            tables[p.name] = p.compute(df)
    found = [tables[p.name] for p in processors]
    if not found:
        return df.select(*KEYS).distinct()
    return reduce(lambda a, b: a.join(b.drop(*(set(a.columns) & set(b.columns) - set(KEYS))), list(KEYS), "full"), found)


def compute_gaps(df: DataFrame, processors: Sequence[GapProcessor]) -> DataFrame:
    """One row for each pair of selections and processor; columns that a processor lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.compute(df) for p in processors))


def make(group: str, interface: Interface | None, errors: ErrorsConfig | None, seed: int) -> list[Any]:
    if interface is None:
        return []
    own = (interface.errors or ErrorsConfig()).under(errors)
    if interface.compute is not None:
        log.warning("compute of %s is passed over: only that of the job counts", group)
    return [registry.get(group, p.type)(p, own, seed) for p in interface.processors]


def union(parts: Sequence[Loaded]) -> DataFrame:
    """One scan of each table; without the columns that only some loaders have there is nothing to fill up."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.df for p in parts))


def run(spark: SparkSession, config: JobConfig | dict[str, Any], write: bool = True) -> JobResult:
    c = config if isinstance(config, JobConfig) else JobConfig.model_validate(config)
    seed = c.compute.seed if c.compute else 42
    if c.compute:
        log.setLevel(c.compute.log_level.upper())
    loader_errors = (c.dataloaders.errors or ErrorsConfig()).under(c.errors)
    loaded: list[Loaded] = []
    for x in c.dataloaders.loaders:
        storage = x.storage or c.dataloaders.storage or c.storage
        loader = registry.get("loaders", x.type)
        part = loader.load(spark, x.model_copy(update={"storage": storage}), sum(len(p.names) for p in loaded), loader_errors)
        if part is not None:
            loaded.append(part)
    if not loaded:
        raise ValueError("no loader has a table")
    base = union(loaded)
    source = [n for n in base.columns if n not in KEYS]
    features, metrics, gaps = (make(g, getattr(c, g), c.errors, seed) for g in ("features", "metrics", "gap"))
    df, generated = add_features(base, features)
    df = checked(df, features)
    out = JobResult()
    if c.features is not None:
        o = c.features.outputs
        out.features = features_table(df, source, generated, o.include if o else None, o.exclude if o else None)
    if metrics:
        batches = [(p.names, p.config.batch_size, p.config.id_column) for p in loaded]
        out.metrics = metrics_table(compute_metrics(df, metrics, batches=batches))
    if gaps:
        out.gap = gap_table(compute_gaps(df, gaps), c.gap.outputs.pairwise if c.gap.outputs else True)
    if write:
        for name in ("features", "metrics", "gap"):
            interface, table = getattr(c, name), getattr(out, name)
            if table is not None and interface is not None and interface.outputs is not None:
                storage: StorageConfig | None = interface.storage or c.storage
                out.paths[name] = ParquetSink(spark, interface.outputs.path, storage).write(table, name)
    return out


def as_frame(spark: SparkSession, data: Any) -> DataFrame:
    """SRC-3: a DataFrame of Spark or pandas; arrays in cells become lists."""
    if isinstance(data, DataFrame):
        return data
    import numpy as np

    plain = data.copy()
    for name in plain.columns:
        if plain[name].map(lambda v: isinstance(v, np.ndarray)).any():
            plain[name] = plain[name].map(lambda v: v.tolist() if isinstance(v, np.ndarray) else v)
    return spark.createDataFrame(plain)


def tagged(df: DataFrame, name: str, ix: int = 0) -> DataFrame:
    return df.withColumns({KEYS[0]: F.lit(name), KEYS[1]: F.lit(ix)})


def profile(spark: SparkSession, data: Any, processors: Sequence[Processor], name: str = "data") -> dict[str, Any]:
    """API-5: all metrics of one table. ``features`` is the table with the generated columns."""
    df = as_frame(spark, data)
    if not processors or df.isEmpty():
        log.warning("no rows or no processors")
        return {}
    df = tagged(df, name)
    features = [p for p in processors if isinstance(p, FeatureProcessor)]
    for p in features:
        df = p.add(df)
    df = checked(df, features)
    out: dict[str, Any] = {"features": df.drop(*KEYS)} if features else {}
    metrics = [p for p in processors if isinstance(p, MetricProcessor)]
    if metrics:
        row = compute_metrics(df, metrics).first()
        out |= {k: v for k, v in row.asDict().items() if k not in KEYS}
    return out


def gap_between(spark: SparkSession, source: Any, target: Any, processor: GapProcessor, features: Sequence[FeatureProcessor] = (), names: tuple[str, str] = ("source", "target")) -> dict[str, Any]:
    """API-6."""
    sides = [as_frame(spark, source), as_frame(spark, target)]
    if any(d.isEmpty() for d in sides):
        return {}
    df = tagged(sides[0], names[0], 0).unionByName(tagged(sides[1], names[1], 1), allowMissingColumns=True)
    for p in features:
        df = p.add(df)
    row = processor.compute(checked(df, features)).first()
    return {} if row is None else row.asDict()
