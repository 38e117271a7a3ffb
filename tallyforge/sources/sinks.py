"""Parquet results (SNK-*)."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.config import StorageConfig
from tallyforge.patterns import select_names
from tallyforge.registry import register
from tallyforge.sources.readers import SELECTION, SELECTION_IX, apply_store, located


class Sink(Protocol):
    """SNK-7: ``table`` is features, metrics or gap."""

    def write(self, df: DataFrame, table: str) -> str: ...


@register("outputs", "parquet")
class ParquetSink:
    """SNK-1, SNK-2, SNK-6: a pattern with ``{}`` becomes a folder for each table, with a part for each selection; any other path one table in one file."""

    def __init__(self, spark: SparkSession, pattern: str, storage: StorageConfig | None = None) -> None:
        self.spark, self.pattern, self.storage = spark, pattern, storage

    def write(self, df: DataFrame, table: str) -> str:
        apply_store(self.spark, self.storage)
        path = located(self.pattern, self.storage)
        plain = df.select(*(F.col(f"`{c}`") for c, kind in df.dtypes if kind != "void"))
        if "{" in path:
            path = path.split("{")[0].rstrip("/_-") or "."
            path = f"{path}/{table}"
            writer = plain.write.mode("overwrite")
            (writer.partitionBy("dataloader") if "dataloader" in plain.columns else writer).parquet(path)
        else:
            (plain if table == "features" else plain.coalesce(1)).write.mode("overwrite").parquet(path)
        return path


def metrics_table(df: DataFrame) -> DataFrame:
    """SNK-3: one row for each selection, its name first; names that begin with __ and vectors stay out, lacking values are null."""
    keep = [c for c, kind in df.dtypes if c not in (SELECTION, SELECTION_IX) and not (c.startswith("__") and c.endswith("__")) and not kind.startswith("array")]
    order = [SELECTION_IX] if SELECTION_IX in df.columns else []
    return df.orderBy(*order).select(SELECTION, *(F.col(f"`{c}`") for c in keep))


def features_table(df: DataFrame, source: list[str], generated: list[str], include: list[str] | None, exclude: list[str] | None) -> DataFrame:
    """SNK-4: source columns by include and exclude, all generated ones, and the selection as ``dataloader``."""
    keep = [c for c in select_names(include, exclude, source) if c in source and c not in generated]
    return df.select(*(F.col(f"`{c}`") for c in [*keep, *generated]), F.col(SELECTION).alias("dataloader"))


def gap_table(df: DataFrame, pairwise: bool = True) -> DataFrame:
    """SNK-5."""
    return df.withColumn("source_target", F.concat_ws("_", "selection_source", "selection_target")) if pairwise else df
