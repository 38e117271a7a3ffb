"""Diversity of the values of columns (DIV-*). Null is a category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.config import DiversityConfig
from tallyforge.operators.base import KEYS, MetricProcessor
from tallyforge.registry import register


def measures() -> dict[str, Column]:
    """Over rows of one count ``n`` for each category of a group."""
    n, total = F.col("n").cast("double"), F.sum("n").cast("double")
    return {
        "simpson": F.when(total > 1, 1 - F.sum(n * (n - 1)) / (total * (total - 1))).otherwise(0.0),
        "gini": 1 - F.sum(n * n) / (total * total),
        "shannon": F.greatest(F.lit(0.0), F.log(total) - F.sum(n * F.log(n)) / total),
        "richness": F.count(F.lit(1)),
    }


@register("metrics", "diversity")
class Diversity(MetricProcessor):
    config_model = DiversityConfig

    def counts(self, df: DataFrame) -> DataFrame:
        """DIV-0: a count for each selection, column and value. One scan for all columns; it shuffles a row for each value."""
        columns = self.columns(df)
        pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
        return df.select(*KEYS, F.explode(pairs).alias("p")).groupBy(*KEYS, "p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))

    def compute(self, df: DataFrame) -> DataFrame:
        columns = self.columns(df)
        if not columns:
            return df.select(*KEYS).distinct()
        chosen = {k: v for k, v in measures().items() if k in self.config.metrics}
        long = self.counts(df).groupBy(*KEYS, "column").agg(*(v.alias(k) for k, v in chosen.items()))
        wide = [F.max(F.when(F.col("column") == c, F.col(k))).alias(f"{c}_{k}") for c in columns for k in self.config.metrics]
        return long.groupBy(*KEYS).agg(*wide)
