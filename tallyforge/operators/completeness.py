"""Shares of values that are there (CMP-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.config import CompletenessConfig
from tallyforge.operators.base import KEYS, MetricProcessor
from tallyforge.registry import register


def present(df: DataFrame, column: str) -> Column:
    """Neither null nor, in a column of floating point, NaN."""
    c = F.col(f"`{column}`")
    return c.isNotNull() & ~F.isnan(c) if dict(df.dtypes)[column] in ("float", "double") else c.isNotNull()


@register("metrics", "completeness")
class Completeness(MetricProcessor):
    config_model = CompletenessConfig

    def columns(self, df: DataFrame) -> list[str]:
        if self.config.scope == "all_visible":
            return [c for c in df.columns if c not in KEYS]
        return super().columns(df)

    def partials(self, df: DataFrame) -> dict[str, Column]:
        """Sums that another aggregation over the same table can take along."""
        return {f"{c}_complete": F.count_if(present(df, c)) for c in self.columns(df)} | {"rows": F.count(F.lit(1))}

    def finish(self, counted: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
        rows = F.col(f"`{prefix}rows`")
        score = {c: F.when(rows > 0, F.col(f"`{prefix}{c}_complete`") / rows).otherwise(0.0) for c in columns}
        overall = reduce(Column.__add__, score.values()) / len(score) if score else F.lit(0.0)
        c = self.config
        out = {f"completeness_{k}": v for k, v in score.items()} if c.include_per_column else {}
        if c.include_overall:
            out["completeness_overall"] = overall
        if not columns:
            out = {f"_metadata_{self.name}": F.lit('{"error": "no columns"}')}
        elif c.include_metadata:
            scores = F.struct(*(v.alias(k) for k, v in score.items()))
            parts = (F.array(*map(F.lit, columns)).alias("columns_analyzed"), rows.alias("total_samples_per_column"), scores.alias("per_column_scores"), overall.alias("overall_score"))
            out[f"_metadata_{self.name}"] = F.to_json(F.struct(*parts))
        return counted.select(*KEYS, *(v.alias(k) for k, v in out.items()))

    def compute(self, df: DataFrame) -> DataFrame:
        counted = df.groupBy(*KEYS).agg(*(v.alias(k) for k, v in self.partials(df).items()))
        return self.finish(counted, self.columns(df))
