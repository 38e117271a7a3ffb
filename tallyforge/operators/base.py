"""What a processor is (EXT-1 to EXT-4).

A processor never touches rows: it gives Catalyst expressions or DataFrames, over a table that holds all selections.
"""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.config import ErrorsConfig, Processor as Config
from tallyforge.patterns import select_names
from tallyforge.sources.readers import SELECTION, SELECTION_IX

KEYS = (SELECTION, SELECTION_IX)
log = logging.getLogger("tallyforge")


def held(df: DataFrame) -> DataFrame:
    """The table, computed once: written where ``spark.checkpoint.dir`` says, or else kept by Spark, which makes lost parts anew."""
    if df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return df.checkpoint()
    return df.persist()


class MissingColumn(KeyError):
    pass


class Processor(ABC):
    """EXT-1."""

    config_model: ClassVar[type[Config]]

    def __init__(self, config: Config | dict[str, Any], errors: ErrorsConfig | None = None, seed: int = 42) -> None:
        self.config = self.config_model.model_validate(config) if isinstance(config, dict) else config
        self.errors, self.seed = errors or ErrorsConfig(), seed

    @property
    def name(self) -> str:
        return self.config.name

    def columns(self, df: DataFrame) -> list[str]:
        """The input columns that ``df`` has; ERR-3 for those that it lacks."""
        available = [c for c in df.columns if c not in KEYS]
        names = select_names(self.config.columns.input, self.config.columns.exclude, available)
        missing = [c for c in names if c not in available]
        if missing:
            if self.errors.policy("on_missing_column") == "fail_fast":
                raise MissingColumn(f"{self.name}: no column {', '.join(missing)}")
            log.warning("%s: no column %s; passed over", self.name, ", ".join(missing))
        return [c for c in names if c in available]

    def check_rate(self, failures: int, rows: int) -> None:
        """ERR-2."""
        if rows and failures / rows > self.errors.max_failure_rate:
            raise RuntimeError(f"{self.name}: {failures} of {rows} failed, more than {self.errors.max_failure_rate:.2%}")


class FeatureProcessor(Processor):
    """EXT-2: adds columns."""

    @abstractmethod
    def generated(self, df: DataFrame) -> list[str]: ...

    @abstractmethod
    def add(self, df: DataFrame) -> DataFrame: ...

    def failed(self, df: DataFrame) -> list[Column]:
        """For each input column: is this row's value one that couldn't be made?"""
        return []

    def failures(self, df: DataFrame) -> tuple[int, int]:
        """How many rows of ``df``, which has the generated columns, have nothing, of how many; raises beyond the rate that is allowed (ERR-2)."""
        bad = self.failed(df)
        if not bad:
            return 0, 0
        row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(f"bad{i}") for i, c in enumerate(bad))).first()
        most = max(row[1:])
        self.check_rate(most, row["n"])
        return most, row["n"]

    def output_name(self, column: str, key: str) -> str:
        """PRJ-3."""
        c = self.config.columns
        name = f"{c.prefix}{column}_{key}{c.suffix}"
        return next((r.to for r in c.rename or () if r.from_ in (name, f"{column}_{key}", key)), name)


class MetricProcessor(Processor):
    """EXT-3: one row for each selection."""

    @abstractmethod
    def compute(self, df: DataFrame) -> DataFrame:
        """selection, selection_ix and the metrics; metadata as ``_metadata_<name>``."""


class GapProcessor(Processor):
    """EXT-4: one row for each pair of selections, the earlier one first."""

    @abstractmethod
    def compute(self, df: DataFrame) -> DataFrame:
        """selection_source, selection_target, metric and what else there is."""
