"""Numbers for each picture of a column (IMG-*, ERR-1, ERR-2, ERR-4)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import nan

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.config import ErrorsConfig, ImageFeaturesConfig
from tallyforge.functions import images
from tallyforge.operators.base import FeatureProcessor
from tallyforge.registry import register

BATCH = 64


def load_files(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """A column of paths as bytes, opened by Spark's own reader. A missing file is null, or with ``strict`` an error (ERR-4)."""
    spark = df.sparkSession
    c = F.col(f"`{column}`")
    folders = [r[0] for r in df.select(F.regexp_replace(c, "/[^/]*$", "")).where(c.isNotNull()).distinct().collect()]  # one for each folder
    there = [f for f in folders if _exists(spark, f)]
    plain = F.regexp_replace(c, "^file:/*", "/")
    missing = F.raise_error(F.concat(F.lit("Path does not exist: "), c)) if strict else F.lit(None)
    if not there:
        return df.withColumn(column, F.when(c.isNotNull(), missing.cast("binary")))
    files = spark.read.format("binaryFile").load(there).select(F.regexp_replace("path", "^file:/*", "/").alias("__path"), F.col("content").alias("__content"))
    joined = df.join(files, plain == F.col("__path"), "left")
    found = F.when(c.isNotNull() & F.col("__path").isNull(), missing.cast("binary")).otherwise(F.col("__content"))
    return joined.withColumn(column, found).drop("__path", "__content")


def strict_files(errors: ErrorsConfig) -> bool:
    """Only where the policy of tables says so itself."""
    return errors.tabular is not None and errors.tabular.on_file_not_found == "fail_fast"


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


@register("features", "image_features")
class ImageFeatures(FeatureProcessor):
    config_model = ImageFeaturesConfig

    def columns(self, df: DataFrame) -> list[str]:
        return super().columns(df) if self.config.columns.input else [c for c in ("image_bytes",) if c in df.columns]

    def generated(self, df: DataFrame) -> list[str]:
        return [self.output_name(c, k) for c in self.columns(df) for k in images.NAMES]

    def add(self, df: DataFrame) -> DataFrame:
        """Four columns of float for each input column; NaN where a picture can't be read."""
        for column in self.columns(df):
            if dict(df.dtypes)[column] == "string":
                df = self._add(load_files(df.withColumn("__shown", F.col(f"`{column}`")), column, strict_files(self.errors)), column).withColumn(column, F.col("__shown")).drop("__shown")
            else:
                df = self._add(df, column)
        return df

    def failed(self, df: DataFrame) -> list[Column]:
        names = [self.output_name(c, images.NAMES[0]) for c in self.columns(df)]
        return [F.isnan(f"`{n}`") for n in names if n in df.columns]

    def _add(self, df: DataFrame, column: str) -> DataFrame:
        c, errors = self.config, self.errors
        names = [self.output_name(column, k) for k in images.NAMES]
        schema = T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(n, T.FloatType()) for n in names])
        df = df.select(*(F.col(f"`{f.name}`") for f in schema.fields[: -len(names)]))
        arrow = to_arrow_schema(schema)
        strict = {k: errors.policy(k) == "fail_fast" for k in ("on_decode_failure", "on_transform_error", "on_unsupported_format")}
        bins = c.histogram.bins if c.histogram else 256

        def one(value: object) -> tuple[float, float, float, float]:
            if value is None:
                return (nan,) * 4
            try:
                picture = images.decode(value) if isinstance(value, (bytes, bytearray)) else np.asarray(value, float)
            except images.Unsupported:
                if strict["on_unsupported_format"]:
                    raise
                return (nan,) * 4
            except Exception:
                if strict["on_decode_failure"]:
                    raise
                return (nan,) * 4
            try:
                g = images.gray(picture, c.grayscale and not isinstance(value, list), c.luminosity_weights)
                return images.features(g, normalize=c.normalize, kernel=c.laplacian_kernel, clip=c.clip_percentiles, bins=bins)
            except Exception:
                if strict["on_transform_error"]:
                    raise
                return (nan,) * 4

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, BATCH):
                    batch = whole.slice(at, BATCH)
                    values = np.array([one(v) for v in batch.column(column).to_pylist()], np.float32).reshape(-1, 4)
                    columns = [x.cast(f.type) for x, f in zip(batch.columns, arrow)] + [pa.array(values[:, i]) for i in range(4)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        return df.mapInArrow(run, schema)
