"""Tables, filters, casts and selections (SRC-*, FLT-*, PRJ-*, SEL-*).

All selections of a loader are one DataFrame with the columns ``selection`` and ``selection_ix``, so that a file is
read once however many values it is split by, and all metrics of all selections are one aggregation.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.config import DataLoaderConfig, ErrorsConfig, FilterConfig, SplitConfig, StorageConfig, TransformConfig
from tallyforge.patterns import expand, has_pattern, java_regex, select_names
from tallyforge.registry import register

SELECTION, SELECTION_IX = "selection", "selection_ix"
KEYS_NAMES = (SELECTION, SELECTION_IX)
SPARK_TYPES = {"int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "bool": "boolean", "string": "string", "categorical": "string"}


def located(path: str, storage: StorageConfig | None) -> str:
    """SRC-5: the path in the bucket, for a store of objects."""
    if storage is None or storage.type != "s3" or "://" in path:
        return path
    path = path.lstrip("/")
    bucket = storage.bucket.strip("/")
    return f"s3a://{path}" if path.startswith(f"{bucket}/") else f"s3a://{bucket}/{path}"


def store_options(storage: StorageConfig | None) -> dict[str, str]:
    """SRC-4: Hadoop's settings for a store; keys that aren't set are looked for in the environment."""
    if storage is None or storage.type != "s3":
        return {}
    env = os.environ.get
    key, secret, token = storage.access_key or env("AWS_ACCESS_KEY_ID"), storage.secret_key or env("AWS_SECRET_ACCESS_KEY"), storage.session_token or env("AWS_SESSION_TOKEN")
    providers = "org.apache.hadoop.fs.s3a."
    pairs: dict[str, object] = {
        "access.key": key,
        "secret.key": secret,
        "session.token": token,
        "endpoint": storage.endpoint or env("AWS_ENDPOINT_URL"),
        "endpoint.region": storage.region or env("AWS_DEFAULT_REGION"),
        "assumed.role.arn": storage.role_arn,
        "assumed.role.session.name": storage.session_name,
        "assumed.role.external.id": storage.external_id,
        "assumed.role.session.duration": f"{max(900, storage.load_frequency)}s" if storage.role_arn else None,
        "connection.request.timeout": None if storage.request_timeout is None else f"{storage.request_timeout:g}s",
        "connection.timeout": None if storage.connect_timeout is None else f"{storage.connect_timeout:g}s",
        "connection.ssl.enabled": None if storage.scheme is None else str(storage.scheme == "https").lower(),
        "attempts.maximum": None if storage.retry is None else storage.retry.max_attempts,
        "checksum.validation": {"always": "true", "never": "false"}.get(storage.checksum_validation),
    }
    if isinstance(storage.proxy_options, dict):
        pairs |= {f"proxy.{k}": storage.proxy_options.get(k) for k in ("host", "port", "username", "password")}
    if storage.anonymous:
        pairs["aws.credentials.provider"] = providers + "AnonymousAWSCredentialsProvider"
    elif storage.role_arn:
        pairs["aws.credentials.provider"] = providers + "auth.AssumedRoleCredentialProvider"
    elif token:
        pairs["aws.credentials.provider"] = providers + "TemporaryAWSCredentialsProvider"
    return {f"fs.s3a.{k}": str(v) for k, v in pairs.items() if v is not None}


def apply_store(spark: SparkSession, storage: StorageConfig | None) -> None:
    conf = spark._jsc.hadoopConfiguration()
    for k, v in store_options(storage).items():
        conf.set(k, v)


def read(spark: SparkSession, config: DataLoaderConfig, errors: ErrorsConfig | None = None) -> DataFrame | None:
    """SRC-1, SRC-2. None for a missing file under a silent policy."""
    apply_store(spark, config.storage)
    path = located(config.path, config.storage)
    try:
        if config.type == "csv":
            return spark.read.csv(path, header=True, inferSchema=True, nanValue="nan", enforceSchema=False)
        return spark.read.parquet(path)
    except AnalysisException as e:
        if errors is not None and errors.tabular is not None and errors.policy("on_file_not_found") == "silent_fail" and "PATH_NOT_FOUND" in str(e):
            return None
        raise


def row_count(df: DataFrame) -> int:
    """SRC-6."""
    return df.count()


def predicate(f: FilterConfig, schema: dict[str, str]) -> Column:
    """FLT-1 to FLT-3: one value, a list, or wildcards. Nulls never pass."""
    c = F.col(f"`{f.column}`")
    if any(has_pattern(v) for v in f.values):
        text = c.cast("string")
        return reduce(Column.__or__, (text.rlike(java_regex(v)) if has_pattern(v) else text == F.lit(str(v)) for v in f.values))
    values = [_typed(v, schema[f.column]) for v in f.values]
    return c == F.lit(values[0]) if len(values) == 1 else c.isin(values)


def _typed(v: object, kind: str) -> object:
    if kind == "string" and not isinstance(v, str):
        return str(v).lower() if isinstance(v, bool) else str(v)
    return v


def filtered(df: DataFrame, filters: list[FilterConfig] | None, but: str | None = None) -> DataFrame:
    """FLT-4: all filters; that on the column ``but`` gives way to a split."""
    schema = dict(df.dtypes)
    conditions = [predicate(f, schema) for f in filters or () if f.column != but]
    return df.where(reduce(Column.__and__, conditions)) if conditions else df


def cast(df: DataFrame, transforms: list[TransformConfig] | None) -> DataFrame:
    """PRJ-2. Absent columns are passed over; a value that doesn't fit is an error (ANSI)."""
    for t in transforms or ():
        if t.column in df.columns:
            df = df.withColumn(t.column if t.in_place else f"{t.column}_{t.to_type.value}", F.col(f"`{t.column}`").cast(SPARK_TYPES[t.to_type.value]))
    return df


def with_prefixes(df: DataFrame, config: DataLoaderConfig) -> DataFrame:
    """PRJ-4: relative paths below their folder."""
    for s in config.sample_path or ():
        if s.prefix and s.column in df.columns:
            c = F.col(f"`{s.column}`")
            df = df.withColumn(s.column, F.when(c.startswith("/") | c.contains("://"), c).otherwise(F.concat_ws("/", F.lit(s.prefix.rstrip("/")), c)))
    return df


def split_values(df: DataFrame, split: SplitConfig) -> list[str]:
    """SEL-3, SEL-4: the values in their order: of the patterns, and within each ascending."""
    literal = split.values is not None and not any(map(has_pattern, split.values))
    if literal:
        found = list(dict.fromkeys(split.values))
    else:
        text = F.col(f"`{split.by}`").cast("string")
        rows = df.select(text.alias("v")).where("v is not null").distinct().orderBy("v").collect()  # one row for each selection
        found = [r["v"] for r in rows]
        if split.values is not None:
            found = [v for v in expand(split.values, found) if v in set(found) or not has_pattern(v)]
    return select_names(found, split.exclude, found) if split.exclude else found


@dataclass
class Loaded:
    """The selections of a loader, in order, and their rows."""

    name: str
    names: list[str]
    df: DataFrame
    config: DataLoaderConfig | None = None


def load(spark: SparkSession, config: DataLoaderConfig, first_ix: int = 0, errors: ErrorsConfig | None = None, df: DataFrame | None = None) -> Loaded | None:
    """SEL-1, SEL-2: the rows of a loader with their selection."""
    if df is None:
        df = read(spark, config, errors)
    if df is None:
        return None
    if config.split is None:
        rows = cast(filtered(df, config.filters), config.transform)
        names = [config.name]
        rows = rows.withColumns({SELECTION: F.lit(config.name), SELECTION_IX: F.lit(first_ix)})
    else:
        base = filtered(df, config.filters, config.split.by)
        values = split_values(base, config.split)
        names = [f"{config.name}_{v}" for v in values]
        text = F.col(f"`{config.split.by}`").cast("string")
        ix = F.array_position(F.array(*map(F.lit, values)), text) - 1 if values else F.lit(-1)
        rows = base.where(text.isin(values)).withColumns({SELECTION: F.concat(F.lit(config.name + "_"), text), SELECTION_IX: (ix + first_ix).cast("int")})
        rows = cast(rows, config.transform)
    return Loaded(config.name, names, with_prefixes(rows, config), config)


class TableLoader:
    """EXT-6: what a loader is; others register a class of this form."""

    def __init__(self, kind: str) -> None:
        self.kind = kind

    def load(self, spark: SparkSession, config: DataLoaderConfig, first_ix: int = 0, errors: ErrorsConfig | None = None) -> Loaded | None:
        return load(spark, config, first_ix, errors)


for _kind in ("parquet", "csv"):
    register("loaders", _kind)(TableLoader(_kind))
