"""The configuration of a job: a strict tree of models (unknown keys are errors)."""

from __future__ import annotations

from enum import StrEnum
from typing import Annotated, Any, Literal

from pydantic import BaseModel, ConfigDict, Field, field_validator, model_validator

Policy = Literal["silent_fail", "fail_fast"]


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid", populate_by_name=True)


# Storage, computing, errors


class RetryConfig(Strict):
    mode: Literal["default", "standard"] = "standard"
    max_attempts: int = Field(3, gt=0)


class StorageConfig(Strict):
    type: Literal["s3", "local"]
    bucket: str | None = None
    access_key: str | None = None
    secret_key: str | None = None
    session_token: str | None = None
    anonymous: bool = False
    role_arn: str | None = None
    session_name: str | None = None
    external_id: str | None = None
    load_frequency: int = Field(900, gt=0)
    region: str | None = None
    endpoint: str | None = None
    request_timeout: float | None = None
    connect_timeout: float | None = None
    scheme: str | None = None
    proxy_options: dict[str, Any] | str | None = None
    tls_ca_file_path: str | None = None
    retry: RetryConfig | None = None
    checksum_validation: Literal["when_required", "always", "never"] = "when_required"

    @model_validator(mode="after")
    def _bucket(self) -> StorageConfig:
        if self.type == "s3" and not self.bucket:
            raise ValueError("storage of type s3 needs a bucket")
        return self


class ComputeConfig(Strict):
    seed: int = 42
    log_level: Literal["debug", "info", "warning", "error"] = "warning"
    max_memory: str | int | None = None
    device: Literal["auto", "cpu", "cuda"] = "auto"
    progress_bar: bool = True
    threads: int = Field(4, gt=0)

    @field_validator("max_memory")
    @classmethod
    def _size(cls, v: str | int | None) -> str | int | None:
        if v is not None:
            memory_bytes(v)
        return v


def memory_bytes(size: str | int) -> int:
    """Bytes of 512, "512MB", "4Gi" and the like. Spark sizes its own memory; the value is only checked."""
    s = str(size).strip().lower()
    digits = s.rstrip("bgikmt")
    unit = s[len(digits) :]
    scale = {"": 1, "b": 1, "k": 10, "kb": 10, "ki": 10, "kib": 10, "m": 20, "mb": 20, "mi": 20, "mib": 20, "g": 30, "gb": 30, "gi": 30, "gib": 30, "t": 40, "tb": 40, "ti": 40, "tib": 40}
    if unit not in scale:
        raise ValueError(f"not a size of memory: {size}")
    return int(float(digits) * (1 if scale[unit] == 1 else 2 ** scale[unit]))


class ImageErrorsConfig(Strict):
    on_decode_failure: Policy = "silent_fail"
    on_transform_error: Policy = "silent_fail"
    on_unsupported_format: Policy = "fail_fast"


class TabularErrorsConfig(Strict):
    on_missing_column: Policy = "fail_fast"
    on_file_not_found: Policy = "fail_fast"


class ErrorsConfig(Strict):
    default: Policy = "silent_fail"
    images: ImageErrorsConfig | None = None
    tabular: TabularErrorsConfig | None = None
    max_failure_rate: float = Field(0.05, ge=0, le=1)

    def policy(self, name: str) -> Policy:
        """That of the group, or the default."""
        for group in (self.images, self.tabular):
            if group is not None and hasattr(group, name):
                return getattr(group, name)
        return self.default

    def under(self, outer: ErrorsConfig | None) -> ErrorsConfig:
        """A copy in which what isn't set here comes from ``outer``."""
        if outer is None:
            return self.model_copy(deep=True)

        def merged(a: dict, b: dict) -> dict:
            return a | {k: merged(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

        return ErrorsConfig.model_validate(merged(outer.model_dump(exclude_unset=True), self.model_dump(exclude_unset=True)))


# Where data comes from


class FilterConfig(Strict):
    column: str
    values: list[bool | int | float | str]

    @field_validator("values", mode="before")
    @classmethod
    def _list(cls, v: Any) -> Any:
        return v if isinstance(v, list) else [v]


class SamplePathConfig(Strict):
    column: str
    prefix: str | None = None


class SplitConfig(Strict):
    by: str
    values: list[str] | None = None
    exclude: list[str] | None = None


class TransformType(StrEnum):
    INT32 = "int32"
    INT64 = "int64"
    FLOAT32 = "float32"
    FLOAT64 = "float64"
    BOOL = "bool"
    STRING = "string"
    CATEGORICAL = "categorical"

    @classmethod
    def _missing_(cls, value: object) -> TransformType | None:
        return cls.STRING if value in ("str", "utf8") else None


class TransformConfig(Strict):
    column: str
    to_type: TransformType
    in_place: bool = False


class DataLoaderConfig(Strict):
    name: str
    type: str = "parquet"
    path: str
    id_column: str | None = None
    batch_size: int = Field(10_000, gt=0)
    filters: list[FilterConfig] | None = None
    sample_path: list[SamplePathConfig] | None = None
    split: SplitConfig | None = None
    transform: list[TransformConfig] | None = None
    storage: StorageConfig | None = None


class DataLoadersConfig(Strict):
    storage: StorageConfig | None = None
    errors: ErrorsConfig | None = None
    loaders: list[DataLoaderConfig]


# Processors


class ColumnRename(Strict):
    from_: str = Field(alias="from")
    to: str


class ColumnsConfig(Strict):
    input: list[str] = []
    exclude: list[str] | None = None
    rename: list[ColumnRename] | None = None
    prefix: str = ""
    suffix: str = ""


class Processor(Strict):
    name: str
    columns: ColumnsConfig = ColumnsConfig()


class HistogramConfig(Strict):
    bins: int = Field(256, gt=0)


# Weights of red, green and blue in the standards.
LUMINOSITY_STANDARDS = {"bt601": (0.299, 0.587, 0.114), "bt709": (0.2126, 0.7152, 0.0722), "bt2020": (0.2627, 0.6780, 0.0593)}


class ImageFeaturesConfig(Processor):
    type: Literal["image_features"] = "image_features"
    features: list[str] = ["luminosity", "contrast", "blur", "entropy"]
    batch_size: int = Field(64, gt=0)
    grayscale: bool = True
    normalize: bool = True
    laplacian_kernel: Literal["3x3", "5x5"] = "3x3"
    clip_percentiles: tuple[int, int] | None = None
    histogram: HistogramConfig | None = None
    luminosity_weights: str | tuple[float, float, float] | None = None

    @field_validator("luminosity_weights")
    @classmethod
    def _weights(cls, v: Any) -> Any:
        if isinstance(v, str):
            key = v.lower().replace(".", "").replace("-", "")
            if key not in LUMINOSITY_STANDARDS:
                raise ValueError(f"unknown luminosity standard {v!r}")
            return LUMINOSITY_STANDARDS[key]
        return v


class ModelConfig(Strict):
    arch: str = "resnet18"
    n_layer_feature: int | list[str] = -2
    device: Literal["auto", "cpu", "cuda"] = "auto"


class InferConfig(Strict):
    batch_size: int = Field(32, gt=0)
    width: int = Field(224, gt=0)
    height: int = Field(224, gt=0)
    norm_mean: list[float] = [0.485, 0.456, 0.406]
    norm_std: list[float] = [0.229, 0.224, 0.225]


class EmbeddingConfig(Processor):
    type: Literal["features_embeddings"] = "features_embeddings"
    model: ModelConfig = ModelConfig()
    infer: InferConfig = InferConfig()


class CompletenessConfig(Processor):
    type: Literal["completeness"] = "completeness"
    include_per_column: bool = True
    include_overall: bool = True
    include_metadata: bool = False
    scope: Literal["configured", "all_visible"] = "configured"


class InterpretationConfig(Strict):
    follows_distribution: str = "fits target"
    does_not_follow_distribution: str = "diverges from target"
    high_diversity: str = "varied"
    low_diversity: str = "uniform"
    high_representativeness: str = "representative"
    low_representativeness: str = "under-represented"


#: Without an ``interpretation`` block a label is its own key.
PLAIN_LABELS = {k: k for k in InterpretationConfig.model_fields}


class BinsConfig(Strict):
    bins: int = Field(10, gt=0)


class ShannonConfig(Strict):
    threshold: float = 2.0


class GrteConfig(Strict):
    threshold: float = 0.5
    scaling_factor: float = -2.0


class KsConfig(Strict):
    sample_size: int = Field(500, gt=0)
    min_sample_size: int = Field(50, gt=0)
    sample_divisor: int = Field(20, gt=0)
    exact: bool = True
    """On all values; else on a sample of the size that the others give."""


class DistributionParams(Strict):
    column: str
    mean: float | None = None
    std: float | None = None
    min: float | None = None
    max: float | None = None


class RepresentativenessConfig(Processor):
    type: Literal["representativeness"] = "representativeness"
    metrics: list[Literal["chi-square", "grte", "kolmogorov-smirnov", "shannon-entropy"]] = ["chi-square", "grte", "kolmogorov-smirnov", "shannon-entropy"]
    alpha: float = 0.05
    epsilon: float = 1e-9
    distribution: Literal["normal", "uniform"] = "normal"
    mean_std_estimation: Literal["from_first_batch", "per_batch", "from_all_data", "user_provided"] = "from_first_batch"
    expected_counts_method: Literal["cdf", "monte_carlo"] = "cdf"
    distribution_params: list[DistributionParams] | None = None
    interpretation: InterpretationConfig | None = None
    histogram: BinsConfig | None = None
    shannon: ShannonConfig | None = None
    grte: GrteConfig | None = None
    ks: KsConfig | None = None
    include_metadata: bool = True


class DiversityConfig(Processor):
    type: Literal["diversity"] = "diversity"
    metrics: list[Literal["simpson", "gini", "shannon", "richness"]] = ["simpson", "gini", "shannon", "richness"]


class KernelParams(Strict):
    gamma: float = 1.0
    degree: float = 3.0
    coefficient0: float = 1.0


class DistanceConfig(Strict):
    metric: str
    evaluator: str | None = None
    k: int | None = None
    feature_weights: list[float] | None = None
    kernel_params: KernelParams | None = None
    epsilon: float = 1e-6
    klmvn_var_eps: float = 0.0


class HistogramSummaryConfig(Strict):
    dims: int = Field(64, gt=0)
    bins: int = Field(32, gt=0)
    range: list[float] = [-3.0, 3.0]


class SummaryConfig(Strict):
    collect_sum_outer: bool | None = None
    store_embeddings: bool | None = None
    histogram: HistogramSummaryConfig | None = None
    channels: dict[str, int] | None = None
    """For cmd: the number of channels of an embedding column, where no ``<column>_channels`` is there."""


class DomainGapConfig(Processor):
    type: Literal["domain_gap"] = "domain_gap"
    columns: ColumnsConfig
    distance: DistanceConfig
    summary: SummaryConfig | None = None

    @model_validator(mode="after")
    def _weights(self) -> DomainGapConfig:
        weights = self.distance.feature_weights
        if weights is not None and not any(c in p for p in self.columns.input for c in "*?[") and len(weights) != len(self.columns.input):
            raise ValueError(f"{len(weights)} feature_weights for {len(self.columns.input)} columns")
        return self


ProcessorConfig = Annotated[ImageFeaturesConfig | EmbeddingConfig | CompletenessConfig | RepresentativenessConfig | DiversityConfig | DomainGapConfig, Field(discriminator="type")]


# Where results go


class ParquetOutputConfig(Strict):
    path_pattern: str
    columns: list[str] = []
    exclude: list[str] = []
    storage: bool | dict[str, Any] | None = None


class FeaturesOutputs(Strict):
    path: str
    include: list[str] | None = None
    exclude: list[str] | None = None


class MetricsOutputs(Strict):
    path: str


class GapOutputs(Strict):
    path: str
    pairwise: bool = True


class Interface(Strict):
    storage: StorageConfig | None = None
    compute: ComputeConfig | None = None
    errors: ErrorsConfig | None = None
    processors: list[ProcessorConfig] = []


class FeaturesInterface(Interface):
    outputs: FeaturesOutputs | None = None


class MetricsInterface(Interface):
    outputs: MetricsOutputs | None = None


class GapInterface(Interface):
    outputs: GapOutputs | None = None


class JobConfig(Strict):
    storage: StorageConfig | None = None
    compute: ComputeConfig | None = None
    errors: ErrorsConfig | None = None
    dataloaders: DataLoadersConfig
    features: FeaturesInterface | None = None
    metrics: MetricsInterface | None = None
    gap: GapInterface | None = None
