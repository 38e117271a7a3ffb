"""Vectors for each picture of a column (EMB-*).

An encoder is made once in each worker, by the name of an architecture. ``projection`` is always there: a fixed random
projection of the resized picture, one for each layer asked for. Others register themselves, or are torchvision's
models where that is installed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.config import EmbeddingConfig, InferConfig, ModelConfig
from tallyforge.functions import images
from tallyforge.operators.base import FeatureProcessor
from tallyforge.operators.visual import load_files, strict_files
from tallyforge.registry import register

#: From layer to vectors and channels for a stack of pictures: (n, 3, height, width).
Encoder = Callable[[np.ndarray], dict[str, tuple[np.ndarray, int]]]
ENCODERS: dict[str, Callable[[ModelConfig, InferConfig], Encoder]] = {}
PROJECTED = 64


def encoder(name: str) -> Callable[[Callable[[ModelConfig, InferConfig], Encoder]], Callable[[ModelConfig, InferConfig], Encoder]]:
    def add(make: Callable[[ModelConfig, InferConfig], Encoder]) -> Callable[[ModelConfig, InferConfig], Encoder]:
        ENCODERS[name] = make
        return make

    return add


@encoder("projection")
def projection(model: ModelConfig, infer: InferConfig) -> Encoder:
    layers = model.n_layer_feature if isinstance(model.n_layer_feature, list) else ["projection"]
    size = 3 * infer.width * infer.height
    weights = {layer: np.random.default_rng(i).standard_normal((size, PROJECTED)).astype(np.float32) / np.sqrt(size) for i, layer in enumerate(layers)}
    return lambda x: {layer: (x.reshape(len(x), -1).astype(np.float32) @ w, PROJECTED) for layer, w in weights.items()}


def torch_encoder(model: ModelConfig, infer: InferConfig) -> Encoder:
    import torch
    from torchvision import models

    device = "cuda" if model.device != "cpu" and torch.cuda.is_available() else "cpu"
    net = models.get_model(model.arch, weights="DEFAULT").eval().to(device)
    from torchvision.models.feature_extraction import create_feature_extractor, get_graph_node_names

    nodes = get_graph_node_names(net)[1]
    layers = model.n_layer_feature if isinstance(model.n_layer_feature, list) else [nodes[model.n_layer_feature]]
    cut = create_feature_extractor(net, layers)

    def run(x: np.ndarray) -> dict[str, tuple[np.ndarray, int]]:
        with torch.no_grad():
            out = cut(torch.as_tensor(x, dtype=torch.float32, device=device))
        return {k: (v.flatten(1).cpu().numpy(), int(v.shape[1])) for k, v in out.items()}

    return run


def prepared(image: np.ndarray, infer: InferConfig) -> np.ndarray:
    """EMB-1: three channels, resized (bilinear), 0 to 1, normalised by channel."""
    rgb = np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image[:, :, :3]
    h, w = rgb.shape[:2]
    y = np.clip((np.arange(infer.height) + 0.5) * h / infer.height - 0.5, 0, h - 1)
    x = np.clip((np.arange(infer.width) + 0.5) * w / infer.width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    dy, dx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    f = rgb.astype(float)
    out = (f[y0][:, x0] * (1 - dx) + f[y0][:, x1] * dx) * (1 - dy) + (f[y1][:, x0] * (1 - dx) + f[y1][:, x1] * dx) * dy
    std = np.array([s or 1e-12 for s in infer.norm_std])
    return ((out / 255 - np.array(infer.norm_mean)) / std).transpose(2, 0, 1)


@register("features", "features_embeddings")
class Embeddings(FeatureProcessor):
    config_model = EmbeddingConfig
    _made: dict[str, Encoder] = {}

    def columns(self, df: DataFrame) -> list[str]:
        return super().columns(df) if self.config.columns.input else [c for c in ("image_bytes",) if c in df.columns]

    def keys(self) -> list[str]:
        layers = self.config.model.n_layer_feature
        if not isinstance(layers, list):
            return ["embedding"]
        return [k for layer in layers for k in (f"emb_{layer.replace('.', '_')}", f"emb_{layer.replace('.', '_')}_channels")]

    def generated(self, df: DataFrame) -> list[str]:
        return [self.output_name(c, k) for c in self.columns(df) for k in self.keys()]

    def encoder(self) -> Encoder:
        """EMB-5: one for each worker process."""
        key = self.config.model_dump_json()
        if key not in self._made:
            make = ENCODERS.get(self.config.model.arch, torch_encoder)
            self._made[key] = make(self.config.model, self.config.infer)
        return self._made[key]

    def failed(self, df: DataFrame) -> list[Column]:
        """A vector of zeros stands for a picture that couldn't be read."""
        first = [self.output_name(c, self.keys()[0]) for c in self.columns(df)]
        return [F.forall(f"`{n}`", lambda x: x == 0) for n in first if n in df.columns]

    def add(self, df: DataFrame) -> DataFrame:
        for column in self.columns(df):
            if dict(df.dtypes)[column] == "string":
                df = self._add(load_files(df.withColumn("__shown", F.col(f"`{column}`")), column, strict_files(self.errors)), column).withColumn(column, F.col("__shown")).drop("__shown")
            else:
                df = self._add(df, column)
        return df

    def _add(self, df: DataFrame, column: str) -> DataFrame:
        """EMB-4: a picture that can't be read has a vector of zeros."""
        layers = self.config.model.n_layer_feature
        names = [self.output_name(column, k) for k in self.keys()]
        kinds = [T.IntegerType() if k.endswith("_channels") else T.ArrayType(T.FloatType()) for k in self.keys()]
        schema = T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(n, k) for n, k in zip(names, kinds)])
        df = df.select(*(F.col(f"`{f.name}`") for f in schema.fields[: -len(names)]))
        arrow, config, errors = to_arrow_schema(schema), self.config, self.errors
        strict, strict_format = errors.policy("on_decode_failure") == "fail_fast", errors.policy("on_unsupported_format") == "fail_fast"
        owner = self

        def picture(value: bytes | None) -> np.ndarray | None:
            if value is None:
                return None
            try:
                return prepared(images.decode(value), config.infer)
            except images.Unsupported:
                if strict_format:
                    raise
            except Exception:
                if strict:
                    raise
            return None

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = owner.encoder()
            for whole in batches:
                for at in range(0, whole.num_rows, config.infer.batch_size):
                    batch = whole.slice(at, config.infer.batch_size)
                    pictures = [picture(v) for v in batch.column(column).to_pylist()]
                    blank = np.zeros((3, config.infer.height, config.infer.width))
                    found = encode(np.stack([blank if p is None else p for p in pictures]))
                    columns = [x.cast(f.type) for x, f in zip(batch.columns, arrow)]
                    for layer in layers if isinstance(layers, list) else list(found)[:1]:
                        vectors, channels = found[layer]
                        vectors = np.where(np.array([p is not None for p in pictures])[:, None], vectors, 0).astype(np.float32)
                        columns.append(pa.array(list(vectors), pa.list_(pa.float32())))
                        if isinstance(layers, list):
                            columns.append(pa.array(np.full(len(pictures), channels, np.int32)))
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

        return df.mapInArrow(run, schema)
