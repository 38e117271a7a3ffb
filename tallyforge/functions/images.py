"""Pictures as arrays, and four numbers for each (IMG-*): luminosity, contrast, blur, entropy.

``pixel_features`` is the same in Catalyst expressions, for gray pictures that a table holds as arrays of pixels.
PNG is decoded here; other formats need Pillow, where it is installed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from math import nan

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("luminosity", "contrast", "blur", "entropy")
# Weights of the usual gray picture (ITU-R 601-2 luma, in thousandths), and Laplacian kernels.
GRAY = (0.299, 0.587, 0.114)
LAPLACIAN = {
    "3x3": np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float),
    "5x5": np.array([[0, 0, 1, 0, 0], [0, 1, 2, 1, 0], [1, 2, -16, 2, 1], [0, 1, 2, 1, 0], [0, 0, 1, 0, 0]], float),
}


class Unsupported(ValueError):
    """No decoder for this format."""


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels (1, 3 or 4), 8 bits."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    try:
        from PIL import Image
    except ImportError:
        raise Unsupported("only PNG can be decoded without Pillow") from None
    import io

    with Image.open(io.BytesIO(data)) as im:
        out = np.asarray(im.convert("RGBA" if "A" in im.getbands() else "L" if im.mode in ("L", "1") else "RGB"))
    return out if out.ndim == 3 else out[:, :, None]


def _png(data: bytes) -> np.ndarray:
    at, packed, palette, clear = 8, [], None, None
    width = height = depth = kind = interlace = 0
    while at + 8 <= len(data):
        (size,), name = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if name == b"IHDR":
            width, height, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = np.frombuffer(body, np.uint8)
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            break
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if not channels or interlace or not width or not height:
        raise Unsupported("interlaced or unknown kind of PNG")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    step, line = max(1, channels * depth // 8), -(-width * channels * depth // 8)
    raw = raw[: height * (line + 1)].reshape(height, line + 1)
    rows = np.zeros((height, line), np.uint8)
    above = np.zeros(line, np.int64)
    for y in range(height):
        rows[y] = above = _unfiltered(int(raw[y, 0]), raw[y, 1:].astype(np.int64), above, step)
    if depth == 16:
        pixels = rows.reshape(height, width, channels, 2)[..., 0]
    elif depth == 8:
        pixels = rows.reshape(height, width, channels)
    else:
        bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
        pixels = (bits @ (1 << np.arange(depth - 1, -1, -1)))[..., None]
        if kind == 0:
            pixels = (pixels * 255 // ((1 << depth) - 1)).astype(np.uint8)
    if kind == 3:
        own = palette[pixels[..., 0]]
        return own if clear is None else np.dstack([own, np.append(clear, np.full(256 - len(clear), 255, np.uint8))[pixels[..., 0]]])
    return pixels[..., :1] if kind == 4 else pixels


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + above) & 255
    if kind == 1:
        grid = np.zeros(-(-len(line) // step) * step, np.int64)
        grid[: len(line)] = line
        return (np.cumsum(grid.reshape(-1, step), axis=0) & 255).reshape(-1)[: len(line)]
    out = line.copy()
    for i in range(len(out)):
        left = int(out[i - step]) if i >= step else 0
        up, corner = int(above[i]), int(above[i - step]) if i >= step else 0
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = left if a <= b and a <= c else up if b <= c else corner
        out[i] = (int(out[i]) + guess) & 255
    return out


def gray(image: np.ndarray, grayscale: bool = True, weights: tuple[float, float, float] | None = None) -> np.ndarray:
    """IMG-2, IMG-3: alpha is dropped; the usual gray picture is whole numbers, a weighted one isn't."""
    if image.ndim == 2:
        return image.astype(float)
    if image.shape[2] == 1:
        return image[:, :, 0].astype(float)
    rgb = image[:, :, :3].astype(float)
    if grayscale:
        return np.floor(rgb @ np.array(GRAY) + 0.5)
    return rgb @ np.array(weights or (0.2126, 0.7152, 0.0722))


def convolve(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Same size, zeros around; the kernels are symmetric."""
    r = kernel.shape[0] // 2
    padded = np.pad(image, r)
    h, w = image.shape
    return sum(kernel[i, j] * padded[i : i + h, j : j + w] for i in range(kernel.shape[0]) for j in range(kernel.shape[1]) if kernel[i, j])


def entropy(values: np.ndarray, bins: int, high: float) -> float:
    counts = np.histogram(values, bins, (0.0, high))[0]
    if not counts.sum():
        return nan
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log(p)).sum())


def features(plain: np.ndarray, *, normalize: bool = True, kernel: str = "3x3", clip: tuple[int, int] | None = None, bins: int = 256) -> tuple[float, float, float, float]:
    """IMG-4 to IMG-9 of a gray picture of 0 to 255."""
    g = plain.astype(float)
    if normalize:
        low, high = g.min(), g.max()
        g = ((g - low) / (high - low) if high > low else np.zeros_like(g)).astype(np.float32).astype(float)
    else:
        g = np.clip(g, 0, 255).astype(np.uint8).astype(float)
    if clip is not None:
        low, high = np.percentile(g, clip)
        if high > low:
            g = np.clip(g, low, high)
            g = (g - low) / (high - low) if normalize else g
    scale = 1.0 if normalize else 255.0
    blur = float(np.var(convolve(g, LAPLACIAN[kernel])))
    return float(g.mean()) / scale, float(g.std()) / scale, blur, entropy(g, bins if normalize else min(256, bins), scale)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not at each place where ``body`` has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def _variance(a: Column, n: Column) -> Column:
    return _let(_total(a) / n, lambda mean: F.aggregate(a, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean)) / n)


def pixel_features(pixels: Column, width: int, *, bins: int = 256, normalize: bool = True) -> dict[str, Column]:
    """For a column of arrays of pixels, row by row; the 3x3 kernel. ``normalize`` brings each picture to 0 to 1."""
    scale = 1.0 if normalize else 255.0
    plain = F.transform(pixels, lambda x: x.cast("double"))

    def scaled(body: Callable[[Column], Column]) -> Column:
        if not normalize:
            return _let(plain, body)
        share = lambda px, low, high: F.transform(px, lambda x: F.when(high > low, (x - low) / (high - low)).otherwise(0.0))
        return _let(plain, lambda px: _let(F.array_min(px), lambda low: _let(F.array_max(px), lambda high: _let(share(px, low, high), body))))

    def blur(px: Column) -> Column:
        side = lambda i, ok: F.when(ok, F.get(px, i)).otherwise(0.0)
        n = F.size(px)
        around = F.transform(px, lambda x, i: side(i - width, i >= width) + side(i + width, i + width < n) + side(i - 1, i % width > 0) + side(i + 1, i % width < width - 1) - 4 * x)
        return _let(around, lambda a: _variance(a, n))

    def entropy_of(px: Column) -> Column:
        n = F.size(px)
        place = F.transform(px, lambda x: F.least(F.lit(bins - 1), F.floor(x / F.lit(scale) * bins)))
        return _let(place, lambda b: -_total(F.transform(F.array_distinct(b), lambda v: _let(F.size(F.filter(b, lambda y: y == v)) / n, lambda p: p * F.log(p)))))

    return {
        "luminosity": scaled(lambda px: _total(px) / F.size(px) / scale),
        "contrast": scaled(lambda px: F.sqrt(_variance(px, F.size(px))) / scale),
        "blur": scaled(blur),
        "entropy": scaled(entropy_of),
    }
