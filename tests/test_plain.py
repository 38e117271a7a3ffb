"""Names, configuration, statistics, pictures: without Spark."""

import math
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pydantic import ValidationError

from tallyforge import config as C
from tallyforge.functions import images, stats
from tallyforge.operators.representativeness import chi_square, edges_of, expected_counts
from tallyforge.patterns import expand, has_pattern, java_regex, select_names


def test_patterns():
    assert has_pattern("a*") and has_pattern("[x]") and not has_pattern("a.b") and not has_pattern(True) and not has_pattern(3)
    assert expand(["b", "a*", "b"], ["a1", "a2", "c"]) == ["b", "a1", "a2"]
    assert select_names(None, ["a?"], ["a1", "b", "ab"]) == ["b"]
    assert select_names([], ["b"], ["a", "b"]) == ["a"]


@given(st.text(alphabet="ab*?[]!-.x", max_size=8), st.text(alphabet="abx.-]!", max_size=6))
def test_java_regex_is_fnmatch(pattern, name):
    import fnmatch

    try:
        own = re.compile(java_regex(pattern))
    except re.error:
        return  # a range that ends before it begins
    if re.search(r"\[[^\]]*-", pattern):
        return
    assert bool(own.match(name)) == fnmatch.fnmatchcase(name, pattern)


def test_config_is_strict():
    with pytest.raises(ValidationError):
        C.JobConfig.model_validate({"dataloaders": {"loaders": []}, "other": 1})
    with pytest.raises(ValidationError):
        C.StorageConfig(type="s3")
    with pytest.raises(ValidationError):
        C.DomainGapConfig.model_validate({"name": "g", "columns": {"input": ["a", "b"]}, "distance": {"metric": "cmd", "feature_weights": [1.0]}})
    assert C.FilterConfig(column="a", values=[True]).values == [True]
    assert C.ColumnsConfig.model_validate(C.ColumnsConfig.model_validate({"rename": [{"from": "a", "to": "b"}]}).model_dump()).rename[0].from_ == "a"
    assert C.memory_bytes("4Gi") == 4 << 30 and C.memory_bytes("512MB") == 512 << 20 and C.memory_bytes(7) == 7
    assert C.ImageFeaturesConfig(name="v", luminosity_weights="BT.601").luminosity_weights == (0.299, 0.587, 0.114)


def test_errors_merge_copies():
    outer = C.ErrorsConfig(max_failure_rate=0.5, tabular=C.TabularErrorsConfig(on_missing_column="silent_fail"))
    own = C.ErrorsConfig(default="fail_fast").under(outer)
    assert (own.default, own.max_failure_rate, own.policy("on_missing_column")) == ("fail_fast", 0.5, "silent_fail")
    assert outer.default == "silent_fail" and own.policy("on_decode_failure") == "fail_fast"


def test_stats():
    assert stats.chi_square_p(3.841458820694124, 1) == pytest.approx(0.05)
    assert stats.chi_square_p(20, 9) == pytest.approx(0.0179124, abs=1e-6)
    assert stats.kolmogorov_p(0.274, 10) == pytest.approx(1 - 0.62847961, abs=1e-6)
    assert stats.kolmogorov_p(1.0, 5) == 0 and stats.kolmogorov_p(0.0, 5) == 1
    assert stats.kolmogorov_p(0.04, 1000) == pytest.approx(stats.kolmogorov_p(0.04, 1000, exact_to=10), abs=0.01)
    assert stats.normal_cdf(1.959963985) == pytest.approx(0.975)
    assert stats.entropy(np.full(10, 3)) == pytest.approx(math.log(10))
    a = np.array([[2.0, 0.3], [0.3, 1.0]])
    assert stats.root_trace(a, a) == pytest.approx(3.0)


def test_bins():
    assert edges_of("normal", 4, {"mean": 0.0, "std": 1.0}, 0, 0, 1e-9)[2] == pytest.approx(0)
    assert list(edges_of("uniform", 2, {"min": 0.0, "max": 4.0}, 1.0, 3.0, 1e-9)) == [0, 2, 4]
    e = edges_of("normal", 10, {"mean": 5.0, "std": 2.0}, 0, 0, 1e-9)
    assert expected_counts("normal", "cdf", e, {"mean": 5.0, "std": 2.0}, 1000, 1) == pytest.approx(np.full(10, 100.0))
    assert expected_counts("normal", "monte_carlo", e, {"mean": 5.0, "std": 2.0}, 1000, 1).sum() == 1000
    labels = C.PLAIN_LABELS
    assert chi_square(np.array([5.0]), np.array([5.0]), 0.05, labels)["interpretation"] == "insufficient_bins"
    assert chi_square(np.array([50.0, 50]), np.array([1.0, 1]), 0.05, labels)["interpretation"] == "follows_distribution"


def png(pixels: np.ndarray, kind: int, filters: list[int]) -> bytes:
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    h, w = pixels.shape[:2]
    step = pixels.shape[2]
    rows, above = [], np.zeros(w * step, int)
    for y in range(h):
        line = pixels[y].reshape(-1).astype(int)
        left = np.concatenate([np.zeros(step, int), line[:-step]])
        corner = np.concatenate([np.zeros(step, int), above[:-step]])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        guess = {0: 0, 1: left, 2: above, 3: (left + above) // 2, 4: np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))}[filters[y % len(filters)]]
        rows.append(bytes([filters[y % len(filters)]]) + ((line - guess) & 255).astype(np.uint8).tobytes())
        above = line
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("channels", "kind"), [(1, 0), (3, 2), (4, 6)])
def test_png_round_trip(channels, kind):
    pixels = np.random.default_rng(3).integers(0, 256, (11, 7, channels)).astype(np.uint8)
    assert (images.decode(png(pixels, kind, [0, 1, 2, 3, 4])) == pixels).all()
    with pytest.raises(images.Unsupported):
        images.decode(b"GIF89a")


def test_features_of_a_constant_picture():
    values = images.features(np.full((5, 5), 9.0))
    assert values[:2] == (0.0, 0.0) and values[3] == 0.0
    assert images.features(np.full((5, 5), 255.0), normalize=False)[0] == pytest.approx(1.0)
    assert images.gray(np.full((1, 1, 4), 100)).item() == 100
