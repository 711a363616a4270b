import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytemill.functions import kernels
from bytemill.schema import FEATURES


def one(data: bytes) -> dict:
    return dict(zip(FEATURES, kernels.features(pa.array([data], pa.binary()))[0].tolist(), strict=True))


def test_golden_values():
    assert one(b"xy" * 500)["entropy"] == pytest.approx(1) and one(b"z" * 99)["entropy"] == 0.0
    every = one(bytes(range(256)) * 4)
    assert every["entropy"] == pytest.approx(8) and every["printable_ratio"] == 98 / 256 and every["byte_mean"] == 127.5 and every["byte_variance"] == 5461.25
    assert kernels.share(kernels.counts(*kernels.flat(pa.array([bytes(range(256))]))), kernels.HEX_DIGITS)[0] == 22 / 256
    assert math.copysign(1, one(b"z")["entropy"]) == 1
    empty = one(b"")
    assert empty["length"] == 0 and all(v == 0 for v in empty.values())
    assert len(FEATURES) == 271


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=80), min_size=1, max_size=6))
def test_features_equal_their_definitions(values):
    for data, row in zip(values, kernels.features(pa.array(values, pa.binary())), strict=True):
        f, n, c = dict(zip(FEATURES, row.tolist(), strict=True)), len(data), Counter(data)
        assert f["length"] == n
        if n:
            assert f["entropy"] == pytest.approx(-sum(k / n * math.log2(k / n) for k in c.values()), abs=1e-9)
            assert f["byte_mean"] == pytest.approx(np.mean(list(data))) and f["byte_variance"] == pytest.approx(np.var(list(data)), abs=1e-9)
            assert sum(f[f"hist_{i}"] for i in range(256)) == pytest.approx(1)
        top = sorted(Counter(zip(data, data[1:], strict=False)).values(), reverse=True)[:10]
        assert [f[f"bigram_top{i}"] for i in range(10)] == pytest.approx([k / (n - 1) for k in top] + [0] * (10 - len(top)))
