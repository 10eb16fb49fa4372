"""Blobs of six surfaces are no larger than published bounds, and keep to their error."""

import numpy as np
import pytest

from rasterloom.codec import bands, writing


def surface(name):
    """(values, mask, error bound). Sizes, coefficients and bounds of the published surfaces."""
    w, h = {"near-constant blocks": (64, 64), "few levels": (32, 32), "terraces": (128, 128), "masked depth": (256, 192)}.get(name, (48, 48))
    row, col = np.indices((h, w)).astype(float)
    wavy, mask, error = 20 + 3 * np.sin(col / 9) + 2 * np.cos(row / 7), None, 0.001
    if name == "near-constant blocks":
        values, error = 100.1234567 + 0.003 * ((7 * col + 13 * row) % 4) + 2 * (row // 8), 0.01
    elif name == "few levels":
        values, error = np.array([10.0, 13.0, 410.0])[((col + 2 * row) % 3).astype(int)] + 0.1, 0.5
    elif name == "centimetre grid":
        values = np.floor(100 * wavy + 0.5) / 100
    elif name == "smooth":
        values = wavy
    elif name == "terraces":
        values, error = 50.1234567 + 0.37 * (col // 16) + 0.23 * (row // 16), 0.01
    else:
        x, y = col / w, row / h
        values, error = 3 + 8 * np.sin(4 * x) * np.cos(3 * y) + 0.3 * np.floor(6 * y), 0.01
        mask, values = values >= 0.5, np.maximum(values, 0)
    return values.astype(np.float32).astype(float), mask, error


#: The published bounds, in bytes.
BOUNDS = {"near-constant blocks": 399, "few levels": 511, "centimetre grid": 2749, "smooth": 3403, "terraces": 399, "masked depth": 34523}


@pytest.mark.parametrize("name", BOUNDS)
def test_sizes(name):
    values, mask, error = surface(name)
    blob = writing.encode(values, "f32", mask, writing.Options(error))
    assert len(blob) <= BOUNDS[name] and len(blob) == writing.encoded_size(values, "f32", mask, writing.Options(error))
    back = bands.decode(blob).values[:, :, 0]
    ok = np.ones(values.shape, bool) if mask is None else mask
    assert np.abs(back - values)[ok].max() <= error * (1 + 1e-6) and (back[~ok] == 0).all()
