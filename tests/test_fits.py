"""Fits of masks: tiles and windows give what whole images give."""

import random

import numpy as np
import pytest

from cartolith.operators import fits


def mask(spark, cells):
    return spark.createDataFrame(sorted(cells), "x int, y int")


def blob(rng, wide, high):
    cx, cy, r = wide / 2, high / 2, min(wide, high) / 2
    return {(x, y) for x in range(wide) for y in range(high) if (x - cx) ** 2 + (y - cy) ** 2 < (r * (0.7 + 0.3 * ((x * 7 + y * 3) % 5) / 5)) ** 2 or rng.random() < 0.05} | {(0, 0), (wide - 1, high - 1)}


@pytest.mark.parametrize(("low", "high", "step"), [(1.0, 2.0, 0.25), (0.4, 0.9, 0.1)])
def test_tiles_fit_as_whole_images_do(spark, monkeypatch, low, high, step):
    rng = random.Random(int(low * 10))
    local = {(x + 100, y - 30) for x, y in blob(rng, 23, 31)}
    scale = (low + high) / 2
    target = {(int(x * scale) + 5 + dx, int(y * scale) - 70 + dy) for x, y in local for dx in (0, 1) for dy in (0, 1)} | {(150, -60), (240, 40)}
    a, b = mask(spark, local), mask(spark, target)
    want = fits.best_fit(a, b, low, high, step, 3).first()
    for name, value in (("WHOLE", 10), ("COARSE", 150), ("SIDE", 16), ("TOGETHER", 7), ("SCALES", 3)):
        monkeypatch.setattr(fits, name, value)
    got = fits.best_fit(a, b, low, high, step, 3).first()
    assert tuple(got) == pytest.approx(tuple(want))
    assert want.iou > 0.5


def test_no_image_of_a_large_mask_is_made(spark, monkeypatch):
    monkeypatch.setattr(fits, "WHOLE", 1000)
    monkeypatch.setattr(fits, "image", lambda *of: pytest.fail("the mask was put together"))
    local = {(x, y) for x in range(200) for y in range(150) if (x // 40 + y // 30) % 2 == 0}
    row = fits.best_fit(mask(spark, local), mask(spark, {(x + 9, y + 4) for x, y in local}), 1.0, 1.0, 0.1, 12).first()
    assert tuple(row) == (1.0, 9.0, 4.0, 1.0)


def test_fits_of_odd_masks(spark):
    some, none = mask(spark, {(0, 0), (4, 4)}), spark.createDataFrame([], "x int, y int")
    with pytest.raises(ValueError, match="without cells"):
        fits.best_fit(none, some, 1.0, 1.0)
    with pytest.raises(ValueError, match="without cells"):
        fits.best_fit(some, none, 1.0, 1.0)
    assert fits.best_fit(some, mask(spark, {(0, 0)}), 1.0, 1.0).count() == 0
    twice = some.union(some)
    assert fits.best_fit(twice, some, 1.0, 1.0).first().iou == 1.0


def test_scaled_rows():
    assert fits.sources(3, 2.0).tolist() == [0, 0, 1, 1, 2, 2]
    assert fits.sources(5, 0.1).tolist() == [0]
    assert (np.diff(fits.sources(97, 1.37)) >= 0).all()
