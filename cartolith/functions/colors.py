"""Pixel predicates and colour arithmetic as Columns; channels are integers from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rgb = tuple[int, int, int]
#: The colours that masks reserve.
OCEAN: Rgb = (0, 0, 0)
UNCLAIMED: Rgb = (128, 128, 128)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def check_colors(ocean: Rgb = OCEAN, unclaimed: Rgb = UNCLAIMED) -> None:
    if tuple(ocean) == tuple(unclaimed):
        raise ValueError("ocean and unclaimed colours must differ")


def is_color(color: Rgb, r="r", g="g", b="b") -> Column:
    return (_c(r) == color[0]) & (_c(g) == color[1]) & (_c(b) == color[2])


def is_ocean(ocean: Rgb = OCEAN, alpha_minimum: int = 1, a="a") -> Column:
    return (_c(a) < alpha_minimum) | is_color(ocean)


def is_unclaimed(unclaimed: Rgb = UNCLAIMED, alpha_minimum: int = 1, a="a") -> Column:
    return (_c(a) >= alpha_minimum) & is_color(unclaimed)


def is_country(ocean: Rgb = OCEAN, unclaimed: Rgb = UNCLAIMED, alpha_minimum: int = 1) -> Column:
    return ~(is_ocean(ocean, alpha_minimum) | is_unclaimed(unclaimed, alpha_minimum))


def is_unknown_land(land="land", ocean: Rgb = OCEAN, alpha_minimum: int = 1) -> Column:
    return _c(land) & is_ocean(ocean, alpha_minimum)


def mask_states(land="land", ocean: Rgb = OCEAN, unclaimed: Rgb = UNCLAIMED, alpha_minimum: int = 1) -> dict[str, Column]:
    """Six booleans of a pixel. `ocean` overlaps the two states outside land, so they are no partition."""
    check_colors(ocean, unclaimed)
    on, country, free = _c(land), is_country(ocean, unclaimed, alpha_minimum), is_unclaimed(unclaimed, alpha_minimum)
    return {
        "ocean": ~on,
        "country": on & country,
        "unclaimed": on & free,
        "unknown_land": is_unknown_land(on, ocean, alpha_minimum),
        "country_outside_land": ~on & country,
        "unclaimed_outside_land": ~on & free,
    }


def land_by_threshold(gray="gray", threshold: int = 128) -> Column:
    return (_c(gray) >= threshold).cast("int")


def land_by_red_minus_blue(threshold: int, r="r", b="b") -> Column:
    return _c(r).cast("int") - _c(b).cast("int") > threshold


def chebyshev(color: Rgb, r="r", g="g", b="b") -> Column:
    return F.greatest(F.abs(_c(r) - color[0]), F.abs(_c(g) - color[1]), F.abs(_c(b) - color[2]))


def squared_distance(color: Rgb, r="r", g="g", b="b") -> Column:
    return sum(((_c(c) - v) * (_c(c) - v) for c, v in zip((r, g, b), color, strict=True)), F.lit(0))


def nearer_of(first: Rgb, second: Rgb, cutoff: int = 3200) -> Column:
    """1 or 2 for the nearer colour (ties: the first), 0 where neither is within the cutoff."""
    d1, d2 = squared_distance(first), squared_distance(second)
    return F.when(F.least(d1, d2) > cutoff, 0).when(d1 <= d2, 1).otherwise(2)


def is_teal_boundary(r="r", g="g", b="b") -> Column:
    """Drawn inner boundaries: dark teal, green and blue both above red and near each other."""
    r, g, b = _c(r), _c(g), _c(b)
    return (r < 120) & (g > r + 18) & (b > r + 18) & (F.abs(g - b) < 45) & (g < 190) & (b < 190) & (r + g + b > 60)


def is_river(r="r", g="g", b="b") -> Column:
    return (_c(b) > _c(r) + 16) & (_c(g) > _c(r) + 10)


def luma(r="r", g="g", b="b") -> Column:
    return 0.299 * _c(r) + 0.587 * _c(g) + 0.114 * _c(b)


def is_border_pixel(threshold: float, exclude_rivers: bool = True) -> Column:
    dark = luma() < threshold
    return dark & ~is_river() if exclude_rivers else dark


def hex_color(r="r", g="g", b="b") -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(_c(c).cast("long")), 2, "0")) for c in (r, g, b)))


def rgb_key(r="r", g="g", b="b") -> Column:
    return F.concat_ws(",", *(_c(c).cast("string") for c in (r, g, b)))


def parse_rgb_key(key: Column) -> Column:
    return F.transform(F.split(key, ","), lambda v: v.cast("int"))


def categorical_hue(index: Column) -> Column:
    """Hue (0 to 180) of the index-th of many colours, by the golden angle."""
    turned = index * 137.508
    return turned - F.floor(turned / 180) * 180


def preview_color(labelled: Column, border: Column, channel: Column) -> Column:
    """A channel of a preview: dimmed, tinted where labelled, white on borders."""
    dim = F.floor(channel * 0.72)
    return F.when(border, 255).when(labelled, F.floor(dim * 0.78 + 205 * 0.22)).otherwise(dim).cast("int")
