"""Colours, sizes, light and small geometry, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class colours, the height ramp's ends, the default point colour, the background.
CLASS_COLORS = (
    (0.5, 0.5, 0.5), (0.7, 0.7, 0.7), (0.55, 0.27, 0.07), (0.0, 1.0, 0.0), (0.0, 0.8, 0.0), (0.0, 0.5, 0.0), (1.0, 0.0, 0.0), (0.4, 0.4, 0.4),
    (0.9, 0.9, 0.0), (0.0, 0.5, 1.0), (0.9, 0.8, 0.7), (0.8, 0.8, 0.8), (0.6, 0.6, 0.6), (0.5, 0.5, 0.5), (0.5, 0.5, 0.5), (0.5, 0.5, 0.5),
)
HEIGHT_LOW, HEIGHT_HIGH = (0.1, 0.3, 0.6), (0.2, 0.7, 1.0)
DEFAULT_RGB, BACKGROUND = (180, 180, 200), (0.13, 0.15, 0.18)


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def mix(a: float | Column, b: float | Column, t: Column) -> Column:
    a, b = (v if isinstance(v, Column) else F.lit(v) for v in (a, b))
    return a * (1 - t) + b * t


def smoothstep(lo: float, hi: float, v: Column) -> Column:
    t = clamp((v - lo) / (hi - lo), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def rgb(parts) -> Column:
    return F.struct(*[p.cast("double").alias(c) for p, c in zip(parts, "rgb", strict=True)])


def height_color(t: Column) -> Column:
    t = clamp(t, 0.0, 1.0)
    return rgb([mix(a, b, t) for a, b in zip(HEIGHT_LOW, HEIGHT_HIGH, strict=True)])


def intensity_color(v: Column, lo: Column, hi: Column) -> Column:
    t = clamp((v - lo) / F.greatest(hi - lo, F.lit(1e-6)), 0.0, 1.0)
    return rgb([t, t, t])


def class_color(c: Column) -> Column:
    """The palette by class; 15 stands for all above."""
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(color, "rgb", strict=True)]) for color in CLASS_COLORS])
    return F.get(table, F.least(c.cast("int"), F.lit(15)))


def byte_from_16(v: Column) -> Column:
    return F.least(F.lit(255), F.floor(v / 256)).cast("int")


def bytes_from_unit(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """Rows whose three parts are at most 1 are scaled by 255; all are clamped to 0..255; NaN becomes 128."""
    unit = (r <= 1) & (g <= 1) & (b <= 1)
    one = lambda v: F.when(F.isnan(v), 128.0).otherwise(clamp(F.when(unit, v * 255).otherwise(v), 0.0, 255.0))
    return tuple(F.floor(one(v)).cast("int") for v in (r, g, b))


def point_size_fixed(size: Column) -> Column:
    return clamp(size, 1.0, 50.0)


def point_size_iso(size: Column, spacing: float, zoom: float) -> Column:
    return clamp(F.lit(spacing if spacing > 0 else 1.0) * zoom * size * 0.5, 1.0, 12.0)


def point_size_persp(size: Column, view_dist: Column, spacing: float, height: int, fov: float) -> Column:
    factor = F.lit(0.5 * height / math.tan(math.radians(fov) / 2)) / F.greatest(view_dist, F.lit(0.1))
    return clamp(size * 0.5 * F.lit(spacing if spacing > 0 else 1.0) * factor, 1.0, 12.0)


def light_direction(azimuth_deg: Column, elevation_deg: Column) -> tuple[Column, Column, Column]:
    a, e = F.radians(azimuth_deg), F.radians(elevation_deg)
    return F.cos(e) * F.cos(a), F.cos(e) * F.sin(a), F.sin(e)


def hex_channels(code: Column) -> tuple[Column, Column, Column]:
    """#rrggbb to three parts of 0..1."""
    return tuple((F.conv(F.substring(code, 2 + 2 * k, 2), 16, 10).cast("int") / 255.0) for k in range(3))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, clamp(((px - ax) * dx + (py - ay) * dy) / n, 0.0, 1.0)).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def splat(u: Column, v: Column, soft: float = 0.1) -> Column:
    """Opacity of a disc at (u, v) in -1..1: 1 inside, falling to 0 at its edge."""
    d = F.sqrt(u * u + v * v)
    return F.when(d > 1, 0.0).otherwise(1 - smoothstep(1 - soft, 1.0, d))


def glow(u: Column, v: Column, strength: float) -> Column:
    """How opaque a glowing splat is at a place of its square (-1 to 1 on both axes): a narrow bell, and a wide one half as
    high times the strength; nothing outside the circle."""
    d2 = u * u + v * v
    return F.when(d2 > 1, F.lit(0.0)).otherwise(F.exp(-d2 * 3.0) + F.exp(-d2 * 1.5) * 0.5 * strength)


def glow_color(channel: Column, strength: float) -> Column:
    """A channel (0 to 1) moved towards a brighter one by three tenths of the strength."""
    t = 0.3 * strength
    return channel * (1 - t) + (channel * 1.3 + 0.1) * t
