"""Scalar expressions on pixels, thresholds, directions and rectangles. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..conf import MARGINS


def js_round(c: Column) -> Column:
    """Half up, also below zero; Spark's round() goes away from zero."""
    return F.floor(c + F.lit(0.5))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def clamp01(c: Column) -> Column:
    return clamp(c, 0.0, 1.0)


def byte(c: Column) -> Column:
    """0..1 to 0..255."""
    return js_round(clamp01(c) * 255).cast("int")


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, or ``empty`` where b is 0."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(empty).cast("double"))


def luminance(r: str = "r", g: str = "g", b: str = "b") -> Column:
    """Relative luminance 0..1 in single precision."""
    return ((0.2126 * F.col(r) + 0.7152 * F.col(g) + 0.0722 * F.col(b)) / 255).cast("float")


def srgb_to_linear(v: Column) -> Column:
    c = v / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE Lab under D65."""
    x, y, z = (srgb_to_linear(v) for v in (r, g, b))
    rows = ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.0721750, 1.0), (0.0193339, 0.1191920, 0.9503041, 1.08883))
    f = []
    for p, q, s, white in rows:
        t = (x * p + y * q + z * s) / white
        f.append(F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0))
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def lab_planes(r: str = "r", g: str = "g", b: str = "b") -> tuple[Column, Column, Column]:
    """Fixed-point Lab: L times 2.55 in a byte, a and b doubled."""
    lum, a, c = lab(F.col(r).cast("double"), F.col(g).cast("double"), F.col(b).cast("double"))
    return clamp(js_round(lum * 2.55), 0, 255).cast("int"), js_round(a * 2).cast("int"), js_round(c * 2).cast("int")


def threshold(sensitivity: Column) -> Column:
    return F.lit(0.76) - sensitivity / 100.0 * 0.50


def normalized_weights(weights: dict[str, float]) -> dict[str, float]:
    total = max(1.0, float(sum(weights.values())))
    return {k: v / total for k, v in weights.items()}


def inside(margin: int, width: Column, height: Column) -> Column:
    x, y = F.col("x"), F.col("y")
    return (x >= margin) & (y >= margin) & (x < width - margin) & (y < height - margin)


def edge_aware_score(weights: dict[str, float], width: Column, height: Column, guard: int = 1) -> Column:
    """Weighted mean of the channels that exist at a pixel; 0 on the guarded frame. Channels without weight aren't read."""
    total, share = F.lit(0.0), F.lit(0.0)
    for name, w in normalized_weights(weights).items():
        if w > 0:
            there = inside(MARGINS[name], width, height)
            total = total + F.when(there, F.col(name) / 255.0 * w).otherwise(0.0)
            share = share + F.when(there, F.lit(w)).otherwise(0.0)
    return F.when(inside(guard, width, height) & (share > 0), total / share).otherwise(0.0)


def interior_score(weights: dict[str, float]) -> Column:
    """The plain weighted sum that local tuning uses."""
    out = F.lit(0.0)
    for name, w in normalized_weights(weights).items():
        out = out + F.col(name) / 255.0 * w
    return out


def axial_difference(a: Column, b: Column) -> Column:
    """Difference of two directions given as bytes of half a turn: 0 parallel, 1 at right angles."""
    return (1 - F.cos(2 * (a - b) / 255.0 * math.pi)) * 0.5


def tensor_bytes(xx: Column, yy: Column, xy: Column) -> tuple[Column, Column]:
    """Direction and coherence bytes of a structure tensor."""
    theta = 0.5 * F.atan2(2 * xy, xx - yy)
    theta = F.when(theta < 0, theta + math.pi).otherwise(theta)
    coherence = F.sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) / (xx + yy + 1e-8)
    return clamp(js_round(theta / math.pi * 255), 0, 255).cast("int"), clamp(js_round(F.least(coherence, F.lit(1.0)) * 255), 0, 255).cast("int")


def edge_sides(mask: Column) -> Column:
    return F.bit_count(mask)


def opposite_edges(mask: Column) -> Column:
    return (mask.bitwiseAND(5) == 5) | (mask.bitwiseAND(10) == 10)


def edge_bits(width: Column, height: Column) -> Column:
    """The frame sides that a pixel lies on: 1 left, 2 top, 4 right, 8 bottom."""
    x, y = F.col("x"), F.col("y")
    return F.when(x == 0, 1).otherwise(0) + F.when(y == 0, 2).otherwise(0) + F.when(x == width - 1, 4).otherwise(0) + F.when(y == height - 1, 8).otherwise(0)


def cell_of(at: str, size: Column, cells: int) -> Column:
    """The cell whose bounds floor(i * size / cells) hold a coordinate."""
    guess = F.floor(F.col(at) * cells / size)
    return F.when(F.floor((guess + 1) * size / cells) <= F.col(at), guess + 1).otherwise(guess).cast("int")


def balanced_score(recall: Column, leakage: Column, negatives: Column) -> Column:
    """Harmonic mean of recall and what doesn't leak; recall alone without negatives."""
    tight = 1 - leakage
    return F.when(negatives == 0, recall).when(recall + tight > 0, 2 * recall * tight / (recall + tight)).otherwise(0.0)


def primary_score(roi_f1: Column, recall: Column, leakage: Column) -> Column:
    return F.coalesce(roi_f1, 0.72 * recall + 0.28 * (1 - leakage))


def normalize_rect(x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """Corners in order, floored or ceiled outwards and clamped to the image."""
    return (
        clamp(F.floor(F.least(x0, x1)), 0, width - 1).cast("int"),
        clamp(F.floor(F.least(y0, y1)), 0, height - 1).cast("int"),
        clamp(F.ceil(F.greatest(x0, x1)), 0, width - 1).cast("int"),
        clamp(F.ceil(F.greatest(y0, y1)), 0, height - 1).cast("int"),
    )


def grid_place(cols: int, rows: int, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Where a pixel lies in a grid of cell centres: the cell up and left of it, and the shares of the way to the next ones."""
    gx = clamp(F.col("x") / F.greatest(F.lit(1), width - 1) * cols - 0.5, 0, cols - 1)
    gy = clamp(F.col("y") / F.greatest(F.lit(1), height - 1) * rows - 0.5, 0, rows - 1)
    return F.floor(gx).cast("int"), F.floor(gy).cast("int"), gx - F.floor(gx), gy - F.floor(gy)


def bilinear(v00: Column, v10: Column, v01: Column, v11: Column, sx: Column, sy: Column) -> Column:
    return (v00 * (1 - sx) + v10 * sx) * (1 - sy) + (v01 * (1 - sx) + v11 * sx) * sy


def local_mask(value: Column, sensitivity: Column, delta: Column) -> Column:
    """Whether the unrounded score reaches the local threshold."""
    return value >= threshold(clamp(sensitivity + delta, 1, 100))
