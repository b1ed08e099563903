"""The boundary features: darkness, multi-scale ridge, directional colour and texture differences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import MARGINS, Params
from ..functions.pixel import lab_planes, luminance
from ..plans.tiles import View, tiled
from .windows import local_dark, local_features, tensor_orientation

#: The four sampled normals with their tangents and angles: across columns, diagonal, across rows, other diagonal.
DIRECTIONS = [((1, 0), (0, 1), 0.0), ((1, 1), (-1, 1), np.pi / 4), ((0, 1), (1, 0), np.pi / 2), ((-1, 1), (1, 1), 3 * np.pi / 4)]
SCALES, COLOR_AT, DENDRITE_AT = (1, 2, 4), (2, 4, 6), (5, 9, 13)


def unit_normals(direction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit normals of direction numbers."""
    n = np.array([d[0] for d in DIRECTIONS], float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    return n[direction, 0], n[direction, 1]


def ridge_kernel(planes: dict[str, np.ndarray], x0: int, y0: int, w: int, h: int) -> dict[str, np.ndarray]:
    """Dark lines: darker than both sides across, but not along. The first best direction and scale win."""
    luma = planes["luma"].astype(np.float32).astype(float)
    v = View(x0, y0, w, h, luma.shape)
    best, best_dir, best_scale, angle = (np.zeros(luma.shape) for _ in range(4))
    for si, radius in enumerate(SCALES):
        scores = []
        for (nx, ny), (tx, ty), _ in DIRECTIONS:
            reach = lambda dx, dy, radius=radius: radius * (np.sqrt(2) if dx and dy else 1)
            ends = []
            for dx, dy in ((nx, ny), (tx, ty)):
                r = reach(dx, dy)
                mean = (v.at(luma, v.x + dx * r, v.y + dy * r) + v.at(luma, v.x - dx * r, v.y - dy * r)) * 0.5
                ends.append(np.maximum(0, mean - luma))
            line = np.maximum(0, ends[0] - ends[1] * 0.68)
            scores.append(np.clip(line * (1 / np.sqrt(radius)) / 0.16, 0, 1))
        stack = np.stack(scores)
        top, where = stack.max(axis=0), stack.argmax(axis=0)
        weight = stack.astype(np.float32).astype(float) ** 2
        vx = sum(weight[i] * np.cos(2 * d[2]) for i, d in enumerate(DIRECTIONS))
        vy = sum(weight[i] * np.sin(2 * d[2]) for i, d in enumerate(DIRECTIONS))
        mean_angle = 0.5 * np.arctan2(vy, vx)
        mean_angle = np.where(mean_angle < 0, mean_angle + np.pi, mean_angle)
        mean_angle = np.where(np.hypot(vx, vy) > 1e-8, mean_angle, np.array([d[2] for d in DIRECTIONS])[where])
        better = top > best
        best, best_dir, best_scale = np.where(better, top, best), np.where(better, where, best_dir), np.where(better, si, best_scale)
        angle = np.where(better, mean_angle, angle)
    there = v.inside(max(SCALES) + 1)
    return {"ridge": np.where(there, np.floor(best * 255 + 0.5), 0).astype(np.int32), "orientation": np.where(there, best_dir, 0).astype(np.int32), "orientation_angle": np.where(there, angle, 0).astype(np.float32), "ridge_scale": np.where(there, best_scale, 0).astype(np.int32)}


def color_kernel(planes: dict[str, np.ndarray], x0: int, y0: int, w: int, h: int) -> dict[str, np.ndarray]:
    """Lab distance between the means of both sides of the normal."""
    v = View(x0, y0, w, h, planes["orientation"].shape)
    nx, ny = unit_normals(planes["orientation"].astype(int))
    delta = 0.0
    for name, scale in (("lab_l", 2.55), ("lab_a", 2.0), ("lab_b", 2.0)):
        p = planes[name].astype(float)
        sides = [sum(v.at(p, v.x + s * nx * d, v.y + s * ny * d) for d in COLOR_AT) for s in (1, -1)]
        delta = delta + ((sides[0] - sides[1]) / len(COLOR_AT) / scale) ** 2
    out = np.floor(np.clip(np.sqrt(delta) / 55, 0, 1) * 255 + 0.5)
    return {"color": np.where(v.inside(max(COLOR_AT) + 1), out, 0).astype(np.int32)}


def dendrite_kernel(planes: dict[str, np.ndarray], x0: int, y0: int, w: int, h: int) -> dict[str, np.ndarray]:
    """Change of texture direction and coherence across the normal, weighted by confidence."""
    v = View(x0, y0, w, h, planes["orientation"].shape)
    nx, ny = unit_normals(planes["orientation"].astype(int))
    o, c = planes["dendrite_orientation"].astype(float), planes["dendrite_coherence"].astype(float) / 255
    total, share = 0.0, 0.0
    for d in DENDRITE_AT:
        (oa, ca), (ob, cb) = ((v.at(o, v.x + s * nx * d, v.y + s * ny * d), v.at(c, v.x + s * nx * d, v.y + s * ny * d)) for s in (1, -1))
        confidence = np.sqrt(ca * cb)
        turn = (1 - np.cos(2 * (oa - ob) / 255 * np.pi)) * 0.5
        total = total + np.minimum(1, turn * confidence + np.abs(ca - cb) * 0.20) * (0.5 + confidence)
        share = share + 0.5 + confidence
    return {"dendrite": np.where(v.inside(max(DENDRITE_AT) + 1), np.floor(total / share * 255 + 0.5), 0).astype(np.int32)}


def ridge(px: DataFrame) -> DataFrame:
    """(key, w, h, luma) with ridge, orientation, orientation_angle and ridge_scale."""
    return tiled(px, ["luma"], {"ridge": "int", "orientation": "int", "orientation_angle": "float", "ridge_scale": "int"}, 7, ridge_kernel)


def feature_kernel(planes: dict[str, np.ndarray], x0: int, y0: int, w: int, h: int) -> dict[str, np.ndarray]:
    """Ridge, then colour and texture across the ridge's direction at each pixel: one tile for all three."""
    made = ridge_kernel(planes, x0, y0, w, h)
    both = planes | made
    return made | color_kernel(both, x0, y0, w, h) | dendrite_kernel(both, x0, y0, w, h)


def features(px: DataFrame, conf: Params | None = None) -> DataFrame:
    """The feature bundle of an RGB raster with w and h: dark, ridge, color, dendrite, orientation, orientation_angle, ridge_scale.

    Columns are carried along, so nothing is joined: windows (four exchanges), one pass over tiles, windows again (two).
    """
    conf = conf or Params()
    radius, strength = max(8, round(conf.local_window / 2)), conf.local_strength if conf.local_enabled else 0.0
    lum, a, b = lab_planes()
    key = ["image_id", "y", "x"]
    df = px.select(*key, "w", "h", luminance().alias("luma"), lum.alias("lab_l"), a.alias("lab_a"), b.alias("lab_b"))
    df = tensor_orientation(local_dark(df, F.col("luma"), "dark", radius, strength), "luma")
    made = {"ridge": "int", "orientation": "int", "orientation_angle": "float", "ridge_scale": "int", "color": "int", "dendrite": "int"}
    out = tiled(df, ["luma", "lab_l", "lab_a", "lab_b", "dendrite_orientation", "dendrite_coherence", "dark"], made, max(DENDRITE_AT) + 1, feature_kernel)
    if strength > 0:
        raw = out.withColumnsRenamed({"ridge": "_ridge", "color": "_color"})
        out = local_features(raw, {"ridge": ("_ridge", 0.45 * strength), "color": ("_color", strength)}, radius)
    return out.select(*key, "w", "h", *MARGINS, "orientation", "orientation_angle", "ridge_scale")
