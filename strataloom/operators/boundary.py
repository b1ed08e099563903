"""From features to the boundary mask: score, threshold, non-maximum suppression, support, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import MARGINS, Params
from ..functions.pixel import bilinear, edge_aware_score, grid_place, local_mask
from ..plans.tiles import View, tiled
from .components import min_component

EPSILON = 1e-7
PLATEAU = 8


def with_delta(feat: DataFrame, grid: DataFrame, out: str = "delta", cols: int = 4, rows: int = 4) -> DataFrame:
    """feat with the image's own calibration interpolated at each pixel. grid (image_id, rx, ry, value); a cell without a value counts as 0.

    The grid becomes a row for each cell with its four corners, which pixels join by image and cell: ``cols * rows`` rows an image, so that
    Spark can broadcast them or split what is skewed.
    """
    cells = grid.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("ry") * cols + F.col("rx")).alias("k"), F.col("value").cast("double").alias("v")))).alias("m"))
    value = lambda x, y: F.coalesce(F.col("m")[F.least(y, F.lit(rows - 1)) * cols + F.least(x, F.lit(cols - 1))], F.lit(0.0))
    k = F.col("k")
    ix, iy = (k % cols).cast("int"), F.floor(k / cols).cast("int")
    corners = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(cols * rows - 1)))).select("image_id", ix.alias("_ix"), iy.alias("_iy"), value(ix, iy).alias("_v00"), value(ix + 1, iy).alias("_v10"), value(ix, iy + 1).alias("_v01"), value(ix + 1, iy + 1).alias("_v11"))
    x0, y0, sx, sy = grid_place(cols, rows, F.col("w"), F.col("h"))
    df = feat.withColumns({"_ix": x0, "_iy": y0, "_sx": sx, "_sy": sy}).join(corners, ["image_id", "_ix", "_iy"], "left")
    delta = bilinear(*(F.coalesce(c, F.lit(0.0)) for c in ("_v00", "_v10", "_v01", "_v11")), F.col("_sx"), F.col("_sy"))
    return df.withColumn(out, delta).drop("_ix", "_iy", "_sx", "_sy", "_v00", "_v10", "_v01", "_v11")


def candidates(feat: DataFrame, conf: Params, calibration: DataFrame | None = None) -> DataFrame:
    """feat with the single-precision ``score`` and the candidate mask ``cand``; the threshold sees the unrounded score. calibration: a grid for each image, as of with_delta()."""
    delta = F.lit(0.0)
    if calibration is not None:
        feat, delta = with_delta(feat, calibration, "_delta"), F.col("_delta")
    df = feat.withColumn("_v", edge_aware_score(conf.weights(), F.col("w"), F.col("h"), conf.frame_guard))
    framed = (F.col("x") >= conf.frame_guard) & (F.col("y") >= conf.frame_guard) & (F.col("x") < F.col("w") - conf.frame_guard) & (F.col("y") < F.col("h") - conf.frame_guard)
    return df.withColumns({"score": F.col("_v").cast("float"), "cand": (framed & local_mask(F.col("_v"), F.lit(conf.sensitivity), delta)).cast("int")}).drop("_v", "_delta")


def nms_kernel(planes: dict[str, np.ndarray], x0: int, y0: int, w: int, h: int) -> dict[str, np.ndarray]:
    """Maxima along the continuous normal; of flat plateaus, the middle along the sampled direction."""
    mask, score = planes["cand"] > 0, planes["score"].astype(float)
    v = View(x0, y0, w, h, mask.shape)
    angle = planes["orientation_angle"].astype(float)
    nx, ny = np.cos(angle), np.sin(angle)

    def bilinear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        fx, fy = np.floor(x), np.floor(y)
        sx, sy = x - fx, y - fy
        at = lambda i, j: v.at(score, np.minimum(w - 1, i), np.minimum(h - 1, j))
        top = at(fx, fy) * (1 - sx) + at(fx + 1, fy) * sx
        bottom = at(fx, fy + 1) * (1 - sx) + at(fx + 1, fy + 1) * sx
        return top * (1 - sy) + bottom * sy

    before, after = bilinear(v.x - nx, v.y - ny), bilinear(v.x + nx, v.y + ny)
    beaten = (score + EPSILON < before) | (score + EPSILON < after)
    single = (score > before + EPSILON) | (score > after + EPSILON)
    step = np.array([(1, 0), (1, 1), (0, 1), (-1, 1)])[planes["orientation"].astype(int) % 4]

    def walk(sign: int) -> tuple[np.ndarray, np.ndarray]:
        """Steps along the plateau, and the score of the candidate where it ends (-1 if none)."""
        steps, going = np.zeros(mask.shape, int), np.ones(mask.shape, bool)
        beyond = np.full(mask.shape, -1.0)
        for k in range(1, PLATEAU + 2):
            x, y = v.x + sign * k * step[..., 0], v.y + sign * k * step[..., 1]
            there = (x >= 0) & (y >= 0) & (x < w) & (y < h)
            m, s = there & v.at(mask, x, y), v.at(score, x, y)
            flat = going & m & (np.abs(s - score) <= EPSILON) & (k <= PLATEAU)
            ends = going & ~flat
            beyond = np.where(ends & m, s, beyond)
            steps += flat
            going = flat
        return steps, beyond

    back, low = walk(-1)
    ahead, high = walk(1)
    middle = (low <= score + EPSILON) & (high <= score + EPSILON) & (back == (back + ahead) // 2)
    keep = np.where(v.inside(MARGINS["ridge"]), ~beaten & (single | middle), True)
    return {"thin": (mask & keep).astype(np.int32)}


def nms(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """df (cand, score, orientation, orientation_angle, w, h and the kept columns, without nulls) with the thinned mask ``thin``."""
    return tiled(df, ["cand", "score", "orientation", "orientation_angle", *keep], {"thin": "int"}, PLATEAU + 2, nms_kernel)


def thinned(feat: DataFrame, conf: Params, calibration: DataFrame | None = None, exclusion: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, w, h, score, thin, exclusion and the kept columns, without nulls): candidates after non-maximum suppression, out of the exclusion."""
    df = candidates(feat, conf, calibration)
    keep = (*keep, exclusion) if exclusion else keep
    out_of = (lambda c: F.when(F.col(exclusion) == 1, 0).otherwise(F.col(c))) if exclusion else F.col
    df = df.withColumn("cand", out_of("cand"))
    df = nms(df, keep) if conf.centerline_nms else df.withColumn("thin", F.col("cand"))
    return df.withColumn("thin", out_of("thin")).select("image_id", "y", "x", "w", "h", "score", "thin", *keep)


def boundary_mask(feat: DataFrame, conf: Params | None = None, calibration: DataFrame | None = None, exclusion: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, w, h, score, pred, exclusion and the kept columns, without nulls): the whole mask pipeline. exclusion: a 0/1 column of feat."""
    conf = conf or Params()
    df = min_component(thinned(feat, conf, calibration, exclusion, keep), "thin", "pred", conf.min_component)
    out = F.when(F.col(exclusion) == 1, 0).otherwise(F.col("pred")) if exclusion else F.col("pred")
    return df.withColumn("pred", out).select("image_id", "y", "x", "w", "h", "score", "pred", *([exclusion] if exclusion else []), *keep)
