"""Masks from rectangles, mask algebra and three-state labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import separable_many

RECTS = "image_id int, ord int, kind string, x0 int, y0 int, x1 int, y1 int, verified boolean"
#: Rectangles are an image's annotations. Beyond this many they are joined by grid cells instead of being broadcast.
BROADCAST_RECTS = 20_000


def rect_pairs(px: DataFrame, rects: DataFrame, reach: int = 0, grid: int = 64) -> DataFrame:
    """(pixel, rectangle) pairs, where the pixel is in the rectangle or at most ``reach`` beyond it: broadcast where the rectangles are few, else an equi-join on grid cells.

    rects: r_image, x0, y0, x1, y1 and others.
    """
    r, rects = rects, rects.withColumns({"x0": F.col("x0") - reach, "y0": F.col("y0") - reach, "x1": F.col("x1") + reach, "y1": F.col("y1") + reach}) if reach else rects
    pairs = _pairs(px, rects, grid)
    return pairs.withColumns({"x0": F.col("x0") + reach, "y0": F.col("y0") + reach, "x1": F.col("x1") - reach, "y1": F.col("y1") - reach}).select(*px.columns, *r.columns) if reach else pairs


def _pairs(px: DataFrame, rects: DataFrame, grid: int) -> DataFrame:
    inside = (px.x >= rects.x0) & (px.x <= rects.x1) & (px.y >= rects.y0) & (px.y <= rects.y1)
    if rects.limit(BROADCAST_RECTS + 1).count() <= BROADCAST_RECTS:
        return px.join(F.broadcast(rects), (px.image_id == rects.r_image) & inside)
    cells = rects.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / grid), F.floor(F.col("x1") / grid)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y0") / grid), F.floor(F.col("y1") / grid))))
    on = (px.image_id == cells.r_image) & (F.floor(px.x / grid) == cells.cx) & (F.floor(px.y / grid) == cells.cy)
    return px.join(cells, on & (px.x >= cells.x0) & (px.x <= cells.x1) & (px.y >= cells.y0) & (px.y <= cells.y1)).drop("cx", "cy")


def in_rects(px: DataFrame, rects: DataFrame, out: str) -> DataFrame:
    """px with a 0/1 column: within any of the rectangles (inclusive bounds)."""
    if rects.limit(BROADCAST_RECTS + 1).count() <= BROADCAST_RECTS:
        # an image's rectangles as one array: no pixel is shuffled
        own = rects.groupBy("image_id").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("_rects"))
        inside = F.exists("_rects", lambda r: F.col("x").between(r["x0"], r["x1"]) & F.col("y").between(r["y0"], r["y1"]))
        return px.join(F.broadcast(own), "image_id", "left").withColumn(out, F.coalesce(inside, F.lit(False)).cast("int")).drop("_rects")
    r = rects.select(F.col("image_id").alias("r_image"), "x0", "y0", "x1", "y1")
    hit = rect_pairs(px.select("image_id", "y", "x"), r).select("image_id", "y", "x").distinct().withColumn(out, F.lit(1))
    return px.join(hit, ["image_id", "y", "x"], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def outside_rects(px: DataFrame, rects: DataFrame) -> DataFrame:
    """Pixels in none of the rectangles."""
    return in_rects(px, rects, "_in").where("_in = 0").drop("_in")


def hit_test(points: DataFrame, rects: DataFrame, reach: int = 6) -> DataFrame:
    """(point_id, ord, handle): the last rectangle whose handle or inside is at a point. points (point_id, image_id, x, y)."""
    r = rects.select(F.col("image_id").alias("r_image"), "ord", "x0", "y0", "x1", "y1")
    mx, my = F.floor((F.col("x0") + F.col("x1")) / 2), F.floor((F.col("y0") + F.col("y1")) / 2)
    handles = (("nw", F.col("x0"), F.col("y0")), ("n", mx, F.col("y0")), ("ne", F.col("x1"), F.col("y0")), ("e", F.col("x1"), my), ("se", F.col("x1"), F.col("y1")), ("s", mx, F.col("y1")), ("sw", F.col("x0"), F.col("y1")), ("w", F.col("x0"), my))
    handle = F.lit(None).cast("string")
    for name, hx, hy in reversed(handles):
        handle = F.when((F.abs(F.col("x") - hx) <= reach) & (F.abs(F.col("y") - hy) <= reach), name).otherwise(handle)
    inside = F.when((F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1")), "move")
    found = rect_pairs(points, r, reach).withColumn("handle", F.coalesce(handle, inside)).where("handle IS NOT NULL")
    last = F.row_number().over(Window.partitionBy("point_id").orderBy(F.desc("ord")))
    return found.withColumn("_n", last).where("_n = 1").select("point_id", "ord", "handle")


def negative_union(manual: Column, fill: Column, positive: Column) -> Column:
    return ((manual == 1) | (fill == 1)) & (positive != 1)


def label_state(positive_band: Column, negative: Column, excluded: Column) -> Column:
    """excluded, positive, negative or unknown; an exclusion overrides, and so does the band a negative."""
    return F.when(excluded == 1, "excluded").when(positive_band == 1, "positive").when(negative == 1, "negative").otherwise("unknown")


def with_bands(scene: DataFrame, tolerance: int) -> DataFrame:
    """scene (pred, ref, neg, excl) with state, clean prediction and whether a prediction lies within the tolerance."""
    df = scene.withColumn("clean", F.when(F.col("excl") == 1, 0).otherwise(F.col("pred")))
    df = separable_many(df, {"ref_band": (F.col("ref").cast("int"), tolerance, F.max), "pred_band": (F.col("clean").cast("int"), tolerance, F.max)})
    return df.withColumn("state", label_state(F.col("ref_band"), F.col("neg"), F.col("excl")))


def error_masks(df: DataFrame) -> DataFrame:
    """tp, fp, fn, negative_violation and unknown_prediction of a scene with bands."""
    p, s = F.col("clean") == 1, F.col("state")
    return df.withColumns({
        "tp": (p & (s == "positive")).cast("int"), "fp": (p & (s == "negative")).cast("int"),
        "fn": ((F.col("ref") == 1) & (s != "excluded") & (F.col("pred_band") == 0)).cast("int"),
        "negative_violation": (p & (s == "negative")).cast("int"), "unknown_prediction": (p & (s == "unknown")).cast("int"),
    })


# Colours of the overlays (rgb) and the alphas' shares of the opacity.
BAND_RGB, NEGATIVE_RGB, UNKNOWN_RGB, HIT_RGB, VIOLATION_RGB, MISS_RGB, BOUNDARY_RGB = "ffd84a", "ff8a00", "23f5de", "58e38a", "ff5e67", "ffd84a", "23f5de"
BAND_SHARE, UNKNOWN_SHARE = 0.24, 0.22


def _alpha(share: float) -> str:
    return f"{int(share + 0.5):02x}"


def overlay(df: DataFrame, opacity: float = 0.9) -> DataFrame:
    """Comparison colours (rgba in hex) of a scene with errors. Exclusions stay clear; bands and unknown predictions are faint, missed reference is opaque."""
    alpha = int(255 * opacity + 0.5)
    band, faint, full = _alpha(alpha * BAND_SHARE), _alpha(alpha * UNKNOWN_SHARE), _alpha(alpha)
    s, p = F.col("state"), F.col("pred") == 1
    rgba = F.when(s == "excluded", "00000000").when((F.col("ref") == 1) & (F.col("pred_band") == 0), MISS_RGB + "ff")
    rgba = rgba.when(p & (s == "positive"), HIT_RGB + full).when(p & (s == "negative"), VIOLATION_RGB + full).when(p, UNKNOWN_RGB + faint)
    return df.withColumn("rgba", rgba.when(s == "positive", BAND_RGB + band).when(s == "negative", NEGATIVE_RGB + band).otherwise("00000000"))
