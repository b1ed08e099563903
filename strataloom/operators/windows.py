"""Neighbourhood operators as separable window frames: one pass along rows, one along columns, never a global window."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixel import byte, clamp01, tensor_bytes
from ..plans.graph import dealt
from ..plans.tiles import tiled


def along_x(a: int, b: int):
    return Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(a, b)


def along_y(a: int, b: int):
    return Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(a, b)


#: Rows of an image that one window of a column holds: what a task sorts doesn't grow with the image's height.
BAND = 4096


def down_columns(df: DataFrame, wanted: dict[str, tuple[Column | str, int, Callable[[Column], Column]]]) -> DataFrame:
    """how over the pixels at most a radius above and below, out -> (value, radius, how), by bands of rows: rows near a band's border are in both bands. One exchange."""
    reach = max(r for _, r, _ in wanted.values())
    df = df.withColumn("_band", F.explode(F.sequence(F.floor((F.col("y") - reach) / BAND), F.floor((F.col("y") + reach) / BAND))))
    df = dealt(df, "image_id", "_band", "x")
    own = Window.partitionBy("image_id", "_band", "x").orderBy("y")
    made = {k: how(v).over(own.rangeBetween(-r, r)) for k, (v, r, how) in wanted.items()}
    return df.withColumns(made).where(F.col("_band") == F.floor(F.col("y") / BAND)).drop("_band")


def separable(df: DataFrame, value: Column, out: str, radius: int, how=F.max, between: Column | None = None) -> DataFrame:
    """how over the square of a radius: along x, then along y. ``between`` may rework the middle result, in ``_row``."""
    df = dealt(df, "image_id", "y").withColumn("_row", how(value).over(along_x(-radius, radius)))
    if between is not None:
        df = df.withColumn("_row", between)
    return down_columns(df, {out: ("_row", radius, how)}).drop("_row")


def separable_many(df: DataFrame, wanted: dict[str, tuple[Column | str, int, Callable[[Column], Column]]]) -> DataFrame:
    """separable() for several columns at once, out -> (value, radius, how): all rows under one sort, then all columns, so two exchanges in all.

    A radius of 0 or less copies the value.
    """
    value = {k: F.col(v) if isinstance(v, str) else v for k, (v, _, _) in wanted.items()}
    row = {f"_r_{k}": how(value[k]).over(along_x(-r, r)) if r > 0 else value[k] for k, (_, r, how) in wanted.items()}
    df, wide = dealt(df, "image_id", "y").withColumns(row), {k: (f"_r_{k}", r, how) for k, (_, r, how) in wanted.items() if r > 0}
    df = down_columns(df, wide) if wide else df
    return df.withColumns({k: F.col(f"_r_{k}") for k in wanted if k not in wide}).drop(*row)


def dilate(df: DataFrame, mask: Column | str, out: str, radius: int) -> DataFrame:
    """Square dilation of a 0/1 mask; radius 0 or less copies it."""
    mask = F.col(mask) if isinstance(mask, str) else mask
    return separable(df, mask.cast("int"), out, radius) if radius > 0 else df.withColumn(out, mask.cast("int"))


def erode(df: DataFrame, mask: Column | str, out: str, radius: int) -> DataFrame:
    """Square erosion; what lies within the radius of the frame is 0."""
    mask = (F.col(mask) if isinstance(mask, str) else mask).cast("int")
    if radius <= 0:
        return df.withColumn(out, mask)
    full = 2 * radius + 1
    df = dealt(df, "image_id", "y").withColumn("_row", F.when(F.count("*").over(along_x(-radius, radius)) == full, F.min(mask).over(along_x(-radius, radius))).otherwise(0))
    df = down_columns(df, {"_n": (F.lit(1), radius, F.count), out: ("_row", radius, F.min)})
    return df.withColumn(out, F.when(F.col("_n") == full, F.col(out)).otherwise(0)).drop("_row", "_n")


def box_mean(df: DataFrame, value: Column, out: str, radius: int) -> DataFrame:
    """Mean over the square, smaller at the frame, in single precision after each pass."""
    return box_means(df, {out: value}, radius)


def box_means(df: DataFrame, values: dict[str, Column], radius: int) -> DataFrame:
    """box_mean() of several columns."""
    df = dealt(df, "image_id", "y").withColumns({f"_r_{k}": F.avg(v).over(along_x(-radius, radius)).cast("float") for k, v in values.items()})
    df = down_columns(df, {k: (f"_r_{k}", radius, F.avg) for k in values})
    return df.withColumns({k: F.col(k).cast("float") for k in values}).drop(*(f"_r_{k}" for k in values))


def prefix_sum(df: DataFrame, value: Column, out: str, radius: int) -> DataFrame:
    """prefix_sums() of one column."""
    return prefix_sums(df, {out: value}, radius)


def prefix_sums(df: DataFrame, values: dict[str, Column], radius: int) -> DataFrame:
    """Sums over the square by differences of running sums: linear however large the radius, two exchanges for all columns.

    Frames go by coordinate, so missing pixels count as nothing.
    """
    for part, order in ((["image_id", "y"], "x"), (["image_id", "x"], "y")):
        w = Window.partitionBy(*part).orderBy(order)
        df = df.withColumns({f"_run_{k}": F.sum(v).over(w.rangeBetween(Window.unboundedPreceding, 0)) for k, v in values.items()})
        top = {k: F.last(f"_run_{k}").over(w.rangeBetween(Window.unboundedPreceding, radius)) for k in values}  # frames that only grow cost the same at any radius
        below = {k: F.coalesce(F.last(f"_run_{k}").over(w.rangeBetween(Window.unboundedPreceding, -radius - 1)), F.lit(0.0)) for k in values}
        df = df.withColumns({f"_part_{k}": top[k] - below[k] for k in values}).drop(*(f"_run_{k}" for k in values))
        values = {k: F.col(f"_part_{k}") for k in values}
    return df.withColumnsRenamed({f"_part_{k}": k for k in values})


def local_dark(df: DataFrame, luma: Column, out: str, radius: int, strength: float) -> DataFrame:
    """Darkness against the neighbourhood's mean and spread, mixed with absolute darkness."""
    df = prefix_sums(df.withColumn("_l", luma.cast("double")), {"_s": F.col("_l"), "_q": F.col("_l") * F.col("_l"), "_n": F.lit(1.0)}, radius)
    mean = F.col("_s") / F.col("_n")
    std = F.sqrt(F.greatest(F.lit(1e-6), F.col("_q") / F.col("_n") - mean * mean))
    z = F.greatest(F.lit(0.0), (mean - F.col("_l")) / (std + 0.018))
    mixed = clamp01((0.67 - F.col("_l")) / 0.57) * (1 - strength) + clamp01(z / 3.2) * strength
    return df.withColumn(out, byte(mixed)).drop("_l", "_s", "_q", "_n")


def local_feature(df: DataFrame, feature: str, out: str, radius: int, strength: float) -> DataFrame:
    """A feature byte against its neighbourhood's mean."""
    return local_features(df, {out: (feature, strength)}, radius)


def local_features(df: DataFrame, wanted: dict[str, tuple[str, float]], radius: int) -> DataFrame:
    """local_feature() of several bytes, out -> (feature, strength)."""
    df = df.withColumns({f"_f_{k}": (F.col(f) / 255.0).cast("float").cast("double") for k, (f, _) in wanted.items()})
    sums = {f"_s_{k}": F.col(f"_f_{k}") for k, (_, strength) in wanted.items() if strength > 0}
    if sums:
        df = prefix_sums(df, sums | {"_n": F.lit(1.0)}, radius)

    def mixed(k: str, feature: str, strength: float) -> Column:
        if strength <= 0:
            return F.col(feature)
        own = F.col(f"_f_{k}")
        return byte(own * (1 - strength) + clamp01(own / (F.col(f"_s_{k}") / F.col("_n") * 2.15 + 0.035)) * strength)

    return df.withColumns({k: mixed(k, f, strength) for k, (f, strength) in wanted.items()}).drop("_n", *(f"_f_{k}" for k in wanted), *sums)


def sobel(df: DataFrame, luma: str) -> DataFrame:
    """gx and gy from smoothing along one axis and a difference along the other; null on the frame."""
    wx, wy = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    v = F.col(luma).cast("double")
    df = df.withColumns({"_up": F.lag(v).over(wy), "_down": F.lead(v).over(wy)})
    df = df.withColumns({"_sum": F.col("_up") + 2 * v + F.col("_down"), "_dif": F.col("_down") - F.col("_up")})
    gx = (F.lead("_sum").over(wx) - F.lag("_sum").over(wx)) * 0.125
    gy = (F.lag("_dif").over(wx) + 2 * F.col("_dif") + F.lead("_dif").over(wx)) * 0.125
    return df.withColumns({"gx": gx, "gy": gy}).drop("_up", "_down", "_sum", "_dif")


def tensor_orientation(df: DataFrame, luma: str, radius: int = 7) -> DataFrame:
    """dendrite_orientation and dendrite_coherence bytes of the blurred structure tensor."""
    products = {"_xx": F.col("gx") * F.col("gx"), "_yy": F.col("gy") * F.col("gy"), "_xy": F.col("gx") * F.col("gy")}
    df = box_means(sobel(df, luma), {k: F.coalesce(e, F.lit(0.0)).cast("float") for k, e in products.items()}, radius)
    o, c = tensor_bytes(*(F.col(k).cast("double") for k in ("_xx", "_yy", "_xy")))
    return df.withColumns({"dendrite_orientation": o, "dendrite_coherence": c}).drop("gx", "gy", "_xx", "_yy", "_xy")


def neighbours(df: DataFrame, mask: str, out: str) -> DataFrame:
    """How many of a pixel's eight neighbours are set."""
    df = separable(df, F.col(mask).cast("int"), out, 1, F.sum)
    return df.withColumn(out, F.col(out) - F.col(mask).cast("int"))


def supported(df: DataFrame, mask: str, out: str) -> DataFrame:
    """Set pixels with two set neighbours at least."""
    df = neighbours(df, mask, "_near")
    return df.withColumn(out, ((F.col(mask) == 1) & (F.col("_near") >= 2)).cast("int")).drop("_near")


def endpoint_proxy(df: DataFrame, mask: str, margin: int = 3) -> DataFrame:
    """Per image: set pixels, interior ones with at most one neighbour, and these in a hundred thousand. Needs w and h."""
    df = neighbours(df, mask, "_near")
    own = F.col(mask) == 1
    deep = (F.col("x") >= margin) & (F.col("y") >= margin) & (F.col("x") < F.col("w") - margin) & (F.col("y") < F.col("h") - margin)
    return df.groupBy("image_id").agg(F.count_if(own).alias("set_pixels"), F.count_if(own & deep & (F.col("_near") <= 1)).alias("endpoints")).withColumn("per_100k", F.when(F.col("set_pixels") > 0, F.col("endpoints") * 100000.0 / F.col("set_pixels")).otherwise(0.0))


def distance_kernel(outs: dict[str, tuple[str, str | None]]) -> Callable[..., dict[str, np.ndarray]]:
    """Chebyshev distances by two raster passes, out -> (mask, walls); walls neither have nor pass on a distance.

    Without walls they are exact. With them, a path may only turn as the two passes do, which is what the reference's figures rest on. Along
    a row, the pass is a running minimum that starts anew behind each wall.
    """

    def swept(d: np.ndarray, wall: np.ndarray, far: int) -> np.ndarray:
        n = d.shape[1]
        x = np.arange(n)
        for y in range(d.shape[0]):
            row, solid = d[y], wall[y]
            if y:
                up = np.concatenate([[far], d[y - 1], [far]])
                row = np.where(solid, row, np.minimum(row, np.minimum(np.minimum(up[:-2], up[1:-1]), up[2:]) + 1))
            start = np.cumsum(solid) * (4 * far)
            row = np.minimum(row, np.minimum.accumulate(row - x - start) + x + start)
            d[y] = np.where(solid, far, np.minimum(row, far))
        return d

    def kernel(planes: dict[str, np.ndarray], x0: int, y0: int, w: int, h: int) -> dict[str, np.ndarray]:
        made = {}
        for out, (mask, walls) in outs.items():
            shape = planes[mask].shape
            far = shape[0] + shape[1] + w + h
            wall = (planes[walls] > 0) if walls else np.zeros(shape, bool)
            y, x = np.mgrid[y0 : y0 + shape[0], x0 : x0 + shape[1]]
            wall = wall | (x < 0) | (y < 0) | (x >= w) | (y >= h)
            d = swept(np.where((planes[mask] > 0) & ~wall, 0, far).astype(np.int64), wall, far)
            made[out] = swept(d[::-1, ::-1].copy(), wall[::-1, ::-1], far)[::-1, ::-1].astype(np.int32)
        return made

    return kernel


def chebyshev_distances(df: DataFrame, outs: dict[str, tuple[str, str | None]], furthest: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, w, h, masks, walls, keep) with the Chebyshev distance to each mask, out -> (0/1 mask, 0/1 walls or None), where it is at most ``furthest``, else null.

    One exchange: a tile sees ``furthest`` pixels around it, as far as any path to a distance that counts. Needs w and h; kept columns hold no nulls.
    """
    inputs = list(dict.fromkeys([c for pair in outs.values() for c in pair if c] + list(keep)))
    made = tiled(df, inputs, {k: "int" for k in outs}, furthest, distance_kernel(outs), max(256, 2 * furthest))
    return made.withColumns({k: F.when(F.col(k) <= furthest, F.col(k)) for k in outs})


def chebyshev_distance(df: DataFrame, mask: str, out: str, furthest: int, walls: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """chebyshev_distances() to one mask."""
    return chebyshev_distances(df, {out: (mask, walls)}, furthest, keep)
