"""Tiles with halos: dense numpy work on pieces of bounded size, for stencils that frames can't express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import dealt

TILE = 256


def tiled(df: DataFrame, inputs: list[str], outputs: dict[str, str], halo: int, kernel: Callable[..., dict[str, np.ndarray]], tile: int = TILE) -> DataFrame:
    """df with columns made by kernel(planes, x0, y0, w, h), which sees a tile with ``halo`` pixels around it.

    A pixel goes to its own tile and to the neighbours whose halo holds it, at most four times; a task holds one tile.
    planes: name -> array (with zeros beyond the image); x0, y0: the image coordinates of its corner; outputs: the
    same shape. Needs w and h. Other columns than the key, inputs, w and h are dropped.
    """
    if halo >= tile:
        raise ValueError("the halo must be smaller than a tile")

    def span(at: str):
        lo, hi = F.floor((F.col(at) - halo) / tile), F.floor((F.col(at) + halo) / tile)
        return F.array_distinct(F.array(F.greatest(lo, F.lit(0)), F.floor(F.col(at) / tile), hi))

    spread = df.select("image_id", "y", "x", "w", "h", *inputs).withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))
    spread = spread.where((F.col("tx") * tile < F.col("w")) & (F.col("ty") * tile < F.col("h")))
    kinds = dict(df.dtypes)
    schema = f"image_id {kinds['image_id']}, y int, x int, w int, h int, " + ", ".join(f"{k} {kinds[k]}" for k in inputs) + ", " + ", ".join(f"{k} {t}" for k, t in outputs.items())

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(rows["tx"].iloc[0]), int(rows["ty"].iloc[0])
        w, h = int(rows["w"].iloc[0]), int(rows["h"].iloc[0])
        x0, y0 = tx * tile - halo, ty * tile - halo
        x, y = rows["x"].to_numpy() - x0, rows["y"].to_numpy() - y0
        planes = {}
        for k in inputs:
            p = np.zeros((tile + 2 * halo, tile + 2 * halo), rows[k].dtype)
            p[y, x] = rows[k].to_numpy()
            planes[k] = p
        made = kernel(planes, x0, y0, w, h)
        own = (x >= halo) & (x < halo + tile) & (y >= halo) & (y < halo + tile)
        out = rows.loc[own, ["image_id", "y", "x", "w", "h", *inputs]].copy()
        for k in outputs:
            out[k] = made[k][y[own], x[own]]
        return out

    return dealt(spread, "image_id", "ty", "tx").groupBy("image_id", "ty", "tx").applyInPandas(run, schema)


class View:
    """Samples a plane of a tile at image coordinates, clamped to the image as well."""

    def __init__(self, x0: int, y0: int, w: int, h: int, shape: tuple[int, int]) -> None:
        self.x0, self.y0, self.w, self.h = x0, y0, w, h
        self.y, self.x = np.mgrid[y0 : y0 + shape[0], x0 : x0 + shape[1]]
        self.shape = shape

    def at(self, plane: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Values at rounded (half up), clamped coordinates. Beyond the tile they are only asked for by pixels of the halo."""
        sx = np.clip(np.floor(x + 0.5), 0, self.w - 1).astype(int) - self.x0
        sy = np.clip(np.floor(y + 0.5), 0, self.h - 1).astype(int) - self.y0
        return plane[np.clip(sy, 0, self.shape[0] - 1), np.clip(sx, 0, self.shape[1] - 1)]

    def inside(self, margin: int) -> np.ndarray:
        return (self.x >= margin) & (self.y >= margin) & (self.x < self.w - margin) & (self.y < self.h - margin)
