"""The diagnostic report: one nested row for each image, put together by joins of structs on the image, nothing global."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import Params
from ..plans.graph import stored
from .fills import spatial_holdout
from .metrics import alignment, compare, macro, multi_tolerance, region_features, regional, roi_metrics
from .windows import endpoint_proxy

KEY = "image_id"


def _struct(df: DataFrame, *leave: str) -> Column:
    return F.struct(*[c for c in df.columns if c not in (KEY, *leave)])


def _one(df: DataFrame, name: str) -> DataFrame:
    """A row's columns as one struct."""
    return df.select(KEY, _struct(df).alias(name))


def _many(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The few rows of an image as an array of structs, in order of ``by``, which come first."""
    rest = [c for c in df.columns if c not in (KEY, *by)]
    return df.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(*by, *rest))).alias(name))


def reference_split(scene: DataFrame, fraction: float = 0.2, cols: int = 4, rows: int = 4) -> DataFrame:
    """scene with held (0/1): whether spatial_holdout() keeps the pixel's cell for validation. Needs ref, w and h."""
    cell = F.least(F.floor(F.col("y") * rows / F.col("h")), F.lit(rows - 1)) * cols + F.least(F.floor(F.col("x") * cols / F.col("w")), F.lit(cols - 1))
    df = scene.withColumn("_cell", cell.cast("int"))
    active = df.where("ref = 1").select(KEY, "_cell").distinct().withColumn("_bit", F.row_number().over(Window.partitionBy(KEY).orderBy("_cell")) - 1)
    held = active.join(spatial_holdout(scene, "ref", fraction, cols, rows).select(KEY, "subset"), KEY)
    held = held.where(F.expr("shiftright(subset, _bit) & 1") == 1).select(KEY, "_cell", F.lit(1).alias("_held"))
    return df.join(held, [KEY, "_cell"], "left").withColumn("held", F.coalesce("_held", F.lit(0))).drop("_cell", "_held")


def holdout_metrics(scene: DataFrame, tolerance: int, fraction: float = 0.2) -> DataFrame:
    """(image_id, tuning_pixels, validation_pixels, tuning_recall, validation_recall): how well the prediction meets each part of the reference."""
    s = stored(reference_split(scene, fraction), "split")
    pixels = s.groupBy(KEY).agg(F.sum(F.col("ref") * (1 - F.col("held"))).alias("tuning_pixels"), F.sum(F.col("ref") * F.col("held")).alias("validation_pixels"))
    part = lambda held, name: compare(s.withColumn("ref", F.col("ref") * (F.col("held") == held).cast("int")), tolerance).select(KEY, F.col("recall").alias(name))
    return pixels.join(part(0, "tuning_recall"), KEY, "left").join(part(1, "validation_recall"), KEY, "left")


def diagnostic(scene: DataFrame, conf: Params, rois: DataFrame | None = None, features: tuple[str, ...] = (), mask: str = "pred") -> DataFrame:
    """A row for each image: settings, whole, cells, macro, tolerances, alignment, holdout, endpoints, and regions' features and ROIs where given.

    scene: mask, ref, neg, excl, w, h and the features. topology.report() has what concerns gaps and closure.
    """
    s = scene.drop("pred").withColumn("pred", F.col(mask)) if mask != "pred" else scene
    cells = stored(regional(s, conf.tolerance, review_radius=conf.review_radius), "regional")
    whole, own = cells.where("rx IS NULL").drop("rx", "ry"), cells.where("rx IS NOT NULL")
    parts = [
        _one(whole, "whole"), _many(own, "cells", "ry", "rx"), _one(macro(cells), "macro"), _many(multi_tolerance(s, [1, 2, 3, 4]), "tolerances", "tolerance"),
        _one(alignment(s, conf.tolerance, conf.review_radius), "alignment"), _one(holdout_metrics(s, conf.tolerance), "holdout"), _one(endpoint_proxy(s, "pred"), "endpoints"),
    ]
    if features:
        parts.append(_many(region_features(s, list(features)), "region_features", "ry", "rx"))
    if rois is not None:
        parts.append(_many(roi_metrics(s, rois, conf.tolerance), "rois", "roi"))
    settings = F.struct(F.lit(conf.tolerance).alias("tolerance"), F.lit(conf.review_radius).alias("review_radius"), F.lit(conf.sensitivity).alias("sensitivity"), F.lit(conf.min_component).alias("min_component"))
    out = s.groupBy(KEY).agg(F.first("w").alias("w"), F.first("h").alias("h")).withColumn("settings", settings)
    for part in parts:
        out = out.join(part, KEY, "left")
    return out
