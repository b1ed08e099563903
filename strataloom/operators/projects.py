"""Project documents: a whole session as JSON, one document an image, and back, with the checks that a restore makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sinks import PROJECT_FORMAT, PROJECT_VERSION, pack_mask, unpack_mask

SEEDS = "array<struct<x double, y double, borderAssisted boolean>>"
RECTS = "array<struct<ord int, x0 int, y0 int, x1 int, y1 int, verified boolean, source string>>"
HEADER = "struct<width int, height int, bitDepth int, topDown boolean, pixelOffset bigint>"
GUIDE = "struct<version int, grid struct<cols int, rows int>, lastSuggestedRound int, lastSkippedRound int, lastSuggestion string>"
CALIBRATION = "struct<cols int, rows int, baseSensitivity int, values array<double>, measured array<int>, regions array<struct<rx int, ry int, delta double, gain double, referencePixels bigint>>>"
SCHEMA = (
    f"format string, formatVersion int, appVersion string, algorithmVersion string, savedAt string, source struct<fingerprint string, fileName string, fileSize bigint, header {HEADER}>, "
    "preview struct<width int, height int, scale double>, settings string, "
    f"reference struct<mask string, centerline string>, nonBoundary struct<mask string, centerline string, closedFillSeeds {SEEDS}>, "
    f"exclusionRects {RECTS}, fullEvaluationRois {RECTS}, precisionGuide {GUIDE}, localCalibration {CALIBRATION}, history array<string>"
)
#: Written into each document.
APP_VERSION, ALGORITHM_VERSION, GUIDE_VERSION = "0.3.0", "tiles-1", 2
#: Where each mask of a session lies in its document.
MASKS = {"ref_band": "reference.mask", "ref": "reference.centerline", "neg_band": "nonBoundary.mask", "neg": "nonBoundary.centerline"}


def _rects(rects: DataFrame, kind: str) -> DataFrame:
    own = {c: F.col(c) if c in rects.columns else F.lit(None) for c in ("verified", "source")}
    item = F.struct("ord", "x0", "y0", "x1", "y1", own["verified"].cast("boolean").alias("verified"), own["source"].cast("string").alias("source"))
    return rects.groupBy("image_id").agg(F.sort_array(F.collect_list(item)).alias(kind))


def guide_part(guide: DataFrame) -> DataFrame:
    """(image_id, guide) of the guide's state (image_id and any of cols, rows, lastSuggestedRound, lastSkippedRound, lastSuggestion as JSON): an 8x8 grid and rounds of -1 where unknown."""
    own = lambda c, kind, default=None: F.coalesce(F.col(c).cast(kind) if c in guide.columns else F.lit(None).cast(kind), F.lit(default).cast(kind)).alias(c)
    return guide.select("image_id", F.struct(F.lit(GUIDE_VERSION).alias("version"), F.struct(own("cols", "int", 8), own("rows", "int", 8)).alias("grid"), own("lastSuggestedRound", "int", -1), own("lastSkippedRound", "int", -1), own("lastSuggestion", "string")).alias("guide"))


def calibration_part(filled: DataFrame, choice: DataFrame, base: int, cols: int = 4, rows: int = 4) -> DataFrame:
    """(image_id, calibration) of tune.calibration_fill() and tune.local_choice() (with ``ref`` where it is known): the grid in order, which cells were measured, and what was chosen there."""
    cell = F.struct((F.col("ry") * cols + F.col("rx")).alias("i"), F.col("value").cast("double").alias("v"), F.col("measured").cast("int").alias("m"))
    g = filled.groupBy("image_id").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    reference = F.col("ref").cast("long") if "ref" in choice.columns else F.lit(None).cast("long")
    region = F.struct("ry", "rx", F.col("delta").cast("double").alias("delta"), F.col("gain").cast("double").alias("gain"), reference.alias("referencePixels"))
    r = choice.groupBy("image_id").agg(F.array_sort(F.collect_list(region)).alias("r"))
    part = F.struct(F.lit(cols).alias("cols"), F.lit(rows).alias("rows"), F.lit(base).alias("baseSensitivity"), F.transform("c", lambda x: x["v"]).alias("values"), F.transform("c", lambda x: x["m"]).alias("measured"), F.transform("r", lambda x: F.struct(x["rx"].alias("rx"), x["ry"].alias("ry"), x["delta"].alias("delta"), x["gain"].alias("gain"), x["referencePixels"].alias("referencePixels"))).alias("regions"))
    return g.join(r, "image_id", "left").select("image_id", part.alias("calibration"))


def snapshot(images: DataFrame, masks: DataFrame, settings: str, seeds: DataFrame, exclusions: DataFrame, rois: DataFrame, extra: DataFrame | None = None, saved_at: Column | None = None) -> DataFrame:
    """(image_id, document). images (image_id, w, h, scale, fingerprint, and where known name, size and header, a struct of HEADER); masks: pixels with w and the columns of MASKS.

    extra (image_id and any of guide, calibration and history, as in SCHEMA). Annotations of one image are a person's; its masks are packed.
    """
    doc = images
    for name in MASKS:
        doc = doc.join(pack_mask(masks, name).withColumnRenamed("packed", name), "image_id", "left")
    seed = F.struct("ord", F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("border_assisted").alias("borderAssisted")).alias("v"))
    doc = doc.join(seeds.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(seed)), lambda s: s["v"]).alias("seeds")), "image_id", "left")
    doc = doc.join(_rects(exclusions, "exclusions"), "image_id", "left").join(_rects(rois, "rois"), "image_id", "left")
    if extra is not None:
        doc = doc.join(extra, "image_id", "left")
    part = lambda c, kind: (F.col(c) if c in doc.columns else F.lit(None)).cast(kind)
    when = saved_at if saved_at is not None else F.current_timestamp()
    body = F.struct(
        F.lit(PROJECT_FORMAT).alias("format"), F.lit(PROJECT_VERSION).alias("formatVersion"), F.lit(APP_VERSION).alias("appVersion"), F.lit(ALGORITHM_VERSION).alias("algorithmVersion"),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("savedAt"),
        F.struct("fingerprint", part("name", "string").alias("fileName"), part("size", "bigint").alias("fileSize"), part("header", HEADER).alias("header")).alias("source"),
        F.struct(F.col("w").alias("width"), F.col("h").alias("height"), F.col("scale").cast("double").alias("scale")).alias("preview"), F.lit(settings).alias("settings"),
        F.struct(F.col("ref_band").alias("mask"), F.col("ref").alias("centerline")).alias("reference"),
        F.struct(F.col("neg_band").alias("mask"), F.col("neg").alias("centerline"), F.coalesce("seeds", F.array().cast(SEEDS)).alias("closedFillSeeds")).alias("nonBoundary"),
        F.coalesce("exclusions", F.array().cast(RECTS)).alias("exclusionRects"), F.coalesce("rois", F.array().cast(RECTS)).alias("fullEvaluationRois"),
        part("guide", GUIDE).alias("precisionGuide"), part("calibration", CALIBRATION).alias("localCalibration"),
        F.coalesce(part("history", "array<string>"), F.array().cast("array<string>")).alias("history"),
    )
    return doc.select("image_id", F.to_json(body).alias("document"))


def project_error() -> Column:
    """Why a parsed document ``p`` can't be restored for an image of fingerprint, w and h; null if it can. The first reason counts."""
    p = lambda c: F.col(f"p.{c}")
    return (
        F.when(F.col("p").isNull() | p("format").isNull() | (p("format") != PROJECT_FORMAT), "not a project")
        .when(~p("formatVersion").eqNullSafe(PROJECT_VERSION), "another version")
        .when((F.coalesce(p("preview.width"), F.lit(0)) == 0) | (F.coalesce(p("preview.height"), F.lit(0)) == 0), "no preview")
        .when(p("source.fingerprint").isNotNull() & (p("source.fingerprint") != "") & ~p("source.fingerprint").eqNullSafe(F.col("fingerprint")), "another image")
        .when((p("preview.width") != F.col("w")) | (p("preview.height") != F.col("h")), "another size")
    )


def restore(documents: DataFrame, images: DataFrame) -> DataFrame:
    """documents (image_id, document) for open images (image_id, w, h, fingerprint): (image_id, p, error). Only rows without error may be used."""
    d = documents.withColumn("p", F.from_json("document", SCHEMA)).join(images.select("image_id", "w", "h", "fingerprint"), "image_id", "left")
    return d.withColumn("error", F.when(F.col("w").isNull(), "no image").otherwise(project_error())).select("image_id", "p", "error")


def restored_mask(restored: DataFrame, name: str) -> DataFrame:
    """(image_id, y, x, name) of a mask of MASKS, dense, of the documents without error; a document without it has none set."""
    p = restored.where("error IS NULL")
    packed = p.select("image_id", F.coalesce(F.col(f"p.{MASKS[name]}"), F.lit("")).alias("packed"), F.col("p.preview.width").alias("w"), F.col("p.preview.height").alias("h"))
    return unpack_mask(packed).select("image_id", "y", "x", F.coalesce("bit", F.lit(0)).alias(name))


def restored_seeds(restored: DataFrame) -> DataFrame:
    """(image_id, ord, x, y, border_assisted); coordinates are rounded, seeds without them dropped."""
    s = restored.where("error IS NULL").select("image_id", F.posexplode("p.nonBoundary.closedFillSeeds").alias("ord", "s")).where("s.x IS NOT NULL AND s.y IS NOT NULL AND NOT isnan(s.x) AND NOT isnan(s.y)")
    return s.select("image_id", "ord", F.floor(F.col("s.x") + 0.5).cast("int").alias("x"), F.floor(F.col("s.y") + 0.5).cast("int").alias("y"), F.coalesce("s.borderAssisted", F.lit(False)).alias("border_assisted"))


def restored_rects(restored: DataFrame, kind: str) -> DataFrame:
    """(image_id, ord, x0, y0, x1, y1, verified, source) of ``exclusionRects`` or ``fullEvaluationRois``."""
    return restored.where("error IS NULL").select("image_id", F.explode(f"p.{kind}").alias("r")).select("image_id", "r.*")


def restored_guide(restored: DataFrame) -> DataFrame:
    """(image_id, version, cols, rows, lastSuggestedRound, lastSkippedRound, lastSuggestion) of the documents that have a guide."""
    g = restored.where("error IS NULL AND p.precisionGuide IS NOT NULL").select("image_id", F.col("p.precisionGuide").alias("g"))
    return g.select("image_id", "g.version", F.col("g.grid.cols").alias("cols"), F.col("g.grid.rows").alias("rows"), "g.lastSuggestedRound", "g.lastSkippedRound", "g.lastSuggestion")


def restored_calibration(restored: DataFrame) -> DataFrame:
    """(image_id, rx, ry, value, measured): each image's grid as extraction takes it."""
    c = restored.where("error IS NULL").select("image_id", F.col("p.localCalibration").alias("c"))
    cells = c.select("image_id", "c.cols", F.posexplode(F.arrays_zip(F.col("c.values").alias("value"), F.col("c.measured").alias("measured"))).alias("i", "v"))
    return cells.select("image_id", (F.col("i") % F.col("cols")).cast("int").alias("rx"), F.floor(F.col("i") / F.col("cols")).cast("int").alias("ry"), "v.value", (F.col("v.measured") == 1).alias("measured"))
