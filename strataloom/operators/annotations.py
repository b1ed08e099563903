"""Annotation objects as event logs: rectangles, fill seeds and the ROI guide's life cycle; diagnostic bundles."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixel import normalize_rect
from .labels import rect_pairs
from .sinks import png, stored_zip

#: A rectangle needs this many pixels, a ROI that is verified this much reference.
MIN_RECT_AREA, MIN_ROI_REFERENCE = 9, 20


def current_rects(events: DataFrame, width: int, height: int) -> DataFrame:
    """events (image_id, rect_id, seq, action, kind, x0, y0, x1, y1, source) -> the rectangles that stand, in order of creation.

    create, edit and delete; bounds are put in order and clamped, too small ones never come to be; a ROI drawn by hand is verified.
    """
    x0, y0, x1, y1 = normalize_rect(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), width, height)
    e = events.withColumns({"x0": x0, "y0": y0, "x1": x1, "y1": y1})
    roomy = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) >= MIN_RECT_AREA
    e = e.where((F.col("action") == "delete") | roomy)
    g = e.groupBy("image_id", "rect_id").agg(F.max_by(F.struct("action", "x0", "y0", "x1", "y1"), "seq").alias("l"), F.min(F.when(F.col("action") == "create", F.col("seq"))).alias("made"), F.min_by("kind", "seq").alias("kind"), F.min_by("source", "seq").alias("source"))
    g = g.where(F.col("made").isNotNull() & (F.col("l.action") != "delete"))
    order = F.row_number().over(Window.partitionBy("image_id", "kind").orderBy("made", "rect_id")) - 1
    verified = F.when(F.col("kind") == "roi", F.coalesce(F.col("source") == "manual", F.lit(False)))
    return g.select("image_id", "rect_id", order.alias("ord"), "kind", "l.x0", "l.y0", "l.x1", "l.y1", "source", verified.alias("verified"))


def added_seeds(seeds: DataFrame) -> DataFrame:
    """Seeds without those on a point that has one already; the first of a point stays."""
    w = Window.partitionBy("image_id", "x", "y").orderBy("ord")
    return seeds.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reference_inside(px: DataFrame, rois: DataFrame) -> DataFrame:
    """(image_id, ord, reference): reference pixels in each ROI that aren't excluded; ROIs without any have 0."""
    r = rois.select(F.col("image_id").alias("r_image"), "ord", "x0", "y0", "x1", "y1")
    hit = rect_pairs(px.where("ref = 1 AND excl = 0").select("image_id", "y", "x"), r)
    n = hit.groupBy("image_id", "ord").agg(F.count("*").alias("reference"))
    return rois.select("image_id", "ord").join(n, ["image_id", "ord"], "left").withColumn("reference", F.coalesce("reference", F.lit(0)))


def guide_states(rois: DataFrame, commands: DataFrame, reference: DataFrame) -> DataFrame:
    """Suggested ROIs after the guide's commands (image_id, ord, seq, command: activate, verify, skip, finish).

    Verifying needs enough reference inside; a skipped or verified ROI stays so; finishing drops what is still open.
    """
    c = commands.join(reference, ["image_id", "ord"], "left")
    fine = (F.col("command") != "verify") | (F.col("reference") >= MIN_ROI_REFERENCE)
    c = c.where(fine & F.col("command").isin("verify", "skip", "activate"))
    closing = F.min(F.when(F.col("command").isin("verify", "skip"), F.struct("seq", "command")))
    last = c.groupBy("image_id", "ord").agg(closing.alias("closed"), F.max("seq").alias("touched"))
    done = commands.where("command = 'finish'").groupBy("image_id").agg(F.min("seq").alias("finished"))
    s = rois.join(last, ["image_id", "ord"], "left").join(done, "image_id", "left")
    state = F.when(F.col("closed.command") == "verify", "verified").when(F.col("closed.command") == "skip", "skipped").when(F.col("finished").isNotNull(), "dropped").when(F.col("touched").isNotNull(), "active").otherwise("suggested")
    return s.select("image_id", "ord", state.alias("state"))


def label_flags(images: DataFrame, px: DataFrame, rois: DataFrame, seeds: DataFrame) -> DataFrame:
    """(image_id, reference, negative, seeded, verified, provisional): what an image has to be judged by. Verified ROIs count, provisional ones (suggested, not yet confirmed) don't."""
    own = px.groupBy("image_id").agg((F.max("ref") == 1).alias("reference"), (F.max("neg") == 1).alias("negative"))
    fine = F.coalesce(F.col("verified"), F.lit(True))
    r = rois.groupBy("image_id").agg(F.bool_or(fine).alias("verified"), F.bool_or(~fine).alias("provisional"))
    s = seeds.select("image_id").distinct().withColumn("seeded", F.lit(True))
    out = images.select("image_id").distinct()
    for part in (own, s, r):
        out = out.join(part, "image_id", "left")
    return out.select("image_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("reference", "negative", "seeded", "verified", "provisional")])


def screen_to_preview(sx: Column, sy: Column, left: float, top: float, scale: float, width: int, height: int) -> tuple[Column, Column]:
    """Pixel under a screen point; null outside the image."""
    x, y = F.floor((sx - left) / scale).cast("int"), F.floor((sy - top) / scale).cast("int")
    there = (x >= 0) & (y >= 0) & (x < width) & (y < height)
    return F.when(there, x), F.when(there, y)


def append_history(history: DataFrame, row: DataFrame, cap: int = 100) -> DataFrame:
    """The newest ``cap`` evaluations, the feature's bound, after one more."""
    from .edits import history_tail

    return history_tail(history.unionByName(row, allowMissingColumns=True), cap, ["timestamp"])


def bundle(report: dict, images: dict[str, tuple[int, int, bytes]], when: dt.datetime) -> bytes:
    """A diagnostic bundle of one image: manifest, report and PNGs (width, height, RGBA bytes) in a stored archive."""
    entries = [("diagnostic.json", json.dumps(report, indent=2, sort_keys=True).encode())]
    entries += [(f"{name}.png", png(*image)) for name, image in sorted(images.items())]
    manifest = {"createdAt": when.isoformat(), "files": [{"name": n, "size": len(d)} for n, d in entries]}
    return stored_zip([("manifest.json", json.dumps(manifest, indent=2).encode()), *entries], when)
