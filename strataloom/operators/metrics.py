"""Partial-label, regional, multi-tolerance and ROI metrics, feature statistics. Counters first, ratios on the few result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixel import cell_of, ratio
from .labels import error_masks, label_state, rect_pairs, with_bands
from .windows import chebyshev_distance, chebyshev_distances, separable_many


def counters() -> list[Column]:
    """The counters of a scene with errors, in one pass."""
    ref, s = F.col("ref") == 1, F.col("state")
    there = ref & (s != "excluded")
    return [
        F.sum("tp").alias("matched_prediction"), F.sum("fp").alias("false_positive"), F.sum("unknown_prediction").alias("unknown_prediction"),
        F.count_if(there & (F.col("pred_band") == 1)).alias("matched_reference"), F.sum("fn").alias("false_negative"),
        F.count_if(s == "negative").alias("negative_pixels"), F.count_if(s == "excluded").alias("excluded_pixels"),
    ]


def ratios(df: DataFrame) -> DataFrame:
    """Recall, leakage, label precision and F1; 0 on empty denominators."""
    c = F.col
    df = df.withColumns({
        "recall": ratio(c("matched_reference"), c("matched_reference") + c("false_negative")),
        "leakage": ratio(c("false_positive"), c("negative_pixels")),
        "label_precision": ratio(c("matched_prediction"), c("matched_prediction") + c("false_positive")),
    })
    return df.withColumn("label_f1", ratio(2 * c("label_precision") * c("recall"), c("label_precision") + c("recall")))


def compare(scene: DataFrame, tolerance: int) -> DataFrame:
    """A row for each image."""
    return ratios(error_masks(with_bands(scene, tolerance)).groupBy("image_id").agg(*counters()))


def regional(scene: DataFrame, tolerance: int, cols: int = 4, rows: int = 4, review_radius: int | None = None) -> DataFrame:
    """Counters and ratios of each image (rx and ry null) and of each of its cells, by grouping sets: one scan, one shuffle. Needs w and h.

    With a review radius there is also alignment_error: how far reference pixels are from a prediction, on average, as far as it reaches; exclusions
    are in the way.
    """
    more = []
    if review_radius is not None:
        clean = scene.withColumn("clean", F.when(F.col("excl") == 1, 0).otherwise(F.col("pred")))
        scene = chebyshev_distance(clean, "clean", "d", review_radius, "excl", ("pred", "ref", "neg"))
        more = [F.avg(F.when((F.col("ref") == 1) & (F.col("excl") == 0), F.col("d"))).alias("alignment_error")]
    df = error_masks(with_bands(scene, tolerance)).withColumns({"rx": cell_of("x", F.col("w"), cols), "ry": cell_of("y", F.col("h"), rows)})
    return ratios(df.groupingSets([["image_id", "rx", "ry"], ["image_id"]], "image_id", "rx", "ry").agg(*counters(), *more))


def macro(regions: DataFrame) -> DataFrame:
    """Second-level figures of regional(): mean leakage over cells with negatives, mean F1 over cells with reference, largest share of negatives."""
    cells = regions.where("rx IS NOT NULL")
    neg = F.col("negative_pixels") > 0
    return cells.groupBy("image_id").agg(
        F.coalesce(F.avg(F.when(neg, F.col("leakage"))), F.lit(0.0)).alias("macro_leakage"),
        F.avg(F.when(F.col("matched_reference") + F.col("false_negative") > 0, F.col("label_f1"))).alias("macro_f1"),
        ratio(F.max("negative_pixels"), F.sum("negative_pixels")).alias("max_negative_share"),
    )


def multi_tolerance(scene: DataFrame, tolerances: list[int]) -> DataFrame:
    """compare() at several tolerances: a row for each image and tolerance. A distance of each pixel to the reference and the prediction answers all of them. Needs w and h."""
    clean = scene.withColumn("clean", F.when(F.col("excl") == 1, 0).otherwise(F.col("pred")))
    d = chebyshev_distances(clean, {"to_ref": ("ref", None), "to_pred": ("clean", None)}, max(tolerances), ("neg", "excl"))
    df = d.withColumn("tolerance", F.explode(F.array(*[F.lit(t) for t in tolerances])))
    df = df.withColumns({"ref_band": F.coalesce((F.col("to_ref") <= F.col("tolerance")).cast("int"), F.lit(0)), "pred_band": F.coalesce((F.col("to_pred") <= F.col("tolerance")).cast("int"), F.lit(0))})
    df = error_masks(df.withColumn("state", label_state(F.col("ref_band"), F.col("neg"), F.col("excl"))))
    return ratios(df.groupBy("image_id", "tolerance").agg(*counters()))


def alignment(scene: DataFrame, tolerance: int, review_radius: int, walls: bool = True) -> DataFrame:
    """Distance from reference to prediction: mean, nearest-rank median and 90th percentile, matched and unmatched pixels. Exclusions are in the way, or with ``walls`` off only left out. Needs w and h."""
    reach = max(tolerance + 1, review_radius)
    df = scene.withColumn("clean", F.when(F.col("excl") == 1, 0).otherwise(F.col("pred")))
    df = chebyshev_distance(df, "clean", "d", reach, "excl" if walls else None, ("ref", "excl")).where((F.col("ref") == 1) & (F.col("excl") == 0))
    # a histogram of the few distances: its size doesn't grow with the image
    hist = df.groupBy("image_id", "d").agg(F.count("*").alias("n"))
    whole = hist.groupBy("image_id").agg(F.coalesce(F.sum(F.when(F.col("d").isNotNull(), F.col("n"))), F.lit(0)).alias("matched"), F.coalesce(F.sum(F.when(F.col("d").isNull(), F.col("n"))), F.lit(0)).alias("unmatched"), F.sum(F.col("d") * F.col("n")).alias("s"), F.array_sort(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "n")))).alias("h"))

    def rank(q: float) -> Column:
        at = F.floor((F.col("matched") - 1) * q + 0.5)
        step = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("d")), lambda acc, v: F.struct((acc["seen"] + v["n"]).alias("seen"), F.when(acc["d"].isNull() & (acc["seen"] + v["n"] > at), v["d"].cast("int")).otherwise(acc["d"]).alias("d")))
        return F.when(F.col("matched") > 0, step["d"])

    return whole.select("image_id", ratio(F.col("s"), F.col("matched"), None).alias("mean"), rank(0.5).alias("median"), rank(0.9).alias("p90"), "matched", "unmatched")


def roi_metrics(scene: DataFrame, rects: DataFrame, tolerance: int = 1) -> DataFrame:
    """Precision, recall and F1 of each ROI (roi -1: their union, where overlaps count once); both masks are clipped before they are widened."""
    r = rects.select(F.col("image_id").alias("r_image"), F.col("ord").alias("roi"), "x0", "y0", "x1", "y1")
    inside = ((F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1")) & (F.col("excl") == 0)).cast("int")
    # pixels around a ROI take part as empty ones: the square frames pass through them
    own = rect_pairs(scene.select("image_id", "y", "x", "pred", "ref", "excl"), r, tolerance).select("image_id", "y", "x", "pred", "ref", "roi", inside.alias("inside"))
    union = own.groupBy("image_id", "y", "x").agg(F.first("pred").alias("pred"), F.first("ref").alias("ref"), F.lit(-1).alias("roi"), F.max("inside").alias("inside"))
    both = own.unionByName(union)
    keyed = both.withColumns({"image": F.col("image_id"), "image_id": F.struct("image_id", "roi"), "ref": F.col("ref") * F.col("inside"), "pred": F.col("pred") * F.col("inside")})
    keyed = separable_many(keyed, {"rb": ("ref", tolerance, F.max), "pb": ("pred", tolerance, F.max)}).where("inside = 1")
    m = keyed.groupBy("image", "roi").agg(
        F.count_if((F.col("pred") == 1) & (F.col("rb") == 1)).alias("true_positive"), F.count_if((F.col("pred") == 1) & (F.col("rb") == 0)).alias("false_positive"),
        F.count_if((F.col("ref") == 1) & (F.col("pb") == 1)).alias("matched_reference"), F.count_if((F.col("ref") == 1) & (F.col("pb") == 0)).alias("false_negative"), F.count("*").alias("evaluated_pixels"),
    ).withColumnRenamed("image", "image_id")
    c = F.col
    m = m.withColumns({"precision": ratio(c("true_positive"), c("true_positive") + c("false_positive")), "recall": ratio(c("matched_reference"), c("matched_reference") + c("false_negative"))})
    return m.withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def feature_statistics(df: DataFrame, features: list[str]) -> DataFrame:
    """Per error class and feature: count, mean, population deviation and interpolated quantiles. df: a scene with errors and features."""
    kind = F.when(F.col("tp") == 1, "tp").when(F.col("fp") == 1, "fp").when(F.col("fn") == 1, "fn").when(F.col("unknown_prediction") == 1, "unknown")
    long = df.select(kind.alias("class"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("e")).where("class IS NOT NULL").select("class", "e.feature", "e.v")
    q = F.percentile("v", [0.1, 0.25, 0.5, 0.75, 0.9])
    return long.groupBy("class", "feature").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), q.alias("q")).select("class", "feature", "n", "mean", "std", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))])


def region_features(df: DataFrame, features: list[str], cols: int = 4, rows: int = 4) -> DataFrame:
    """Mean of each feature in each cell. Needs w and h."""
    return df.withColumns({"rx": cell_of("x", F.col("w"), cols), "ry": cell_of("y", F.col("h"), rows)}).groupBy("image_id", "rx", "ry").agg(*[F.avg(f).alias(f) for f in features])
