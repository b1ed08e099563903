"""Seeds in closed regions, and the holdouts of regions, components and cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import Params
from ..functions.pixel import edge_sides, js_round, opposite_edges
from ..plans.graph import shuffled
from .components import closed_regions, label_pixels, pixels_of, runs_at
from .windows import dilate, separable_many

U32 = 0xFFFFFFFF  # the multipliers below are fixed values


def _wrapped(c: Column) -> Column:
    """The low 32 bits of a product, as the shifts and xors of 32-bit arithmetic see them."""
    return c.cast("long").bitwiseAND(U32)


def classify_seeds(px: DataFrame, seeds: DataFrame, conf: Params, regions: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """seeds (image_id, ord, x, y, border_assisted) with label, region_pixels, fill_pixels, uses_border and reason (null: accepted). Needs ref, w and h.

    Checks go in the reference order; of several seeds that pass in one region the first counts. regions: closed_regions() of px, to label once for
    several uses.
    """
    r, index = regions or closed_regions(px, conf.fill_safety)
    at = runs_at(seeds.select("image_id", "y", "x").distinct(), r)
    sizes = px.groupBy("image_id").agg(F.first("w").alias("w"), F.first("h").alias("h"))
    s = seeds.join(F.broadcast(sizes), "image_id").join(at, ["image_id", "y", "x"], "left").join(shuffled(index, "image_id", "root"), ["image_id", "root"], "left")
    total = F.col("w") * F.col("h")
    most, border_most = F.greatest(F.lit(1), F.floor(total * conf.fill_max_area)), F.greatest(F.lit(1), F.floor(total * min(conf.fill_max_area, conf.fill_border_max_area)))
    edge = F.col("edge_mask")
    border = F.col("border_assisted") & (edge > 0)
    reason = (
        F.when((F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") >= F.col("w")) | (F.col("y") >= F.col("h")), "seed-outside")
        .when(F.col("root").isNull(), "seed-on-boundary")
        .when(F.col("size") > most, "region-too-large")
        .when((edge > 0) & ~F.col("border_assisted"), "open-region")
        .when(border & (F.col("size") > border_most), "border-region-too-large")
        .when(border & ((edge_sides(edge) > conf.fill_max_sides) | opposite_edges(edge)), "border-too-many-sides")
        .when(border & (F.col("contacts") < conf.fill_min_contact), "border-insufficient-reference")
        .when(F.col("safe_size") < conf.fill_min_pixels, "region-too-small")
    )
    s = s.withColumn("_why", reason)
    first = F.row_number().over(Window.partitionBy("image_id", F.when(F.col("_why").isNull(), F.col("root")), F.col("_why").isNull()).orderBy("ord"))
    why = F.coalesce("_why", F.when(first > 1, "duplicate-region"))
    return s.withColumn("reason", why).select("image_id", "ord", "x", "y", "border_assisted", "root", "label", F.coalesce("size", F.lit(0)).alias("region_pixels"), F.when(F.col("reason").isNull() | (F.col("reason") == "region-too-small"), F.col("safe_size")).otherwise(0).alias("fill_pixels"), (F.col("reason").isNull() & (edge > 0)).alias("uses_border"), "reason")


def fill_mask(px: DataFrame, seeds: DataFrame, conf: Params, regions: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """px with ``fill``: the accepted regions, less what lies within the safety distance of the reference. regions: as of classify_seeds()."""
    regions = regions or closed_regions(px, conf.fill_safety)
    ok = classify_seeds(px, seeds, conf, regions).where("reason IS NULL").select("image_id", "root").distinct()
    hit = pixels_of(regions[0].join(ok, ["image_id", "root"], "left_semi")).withColumn("_hit", F.lit(1))
    df = dilate(px, "ref", "_safe", conf.fill_safety).join(shuffled(hit, "image_id", "y", "x"), ["image_id", "y", "x"], "left")
    return df.withColumn("fill", F.when((F.col("_hit") == 1) & (F.col("_safe") == 0), 1).otherwise(0)).drop("_hit", "_safe")


def region_hash(x: Column, y: Column, label: Column, pixels: Column) -> Column:
    """A region's place in the holdout order."""
    parts = [_wrapped((js_round(x) + 1) * 73856093), _wrapped((js_round(y) + 1) * 19349663), _wrapped((label + 1) * 83492791), _wrapped((pixels + 1) * 2654435761)]
    return parts[0].bitwiseXOR(parts[1]).bitwiseXOR(parts[2]).bitwiseXOR(parts[3]).bitwiseAND(U32)


def region_holdout(accepted: DataFrame, fraction: float = 0.2) -> DataFrame:
    """Accepted seeds with ``validation``: whole regions, in hash order, a share of them but never all or none of two."""
    n = F.count("*").over(Window.partitionBy("image_id"))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("hash", "label"))
    a = accepted.withColumn("hash", region_hash(F.col("x"), F.col("y"), F.col("label"), F.col("fill_pixels"))).withColumns({"_n": n, "_r": rank})
    want = F.when(F.col("_n") >= 2, F.least(F.greatest(js_round(F.col("_n") * fraction), F.lit(1)), F.col("_n") - 1)).otherwise(0)
    return a.withColumn("validation", F.col("_r") <= want).drop("_n", "_r")


def component_holdout(px: DataFrame, mask: str = "ref", fraction: float = 0.2, least: int = 8) -> DataFrame:
    """(image_id, root, size, hash, validation) of the 8-connected components: in hash order until a share of the pixels is reached, never all."""
    lab = label_pixels(px, F.col(mask) == 1, 8)
    c = lab.groupBy("image_id", "root").agg(F.count("*").alias("size"), F.avg("x").alias("cx"), F.avg("y").alias("cy")).where(F.col("size") >= least)
    h = _wrapped(js_round(F.col("cx")) * 73856093).bitwiseXOR(_wrapped(js_round(F.col("cy")) * 19349663)).bitwiseXOR(_wrapped(F.col("size") * 83492791)).bitwiseAND(U32)
    order = Window.partitionBy("image_id").orderBy("hash", "root")
    c = c.withColumn("hash", h).withColumns({"_before": F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_r": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy("image_id")), "_all": F.sum("size").over(Window.partitionBy("image_id"))})
    target = F.greatest(F.lit(1), js_round(F.col("_all") * fraction))
    return c.select("image_id", "root", "size", "hash", ((F.col("_n") >= 2) & (F.col("_r") <= F.col("_n") - 1) & ((F.col("_r") == 1) | (F.col("_before") < target))).alias("validation"))


def spatial_holdout(px: DataFrame, mask: str = "ref", fraction: float = 0.2, cols: int = 4, rows: int = 4) -> DataFrame:
    """(image_id, subset, pixels, cells): the subset of grid cells (a bit each, in cell order) whose pixels and cells come nearest to a share.

    All subsets of an image's active cells are rows of one job; cells are at most ``cols * rows``, so their number is fixed.
    """
    cell = F.least(F.floor(F.col("y") * rows / F.col("h")), F.lit(rows - 1)) * cols + F.least(F.floor(F.col("x") * cols / F.col("w")), F.lit(cols - 1))
    c = px.where(F.col(mask) == 1).groupBy("image_id", cell.cast("int").alias("cell")).agg(F.count("*").alias("n"))
    g = c.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("cells"), F.sum("n").alias("total")).where(F.size("cells") >= 2)
    s = g.withColumn("subset", F.explode(F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2.0), F.size("cells")).cast("long") - 2)))
    # plain sums over the cells' bits, in generated code; only subsets that tie are folded
    bit = lambda i: F.shiftright("subset", i).bitwiseAND(1)
    sums = [bit(i) * F.coalesce(F.get("cells", F.lit(i))["n"], F.lit(0)) for i in range(cols * rows)]
    target, want = F.greatest(F.lit(1), js_round(F.col("total") * fraction)), F.greatest(F.lit(1), js_round(F.size("cells") * fraction))
    s = s.select("image_id", "subset", "cells", "total", reduce(lambda a, b: a + b, sums).alias("pixels"), F.bit_count("subset").cast("long").alias("many"))
    s = s.withColumn("error", F.struct(F.abs(F.col("pixels") - target), F.abs(F.col("many") - want)))
    least = s.groupBy("image_id").agg(F.min("error").alias("error"))
    s = s.join(least, ["image_id", "error"])
    start = F.struct(F.lit(0).alias("i"), F.lit(2166136261).cast("long").alias("tie"))

    def add(acc: Column, v: Column) -> Column:
        on = F.col("subset").bitwiseAND(F.pow(F.lit(2.0), acc["i"]).cast("long")) > 0
        mixed = F.pmod(acc["tie"].bitwiseXOR(((v["cell"] + 1).cast("long") * 16777619).bitwiseAND(U32)).bitwiseAND(U32) * 16777619, F.lit(1 << 32))
        return F.struct((acc["i"] + 1).alias("i"), F.when(on, mixed).otherwise(acc["tie"]).alias("tie"))

    rank = F.struct(F.aggregate("cells", start, add)["tie"], F.col("subset"))
    return s.groupBy("image_id").agg(F.min_by(F.struct("subset", "pixels", "many"), rank).alias("b")).select("image_id", "b.subset", "b.pixels", F.col("b.many").alias("cells"))


def negative_holdout(px: DataFrame, seeds: DataFrame, conf: Params, line: str = "neg_line", radius: int = 2, fraction: float = 0.2, least: int = 20) -> DataFrame:
    """px with neg_tune and neg_validation (0/1): negatives drawn by hand (``line``) and closed regions, each held out as wholes. Needs ref, w and h.

    Lines are split by component and widened by ``radius`` if the held out ones have ``least`` pixels, closed regions if any is held out; what isn't
    split is for tuning. Neither covers the reference. An image whose validation has fewer than ``least`` pixels in all has none.
    """
    key = ["image_id", "y", "x"]
    comps = component_holdout(px, line, fraction).where("validation")
    enough = comps.groupBy("image_id").agg(F.sum("size").alias("n")).where(F.col("n") >= least).select("image_id")
    held = comps.join(enough, "image_id", "left_semi").select("image_id", "root", F.lit(1).alias("_held"))
    drawn = label_pixels(px.select(*key, line), F.col(line) == 1, 8).join(shuffled(held, "image_id", "root"), ["image_id", "root"], "left").select(*key, F.coalesce("_held", F.lit(0)).alias("_held"))
    regions = closed_regions(px, conf.fill_safety)
    ok = region_holdout(classify_seeds(px, seeds, conf, regions).where("reason IS NULL"), fraction)
    closed = pixels_of(shuffled(regions[0], "image_id", "root").join(ok.select("image_id", "root", F.col("validation").cast("int").alias("_out")), ["image_id", "root"]), "_out")
    df = px.join(shuffled(drawn, *key), key, "left").join(shuffled(closed, *key), key, "left")
    df = separable_many(df, {"_mt": (F.coalesce(1 - F.col("_held"), F.lit(0)), radius, F.max), "_mv": (F.coalesce("_held", F.lit(0)), radius, F.max), "_safe": ("ref", conf.fill_safety, F.max)})
    free, fill = F.col("ref") == 0, F.col("_out").isNotNull() & (F.col("_safe") == 0)
    tune, validation = free & ((F.col("_mt") == 1) | (fill & (F.col("_out") == 0))), free & ((F.col("_mv") == 1) | (fill & (F.col("_out") == 1)))
    df = df.withColumns({"neg_tune": F.coalesce(tune, F.lit(False)).cast("int"), "neg_validation": F.coalesce(validation, F.lit(False)).cast("int")}).drop("_held", "_out", "_mt", "_mv", "_safe")
    fine = df.groupBy("image_id").agg(F.sum("neg_validation").alias("n")).where(F.col("n") >= least).select("image_id", F.lit(1).alias("_fine"))
    df = df.join(F.broadcast(fine), "image_id", "left")
    return df.withColumn("neg_validation", F.col("neg_validation") * F.coalesce("_fine", F.lit(0))).drop("_fine")


def holdout_summary(split: DataFrame) -> DataFrame:
    """(image_id, tuning_pixels, validation_pixels, mode) of negative_holdout()."""
    g = split.groupBy("image_id").agg(F.sum("neg_tune").alias("tuning_pixels"), F.sum("neg_validation").alias("validation_pixels"))
    mode = F.when(F.col("validation_pixels") > 0, "independent-region-holdout").when(F.col("tuning_pixels") > 0, "validation-unavailable").otherwise("no-negative-labels")
    return g.withColumn("mode", mode)
