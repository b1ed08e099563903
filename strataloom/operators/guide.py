"""Where to label next: grid cells ranked by what the metrics lack, and drawn by a seeded shuffle at the start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixel import cell_of, clamp, clamp01, js_round, ratio

U32 = 0xFFFFFFFF


def grid(images: DataFrame, cols: int = 8, rows: int = 8) -> DataFrame:
    """Cells (image_id, w, h, rx, ry, x0, y0, x1, y1) with half-open bounds. images (image_id, w, h)."""
    g = images.select("image_id", "w", "h", F.explode(F.sequence(F.lit(0), F.lit(cols * rows - 1))).alias("_i"))
    g = g.select("image_id", "w", "h", (F.col("_i") % cols).cast("int").alias("rx"), F.floor(F.col("_i") / cols).cast("int").alias("ry"))
    at = lambda i, size, n: F.floor(i * F.col(size) / n).cast("int")
    return g.withColumns({"x0": at(F.col("rx"), "w", cols), "x1": at(F.col("rx") + 1, "w", cols), "y0": at(F.col("ry"), "h", rows), "y1": at(F.col("ry") + 1, "h", rows)})


def to_roi(cells: DataFrame) -> DataFrame:
    """Cells with their ROI: most of the cell, within fixed sizes, centred, inside the image."""
    tw = F.least(F.col("w"), clamp(js_round(F.greatest(F.lit(1), F.col("x1") - F.col("x0")) * 0.85), 140, 240))
    th = F.least(F.col("h"), clamp(js_round(F.greatest(F.lit(1), F.col("y1") - F.col("y0")) * 0.85), 100, 180))
    rx0 = F.least(F.greatest(js_round((F.col("x0") + F.col("x1") - 1) / 2 - tw / 2), F.lit(0)), F.greatest(F.lit(0), F.col("w") - tw))
    ry0 = F.least(F.greatest(js_round((F.col("y0") + F.col("y1") - 1) / 2 - th / 2), F.lit(0)), F.greatest(F.lit(0), F.col("h") - th))
    return cells.withColumns({"roi_x0": rx0.cast("int"), "roi_y0": ry0.cast("int"), "roi_x1": F.least(F.col("w") - 1, rx0 + tw - 1).cast("int"), "roi_y1": F.least(F.col("h") - 1, ry0 + th - 1).cast("int")})


def rois_to_cells(rois: DataFrame, cols: int = 8, rows: int = 8) -> DataFrame:
    """(image_id, rx, ry) cells that ROIs (x0, y0, x1, y1, w, h, cell_rx, cell_ry) occupy: the stored cell, else the centre's."""
    c = lambda a, b, size, n: clamp(F.floor((F.col(a) + F.col(b)) / 2 / F.greatest(F.lit(1), F.col(size)) * n), 0, n - 1)
    return rois.select("image_id", F.coalesce("cell_rx", c("x0", "x1", "w", cols)).cast("int").alias("rx"), F.coalesce("cell_ry", c("y0", "y1", "h", rows)).cast("int").alias("ry")).distinct()


def repaired(rois: DataFrame, cols: int = 8, rows: int = 8) -> DataFrame:
    """ROIs whose coordinates are null or not numbers take their cell's instead."""
    bad = F.lit(False)
    for c in ("x0", "y0", "x1", "y1"):
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    at = lambda i, size, n: F.floor(F.coalesce(i, F.lit(0)) * F.col(size) / n)
    new = {"x0": at(F.col("cell_rx"), "w", cols), "x1": at(F.col("cell_rx") + 1, "w", cols) - 1, "y0": at(F.col("cell_ry"), "h", rows), "y1": at(F.col("cell_ry") + 1, "h", rows) - 1}
    return rois.withColumn("_bad", bad).withColumns({k: F.when(F.col("_bad"), v).otherwise(F.col(k)).cast("int") for k, v in new.items()}).drop("_bad")


def exclusion_ratio(px: DataFrame, cols: int = 8, rows: int = 8) -> DataFrame:
    """(image_id, rx, ry, excluded) share of excluded pixels in each cell. Needs excl, w and h."""
    return px.groupBy("image_id", cell_of("x", F.col("w"), cols).alias("rx"), cell_of("y", F.col("h"), rows).alias("ry")).agg(F.avg(F.col("excl").cast("double")).alias("excluded"))


def coverage(rois: DataFrame, cols: int = 8, rows: int = 8) -> DataFrame:
    """Verified ROIs, the distinct cells they occupy and the share of the grid. A ROI is verified unless it says it isn't."""
    v = rois.where(F.coalesce("verified", F.lit(True)))
    return v.groupBy("image_id").agg(F.count("*").alias("verified"), F.countDistinct("cell_rx", "cell_ry").alias("cells")).withColumn("share", F.col("cells") / (cols * rows))


def nearest_occupied(cells: DataFrame, occupied: DataFrame) -> DataFrame:
    """Cells with their Chebyshev distance to the nearest occupied cell; 8 without any. Both sides are at most a grid an image."""
    o = occupied.select("image_id", F.col("rx").alias("orx"), F.col("ry").alias("ory"))
    d = cells.join(o, "image_id").groupBy("image_id", "rx", "ry").agg(F.min(F.greatest(F.abs(F.col("rx") - F.col("orx")), F.abs(F.col("ry") - F.col("ory")))).alias("distance"))
    return cells.join(d, ["image_id", "rx", "ry"], "left").withColumn("distance", F.coalesce("distance", F.lit(8)))


def active_scores(regions: DataFrame, occupied: DataFrame, verified: Column, rollback: bool = False) -> DataFrame:
    """Unoccupied cells with a reason to be labelled, their role and score.

    regions: metrics.regional() with cells and image rows on one grid, bounds (x0..y1), risk (of the local calibration) and prediction_pixels; verified: how many ROIs stand.
    """
    whole = regions.where("rx IS NULL").select("image_id", F.col("recall").alias("g_recall"))
    neg = F.col("negative_pixels") > 0
    macro = regions.where("rx IS NOT NULL").groupBy("image_id").agg(F.coalesce(F.avg(F.when(neg, F.col("leakage"))), F.lit(0.0)).alias("g_leakage"))
    df = regions.where("rx IS NOT NULL").join(occupied, ["image_id", "rx", "ry"], "left_anti").join(whole, "image_id").join(macro, "image_id")
    df = nearest_occupied(df, occupied)
    area = F.greatest(F.lit(1), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    reference = F.col("matched_reference") + F.col("false_negative")
    dense = F.col("prediction_pixels") / area
    excess = dense - reference / area * 1.35
    recall_gap = F.when(reference >= 20, F.greatest(F.lit(0.0), F.col("g_recall") - F.col("recall"))).otherwise(0.0)
    leak_gap = F.when(F.col("negative_pixels") >= 20, F.greatest(F.lit(0.0), F.col("leakage") - F.col("g_leakage"))).otherwise(0.0)
    cover = (verified < 6) & (F.col("distance") >= 3)
    df = df.where(F.col("excluded_pixels") / area < 0.60).withColumns({"recall_gap": recall_gap, "leak_gap": leak_gap, "density": dense, "excess": excess, "_cover": cover})
    df = df.where((F.col("recall_gap") > 0.05) | (F.col("leak_gap") > 0.03) | ((F.col("density") > 0.015) & (F.col("excess") > 0.008)) | (F.col("risk") >= 3) | F.col("_cover"))
    parts = (("low-recall", clamp01((F.col("recall_gap") - 0.05) / 0.20), 0.30), ("high-leakage", clamp01((F.col("leak_gap") - 0.03) / 0.20), 0.25), ("fp-suspect", clamp01((F.col("excess") - 0.008) / 0.05), 0.25), ("local-risk", clamp01((F.col("risk") - 3) / 12.0), 0.12), ("coverage", F.when(F.col("_cover"), clamp01((F.col("distance") - 1) / 4.0)).otherwise(0.0), 0.08))
    top = F.greatest(*[p for _, p, _ in parts])
    role = F.lit(None).cast("string")
    for name, p, _ in reversed(parts):
        role = F.when(p == top, name).otherwise(role)
    score = sum((p * w for _, p, w in parts), F.lit(0.08 if rollback else 0.0))
    return df.withColumns({"role": role, "score": score}).drop("_cover")


def spaced(candidates: DataFrame, count: int = 3) -> DataFrame:
    """The first ``count`` candidates by ``rank``, two cells apart where that leaves enough: a fold over at most one grid an image."""
    g = candidates.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("rank", "rx", "ry"))).alias("c"))
    kind = "array<struct<rank:int,rx:int,ry:int>>"
    empty = F.from_json(F.lit("[]"), kind)

    def take(far: bool):
        def step(acc, v):
            close = F.exists(acc, lambda s: F.greatest(F.abs(s["rx"] - v["rx"]), F.abs(s["ry"] - v["ry"])) < (2 if far else 1))
            v = F.struct(v["rank"].cast("int").alias("rank"), v["rx"].cast("int").alias("rx"), v["ry"].cast("int").alias("ry"))
            return F.when((F.size(acc) < count) & ~close, F.concat(acc, F.array(v))).otherwise(acc)

        return step

    g = g.withColumn("s", F.aggregate("c", empty, take(True))).withColumn("s", F.aggregate("c", F.col("s"), take(False)))
    return g.select("image_id", F.posexplode("s").alias("i", "v")).select("image_id", (F.col("i") + 1).alias("selection_rank"), "v.rx", "v.ry")


def active(regions: DataFrame, occupied: DataFrame, verified: Column, count: int = 3, rollback: bool = False, most: int = 9) -> DataFrame:
    """The chosen cells with role and score; none once ``most`` ROIs are verified."""
    s = active_scores(regions, occupied, verified, rollback).where(verified < most)
    order = Window.partitionBy("image_id").orderBy(F.desc(F.round("score", 9)), "ry", "rx")
    s = s.withColumn("rank", F.row_number().over(order))
    return s.join(spaced(s, count), ["image_id", "rx", "ry"]).select("image_id", "selection_rank", "rx", "ry", "role", "score")


def reference_guided(regions: DataFrame, occupied: DataFrame, count: int = 3, least: int = 20) -> DataFrame:
    """Cells of lowest recall, highest leakage and nearest to the whole, then by most reference; each cell once."""
    whole = regions.where("rx IS NULL").select("image_id", F.col("recall").alias("g_recall"), F.col("leakage").alias("g_leakage"))
    ref = F.col("matched_reference") + F.col("false_negative")
    u = regions.where("rx IS NOT NULL").withColumn("reference", ref).where(F.col("reference") >= least).join(occupied, ["image_id", "rx", "ry"], "left_anti").join(whole, "image_id")
    near = F.abs(F.col("recall") - F.col("g_recall")) + F.abs(F.col("leakage") - F.col("g_leakage"))
    w = lambda *o: F.row_number().over(Window.partitionBy("image_id").orderBy(*o, "ry", "rx"))
    picks = u.withColumn("pri", F.lit(0)).withColumn("role", F.lit("low-recall")).withColumn("n", w("recall")).where("n = 1")
    picks = picks.unionByName(u.where("negative_pixels > 0").withColumn("pri", F.lit(1)).withColumn("role", F.lit("high-leakage")).withColumn("n", w(F.desc("leakage"))).where("n = 1"))
    picks = picks.unionByName(u.withColumn("pri", F.lit(2)).withColumn("role", F.lit("representative")).withColumn("n", w(near)).where("n = 1"))
    picks = picks.unionByName(u.withColumn("role", F.lit("representative")).withColumn("n", w(F.desc("reference"))).withColumn("pri", F.col("n") + 2))
    once = picks.withColumn("k", F.row_number().over(Window.partitionBy("image_id", "rx", "ry").orderBy("pri"))).where("k = 1")
    return once.withColumn("selection_rank", w("pri")).where(F.col("selection_rank") <= count).select("image_id", "selection_rank", "rx", "ry", "role")


def string_hash(text: str) -> int:
    """32-bit FNV-1a over UTF-16 units."""
    h = 0x811C9DC5
    raw = text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x01000193) & U32
    return h


class SeededRandom:
    """The reproducible generator of the shuffles: 32-bit state, numbers in [0, 1)."""

    def __init__(self, seed: int) -> None:
        self.state = seed & U32

    def __call__(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & U32
        t = self.state
        t = ((t ^ (t >> 15)) * (t | 1)) & U32
        t = (t ^ ((t + (((t ^ (t >> 7)) * (t | 61)) & U32)) & U32)) & U32
        return (t ^ (t >> 14)) / 4294967296


def shuffled(items: list, random: SeededRandom) -> list:
    out = list(items)
    for i in range(len(out) - 1, 0, -1):
        j = int(random() * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def bootstrap(cells: DataFrame, fingerprint: str, round_: int = 0, count: int = 3) -> DataFrame:
    """The first cells to label: free cells (image_id, rx, ry) in seeded order, two apart where possible. Grouped by image, a grid each."""
    import pandas as pd

    kind = dict(cells.dtypes)["image_id"]

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ry", "rx"])
        order = shuffled(list(zip(rows["rx"].tolist(), rows["ry"].tolist(), strict=True)), SeededRandom(string_hash(f"{fingerprint}|precision-bootstrap-v2|{round_}")))
        chosen: list = []
        for far in (2, 1):
            for c in order:
                if len(chosen) < count and all(max(abs(c[0] - o[0]), abs(c[1] - o[1])) >= far for o in chosen):
                    chosen.append(c)
        return pd.DataFrame([(rows["image_id"].iloc[0], i + 1, x, y) for i, (x, y) in enumerate(chosen)], columns=["image_id", "selection_rank", "rx", "ry"])

    return cells.select("image_id", "rx", "ry").groupBy("image_id").applyInPandas(pick, f"image_id {kind}, selection_rank int, rx int, ry int")
