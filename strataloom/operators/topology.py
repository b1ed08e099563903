"""Endpoints, gap candidates and guarded bridging; closure of annotated regions over repair radii."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import Params
from ..functions.pixel import edge_sides, js_round, opposite_edges, ratio
from ..plans.graph import dealt, shuffled, stored
from .components import index_of, label_pixels, labels_and_index, layered_runs, pixels_of, runs_at
from .metrics import macro, regional
from .windows import dilate, endpoint_proxy, erode, separable_many


def endpoints(px: DataFrame, mask: str = "pred", margin: int = 3) -> DataFrame:
    """(image_id, y, x, out_x, out_y): set pixels with exactly one set neighbour, and the unit vector away from it. Needs w and h."""
    df = px.withColumns({"_m": F.col(mask).cast("int"), "_mx": F.col(mask) * F.col("x"), "_my": F.col(mask) * F.col("y")})
    df = separable_many(df, {f"{c}s": (c, 1, F.sum) for c in ("_m", "_mx", "_my")})
    deep = (F.col("x") >= margin) & (F.col("y") >= margin) & (F.col("x") < F.col("w") - margin) & (F.col("y") < F.col("h") - margin)
    df = df.where((F.col(mask) == 1) & deep & (F.col("_ms") == 2))
    tx, ty = 2 * F.col("x") - F.col("_mxs"), 2 * F.col("y") - F.col("_mys")  # away from the one neighbour
    n = F.sqrt(tx * tx + ty * ty)
    return df.select("image_id", "y", "x", (tx / n).alias("out_x"), (ty / n).alias("out_y"))


def gap_interior(c: DataFrame) -> DataFrame:
    """Gaps with their interior pixels (step, x, y), rounded along the line."""
    steps = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    df = c.withColumn("_n", steps).where("_n > 1").withColumn("step", F.explode(F.sequence(F.lit(1), F.col("_n") - 1)))
    t = F.col("step") / F.col("_n")
    return df.withColumns({"x": js_round(F.col("x1") + (F.col("x2") - F.col("x1")) * t).cast("int"), "y": js_round(F.col("y1") + (F.col("y2") - F.col("y1")) * t).cast("int")}).drop("_n")


def gap_pairs(px: DataFrame, conf: Params, mask: str = "pred", max_distance: float | None = None) -> DataFrame:
    """Endpoint pairs within a distance, with ``facing`` (both cosines suffice) and the place in emission order.

    A band join: endpoints are dealt to cells as wide as the distance; each also looks into the eight around its own.
    """
    far = conf.gap_max_distance if max_distance is None else max_distance
    cell = max(2, math.ceil(far))
    e = endpoints(px, mask).withColumns({"bx": F.floor(F.col("x") / cell), "by": F.floor(F.col("y") / cell)})
    a = e.select("image_id", *[F.col(c).alias(f"a_{c}") for c in ("x", "y", "out_x", "out_y")], "bx", "by")
    a = a.withColumn("oy", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))).withColumn("ox", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])))
    a = a.withColumns({"bx": F.col("bx") + F.col("ox"), "by": F.col("by") + F.col("oy")})
    b = e.select("image_id", *[F.col(c).alias(f"b_{c}") for c in ("x", "y", "out_x", "out_y")], "bx", "by")
    p = a.join(shuffled(b, "image_id", "bx", "by"), ["image_id", "bx", "by"]).where((F.col("b_y") > F.col("a_y")) | ((F.col("b_y") == F.col("a_y")) & (F.col("b_x") > F.col("a_x"))))
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    p = p.withColumn("distance", F.sqrt(dx * dx + dy * dy)).where((F.col("distance") > 1.1) & (F.col("distance") <= far))
    fa = (F.col("a_out_x") * dx + F.col("a_out_y") * dy) / F.col("distance")
    fb = -(F.col("b_out_x") * dx + F.col("b_out_y") * dy) / F.col("distance")
    least = math.cos(math.radians(max(5.0, min(80.0, conf.max_gap_angle_deg))))
    near = 1 - F.least(F.lit(1.0), (F.col("distance") - 1) / max(0.5, far - 1))
    align = F.least(fa, fb)
    return p.select("image_id", F.col("a_x").alias("x1"), F.col("a_y").alias("y1"), F.col("b_x").alias("x2"), F.col("b_y").alias("y2"), "distance", align.alias("alignment"), (align * 0.75 + near * 0.25).alias("score"), F.greatest(F.lit(1), js_round(F.col("distance")) - 1).cast("int").alias("missing"), ((fa >= least) & (fb >= least)).alias("facing"), "oy", "ox")


def gap_scan(px: DataFrame, conf: Params, mode: str = "safe", mask: str = "pred") -> DataFrame:
    """All pairs of ends within a mode's reach with ``facing`` and ``crosses`` (whether a set pixel is between them), stored: what candidates, reviews and counters come from."""
    pairs = stored(gap_pairs(px, conf, mask, reach_of(conf, mode)), "gap-pairs")
    return stored(_crossed(px, pairs, mask), "gap-scan")


def _crossed(px: DataFrame, pairs: DataFrame, mask: str) -> DataFrame:
    set_pixels = px.where(F.col(mask) == 1).select("image_id", "y", "x")
    crossing = gap_interior(pairs.where("facing")).join(shuffled(set_pixels, "image_id", "y", "x"), ["image_id", "y", "x"], "left_semi").select("image_id", "x1", "y1", "x2", "y2", F.lit(True).alias("_x")).distinct()
    return pairs.join(shuffled(crossing, "image_id", "x1", "y1", "x2", "y2"), ["image_id", "x1", "y1", "x2", "y2"], "left").withColumn("crosses", F.coalesce("_x", F.lit(False))).drop("_x")


#: In how many parts of an image a top-k is taken before that of the image, round by round.
TOP_PARTS = (64, 8)


def _first(df: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    """The first pairs of each image by an order without ties, with their rank.

    Taken in parts of an image first, so that no task sorts all pairs of an image: the last round has eight times the limit at most. Spark
    itself takes top-k's ahead of a shuffle only up to spark.sql.optimizer.windowGroupLimitThreshold, 1,000 rows.
    """

    def top(df: DataFrame, *key: str) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= limit)

    for parts in TOP_PARTS:
        part = F.pmod(F.xxhash64("y1", "x1", "y2", "x2"), F.lit(parts))
        df = top(dealt(df.withColumn("_part", part), "image_id", "_part"), "image_id", "_part").drop("_part", "rank")
    return top(df, "image_id")


def ranked_gaps(scan: DataFrame, limit: int | None = 2000) -> DataFrame:
    """Facing pairs across free pixels, ranked by score and distance; ties in order of emission. limit: a top-k for each image."""
    order = [F.desc("score"), "distance", "y1", "x1", "oy", "ox", "y2", "x2"]
    c = scan.where("facing AND NOT crosses")
    c = _first(c, order, limit) if limit else c.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(*order)))
    return c.drop("facing", "crosses", "oy", "ox")


def gap_candidates(px: DataFrame, conf: Params, mask: str = "pred", max_distance: float | None = None, limit: int | None = 2000) -> DataFrame:
    """ranked_gaps() of a mask."""
    return ranked_gaps(_crossed(px, gap_pairs(px, conf, mask, max_distance), mask), limit)


def _evidence(inner: DataFrame, feat: DataFrame) -> DataFrame:
    """Mean ridge and colour evidence along each gap; of a pixel with one of them alone, that one counts in full, one with neither not at all."""
    seen = inner.join(shuffled(feat.select("image_id", "y", "x", "ridge", "color"), "image_id", "y", "x"), ["image_id", "y", "x"])
    weight = F.when(F.col("ridge").isNotNull(), 0.65).otherwise(0.0) + F.when(F.col("color").isNotNull(), 0.35).otherwise(0.0)
    value = (0.65 * F.coalesce(F.col("ridge"), F.lit(0)) + 0.35 * F.coalesce(F.col("color"), F.lit(0))) / 255
    return seen.groupBy("image_id", "rank").agg(F.avg(F.when(weight > 0, value / weight)).alias("evidence"))


def _greedy(limit: int):
    """Accept ranked gaps of one image, each endpoint once; rows come with all set-wise reasons decided."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", ignore_index=True)
        used, drawn, why, added, taken = set(), set(), [], [], 0
        for r in rows.itertuples(index=False):
            ends = {(r.x1, r.y1), (r.x2, r.y2)}
            reason, n = r.early, 0
            if reason is None and used & ends:
                reason = "endpoint-conflict"
            if reason is None:
                reason = r.late
            if reason is None and taken >= limit:
                reason = "limit"
            if reason is None:
                new = {tuple(p) for p in r.path} - drawn if r.path is not None else set()
                n = len(new)
                if n:
                    drawn |= new
                    used |= ends
                    taken += 1
                else:
                    reason = "nothing-added"
            why.append(reason)
            added.append(n)
        out = rows[["image_id", "rank"]].copy()
        out["reason"], out["added"] = why, added
        return out

    return run


def bridge(px: DataFrame, conf: Params, mode: str = "safe", feat: DataFrame | None = None, mask: str = "pred", negative: str | None = "neg", exclusion: str | None = "excl", scan: DataFrame | None = None) -> DataFrame:
    """Ranked gap candidates with ``reason`` (null: accepted), evidence and added pixels.

    What depends on the gap alone (distance, score, empty path, guards, evidence) is decided set-wise; only the matching of
    endpoints is sequential, on at most the top candidates of one image.
    """
    far = reach_of(conf, mode)
    c = ranked_gaps(gap_scan(px, conf, mode, mask) if scan is None else scan, CONSIDERED[mode])
    inner = gap_interior(c)
    paths = inner.groupBy("image_id", "rank").agg(F.collect_set(F.array("x", "y")).alias("path"))
    ends = c.select("image_id", "rank", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("e")).select("image_id", "rank", "e.x", "e.y")
    whole = inner.select("image_id", "rank", "x", "y").unionByName(ends)

    def touched(column: str, radius: int, name: str) -> DataFrame:
        guard = dilate(px, column, "_g", radius).where("_g = 1").select("image_id", "y", "x")
        return whole.join(shuffled(guard, "image_id", "y", "x"), ["image_id", "y", "x"], "left_semi").select("image_id", "rank").distinct().withColumn(name, F.lit(True))

    c = c.join(paths, ["image_id", "rank"], "left")
    for column, radius, name in ((exclusion, 0, "on_exclusion"), (negative, conf.negative_guard_radius, "on_negative")):
        c = c.join(touched(column, radius, name), ["image_id", "rank"], "left") if column else c.withColumn(name, F.lit(None).cast("boolean"))
    if mode == "safe":
        early = F.when(F.col("distance") > conf.gap_apply_max_distance, "distance").when(F.col("score") < conf.min_gap_score, "score")
        late, limit = F.lit(None).cast("string"), 400
        c = c.withColumn("evidence", F.lit(None).cast("double"))
    else:
        early = F.when(F.col("distance") <= conf.gap_apply_max_distance, "safe-range").when(F.col("distance") > far, "distance").when(F.col("score") < conf.extended_min_gap_score, "score")
        late, limit = F.when(F.col("evidence").isNull(), "evidence-unavailable").when(F.col("evidence") < conf.min_path_evidence, "evidence"), 240
        c = c.join(_evidence(inner, feat), ["image_id", "rank"], "left") if feat is not None else c.withColumn("evidence", F.lit(None).cast("double"))
    late = F.when(F.col("path").isNull(), "no-interior-pixels").when(F.col("on_exclusion"), "exclusion").when(F.col("on_negative"), "negative").otherwise(late)
    c = c.withColumns({"early": early, "late": late})
    kind = dict(c.dtypes)["image_id"]
    done = c.select("image_id", "rank", "x1", "y1", "x2", "y2", "early", "late", "path").groupBy("image_id").applyInPandas(_greedy(limit), f"image_id {kind}, rank int, reason string, added int")
    return c.drop("early", "late", "on_exclusion", "on_negative").join(done, ["image_id", "rank"])


#: What a review of a mode holds at most for an image, and how many pairs out of angle are looked at for it.
REVIEWED = {"safe": 360, "extended": 480}
CONSIDERED = {"safe": 2000, "extended": 2400}


def reach_of(conf: Params, mode: str) -> float:
    """How far apart the ends of a mode's gaps may be."""
    return max(conf.gap_max_distance, conf.gap_apply_max_distance) if mode == "safe" else max(conf.gap_apply_max_distance + 0.25, min(8.0, conf.extended_gap_max_distance))


def angle_rejected(scan: DataFrame, mode: str = "safe") -> DataFrame:
    """Pairs within reach that don't face each other, the first of each image in order of emission, with their rank."""
    return _first(scan.where("NOT facing"), ["y1", "x1", "oy", "ox", "y2", "x2"], CONSIDERED[mode]).drop("facing", "crosses", "oy", "ox")


def gap_reviews(bridged: DataFrame, angled: DataFrame, mode: str = "safe") -> DataFrame:
    """(image_id, n, x1, y1, x2, y2, distance, alignment, score, missing, disposition, rejection_reason, evidence, added): what became of each pair, in review order.

    bridged: of bridge(); angled: of angle_rejected(), which comes first. Of the extended mode, what the safe one covers is left out. A top-k for each image.
    """
    columns = ["image_id", "x1", "y1", "x2", "y2", "distance", "alignment", "score", "missing"]
    reason = F.col("reason")
    group = F.when(reason.startswith("evidence"), "evidence").when(reason == "no-interior-pixels", "empty").otherwise(reason)
    judged = bridged.where(reason.isNull() | ~reason.isin("safe-range", "nothing-added"))
    judged = judged.select(*columns, F.lit(1).alias("_turn"), "rank", F.coalesce(F.concat(F.lit("rejected-"), group), F.lit(f"accepted-{mode}")).alias("disposition"), reason.alias("rejection_reason"), "evidence", "added")
    none = angled.select(*columns, F.lit(0).alias("_turn"), "rank", F.lit("rejected-angle").alias("disposition"), F.lit("angle").alias("rejection_reason"), F.lit(None).cast("double").alias("evidence"), F.lit(0).alias("added"))
    n = F.row_number().over(Window.partitionBy("image_id").orderBy("_turn", "rank"))
    return none.unionByName(judged).withColumn("n", n).where(F.col("n") <= REVIEWED[mode]).drop("_turn", "rank")


def gap_counters(scan: DataFrame, bridged: DataFrame, mode: str = "safe") -> DataFrame:
    """A row for each image with any pair: candidates found and considered, whether some were left out, bridges, added pixels, and a count for each reason."""
    most = F.lit(CONSIDERED[mode]).cast("long")
    found = scan.groupBy("image_id").agg(F.count_if(F.col("facing") & ~F.col("crosses")).alias("source_candidates"), F.least(F.count_if(~F.col("facing")), most).alias("n_angle"))
    found = found.where("source_candidates > 0 OR n_angle > 0")
    why = ["distance", "score", "endpoint-conflict", "no-interior-pixels", "exclusion", "negative", "evidence", "evidence-unavailable", "limit", "safe-range"]
    n = lambda r: F.count_if(F.col("reason") == r).alias("n_" + r.replace("-", "_"))
    g = bridged.groupBy("image_id").agg(F.count("*").alias("considered"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.sum(F.when(F.col("reason").isNull(), F.col("added")).otherwise(0)).alias("added_pixels"), *[n(r) for r in why])
    out = found.join(g, "image_id", "left").fillna(0)
    return out.withColumn("truncated", F.col("source_candidates") > F.col("considered"))


def application_log(log: DataFrame) -> DataFrame:
    """(image_id, applied, bridges, pixels) of a log (image_id, seq, action, mode, bridges, pixels): what is drawn after it.

    An ``apply`` adds its gaps to what is drawn, a ``revert`` takes back all that was; applications before the last revert don't count.
    """
    last = F.max(F.when(F.col("action") == "revert", F.col("seq"))).over(Window.partitionBy("image_id"))
    on = (F.col("action") == "apply") & (F.coalesce(last, F.lit(-1)) < F.col("seq"))
    d = log.withColumn("_on", on)
    g = d.groupBy("image_id").agg(F.array_sort(F.collect_list(F.when(F.col("_on"), F.struct("seq", "mode")))).alias("a"), F.coalesce(F.sum(F.when(F.col("_on"), F.col("bridges"))), F.lit(0)).alias("bridges"), F.coalesce(F.sum(F.when(F.col("_on"), F.col("pixels"))), F.lit(0)).alias("pixels"))
    return g.select("image_id", F.transform("a", lambda v: v["mode"]).alias("applied"), "bridges", "pixels")


def apply_bridges(px: DataFrame, bridged: DataFrame, mask: str = "pred", out: str = "bridged") -> DataFrame:
    """px with the mask and all accepted gaps' pixels; the mask itself stays, so dropping the column takes them back."""
    new = bridged.where("reason IS NULL").select("image_id", F.explode("path").alias("p")).select("image_id", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y")).distinct().withColumn("_b", F.lit(1))
    return px.join(new, ["image_id", "y", "x"], "left").withColumn(out, F.greatest(F.col(mask), F.coalesce("_b", F.lit(0)))).drop("_b")


def cores(px: DataFrame, conf: Params, fill: str = "fill", border: str = "border_fill") -> DataFrame:
    """Pixels of eroded fills with core and fill: root, size, allowed edges and whether the border assisted. Needs w and h."""
    df = erode(px, fill, "_core", conf.core_erosion)
    core = label_pixels(df, F.col("_core") == 1, 4).select("image_id", "y", "x", F.col("root").alias("core"))
    n = core.groupBy("image_id", "core").agg(F.count("*").alias("core_size"), F.min(F.struct("y", "x")).alias("f")).where(F.col("core_size") >= conf.min_core_pixels)
    lab, index = labels_and_index(px, F.col(fill) == 1, 4, (border,))
    lab = lab.withColumnRenamed("root", "fill_root")
    index = index.select("image_id", F.col("root").alias("fill_root"), F.col("size").alias("fill_size"), F.col("edge_mask").alias("allowed"))
    flagged = lab.groupBy("image_id", "fill_root").agg((F.max(border) == 1).alias("by_fill"))
    direct = core.join(shuffled(px.select("image_id", "y", "x", border), "image_id", "y", "x"), ["image_id", "y", "x"]).groupBy("image_id", "core").agg((F.max(border) == 1).alias("direct"))
    meta = n.select("image_id", "core", "core_size", F.col("f.y").alias("y"), F.col("f.x").alias("x")).join(shuffled(lab.select("image_id", "y", "x", "fill_root"), "image_id", "y", "x"), ["image_id", "y", "x"], "left").drop("y", "x")
    meta = meta.join(shuffled(index, "image_id", "fill_root"), ["image_id", "fill_root"], "left").join(shuffled(flagged, "image_id", "fill_root"), ["image_id", "fill_root"], "left").join(shuffled(direct, "image_id", "core"), ["image_id", "core"], "left")
    meta = meta.withColumn("assisted", F.coalesce("by_fill", F.lit(False)) | F.coalesce("direct", F.lit(False))).drop("by_fill", "direct")
    return core.join(shuffled(meta, "image_id", "core"), ["image_id", "core"])


def backgrounds(px: DataFrame, mask: str, radii: tuple[int, ...]) -> DataFrame:
    """(image_id, radius, y, a, b, root, w, h): the labelled runs of what the mask widened by each radius leaves, all radii in one pass; stored."""
    walls = separable_many(px.select("image_id", "y", "x", "w", "h", F.col(mask).cast("int").alias("_m")), {f"_w{r}": ("_m", r, F.max) for r in radii})
    free = F.filter(F.array(*[F.when(F.col(f"_w{r}") == 0, F.lit(r)) for r in radii]), lambda r: r.isNotNull())
    return stored(layered_runs(walls.select("image_id", "y", "x", "w", "h", F.explode(free).alias("radius")), "radius", 4), "backgrounds")


def _background_index(runs: DataFrame) -> DataFrame:
    return index_of(runs, "radius").select("image_id", "radius", F.col("root").alias("bg"), F.col("size").alias("bg_size"), F.col("edge_mask").alias("bg_edges"))


def core_closure(core: DataFrame, runs: DataFrame, radii: tuple[int, ...], conf: Params) -> DataFrame:
    """A row for each image and radius: how many cores the wall closes. A core is open if its background, of backgrounds(), reaches the frame where it may not."""
    back = pixels_of(runs, "radius", F.col("root").alias("bg"))
    each = core.withColumn("radius", F.explode(F.array(*[F.lit(r) for r in radii])))
    seen = each.join(shuffled(back, "image_id", "radius", "y", "x"), ["image_id", "radius", "y", "x"], "left")
    per = seen.groupBy("image_id", "radius", "core", "core_size", "fill_size", "allowed", "assisted", "bg").agg(F.count("*").alias("n"))
    per = per.join(shuffled(_background_index(runs), "image_id", "radius", "bg"), ["image_id", "radius", "bg"], "left")
    allowed = F.coalesce("allowed", F.lit(0))
    share = F.coalesce("bg_size", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("fill_size", "core_size"))
    stray = F.col("assisted") & F.col("bg").isNotNull() & (F.col("bg_edges").bitwiseAND(F.bitwise_not(allowed.cast("int"))) != 0)
    per = per.withColumns({"_leak": F.col("bg").isNotNull() & ~F.col("assisted") & (F.col("bg_edges") > 0), "_stray": stray, "_big": F.col("assisted") & F.col("bg").isNotNull() & (share > conf.max_leak_ratio)})
    g = per.groupBy("image_id", "radius", "core", "core_size", "assisted", allowed.alias("allowed")).agg(F.coalesce(F.sum(F.when(F.col("bg").isNull(), F.col("n"))), F.lit(0)).alias("covered"), F.max("_leak").alias("leak"), F.max("_stray").alias("stray"), F.max("_big").alias("big"))
    sides = edge_sides(F.col("allowed"))
    bad = F.col("assisted") & ((F.col("allowed") == 0) | (sides > 2) | opposite_edges(F.col("allowed")))
    g = g.withColumns({"full": F.col("covered") >= F.col("core_size"), "bad": bad})
    g = g.withColumn("open", F.col("bad") | (~F.col("full") & (F.col("leak") | F.col("stray") | F.col("big"))))
    a = F.col("assisted")
    out = g.groupBy("image_id", "radius").agg(
        F.count("*").alias("regions"), F.count_if(~F.col("open")).alias("closed"), F.count_if("open").alias("open"), F.count_if("full").alias("fully_covered"), F.sum("covered").alias("covered_pixels"), F.sum("core_size").alias("core_pixels"),
        F.count_if(a).alias("assisted"), F.count_if(a & ~F.col("open")).alias("assisted_closed"), F.count_if(a & F.col("open")).alias("assisted_open"), F.count_if(a & (sides == 1)).alias("single_edge"), F.count_if(a & (sides == 2) & ~opposite_edges(F.col("allowed"))).alias("corner"), F.count_if("bad").alias("invalid_edges"),
    )
    return out.withColumn("closure_rate", ratio(F.col("closed"), F.col("regions"), None))


def seed_closure(px: DataFrame, seeds: DataFrame, runs: DataFrame, radii: tuple[int, ...], conf: Params) -> DataFrame:
    """The same from seed points, for images without fills."""
    size = px.groupBy("image_id").agg(F.first("w").alias("w"), F.first("h").alias("h"))
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("w")) & (F.col("y") < F.col("h"))
    s = seeds.join(F.broadcast(size), "image_id").where(inside).withColumn("radius", F.explode(F.array(*[F.lit(r) for r in radii])))
    back = runs_at(s.select("image_id", "radius", "y", "x").distinct(), runs, ("radius",)).withColumnRenamed("root", "bg")
    at = s.join(back, ["image_id", "radius", "y", "x"], "left").join(shuffled(_background_index(runs), "image_id", "radius", "bg"), ["image_id", "radius", "bg"], "left")
    edge = F.coalesce("bg_edges", F.lit(0)) > 0
    roomy = F.col("bg_size") > F.col("w") * F.col("h") * 0.12 * conf.max_leak_ratio
    at = at.withColumn("open", F.coalesce(F.col("bg").isNotNull() & F.when(F.col("border_assisted"), edge & roomy).otherwise(edge), F.lit(False)))
    g = at.groupBy("image_id", "radius").agg(F.count("*").alias("regions"), F.count_if(~F.col("open")).alias("closed"), F.count_if("open").alias("open"), F.count_if(F.col("bg").isNull()).alias("fully_covered"))
    return g.withColumn("closure_rate", ratio(F.col("closed"), F.col("regions"), None))


def closure_profile(px: DataFrame, conf: Params, mask: str = "pred", seeds: DataFrame | None = None) -> DataFrame:
    """(image_id, radius, ...): core_closure() of the mask widened by each repair radius; seed_closure() where seeds are given instead of fills."""
    radii = tuple(conf.closure_radii)
    runs = backgrounds(px, mask, radii)
    return core_closure(stored(cores(px, conf), "cores"), runs, radii, conf) if seeds is None else seed_closure(px, seeds, runs, radii, conf)


def bridged_backgrounds(px: DataFrame, runs: DataFrame, bridged: DataFrame, radii: tuple[int, ...]) -> DataFrame:
    """backgrounds() after the accepted gaps were drawn, from those before: only parts that a widened gap touches are labelled again.

    Drawing can split a part of the background but never joins two, and a part without a new pixel stays as it is.
    """
    size = px.groupBy("image_id").agg(F.first("w").alias("w"), F.first("h").alias("h"))
    new = bridged.where("reason IS NULL").select("image_id", F.explode("path").alias("p")).select("image_id", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y")).distinct()
    new = new.join(F.broadcast(size), "image_id").withColumn("radius", F.explode(F.array(*[F.lit(r) for r in radii])))
    for axis, n in (("x", "w"), ("y", "h")):
        span = F.sequence(F.greatest(F.lit(0), F.col(axis) - F.col("radius")), F.least(F.col(n) - 1, F.col(axis) + F.col("radius")))
        new = new.withColumn(axis, F.explode(span)).distinct()
    new = stored(new.select("image_id", "radius", "y", "x"), "widened-gaps")
    touched = stored(runs_at(new, runs, ("radius",)).select("image_id", "radius", "root").distinct(), "touched")
    part = ["image_id", "radius", "root"]
    again = pixels_of(runs.join(touched, part, "left_semi"), "radius", "w", "h").join(new, ["image_id", "radius", "y", "x"], "left_anti")
    return stored(runs.join(touched, part, "left_anti").unionByName(layered_runs(again, "radius", 4)), "backgrounds")


def gap_preview(px: DataFrame, conf: Params, mode: str = "safe", feat: DataFrame | None = None, mask: str = "pred", seeds: DataFrame | None = None) -> DataFrame:
    """A row for each image: accepted bridges and added pixels, and evaluation and closure before and after they are drawn, nothing of which is applied.

    px: mask, ref, neg, excl, w, h, and fill and border_fill unless seeds are given. What the drawing changes of the background is derived from the labels before.
    """
    radii = tuple(conf.closure_radii)
    gaps = stored(bridge(px, conf, mode, feat, mask), "gaps")
    runs = backgrounds(px, mask, radii)
    core = stored(cores(px, conf), "cores") if seeds is None else None
    closure = lambda r: core_closure(core, r, radii, conf) if seeds is None else seed_closure(px, seeds, r, radii, conf)
    both = apply_bridges(px, gaps, mask, "_after")
    out = gaps.groupBy("image_id").agg(F.count_if(F.col("reason").isNull()).alias("bridges"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("added"))), F.lit(0)).alias("added_pixels"))
    out = px.select("image_id").distinct().join(out, "image_id", "left").fillna(0, ["bridges", "added_pixels"])
    for name, m, r in (("before", mask, runs), ("after", "_after", bridged_backgrounds(px, runs, gaps, radii))):
        cells = stored(regional(both.withColumn("pred", F.col(m)), conf.tolerance), "regional")
        own, tight = cells.where("rx IS NULL").select("image_id", "recall", "leakage"), macro(cells).select("image_id", "macro_leakage")
        base = closure(r)
        zero = base.where(F.col("radius") == min(radii)).select("image_id", "closed", "open", "closure_rate")
        whole = profile_summary(base).select("image_id", "weighted_closure", "mean_required_radius", "open_after_max")
        figures = own.join(tight, "image_id", "left").join(zero, "image_id", "left").join(whole, "image_id", "left")
        out = out.join(figures.select("image_id", F.struct(*[c for c in figures.columns if c != "image_id"]).alias(name)), "image_id", "left")
    return out


def profile_summary(profile: DataFrame) -> DataFrame:
    """Per image: mean closure rate, regions newly closed at each radius, mean radius needed (capped) and what stays open."""
    order = Window.partitionBy("image_id").orderBy("radius")
    was = F.coalesce(F.max("closed").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = profile.withColumn("_new", F.greatest(F.lit(0), F.col("closed") - was))
    g = p.groupBy("image_id").agg(F.min_by("regions", "radius").alias("regions"), F.avg(F.coalesce("closure_rate", F.lit(0.0))).alias("weighted_closure"), F.max("closed").alias("_closed"), F.sum(F.col("_new") * F.col("radius")).alias("_need"), F.max("radius").alias("max_radius"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("radius").cast("string"), "_new")))).alias("_hist"))
    left = F.greatest(F.lit(0), F.col("regions") - F.col("_closed"))
    return g.select("image_id", "regions", "weighted_closure", ratio(F.col("_need") + left * (F.col("max_radius") + 1), F.col("regions"), None).alias("mean_required_radius"), "max_radius", left.alias("open_after_max"), F.map_concat("_hist", F.create_map(F.concat(F.lit(">"), F.col("max_radius").cast("string")), left)).alias("histogram"))


def recovery(profile: DataFrame) -> DataFrame:
    """Regions newly closed at each radius beyond the smallest."""
    order = Window.partitionBy("image_id").orderBy("radius")
    was = F.max("closed").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return profile.withColumn("_was", was).where("_was IS NOT NULL").withColumn("newly_closed", F.greatest(F.lit(0), F.col("closed") - F.col("_was"))).select("image_id", "radius", "newly_closed", "closed", "closure_rate")


def report(px: DataFrame, conf: Params, feat: DataFrame | None = None, mask: str = "pred", seeds: DataFrame | None = None) -> DataFrame:
    """One nested row for each image: endpoints, safe and extended (counters of each bridging), closure by radius, its profile and recovery.

    px: mask, ref, neg, excl, w, h, and fill and border_fill unless seeds are given. Parts are structs joined by image; none gathers more than a
    row for each radius.
    """
    out = endpoint_proxy(px, mask).select("image_id", F.struct("set_pixels", "endpoints", "per_100k").alias("endpoints"))
    for mode in ("safe", "extended") if feat is not None else ("safe",):
        scan = gap_scan(px, conf, mode, mask)
        counted = gap_counters(scan, bridge(px, conf, mode, feat, mask, scan=scan), mode)
        out = out.join(counted.select("image_id", F.struct(*[c for c in counted.columns if c != "image_id"]).alias(mode)), "image_id", "left")
    profile = stored(closure_profile(px, conf, mask, seeds), "profile")
    whole, back = profile_summary(profile), recovery(profile)
    by_radius = lambda df, name: df.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("radius", *[c for c in df.columns if c not in ("image_id", "radius")]))).alias(name))
    out = out.join(by_radius(profile, "closure"), "image_id", "left").join(by_radius(back, "recovery"), "image_id", "left")
    return out.join(whole.select("image_id", F.struct(*[c for c in whole.columns if c != "image_id"]).alias("profile")), "image_id", "left")
