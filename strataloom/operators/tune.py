"""Parameter search: candidates are rows, one job scores them all, max_by picks. Only the rounds themselves are a driver loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..conf import MARGINS, Params
from ..functions.pixel import balanced_score, cell_of, clamp, inside, interior_score, ratio, threshold
from ..plans.graph import stored
from .boundary import thinned
from .components import pixels_of, sized_runs
from .windows import dilate, separable_many, supported

# What the search tries, in this order.
MIN_COMPONENTS = (1, 4, 8, 16, 24, 40, 64, 96, 128, 192, 256)
DELTAS = (-18, -10, -4, 0, 4, 10, 18)
SENSITIVITY_STEPS, WEIGHT_STEPS = (12, 6, 3), (25, 10, 5)
BROAD_SENSITIVITY, BROAD_WEIGHTS = (35, 50, 65, 80, 95), (0, 10, 25, 50, 75, 100)
COORDINATES = ("sensitivity", "dark_weight", "ridge_weight", "color_weight", "dendrite_weight")
EPSILON = 1e-9


def coordinate_candidates(name: str, value: int, round_: int) -> list[int]:
    """Values to try for one coordinate: steps around the current one, and a broad grid at first."""
    sens = name == "sensitivity"
    step = (SENSITIVITY_STEPS if sens else WEIGHT_STEPS)[min(round_, 2)]
    broad = (BROAD_SENSITIVITY if sens else BROAD_WEIGHTS) if round_ == 0 else (() if sens else (0,))
    low = 1 if sens else 0
    return sorted({max(low, min(100, v)) for v in (*(value + k * step for k in (-2, -1, 0, 1, 2)), *broad)})


FIGURES = ("recall", "leakage", "macro_leakage", "label_precision", "label_f1", "roi_precision", "roi_recall", "roi_f1", "score")


def objective(df: DataFrame, n: int, tolerance: int, cell: Callable[[str, Column, int], Column] = cell_of, cols: int = 4, rows: int = 4) -> DataFrame:
    """(image_id, ord, FIGURES) of n candidates whose predictions are the bits of one long, so that all are scored in one pass.

    df: key, w, h, ref, neg, excl, ref_band, bits and, where there are complete ROIs, roi (0/1). Reference is matched by bits that are or-ed over
    two windows. Where an image has ROI pixels the score is their F1, with both masks clipped to the ROIs; else it is the balanced one.
    """
    if n > 62:
        raise ValueError("at most 62 candidates in one pass")
    seen = F.col("excl") == 0
    df = df.withColumn("bits", F.when(seen, F.col("bits")).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("_in", (seen & (F.col("roi") == 1)).cast("int")) if "roi" in df.columns else df.withColumn("_in", F.lit(0))
    own = F.when(F.col("_in") == 1, F.col("bits")).otherwise(F.lit(0).cast("long"))
    df = separable_many(df, {"_near": ("bits", tolerance, F.bit_or), "_near_in": (own, tolerance, F.bit_or), "_roi_band": (F.col("ref").cast("int") * F.col("_in"), tolerance, F.max)})
    df = df.withColumns({"rx": cell("x", F.col("w"), cols), "ry": cell("y", F.col("h"), rows)})
    ref, band = seen & (F.col("ref") == 1), seen & (F.col("ref_band") == 1)
    neg, inner = seen & (F.col("neg") == 1) & (F.col("ref_band") == 0), F.col("_in") == 1
    bit = lambda c, i: F.shiftright(c, i).bitwiseAND(1)
    count = lambda when, c, i: F.sum(F.when(when, bit(c, i)).otherwise(0))
    each = lambda i: F.struct(count(ref, "_near", i).alias("hit"), count(band, "bits", i).alias("good"), count(neg, "bits", i).alias("bad"), count(inner & (F.col("ref") == 1), "_near_in", i).alias("i_hit"), count(inner & (F.col("_roi_band") == 1), "bits", i).alias("i_good"), count(inner & (F.col("_roi_band") == 0), "bits", i).alias("i_bad"))
    cells = df.groupBy("image_id", "rx", "ry").agg(F.count_if(ref).alias("ref"), F.count_if(neg).alias("neg"), F.count_if(inner).alias("inner"), F.count_if(inner & (F.col("ref") == 1)).alias("i_ref"), F.array(*[each(i) for i in range(n)]).alias("c"))
    flat = cells.select("image_id", "ref", "neg", "inner", "i_ref", F.posexplode("c").alias("ord", "c")).select("image_id", "ord", "ref", "neg", "inner", "i_ref", "c.*")
    g = flat.groupBy("image_id", "ord").agg(*[F.sum(c).alias(c) for c in ("ref", "neg", "inner", "i_ref", "hit", "good", "bad", "i_hit", "i_good", "i_bad")], F.coalesce(F.avg(F.when(F.col("neg") > 0, F.col("bad") / F.col("neg"))), F.lit(0.0)).alias("macro_leakage"))
    c = F.col
    f1 = lambda p, r: ratio(2 * c(p) * c(r), c(p) + c(r))
    g = g.withColumns({"recall": ratio(c("hit"), c("ref")), "leakage": ratio(c("bad"), c("neg")), "label_precision": ratio(c("good"), c("good") + c("bad")), "roi_precision": F.when(c("inner") > 0, ratio(c("i_good"), c("i_good") + c("i_bad"))), "roi_recall": F.when(c("inner") > 0, ratio(c("i_hit"), c("i_ref")))})
    g = g.withColumns({"label_f1": f1("label_precision", "recall"), "roi_f1": F.when(c("inner") > 0, f1("roi_precision", "roi_recall"))})
    g = g.withColumn("score", F.coalesce("roi_f1", balanced_score(c("recall"), c("macro_leakage"), c("neg"))))
    return g.select("image_id", "ord", *FIGURES)


def _third(at: str, size: Column, cells: int) -> Column:
    """The cell by share of the size, as raw scores count them."""
    return F.least(F.lit(cells - 1), F.floor(F.col(at) * cells / size)).cast("int")


def _score(c: Params, w: Column, h: Column) -> Column:
    """The score of one configuration, normalised over the channels that a pixel has; 0 on the frame."""
    total, share = F.lit(0.0), F.lit(0.0)
    for name, weight in c.weights().items():
        if weight > 0:
            there = inside(MARGINS[name], w, h)
            total = total + F.when(there, F.col(name) / 255.0 * float(weight)).otherwise(0.0)
            share = share + F.when(there, F.lit(float(weight))).otherwise(0.0)
    return F.when(inside(1, w, h) & (share > 0), total / share).otherwise(F.lit(-1.0))


def raw_scores(scene: DataFrame, configs: list[Params], tolerance: int) -> DataFrame:
    """objective() of each configuration's thresholded score, without thinning or components; ``ord`` is its place in the list.

    scene: features with ref, neg, excl, w, h and perhaps roi. Pixels that no figure depends on are left out.
    """
    df = dilate(scene, "ref", "ref_band", tolerance)
    counts = (F.col("ref_band") == 1) | (F.col("neg") == 1)
    df = df.where(counts | (F.col("roi") == 1) if "roi" in df.columns else counts)
    bits = F.lit(0).cast("long")
    for i, c in enumerate(configs):
        bits = bits.bitwiseOR(F.when(_score(c, F.col("w"), F.col("h")) >= threshold(F.lit(c.sensitivity)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return objective(df.withColumn("bits", bits), len(configs), tolerance, _third)


def preference() -> Column:
    """The lexicographic order of results: score, recall in the ROIs where they are the score, recall, low macro leakage, then the first."""
    r = lambda c: F.round(F.col(c), 9)
    return F.struct(r("score"), F.coalesce(r("roi_recall"), F.lit(0.0)), r("recall"), -r("macro_leakage"), -F.col("ord"))


def best(scores: DataFrame) -> DataFrame:
    """The preferred candidate of each image."""
    return scores.groupBy("image_id").agg(F.max_by(F.struct("ord", *FIGURES), preference()).alias("b")).select("image_id", "b.*")


def processed_scores(scene: DataFrame, tolerance: int) -> DataFrame:
    """(image_id, FIGURES) of a finished mask. scene: pred, ref, neg, excl, w, h and perhaps roi."""
    df = dilate(scene, "ref", "ref_band", tolerance).withColumn("bits", F.col("pred").cast("long"))
    return objective(df, 1, tolerance).drop("ord")


def component_sizes_of(thin: DataFrame) -> DataFrame:
    """thin with ``size``: that of the 8-connected component of each supported pixel, else null."""
    df = stored(supported(thin, "thin", "_sup"), "support")
    own = pixels_of(sized_runs(df.select("image_id", "y", "x", "_sup"), F.col("_sup") == 1), "size")
    return df.drop("_sup").join(own, ["image_id", "y", "x"], "left")


def min_component_search(scene: DataFrame, tolerance: int, current: int = 24) -> DataFrame:
    """(image_id, ord, least, FIGURES) for each candidate size, from one components pass and one scoring pass over scene's ``thin`` mask."""
    tries = sorted({*MIN_COMPONENTS, max(1, min(300, current))})
    df = dilate(component_sizes_of(scene), "ref", "ref_band", tolerance)
    bits = F.lit(0).cast("long")
    for i, least in enumerate(tries):
        bits = bits.bitwiseOR(F.when(F.col("size") >= least, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    s = objective(df.withColumn("bits", bits), len(tries), tolerance)
    return s.withColumn("least", F.get(F.array(*[F.lit(t) for t in tries]), F.col("ord"))).select("image_id", "ord", "least", *FIGURES)


def better(candidate: dict, than: dict | None) -> bool:
    """preference() of two results, with differences up to EPSILON as none; the standing one wins ties."""
    if than is None:
        return True
    for key, sign in (("score", 1), ("roi_recall", 1), ("recall", 1), ("macro_leakage", -1)):
        a, b = candidate[key], than[key]
        if a is None or b is None:
            continue
        if abs(a - b) > EPSILON:
            return (a - b) * sign > 0
    return False


def _overall(scores: DataFrame) -> list[dict]:
    """Scores over all images: a row for each candidate, in order."""
    return [r.asDict() for r in scores.groupBy("ord").agg(*[F.avg(c).alias(c) for c in FIGURES]).orderBy("ord").collect()]


def _first_best(found: list[dict]) -> dict:
    top = None
    for f in found:
        top = f if better(f, top) else top
    return top


def auto_tune(scene: DataFrame, conf: Params, tolerance: int, rounds: int = 3) -> tuple[Params, dict]:
    """Coordinate descent over one scene's images together; returns the best configuration and the record of the search.

    Component sizes are searched first and after each round. In a round, raw scores propose a value for each coordinate and the finished
    mask's score accepts it; a round that doesn't beat the best so far is taken back, and the search ends when a round neither
    changed anything nor was accepted. Then each channel is left out of the best once. Each step is one job over all its
    candidates; the driver sees a row for each.
    """
    columns = ["image_id", "y", "x", "w", "h", *MARGINS, "orientation", "orientation_angle", "ref", "neg", "excl", *(["roi"] if "roi" in scene.columns else [])]
    scene = stored(scene.select(*columns), "tuning")
    labels = ["ref", "neg", *(["roi"] if "roi" in scene.columns else [])]

    def thin(c: Params) -> DataFrame:
        return thinned(scene, c, exclusion="excl", keep=tuple(labels))

    def processed(c: Params) -> dict:
        df = component_sizes_of(thin(c)).withColumn("pred", F.coalesce((F.col("size") >= c.min_component).cast("int"), F.lit(0)))
        return _overall(processed_scores(df, tolerance).withColumn("ord", F.lit(0)))[0] | {"conf": c}

    def sized(c: Params) -> dict:
        found = _overall(min_component_search(thin(c), tolerance, c.min_component))
        top = _first_best(found)
        return top | {"conf": c.with_(min_component=sorted({*MIN_COMPONENTS, max(1, min(300, c.min_component))})[top["ord"]])}

    told = lambda r: {k: r[k] for k in FIGURES}
    top = sized(conf)
    record: dict = {"baseline": {"parameters": top["conf"], "objective": told(top)}, "rounds": [], "ablation": []}
    working, standing = top["conf"], top
    for round_ in range(max(1, min(3, rounds))):
        trace: dict = {"round": round_ + 1, "start": working, "coordinates": []}
        changed = False
        for name in COORDINATES:
            before = getattr(working, name)
            values = coordinate_candidates(name, before, round_)
            raw = _overall(raw_scores(scene, [working.with_(**{name: v}) for v in values], tolerance))
            pick = values[_first_best(raw)["ord"]]
            accepted, got = pick == before, None
            if pick != before:
                got = processed(working.with_(**{name: pick}))
                if better(got, standing):
                    working, standing, accepted, changed = got["conf"], got, True, True
            trace["coordinates"].append({"name": name, "previous": before, "proposed": pick, "selected": getattr(working, name), "accepted": accepted, "objective": told(got or standing), "candidates": [{"value": v, **told(r)} for v, r in zip(values, raw, strict=True)]})
        after = sized(working)
        trace |= {"parameters": after["conf"], "objective": told(after), "accepted": better(after, top)}
        if trace["accepted"]:
            top = after
        else:
            trace["reverted_to"] = top["conf"]
        working, standing = top["conf"], top
        record["rounds"].append(trace)
        if not changed and not trace["accepted"]:
            break
    for label, name in (("full", None), ("-Dark", "dark_weight"), ("-Ridge", "ridge_weight"), ("-Color", "color_weight"), ("-Dendrite", "dendrite_weight")):
        got = processed(top["conf"].with_(**{name: 0})) if name else top
        record["ablation"].append({"label": label, "disabled": name, "objective": told(got)})
    record["final"] = {"parameters": top["conf"], "objective": told(top)}
    return top["conf"], record


def local_scores(scene: DataFrame, conf: Params, tolerance: int, cols: int = 4, rows: int = 4) -> DataFrame:
    """(image_id, rx, ry, delta, moved, ref, recall, precision, f1) of every cell and sensitivity delta, in one pass. scene: features, ref, neg, excl, w, h.

    ``moved`` is the delta that the limits of the sensitivity leave. With a 0/1 column roi, verified ROIs count as labelled through and
    through: what isn't reference in them is background.
    """
    moved = [max(1, min(100, conf.sensitivity + d)) - conf.sensitivity for d in DELTAS]
    seen = F.col("excl") == 0
    value = interior_score(conf.weights())
    bits = F.lit(0).cast("long")
    for i, m in enumerate(moved):
        bits = bits.bitwiseOR(F.when(seen & (value >= threshold(F.lit(conf.sensitivity + m))), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    df = scene.withColumns({"bits": bits, "_roi": F.col("roi") if "roi" in scene.columns else F.lit(0)})
    df = separable_many(df, {"ref_band": ("ref", tolerance, F.max), "_near": ("bits", tolerance, F.bit_or)}).where(seen)
    band, judged = F.col("ref_band") == 1, (F.col("ref_band") == 1) | (F.col("neg") == 1) | (F.col("_roi") == 1)
    count = lambda when, c, i: F.sum(F.when(when, F.shiftright(c, i).bitwiseAND(1)).otherwise(0))
    each = lambda i: F.struct(F.lit(DELTAS[i]).alias("delta"), F.lit(moved[i]).alias("moved"), count(F.col("ref") == 1, "_near", i).alias("matched"), count(band, "bits", i).alias("good"), count(judged, "bits", i).alias("all"))
    df = df.withColumns({"rx": cell_of("x", F.col("w"), cols), "ry": cell_of("y", F.col("h"), rows)})
    g = df.groupBy("image_id", "rx", "ry").agg(F.sum("ref").alias("ref"), F.array(*[each(i) for i in range(len(DELTAS))]).alias("c"))
    g = g.select("image_id", "rx", "ry", "ref", F.explode("c").alias("c")).select("image_id", "rx", "ry", "ref", "c.*")
    g = g.withColumns({"recall": ratio(F.col("matched"), F.col("ref")), "precision": ratio(F.col("good"), F.col("all"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return g.select("image_id", "rx", "ry", "delta", "moved", "ref", "recall", "precision", f1.alias("f1"))


def local_choice(scores: DataFrame, least_reference: int = 20) -> DataFrame:
    """(image_id, rx, ry, delta, gain) of the cells with enough reference: the delta (as moved) that gains most and loses no recall; 0 if none gains.

    The anchor is the candidate that doesn't move the sensitivity (the last one, where limits hold several back), or moves it least.
    """
    w = Window.partitionBy("image_id", "rx", "ry")
    last = F.when(F.col("moved") == 0, F.col("delta")).otherwise(-F.col("delta"))
    s = scores.where(F.col("ref") >= least_reference).withColumn("adjusted", F.col("f1") - 0.035 * F.abs(F.col("delta")) / 18)
    s = s.withColumn("anchor", F.max(F.struct((-F.abs(F.col("moved"))).alias("near"), last.alias("last"), "delta", "recall", "adjusted")).over(w))
    own = F.col("delta") == F.col("anchor.delta")
    gain = F.col("adjusted") - F.col("anchor.adjusted")
    fine = own | (F.col("moved") == 0) | ((F.col("recall") >= F.col("anchor.recall") - 0.02) & (gain >= 0.001))
    order = F.struct(F.round("adjusted", 9), F.round("recall", 9), own, -F.col("delta"))
    return s.where(fine).groupBy("image_id", "rx", "ry").agg(F.max_by(F.struct(F.col("moved").alias("delta"), gain.alias("gain")), order).alias("b")).select("image_id", "rx", "ry", "b.delta", "b.gain")


def calibration_fill(measured: DataFrame, cols: int = 4, rows: int = 4, images: DataFrame | None = None) -> DataFrame:
    """(image_id, rx, ry, value, measured) of every cell: measured deltas are anchors, others lean on measured neighbours by distance.

    Of the images in measured, or of ``images`` if given: 0 throughout where nothing was measured.
    """
    m = measured.select("image_id", F.col("rx").alias("mx"), F.col("ry").alias("my"), F.col("delta").cast("double").alias("v"))
    grid = (measured if images is None else images).select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(cols * rows - 1))).alias("i")).select("image_id", (F.col("i") % cols).cast("int").alias("rx"), F.floor(F.col("i") / cols).cast("int").alias("ry"))
    d2 = (F.col("rx") - F.col("mx")) * (F.col("rx") - F.col("mx")) + (F.col("ry") - F.col("my")) * (F.col("ry") - F.col("my"))
    near = grid.join(m, "image_id").withColumn("d2", d2.cast("double")).where("d2 <= 2")
    g = near.groupBy("image_id", "rx", "ry").agg(F.max(F.when(F.col("d2") == 0, F.col("v"))).alias("own"), F.sum(F.when(F.col("d2") > 0, F.col("v") / F.col("d2"))).alias("s"), F.sum(F.when(F.col("d2") > 0, 1 / F.col("d2"))).alias("n"))
    g = grid.join(g, ["image_id", "rx", "ry"], "left")
    value = F.coalesce("own", F.col("s") / (1.5 + F.col("n")), F.lit(0.0)).cast("float")
    return g.select("image_id", "rx", "ry", value.alias("value"), F.col("own").isNotNull().alias("measured"))


def calibration_summary(filled: DataFrame) -> DataFrame:
    return filled.groupBy("image_id").agg(F.count_if(F.abs(F.col("value")) > 1e-6).alias("active_cells"), F.max(F.abs(F.col("value"))).alias("max_abs"), F.count_if("measured").alias("measured_cells"))


GUARDED = "recall double, macro_leakage double, roi_f1 double, regions long, weighted_closure double, open_after_max long, mean_required_radius double, primary double"


def _moved(key: str) -> Column:
    """after less before."""
    return F.col(f"after.{key}") - F.col(f"before.{key}")


def _profiles() -> Column:
    """Whether both sides have regions to close."""
    return F.coalesce((F.col("before.regions") > 0) & (F.col("after.regions") > 0), F.lit(False))


def stage_reason() -> Column:
    """Why a tuning stage may not stand, the first broken limit; null if it may. Of columns before and after, structs of GUARDED."""
    broken = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(F.col("before").isNull() | F.col("after").isNull(), "missing-evaluation")
        .when(broken(_moved("recall") < -0.005), "positive-recall-regression")
        .when(broken(_moved("macro_leakage") > 0.005), "macro-negative-leakage-regression")
        .when(broken(_moved("roi_f1") < -0.002), "verified-roi-f1-regression")
        .when(_profiles() & broken(_moved("weighted_closure") < -0.01), "weighted-closure-regression")
        .when(_profiles() & broken(_moved("open_after_max") > 3), "open-at-3-regression")
    )


def gap_passes() -> Column:
    """Whether a bridging stands: metrics may hardly move and the topology must gain; without regions the primary score must. As stage_reason()."""
    holds = F.coalesce(_moved("recall") >= -0.001, F.lit(True)) & F.coalesce(_moved("macro_leakage") <= 0.001, F.lit(True)) & F.coalesce(_moved("roi_f1") >= -0.001, F.lit(True))
    gains = F.coalesce(_moved("weighted_closure") > 0.00025, F.lit(False)) | F.coalesce(_moved("open_after_max") < 0, F.lit(False)) | F.coalesce(_moved("mean_required_radius") < -0.002, F.lit(False))
    return F.coalesce(holds & F.when(_profiles(), gains).otherwise(_moved("primary") > 0.001), F.lit(False))


def _guarded(spark: SparkSession, before: dict | None, after: dict | None) -> DataFrame:
    names = [c.split()[0] for c in GUARDED.split(", ")]
    row = lambda e: None if e is None else tuple(e.get(k) for k in names)
    return spark.createDataFrame([(row(before), row(after))], f"before struct<{GUARDED}>, after struct<{GUARDED}>")


def stage_guard(spark: SparkSession, before: dict | None, after: dict | None) -> tuple[bool, str | None]:
    """stage_reason() of two evaluations."""
    reason = _guarded(spark, before, after).select(stage_reason().alias("r")).first().r
    return reason is None, reason


def gap_guard(spark: SparkSession, before: dict | None, after: dict | None) -> bool:
    """gap_passes() of two evaluations."""
    return _guarded(spark, before, after).select(gap_passes().alias("g")).first().g


def stage_verdict(spark: SparkSession, before: dict | None, after: dict | None) -> tuple[bool, str | None]:
    """Whether a tuning stage stands: stage_guard(), and the primary score may fall by 0.002 at most."""
    fine, why = stage_guard(spark, before, after)
    if fine and after["primary"] < before["primary"] - 0.002:
        return False, "primary-score-regression"
    return fine, why
