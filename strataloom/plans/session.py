"""What a user runs: load, extract, compare, tune, repair, report."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import Params
from ..functions.pixel import primary_score
from ..operators import topology, tune
from ..operators.boundary import boundary_mask
from ..operators.components import closed_regions
from ..operators.features import features
from ..operators.fills import fill_mask
from ..operators.labels import in_rects
from ..operators.metrics import compare, macro, multi_tolerance, regional, roi_metrics
from ..sources.raster import with_size
from .graph import stored

KEY = ["image_id", "y", "x"]


@dataclass
class Session:
    """An image set with its labels. Everything derived is a new DataFrame; features are stored once and read again.

    labels: (key, ref, neg, excl) with 0/1 columns. Changing the configuration makes a new session; what depends on the
    features alone is kept, what depends on the mask is derived anew.
    """

    px: DataFrame
    labels: DataFrame
    conf: Params = Params()
    rois: DataFrame | None = None
    seeds: DataFrame | None = None
    calibration: DataFrame | None = None  # (image_id, rx, ry, value): each image's own grid
    _features: DataFrame | None = None
    _mask: DataFrame | None = None
    _predicted: DataFrame | None = None

    def features(self) -> DataFrame:
        if self._features is None:
            self._features = stored(features(with_size(self.px), self.conf), "features")
        return self._features

    def scene(self) -> DataFrame:
        """Features with labels."""
        lab = self.labels.select(*KEY, "ref", "neg", "excl")
        f = self.features().join(lab, KEY, "left")
        return f.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("ref", "neg", "excl")})

    def predicted(self) -> DataFrame:
        """(key, w, h, score, pred, excl, ref, neg), stored: labels travel with the mask, so that nothing is joined."""
        if self._predicted is None:
            if self._mask is None:
                self._predicted = stored(boundary_mask(self.scene(), self.conf, self.calibration, exclusion="excl", keep=("ref", "neg")), "predicted")
                self._mask = self._predicted.select(*KEY, "pred")
            else:  # other labels under the same mask
                self._predicted = stored(self.scene().select(*KEY, "w", "h", "excl", "ref", "neg").join(self._mask, KEY), "predicted")
        return self._predicted

    def mask(self) -> DataFrame:
        if self._mask is None:
            self.predicted()
        return self._mask

    def with_conf(self, conf: Params) -> Session:
        """A changed feature setting drops features and calibration, a changed extraction setting the calibration only."""
        same = (conf.local_enabled, conf.local_strength, conf.local_window) == (self.conf.local_enabled, self.conf.local_strength, self.conf.local_window)
        return Session(self.px, self.labels, conf, self.rois, self.seeds, None, self._features if same else None)

    def with_calibration(self, grid: DataFrame | None) -> Session:
        """Each image's own calibration grid; only the mask is derived anew."""
        return replace(self, calibration=grid, _mask=None, _predicted=None)

    def with_labels(self, labels: DataFrame, exclusions_changed: bool = False) -> Session:
        """Edited labels drop the calibration, which was measured by them, and with it its mask; a mask without calibration is derived anew only if exclusions changed, which cut it. Features stay."""
        stays = self.calibration is None and not exclusions_changed
        return replace(self, labels=labels, calibration=None, _mask=self._mask if stays else None, _predicted=None)

    def with_rois(self, rois: DataFrame | None) -> Session:
        """Edited ROIs touch evaluations alone."""
        return replace(self, rois=rois)

    def with_seeds(self, seeds: DataFrame | None) -> Session:
        """Edited seeds change the closed negatives and closure alone."""
        return replace(self, seeds=seeds)

    def compare(self) -> dict[str, DataFrame]:
        """Whole, regional and multi-tolerance metrics, and the ROIs' where there are any."""
        p = self.predicted()
        out = {"whole": compare(p, self.conf.tolerance), "regional": regional(p, self.conf.tolerance, review_radius=self.conf.review_radius), "tolerances": multi_tolerance(p, [1, 2, 3, 4])}
        if self.rois is not None:
            out["rois"] = roi_metrics(p, self.rois, self.conf.tolerance)
        return out

    def filled(self, p: DataFrame) -> DataFrame:
        """p with fill and border_fill from the seeds."""
        if self.seeds is None:
            return p.withColumns({"fill": F.lit(0), "border_fill": F.lit(0)})
        regions = closed_regions(p, self.conf.fill_safety)  # labelled once for both
        f = fill_mask(p, self.seeds, self.conf, regions)
        b = fill_mask(p, self.seeds.where("border_assisted"), self.conf, regions).select(*KEY, F.col("fill").alias("border_fill"))
        return f.join(b, KEY)

    def judged(self) -> DataFrame:
        """The scene with roi: whether a verified ROI holds the pixel."""
        s = self.scene()
        return in_rects(s, self.verified(), "roi") if self.rois is not None else s

    def verified(self) -> DataFrame:
        """The ROIs that count: all but those marked as not verified."""
        return self.rois.where(F.coalesce(F.col("verified"), F.lit(True))) if "verified" in self.rois.columns else self.rois

    def evaluate(self, p: DataFrame, mask: str = "pred") -> dict:
        """One row of figures over all images: what guards and stages compare."""
        df = p.drop("pred").withColumn("pred", F.col(mask)) if mask != "pred" else p
        r = stored(regional(df, self.conf.tolerance), "regional")
        whole = r.where("rx IS NULL").agg(F.avg("recall").alias("recall"), F.avg("leakage").alias("leakage")).first().asDict()
        whole["macro_leakage"] = macro(r).agg(F.avg("macro_leakage")).first()[0]
        whole["roi_f1"] = roi_metrics(df, self.verified(), self.conf.tolerance).where("roi = -1").agg(F.avg("f1")).first()[0] if self.rois is not None else None
        if self.seeds is not None:
            prof = stored(topology.closure_profile(self.filled(df), self.conf), "profile")
            whole |= topology.profile_summary(prof).agg(F.sum("regions").alias("regions"), F.avg("weighted_closure").alias("weighted_closure"), F.avg("mean_required_radius").alias("mean_required_radius"), F.sum("open_after_max").alias("open_after_max")).first().asDict()
        score = primary_score(F.lit(whole["roi_f1"]).cast("double"), F.lit(whole["recall"]), F.lit(whole["macro_leakage"]))
        return whole | {"primary": p.sparkSession.range(1).select(score.alias("v")).first().v}

    def optimize(self, rounds: int = 1) -> tuple[Session, DataFrame, list[dict]]:
        """Global search, local calibration, safe and extended repair; each stage stands only if its guard lets it, and says why if it doesn't.

        One configuration is searched for the whole set, and stages are judged by its mean figures; calibrations are each image's own.
        """
        trace: list[dict] = []
        now = self
        before = now.evaluate(now.predicted())
        trace.append({"stage": "baseline", **before})
        spark = now.px.sparkSession
        conf, search = tune.auto_tune(now.judged(), now.conf, now.conf.tolerance, rounds)
        trace[0]["search"] = search
        tried = now.with_conf(conf)
        after = tried.evaluate(tried.predicted())
        fine, why = tune.stage_verdict(spark, before, after)
        trace.append({"stage": "global", "accepted": fine, "status": "accepted" if fine else "rolled-back", "reason": why, **after})
        if fine:
            now, before = tried, after
        choice = tune.local_choice(tune.local_scores(now.judged(), now.conf, now.conf.tolerance))
        grid = stored(tune.calibration_fill(choice, images=now.features()), "calibration")  # each image by its own grid
        changed = tune.calibration_summary(grid).agg(F.coalesce(F.sum("active_cells"), F.lit(0)).alias("n")).first().n > 0
        if changed:
            tried = now.with_calibration(grid)
            after = tried.evaluate(tried.predicted())
            fine, why = tune.stage_verdict(spark, before, after)
            trace.append({"stage": "local", "accepted": fine, "status": "accepted" if fine else "rolled-back", "reason": why, **after})
            if fine:
                now, before = tried, after
        else:
            trace.append({"stage": "local", "accepted": False, "status": "no-change", "reason": "no-better-local-delta", **before})
        p = now.predicted()
        for mode in ("safe", "extended"):
            gaps = stored(topology.bridge(p, now.conf, mode, now.features()), "gaps")
            n = gaps.where("reason IS NULL").count()
            if not n:
                trace.append({"stage": mode, "accepted": False, "reason": "no-candidate", "bridges": 0, **before})
                continue
            q = stored(topology.apply_bridges(p, gaps), "bridged")
            after = now.evaluate(q, "bridged")
            fine = tune.gap_guard(spark, before, after)
            trace.append({"stage": mode, "accepted": fine, "reason": None if fine else "guard-rejected", "bridges": n if fine else 0, **after})
            if fine:
                p, before = q.drop("pred").withColumnRenamed("bridged", "pred"), after
        return now, p, trace
