"""Steps that must not send pixels to the driver, nor gather an image in one task."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strataloom.conf import Params
from strataloom.operators import components, edits, metrics, sinks, topology, windows
from strataloom.sources import raster
from strataloom.streaming import sessions


def _px(spark, h, w, seed=1, images=(1,)):
    m = np.random.default_rng(seed).integers(0, 2, (h, w))
    return m, spark.createDataFrame([(i, y, x, int(m[y, x]), w, h) for i in images for y in range(h) for x in range(w)], "image_id int, y int, x int, m int, w int, h int")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _grid(df, c, h, w):
    out = np.full((h, w), -1.0)
    for r in df.collect():
        assert out[r.y, r.x] == -1
        out[r.y, r.x] = r[c]
    return out


def test_sizes_are_broadcast_and_pixels_are_not(spark):
    """the hint holds, however small the planner takes the pixels to be."""
    _, px = _px(spark, 4, 4)
    logical = raster.with_size(px.select("image_id", "y", "x"))._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in logical


def test_labels_meet_pixels_by_a_shuffled_join(spark):
    """F1 to F6, F8, F19."""
    m, px = _px(spark, 9, 9)
    lab = components.label_pixels(px, F.col("m") == 1, 8)
    assert "SortMergeJoin" in _plan(lab)
    assert lab.count() == m.sum()


@pytest.mark.parametrize("radius", [1, 2, 5])
def test_bands_change_no_result(spark, monkeypatch, radius):
    """F11 to F17: bands lower than the radius, too."""
    monkeypatch.setattr(windows, "BAND", 4)
    h, w = 13, 6
    m, px = _px(spark, h, w)
    cut = lambda y, x: m[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
    full = (2 * radius + 1) ** 2
    df = windows.separable_many(px, {"wide": ("m", radius, F.max), "many": ("m", radius, F.sum), "same": ("m", 0, F.max)})
    for c, f in (("wide", lambda y, x: cut(y, x).max()), ("many", lambda y, x: cut(y, x).sum()), ("same", lambda y, x: m[y, x])):
        assert (_grid(df, c, h, w) == [[f(y, x) for x in range(w)] for y in range(h)]).all()
    lean = _grid(windows.erode(px, "m", "lean", radius), "lean", h, w)
    assert (lean == [[int(cut(y, x).size == full and cut(y, x).min()) for x in range(w)] for y in range(h)]).all()
    assert "_band" in _plan(df)


def test_pixel_windows_keep_all_shuffle_partitions(spark):
    """F11 to F17: few compressed bytes don't make one task of all pixels."""
    _, px = _px(spark, 40, 40)
    df = windows.dilate(px, "m", "wide", 1)
    df.collect()
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_gaps_keep_all_shuffle_partitions(spark):
    """F12 to F16: ends, crossed pairs and evidence are dealt out however few bytes the mask has; pixels are never broadcast."""
    rows = [(1, y, x, int(y == 20 and x not in (20, 21)), 40, 40, 200, 180) for y in range(40) for x in range(40)]
    px = spark.createDataFrame(rows, "image_id int, y int, x int, m int, w int, h int, ridge int, color int")
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = topology.endpoints(px, "m")
    assert {(r.y, r.x) for r in ends.collect()} == {(20, 19), (20, 22)} and ends.rdd.getNumPartitions() == most
    pairs = topology.gap_pairs(px, Params(), "m").localCheckpoint()
    crossed = topology._crossed(px, pairs, "m")
    assert [(r.x1, r.x2, r.crosses) for r in crossed.collect()] == [(19, 22, False)]
    seen = topology._evidence(topology.gap_interior(pairs.withColumn("rank", F.lit(1))), px)
    assert seen.first().evidence == pytest.approx((0.65 * 200 + 0.35 * 180) / 255)
    for df in (crossed, seen):
        assert "BroadcastHashJoin" not in _plan(df)


def test_top_gaps_are_taken_in_parts_of_an_image(spark):
    """F12 to F15: limits over 1,000 are no top-k ahead of the shuffle for Spark, so an image's pairs must not meet in one task before."""
    rng = np.random.default_rng(4)
    rows = [(i, int(y), int(x), int(y) + 1, int(x) + n, 2.0, 1.0, float(s), 1, bool(s % 2), False, 0, 0) for i in (1, 2) for n, (y, x, s) in enumerate(rng.integers(0, 9, (3000, 3)))]
    scan = spark.createDataFrame(rows, "image_id int, y1 int, x1 int, y2 int, x2 int, distance double, alignment double, score double, missing int, facing boolean, crosses boolean, oy int, ox int")
    for limit in (7, 1200, 5000):
        got = topology.ranked_gaps(scan, limit)
        for i in (1, 2):
            best = sorted((-r[7], r[1], r[2], r[3], r[4]) for r in rows if r[0] == i and r[9])[:limit]
            kept = got.where(F.col("image_id") == i).orderBy("rank").collect()
            assert [(-r.score, r.y1, r.x1, r.y2, r.x2) for r in kept] == best and [r["rank"] for r in kept] == list(range(1, len(best) + 1))
    angled = topology.angle_rejected(scan, "extended")
    for df in (topology.ranked_gaps(scan, 2400), angled):
        assert _plan(df).count("REPARTITION_BY_NUM") == 2
    out = sorted((r[0], *r[1:5]) for r in rows if not r[9])
    assert sorted((r.image_id, r.y1, r.x1, r.y2, r.x2) for r in angled.collect()) == out


def test_alignment_looks_through_exclusions_without_walls(spark):
    """a wall between reference and prediction."""
    rows = [(1, y, x, int(x == 2 and y == 4), int(x == 6 and y == 4), int(x == 4), 9, 9) for y in range(9) for x in range(9)]
    s = spark.createDataFrame(rows, "image_id int, y int, x int, ref int, pred int, excl int, w int, h int")
    seen, walled = (metrics.alignment(s, 2, 5, walls=w).first() for w in (False, True))
    assert (seen["mean"], seen["matched"], seen["unmatched"]) == (4.0, 1, 0)
    assert (walled["matched"], walled["unmatched"]) == (0, 1)


def test_masks_of_several_pieces_come_back(spark):
    """more than a piece, a last one that isn't full, a short string, and an image without pixels."""
    h, w = 37, 29
    m, px = _px(spark, h, w, images=(1, 2))
    packed = sinks.pack_mask(px, "m").withColumns({"w": F.lit(w), "h": F.lit(h)})
    assert h * w > sinks.PIECE * 6
    back = sinks.unpack_mask(packed)
    for i in (1, 2):
        assert (_grid(back.where(F.col("image_id") == i), "bit", h, w) == m).all()
    odd = sinks.unpack_mask(spark.createDataFrame([(3, "", 30, 20), (4, "", 0, 0)], "image_id int, packed string, w int, h int"))
    assert [tuple(r) for r in odd.groupBy("image_id").agg(F.count("*"), F.count("bit")).collect()] == [(3, 600, 0)]


def test_strokes_are_dealt_out_before_they_are_drawn(spark, monkeypatch):
    """counting points needs no shuffle of points; a seq that repeats is counted as one."""
    s = spark.range(400).select((F.col("id") % 390).alias("seq"), F.lit("positive").alias("layer"), *[(F.col("id") * k % 17).cast("int").alias(c) for k, c in ((3, "x0"), (5, "y0"), (7, "x1"), (11, "y1"))])
    count = lambda: edits.stroke_points(s).groupBy("seq", "x", "y").agg(F.count("*").alias("n"))
    whole = sorted(map(tuple, count().collect()))
    monkeypatch.setattr(edits, "SEGMENTS", 50)
    dealt = count()
    assert _plan(dealt).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, dealt.collect())) == whole


class _Kept(list):
    """A list state or a value state, with what a processor calls of them."""

    def get(self):
        return list(self)

    def appendValue(self, row):  # noqa: N802
        self.append(row)

    def put(self, rows):
        self[:] = rows

    update = put


def test_waiting_events_are_packed(monkeypatch):
    """an arrival is a few rows of state however many events it has; each event is folded once, in order."""
    monkeypatch.setattr(sessions, "PACK", 10, raising=False)
    states, timers, seen = {"waiting": _Kept(), "held": _Kept()}, [], []
    handle = SimpleNamespace(getListState=lambda name, _: states[name], getValueState=lambda name, _: states[name], registerTimer=timers.append)

    def fold(s, events, now):
        seen.extend(events)
        return [{"what": "n", "start": 0, "end": now, "n": len(events), "outcome": "folded"}], None

    p = sessions.InOrder("user_id", fold)
    p.init(handle)
    event = Row("user_id", "at", "ts", "id", "kind", "value")
    for some in (range(24, -1, -1), range(20, 30)):  # five come twice
        p.handleInputRows((7,), iter([event(7, None, 100 + i, i, "view", 0.1 * i) for i in some]), None)
    assert len(states["waiting"]) == 4 and timers == [100, 120]
    passed = SimpleNamespace(getCurrentWatermarkInMs=lambda: 126)
    assert [r.asDict() for r in p.handleExpiredTimer((7,), passed, None)] == [{"user_id": 7, "what": "n", "start": 0, "end": 126, "n": 27, "outcome": "folded"}]
    assert seen == [(100 + i, i, "view", 0.1 * i) for i in range(27)]
    assert len(states["waiting"]) == 1 and timers[2:] == [127]
