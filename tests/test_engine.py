"""The engine on hand-built and random rasters, against plain numpy and the figures that hold for them."""

import datetime as dt
import hashlib
import io
import json
import math
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.conf import Params
from strataloom.operators import boundary, components, edits, features, fills, guide, labels, metrics, sinks, topology, tune, windows
from strataloom.plans import graph, queries
from strataloom.plans.session import Session
from strataloom.plans.tiles import tiled
from strataloom.sources import raster
from strataloom.streaming import live

KEY = ["image_id", "y", "x"]


def frame(spark, image=0, **planes):
    """Pixels of 2-D arrays, with w and h."""
    first = next(iter(planes.values()))
    h, w = first.shape
    kinds = {k: "double" if p.dtype.kind == "f" else "int" for k, p in planes.items()}
    rows = [(image, y, x, *[p[y, x].item() for p in planes.values()], w, h) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id int, y int, x int, " + ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", w int, h int")


def plane(df, column, shape, dtype=float):
    out = np.zeros(shape, dtype)
    for r in df.select("y", "x", column).collect():
        out[r.y, r.x] = r[column] if r[column] is not None else -1
    return out


def window(a, r, how):
    h, w = a.shape
    return np.array([[how(a[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]) for x in range(w)] for y in range(h)])


def noise(seed, shape, share=0.4):
    return (np.random.default_rng(seed).random(shape) < share).astype(int)


@pytest.mark.parametrize("r", [0, 1, 3])
def test_square_operators(spark, r):
    m = noise(r, (17, 23))
    df = frame(spark, m=m)
    assert (plane(windows.dilate(df, "m", "o", r), "o", m.shape) == window(m, r, np.max)).all()
    inner = np.zeros_like(m)
    h, w = m.shape
    inner[r : h - r, r : w - r] = window(m, r, np.min)[r : h - r, r : w - r]
    assert (plane(windows.erode(df, "m", "o", r), "o", m.shape) == inner).all()
    v = np.random.default_rng(1).random((17, 23))
    assert np.allclose(plane(windows.prefix_sum(frame(spark, v=v), F.col("v"), "o", r + 4), "o", v.shape), window(v, r + 4, np.sum))


def test_support_and_endpoints(spark):
    m = np.zeros((12, 20), int)
    m[6, 4:12] = 1
    df = frame(spark, m=m)
    assert plane(windows.supported(df, "m", "o"), "o", m.shape).sum() == 6
    e = windows.endpoint_proxy(df, "m").first()
    assert (e.set_pixels, e.endpoints) == (8, 2)
    found = sorted((r.x, r.y, r.out_x, r.out_y) for r in topology.endpoints(df, "m").collect())
    assert found == [(4, 6, -1.0, 0.0), (11, 6, 1.0, 0.0)]


def test_chebyshev(spark):
    m = noise(3, (20, 25), 0.03)
    got = plane(windows.chebyshev_distance(frame(spark, m=m), "m", "d", 4), "d", m.shape)
    ys, xs = np.nonzero(m)
    for y in range(20):
        for x in range(25):
            d = min((max(abs(x - a), abs(y - b)) for b, a in zip(ys, xs, strict=True)), default=99)
            assert got[y, x] == (d if d <= 4 else -1)


def walled(mask, wall):
    """Distances by the two raster passes, pixel by pixel; walls are in the way."""
    h, w = mask.shape
    d = np.where((mask == 1) & (wall == 0), 0, h + w + 1)
    for order, near in ((1, ((0, -1), (-1, 0), (-1, -1), (-1, 1))), (-1, ((0, 1), (1, 0), (1, -1), (1, 1)))):
        for y in range(h)[::order]:
            for x in range(w)[::order]:
                if d[y, x] and not wall[y, x]:
                    d[y, x] = min([d[y, x], *(d[y + b, x + a] + 1 for b, a in near if 0 <= y + b < h and 0 <= x + a < w)])
    return d


def test_distances_reach_the_review_radius(spark, tmp_path):
    """The registered queries see pixels up to 18 away, against brute force."""
    h, w, at = 45, 64, [(3, 10), (30, 12), (38, 60)]  # thin pixels (y, x); g is 0 there and 255 elsewhere
    rows = [[1.0] * 64 for _ in range(h)]
    for y, x in at:
        rows[y][(x + 21) % 64] = -1.0
    spark.createDataFrame([(y, v, 0) for y, v in enumerate(rows)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    d = np.array([[min(max(abs(x - b), abs(y - a)) for a, b in at) for x in range(w)] for y in range(h)])
    got = {r.d: r.n for r in queries.queries()["chebyshev_distance_review"](spark, str(tmp_path)).collect()}
    assert got == {k: int((d == k).sum()) for k in range(19)}
    ys, xs = np.mgrid[:h, :w]
    excl = (xs >= 3) & (xs <= 9) & (ys >= 2) & (ys <= 6)
    thin = np.zeros((h, w), int)
    thin[tuple(zip(*at, strict=True))] = 1
    far = walled(thin, excl.astype(int))[((xs + 2 * ys) % 17 == 0) & ~excl]
    near = np.sort(far[far <= 18])
    r = queries.queries()["alignment_summary_review"](spark, str(tmp_path)).first()
    rank = lambda q: near[math.floor((len(near) - 1) * q + 0.5)]
    assert (r.matched, r.unmatched, r.median, r.p90) == (len(near), len(far) - len(near), rank(0.5), rank(0.9)) and r.unmatched and r.p90 > 6
    assert r["mean"] == pytest.approx(near.mean(), abs=1e-9)


def test_ridge_against_loops(spark):
    luma = np.random.default_rng(7).random((24, 30)).astype(np.float32).astype(float)
    luma[:, 14] *= 0.2
    got = features.ridge(frame(spark, luma=luma).withColumn("luma", F.col("luma").cast("float")))
    ridge, orient, scale = (plane(got, c, luma.shape) for c in ("ridge", "orientation", "ridge_scale"))
    h, w = luma.shape
    at = lambda x, y: luma[min(h - 1, max(0, math.floor(y + 0.5))), min(w - 1, max(0, math.floor(x + 0.5)))]
    for y in range(5, h - 5):
        for x in range(5, w - 5):
            best = (0.0, 0, 0)
            for si, r in enumerate((1, 2, 4)):
                for di, (n, t, _) in enumerate(features.DIRECTIONS):
                    k = [r * (math.sqrt(2) if a and b else 1) for a, b in (n, t)]
                    ends = [max(0, (at(x + d[0] * q, y + d[1] * q) + at(x - d[0] * q, y - d[1] * q)) / 2 - luma[y, x]) for d, q in zip((n, t), k, strict=True)]
                    s = min(1, max(0, max(0, ends[0] - ends[1] * 0.68) / math.sqrt(r) / 0.16))
                    if s > best[0] + 1e-12:
                        best = (s, di, si)
            assert abs(ridge[y, x] - math.floor(best[0] * 255 + 0.5)) <= 1
            if best[0] < 1 and best[0] > 0:
                assert (orient[y, x], scale[y, x]) == best[1:]
    assert ridge[:5].sum() == ridge[:, :5].sum() == 0


def test_tiles_don_t_show(spark):
    a = np.random.default_rng(0).integers(0, 255, (40, 45))
    kernel = lambda p, x0, y0, w, h: {"o": p["a"] + np.roll(p["a"], 3, axis=0) * 2 + np.roll(p["a"], -3, axis=1)}
    df = frame(spark, a=a)
    one, many = (plane(tiled(df, ["a"], {"o": "int"}, 4, kernel, tile=t), "o", a.shape) for t in (64, 16))
    assert (one[4:-4, 4:-4] == many[4:-4, 4:-4]).all()


def test_tensor_step_and_dendrite(spark):
    y, x = np.mgrid[0:64, 0:64]
    luma = np.where(x < 32, (x // 2) % 2, (y // 2) % 2).astype(float)
    df = frame(spark, luma=luma)
    t = windows.tensor_orientation(df, "luma").withColumn("orientation", F.lit(0))
    d = plane(tiled(t, ["orientation", "dendrite_orientation", "dendrite_coherence"], {"dendrite": "int"}, 14, features.dendrite_kernel), "dendrite", luma.shape)
    assert d[20:44, 30:34].mean() > 100 and d[20:44, 15:18].mean() < 20


def test_frame_rules(spark):
    strong = np.full((40, 40), 255)
    df = frame(spark, dark=strong, ridge=strong, color=strong, dendrite=strong)
    c = boundary.candidates(df, Params(sensitivity=50))
    m = plane(c, "cand", strong.shape)
    assert m[0].sum() == m[:, 0].sum() == 0 and m[1, 1] == 1 and m[1:-1, 1:-1].all()


def test_nms_thins_a_diagonal(spark):
    y, x = np.mgrid[0:40, 0:40]
    off = np.abs(x - y)
    score = np.clip(1 - off / 5, 0, 1)
    df = frame(spark, score=score, cand=(score > 0).astype(int), orientation=np.full(x.shape, 3)).withColumns({"score": F.col("score").cast("float"), "orientation_angle": F.lit(3 * math.pi / 4).cast("float")})
    thin = plane(boundary.nms(df), "thin", x.shape)[8:-8, 8:-8]
    assert (thin == (off[8:-8, 8:-8] == 0)).all()


def test_nms_plateau_keeps_its_edges_and_middle(spark):
    score = np.zeros((30, 30))
    score[:, 12:17] = 0.8
    df = frame(spark, score=score, cand=(score > 0).astype(int), orientation=np.zeros((30, 30), int)).withColumns({"score": F.col("score").cast("float"), "orientation_angle": F.lit(0.0).cast("float")})
    thin = plane(boundary.nms(df), "thin", score.shape)[8:-8]
    assert (thin[:, [12, 14, 16]] == 1).all() and thin.sum() == 3 * len(thin)  # edges rise over one side, the middle is chosen


def flood(m, near):
    lab, n = np.zeros(m.shape, int), 0
    for y, x in np.argwhere(m):
        if lab[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        lab[y, x] = n
        while todo:
            b, a = todo.pop()
            for dy, dx in near:
                q, p = b + dy, a + dx
                if 0 <= q < m.shape[0] and 0 <= p < m.shape[1] and m[q, p] and not lab[q, p]:
                    lab[q, p] = n
                    todo.append((q, p))
    return lab


N4 = [(0, 1), (1, 0), (0, -1), (-1, 0)]
N8 = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


@pytest.mark.parametrize(("connectivity", "near", "tile"), [(4, N4, 256), (8, N8, 256), (4, N4, 5), (8, N8, 5), (8, N8, 1)])
def test_components(spark, connectivity, near, tile):
    m = noise(11, (22, 26), 0.42)
    lab = flood(m, near)
    r = components.labelled_runs(frame(spark, m=m), F.col("m") == 1, connectivity, tile)
    got = {(p.y, p.x): p.root for p in components.pixels_of(r, "root").collect()}
    assert set(got) == set(zip(*np.nonzero(m), strict=True))
    firsts = {n: min((y << 32) | x for y, x in zip(*np.nonzero(lab == n), strict=True)) for n in range(1, lab.max() + 1)}
    assert all(root == firsts[lab[at]] for at, root in got.items())


def spiral(n):
    """A line of one pixel that winds to the middle with one free pixel between its turns."""
    m = np.zeros((n, n), int)
    y = x = 0
    dy, dx = 0, 1
    m[0, 0] = 1
    while True:
        moved = False
        while 0 <= y + dy < n and 0 <= x + dx < n and not m[y + dy, x + dx] and not (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n and m[y + 2 * dy, x + 2 * dx]):
            y, x = y + dy, x + dx
            m[y, x] = 1
            moved = True
        if not moved:
            return m
        dy, dx = dx, -dy


def test_a_spiral_over_many_tiles_is_one_component(spark):
    m = spiral(40)
    r = components.labelled_runs(frame(spark, m=m), F.col("m") == 1, 4, 8)
    assert [x.n for x in r.groupBy("root").agg(F.sum(F.col("b") - F.col("a") + 1).alias("n")).collect()] == [m.sum()]
    assert r.agg(F.max(F.col("b") - F.col("a") + 1)).first()[0] <= 8
    back = components.sizes(frame(spark, m=m), F.col("m") == 0, 8)
    assert sorted(x["size"] for x in back.collect()) == sorted(np.bincount(flood(1 - m, N8)[m == 0])[1:].tolist())


def test_no_set_pixel_no_component(spark):
    assert components.sizes(frame(spark, m=np.zeros((5, 5), int)), F.col("m") == 1).collect() == []


def test_component_index_and_filter(spark):
    m = np.zeros((10, 10), int)
    m[0, 0:3] = m[5, 5] = m[9, 9] = 1
    got = [(r.label, r.size, r.edge_mask, r.first_p, r.active) for r in components.component_index(frame(spark, m=m), F.col("m") == 1, 2).orderBy("label").collect()]
    assert got == [(1, 3, 3, 0, True), (2, 1, 0, 55, False), (3, 1, 12, 99, False)]
    big = np.zeros((12, 12), int)
    big[2:6, 2:6] = 1
    big[9, 9:11] = 1
    assert plane(components.min_component(frame(spark, m=big), "m", "o", 5), "o", big.shape).sum() == 16


def scene_of(spark, pred, ref, neg=None, excl=None):
    z = np.zeros_like(pred)
    return frame(spark, pred=pred, ref=ref, neg=z if neg is None else neg, excl=z if excl is None else excl)


def test_three_states(spark):
    pred, ref, neg = (np.zeros((20, 20), int) for _ in range(3))
    ref[5, 5] = pred[5, 5] = 1
    neg[15, 15] = pred[15, 15] = 1
    pred[10, 10] = 1
    m = metrics.compare(scene_of(spark, pred, ref, neg), 1).first()
    assert (m.matched_prediction, m.false_positive, m.unknown_prediction, m.recall, m.leakage) == (1, 1, 1, 1.0, 1.0)
    excl = np.zeros_like(pred)
    excl[14:17, 14:17] = 1
    m = metrics.compare(scene_of(spark, pred, ref, neg, excl), 1).first()
    assert (m.false_positive, m.negative_pixels, m.excluded_pixels, m.leakage) == (0, 0, 9, 0.0)


def test_shift_and_tolerance(spark):
    pred, ref = np.zeros((20, 20), int), np.zeros((20, 20), int)
    ref[10, 4:16], pred[12, 4:16] = 1, 1
    got = {r.tolerance: r.recall for r in metrics.multi_tolerance(scene_of(spark, pred, ref), [1, 2]).collect()}
    assert got == {1: 0.0, 2: 1.0}
    a = metrics.alignment(scene_of(spark, pred, ref), 1, 18).first()
    assert (a.mean, a.median, a.p90, a.matched, a.unmatched) == (2.0, 2, 2, 12, 0)


def test_macro_differs_from_pixel_leakage(spark):
    neg = np.zeros((40, 40), int)
    neg[:10, :10] = 1
    neg[35, 35] = 1
    pred = np.zeros_like(neg)
    pred[35, 35] = 1
    r = metrics.regional(scene_of(spark, pred, np.zeros_like(neg), neg), 1)
    assert metrics.macro(r).first().macro_leakage == 0.5 and r.where("rx IS NULL").first().leakage == pytest.approx(1 / 101)


def test_roi_metrics(spark):
    pred, ref = np.zeros((20, 20), int), np.zeros((20, 20), int)
    ref[5, 3:9] = 1
    pred[5, 3:6] = pred[8, 8] = pred[15, 15] = 1
    rects = spark.createDataFrame([(0, 0, 2, 2, 10, 10), (0, 1, 5, 2, 12, 10)], "image_id int, ord int, x0 int, y0 int, x1 int, y1 int")
    got = {r.roi: r for r in metrics.roi_metrics(scene_of(spark, pred, ref), rects, 1).collect()}
    assert (got[0].true_positive, got[0].false_positive, got[0].matched_reference, got[0].false_negative) == (3, 1, 4, 2)
    assert got[-1].evaluated_pixels == 11 * 9 and got[-1].precision == 0.75


def test_rect_grid_join_equals_broadcast(spark, monkeypatch):
    df = frame(spark, m=np.zeros((70, 90), int))
    rects = spark.createDataFrame([(0, 0, 3, 3, 70, 66), (0, 1, 80, 0, 89, 5)], "image_id int, ord int, x0 int, y0 int, x1 int, y1 int")
    few = plane(labels.in_rects(df, rects, "i"), "i", (70, 90))
    monkeypatch.setattr(labels, "BROADCAST_RECTS", 1)
    assert (plane(labels.in_rects(df, rects, "i"), "i", (70, 90)) == few).all() and few.sum() == 68 * 64 + 60


def loop_reference(gap_at=None, shape=(40, 40)):
    m = np.zeros(shape, int)
    m[10, 10:30] = m[29, 10:30] = 1
    m[10:30, 10] = m[10:30, 29] = 1
    if gap_at:
        m[gap_at] = 0
    return m


def seeds_of(spark, rows):
    return spark.createDataFrame([(0, i, x, y, b) for i, (x, y, b) in enumerate(rows)], "image_id int, ord int, x int, y int, border_assisted boolean")


def test_fill_rules(spark):
    conf = Params(fill_safety=1)
    why = lambda ref, seeds: [r.reason for r in fills.classify_seeds(frame(spark, ref=ref), seeds_of(spark, seeds), conf).orderBy("ord").collect()]
    assert why(loop_reference(), [(20, 20, False), (21, 21, False), (10, 10, False), (2, 2, False), (-3, 4, False)]) == [None, "duplicate-region", "seed-on-boundary", "region-too-large", "seed-outside"]
    assert why(loop_reference((10, 20)), [(20, 20, False)]) == ["region-too-large"]
    top = np.zeros((60, 60), int)
    top[0:12, 20] = top[0:12, 40] = 1
    top[11, 20:41] = 1
    assert why(top, [(30, 5, False), (30, 5, True), (30, 40, True)]) == ["open-region", None, "region-too-large"]
    filled = fills.fill_mask(frame(spark, ref=loop_reference()), seeds_of(spark, [(20, 20, False)]), conf)
    assert plane(filled, "fill", (40, 40)).sum() == 16 * 16


def test_closure_profile(spark):
    conf = Params(core_erosion=1, min_core_pixels=4)
    def profile(pred):
        fill = np.zeros((40, 40), int)
        fill[13:27, 13:27] = 1
        df = frame(spark, pred=pred, fill=fill, border_fill=np.zeros_like(fill))
        return topology.profile_summary(topology.closure_profile(df, conf)).first()
    broken, whole = profile(loop_reference((10, 20))), profile(loop_reference())
    assert (broken.weighted_closure, broken.mean_required_radius, broken.open_after_max) == (0.75, 1.0, 0)
    assert (whole.weighted_closure, whole.mean_required_radius) == (1.0, 0.0)
    assert dict(broken.histogram) == {"0": 0, "1": 1, "2": 0, "3": 0, ">3": 0}
    s = topology.closure_profile(frame(spark, pred=loop_reference((10, 20))), conf, seeds=seeds_of(spark, [(20, 20, False)])).orderBy("radius").collect()
    assert [r.closed for r in s] == [0, 1, 1, 1]
    assert [r.newly_closed for r in topology.recovery(topology.closure_profile(frame(spark, pred=loop_reference((10, 20))), conf, seeds=seeds_of(spark, [(20, 20, False)]))).orderBy("radius").collect()] == [1, 0, 0]


def line_with_gap(n, shape=(24, 60)):
    m = np.zeros(shape, int)
    m[12, 5:25] = m[12, 25 + n : 50] = 1
    return m


def test_gaps(spark):
    z = np.zeros((24, 60), int)
    df = frame(spark, pred=line_with_gap(3), neg=z, excl=z)
    c = topology.gap_candidates(df, Params()).collect()
    assert [(r.x1, r.x2, r.distance, r.missing) for r in c] == [(24, 28, 4.0, 3)]
    near = frame(spark, pred=line_with_gap(1), neg=z, excl=z)
    g = topology.bridge(near, Params())
    assert [(r.reason, r.added) for r in g.collect()] == [(None, 1)]
    assert plane(topology.apply_bridges(near, g), "bridged", z.shape)[12, 25] == 1
    guard = z.copy()
    guard[12, 25] = 1
    assert topology.bridge(frame(spark, pred=line_with_gap(1), neg=guard, excl=z), Params()).first().reason == "negative"
    assert topology.bridge(frame(spark, pred=line_with_gap(1), neg=z, excl=guard), Params()).first().reason == "exclusion"


def test_extended_gap_needs_evidence(spark):
    z = np.zeros((24, 60), int)
    df = frame(spark, pred=line_with_gap(5), neg=z, excl=z, ridge=np.full(z.shape, 220), color=np.full(z.shape, 200))
    assert topology.bridge(df, Params(), "extended", df).first().reason is None
    dull = df.withColumns({"ridge": F.lit(10), "color": F.lit(10)})
    assert topology.bridge(df, Params(), "extended", dull).first().reason == "evidence"
    assert topology.bridge(df, Params(), "extended", None).first().reason == "evidence-unavailable"
    guard = z.copy()
    guard[12, 27] = 1
    assert topology.bridge(df.withColumn("neg", ((F.col("y") == 12) & (F.col("x") == 27)).cast("int")), Params(), "extended", df).first().reason == "negative"


def test_spatial_holdout(spark):
    r = np.random.default_rng(5)
    ref = (r.random((40, 40)) < np.where(np.mgrid[0:40, 0:40][1] < 10, 0.5, 0.05)).astype(int)
    got = fills.spatial_holdout(frame(spark, ref=ref)).first()
    cells = {}
    for y, x in np.argwhere(ref):
        cells[y * 4 // 40 * 4 + x * 4 // 40] = cells.get(y * 4 // 40 * 4 + x * 4 // 40, 0) + 1
    order, total = sorted(cells), int(ref.sum())
    target, want = max(1, math.floor(total * 0.2 + 0.5)), max(1, math.floor(len(order) * 0.2 + 0.5))
    best = None
    for s in range(1, (1 << len(order)) - 1):
        own = [c for i, c in enumerate(order) if s >> i & 1]
        key = (abs(sum(cells[c] for c in own) - target), abs(len(own) - want))
        if best is None or key <= best[0]:
            tie = 2166136261
            for c in own:
                tie = ((tie ^ ((c + 1) * 16777619 & 0xFFFFFFFF)) * 16777619) & 0xFFFFFFFF
            if best is None or (*key, tie) < (*best[0], best[1]):
                best = (key, tie, s, sum(cells[c] for c in own))
    assert (got.subset, got.pixels) == best[2:]


def test_component_holdout_is_neither_all_nor_none(spark):
    m = np.zeros((30, 60), int)
    for i in range(5):
        m[3 + 5 * i, 5 : 20 + 5 * i] = 1
    c = fills.component_holdout(frame(spark, ref=m)).collect()
    held = sum(r.size for r in c if r.validation)
    assert len(c) == 5 and 0 < sum(r.validation for r in c) < 5 and held >= 0.2 * m.sum()


def test_calibration_of_the_tables_rasters(spark, tmp_path):
    """The registered query fills the cells of every image from what local_sensitivity measured, against a loop."""
    r = np.random.default_rng(5)
    heights = {0: 40, 1: 20, 2: 8}  # the cells of the last one hold too little reference
    rows = [(100 * i + y, r.uniform(-0.5, 0.5, 64).tolist(), i) for i, h in heights.items() for y in range(h)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    known = {(x.image_id, x.rx, x.ry): x.delta for x in queries.queries()["local_sensitivity"](spark, str(tmp_path)).collect()}
    got = {(x.image_id, x.rx, x.ry): (x.value, x.measured) for x in queries.queries()["calibration_fill_measured"](spark, str(tmp_path)).collect()}
    assert set(got) == {(i, x, y) for i in heights for x in range(4) for y in range(4)} and any(known.values())
    for (i, x, y), (value, measured) in got.items():
        near = [((a - x) ** 2 + (b - y) ** 2, v) for (k, a, b), v in known.items() if k == i and (a - x) ** 2 + (b - y) ** 2 in (1, 2)]
        filled = sum(v / q for q, v in near) / (1.5 + sum(1 / q for q, _ in near))
        assert measured == ((i, x, y) in known) and value == pytest.approx(known.get((i, x, y), filled), abs=1e-5)
    assert {i for i, *_ in known} == {0, 1} and not all(m for (i, *_), (_, m) in got.items() if i == 1)


def test_tuning(spark):
    assert tune.coordinate_candidates("sensitivity", 62, 0) == [35, 38, 50, 62, 65, 74, 80, 86, 95]
    assert tune.coordinate_candidates("ridge_weight", 55, 2) == [0, 45, 50, 55, 60, 65]
    filled = {(r.rx, r.ry): (r.value, r.measured) for r in tune.calibration_fill(spark.createDataFrame([(0, 0, 0, 0), (0, 0, 1, 8)], "image_id int, rx int, ry int, delta int")).collect()}
    assert filled[0, 0] == (0.0, True) and filled[0, 1] == (8.0, True) and filled[1, 0][0] == pytest.approx((8 / 2) / (1.5 + 1.5)) and filled[3, 3] == (0.0, False)
    rows = [(0, 0, 0, 0, 0, 30, 0.9, 0.5, 0.60), (0, 0, 0, 10, 10, 30, 0.8, 0.9, 0.85), (0, 0, 0, 4, 4, 30, 0.89, 0.6, 0.70), (0, 1, 0, 0, 0, 5, 0.9, 0.5, 0.6)]
    rows += [(0, 2, 0, d, min(d, 2), 30, 0.5, 0.5, 0.5 + d / 100) for d in (0, 4, 10, 18)]  # the limit holds the sensitivity: what is kept is what it moved by
    rows += [(0, 3, 0, d, 0, 30, 0.5, 0.5, 0.5) for d in (0, 4, 10, 18)]
    s = spark.createDataFrame(rows, "image_id int, rx int, ry int, delta int, moved int, ref int, recall double, precision double, f1 double")
    assert sorted((r.rx, r.delta) for r in tune.local_choice(s).collect()) == [(0, 4), (2, 2), (3, 0)]


def test_guards(spark):
    base = {"recall": 0.9, "leakage": 0.1, "macro_leakage": 0.1, "roi_f1": 0.8, "regions": 5, "weighted_closure": 0.5, "open_after_max": 3, "mean_required_radius": 1.0, "primary": 0.9}
    stage = lambda **after: tune.stage_guard(spark, base, base | after)
    assert stage() == (True, None) and stage(recall=0.8951, macro_leakage=0.1049, roi_f1=0.7981, weighted_closure=0.4901, open_after_max=6, leakage=0.9) == (True, None)
    assert stage(recall=0.89, macro_leakage=0.5) == (False, "positive-recall-regression") and stage(macro_leakage=0.2, roi_f1=0.1) == (False, "macro-negative-leakage-regression")
    assert stage(roi_f1=0.79) == (False, "verified-roi-f1-regression") and stage(weighted_closure=0.48) == (False, "weighted-closure-regression") and stage(open_after_max=7) == (False, "open-at-3-regression")
    assert stage(roi_f1=None, regions=0, open_after_max=9) == (True, None) and tune.stage_guard(spark, None, base) == (False, "missing-evaluation")
    gap = lambda **after: tune.gap_guard(spark, base, base | after)
    assert gap(open_after_max=2) and gap(weighted_closure=0.51) and gap(mean_required_radius=0.9) and not gap() and not gap(open_after_max=2, recall=0.8) and not gap(open_after_max=2, macro_leakage=0.12) and not gap(open_after_max=2, roi_f1=0.7)
    assert not gap(regions=0, open_after_max=1) and gap(regions=0, primary=0.92) and not tune.gap_guard(spark, base, None)


def test_auto_tune_finds_the_dark_channel(spark):
    r = np.random.default_rng(2)
    ref = np.zeros((40, 40), int)
    ref[:, 20] = 1
    dark = np.where(ref == 1, 230, 60) + r.integers(0, 10, ref.shape)
    junk = r.integers(0, 255, ref.shape)
    neg = (np.abs(np.mgrid[0:40, 0:40][1] - 20) > 5).astype(int)
    s = frame(spark, dark=dark, ridge=junk, color=junk, dendrite=junk, orientation=np.zeros_like(ref), ref=ref, neg=neg, excl=np.zeros_like(ref)).withColumn("orientation_angle", F.lit(0.0).cast("float"))
    start = Params(sensitivity=62, dark_weight=15, ridge_weight=40, min_component=4)
    conf, found = tune.auto_tune(s, start, 2, rounds=1)
    assert found["final"]["objective"]["score"] == pytest.approx(1.0)
    assert found["baseline"]["objective"]["score"] < 0.999
    assert conf.dark_weight / sum(conf.weights().values()) > start.dark_weight / sum(start.weights().values())
    assert [x["label"] for x in found["ablation"]] == ["full", "-Dark", "-Ridge", "-Color", "-Dendrite"] and found["ablation"][1]["objective"]["score"] < found["ablation"][0]["objective"]["score"]


class PlainTuning:
    """The search by loops over one small image, as it is described, without thinning."""

    def __init__(self, planes, ref, neg, excl, roi, tolerance):
        self.planes, self.ref, self.neg, self.excl, self.roi, self.t = planes, ref, neg, excl, roi, tolerance
        self.h, self.w = ref.shape

    def wide(self, m):
        out = np.zeros_like(m)
        for y, x in zip(*np.nonzero(m), strict=True):
            out[max(0, y - self.t) : y + self.t + 1, max(0, x - self.t) : x + self.t + 1] = 1
        return out

    def score(self, pred, by_share):
        pred = pred * (1 - self.excl)
        seen, band, near = self.excl == 0, self.wide(self.ref), self.wide(pred)
        ref, neg = seen & (self.ref == 1), seen & (self.neg == 1) & (band == 0)
        div = lambda a, b: a / b if b else 0.0
        harmonic = lambda a, b: 2 * a * b / (a + b) if a + b else 0.0
        y, x = np.mgrid[0 : self.h, 0 : self.w]
        if by_share:
            cell = np.minimum(3, y * 4 // self.h) * 4 + np.minimum(3, x * 4 // self.w)
        else:
            edges = lambda n: np.searchsorted([i * n // 4 for i in range(1, 4)], np.arange(n), "right")
            cell = edges(self.h)[:, None] * 4 + edges(self.w)[None, :]
        recall, leak = div((near[ref] == 1).sum(), ref.sum()), div(pred[neg].sum(), neg.sum())
        macro = [pred[neg & (cell == c)].mean() for c in range(16) if (neg & (cell == c)).any()]
        macro = sum(macro) / len(macro) if macro else 0.0
        value = recall if not neg.any() else harmonic(recall, 1 - macro)
        out = {"recall": recall, "leakage": leak, "macro_leakage": macro, "roi_recall": None, "roi_f1": None}
        inner = seen & (self.roi == 1)
        if inner.any():
            r, p = self.ref * inner, pred * inner
            rb, pb = self.wide(r), self.wide(p)
            precision, roi_recall = div((p * rb).sum(), p.sum()), div((r * pb).sum(), r.sum())
            value = harmonic(precision, roi_recall)
            out |= {"roi_recall": roi_recall, "roi_f1": value}
        return out | {"score": value}

    def values(self, c):
        y, x = np.mgrid[0 : self.h, 0 : self.w]
        total, share = np.zeros((self.h, self.w)), np.zeros((self.h, self.w))
        for name, margin in (("dark", 0), ("ridge", 5), ("color", 7), ("dendrite", 14)):
            there = (x >= margin) & (y >= margin) & (x < self.w - margin) & (y < self.h - margin)
            weight = c.weights()[name]
            total += there * self.planes[name] / 255 * weight
            share += there * weight
        framed = (x >= 1) & (y >= 1) & (x < self.w - 1) & (y < self.h - 1) & (share > 0)
        return (framed & (total / np.maximum(share, 1e-12) >= 0.76 - c.sensitivity / 100 * 0.5)).astype(int)

    def sizes(self, c):
        raw = self.values(c) * (1 - self.excl)
        around = sum(np.pad(raw, 1)[1 + dy : 1 + dy + self.h, 1 + dx : 1 + dx + self.w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) - raw
        sup = raw * (around >= 2)
        size, seen = np.zeros_like(sup), set()
        for start in zip(*np.nonzero(sup), strict=True):
            if start in seen:
                continue
            stack, blob = [start], {start}
            while stack:
                y, x = stack.pop()
                for p in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                    if p not in blob and 0 <= p[0] < self.h and 0 <= p[1] < self.w and sup[p]:
                        blob.add(p)
                        stack.append(p)
            seen |= blob
            for p in blob:
                size[p] = len(blob)
        return size

    def better(self, a, b):
        if b is None or abs(a["score"] - b["score"]) > 1e-9:
            return b is None or a["score"] > b["score"]
        for k, sign in (("roi_recall", 1), ("recall", 1)):
            if a[k] is not None and abs(a[k] - b[k]) > 1e-9:
                return a[k] > b[k]
        return a["macro_leakage"] < b["macro_leakage"] - 1e-9

    def processed(self, c):
        return self.score((self.sizes(c) >= c.min_component).astype(int), False) | {"conf": c}

    def sized(self, c):
        size, top = self.sizes(c), None
        for least in sorted({1, 4, 8, 16, 24, 40, 64, 96, 128, 192, 256, c.min_component}):
            got = self.score((size >= least).astype(int), False) | {"conf": c.with_(min_component=least)}
            top = got if self.better(got, top) else top
        return top

    def run(self, conf, rounds):
        top = self.sized(conf)
        steps = [("baseline", top["conf"], top["score"])]
        working, standing = top["conf"], top
        for k in range(rounds):
            changed = False
            for name in ("sensitivity", "dark_weight", "ridge_weight", "color_weight", "dendrite_weight"):
                old, pick, best = getattr(working, name), None, None
                for v in tune.coordinate_candidates(name, old, k):
                    got = self.score(self.values(working.with_(**{name: v})), True)
                    if self.better(got, best):
                        best, pick = got, v
                accepted = pick == old
                if pick != old:
                    got = self.processed(working.with_(**{name: pick}))
                    if self.better(got, standing):
                        working, standing, accepted, changed = got["conf"], got, True, True
                steps.append((name, pick, accepted, getattr(working, name)))
            after = self.sized(working)
            kept = self.better(after, top)
            top = after if kept else top
            working, standing = top["conf"], top
            steps.append(("round", kept, top["conf"]))
            if not changed and not kept:
                break
        for name in ("dark_weight", "ridge_weight", "color_weight", "dendrite_weight"):
            steps.append(("without", name, self.processed(top["conf"].with_(**{name: 0}))["score"]))
        return top["conf"], steps


@pytest.mark.parametrize(("with_rois", "rounds"), [(True, 1), (False, 2)])
def test_auto_tune_step_by_step(spark, with_rois, rounds):
    """Every proposal, acceptance, component size, reversal and ablation against plain loops."""
    r = np.random.default_rng(5)
    h, w = 34, 37
    y, x = np.mgrid[0:h, 0:w]
    ref = ((x == 18) | (y == 20) & (x > 8)).astype(int)
    line = np.abs(x - 18) <= 1
    planes = {"dark": np.where(line, 190, 90) + r.integers(-40, 40, ref.shape), "ridge": np.where(ref == 1, 200, 40) + r.integers(0, 50, ref.shape), "color": r.integers(0, 255, ref.shape), "dendrite": np.where(y > 18, 180, 30) + r.integers(0, 60, ref.shape)}
    neg, excl = ((x < 12) & (y < 15) | (x > 26)).astype(int), ((x > 30) & (y < 6)).astype(int)
    roi = ((x > 10) & (x < 30) & (y > 5) & (y < 30)).astype(int) if with_rois else np.zeros_like(ref)
    s = frame(spark, **planes, orientation=np.zeros_like(ref), ref=ref, neg=neg, excl=excl, **({"roi": roi} if with_rois else {})).withColumn("orientation_angle", F.lit(0.0).cast("float"))
    start = Params(sensitivity=62, dark_weight=15, ridge_weight=40, color_weight=25, dendrite_weight=20, min_component=10, centerline_nms=False)
    plain = PlainTuning(planes, ref, neg, excl, roi, 2)
    conf, steps = plain.run(start, rounds)
    got, found = tune.auto_tune(s, start, 2, rounds)
    mine = [("baseline", found["baseline"]["parameters"], pytest.approx(found["baseline"]["objective"]["score"]))]
    for k in found["rounds"]:
        mine += [(c["name"], c["proposed"], c["accepted"], c["selected"]) for c in k["coordinates"]]
        mine.append(("round", k["accepted"], k["parameters"] if k["accepted"] else k["reverted_to"]))
    mine += [("without", a["disabled"], pytest.approx(a["objective"]["score"])) for a in found["ablation"][1:]]
    assert steps == mine and got == conf


def test_guide(spark):
    images = spark.createDataFrame([(0, 1800, 1320)], "image_id int, w int, h int")
    rois = guide.to_roi(guide.grid(images))
    sizes = {(r.roi_x1 - r.roi_x0 + 1, r.roi_y1 - r.roi_y0 + 1) for r in rois.collect()}
    assert sizes == {(191, 140)}
    a, b = (sorted((r.selection_rank, r.rx, r.ry) for r in guide.bootstrap(guide.grid(images), "f").collect()) for _ in range(2))
    assert a == b and len(a) == 3 and all(max(abs(p[1] - q[1]), abs(p[2] - q[2])) >= 2 for i, p in enumerate(a) for q in a[:i])
    assert guide.string_hash("") == 0x811C9DC5 and guide.string_hash("a") == 0xE40C292C
    assert all(0 <= v < 1 for v in (guide.SeededRandom(s)() for s in range(50)))
    broken = spark.createDataFrame([(0, 1, 2, 800, 400, None, 5.0, 6.0, float("nan"))], "image_id int, cell_rx int, cell_ry int, w int, h int, x0 double, y0 double, x1 double, y1 double")
    r = guide.repaired(broken).first()
    assert (r.x0, r.y0, r.x1, r.y1) == (100, 100, 199, 149)
    c = spark.createDataFrame([(0, 1, 0, 0), (0, 2, 1, 0), (0, 3, 5, 5), (0, 4, 0, 1)], "image_id int, rank int, rx int, ry int")
    assert [(r.rx, r.ry) for r in guide.spaced(c).orderBy("selection_rank").collect()] == [(0, 0), (5, 5), (1, 0)]


def test_edits(spark):
    s = spark.createDataFrame([(1, "positive", 0, 0, 4, 0, False), (2, "negative", 2, 0, 2, 3, False), (3, "negative", 2, 3, 2, 3, True)], "seq long, layer string, x0 int, y0 int, x1 int, y1 int, erase boolean")
    d = edits.stroke_deltas(s, 1)
    after = lambda n: {(r.layer, r.x, r.y) for r in edits.replay(d, n).collect()}
    assert after(1) == {("positive", x, 0) for x in range(5)}
    assert after(2) == {("positive", 0, 0), ("positive", 4, 0)} | {("negative", 2, y) for y in range(4)}
    assert after(3) == {("positive", 0, 0), ("positive", 4, 0), ("negative", 2, 0), ("negative", 2, 1)}
    c = spark.createDataFrame([(1, "p", 0, 0, 1, 0, 1), (1, "p", 0, 0, 2, 1, 0), (1, "p", 1, 0, 3, 0, 1)], "seq long, layer string, x int, y int, ord int, before int, after int")
    assert [(r.x, r.before, r.after) for r in edits.compact(c).collect()] == [(1, 0, 1)]
    cmds = [("edit", 1), ("edit", 2), ("undo", None), ("redo", None), ("undo", None), ("edit", 3), ("redo", None)]
    r = edits.cursor_after(spark.createDataFrame([(0, i, k, v) for i, (k, v) in enumerate(cmds)], "session int, ord int, command string, seq long")).first()
    assert (r.done, r.undone) == ([1, 3], [])


def test_replay_takes_the_whole_log(spark, tmp_path):
    """Edits past id 5000 count in the registered query; an undo cursor leaves out those after it."""
    log = [(i, i % 97, ("a", "b")[i % 2], float(i % 31)) for i in range(1, 12_001)]
    df = spark.createDataFrame(log, "event_id long, user_id long, event_type string, value double")
    df.write.parquet(f"{tmp_path}/events.parquet")

    def loop(cursor):
        state = {(kind, u % 64, int(v) % 48): int(i % 3 > 0) for i, u, kind, v in log if i <= cursor}
        return {k for k, v in state.items() if v}

    whole = {tuple(r) for r in queries.queries()["edit_log_replay_whole"](spark, str(tmp_path)).collect()}
    assert whole == loop(12_000) != loop(5000)
    assert {tuple(r) for r in edits.replay(queries._edits(spark, str(tmp_path)), 7000).collect()} == loop(7000)


def bmp(rgb, depth=24, top_down=False, planes=1, compression=0, magic=b"BM", cut=0):
    h, w, _ = rgb.shape
    stride = (depth * w + 31) // 32 * 4
    rows = [b"".join(bytes([b, g, r] + [0] * (depth // 8 - 3)) for r, g, b in row).ljust(stride, b"\0") for row in rgb.tolist()]
    data = b"".join(rows if top_down else rows[::-1])
    head = struct.pack("<2sIHHIIiiHHIIiiII", magic, 54 + len(data), 0, 0, 54, 40, w, -h if top_down else h, planes, depth, compression, len(data), 0, 0, 0, 0)
    return (head + data)[: len(head) + len(data) - cut]


def test_bmp(spark, tmp_path):
    rgb = np.random.default_rng(0).integers(0, 256, (4, 5, 3))
    good = {"a.bmp": bmp(rgb), "b.bmp": bmp(rgb, 32), "c.bmp": bmp(rgb, top_down=True)}
    bad = {"m.bmp": bmp(rgb, magic=b"XX"), "d.bmp": bmp(rgb, 8), "z.bmp": bmp(rgb, compression=1), "t.bmp": bmp(rgb, cut=3), "p.bmp": bmp(rgb, planes=2)}
    for name, data in {**good, **bad}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "x.txt").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: r for r in raster.bmp_headers(spark, str(tmp_path)).collect()}
    assert {k for k, r in got.items() if r.error is None} == set(good) and set(got) == {*good, *bad}
    assert (got["a.bmp"].rowStride, got["b.bmp"].bytesPerPixel, got["c.bmp"].topDown) == (16, 4, True)
    raster.register(spark)
    for name in good:
        df = spark.read.format("bmp_preview").option("path", f"{tmp_path}/{name}").option("rowsPerPartition", 2).load()
        assert (np.stack([plane(df, c, (4, 5)) for c in "rgb"], axis=2) == rgb).all()
    half = spark.read.format("bmp_preview").option("path", f"{tmp_path}/a.bmp").option("maxWidth", 2).load()
    assert half.count() == 4 and raster.preview_size(3600, 1400) == (1800, 700)
    assert raster.fingerprints(spark, f"{tmp_path}/a.bmp").first().fingerprint != raster.fingerprints(spark, f"{tmp_path}/b.bmp").first().fingerprint


def test_source_fingerprint_sees_the_whole_text(spark, tmp_path):
    """An edit anywhere in a text of up to 128 KiB changes the registered query's fingerprint."""
    base = "abcdefghij" * 13_000
    texts = [base] + [base[:i] + "#" + base[i + 1 :] for i in (0, 300, 20_000, 65_535, 65_536, 100_000, 129_999)] + ["", "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.fingerprint for r in queries.queries()["source_fingerprint_64k"](spark, str(tmp_path)).collect()}
    assert len(set(got.values())) == len(texts)
    n, part = len(base), 65536
    assert got[0] == hashlib.sha256((str(n) + base[:part] + base[n // 2 - part // 2 :][:part] + base[n - part :]).encode()).hexdigest()


def test_sinks(spark, tmp_path):
    m = noise(1, (9, 13))
    df = frame(spark, m=m)
    packed = sinks.pack_mask(df, "m").withColumns({"w": F.lit(13), "h": F.lit(9)})
    assert (plane(sinks.unpack_mask(packed), "bit", m.shape) == m).all()
    docs = sinks.project_documents(packed.select("image_id", F.col("packed").alias("reference")), Params().to_settings())
    back = sinks.read_projects(docs.unionByName(spark.createDataFrame([(1, "{}"), (2, '{"format":"other"}')], docs.schema)), "format string, formatVersion int, settings string, masks struct<reference:string>").orderBy("image_id").collect()
    assert [r.error for r in back] == [None, "not a project", "another format"] and Params.from_settings(json.loads(back[0].p.settings)) == Params()
    assert Params.from_settings({"localStrength": 70, "brush": 5}).local_strength == 0.7
    names = spark.createDataFrame([("a", 1), ("a", 2), ("", 3)], "name string, size long")
    assert sorted(r.problem for r in sinks.zip_problems(names).collect()) == ["duplicate name: a", "empty name"]
    z = sinks.stored_zip([("a.json", b"{}"), ("ü.txt", b"x")], dt.datetime(2024, 5, 6, 7, 8, 9))
    with zipfile.ZipFile(io.BytesIO(z)) as f:
        assert f.namelist() == ["a.json", "ü.txt"] and f.testzip() is None
    with pytest.raises(ValueError):
        sinks.stored_zip([("a", b""), ("a", b"")], dt.datetime(2024, 1, 1))
    colours = df.withColumn("rgba", sinks.boundary_overlay(F.col("m") == 1))
    assert sinks.write_pngs(colours, str(tmp_path / "png")).first().png[:8] == b"\x89PNG\r\n\x1a\n"
    path = str(tmp_path / "auto")
    sinks.autosave(spark.createDataFrame([("ab", "1"), ("cd", "2")], "key string, document string"), path)
    sinks.autosave(spark.createDataFrame([("ab", "3"), ("ae", "4")], "key string, document string"), path)
    assert [sinks.load_autosave(spark, path, k).first().document for k in ("ab", "ae", "cd")] == ["3", "4", "2"]
    sinks.delete_autosave(spark, path, "cd")
    assert sinks.load_autosave(spark, path, "cd").count() == 0 and sinks.load_autosave(spark, path, "ab").count() == 1
    report = json.loads(sinks.diagnostic_report(a=spark.createDataFrame([(1, "x")], "n int, s string"), b=spark.range(2)).first().report)
    assert report == {"a": [{"n": 1, "s": "x"}], "b": [{"id": 0}, {"id": 1}]}


def test_streams(spark, tmp_path):
    rows = [("p", 1, 1, 1, 1, dt.datetime(2024, 1, 1, 0, 1)), ("p", 1, 1, 2, 0, dt.datetime(2024, 1, 1, 0, 2)), ("n", 2, 2, 3, 1, dt.datetime(2024, 1, 1, 0, 30))]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], live.EDITS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = live.upsert_latest(live.edit_stream(spark, str(tmp_path / "in"), files_per_trigger=1), str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination()
    assert sorted((r.layer, r.value, r.seq) for r in live.read_latest(spark, str(tmp_path / "t")).collect()) == [("n", 1, 3), ("p", 0, 2)]
    ev = live.edit_stream(spark, str(tmp_path / "in")).select("ts", F.col("layer").alias("event_type"), F.col("seq").cast("double").alias("value"))
    live.run_to_table(live.activity(ev), str(tmp_path / "o"), str(tmp_path / "c2")).awaitTermination()
    assert [(r.event_type, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("p", 2, 3.0)]
    touched = {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in (tmp_path / "t").glob("part=*")}
    spark.createDataFrame([("p", 1, 1, 9, 7, dt.datetime(2024, 1, 1, 2, 0))], live.EDITS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live.upsert_latest(live.edit_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert sorted((r.layer, r.value, r.seq) for r in live.read_latest(spark, str(tmp_path / "t")).collect()) == [("n", 1, 3), ("p", 7, 9)]
    assert sum(touched[p.name] != sorted(f.name for f in p.glob("*.parquet")) for p in (tmp_path / "t").glob("part=*")) == 1


def test_min_labels(spark):
    e = spark.createDataFrame([(0, i, i + 1) for i in range(12)] + [(1, 5, 9)], "image_id int, a long, b long")
    got = {(r.image_id, r.node): r.root for r in graph.min_labels(e).collect()}
    assert got == {(0, i): 0 for i in range(13)} | {(1, 5): 5, (1, 9): 5}


def test_session(spark):
    r = np.random.default_rng(3)
    rgb = r.integers(150, 220, (48, 48, 3))
    rgb[:, 24] = rgb[20] = 20
    ref = np.zeros((48, 48), int)
    ref[:, 24] = ref[20] = 1
    px = frame(spark, r=rgb[..., 0], g=rgb[..., 1], b=rgb[..., 2]).drop("w", "h")
    lab = frame(spark, ref=ref, neg=1 - windows_band(ref, 5), excl=np.zeros_like(ref)).drop("w", "h")
    s = Session(px, lab, Params(local_window=32, min_component=8))
    m = s.compare()["whole"].first()
    assert m.recall > 0.9 and m.leakage < 0.2
    assert s.with_conf(s.conf.with_(sensitivity=70))._features is not None and s.with_conf(s.conf.with_(local_window=64))._features is None


def windows_band(m, r):
    return window(m, r, np.max)


def test_annotations(spark):
    from strataloom.operators import annotations as a

    rows = [(0, 1, 1, "create", "roi", 10.0, 10.0, 2.5, 3.2, "manual"), (0, 2, 2, "create", "roi", 0.0, 0.0, 1.0, 1.0, "manual"), (0, 3, 3, "create", "exclusion", 5.0, 5.0, 90.0, 9.0, None), (0, 3, 4, "edit", "exclusion", 6.0, 5.0, 20.0, 9.0, None), (0, 4, 5, "create", "roi", 1.0, 1.0, 9.0, 9.0, "precision-guide"), (0, 5, 6, "create", "roi", 1.0, 1.0, 9.0, 9.0, "manual"), (0, 5, 7, "delete", "roi", 0.0, 0.0, 0.0, 0.0, None)]
    e = spark.createDataFrame(rows, "image_id int, rect_id int, seq int, action string, kind string, x0 double, y0 double, x1 double, y1 double, source string")
    got = {r.rect_id: r for r in a.current_rects(e, 50, 40).collect()}
    assert set(got) == {1, 3, 4} and (got[1].x0, got[1].y0, got[1].x1, got[1].y1, got[1].verified) == (2, 3, 10, 10, True)
    assert (got[3].x0, got[3].x1, got[3].verified, got[4].verified, got[4].ord) == (6, 20, None, False, 1)
    ref = np.zeros((20, 20), int)
    ref[5, :] = ref[6, :5] = 1
    px = frame(spark, ref=ref, excl=np.zeros_like(ref))
    rois = spark.createDataFrame([(0, 0, 0, 0, 19, 9), (0, 1, 0, 10, 19, 19), (0, 2, 0, 0, 3, 9), (0, 3, 0, 0, 3, 3)], "image_id int, ord int, x0 int, y0 int, x1 int, y1 int")
    inside = a.reference_inside(px, rois)
    assert {r.ord: r.reference for r in inside.collect()} == {0: 25, 1: 0, 2: 8, 3: 0}
    cmd = spark.createDataFrame([(0, 0, 1, "activate"), (0, 0, 2, "verify"), (0, 0, 3, "skip"), (0, 1, 4, "verify"), (0, 2, 5, "skip")], "image_id int, ord int, seq int, command string")
    assert {r.ord: r.state for r in a.guide_states(rois, cmd, inside).collect()} == {0: "verified", 1: "suggested", 2: "skipped", 3: "suggested"}
    done = cmd.unionByName(spark.createDataFrame([(0, None, 9, "finish")], cmd.schema))
    assert {r.ord: r.state for r in a.guide_states(rois, done, inside).collect()} == {0: "verified", 1: "dropped", 2: "skipped", 3: "dropped"}
    s = spark.createDataFrame([(0, 0, 3, 3), (0, 1, 3, 3), (0, 2, 4, 3)], "image_id int, ord int, x int, y int")
    assert sorted(r.ord for r in a.added_seeds(s).collect()) == [0, 2]
    x, y = a.screen_to_preview(F.lit(25.0), F.lit(12.0), 5, 2, 2, 20, 20)
    p = spark.range(1).select(x.alias("x"), y.alias("y"), a.screen_to_preview(F.lit(1.0), F.lit(1.0), 5, 2, 2, 20, 20)[0].alias("out")).first()
    assert (p.x, p.y, p.out) == (10, 5, None)
    with zipfile.ZipFile(io.BytesIO(a.bundle({"a": 1}, {"mask": (1, 1, b"\0\0\0\xff")}, dt.datetime(2024, 1, 1)))) as z:
        assert z.namelist() == ["manifest.json", "diagnostic.json", "mask.png"]
    h = spark.createDataFrame([(i,) for i in range(100)], "timestamp int")
    assert a.append_history(h, spark.createDataFrame([(500,)], h.schema)).agg(F.min("timestamp"), F.count("*")).first()[:] == (1, 100)


def test_optimize_never_loses(spark):
    r = np.random.default_rng(8)
    rgb = r.integers(150, 200, (36, 36, 3))
    rgb[:, 18] = 20
    rgb[17, 18] = 180
    ref = np.zeros((36, 36), int)
    ref[:, 18] = 1
    px = frame(spark, r=rgb[..., 0], g=rgb[..., 1], b=rgb[..., 2]).drop("w", "h")
    lab = frame(spark, ref=ref, neg=1 - windows_band(ref, 4), excl=np.zeros_like(ref)).drop("w", "h")
    s = Session(px, lab, Params(local_window=32, min_component=4, sensitivity=50))
    _, mask, trace = s.optimize(rounds=1)
    assert [t["stage"] for t in trace][:2] == ["baseline", "global"] and {t["stage"] for t in trace} >= {"safe", "extended"}
    kept = [t for t in trace if t.get("accepted", True)]
    assert kept[-1]["primary"] >= trace[0]["primary"] - 0.002 and mask.count() == 36 * 36


def test_negative_holdout(spark):
    """Lines and closed regions go to one side as wholes; both sides together are all negatives, less the reference."""
    ref = np.zeros((60, 64), int)
    for y, x in ((4, 4), (4, 34), (32, 4)):
        ref[y : y + 21, [x, x + 21]] = 1
        ref[[y, y + 20], x : x + 22] = 1
    line = np.zeros_like(ref)
    line[30, 5:45] = line[56, 5:45] = line[33:55, 60] = 1
    s = frame(spark, ref=ref, neg_line=line)
    seeds = spark.createDataFrame([(0, k, x + 10, y + 10, False) for k, (y, x) in enumerate(((4, 4), (4, 34), (32, 4)))], "image_id int, ord int, x int, y int, border_assisted boolean")
    conf = Params(fill_safety=1)
    got = fills.negative_holdout(s, seeds, conf, radius=1)
    tune, held = plane(got, "neg_tune", ref.shape, int), plane(got, "neg_validation", ref.shape, int)
    fill = plane(fills.fill_mask(s, seeds, conf), "fill", ref.shape, int)
    assert ((tune | held) == ((window(line, 1, np.max) | fill) & (1 - ref))).all() and not (tune & held).any() and tune.any()
    assert held.sum() >= 20 and len({int(tune[y + 10, x + 10]) for y, x in ((4, 4), (4, 34), (32, 4))}) == 2
    assert fills.holdout_summary(got).first().mode == "independent-region-holdout"
    none = fills.negative_holdout(s.withColumn("neg_line", F.lit(0)), seeds.limit(0), conf)
    assert fills.holdout_summary(none).first().asDict() == {"image_id": 0, "tuning_pixels": 0, "validation_pixels": 0, "mode": "no-negative-labels"}


def test_walled_distance(spark):
    """The two passes with exclusions in the way, against the passes pixel by pixel, over several tiles."""
    h, w, far = 23, 41, 9
    mask, wall = noise(4, (h, w), 0.03), noise(9, (h, w), 0.25)
    d = walled(mask, wall)
    got = plane(windows.chebyshev_distance(frame(spark, m=mask, e=wall), "m", "d", far, "e"), "d", (h, w), int)
    assert (got == np.where(d <= far, d, -1)).all()


def test_windows_share_their_exchanges(spark):
    """Whatever the number of columns: two exchanges for the label bands, two for the local contrast."""
    s = frame(spark, pred=noise(1, (9, 9)), ref=noise(2, (9, 9)), neg=noise(3, (9, 9)), excl=noise(4, (9, 9)), luma=noise(5, (9, 9)).astype(float))
    for df in (labels.with_bands(s, 2), windows.local_dark(s, F.col("luma"), "o", 3, 0.7)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2


def test_prefix_sums_with_holes(spark):
    """Frames go by coordinate: a missing pixel counts as nothing and shifts nothing."""
    v, there = np.random.default_rng(7).random((12, 15)), noise(8, (12, 15), 0.7)
    df = frame(spark, v=v, there=there).where("there = 1")
    got = plane(windows.prefix_sum(df, F.col("v"), "o", 2), "o", v.shape)
    rows = np.array([[(v * there)[y, max(0, x - 2) : x + 3].sum() for x in range(15)] for y in range(12)])
    want = np.array([[sum(rows[k, x] for k in range(max(0, y - 2), min(12, y + 3)) if there[k, x]) for x in range(15)] for y in range(12)])
    assert (np.abs(got - want) < 1e-9)[there == 1].all()
