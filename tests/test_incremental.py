"""What is kept and updated instead of recomputed: tiles of label layers, background labels under bridges, sessions in streams; and readers that read ranges."""

import datetime as dt
import glob
import hashlib
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import bmp, frame, noise, plane

from strataloom.conf import Params
from strataloom.operators import annotations, boundary, dirty, projects, reports, topology, tune, windows
from strataloom.plans import graph
from strataloom.plans.session import Session
from strataloom.sources import raster
from strataloom.streaming import sessions

# dirty tiles ---------------------------------------------------------------------------------------------------------

DELTAS = "image_id long, seq long, layer string, x int, y int, after int"


def widened(points, r, w, h):
    return {(x + i, y + j) for x, y in points for i in range(-r, r + 1) for j in range(-r, r + 1) if 0 <= x + i < w and 0 <= y + j < h}


def layers(log, r, w, h):
    """Bands and negatives of a whole log, image by image."""
    now = {}
    for image, _, layer, x, y, after in sorted(log, key=lambda d: d[1]):
        if 0 <= x < w and 0 <= y < h:
            now[image, layer, x, y] = after
    out = set()
    for image in {k[0] for k in now}:
        of = lambda name: widened({(x, y) for (i, k, x, y), v in now.items() if i == image and k == name and v}, r, w, h)  # noqa: E731, B023
        band, neg = of("reference"), of("negative")
        out |= {(image, x, y, 1, 0) for x, y in band} | {(image, x, y, 0, 1) for x, y in neg - band}
    return out


def edit_log(n, seed, w, h, start=0):
    r = random.Random(seed)
    return [(r.randrange(2), start + i, r.choice(["reference", "negative"]), r.randrange(-3, w + 3), r.randrange(-3, h + 3), int(r.random() < 0.7)) for i in range(n)]


def test_batches_of_edits_give_what_the_whole_log_gives(spark, tmp_path):
    w, h, r = 50, 40, 2
    held, log = dirty.LabelStore(spark, f"file://{tmp_path}/store", w, h, r, tile=16), []
    assert held.counts().count() == held.masks().count() == 0
    for k, n in enumerate((60, 25, 1)):
        batch = edit_log(n, k, w, h, 1000 * k)
        log += batch
        held.apply(spark.createDataFrame(batch, DELTAS))
        want = layers(log, r, w, h)
        assert {tuple(x) for x in held.masks().collect()} == want
        counts = {x.image_id: (x.ref, x.neg) for x in held.counts().collect()}
        assert counts == {i: (sum(m[3] for m in want if m[0] == i), sum(m[4] for m in want if m[0] == i)) for i in counts}
    back = dirty.undone(spark.createDataFrame(log, DELTAS), 999).withColumn("seq", F.col("seq") + 100_000)
    held.apply(back)
    assert {tuple(x) for x in held.masks().collect()} == layers(log[:60], r, w, h)


def test_an_edit_reads_and_writes_only_the_tiles_it_can_change(spark, tmp_path):
    path, line = f"{tmp_path}/store", [(0, i, "reference", i, i, 1) for i in range(64)]
    held = dirty.LabelStore(spark, f"file://{path}", 64, 64, 2, tile=16)
    held.apply(spark.createDataFrame(line, DELTAS))
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/*/cell=*/*.parquet")}
    far = [f for f in before if "cell=0_3_3" in f]
    assert far
    for f in far:  # a read of these would fail
        with open(f, "wb") as out:
            out.write(b"broken")
    held.apply(spark.createDataFrame([(0, 1000, "negative", 15, 2, 1)], DELTAS))
    assert held.last == {"read": ["0_0_0", "0_0_1", "0_0_2", "0_1_0", "0_1_1", "0_1_2"], "replaced": ["0_0_0", "0_0_1"]}
    after = glob.glob(f"{path}/*/cell=*/*.parquet")
    changed = {f.split("cell=")[1].split("/")[0] for f in set(before) ^ set(after)}
    assert changed == {"0_0_0", "0_0_1"} and set(far) <= set(after)


# sessions ------------------------------------------------------------------------------------------------------------

STREAM = "user_id long, ts timestamp, id long, kind string, value double"


def at(ms):
    return dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)


def millis(x):
    return None if x is None else x - int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)


def run_stream(spark, tmp_path, batches, fold, watermark="10 seconds"):
    """Each batch is a run that takes the stream up where the last one left it."""
    folder = f"{tmp_path}/in"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(u, at(ms), i_, k, float(v)) for u, ms, i_, k, v in rows], STREAM).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        events = spark.readStream.schema(STREAM).parquet(f"file://{folder}")
        sessions.run(events, "user_id", fold, watermark, f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    got = spark.read.schema(f"user_id long, {sessions.SESSIONS}").parquet(f"file://{tmp_path}/out")
    return sorted((r.user_id, r.what, millis(r.start), millis(r.end), r.n, r.outcome) for r in got.collect())


def test_strokes_and_debounced_saves(spark, tmp_path):
    first = [(1, 1000, 1, "begin", 0), (1, 1500, 3, "end", 0), (1, 1200, 2, "continue", 0), (1, 1200, 2, "continue", 0), (2, 100, 9, "continue", 0), (2, 200, 10, "end", 0), (1, 60_000, 20, "continue", 0)]
    # late by less than the watermark, repeated across runs, and too late
    second = [(1, 55_000, 11, "begin", 0), (1, 55_100, 12, "end", 0), (1, 55_700, 13, "begin", 0), (1, 55_790, 14, "end", 0), (1, 1500, 3, "end", 0), (1, 2000, 30, "begin", 0), (3, 90_000, 21, "begin", 0)]
    third = [(3, 200_000, 31, "continue", 0), (1, 55_700, 13, "begin", 0)]
    got = run_stream(spark, tmp_path, [first, second, third], sessions.strokes(700))
    assert got == [(1, "save", 1500, 2200, 1, "saved"), (1, "save", 55_100, 56_490, 2, "saved"), (1, "stroke", 1000, 1500, 2, "committed"), (1, "stroke", 55_000, 55_100, 1, "committed"), (1, "stroke", 55_700, 55_790, 1, "committed")]


def test_stroke_fold():
    fold, state = sessions.strokes(700), {}
    rows, due = fold(state, [(0, 1, "begin", 0), (10, 2, "begin", 0), (20, 3, "continue", 0), (30, 4, "end", 0)], 100)
    assert rows == [{"what": "stroke", "start": 10, "end": 30, "n": 2, "outcome": "committed"}] and due == 730
    rows, due = fold(state, [(730, 5, "begin", 0)], 800)
    assert rows == [{"what": "save", "start": 30, "end": 730, "n": 1, "outcome": "saved"}] and due is None


def test_guide_fold():
    fold, state = sessions.guide_runs(2, 20), {}
    rows, _ = fold(state, [(0, 1, "verify", 50), (1, 2, "start", 0), (2, 3, "verify", 19), (3, 4, "verify", 20), (4, 5, "start", 0), (5, 6, "verify", 30), (6, 7, "verify", 30), (7, 8, "skip", 0), (8, 9, "start", 0)], 10)
    assert [(r["start"], r["end"], r["n"], r["outcome"]) for r in rows] == [(1, 4, 1, "restarted"), (4, 6, 2, "verified")] and state == {"start": 8, "verified": 0}
    assert fold(state, [(9, 10, "skip", 0)], 10)[0] == [{"what": "guide", "start": 8, "end": 9, "n": 0, "outcome": "skipped"}]


# gaps ----------------------------------------------------------------------------------------------------------------


def holed(n=40):
    g = np.zeros((n, n), int)
    g[::8] = 1
    g[:, ::8] = 1
    g[8, 12] = g[16, 20] = g[24, 4] = g[32, 20] = 0  # the last one opens a square to the frame
    return g


def grid_frame(spark):
    g = holed()
    fill = np.zeros_like(g)
    for y in range(0, 40, 8):
        for x in range(0, 40, 8):
            fill[y + 1 : y + 8, x + 1 : x + 8] = 1
    ref, z = noise(3, g.shape, 0.1), np.zeros_like(g)
    return frame(spark, pred=g, ref=ref, neg=noise(4, g.shape, 0.05) * (g == 0), excl=z, fill=fill, border_fill=z)


def test_background_after_bridges_is_that_of_a_new_labelling(spark):
    df, conf = grid_frame(spark), Params(core_erosion=1, min_core_pixels=4, negative_guard_radius=0)
    gaps = graph.stored(topology.bridge(df, conf, negative=None), "gaps")
    assert gaps.where("reason IS NULL").count() == 4
    runs = topology.backgrounds(df, "pred", (0, 1, 2))
    after = topology.bridged_backgrounds(df, runs, gaps, (0, 1, 2))
    whole = topology.backgrounds(topology.apply_bridges(df, gaps), "bridged", (0, 1, 2))
    pixels = lambda r: {(p.radius, p.y, p.x): p.root for p in topology.pixels_of(r, "radius", "root").collect()}
    assert pixels(after) == pixels(whole) and pixels(after) != pixels(runs)


def test_preview_applies_nothing_and_says_what_would_change(spark):
    df, conf = grid_frame(spark), Params(core_erosion=1, min_core_pixels=4)
    p = topology.gap_preview(df.withColumn("neg", F.lit(0)), conf).first()
    before = topology.profile_summary(topology.closure_profile(df, conf)).first()
    assert (p.bridges, p.added_pixels) == (4, 4)
    assert p.before.weighted_closure == pytest.approx(before.weighted_closure) and (p.before.closed, p.after.closed) == (15, 16)


def test_reviews_counters_and_log(spark):
    m = np.zeros((40, 60), int)
    m[10, 5:20] = m[10, 22:30] = 1  # bridged
    m[20, 5:20] = m[20, 22:30] = 1  # guarded by a negative
    m[30, 5:20] = 1
    m[31:37, 21] = 1  # out of angle
    neg = np.zeros_like(m)
    neg[20, 21] = 1
    df = frame(spark, pred=m, neg=neg, excl=np.zeros_like(m))
    scan = topology.gap_scan(df, Params())
    bridged = topology.bridge(df, Params(), scan=scan)
    rows = topology.gap_reviews(bridged, topology.angle_rejected(scan)).orderBy("n").collect()
    assert [(r.n, r.disposition, r.rejection_reason) for r in rows] == [(1, "rejected-angle", "angle"), (2, "accepted-safe", None), (3, "rejected-negative", "negative")]
    c = topology.gap_counters(scan, bridged).first()
    assert (c.source_candidates, c.considered, c.accepted, c.added_pixels, c.n_angle, c.n_negative, c.truncated) == (2, 2, 1, 2, 1, 1, False)
    log = spark.createDataFrame([(1, 1, "apply", "safe", 3, 5), (1, 2, "revert", None, 0, 0), (1, 3, "apply", "safe", 2, 2), (1, 4, "apply", "extended", 1, 7), (2, 1, "apply", "safe", 1, 1), (2, 2, "revert", None, 0, 0)], "image_id int, seq int, action string, mode string, bridges int, pixels int")
    assert sorted((r.image_id, r.applied, r.bridges, r.pixels) for r in topology.application_log(log).collect()) == [(1, ["safe", "extended"], 3, 9), (2, [], 0, 0)]


def test_report_has_a_row_for_each_image(spark):
    df = grid_frame(spark)
    two = df.unionByName(df.withColumn("image_id", F.col("image_id") + 1).withColumn("pred", F.lit(0)))
    rows = {r.image_id: r for r in topology.report(two, Params(core_erosion=1, min_core_pixels=4), two.withColumns({"ridge": F.lit(200), "color": F.lit(200)})).collect()}
    first = min(rows)
    assert len(rows) == 2 and rows[first].endpoints.endpoints == 8 and rows[first].safe.source_candidates == 4
    assert [c.radius for c in rows[first].closure] == [0, 1, 2, 3] and len(rows[first].recovery) == 3 and rows[first].profile.regions == 25
    assert rows[first + 1].safe is None and rows[first + 1].profile.weighted_closure == 0


# calibration and guards ------------------------------------------------------------------------------------------------


def test_each_image_has_its_own_grid(spark):
    z = np.zeros((20, 20), int)
    two = frame(spark, a=z).unionByName(frame(spark, a=z).withColumn("image_id", F.col("image_id") + 1))
    image = two.agg(F.min("image_id")).first()[0]
    grid = spark.createDataFrame([(image, rx, ry, 10.0) for rx in range(4) for ry in range(4)] + [(image + 1, rx, ry, -10.0) for rx in range(4) for ry in range(4)], "image_id int, rx int, ry int, value double")
    got = {r.image_id: (r.low, r.high) for r in boundary.with_delta(two, grid).groupBy("image_id").agg(F.min("delta").alias("low"), F.max("delta").alias("high")).collect()}
    assert got == {image: (10.0, 10.0), image + 1: (-10.0, -10.0)}
    none = boundary.with_delta(two, grid.where(F.col("image_id") == image)).where(F.col("image_id") != image).agg(F.max("delta")).first()[0]
    assert none == 0.0


def test_a_stage_is_rolled_back_if_only_the_primary_score_falls(spark):
    base = {"recall": 0.8, "macro_leakage": 0.1, "roi_f1": None, "regions": 0, "weighted_closure": None, "open_after_max": 0, "mean_required_radius": None, "primary": 0.8}
    assert tune.stage_verdict(spark, base, base) == (True, None)
    assert tune.stage_verdict(spark, base, base | {"primary": 0.7979}) == (False, "primary-score-regression")
    assert tune.stage_verdict(spark, base, base | {"primary": 0.7981}) == (True, None)
    assert tune.stage_verdict(spark, base, base | {"recall": 0.7, "primary": 0.7}) == (False, "positive-recall-regression")


def test_a_snapshot_keeps_every_field(spark):
    m = noise(7, (9, 11), 0.3)
    px = frame(spark, ref=m, ref_band=m, neg=1 - m, neg_band=1 - m)
    one = px.agg(F.min("image_id").alias("image_id")).select("image_id", F.lit(11).alias("w"), F.lit(9).alias("h"), F.lit(0.5).alias("scale"), F.lit("f1").alias("fingerprint"), F.lit("a.bmp").alias("name"), F.lit(3_000_000_000).alias("size"), F.struct(F.lit(22).alias("width"), F.lit(18).alias("height"), F.lit(24).alias("bitDepth"), F.lit(True).alias("topDown"), F.lit(54).cast("long").alias("pixelOffset")).alias("header"))
    key = one.first().image_id
    seeds = spark.createDataFrame([(key, 0, 3, 4, True)], "image_id int, ord int, x int, y int, border_assisted boolean")
    rects = spark.createDataFrame([(key, 0, 1, 2, 3, 4, False, "guide")], "image_id int, ord int, x0 int, y0 int, x1 int, y1 int, verified boolean, source string")
    filled = spark.createDataFrame([(key, rx, ry, float(rx - ry), rx == ry) for rx in range(4) for ry in range(4)], "image_id int, rx int, ry int, value double, measured boolean")
    choice = spark.createDataFrame([(key, 1, 1, 4, 0.02)], "image_id int, rx int, ry int, delta int, gain double")
    guide = spark.createDataFrame([(key, 2, '{"mode":"active"}')], "image_id int, lastSuggestedRound int, lastSuggestion string")
    extra = projects.guide_part(guide).join(projects.calibration_part(filled, choice, 62), "image_id").withColumn("history", F.array(F.lit('{"kind":"tune"}')))
    docs = projects.snapshot(one, px, Params().with_(sensitivity=50).to_settings().__str__(), seeds, rects, rects, extra, F.lit("2024-05-06 07:08:09.5").cast("timestamp"))
    back = projects.restore(docs, one)
    p = back.first().p
    assert back.first().error is None and (p.appVersion, p.algorithmVersion, p.savedAt) == (projects.APP_VERSION, projects.ALGORITHM_VERSION, "2024-05-06T07:08:09.500Z")
    assert (p.source.fileName, p.source.fileSize, p.source.header.bitDepth, p.source.header.topDown) == ("a.bmp", 3_000_000_000, 24, True)
    assert p.localCalibration.baseSensitivity == 62 and p.localCalibration.measured == [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1] and [(r.rx, r.delta) for r in p.localCalibration.regions] == [(1, 4.0)]
    assert sorted(map(tuple, projects.restored_calibration(back).collect())) == sorted(map(tuple, filled.collect()))
    assert tuple(projects.restored_guide(back).first()) == (key, 2, 8, 8, 2, -1, '{"mode":"active"}') and p.history == ['{"kind":"tune"}']
    assert (plane(projects.restored_mask(back, "ref"), "ref", m.shape) == m).all() and projects.restored_rects(back, "fullEvaluationRois").first().source == "guide"


def test_edits_keep_what_they_dont_touch(spark):
    r = np.random.default_rng(4)
    z = np.zeros((20, 20), int)
    px = frame(spark, r=r.integers(0, 255, z.shape), g=r.integers(0, 255, z.shape), b=r.integers(0, 255, z.shape)).select("image_id", "y", "x", "r", "g", "b")
    labels = frame(spark, ref=noise(1, z.shape, 0.1), neg=noise(2, z.shape, 0.1), excl=z).select("image_id", "y", "x", "ref", "neg", "excl")
    s = Session(px, labels, Params(local_window=16, min_component=2))
    mask, feat = s.mask(), s.features()
    cut = labels.withColumn("excl", (F.col("x") < 10).cast("int"))
    assert s.with_labels(labels.withColumn("ref", F.lit(0))).mask() is mask and s.with_rois(None).mask() is mask and s.with_seeds(None).mask() is mask
    other = s.with_labels(cut, exclusions_changed=True)
    assert other.features() is feat and other.mask() is not mask and other.mask().where("pred = 1 AND x < 10").count() == 0 < mask.where("pred = 1 AND x < 10").count()
    grid = spark.createDataFrame([(0, rx, ry, 5.0) for rx in range(4) for ry in range(4)], "image_id int, rx int, ry int, value double")
    tuned = s.with_calibration(grid)
    assert tuned.features() is feat and tuned.with_labels(labels).calibration is None and tuned.with_labels(labels)._mask is None and tuned.with_rois(None).calibration is grid
    assert s.with_conf(s.conf.with_(sensitivity=40)).features() is feat and s.with_conf(s.conf.with_(local_window=8))._features is None


def test_flags_of_labels(spark):
    px = spark.createDataFrame([(1, 0, 0, 1, 0), (2, 0, 0, 0, 1), (3, 0, 0, 0, 0)], "image_id int, y int, x int, ref int, neg int")
    rois = spark.createDataFrame([(1, None), (1, False), (2, False)], "image_id int, verified boolean")
    seeds = spark.createDataFrame([(3,)], "image_id int")
    got = {r.image_id: tuple(r)[1:] for r in annotations.label_flags(px, px, rois, seeds).collect()}
    assert got == {1: (True, False, False, True, True), 2: (False, True, False, False, True), 3: (False, False, True, False, False)}


def test_diagnostic_report_has_a_row_for_each_image(spark):
    df = grid_frame(spark)
    two = df.unionByName(df.withColumn("image_id", F.col("image_id") + 1)).withColumn("dark", F.col("pred") * 200)
    rows = reports.diagnostic(two, Params(tolerance=1, review_radius=4), features=("dark",)).collect()
    assert len(rows) == 2 and rows[0].whole == rows[1].whole and len(rows[0].cells) == len(rows[0].region_features) == 16
    assert [t.tolerance for t in rows[0].tolerances] == [1, 2, 3, 4] and rows[0].endpoints.endpoints == 8 and rows[0].settings.tolerance == 1
    n = df.agg(F.sum("ref")).first()[0]
    assert rows[0].holdout.tuning_pixels + rows[0].holdout.validation_pixels == n and 0.1 * n < rows[0].holdout.validation_pixels < 0.3 * n
    assert 0 <= rows[0].holdout.validation_recall <= 1


# sources -------------------------------------------------------------------------------------------------------------


def test_a_large_bitmap_is_read_by_ranges(spark, tmp_path):
    """A sparse file of over 2 GB: headers take 256 bytes, fingerprints three parts more."""
    w, h = 30_000, 24_000
    size = 54 + (w * 24 + 31) // 32 * 4 * h
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", size % (1 << 32), 0, 0, 54, 40, w, h, 1, 24, 0, 0, 0, 0, 0, 0)
    name = f"{tmp_path}/large.bmp"
    with open(name, "wb") as f:
        f.write(head)
        f.seek(size - 3)
        f.write(b"\x01\x02\x03")
    assert size > 1 << 31
    row = raster.bitmaps(spark, f"file://{name}").first()
    assert (row.width, row.height, row.actualFileSize, row.error, row.bytes_read, row.fingerprint) == (w, h, size, None, 256, None)
    row = raster.bitmaps(spark, f"file://{name}", fingerprint=True).first()
    part = 65536
    want = hashlib.sha256(f"{size}|{w}|{h}|24".encode() + head + b"\0" * (2 * part - 54) + b"\0" * (part - 3) + b"\x01\x02\x03").hexdigest()
    assert (row.fingerprint, row.bytes_read) == (want, 256 + 3 * part)
    raster.register(spark)
    top = spark.read.format("bmp_preview").option("path", name).option("maxWidth", 30).option("maxHeight", 24).load()
    assert top.count() == 30 * 24 and top.agg(F.max("r")).first()[0] == 0


def test_fingerprints_of_small_files(spark, tmp_path):
    data = bmp(np.random.default_rng(1).integers(0, 256, (4, 5, 3)))
    (tmp_path / "a.bmp").write_bytes(data)
    (tmp_path / "no.bmp").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[1]: r.fingerprint for r in raster.fingerprints(spark, str(tmp_path)).collect()}
    assert got == {"a.bmp": hashlib.sha256(f"{len(data)}|5|4|24".encode() + data * 3).hexdigest(), "no.bmp": None}


@pytest.mark.parametrize("rows_per_part", [10, 1000])
def test_numbering_by_ranges(spark, rows_per_part):
    r = random.Random(2)
    rows = [(r.choice([None, 1, 2]), i) for i in r.sample(range(5000), 200)] + [(3, None)]
    got = raster.numbered(spark.createDataFrame(rows, "g int, o long").repartition(3), "g", "o", "n", rows_per_part).collect()
    want = {}
    for g in {x for x, _ in rows}:
        want |= {(g, o): i for i, o in enumerate(sorted((o for x, o in rows if x == g), key=lambda v: -1 if v is None else v))}
    assert {(x.g, x.o): x.n for x in got} == want


def test_sums_of_any_radius_have_frames_that_only_grow(spark):
    df = frame(spark, v=noise(5, (12, 15), 0.5))
    plan = windows.prefix_sum(df, F.col("v"), "s", 4)._jdf.queryExecution().executedPlan().toString()
    assert "currentrow$(), 4" not in plan and "unboundedpreceding$(), 4" in plan
    m = noise(5, (12, 15), 0.5)
    got = plane(windows.prefix_sum(df, F.col("v"), "s", 4), "s", m.shape)
    assert all(got[y, x] == m[max(0, y - 4) : y + 5, max(0, x - 4) : x + 5].sum() for y in range(12) for x in range(15))
