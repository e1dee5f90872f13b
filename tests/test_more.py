"""Registries, scoring, images, masks, memory trackers and block-wise curves against plain versions."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from opalgrid.functions import masks as K
from opalgrid.functions.geometry import box
from opalgrid.operators import match as M, metrics as X, registry as R
from opalgrid.operators.groups import per_group
from opalgrid.sources import images as I, scoring
from opalgrid.streaming import memory, mot

ROWS = "image_id long, cls string, det_id long, score double, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, seed, n, name="det_id"):
    r = np.random.default_rng(seed)
    p = r.integers(0, 60, (n, 2))
    rows = [(int(i % 5), "ab"[i % 2], i, float(r.integers(0, 20)) / 20, *map(float, a), float(a[0] + r.integers(5, 40)), float(a[1] + r.integers(5, 40))) for i, a in enumerate(p)]
    return spark.createDataFrame(rows, ROWS).withColumnRenamed("det_id", name)


def test_registry():
    g = R.Registry("thing")
    g.register("one")(lambda a=1: a)
    assert g.build("one") == 1 and g.build({"type": "one", "a": 5}) == 5 and g.names() == ["one"]
    with pytest.raises(ValueError, match="twice"):
        g.register("one")(int)
    with pytest.raises(KeyError, match="did you mean one"):
        g.get("ome")


def test_metrics_of_batches_add_up(spark):
    df = spark.createDataFrame([("a", 0.9), ("a", None), ("b", 0.6)], "cls string, iou double")
    whole = {tuple(r) for r in R.evaluate(["overlap"], [df], ["cls"]).collect()}
    parts = {tuple(r) for r in R.evaluate(["overlap"], [df.where("iou > 0.7"), df.where("iou is null or iou <= 0.7")], ["cls"]).collect()}
    assert whole == parts and ("a", "mean_iou", 0.45) in whole and ("b", "pr_75", 0.0) in whole
    none = {r.name: r.value for r in R.evaluate(["overlap", "accuracy"], [df.limit(0).withColumns({"pred_id": F.lit(1), "target_id": F.lit(1)})]).collect()}
    assert all(v is None or v == 0 for v in none.values())


def test_retry_waits_longer_and_gives_up():
    waits, left = [], [3]

    def call(row):
        if left[0]:
            left[0] -= 1
            raise scoring.Retry("busy")
        return "yes"

    assert scoring.with_retry(call, {}, 4, 1.0, 3.0, waits.append, 7) == ("yes", 4)
    assert len(waits) == 3 and 0.5 <= waits[0] <= 1.5 and 1.0 <= waits[1] <= 3.0 and 1.5 <= waits[2] <= 4.5
    left[0] = 9
    assert scoring.with_retry(call, {}, 2, 0.0, 0.0, waits.append, 7) == ("<answer>0</answer>\n[WARN] busy", 2)

    def broken(row):
        raise RuntimeError("no")

    assert scoring.with_retry(broken, {}, 4, 0.0, 0.0, waits.append, 1) == ("<answer>0</answer>\n[WARN] no", 1)


def filtered(pixels, kind):
    """A PNG whose rows use one filter of the format."""
    h, w, _ = pixels.shape
    flat = pixels.reshape(h, -1).astype(int)
    rows = []
    for y in range(h):
        above = flat[y - 1] if y else np.zeros(3 * w, int)
        left, corner = (np.concatenate([np.zeros(3, int), x[:-3]]) for x in (flat[y], above))
        p = left + above - corner
        near = np.stack([abs(p - left), abs(p - above), abs(p - corner)]).argmin(axis=0)
        guess = [0, left, above, (left + above) // 2, np.choose(near, [left, above, corner])][kind]
        rows.append(bytes([kind]) + ((flat[y] - guess) & 255).astype(np.uint8).tobytes())
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return I.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_rows_of_every_filter(kind):
    pixels = np.random.default_rng(kind).integers(0, 256, (7, 9, 3))
    assert (I.decode_png(filtered(pixels, kind)) == pixels).all() and I.size_of(filtered(pixels, kind)) == (9, 7)
    assert (I.decode_png(I.encode_png(pixels)) == pixels).all() and I.size_of(b"GIF89a") is None and I.size_of(b"") is None


def test_masks(spark):
    df = spark.createDataFrame([([5, 3, 7, 2], 10), ([2, 4, 0, 4], 4), ([], 4), ([8, 12], 5)], "runs array<int>, h int")
    got = [tuple(r) for r in df.where("h = 4").select(K.mask_area(F.col("runs")), *K.mask_box(F.col("runs"), 4)).collect()]
    assert got == [(8, 0, 0, 3, 4), (0, None, None, None, None)]
    assert [tuple(r) for r in df.where("h = 10").select(*K.mask_box(F.col("runs"), 10)).collect()] == [(0, 5, 2, 8)]


def test_curve_in_blocks_equals_one_window(spark):
    r = np.random.default_rng(3)
    rows = [("ab"[i % 2], i, None if i % 50 == 0 else float(r.choice([0.0, 0.001, 0.3, 0.9, 1.0, r.random()])), int(r.random() < 0.5)) for i in range(400)]
    t = spark.createDataFrame(rows, "cls string, det_id long, score double, tp int").withColumn("fp", 1 - F.col("tp"))
    n = spark.createDataFrame([("a", 150), ("b", 140), ("c", 3), ("d", 0)], "cls string, n_gt long")
    curve = X.precision_recall(t, n, ["cls"])
    w = W.partitionBy("cls").orderBy(F.desc("score"), "det_id")
    plain = t.withColumns({"rank": F.row_number().over(w), "ctp": F.sum("tp").over(w.rowsBetween(W.unboundedPreceding, 0))})
    key = lambda df: sorted((x.cls, x.det_id, x.rank, x.ctp) for x in df.collect())
    assert key(curve) == key(plain)
    want = {"c": 0.0}
    for cls, total in (("a", 150), ("b", 140)):
        tp = np.array([x.tp for x in plain.where(F.col("cls") == cls).orderBy("rank").collect()])
        p = np.cumsum(tp) / np.arange(1, len(tp) + 1)
        want[cls] = float((np.maximum.accumulate(p[::-1])[::-1] * tp).sum() / total)
    assert {x.cls: x.ap for x in X.average_precision(curve, n, ["cls"]).collect()} == pytest.approx(want)


def test_coco_rule_for_many_settings_equals_one_by_one(spark):
    d = boxes(spark, 1, 60)
    g = boxes(spark, 2, 40, "gt_id").withColumns({"iscrowd": (F.col("gt_id") % 7 == 0).cast("int"), "ignore": (F.col("gt_id") % 5 == 0).cast("int")})
    settings = [(t, n, *b) for t in (0.2, 0.5) for n, b in (("all", (-1.0, 1e9)), ("small", (-1.0, 400.0)))]
    every = M.coco_match_all(d, g, ["image_id", "cls"], settings)
    for t, name, lo, hi in settings:
        size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
        one = M.coco_match(d, g.withColumn("ignore", F.greatest("ignore", ((size < lo) | (size >= hi)).cast("int"))), ["image_id", "cls"], t)
        key = lambda df: sorted((x.det_id, x.matched, x.dt_ignore) for x in df.collect())
        assert key(every.where((F.col("threshold") == t) & (F.col("range") == name))) == key(one)


def test_groups_pass_whole_through_one_stream(spark):
    df = spark.createDataFrame([(k if k % 3 else None, v) for k in range(40) for v in range(k % 5 + 1)], "k long, v long")
    got = per_group(df, ["k"], ["v"], lambda g: {"n": np.array([len(g["v"])]), "s": np.array([g["v"].sum()])}, "k long, n long, s long")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.groupBy("k").agg(F.count("*"), F.sum("v")).collect()), key=str)
    assert per_group(df.limit(0), ["k"], ["v"], lambda g: {"n": g["v"]}, "k long, n long").count() == 0


@pytest.mark.parametrize("kind", ["quasi_dense", "mask_track"])
def test_memory_follows_looks_not_places(kind):
    looks = np.eye(3) * 8
    own = memory.KINDS[kind]()
    labels = np.zeros(3, int)
    place = lambda k: np.array([[k * 100.0 + 30 * i, 0, k * 100 + 30 * i + 20, 20] for i in range(3)])
    first = own.step(0, place(0), np.full(3, 0.9), labels, looks)
    order = [2, 0, 1]
    again = own.step(1, place(1), np.full(3, 0.9), labels, looks[order])
    assert sorted(first) == [0, 1, 2] and again.tolist() == [first[i] for i in order]


def test_hota_of_a_perfect_and_an_empty_tracker(spark):
    rows = [(0, f, k, float(30 * k + f), 0.0, float(30 * k + f + 20), 20.0) for f in range(6) for k in range(3)]
    g = spark.createDataFrame(rows, "video long, frame_id long, track_id long, x1 double, y1 double, x2 double, y2 double")
    best = mot.hota(g, g.withColumn("track_id", F.col("track_id") + 10)).first()
    assert best.hota == pytest.approx(1) and best.ass_a == pytest.approx(1)
    split = mot.hota(g, g.withColumn("track_id", F.col("track_id") + F.when(F.col("frame_id") < 3, 10).otherwise(20))).first()
    assert split.det_a == pytest.approx(1) and split.ass_a == pytest.approx(0.5)
    assert mot.hota(g, g.limit(0)).first().hota == 0


def test_size_of_a_track_pair(spark):
    a = spark.createDataFrame([(0, 0, f, 1, 0.0, 0.0, 10.0, 10.0, 0.5) for f in range(3)], "video long, cls long, frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double, score double")
    b = a.where("frame_id < 2").withColumnRenamed("det_id", "gt_id").drop("score")
    assert [tuple(r) for r in X.track_pairs(b, a, ["video", "cls"]).collect()] == [(0, 0, 1, 1, pytest.approx(2 / 3))]
    assert X.video_ap(b, a, 0.5).first().ap == pytest.approx(1) and X.video_ap(b, a, 0.7).first().ap == 0


def test_hard_samples_and_centre_regions(spark):
    from opalgrid.operators import assign as A

    rows = [(1, i, a, l) for i, (a, l) in enumerate([(1, 0.1), (2, 0.9), (3, 0.9), (0, 0.2), (0, None), (0, 0.7), (-1, 5.0)])]
    got = A.sample_hard(spark.createDataFrame(rows, "g int, det_id int, assigned int, loss double"), ["g"], number=4, positive_share=0.5)
    assert sorted(r.det_id for r in got.collect()) == [1, 2, 3, 5]
    assert A.sample_hard(spark.createDataFrame([], "g int, det_id int, assigned int, loss double"), ["g"]).count() == 0
    gts = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0), (1, 2, 30.0, 30.0, 70.0, 70.0)], "g int, gt_id int, x1 double, y1 double, x2 double, y2 double")
    at = lambda i, x: (1, i, x - 1, x - 1, x + 1, x + 1)
    priors = spark.createDataFrame([at(1, 50.0), at(2, 57.0), at(3, 70.0), at(4, 95.0)], "g int, det_id int, x1 double, y1 double, x2 double, y2 double")
    out = A.centre_region_assign(priors, gts, ["g"]).collect()
    assert {r.det_id: r.assigned for r in out} == {1: 2, 2: 1, 3: -1, 4: 0}


def test_approximations_speak_through_their_best(spark):
    from opalgrid.operators import assign as A

    pairs = spark.createDataFrame([(1, 1, 1, 0.2), (1, 1, 1, 0.7), (1, 2, 1, 0.45), (1, 3, 1, 0.1)], "g int, det_id int, gt_id int, iou double")
    got = {r.det_id: r.assigned for r in A.approx_max_iou_assign(pairs, ["g"]).collect()}
    assert got == {1: 1, 2: -1, 3: 0}


def test_anchor_evolution(spark):
    """Two kinds of boxes, two anchors: both are found nearly; reruns agree; no boxes give 0."""
    rows = [(20.0, 10.0)] * 30 + [(60.0, 90.0)] * 10 + [(None, 5.0)]
    b = spark.createDataFrame(rows, "w double, h double")
    (small, large), worth = X.anchor_evolution(b, 2, 5.0, 120.0, generations=40)
    share = lambda a, c: min(a[0], c[0]) * min(a[1], c[1]) / (a[0] * a[1] + c[0] * c[1] - min(a[0], c[0]) * min(a[1], c[1]))
    assert worth == pytest.approx((30 * share(small, (20, 10)) + 10 * share(large, (60, 90))) / 40) and worth > 0.85
    assert X.anchor_evolution(b, 2, 5.0, 120.0, generations=1) == X.anchor_evolution(b, 2, 5.0, 120.0, generations=1)
    assert X.anchor_evolution(b.limit(0), 1, generations=1)[1] == 0.0


def test_smoothed_tracks(spark):
    """Straight tracks stay, jitter shrinks, short tracks and rows are kept."""
    from opalgrid.streaming.tracks import smooth_tracks

    r = np.random.default_rng(1)
    line = [(1, 1, f, 2.0 * f, 5.0, 2.0 * f + 10, 15.0, 0.5) for f in range(20)]
    shaky = [(1, 2, f, *(np.array([2.0 * f, 5.0, 2.0 * f + 10, 15.0]) + r.normal(0, 1, 4)).tolist(), 0.5) for f in range(20)]
    alone = [(2, 1, 4, 1.0, 2.0, 3.0, 4.0, 0.9)]
    got = smooth_tracks(spark.createDataFrame(line + shaky + alone, "video int, track_id int, frame_id int, x1 double, y1 double, x2 double, y2 double, score double")).collect()
    assert len(got) == 41
    off = lambda rows: np.abs([x[3] - 2.0 * x[2] for x in rows]).mean()
    assert off([g for g in got if (g.video, g.track_id) == (1, 1)]) < 1e-6
    assert off([g for g in got if (g.video, g.track_id) == (1, 2)]) < off(shaky)
    assert [tuple(g) for g in got if g.video == 2] == [pytest.approx(alone[0])]
