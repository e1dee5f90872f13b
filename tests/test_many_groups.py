"""Solvers that take many groups at once, against one group or one setting at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


def boxes(spark, n: int, what: str, seed: int):
    draw = np.random.default_rng(seed)
    rows = [(int(draw.integers(12)), "abc"[draw.integers(2 if what == "gt_id" else 3)], i + 1, float(draw.integers(20)) / 20, x, y, x + w, y + h) for i, (x, y, w, h) in enumerate(zip(*(draw.integers(a, b, n).astype(float).tolist() for a, b in ((0, 30), (0, 30), (20, 60), (20, 60))), strict=True))]
    return spark.createDataFrame(rows, f"image_id long, cls string, {what} long, score double, x1 double, y1 double, x2 double, y2 double")


def test_coco_table_follows_many_settings_in_one_row_a_detection(spark):
    from opalgrid.operators import match as M, metrics as X

    d, g = boxes(spark, 150, "det_id", 1), boxes(spark, 70, "gt_id", 2).drop("score")
    g = g.withColumns({"ignore": (F.col("gt_id") % 7 == 0).cast("int"), "iscrowd": (F.col("gt_id") % 14 == 0).cast("int")})
    ranges = {f"r{k}": (300.0 * k, 300.0 * k + 900) for k in range(7)}  # 70 settings: more than a number has bits
    got = {(r.cls, round(r.threshold, 2), r.range): r for r in X.coco_table(d, g, "image_id", "cls", ranges, most=9).collect()}
    keys = ["cls", "threshold", "range"]
    top = d.withColumn("r", F.expr("row_number() over (partition by image_id, cls order by score desc, det_id)")).where("r <= 9").drop("r")
    m = M.coco_match_all(top, g, ["image_id", "cls"], [(t, n, *b) for t in X.COCO_THRESHOLDS for n, b in ranges.items()])
    lo = F.substring("range", 2, 1).cast("int") * 300.0
    m = m.where((F.col("dt_ignore") == 0) & (F.col("matched").isNotNull() | ((F.col("area") >= lo) & (F.col("area") < lo + 900))))
    m = m.withColumns({"tp": F.col("matched").isNotNull().cast("int"), "fp": F.col("matched").isNull().cast("int")})
    n = spark.createDataFrame([(*k, r.n_gt) for k, r in got.items()], "cls string, threshold double, range string, n_gt long")
    m = m.withColumn("threshold", F.round("threshold", 2)).cache()
    n = n.withColumn("threshold", F.round("threshold", 2))
    want = X.average_precision(X.precision_recall(m, n, keys, ties=("image_id", "det_id")), n, keys, "101points").collect()
    assert len(want) == len(got) > 100
    for r in want:
        assert abs(r.ap - got[r.cls, round(r.threshold, 2), r.range].ap) < 1e-9
    hits = {(r.cls, r.threshold, r.range): r.n for r in m.where("tp = 1 and place <= 1").groupBy(*keys).agg(F.count("*").alias("n")).collect()}
    for k, r in got.items():
        assert abs(r.ar_1 - hits.get(k, 0) / r.n_gt) < 1e-9
    assert sum(r.ap > 0 for r in want) > 20


def test_coco_match_keeps_groups_without_ground_truth(spark):
    from opalgrid.operators import match as M

    d, g = boxes(spark, 60, "det_id", 3), boxes(spark, 20, "gt_id", 4).drop("score").withColumns({"ignore": F.lit(0), "iscrowd": F.lit(0)})
    out = M.coco_match(d, g.where("cls = 'a'"), ["image_id", "cls"], 0.3)
    assert "MapInArrow" in out._jdf.queryExecution().toString()  # many groups a call, no fold in the plan
    rows = out.collect()
    assert len(rows) == 60 and all(r.matched is None for r in rows if r.cls != "a") and any(r.matched for r in rows)


def test_smoothing_of_equally_long_tracks_in_one_call(spark):
    from opalgrid.streaming.tracks import smooth_tracks

    draw = np.random.default_rng(1)
    rows = [(v, t, f, *map(float, draw.normal(50, 5, 4)), 0.5) for v in range(3) for t in range(4) for f in range(1 + t * 2)]
    df = spark.createDataFrame(rows, "video int, track_id int, frame_id int, x1 double, y1 double, x2 double, y2 double, score double")
    out = smooth_tracks(df)
    assert out.rdd.getNumPartitions() >= 12  # stated, whatever the bytes
    got = {(r.video, r.track_id, r.frame_id): r.x1 for r in out.collect()}
    for v in range(3):
        for t in range(4):
            own = np.array([(r[2], r[3]) for r in rows if r[:2] == (v, t)])
            at, y = own[:, 0], own[:, 1]
            kernel = np.exp(-0.5 * ((at[:, None] - at[None]) / 10) ** 2)
            line = np.stack([np.ones_like(at), at - at.mean()], axis=1)
            trend = line @ np.linalg.lstsq(line, y, rcond=None)[0]
            want = trend + np.linalg.solve(kernel + np.eye(len(at)), kernel).T @ (y - trend)
            assert np.allclose([got[v, t, int(f)] for f in at], want, atol=1e-9)


def test_fusion_of_many_groups_equals_one_by_one():
    from opalgrid.operators.suppress import fuse_groups

    draw = np.random.default_rng(4)
    n = draw.integers(1, 12, 60)
    group = np.repeat(np.arange(60), n)
    corner = draw.integers(0, 40, (len(group), 2)).astype(float)
    box = np.concatenate([corner, corner + draw.integers(20, 40, (len(group), 2))], axis=1)
    score, model = draw.random(len(group)), draw.integers(0, 2, len(group))
    order = np.lexsort((-score, group))
    box, score, model, weights = box[order], score[order], model[order], np.array([2.0, 1.0])
    for mode in ("avg", "max", "box_and_model_avg", "absent_model_aware_avg"):
        at, boxes_, out = fuse_groups(group, box, score, model, weights, 0.4, mode)
        for g in range(60):
            own = group == g
            _, b, s = fuse_groups(np.zeros(own.sum(), int), box[own], score[own], model[own], weights, 0.4, mode)
            assert np.array_equal(boxes_[at == g], b) and np.array_equal(out[at == g], s)
    assert len(out) < len(group)
