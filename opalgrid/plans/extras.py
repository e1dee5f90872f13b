"""More queries of the inventory: filters, costs, registries, video figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from opalgrid.functions import costs, geometry as G
from opalgrid.operators import assign as A, match as M, metrics as X
from opalgrid.plans.boxes import by_image, by_image_sql, pairs as box_pairs
from opalgrid.plans.carrier import BOTH, DET, PAIRS, area_sql, det, gt, inter_sql, iou_sql, query, table, union_sql
from opalgrid.plans.matching import KEYS
from opalgrid.streaming import mot, tracks as K


@query("b20_corner_by_hash", f"WITH {DET}, k AS (SELECT *, ('0x' || substr(md5(image_id || '/' || det_id), 1, 8))::BIGINT % 4 AS k FROM det) SELECT image_id, det_id, CASE WHEN k % 2 = 0 THEN x1 + 2 ELSE x2 - 2 END AS x, CASE WHEN k < 2 THEN y1 + 2 ELSE y2 - 2 END AS y FROM k")
def b20(spark, sf):
    x, y = G.corner_by_hash(F.concat_ws("/", "image_id", "det_id"), G.box())
    return det(spark, sf).select("image_id", "det_id", x.alias("x"), y.alias("y"))


@query("b21_yolo", by_image_sql(tx="64 * least(greatest(((g.x1 + g.x2) - (d.x1 + d.x2)) / 2 / 32 + 0.5, 0.000001), 0.999999)", tw="ln((g.x2 - g.x1) / (d.x2 - d.x1))", w="g.x2 - g.x1"))
def b21y(spark, sf):
    t = G.yolo_encode(G.box(), G.box("g_"), 32.0)
    back = G.yolo_decode(G.box(), t, 32.0)
    return by_image(box_pairs(spark, sf), tx=64 * t[0], tw=t[2], w=back.x2 - back.x1)


@query("b22_grid_points", "SELECT r, c, (c + 0.5) * 16 AS x, (r + 0.5) * 16 AS y FROM (SELECT unnest(range(50)) AS r), (SELECT unnest(range(50)) AS c)")
def b22p(spark, sf):
    levels = spark.createDataFrame([(0, 50, 50, 16)], "level int, rows int, cols int, stride int")
    return A.grid_points(levels).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "x", "y")


@query("c7_c8_exclusions", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND (o_custkey % 9 IS NULL OR o_custkey % 9 NOT IN (0, 4))")
def c7(spark, sf):
    """Crowds and excluded identifiers leave."""
    o = table(spark, sf, "orders").withColumns({"iscrowd": (F.col("o_orderstatus") == "P").cast("int"), "pred_id": F.col("o_custkey") % 9})
    return o.where((F.col("iscrowd") != 1) & ~F.coalesce(F.col("pred_id").isin(0, 4), F.lit(False))).select("o_orderkey")


@query("c11_score_and_size_of_gt", f"WITH {BOTH} SELECT image_id, gt_id FROM gt WHERE x2 - x1 > 50 AND y2 - y1 > 45")
def c11(spark, sf):
    return gt(spark, sf).where((G.width(G.box()) > 50) & (G.height(G.box()) > 45)).select("image_id", "gt_id")


@query("c12_annotated_classes_only", f"WITH {BOTH} SELECT DISTINCT image_id, det_id FROM det d WHERE EXISTS (SELECT 1 FROM gt g WHERE g.image_id = d.image_id AND g.cls = d.cls AND g.gt_id > 3)")
def c12(spark, sf):
    return M.without_unannotated(det(spark, sf), gt(spark, sf).where("gt_id > 3")).select("image_id", "det_id")


@query("d23_occluded_recall", f"WITH {BOTH}, {PAIRS} SELECT g.image_id, g.gt_id, max(CAST(coalesce(p.score >= 0.3 AND p.iou >= 0.75, false) AS INT)) AS found FROM gt g LEFT JOIN pairs p USING (image_id, cls, gt_id) GROUP BY 1, 2")
def d23(spark, sf):
    return M.occluded_recall(gt(spark, sf), det(spark, sf)).select("image_id", "gt_id", "found")


def video_boxes(spark, sf):
    """Every ten images are a video; an object is a place and keeps its identifier."""
    d = det(spark, sf).select(F.expr("image_id div 10").alias("video"), (F.col("image_id") % 10).alias("frame_id"), "det_id", "score", "x1", "y1", "x2", "y2")
    g = d.where("det_id % 3 = 1").withColumn("track_id", F.col("det_id"))
    return g, d


@query("f21_tracking_figures")
def f21(spark, sf):
    g, d = video_boxes(spark, sf)
    p = K.track(d, "byte", high=0.5, start=0.5)
    out = mot.figures(g, p)
    return out.select("video", "n_gt", "n_pred", "hits", "misses", "false_alarms", "switches", *[F.round(c, 4).alias(c) for c in ("mota", "motp", "idf1")])


@query("f22_sequence_iou", f"WITH {BOTH}, t AS (SELECT image_id // 10 AS video, image_id % 10 AS f, det_id AS k, x1, y1, x2, y2 FROM det), g AS (SELECT image_id // 10 AS video, image_id % 10 AS f, gt_id AS k, x1 AS g_x1, y1 AS g_y1, x2 AS g_x2, y2 AS g_y2 FROM gt), j AS (SELECT * FROM t FULL JOIN g USING (video, f, k)) SELECT video, k AS track_id, round(sum(CASE WHEN x1 IS NOT NULL AND g_x1 IS NOT NULL THEN {inter_sql('', 'g_')} ELSE 0 END) / sum(CASE WHEN g_x1 IS NULL THEN {area_sql('')} WHEN x1 IS NULL THEN {area_sql('g_')} ELSE {union_sql('', 'g_')} END), 6) AS iou FROM j GROUP BY 1, 2")
def f22(spark, sf):
    name = lambda df, k: df.select(F.expr("image_id div 10").alias("video"), (F.col("image_id") % 10).alias("f"), F.col(k).alias("track_id"), "x1", "y1", "x2", "y2")
    g = name(gt(spark, sf), "gt_id")
    for c in ("x1", "y1", "x2", "y2"):
        g = g.withColumnRenamed(c, f"g_{c}")
    rows = name(det(spark, sf), "det_id").join(g, ["video", "f", "track_id"], "full")
    return X.sequence_iou(rows, ["video", "track_id"]).withColumn("iou", F.round("iou", 6))


@query("windowed_counts", "SELECT CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def l1(spark, sf):
    """Tumbling windows; the same plan runs on a stream (`tracks.windowed_counts`)."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "5 minutes"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("window.start").alias("start"), "event_type", "n")


_P = "(0.1 + d.score * 0.8)"


@query("m6_match_costs", by_image_sql(l1="abs(d.x1 - g.x1) + abs(d.y1 - g.y1) + abs(d.x2 - g.x2) + abs(d.y2 - g.y2)", overlap=f"-2 * {iou_sql('d.', 'g.')}", focal=f"-ln({_P} + 1e-12) * 0.25 * (1 - {_P}) * (1 - {_P}) + ln(1 - {_P} + 1e-12) * 0.75 * {_P} * {_P}"))
def m6(spark, sf):
    p = 0.1 + F.col("score") * 0.8
    return by_image(box_pairs(spark, sf), l1=costs.l1(G.box(), G.box("g_")), overlap=costs.overlap(G.box(), G.box("g_"), weight=2.0), focal=costs.focal(p))


@query("m7_point_in_centre_region", f"WITH {BOTH}, p AS (SELECT d.image_id, d.cls, d.det_id, g.gt_id, (g.x2 - g.x1) * (g.y2 - g.y1) AS a FROM det d JOIN gt g ON d.image_id = g.image_id AND d.cls = g.cls WHERE abs((d.x1 + d.x2) / 2 - (g.x1 + g.x2) / 2) < (g.x2 - g.x1) * 0.1 AND abs((d.y1 + d.y2) / 2 - (g.y1 + g.y2) / 2) < (g.y2 - g.y1) * 0.1) SELECT image_id, det_id, gt_id AS assigned FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls, det_id ORDER BY a, gt_id) AS r FROM p) WHERE r = 1")
def m7(spark, sf):
    """Points inside the core (a fifth) of a ground truth; of several the smallest box wins."""
    core = G.resize_about_centre(G.box("g_"), 0.2, 0.2)
    px, py = G.centre(G.box())
    near = box_pairs(spark, sf).where(G.holds_point(core, px, py)).withColumn("a", G.area(G.box("g_")))
    return near.groupBy("image_id", "cls", "det_id").agg(F.min(F.struct("a", "gt_id")).alias("b")).select("image_id", "det_id", F.col("b.gt_id").alias("assigned"))


@query("n4_box_forms", f"WITH {DET} SELECT image_id, det_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM det")
def n4(spark, sf):
    v = tuple(G.box())
    for a, b in (("xyxy", "cxcywh"), ("cxcywh", "cxcyah"), ("cxcyah", "xywh")):
        v = G.convert(v, a, b)
    return det(spark, sf).select("image_id", "det_id", *[F.round(c, 6).alias(n) for c, n in zip(v, "xywh", strict=True)])
