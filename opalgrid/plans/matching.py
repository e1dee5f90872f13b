"""Joins, matching, suppression (inventory D, E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opalgrid.functions import geometry as G
from opalgrid.operators import assign as A, match as M, suppress as S
from opalgrid.plans.boxes import pairs as box_pairs
from opalgrid.plans.carrier import BOTH, DET, PAIRS, area_sql, det, gt, inter_sql, iou_sql, query, table

KEYS = ["image_id", "cls"]


def class_pairs(spark, sf, plus: int = 0) -> DataFrame:
    return M.pairs_of(gt(spark, sf), det(spark, sf), KEYS, extra=("score",), plus=plus)


def records(spark, sf) -> DataFrame:
    """Question records: one per ground truth, in order (row_idx per image is dense over all)."""
    return gt(spark, sf).select("image_id", (F.col("image_id") * 100 + F.col("gt_id")).alias("row_idx"), "gt_id")


def responses(spark, sf) -> DataFrame:
    """Responses: every detection answers, so an image has more of them than records."""
    return det(spark, sf).where("det_id % 2 = 0").select("image_id", (F.col("image_id") * 100 + F.col("det_id")).alias("row_idx"), F.concat(F.lit("<answer>"), F.col("det_id").cast("string"), F.lit("</answer>")).alias("response"))


@query("d1_zip_join", f"WITH {BOTH} SELECT DISTINCT g.image_id * 100 + gt_id AS row_idx, '<answer>' || det_id || '</answer>' AS response FROM gt g JOIN det d ON d.image_id = g.image_id AND d.det_id = g.gt_id AND d.det_id % 2 = 0")
def d1(spark, sf):
    return M.zip_join(records(spark, sf).select("row_idx"), responses(spark, sf).select("row_idx", "response"))


@query("d2_fallback_alignment", f"WITH {BOTH}, a AS (SELECT image_id, gt_id, row_number() OVER (PARTITION BY image_id ORDER BY gt_id) AS k FROM gt), b AS (SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY det_id) AS k FROM det WHERE det_id % 2 = 0) SELECT a.image_id, gt_id, coalesce('<answer>' || det_id || '</answer>', '') AS response FROM a LEFT JOIN b ON a.image_id = b.image_id AND a.k = b.k")
def d2(spark, sf):
    return M.align(records(spark, sf), responses(spark, sf), "image_id").select("image_id", "gt_id", "response")


@query("d3_box_lookup", f"WITH {BOTH} SELECT g.image_id, g.gt_id, d.x1 AS p_x1, d.y2 AS p_y2 FROM gt g LEFT JOIN (SELECT image_id, det_id % 10 AS m, arg_max(x1, det_id) AS x1, arg_max(y2, det_id) AS y2 FROM det GROUP BY 1, 2) d ON g.image_id = d.image_id AND d.m = g.gt_id % 13")
def d3(spark, sf):
    asked = gt(spark, sf).select("image_id", "gt_id", (F.col("gt_id") % 13).alias("pred_id"))
    markers = det(spark, sf).withColumn("marker_id", F.col("det_id") % 10)
    return M.lookup_box(asked, markers, order="det_id").select("image_id", "gt_id", "p_x1", "p_y2")


@query("d4_best_match", f"""WITH {BOTH}, m AS (SELECT * FROM det WHERE det_id % 4 <> 1 AND image_id % 10 <> 3),
p AS (SELECT g.image_id, g.gt_id, m.det_id, m.cls = g.cls AS same, {iou_sql('g.', 'm.')} AS iou FROM gt g LEFT JOIN m ON g.image_id = m.image_id)
SELECT image_id, gt_id, det_id AS marker_id, round(CASE WHEN det_id IS NOT NULL THEN iou END, 6) AS match_iou, CASE WHEN det_id IS NULL THEN 'no_markers' WHEN same THEN 'class_filtered' ELSE 'no_class_match' END AS match_policy
FROM (SELECT *, row_number() OVER (PARTITION BY image_id, gt_id ORDER BY coalesce(same, false) DESC, iou DESC, det_id) AS r FROM p) WHERE r = 1""")
def d4(spark, sf):
    markers = det(spark, sf).where("det_id % 4 <> 1 AND image_id % 10 <> 3").withColumnRenamed("det_id", "marker_id")
    out = M.best_match(gt(spark, sf), markers, sample="gt_id")
    return out.select("image_id", "gt_id", "marker_id", F.round("match_iou", 6).alias("match_iou"), "match_policy")




@query("d5_one_to_one", f"""WITH RECURSIVE {BOTH}, {PAIRS},
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY iou DESC, gt_id DESC, det_id DESC) AS k FROM pairs WHERE iou >= 0.3),
walk(image_id, cls, k, gs, ds, took) AS (
  SELECT image_id, cls, CAST(1 AS BIGINT), [gt_id], [det_id], true FROM r WHERE k = 1
  UNION ALL
  SELECT w.image_id, w.cls, r.k, CASE WHEN free THEN list_append(gs, gt_id) ELSE gs END, CASE WHEN free THEN list_append(ds, det_id) ELSE ds END, free
  FROM walk w JOIN r ON w.image_id = r.image_id AND w.cls = r.cls AND r.k = w.k + 1, LATERAL (SELECT NOT list_contains(gs, gt_id) AND NOT list_contains(ds, det_id) AS free))
SELECT w.image_id, w.cls, r.gt_id, r.det_id, round(r.iou, 6) AS iou FROM walk w JOIN r USING (image_id, cls, k) WHERE took""")
def d5(spark, sf):
    return M.one_to_one(class_pairs(spark, sf), KEYS, 0.3).withColumn("iou", F.round("iou", 6))


@query("d6_overlap_filter", f"WITH {BOTH}, {PAIRS} SELECT DISTINCT image_id, det_id FROM pairs WHERE iou >= 0.5")
def d6(spark, sf):
    return M.overlap_filter(det(spark, sf), class_pairs(spark, sf), KEYS, 0.5).select("image_id", "det_id")


@query("d7_stem_join", f"WITH {BOTH} SELECT DISTINCT CAST(d.image_id AS VARCHAR) AS stem FROM det d JOIN gt g USING (image_id)")
def d7(spark, sf):
    from opalgrid.functions.text import stem

    left = det(spark, sf).select(F.concat(F.lit("/a/"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("p")).select(stem(F.col("p")).alias("stem")).distinct()
    right = gt(spark, sf).select(F.concat(F.lit("/b/c/"), F.col("image_id").cast("string"), F.lit(".xml")).alias("p")).select(stem(F.col("p")).alias("stem")).distinct()
    return left.join(right, "stem")


VOC = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls, det_id ORDER BY iou DESC, gt_id) AS r FROM pairs) WHERE r = 1),
claims AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls, gt_id ORDER BY score DESC, det_id) AS c FROM best WHERE iou >= {t}),
tpfp AS (SELECT d.image_id, d.cls, d.det_id, d.score, coalesce(CASE WHEN c.gt_id % 5 <> 0 AND c.c = 1 THEN 1 END, 0) AS tp, CASE WHEN c.gt_id % 5 = 0 THEN 0 WHEN c.c = 1 THEN 0 ELSE 1 END AS fp FROM det d LEFT JOIN claims c USING (image_id, cls, det_id))"""


def voc(spark, sf, t: float = 0.5) -> DataFrame:
    return M.tpfp_voc(det(spark, sf), gt(spark, sf).withColumn("ignore", F.col("gt_id") % 5 == 0), KEYS, t)


@query("d8_tpfp_voc", f"WITH {BOTH}, {PAIRS}, {VOC.format(t=0.5)} SELECT DISTINCT image_id, det_id, tp, fp FROM tpfp")
def d8(spark, sf):
    return voc(spark, sf).select("image_id", "det_id", "tp", "fp")


def _sequential(own: str, pick: str) -> str:
    """SQL walk over the detections of a group by falling score, each taking at most one free box."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY score DESC, det_id) AS k FROM det),
c AS (SELECT p.*, o.k, row_number() OVER (PARTITION BY p.image_id, p.cls, p.det_id ORDER BY {pick}) AS pref FROM (SELECT pairs.*, g.x2 - g.x1 AS gw, g.y2 - g.y1 AS gh FROM pairs JOIN gt g USING (image_id, cls, gt_id)) p JOIN o USING (image_id, cls, det_id) WHERE {own}),
l AS (SELECT image_id, cls, k, list(gt_id ORDER BY pref) AS want FROM c GROUP BY 1, 2, 3),
walk(image_id, cls, k, used, got) AS (
  SELECT image_id, cls, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM (SELECT DISTINCT image_id, cls FROM det)
  UNION ALL
  SELECT w.image_id, w.cls, o.k, CASE WHEN f IS NULL THEN used ELSE list_append(used, f) END, f
  FROM walk w JOIN o ON w.image_id = o.image_id AND w.cls = o.cls AND o.k = w.k + 1 LEFT JOIN l ON l.image_id = o.image_id AND l.cls = o.cls AND l.k = o.k,
  LATERAL (SELECT list_filter(want, lambda x: NOT list_contains(used, x))[1] AS f))"""


@query("d9_tpfp_imagenet", f"""WITH RECURSIVE {BOTH}, {PAIRS}, {_sequential('iou >= least(gw * gh / ((gw + 10) * (gh + 10)), 0.5)', 'iou DESC, gt_id')}
SELECT o.image_id, o.det_id, CAST(got IS NOT NULL AS INT) AS tp FROM walk w JOIN o USING (image_id, cls, k)""")
def d9(spark, sf):
    return M.tpfp_imagenet(det(spark, sf), gt(spark, sf), KEYS).select("image_id", "det_id", "tp")


_SINGLE = VOC.format(t=0.5).replace("c.gt_id % 5 <> 0", "true").replace("c.gt_id % 5 = 0", "false").replace("FROM pairs)", "FROM pairs WHERE gt_id % 4 <> 0)")


@query("d10_tpfp_openimages", f"""WITH {BOTH}, {PAIRS}, {_SINGLE},
inside AS (SELECT d.image_id, d.cls, d.det_id, d.score, g.gt_id, {inter_sql('d.', 'g.')} / {area_sql('d.')} AS ioa FROM (SELECT det.* FROM det JOIN tpfp USING (image_id, cls, det_id) WHERE fp = 1) d JOIN gt g ON d.image_id = g.image_id AND d.cls = g.cls WHERE g.gt_id % 4 = 0),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls, det_id ORDER BY ioa DESC, gt_id) AS r FROM inside) WHERE r = 1 AND ioa >= 0.5),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls, gt_id ORDER BY score DESC, det_id) AS q FROM own)
SELECT DISTINCT image_id, det_id, CAST(CASE WHEN q = 1 THEN 1 ELSE tp END AS INT) AS tp, CAST(CASE WHEN q = 1 THEN 0 ELSE fp END AS INT) AS fp FROM tpfp LEFT JOIN (SELECT image_id, cls, det_id, q FROM ranked) USING (image_id, cls, det_id) WHERE q IS NULL OR q = 1""")
def d10(spark, sf):
    g = gt(spark, sf).withColumn("is_group_of", F.col("gt_id") % 4 == 0)
    return M.tpfp_openimages(det(spark, sf), g, KEYS).select("image_id", "det_id", "tp", "fp")


@query("d11_coco_match", f"""WITH RECURSIVE {BOTH}, {PAIRS}, {_sequential('iou >= 0.5', 'CASE WHEN gt_id % 5 = 0 THEN 1 ELSE 0 END, iou DESC, gt_id DESC')}
SELECT o.image_id, o.det_id, got AS matched, CASE WHEN got % 5 = 0 THEN 1 ELSE 0 END AS dt_ignore FROM walk w JOIN o USING (image_id, cls, k)""")
def d11(spark, sf):
    g = gt(spark, sf).withColumns({"ignore": (F.col("gt_id") % 5 == 0).cast("int"), "iscrowd": F.lit(0)})
    return M.coco_match(det(spark, sf), g, KEYS, 0.5).select("image_id", "det_id", "matched", "dt_ignore")


@query("d12_d13_global_greedy", f"""WITH RECURSIVE {BOTH}, {PAIRS}, top AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY image_id, cls ORDER BY score DESC, det_id) AS rk FROM pairs) WHERE rk <= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY iou DESC, gt_id, det_id) AS k FROM top),
walk(image_id, cls, k, gs, ds, took) AS (
  SELECT image_id, cls, CAST(1 AS BIGINT), [gt_id], [det_id], true FROM r WHERE k = 1
  UNION ALL
  SELECT w.image_id, w.cls, r.k, CASE WHEN free THEN list_append(gs, gt_id) ELSE gs END, CASE WHEN free THEN list_append(ds, det_id) ELSE ds END, free
  FROM walk w JOIN r ON w.image_id = r.image_id AND w.cls = r.cls AND r.k = w.k + 1, LATERAL (SELECT NOT list_contains(gs, gt_id) AND NOT list_contains(ds, det_id) AS free))
SELECT g.image_id, g.gt_id, round(coalesce(m.iou, 0), 6) AS iou FROM gt g LEFT JOIN (SELECT r.* FROM walk w JOIN r USING (image_id, cls, k) WHERE took) m USING (image_id, cls, gt_id)""")
def d13(spark, sf):
    return best_per_gt(spark, sf).select("image_id", "gt_id", F.round("iou", 6).alias("iou"))


def best_per_gt(spark, sf, proposals: int = 5) -> DataFrame:
    """Every ground truth with the IoU of the proposal matched to it (0: none)."""
    from pyspark.sql import Window as W

    p = class_pairs(spark, sf).withColumn("rk", F.dense_rank().over(W.partitionBy(*KEYS).orderBy(F.desc("score"), "det_id"))).where(F.col("rk") <= proposals)
    got = M.one_to_one(p, KEYS, None, ties="asc")
    return gt(spark, sf).join(got.select(*KEYS, "gt_id", "iou"), [*KEYS, "gt_id"], "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))


@query("d14_d15_top_k_hit", f"WITH {BOTH}, p AS (SELECT g.image_id, g.gt_id, {iou_sql('d.', 'g.')} AS iou, row_number() OVER (PARTITION BY g.image_id, g.gt_id ORDER BY d.score DESC, d.det_id) AS rank FROM gt g JOIN det d ON d.image_id = g.image_id AND d.cls = g.cls) SELECT image_id, gt_id, CAST(max(CASE WHEN rank <= 1 THEN iou END) >= 0.5 AS INT) AS hit1, CAST(max(CASE WHEN rank <= 5 THEN iou END) >= 0.5 AS INT) AS hit5, CAST(max(iou) >= 0.5 AS INT) AS hit_all FROM p GROUP BY 1, 2")
def d14(spark, sf):
    out = None
    for k, name in ((1, "hit1"), (5, "hit5"), (-1, "hit_all")):
        part = M.top_k_hit(ranked_pairs(spark, sf), ["image_id", "gt_id"], k, 0.5).withColumnRenamed("hit", name)
        out = part if out is None else out.join(part, ["image_id", "gt_id"])
    return out


def ranked_pairs(spark, sf) -> DataFrame:
    from pyspark.sql import Window as W

    return class_pairs(spark, sf).withColumn("rank", F.row_number().over(W.partitionBy("image_id", "gt_id").orderBy(F.desc("score"), "det_id")))


@query("d16_caltech", f"""WITH RECURSIVE {BOTH}, {PAIRS}, {_sequential('iou >= 0.5 AND gt_id % 4 <> 1', 'iou DESC, gt_id')},
hid AS (SELECT DISTINCT d.image_id, d.cls, d.det_id FROM det d JOIN gt g ON d.image_id = g.image_id AND d.cls = g.cls WHERE g.gt_id % 4 = 1 AND {inter_sql('d.', 'g.')} / {area_sql('d.')} >= 0.5)
SELECT o.image_id, o.det_id, CAST(got IS NOT NULL AS INT) AS tp, CASE WHEN got IS NULL AND hid.det_id IS NULL THEN 1 ELSE 0 END AS fp FROM walk w JOIN o USING (image_id, cls, k) LEFT JOIN hid ON hid.image_id = o.image_id AND hid.cls = o.cls AND hid.det_id = o.det_id""")
def d16(spark, sf):
    g = gt(spark, sf).withColumn("ignore", (F.col("gt_id") % 4 == 1).cast("int"))
    return M.caltech_match(det(spark, sf), g, KEYS).select("image_id", "det_id", "tp", "fp")


@query("d17_crowd_voc", f"WITH {BOTH}, {PAIRS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls, det_id ORDER BY iou DESC, gt_id) AS r FROM pairs) WHERE r = 1), claims AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls, gt_id ORDER BY score DESC, det_id) AS c FROM best WHERE iou >= 0.5) SELECT DISTINCT d.image_id, d.det_id, CAST(coalesce(c, 0) = 1 AS INT) AS tp FROM det d LEFT JOIN claims USING (image_id, cls, det_id)")
def d17(spark, sf):
    return M.tpfp_voc(det(spark, sf), gt(spark, sf), KEYS, 0.5).select("image_id", "det_id", "tp")


def _partial(where: str, worth: str) -> str:
    """SQL: every way to give the ground truths of a group a detection each, or none: n pairs, their worth."""
    return f"""e AS (SELECT image_id, cls, det_id, {worth} AS w, dense_rank() OVER (PARTITION BY image_id, cls ORDER BY gt_id) AS k FROM pairs WHERE {where}),
choice AS (SELECT image_id, cls, k, det_id, w, 1 AS one FROM e UNION ALL SELECT DISTINCT image_id, cls, k, NULL, 0.0, 0 FROM e),
ways(image_id, cls, k, used, n, w) AS (
  SELECT DISTINCT image_id, cls, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM e
  UNION ALL SELECT v.image_id, v.cls, c.k, CASE WHEN one = 1 THEN list_append(used, det_id) ELSE used END, n + one, v.w + c.w
  FROM ways v JOIN choice c ON c.image_id = v.image_id AND c.cls = v.cls AND c.k = v.k + 1 AND (one = 0 OR NOT list_contains(used, det_id)))"""


@query("d18_max_matching", f"WITH RECURSIVE {BOTH}, {PAIRS}, {_partial('iou >= 0.5', '0.0')} SELECT image_id, cls, max(n) AS n_matched FROM ways GROUP BY 1, 2")
def d18(spark, sf):
    return A.max_matching(class_pairs(spark, sf).where("iou >= 0.5"), KEYS, "gt_id", "det_id")


@query("d19_hungarian", f"WITH RECURSIVE {BOTH}, {PAIRS}, {_partial('iou > 0', '1 - iou')}, best AS (SELECT image_id, cls, n, min(w) AS w FROM ways GROUP BY 1, 2, 3 QUALIFY n = max(n) OVER (PARTITION BY image_id, cls)) SELECT image_id, CAST(sum(n) AS BIGINT) AS n, round(sum(w), 6) AS cost FROM best GROUP BY 1")
def d19(spark, sf):
    p = class_pairs(spark, sf).where("iou > 0").withColumn("cost", 1 - F.col("iou"))
    return A.hungarian(p, KEYS, "gt_id", "det_id", "cost").groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


@query("d20_assignment_with_limit", f"WITH RECURSIVE {BOTH}, {PAIRS}, {_partial('iou > 0', '1 - iou')}, best AS (SELECT image_id, cls, arg_min(n, w - 0.7 * n) AS n, arg_min(w, w - 0.7 * n) AS w FROM ways GROUP BY 1, 2) SELECT image_id, CAST(sum(n) AS BIGINT) AS n, round(sum(w), 6) AS cost FROM best GROUP BY 1 HAVING sum(n) > 0")
def d20(spark, sf):
    p = class_pairs(spark, sf).where("iou > 0").withColumn("cost", 1 - F.col("iou"))
    return A.hungarian(p, KEYS, "gt_id", "det_id", "cost", limit=0.7).groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


@query("d21_confusion", f"""WITH {BOTH}, p AS (SELECT d.image_id, d.det_id, g.gt_id, d.cls AS pc, g.cls AS gc FROM det d JOIN gt g ON d.image_id = g.image_id WHERE d.score >= 0.3 AND {iou_sql('d.', 'g.')} >= 0.5)
SELECT gt_class, pred_class, CAST(sum(n) AS BIGINT) AS n FROM (
SELECT gc AS gt_class, pc AS pred_class, count(*) AS n FROM p GROUP BY 1, 2
UNION ALL SELECT 'background', cls, count(*) FROM det d WHERE score >= 0.3 AND NOT EXISTS (SELECT 1 FROM p WHERE p.image_id = d.image_id AND p.det_id = d.det_id) GROUP BY 2
UNION ALL SELECT cls, 'background', count(*) FROM gt g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.image_id = g.image_id AND p.gt_id = g.gt_id AND pc = gc) GROUP BY 1) GROUP BY 1, 2""")
def d21(spark, sf):
    return M.confusion_pairs(det(spark, sf), gt(spark, sf), "image_id", "cls", 0.5, 0.3)


@query("d22_panoptic_match", "WITH px AS (SELECT l_orderkey // 4 AS image_id, l_partkey % 6 AS gt_id, CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE l_partkey % 6 END AS pred_id, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2, 3), g AS (SELECT image_id, gt_id, sum(n) AS gn FROM px GROUP BY 1, 2), p AS (SELECT image_id, pred_id, sum(n) AS pn FROM px GROUP BY 1, 2) SELECT image_id, gt_id, pred_id, round(n / (gn + pn - n), 6) AS iou FROM px JOIN g USING (image_id, gt_id) JOIN p USING (image_id, pred_id) WHERE gt_id <> 0 AND pred_id <> 0 AND n / (gn + pn - n) > 0.5")
def d22(spark, sf):
    return M.panoptic_match(pixels(spark, sf)).withColumn("iou", F.round("iou", 6))


def pixels(spark, sf) -> DataFrame:
    l = table(spark, sf, "lineitem")
    pred = F.when(F.col("l_suppkey") % 9 == 0, 0).otherwise(F.col("l_partkey") % 6)
    return l.groupBy(F.expr("l_orderkey div 4").alias("image_id"), (F.col("l_partkey") % 6).alias("gt_id"), pred.cast("long").alias("pred_id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))


@query("d24_supercategories", "SELECT cls, count(*) AS n FROM (SELECT n_name AS cls FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY cls")
def d24(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("cls"))
    up = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("cls"), F.col("r_name").alias("ancestor"))
    return M.supercategories(rows, up).groupBy("cls").agg(F.count("*").alias("n"))


@query("d25_image_annotation_join", f"WITH {BOTH} SELECT o_orderkey AS image_id, count(gt_id) AS n FROM orders JOIN gt ON o_orderkey = image_id WHERE o_orderstatus = 'F' GROUP BY 1")
def d25(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("image_id"))
    return gt(spark, sf).join(o, "image_id").groupBy("image_id").agg(F.count("gt_id").alias("n"))


def _walk_nms(threshold: float, free: str = "false", where: str = "true", group: str = "image_id, cls") -> str:
    on = " AND ".join(f"w.{k.strip()} = o.{k.strip()}" for k in group.split(","))
    cols = ", ".join(f"w.{k.strip()}" for k in group.split(","))
    hit = f"coalesce(list_bool_or(list_transform(kept, lambda b: NOT b.free AND {iou_sql('b.', 'o.').replace('coalesce', 'ifnull')} > {threshold})), false)"
    return f"""o AS (SELECT *, {free} AS free, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, det_id) AS k FROM det WHERE {where}),
walk AS (
  SELECT {group}, CAST(1 AS BIGINT) AS k, [{{'free': free, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept, true AS stays FROM o WHERE k = 1
  UNION ALL
  SELECT {cols}, o.k, CASE WHEN s THEN list_append(kept, {{'free': o.free, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) ELSE kept END, s
  FROM walk w JOIN o ON {on} AND o.k = w.k + 1, LATERAL (SELECT o.free OR NOT {hit} AS s)),
survivors AS (SELECT o.* FROM walk w JOIN o ON {on} AND w.k = o.k WHERE w.stays)"""


@query("e1_nms", f"WITH RECURSIVE {DET}, {_walk_nms(0.4, group='image_id')} SELECT image_id, det_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS r FROM survivors) WHERE r <= 10")
def e1(spark, sf):
    return S.nms(det(spark, sf), ["image_id"], 0.4, 10).select("image_id", "det_id")


@query("e2_two_band", f"WITH RECURSIVE {DET}, {_walk_nms(0.4, free='score >= 0.6')} SELECT image_id, det_id FROM survivors")
def e2(spark, sf):
    return S.two_band(det(spark, sf), KEYS, 0.6, 0.4).select("image_id", "det_id")


@query("e3_two_band_with_fallback", f"""WITH RECURSIVE {DET}, {_walk_nms(0.4, free='score >= 0.8', where='score >= 0.5')},
lone AS (SELECT image_id, cls, det_id, score, row_number() OVER (PARTITION BY image_id, cls ORDER BY score DESC, det_id) AS r, max(score) OVER (PARTITION BY image_id, cls) AS top FROM det)
SELECT image_id, det_id FROM survivors UNION ALL SELECT image_id, det_id FROM lone WHERE top < 0.5 AND r <= 2""")
def e3(spark, sf):
    return S.two_band_with_fallback(det(spark, sf), KEYS, 0.5, 0.8, 0.4).select("image_id", "det_id")


@query("e4_file_fallback", f"WITH {DET}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS r, max(score) OVER (PARTITION BY image_id) AS top FROM det) SELECT image_id, det_id FROM r WHERE score >= 0.95 OR (top < 0.95 AND r <= 2)")
def e4(spark, sf):
    return S.file_fallback(det(spark, sf), "image_id", 0.95).select("image_id", "det_id")


@query("e5_multiclass_nms", f"WITH RECURSIVE {DET}, {_walk_nms(0.3, where='score > 0.2')} SELECT image_id, det_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS r FROM survivors) WHERE r <= 8")
def e5(spark, sf):
    return S.multiclass_nms(det(spark, sf), "image_id", "cls", 0.2, 0.3, 8).select("image_id", "det_id")


@query("e6_fast_nms", f"WITH {DET} SELECT image_id, det_id FROM det a WHERE NOT EXISTS (SELECT 1 FROM det b WHERE a.image_id = b.image_id AND a.cls = b.cls AND (b.score > a.score OR (b.score = a.score AND b.det_id < a.det_id)) AND {iou_sql('a.', 'b.')} > 0.3)")
def e6(spark, sf):
    return S.fast_nms(det(spark, sf), KEYS, 0.3).select("image_id", "det_id")


@query("e7_matrix_nms", f"""WITH {DET}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY score DESC, det_id) AS k FROM det),
p AS (SELECT a.image_id, a.cls, a.k AS ka, b.k AS kb, {iou_sql('a.', 'b.')} AS iou FROM o a JOIN o b ON a.image_id = b.image_id AND a.cls = b.cls AND b.k < a.k),
w AS (SELECT image_id, cls, ka AS k, max(iou) AS m FROM p GROUP BY 1, 2, 3),
f AS (SELECT p.image_id, p.cls, p.ka AS k, min(exp(-2.0 * (iou * iou - coalesce(m, 0) * coalesce(m, 0)))) AS factor FROM p LEFT JOIN w ON w.image_id = p.image_id AND w.cls = p.cls AND w.k = p.kb GROUP BY 1, 2, 3)
SELECT o.image_id, o.det_id, round(o.score * coalesce(f.factor, 1.0), 6) AS decayed FROM o LEFT JOIN f USING (image_id, cls, k)""")
def e7(spark, sf):
    return S.matrix_nms(det(spark, sf), KEYS).select("image_id", "det_id", F.round("decayed", 6).alias("decayed"))


_FUSED = f"""o AS (SELECT *, score * CASE WHEN det_id % 2 = 0 THEN 2.0 ELSE 1.0 END AS s, row_number() OVER (PARTITION BY image_id, cls ORDER BY score * CASE WHEN det_id % 2 = 0 THEN 2.0 ELSE 1.0 END DESC, det_id) AS k FROM det),
walk(image_id, cls, k, c) AS (
  SELECT image_id, cls, CAST(1 AS BIGINT), [{{'x1': x1 * greatest(s, 1e-12), 'y1': y1 * greatest(s, 1e-12), 'x2': x2 * greatest(s, 1e-12), 'y2': y2 * greatest(s, 1e-12), 'm': greatest(s, 1e-12), 't': s, 'n': 1}}] FROM o WHERE k = 1
  UNION ALL SELECT w.image_id, w.cls, o.k, CASE WHEN top > 0.55
      THEN list_transform(c, lambda b, i: CASE WHEN i = nearest THEN {{'x1': b.x1 + o.x1 * greatest(s, 1e-12), 'y1': b.y1 + o.y1 * greatest(s, 1e-12), 'x2': b.x2 + o.x2 * greatest(s, 1e-12), 'y2': b.y2 + o.y2 * greatest(s, 1e-12), 'm': b.m + greatest(s, 1e-12), 't': b.t + s, 'n': b.n + 1}} ELSE b END)
      ELSE list_append(c, {{'x1': o.x1 * greatest(s, 1e-12), 'y1': o.y1 * greatest(s, 1e-12), 'x2': o.x2 * greatest(s, 1e-12), 'y2': o.y2 * greatest(s, 1e-12), 'm': greatest(s, 1e-12), 't': s, 'n': 1}}) END
  FROM walk w JOIN o ON o.image_id = w.image_id AND o.cls = w.cls AND o.k = w.k + 1,
  LATERAL (SELECT list_transform(list_transform(c, lambda b: {{'x1': b.x1 / b.m, 'y1': b.y1 / b.m, 'x2': b.x2 / b.m, 'y2': b.y2 / b.m}}), lambda b: {iou_sql('b.', 'o.').replace('coalesce', 'ifnull')}) AS ious), LATERAL (SELECT list_max(ious) AS top, list_position(ious, list_max(ious)) AS nearest)),
fused AS (SELECT image_id, cls, unnest(c) AS b FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY k DESC) AS r FROM walk) WHERE r = 1)"""


@query("e8_weighted_boxes_fusion", f"WITH RECURSIVE {DET}, {_FUSED} SELECT image_id, count(*) AS n, round(sum(b.t / b.n * least(b.n, 2) / 3.0), 6) AS score, round(sum((b.x1 + b.y2) / b.m), 4) AS place FROM fused GROUP BY 1")
def e8(spark, sf):
    d = det(spark, sf).withColumn("model", (F.col("det_id") % 2).cast("int"))
    out = S.weighted_boxes_fusion(d, "image_id", "cls", [2.0, 1.0], 0.55)
    return out.groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"), F.round(F.sum(F.col("x1") + F.col("y2")), 4).alias("place"))


@query("e9_top_k_above", f"WITH {DET} SELECT image_id, det_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS r FROM det WHERE score > 0.1) WHERE r <= 6")
def e9(spark, sf):
    return S.top_k_above(det(spark, sf), "image_id", 0.1, 6).select("image_id", "det_id")


@query("e10_tile_merge", f"WITH RECURSIVE base AS (SELECT 1), {DET.replace('det AS', 'raw AS', 1)}, det AS (SELECT image_id, det_id, cls, score, x1 + 50 * (det_id % 2) AS x1, y1 + 30 * (det_id % 2) AS y1, x2 + 50 * (det_id % 2) AS x2, y2 + 30 * (det_id % 2) AS y2 FROM raw), {_walk_nms(0.3)} SELECT image_id, det_id, x1, y1 FROM survivors")
def e10(spark, sf):
    tiles = spark.createDataFrame([(0, 0.0, 0.0), (1, 50.0, 30.0)], "tile_id long, dx double, dy double")
    d = det(spark, sf).withColumn("tile_id", F.col("det_id") % 2)
    return S.merge_tiles(d, tiles, "image_id", "cls", 0.3).select("image_id", "det_id", "x1", "y1")


@query("e11_tta_merge", f"WITH RECURSIVE base AS (SELECT 1), {DET.replace('det AS', 'raw AS', 1)}, det AS (SELECT image_id, det_id * 2 AS det_id, cls, score, x1, y1, x2, y2 FROM raw UNION ALL SELECT image_id, det_id * 2 + 1, cls, score / 2, x1 + 3, y1, x2 + 3, y2 FROM raw), {_walk_nms(0.3)} SELECT image_id, det_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS r FROM survivors) WHERE r <= 12")
def e11(spark, sf):
    plain = det(spark, sf)
    b = G.flip(G.translate(G.box(), 3, 0), "horizontal", 800.0, 600.0)
    turned = plain.select("image_id", "det_id", "cls", (F.col("score") / 2).alias("score"), *[c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), b, strict=True)])
    return S.merge_views([(plain, None), (turned, "horizontal")], 800.0, 600.0, "image_id", "cls", 0.3, 12).select("image_id", "det_id")


@query("e12_label_offsets", "SELECT p_size AS chunk, coalesce(CAST(sum(count(*)) OVER (ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS \"offset\" FROM part GROUP BY p_size")
def e12(spark, sf):
    return S.label_offsets(table(spark, sf, "part").groupBy(F.col("p_size").alias("chunk")).agg(F.count("*").alias("n_labels")))


@query("e13_pseudo_labels", f"WITH RECURSIVE {DET}, {_walk_nms(0.3, where='score > 0.5')} SELECT image_id, count(*) AS n, round(sum(floor(score * 100 + 0.5000001) / 100), 4) AS score FROM survivors GROUP BY image_id")
def e13(spark, sf):
    out = S.pseudo_labels(det(spark, sf), "image_id", "cls", 0.5, 0.3)
    return out.select("image_id", F.size("instances").cast("long").alias("n"), F.round(F.aggregate("instances", F.lit(0.0), lambda s, x: s + x["score"]), 4).alias("score"))
