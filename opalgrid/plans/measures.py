"""Metric families (inventory F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from opalgrid.functions import geometry as G, text as T
from opalgrid.operators import metrics as X, match as M
from opalgrid.plans.boxes import pairs as box_pairs
from opalgrid.plans.carrier import BOTH, DET, PAIRS, area_sql, det, gt, inter_sql, iou_sql, query, table, union_sql
from opalgrid.plans.matching import KEYS, VOC, best_per_gt, class_pairs, pixels, ranked_pairs, voc

ANSWERED = """asked AS (SELECT g.image_id, g.gt_id, g.x1 AS g_x1, g.y1 AS g_y1, g.x2 AS g_x2, g.y2 AS g_y2, g.gt_id AS target_id,
  CASE WHEN (g.image_id + g.gt_id) % 11 = 0 THEN NULL WHEN g.gt_id % 8 = 2 THEN 0 WHEN g.gt_id % 5 = 1 THEN g.gt_id + 1 ELSE g.gt_id END AS pred_id, g.image_id % 17 = 0 AS broken FROM gt g),
r AS (SELECT a.*, d.x1 AS p_x1, d.y1 AS p_y1, d.x2 AS p_x2, d.y2 AS p_y2, CASE WHEN broken THEN 'no_gt' WHEN pred_id IS NULL THEN 'unread' WHEN pred_id = 0 THEN 'excluded' WHEN d.det_id IS NULL THEN 'no_marker' ELSE 'resolved' END AS c
  FROM asked a LEFT JOIN det d ON d.image_id = a.image_id AND d.det_id = a.pred_id)"""
_I, _U = inter_sql("g_", "p_"), union_sql("g_", "p_")
_SHARE = "(SELECT round(avg(CASE WHEN iou >= {t} THEN 1.0 ELSE 0 END), 6) FROM v WHERE c <> 'excluded')"


def answered(spark, sf) -> DataFrame:
    """Questions with synthetic answers: some unreadable, some excluded, some wrong, some without a valid box."""
    g = gt(spark, sf)
    i = F.col("gt_id")
    pred = F.when((F.col("image_id") + i) % 11 == 0, F.lit(None).cast("string")).when(i % 8 == 2, "<answer>0</answer>").when(i % 5 == 1, F.concat(F.lit("Answer: "), (i + 1).cast("string"))).otherwise(F.concat(F.lit("It is <answer>"), i.cast("string"), F.lit("</answer>")))
    broken = F.col("image_id") % 17 == 0
    rows = g.select("image_id", i.alias("target_id"), T.answer_strict(pred).alias("pred_id"), *[F.when(~broken, F.col(c)).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    return M.lookup_box(rows, det(spark, sf).withColumnRenamed("det_id", "marker_id"), order="marker_id")


@query("f1_grounding_metrics", f"""WITH {BOTH}, {ANSWERED},
v AS (SELECT *, CASE WHEN c = 'resolved' THEN {_I} / {_U} ELSE 0 END AS iou, CASE WHEN c = 'resolved' THEN {_I} ELSE 0 END AS i, CASE WHEN c = 'resolved' THEN {_U} WHEN c IN ('unread', 'no_marker') THEN {area_sql('g_')} ELSE 0 END AS u FROM r)
SELECT count(*) FILTER (WHERE c <> 'excluded') AS n_counted, count(*) FILTER (WHERE c IN ('resolved', 'no_marker')) AS n_answered, count(*) FILTER (WHERE c = 'excluded') AS n_excluded, count(*) FILTER (WHERE c IN ('no_gt', 'unread', 'no_marker')) AS n_invalid,
round(avg(CASE WHEN pred_id = target_id THEN 1.0 ELSE 0 END) FILTER (WHERE c IN ('resolved', 'no_marker')), 6) AS id_accuracy, round(avg(iou) FILTER (WHERE c <> 'excluded'), 6) AS mean_iou, round(sum(i) / sum(u), 6) AS cum_iou,
{', '.join(_SHARE.format(t=t / 10) + f' AS pr_{t * 10}' for t in (5, 6, 7, 8, 9))} FROM v""")
def f1(spark, sf):
    out = X.grounding_metrics(answered(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


@query("f2_counts", f"WITH {BOTH} SELECT cls, count(*) AS n, count(DISTINCT image_id) AS images, count(*) FILTER (WHERE x2 - x1 >= 55) AS kept FROM gt GROUP BY cls")
def f2(spark, sf):
    return gt(spark, sf).groupBy("cls").agg(F.count("*").alias("n"), F.countDistinct("image_id").alias("images"), F.count_if(F.col("x2") - F.col("x1") >= 55).alias("kept"))


@query("f3_i1_i2_split_coverage", "WITH s AS (SELECT DISTINCT o_orderkey AS i, o_orderkey % 7 AS split FROM orders WHERE o_orderkey % 10 <> 0 UNION SELECT o_orderkey + 1, 0 FROM orders WHERE o_orderkey % 50 = 0), p AS (SELECT i, count(DISTINCT split) AS k FROM s GROUP BY i), e AS (SELECT o_orderkey AS i FROM orders) SELECT (SELECT count(*) FROM p WHERE k > 1) AS n_overlap, (SELECT count(*) FROM e ANTI JOIN p USING (i)) AS n_missing, (SELECT count(*) FROM p ANTI JOIN e USING (i)) AS n_extra")
def f3(spark, sf):
    from opalgrid.operators.rank import coverage

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_index"))
    s = o.where("sample_index % 10 <> 0").withColumn("split", F.col("sample_index") % 7).union(o.where("sample_index % 50 = 0").select((F.col("sample_index") + 1), F.lit(0).cast("long")))
    return coverage(s, o)


_CURVE = """n AS (SELECT cls, count(*) FILTER (WHERE gt_id % 5 <> 0) AS n_gt FROM gt GROUP BY cls),
run AS (SELECT cls, row_number() OVER w AS k, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp FROM tpfp WINDOW w AS (PARTITION BY cls ORDER BY score DESC, image_id, det_id ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT cls, k, n_gt, ctp, cfp, coalesce(ctp / nullif(ctp + cfp, 0), 0) AS p, ctp / n_gt AS r FROM run JOIN n USING (cls))"""
_AREA = "env AS (SELECT cls, n_gt, max(p) OVER (PARTITION BY cls ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e, r - coalesce(lag(r) OVER (PARTITION BY cls ORDER BY k), 0) AS gain FROM curve)"


def n_gts(spark, sf, plain: bool = False) -> DataFrame:
    return gt(spark, sf).groupBy("cls").agg((F.count("*") if plain else F.count_if(F.col("gt_id") % 5 != 0)).alias("n_gt"))


def curve(spark, sf, t: float = 0.5) -> DataFrame:
    return X.precision_recall(voc(spark, sf, t), n_gts(spark, sf), ["cls"], ties=("image_id", "det_id"))


@query("f4_average_precision", f"WITH {BOTH}, {PAIRS}, {VOC.format(t=0.5)}, {_CURVE}, {_AREA} SELECT cls, n_gt, round(sum(e * gain), 6) AS ap FROM env GROUP BY cls, n_gt")
def f4(spark, sf):
    return X.average_precision(curve(spark, sf), n_gts(spark, sf), ["cls"]).withColumn("ap", F.round("ap", 6))


def _points(n: int) -> str:
    return f"steps AS (SELECT unnest(range({n})) / {n - 1}.0 AS s), peak AS (SELECT c.cls, s, coalesce(max(p) FILTER (WHERE r + 1e-12 >= s), 0) AS p FROM curve c, steps GROUP BY c.cls, s)"


@query("f4_average_precision_11_points", f"WITH {BOTH}, {PAIRS}, {VOC.format(t=0.5)}, {_CURVE}, {_points(11)} SELECT cls, n_gt, round(avg(p), 6) AS ap FROM peak JOIN n USING (cls) GROUP BY cls, n_gt")
def f4b(spark, sf):
    return X.average_precision(curve(spark, sf), n_gts(spark, sf), ["cls"], "11points").withColumn("ap", F.round("ap", 6))


@query("f5_mean_ap", f"WITH {BOTH}, {PAIRS}, {VOC.format(t=0.5)}, {_CURVE}, {_AREA} SELECT round(avg(ap), 6) AS map, count(*) AS n_classes FROM (SELECT cls, sum(e * gain) AS ap FROM env GROUP BY cls)")
def f5(spark, sf):
    return X.mean_ap(X.average_precision(curve(spark, sf), n_gts(spark, sf), ["cls"])).withColumn("map", F.round("map", 6))


def crowded(spark, sf) -> DataFrame:
    """Ground truth whose every ninth box is a crowd."""
    crowd = (F.col("gt_id") % 9 == 0).cast("int")
    return gt(spark, sf).withColumns({"ignore": crowd, "iscrowd": crowd})


#: Areas of small, medium and large boxes of the synthetic tables.
RANGES = {"all": (0.0, 1e10), "small": (0.0, 2600.0), "medium": (2600.0, 3400.0), "large": (3400.0, 1e10)}


@query("f6_coco_summary")
def f6(spark, sf):
    """The twelve COCO figures: thresholds .5 to .95, 101 recalls, area ranges, 1, 10 and 100 detections."""
    return X.coco_summary(X.coco_table(det(spark, sf), crowded(spark, sf), "image_id", "cls", RANGES)).select("name", F.round("value", 6).alias("value"))


@query("f7_classwise_table", f"WITH {BOTH}, {PAIRS}, {VOC.format(t=0.5)}, {_CURVE}, {_AREA} SELECT round(max(CASE WHEN cls = 'A' THEN ap END), 6) AS \"A\", round(max(CASE WHEN cls = 'N' THEN ap END), 6) AS \"N\", round(max(CASE WHEN cls = 'R' THEN ap END), 6) AS \"R\" FROM (SELECT cls, sum(e * gain) AS ap FROM env GROUP BY cls)")
def f7(spark, sf):
    ap = X.average_precision(curve(spark, sf), n_gts(spark, sf), ["cls"])
    return ap.groupBy(F.lit(1).alias("k")).pivot("cls", ["A", "N", "R"]).agg(F.round(F.first("ap"), 6)).drop("k")


@query("f8_recalls", f"""WITH RECURSIVE {BOTH}, {PAIRS}, top AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY image_id, cls ORDER BY score DESC, det_id) AS rk FROM pairs) WHERE rk <= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY iou DESC, gt_id, det_id) AS k FROM top),
walk(image_id, cls, k, gs, ds, took) AS (SELECT image_id, cls, CAST(1 AS BIGINT), [gt_id], [det_id], true FROM r WHERE k = 1
  UNION ALL SELECT w.image_id, w.cls, r.k, CASE WHEN free THEN list_append(gs, gt_id) ELSE gs END, CASE WHEN free THEN list_append(ds, det_id) ELSE ds END, free FROM walk w JOIN r ON w.image_id = r.image_id AND w.cls = r.cls AND r.k = w.k + 1, LATERAL (SELECT NOT list_contains(gs, gt_id) AND NOT list_contains(ds, det_id) AS free)),
b AS (SELECT g.image_id, g.gt_id, coalesce(m.iou, 0) AS iou FROM gt g LEFT JOIN (SELECT r.* FROM walk w JOIN r USING (image_id, cls, k) WHERE took) m USING (image_id, cls, gt_id))
SELECT threshold, round(avg(CASE WHEN iou >= threshold THEN 1.0 ELSE 0 END), 6) AS recall, count(*) AS n FROM b, (SELECT unnest([0.5, 0.7, 0.9]::DOUBLE[]) AS threshold) GROUP BY threshold""")
def f8(spark, sf):
    return X.recall_table(best_per_gt(spark, sf), (0.5, 0.7, 0.9)).withColumn("recall", F.round("recall", 6))


@query("f9_voc_legacy", f"WITH {BOTH}, pairs AS (SELECT d.image_id, d.cls, g.gt_id, d.det_id, d.score, {iou_sql('d.', 'g.', 1)} AS iou FROM det d JOIN gt g ON d.image_id = g.image_id AND d.cls = g.cls), {VOC.format(t=0.7)}, {_CURVE}, {_AREA} SELECT cls, round(sum(e * gain), 6) AS ap FROM env GROUP BY cls")
def f9(spark, sf):
    m = M.tpfp_voc(det(spark, sf), gt(spark, sf).withColumn("ignore", F.col("gt_id") % 5 == 0), KEYS, 0.7, plus=1)
    n = n_gts(spark, sf)
    return X.average_precision(X.precision_recall(m, n, ["cls"], ties=("image_id", "det_id")), n, ["cls"]).select("cls", F.round("ap", 6).alias("ap"))


@query("f10_f11_precision_at_k", f"WITH {BOTH}, p AS (SELECT g.cls, g.image_id, g.gt_id, {iou_sql('d.', 'g.')} AS iou, row_number() OVER (PARTITION BY g.image_id, g.gt_id ORDER BY d.score DESC, d.det_id) AS rank FROM gt g JOIN det d ON d.image_id = g.image_id AND d.cls = g.cls), h AS (SELECT cls, image_id, gt_id, " + ", ".join(f"coalesce(max(CASE WHEN rank <= {k} THEN iou END) >= 0.5, false) AS h{k}" for k in (1, 5, 10)) + " FROM p GROUP BY 1, 2, 3) SELECT cls, round(avg(h1::INT), 6) AS p1, round(avg(h5::INT), 6) AS p5, round(avg(h10::INT), 6) AS p10 FROM h GROUP BY cls")
def f10(spark, sf):
    p = ranked_pairs(spark, sf)
    best = lambda k: F.max(F.when(F.col("rank") <= k, F.col("iou"))) >= 0.5
    h = p.groupBy("cls", "image_id", "gt_id").agg(*[F.coalesce(best(k), F.lit(False)).cast("int").alias(f"p{k}") for k in (1, 5, 10)])
    return h.groupBy("cls").agg(*[F.round(F.avg(f"p{k}"), 6).alias(f"p{k}") for k in (1, 5, 10)])


@query("f12_multi_target", f"""WITH RECURSIVE {BOTH}, t AS (SELECT * FROM gt WHERE gt_id >= 8), p AS (SELECT * FROM det WHERE score >= 0.9),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, gt_id DESC, det_id DESC) AS k FROM (SELECT p.image_id, t.gt_id, p.det_id, {iou_sql('p.', 't.')} AS iou FROM p JOIN t ON p.image_id = t.image_id) WHERE iou >= 0.5),
walk(image_id, k, gs, ds, took) AS (
  SELECT image_id, CAST(1 AS BIGINT), [gt_id], [det_id], true FROM r WHERE k = 1
  UNION ALL SELECT w.image_id, r.k, CASE WHEN free THEN list_append(gs, gt_id) ELSE gs END, CASE WHEN free THEN list_append(ds, det_id) ELSE ds END, free
  FROM walk w JOIN r ON w.image_id = r.image_id AND r.k = w.k + 1, LATERAL (SELECT NOT list_contains(gs, gt_id) AND NOT list_contains(ds, det_id) AS free)),
i AS (SELECT image_id, coalesce(ng, 0) AS ng, coalesce(np, 0) AS np, coalesce(h, 0) AS h FROM (SELECT DISTINCT image_id FROM det) LEFT JOIN (SELECT image_id, count(*) AS ng FROM t GROUP BY 1) USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS np FROM p GROUP BY 1) USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS h FROM walk WHERE took GROUP BY 1) USING (image_id))
SELECT round(avg(CASE WHEN ng = 0 THEN np = 0 ELSE h = ng AND h = np END::INT), 6) AS f1_rate, round(count(*) FILTER (WHERE ng > 0 AND np > 0) / count(*) FILTER (WHERE ng > 0), 6) AS t_acc, round(count(*) FILTER (WHERE ng = 0 AND np = 0) / count(*) FILTER (WHERE ng = 0), 6) AS n_acc FROM i""")
def f12(spark, sf):
    """Expressions of many targets or none: an image is one expression, its confident boxes the answer."""
    p, t = det(spark, sf).where("score >= 0.9"), gt(spark, sf).where("gt_id >= 8")
    hits = M.one_to_one(M.pairs_of(t, p, ["image_id"]), ["image_id"], 0.5).groupBy("image_id").agg(F.count("*").alias("hits"))
    count = lambda df, n: df.groupBy("image_id").agg(F.count("*").alias(n))
    i = det(spark, sf).select("image_id").distinct().join(count(t, "n_gt"), "image_id", "left").join(count(p, "n_pred"), "image_id", "left").join(hits, "image_id", "left").fillna(0)
    out = X.multi_target_scores(i)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_LENGTH = "len(list_filter(regexp_split_to_array(trim(p_name || ' ' || p_type), '\\s+'), lambda x: x <> ''))"


@query("f13_length_buckets", f"SELECT CASE WHEN w <= 3 THEN '1-3' WHEN w <= 6 THEN '4-6' WHEN w <= 9 THEN '7-9' ELSE '10+' END AS bucket, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM (SELECT {_LENGTH} AS w, p_retailprice FROM part) GROUP BY 1")
def f13(spark, sf):
    p = table(spark, sf, "part")
    return p.groupBy(T.word_bucket(F.concat_ws(" ", "p_name", "p_type")).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean"))


@query("f14_base_and_novel", f"WITH {BOTH}, {PAIRS}, {VOC.format(t=0.5)}, {_CURVE}, {_AREA}, a AS (SELECT cls, sum(e * gain) AS ap FROM env GROUP BY cls) SELECT CASE WHEN cls = 'R' THEN 'novel' ELSE 'base' END AS split, round(avg(ap), 6) AS map, count(*) AS n_classes FROM a GROUP BY 1")
def f14(spark, sf):
    """Average precision of base classes and of a novel one."""
    ap = X.average_precision(curve(spark, sf), n_gts(spark, sf), ["cls"]).withColumn("split", F.when(F.col("cls") == "R", "novel").otherwise("base"))
    return X.mean_ap(ap, ["split"]).withColumn("map", F.round("map", 6))


@query("f15_frequency_ap", f"""WITH {BOTH}, {PAIRS}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, image_id, det_id) AS r FROM det) WHERE r <= 1000),
{VOC.format(t=0.5).replace("FROM det d LEFT JOIN", "FROM top d LEFT JOIN")}, {_CURVE}, {_AREA}, f AS (SELECT cls, CASE WHEN n <= 10 THEN 'r' WHEN n <= 100 THEN 'c' ELSE 'f' END AS frequency FROM (SELECT cls, count(DISTINCT image_id) // 40 AS n FROM gt GROUP BY 1))
SELECT frequency, round(avg(ap), 6) AS map, count(*) AS n_classes FROM (SELECT cls, sum(e * gain) AS ap FROM env GROUP BY cls) JOIN f USING (cls) GROUP BY 1""")
def f15(spark, sf):
    """Fixed AP: the best 1000 detections of a class over all images; classes by the number of their images."""
    from opalgrid.operators.rank import first_n

    best = first_n(det(spark, sf), ["cls"], [F.desc("score"), F.col("image_id"), F.col("det_id")], 1000).select("cls", "image_id", "det_id")
    kept = voc(spark, sf).join(best, ["cls", "image_id", "det_id"], "left_semi")
    n = n_gts(spark, sf)
    ap = X.average_precision(X.precision_recall(kept, n, ["cls"], ties=("image_id", "det_id")), n, ["cls"])
    images = gt(spark, sf).groupBy("cls").agg(F.expr("count(distinct image_id) div 40").alias("n_images"))
    return X.mean_ap(ap.join(X.frequency_groups(images), "cls"), ["frequency"]).withColumn("map", F.round("map", 6))


@query("f15_top_k_per_class", f"WITH {DET} SELECT cls, image_id, det_id FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, image_id, det_id) AS r FROM det) WHERE r <= 1000")
def f15(spark, sf):
    from opalgrid.operators.rank import first_n

    return first_n(det(spark, sf), ["cls"], [F.desc("score"), F.col("image_id"), F.col("det_id")], 1000).select("cls", "image_id", "det_id")


@query("f16_miss_rate", f"""WITH {BOTH}, {PAIRS}, {VOC.format(t=0.5)}, {_CURVE}, im AS (SELECT count(DISTINCT image_id) AS n FROM det),
pts AS (SELECT unnest([0.01, 0.0178, 0.03162, 0.0562, 0.1, 0.1778, 0.3162, 0.5623, 1.0]::DOUBLE[]) AS pt),
m AS (SELECT c.cls, pt, coalesce(arg_max(1 - r, k) FILTER (WHERE cfp / n <= pt), 1.0) AS miss FROM curve c, im, pts GROUP BY c.cls, pt)
SELECT cls, round(exp(avg(ln(greatest(miss, 1e-10)))), 6) AS mr FROM m GROUP BY cls""")
def f16(spark, sf):
    n = det(spark, sf).agg(F.countDistinct("image_id").alias("n_images"))
    c = curve(spark, sf).crossJoin(F.broadcast(n))  # one row
    out = X.log_average_miss_rate(c, ["cls"], (0.01, 0.0178, 0.03162, 0.0562, 0.1, 0.1778, 0.3162, 0.5623, 1.0), F.col("n_images"))
    return out.withColumn("mr", F.round("mr", 6))


@query("f16_crowd_ap", f"WITH {BOTH}, {PAIRS}, {VOC.format(t=0.5)}, {_CURVE}, s AS (SELECT cls, r - coalesce(lag(r) OVER w, 0) AS dr, p + coalesce(lag(p) OVER w, 1) AS pp FROM curve WINDOW w AS (PARTITION BY cls ORDER BY k)) SELECT cls, round(sum(dr * pp / 2), 6) AS ap FROM s GROUP BY cls")
def f16c(spark, sf):
    """Area under the plain curve by trapezoids."""
    return X.trapezoid_ap(curve(spark, sf), ["cls"]).withColumn("ap", F.round("ap", 6))


@query("f17_panoptic_quality", "WITH px AS (SELECT l_orderkey // 4 AS image_id, l_partkey % 6 AS gt_id, CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE l_partkey % 6 END AS pred_id, sum(CAST(floor(l_quantity) AS BIGINT)) AS n FROM lineitem GROUP BY 1, 2, 3), g AS (SELECT image_id, gt_id, sum(n) AS gn FROM px GROUP BY 1, 2), p AS (SELECT image_id, pred_id, sum(n) AS pn FROM px GROUP BY 1, 2), m AS (SELECT gt_id AS c, count(*) AS tp, sum(n / (gn + pn - n)) AS s FROM px JOIN g USING (image_id, gt_id) JOIN p USING (image_id, pred_id) WHERE gt_id <> 0 AND pred_id <> 0 AND n / (gn + pn - n) > 0.5 GROUP BY 1), ng AS (SELECT gt_id AS c, count(*) AS ng FROM g WHERE gt_id <> 0 GROUP BY 1), np AS (SELECT pred_id AS c, count(*) AS np FROM p WHERE pred_id <> 0 GROUP BY 1) SELECT c AS category_id, round(s / (tp + 0.5 * (ng - tp) + 0.5 * (np - tp)), 6) AS pq, round(s / tp, 6) AS sq, round(tp / (tp + 0.5 * (ng - tp) + 0.5 * (np - tp)), 6) AS rq FROM ng JOIN np USING (c) JOIN m USING (c)")
def f17(spark, sf):
    px = pixels(spark, sf)
    m = M.panoptic_match(px).select(F.col("gt_id").alias("category_id"), "iou")
    g = px.where("gt_id <> 0").select("image_id", F.col("gt_id").alias("category_id")).distinct()
    p = px.where("pred_id <> 0").select("image_id", F.col("pred_id").alias("category_id")).distinct()
    out = X.panoptic_quality(m, g, p)
    return out.select("category_id", *[F.round(c, 6).alias(c) for c in ("pq", "sq", "rq")])


@query("f18_segmentation", "WITH c AS (SELECT l_partkey % 6 AS t, l_suppkey % 6 AS p, count(*) AS n FROM lineitem WHERE l_partkey % 6 <> 5 GROUP BY 1, 2), k AS (SELECT unnest(range(6)) AS cls), s AS (SELECT cls, sum(n) FILTER (WHERE t = cls AND p = cls) AS i, sum(n) FILTER (WHERE t = cls) AS l, sum(n) FILTER (WHERE p = cls) AS q FROM c, k GROUP BY cls) SELECT cls, round(coalesce(i, 0) / (coalesce(l, 0) + q - coalesce(i, 0)), 6) AS iou, round(2 * coalesce(i, 0) / (coalesce(l, 0) + q), 6) AS dice, round(coalesce(coalesce(i, 0) / nullif(coalesce(l, 0), 0), 0), 6) AS acc FROM s")
def f18(spark, sf):
    l = table(spark, sf, "lineitem").select((F.col("l_partkey") % 6).alias("truth"), (F.col("l_suppkey") % 6).alias("pred"))
    out = X.segmentation_scores(X.confusion_table(l, "truth", "pred", ignore=5), "truth", "pred")
    return out.select("cls", *[F.round(c, 6).alias(c) for c in ("iou", "dice", "acc")])


@query("f19_referring_segmentation", f"WITH {BOTH}, {PAIRS}, x AS (SELECT {inter_sql('d.', 'g.')} AS i, {union_sql('d.', 'g.')} AS u FROM det d JOIN gt g ON d.image_id = g.image_id AND d.det_id = g.gt_id) SELECT round(sum(i) / sum(u), 6) AS ciou, round(avg(i / u), 6) AS miou FROM x")
def f19(spark, sf):
    p = box_pairs(spark, sf).where("det_id = gt_id").select(G.intersection(G.box(), G.box("g_")).alias("i"), G.union(G.box(), G.box("g_")).alias("u"))
    return p.agg(F.round(F.sum("i") / F.sum("u"), 6).alias("ciou"), F.round(F.avg(F.col("i") / F.col("u")), 6).alias("miou"))


@query("f20_retrieval", """WITH q AS (SELECT vec_id AS qid, label AS ql, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0),
p AS (SELECT qid, vec_id AS gid, ql = label AS same, list_sum(list_transform(list_zip(qe, embedding), lambda z: (z[1] - z[2])::DOUBLE * (z[1] - z[2])::DOUBLE)) AS d FROM embeddings, q WHERE vec_id <> qid),
r AS (SELECT qid, same, row_number() OVER w AS k, sum(same::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS h FROM p WINDOW w AS (PARTITION BY qid ORDER BY d, gid)),
s AS (SELECT qid, sum(CASE WHEN same THEN h / k ELSE 0 END) / sum(same::INT) AS ap, min(CASE WHEN same THEN k END) AS f FROM r GROUP BY qid HAVING sum(same::INT) > 0)
SELECT round(avg(ap), 5) AS map, round(avg((f <= 1)::INT), 5) AS cmc_1, round(avg((f <= 5)::INT), 5) AS cmc_5, round(avg((f <= 10)::INT), 5) AS cmc_10, count(*) AS n_queries FROM s""")
def f20(spark, sf):
    """The stated query set (identifiers divisible by 100) against all rows."""
    e = table(spark, sf, "embeddings")
    out = X.retrieval(e, e.where("vec_id % 100 = 0"))
    return out.select(*[F.round(c, 5).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


@query("f25_confusion_percent", f"WITH {BOTH}, p AS (SELECT g.cls AS gt_class, d.cls AS pred_class FROM det d JOIN gt g ON d.image_id = g.image_id WHERE {iou_sql('d.', 'g.')} >= 0.5) SELECT gt_class, pred_class, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY gt_class), 6) AS percent FROM p GROUP BY 1, 2")
def f25(spark, sf):
    cells = M.confusion_pairs(det(spark, sf), gt(spark, sf), "image_id", "cls", 0.5).where("gt_class <> 'background' and pred_class <> 'background'")
    return X.row_shares(cells).withColumn("percent", F.round("percent", 6))


_GROUPS = "CASE WHEN {c} IN ('A', 'N') THEN 1 ELSE 2 END"


@query("f26_error_shares", f"""WITH {BOTH}, b AS (SELECT d.image_id, d.det_id, max(CASE WHEN d.cls = g.cls THEN {iou_sql('d.', 'g.')} END) AS own, max(CASE WHEN {_GROUPS.format(c='d.cls')} = {_GROUPS.format(c='g.cls')} THEN {iou_sql('d.', 'g.')} END) AS sim, max({iou_sql('d.', 'g.')}) AS any_cls FROM det d LEFT JOIN gt g ON d.image_id = g.image_id GROUP BY 1, 2),
m AS (SELECT g.image_id, g.gt_id, max({iou_sql('d.', 'g.')}) AS o FROM gt g LEFT JOIN det d ON d.image_id = g.image_id AND d.cls = g.cls GROUP BY 1, 2)
SELECT CASE WHEN own >= 0.75 THEN 'c75' WHEN own >= 0.5 THEN 'c50' WHEN own >= 0.1 THEN 'loc' WHEN sim >= 0.1 THEN 'sim' WHEN any_cls >= 0.1 THEN 'oth' ELSE 'bg' END AS kind, count(*) AS n FROM b GROUP BY 1
UNION ALL SELECT 'fn', count(*) FROM m WHERE coalesce(o, 0) < 0.1""")
def f26(spark, sf):
    """Detections by the first scenario that would forgive them, and ground truths that nothing found."""
    groups = spark.createDataFrame([("A", 1), ("N", 1), ("R", 2)], "cls string, supercategory int")
    return X.error_shares(det(spark, sf), gt(spark, sf), groups)


@query("f27_area_groups", f"WITH {BOTH} SELECT CASE WHEN a < 2600 THEN 'small' WHEN a < 3400 THEN 'medium' ELSE 'large' END AS size, CAST(floor(sqrt(a) / 2) AS BIGINT) AS bin, count(*) AS n FROM (SELECT {area_sql('')} AS a FROM gt) GROUP BY 1, 2")
def f27(spark, sf):
    a = G.area(G.box())
    size = F.when(a < 2600, "small").when(a < 3400, "medium").otherwise("large")
    return gt(spark, sf).groupBy(size.alias("size"), F.floor(F.sqrt(a) / 2).alias("bin")).agg(F.count("*").alias("n"))


@query("f28_image_ranking", f"WITH {BOTH}, {PAIRS}, i AS (SELECT image_id, round(avg(coalesce(m, 0)), 9) AS s FROM gt LEFT JOIN (SELECT image_id, cls, gt_id, max(iou) AS m FROM pairs GROUP BY 1, 2, 3) USING (image_id, cls, gt_id) GROUP BY 1) SELECT image_id, round(s, 6) AS score, kind FROM (SELECT *, 'best' AS kind, row_number() OVER (ORDER BY s DESC, image_id) AS r FROM i UNION ALL SELECT *, 'worst', row_number() OVER (ORDER BY s, image_id) FROM i) WHERE r <= 20")
def f28(spark, sf):
    """The 20 best and the 20 worst images by mean best IoU (a top-k report)."""
    m = class_pairs(spark, sf).groupBy(*KEYS, "gt_id").agg(F.max("iou").alias("m"))
    i = gt(spark, sf).join(m, [*KEYS, "gt_id"], "left").groupBy("image_id").agg(F.round(F.avg(F.coalesce("m", F.lit(0.0))), 9).alias("s"))
    best, worst = i.orderBy(F.desc("s"), "image_id").limit(20), i.orderBy("s", "image_id").limit(20)
    return best.withColumn("kind", F.lit("best")).unionByName(worst.withColumn("kind", F.lit("worst"))).select("image_id", F.round("s", 6).alias("score"), "kind")


@query("f29_robustness", "WITH t AS (SELECT l_returnflag AS metric, l_linenumber % 6 AS severity, avg(l_discount) AS value FROM lineitem GROUP BY l_returnflag, l_linenumber % 6, l_suppkey % 15) SELECT metric, round(avg(value) FILTER (WHERE severity = 0), 6) AS p, round(avg(value) FILTER (WHERE severity > 0), 6) AS mpc, round(avg(value) FILTER (WHERE severity > 0) / avg(value) FILTER (WHERE severity = 0), 6) AS rpc FROM t GROUP BY metric")
def f29(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("metric"), (F.col("l_linenumber") % 6).alias("severity"), (F.col("l_suppkey") % 15).alias("distortion")).agg(F.avg("l_discount").alias("value"))
    out = X.robustness(t)
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("p", "mpc", "rpc")])


@query("f30_epoch_times", "WITH e AS (SELECT event_id // 500 AS epoch, avg(value) AS t FROM events GROUP BY 1) SELECT arg_max(epoch, t) AS slowest, arg_min(epoch, t) AS fastest, round(avg(t), 6) AS mean_time, round(stddev_pop(t), 6) AS std_over_epochs FROM e")
def f30(spark, sf):
    log = table(spark, sf, "events").select(F.expr("event_id div 500").alias("epoch"), F.col("value").alias("time"))
    return X.epoch_times(log).select("slowest", "fastest", F.round("mean_time", 6).alias("mean_time"), F.round("std_over_epochs", 6).alias("std_over_epochs"))


def _kmeans(start: list[tuple[float, float]], rounds: int) -> str:
    """SQL: rounds of k-means over (w, h) of ground truth, by IoU at a common corner."""
    parts = ["b AS (SELECT x2 - x1 AS w, y2 - y1 AS h FROM gt)", "k0 AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, CAST({w} AS DOUBLE), CAST({h} AS DOUBLE))" for i, (w, h) in enumerate(start)) + ") AS t(i, cw, ch))"]
    for r in range(rounds):
        near = f"SELECT b.w, b.h, arg_max(i, least(b.w, cw) * least(b.h, ch) / (b.w * b.h + cw * ch - least(b.w, cw) * least(b.h, ch)) - i * 1e-12) AS i FROM (SELECT *, row_number() OVER () AS r FROM b) b, k{r} GROUP BY r, b.w, b.h"
        parts.append(f"n{r} AS (SELECT i, avg(w) AS w, avg(h) AS h FROM ({near}) GROUP BY i), k{r + 1} AS (SELECT k{r}.i, coalesce(w, cw) AS cw, coalesce(h, ch) AS ch FROM k{r} LEFT JOIN n{r} USING (i))")
    return ", ".join(parts)


@query("f31_anchor_kmeans", f"WITH {BOTH}, {_kmeans([(45.0, 45.0), (60.0, 60.0), (75.0, 60.0)], 4)} SELECT i AS anchor, round(cw, 4) AS w, round(ch, 4) AS h FROM k4")
def f31(spark, sf):
    b = gt(spark, sf).select(G.width(G.box()).alias("w"), G.height(G.box()).alias("h"))
    got = X.anchor_kmeans(b, [(45.0, 45.0), (60.0, 60.0), (75.0, 60.0)], rounds=4)
    return spark.createDataFrame([(i, round(w, 4), round(h, 4)) for i, (w, h) in enumerate(got)], "anchor int, w double, h double")


@query("f32_usage", "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS tokens, count(*) FILTER (WHERE length(text) > 300) AS long FROM conversations GROUP BY role")
def f32(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("tokens"), F.count_if(F.length("text") > 300).alias("long"))


@query("f33_regions", f"WITH {BOTH} SELECT image_id, cls AS phrase, count(*) AS n, min(gt_id) AS first, string_agg(CAST(gt_id AS VARCHAR), ',' ORDER BY gt_id) AS ids FROM gt GROUP BY 1, 2")
def f33(spark, sf):
    g = gt(spark, sf).groupBy("image_id", F.col("cls").alias("phrase")).agg(F.array_sort(F.collect_list("gt_id")).alias("l"), F.min("gt_id").alias("first"))
    return g.select("image_id", "phrase", F.size("l").cast("long").alias("n"), "first", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("ids"))


@query("f34_slices", f"WITH {BOTH}, {PAIRS}, m AS (SELECT image_id % 3 AS s, gt_id, image_id, max(iou) AS m FROM pairs GROUP BY 1, 2, 3) SELECT 'set' || s || '/mean_iou' AS name, round(avg(m), 6) AS value FROM m GROUP BY s")
def f34(spark, sf):
    """Slices of one evaluation under prefixed names."""
    m = class_pairs(spark, sf).groupBy("image_id", "gt_id").agg(F.max("iou").alias("m"))
    return m.groupBy(F.concat(F.lit("set"), (F.col("image_id") % 3).cast("string"), F.lit("/mean_iou")).alias("name")).agg(F.round(F.avg("m"), 6).alias("value"))


@query("f35_class_names", "SELECT DISTINCT lower(p_brand) AS name FROM part")
def f35(spark, sf):
    return table(spark, sf, "part").select(T.name_key(F.col("p_brand")).alias("name")).distinct()
