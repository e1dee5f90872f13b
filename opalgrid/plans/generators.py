"""Generators, converters, trackers, assigners and sinks (inventory K, L, M, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opalgrid.functions import geometry as G, text as T
from opalgrid.operators import assign as A, convert as C, metrics as X, questions as Q, rank as R
from opalgrid.plans.carrier import BOTH, DET, PAIRS, det, gt, iou_sql, query, table
from opalgrid.plans.matching import KEYS, class_pairs
from opalgrid.plans.ranking import frames
from opalgrid.sources import documents as S
from opalgrid.streaming import tracks as K


def markers(spark, sf):
    return det(spark, sf).where("score >= 0.5").withColumnRenamed("det_id", "marker_id")


def samples(spark, sf):
    return gt(spark, sf).withColumnRenamed("gt_id", "sample_id").withColumn("description", F.concat(F.lit("the "), F.col("cls"), F.lit(" one")))


_BEST = f"""m AS (SELECT * FROM det WHERE score >= 0.5),
p AS (SELECT g.image_id, g.gt_id, g.cls, m.det_id, coalesce(m.cls = g.cls, false) AS same, {iou_sql('g.', 'm.')} AS iou FROM gt g LEFT JOIN m ON g.image_id = m.image_id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, gt_id ORDER BY same DESC, iou DESC, det_id) AS r FROM p) WHERE r = 1)"""


@query("k1_k2_referring_pairs", f"WITH {BOTH}, {_BEST} SELECT image_id, gt_id AS sample_id, 'In this image, which marker ID corresponds to: the ' || cls || ' one? Answer with <answer>ID</answer>.' AS question, coalesce(det_id, -1) AS marker_id, '<answer>' || coalesce(det_id, -1) || '</answer>' AS expected_answer, CASE WHEN det_id IS NULL THEN 'no_markers' WHEN same THEN 'class_filtered' ELSE 'no_class_match' END AS match_policy FROM b")
def k1(spark, sf):
    return Q.referring_pairs(samples(spark, sf), markers(spark, sf), skip_unmatched=False).select("image_id", "sample_id", "question", "marker_id", "expected_answer", "match_policy")


_SPATIAL = """c AS (SELECT image_id, cls, det_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) * (y2 - y1) AS a, count(*) OVER (PARTITION BY image_id, cls) AS n FROM det WHERE score >= 0.5),
k AS (SELECT *, row_number() OVER lr AS lr, row_number() OVER tb AS tb, cx - lag(cx) OVER lr AS gx, cy - lag(cy) OVER tb AS gy, row_number() OVER (PARTITION BY image_id, cls ORDER BY a DESC, det_id) AS big, row_number() OVER (PARTITION BY image_id, cls ORDER BY a, det_id) AS small, (max(a) OVER w - min(a) OVER w) / max(a) OVER w AS diff FROM c WINDOW w AS (PARTITION BY image_id, cls), lr AS (PARTITION BY image_id, cls ORDER BY cx, cy, det_id), tb AS (PARTITION BY image_id, cls ORDER BY cy, cx, det_id)),
f AS (SELECT *, min(gx) OVER (PARTITION BY image_id, cls) / 800 AS mx, min(gy) OVER (PARTITION BY image_id, cls) / 800 AS my FROM k),
q AS (SELECT image_id, cls, det_id, 'single' AS kind, 1 AS rank FROM f WHERE n = 1
  UNION ALL SELECT image_id, cls, det_id, 'left_to_right', lr FROM f WHERE n >= 2 AND mx >= {g} AND (n <= 3 OR lr = 1 OR lr = n)
  UNION ALL SELECT image_id, cls, det_id, 'top_to_bottom', tb FROM f WHERE n >= 2 AND my >= {g} AND (n <= 3 OR tb = 1 OR tb = n)
  UNION ALL SELECT image_id, cls, det_id, 'largest', 1 FROM f WHERE n >= 2 AND diff >= {d} AND big = 1
  UNION ALL SELECT image_id, cls, det_id, 'smallest', 1 FROM f WHERE n >= 2 AND diff >= {d} AND small = 1)
SELECT image_id, cls, det_id AS marker_id, kind, CAST(rank AS BIGINT) AS rank FROM q
UNION ALL SELECT image_id, cls, det_id, 'fallback', lr FROM f WHERE n < 13 AND NOT EXISTS (SELECT 1 FROM q WHERE q.image_id = f.image_id AND q.det_id = f.det_id)"""


@query("k3_spatial_questions", f"WITH {DET}, {_SPATIAL.format(g=0.02, d=0.2)}")
def k3(spark, sf):
    return Q.spatial_questions(markers(spark, sf), 0.02, 0.2).select("image_id", "cls", "marker_id", "kind", "rank")


@query("k4_spatial_questions_loose", f"WITH {DET}, {_SPATIAL.format(g=0.03, d=0.1)}")
def k4(spark, sf):
    return Q.spatial_questions(markers(spark, sf), 0.03, 0.1).select("image_id", "cls", "marker_id", "kind", "rank")


@query("k5_where_questions", f"WITH {DET} SELECT image_id, det_id AS marker_id, 'Where is the ' || cls || '?' AS question, x1, y2 FROM det WHERE score >= 0.5")
def k5(spark, sf):
    return Q.where_questions(markers(spark, sf)).select("image_id", "marker_id", "question", "answer.x1", "answer.y2")


def old_responses(spark, sf):
    o = table(spark, sf, "orders")
    bad = F.col("o_orderkey") % 7 == 3
    return o.select(F.col("o_orderkey").alias("row_idx"), F.col("o_custkey").alias("image_id"), F.when(bad, F.concat(F.lit("<answer>0</answer>\n[WARN] HTTP 500: "), F.col("o_orderpriority"))).otherwise(F.concat(F.lit("<answer>"), F.col("o_custkey").cast("string"), F.lit("</answer>"))).alias("response"))


@query("k6_retry_subset", "SELECT o_orderkey AS original_index, o_custkey AS image_id, 'HTTP 500: ' || o_orderpriority AS reason, row_number() OVER (ORDER BY o_orderkey) - 1 AS retry_index FROM orders WHERE o_orderkey % 7 = 3")
def k6(spark, sf):
    r = old_responses(spark, sf)
    return Q.indexed(Q.retry_subset(r.select("row_idx", "image_id"), r), "original_index")


@query("k7_manifest_merge", "SELECT count(*) FILTER (WHERE o_orderkey % 7 = 3 AND o_orderkey % 2 = 0) AS n_replaced, true AS complete, count(*) FILTER (WHERE o_orderkey % 7 = 3 AND o_orderkey % 2 = 0 AND o_orderkey % 5 = 0) AS n_still_warned, 0 AS n_placeholder, count(*) FILTER (WHERE o_orderkey % 7 <> 3 OR (o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0)) AS n_clean FROM orders")
def k7(spark, sf):
    old = old_responses(spark, sf)
    subset = Q.retry_subset(old.select("row_idx", "image_id"), old).where("original_index % 2 = 0")
    new = subset.select("original_index", F.when(F.col("original_index") % 5 == 0, "[WARN] again").otherwise("<answer>7</answer>").alias("response"))
    merged = Q.merged(old, new)
    clean = merged.agg(F.count_if(~F.col("still_warned")).alias("n_clean"))
    return Q.merge_guards(merged, subset.count()).crossJoin(clean)  # one row each


@query("k8_marker_documents", f"WITH {DET} SELECT image_id, count(*) AS n, CAST(sum(det_id) AS BIGINT) AS ids FROM det WHERE score >= 0.5 GROUP BY image_id")
def k8(spark, sf):
    docs = Q.marker_documents(markers(spark, sf))
    back = S.parse_markers(docs)
    return back.groupBy(F.col("image_name").cast("long").alias("image_id")).agg(F.count("*").alias("n"), F.sum("marker_id").alias("ids"))


@query("k9_xml_stub", "SELECT p_partkey AS image_id, '<annotation><filename>' || p_partkey || '.jpg</filename><size><width>' || p_size || '</width><height>600</height><depth>3</depth></size></annotation>' AS value FROM part")
def k9(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), F.concat(F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("file_name"), F.col("p_size").alias("width"), F.lit(600).alias("height"))
    return Q.xml_stub(p)


@query("k10_complete_records", "WITH b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS block_idx, CASE WHEN role = 'assistant' AND conv_id % 3 = 0 THEN '' ELSE 'x' END AS body FROM conversations), m AS (SELECT conv_id, min(block_idx) FILTER (WHERE body = '') AS cut FROM b GROUP BY 1) SELECT conv_id, block_idx FROM b JOIN m USING (conv_id) WHERE cut IS NULL OR block_idx < cut")
def k10(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("-" * 70 + "\nimg"), F.when((F.col("role") == "assistant") & (F.col("conv_id") % 3 == 0), "\n").otherwise("\nx\n")).alias("b"))
    files = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "b"))), lambda r: r["b"]), "").alias("value"))
    return S.complete_prefix(S.parse_blocks(files, ["conv_id"]), ["conv_id"]).select("conv_id", F.col("block_idx").cast("long").alias("block_idx"))


@query("k11_sample_index", f"WITH {BOTH} SELECT image_id, gt_id, row_number() OVER (ORDER BY image_id * 100 + gt_id) - 1 AS sample_index, CASE image_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM gt")
def k11(spark, sf):
    g = gt(spark, sf).select("image_id", "gt_id", (F.col("image_id") * 100 + F.col("gt_id")).alias("place"))
    split = F.when(F.col("image_id") % 10 == 0, "test").when(F.col("image_id") % 10 == 1, "val").otherwise("train")
    return Q.indexed(g, "place", "sample_index").select("image_id", "gt_id", "sample_index", split.alias("split"))


@query("k12_to_coco", f"WITH {BOTH} SELECT image_id, CASE cls WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS category_id, count(*) AS n, CAST(sum((x2 - x1) * (y2 - y1)) AS DOUBLE) AS area FROM gt GROUP BY 1, 2")
def k12(spark, sf):
    cats = spark.createDataFrame([(1, "A"), (2, "N"), (3, "R")], "id int, name string")
    _, ann, _ = C.to_coco(gt(spark, sf).withColumnRenamed("cls", "class"), gt(spark, sf).select("image_id").distinct(), cats)
    return ann.groupBy("image_id", "category_id").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


@query("k12_mot_to_coco", f"WITH {DET} SELECT image_id % 10 AS video, count(*) AS n, CAST(sum((x2 - x1) * (y2 - y1)) AS DOUBLE) AS area FROM det WHERE det_id % 2 = 0 AND score > 0 GROUP BY 1")
def k12b(spark, sf):
    rows = det(spark, sf).select((F.col("image_id") % 10).alias("video"), F.col("image_id").alias("frame_id"), F.col("det_id").alias("ins_id"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), F.col("score").alias("conf"), (F.col("det_id") % 2 + 1).alias("category_id"), F.lit(1.0).alias("visibility"))
    return C.mot_to_coco(rows).groupBy("video").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


@query("k13_to_odvg_detection", f"WITH {BOTH} SELECT image_id, count(*) AS n FROM gt WHERE least(greatest(x2, 0), 250) > least(greatest(x1, 0), 250) AND least(greatest(y2, 0), 250) > least(greatest(y1, 0), 250) AND x2 - x1 >= 1 AND y2 - y1 >= 1 GROUP BY image_id")
def k13(spark, sf):
    g = gt(spark, sf)
    images = g.select("image_id").distinct().select("image_id", F.col("image_id").cast("string").alias("file_name"), F.lit(250).alias("height"), F.lit(250).alias("width"))
    out = C.to_odvg_detection(images, g.withColumn("label", F.ascii("cls")).withColumnRenamed("cls", "class"))
    return out.select("image_id", F.size("instances").cast("long").alias("n"))


@query("k13_to_odvg_grounding", f"WITH {BOTH}, r AS (SELECT image_id, cls, min(gt_id) AS f, count(*) AS n FROM gt GROUP BY 1, 2) SELECT image_id, string_agg(cls || ':' || n, ' ' ORDER BY f) AS regions FROM r GROUP BY image_id")
def k13b(spark, sf):
    g = gt(spark, sf)
    out = C.to_odvg_grounding(g.select("image_id").distinct().withColumn("caption", F.lit("c")), g.withColumnRenamed("cls", "phrase").withColumnRenamed("gt_id", "pos"))
    return out.select("image_id", F.array_join(F.transform("regions", lambda r: F.concat(r["phrase"], F.lit(":"), F.size(r["bbox"]).cast("string"))), " ").alias("regions"))


@query("k14_k15_splits", f"WITH {BOTH} SELECT (SELECT count(*) FROM gt WHERE cls IN ('A', 'N') AND image_id % 3 <> 0) AS seen, (SELECT count(*) FROM gt WHERE cls = 'R' AND image_id % 3 <> 0) AS unseen, (SELECT count(*) FROM gt WHERE image_id % 3 = 1) AS one_source")
def k14(spark, sf):
    g = gt(spark, sf).withColumnRenamed("cls", "class")
    images = g.where("image_id % 3 <> 0").select("image_id", F.when(F.col("image_id") % 3 == 1, "coco/x").otherwise("flickr/x").alias("file_name")).distinct()
    seen, unseen = C.seen_unseen(g, images, ["A", "N"], ["R"])
    one = C.from_one_source(images, g, "coco/")
    count = lambda df, n: df.agg(F.count("*").alias(n))
    return count(seen, "seen").crossJoin(count(unseen, "unseen")).crossJoin(count(one, "one_source"))  # one row each


@query("k16_panoptic_to_semantic", "SELECT CASE WHEN p_size % 4 = 3 THEN 255 ELSE p_size % 4 * 10 END AS train_id, count(*) AS n FROM part GROUP BY 1")
def k16(spark, sf):
    mapping = spark.createDataFrame([(0, 0), (1, 10), (2, 20)], "category_id int, train_id int")
    return C.panoptic_to_semantic(table(spark, sf, "part").select((F.col("p_size") % 4).alias("category_id")), mapping).groupBy("train_id").agg(F.count("*").alias("n"))


@query("k19_fuse_models")
def k19(spark, sf):
    """Two models fused, then measured against ground truth."""
    from opalgrid.operators import match as M, suppress as P

    d = det(spark, sf)
    both = d.withColumn("model", F.lit(0)).unionByName(d.withColumns({"x1": F.col("x1") + 1, "x2": F.col("x2") + 1, "model": F.lit(1)}))
    fused = P.weighted_boxes_fusion(both, "image_id", "cls", [1.0, 1.0], 0.55).withColumn("det_id", F.xxhash64("x1", "y1", "x2", "y2", "score"))
    n = gt(spark, sf).groupBy("cls").agg(F.count("*").alias("n_gt"))
    curve = X.precision_recall(M.tpfp_voc(fused, gt(spark, sf), KEYS), n, ["cls"], ties=("image_id", "det_id"))
    return X.average_precision(curve, n, ["cls"]).select("cls", "n_gt", F.round("ap", 4).alias("ap"))


@query("k20_offline_evaluation", f"WITH {BOTH}, {PAIRS} SELECT cls, count(*) AS n, round(avg(iou), 6) AS mean_iou FROM (SELECT cls, image_id, gt_id, max(iou) AS iou FROM pairs GROUP BY 1, 2, 3) GROUP BY cls")
def k20(spark, sf):
    best = class_pairs(spark, sf).groupBy("cls", "image_id", "gt_id").agg(F.max("iou").alias("iou"))
    return best.groupBy("cls").agg(F.count("*").alias("n"), F.round(F.avg("iou"), 6).alias("mean_iou"))


def event_tracks(spark, sf):
    """Tracks: a user is a video, an event type a track, a day a frame; the last event of a day counts."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("video"), F.col("event_type").alias("track_id"), F.datediff(F.col("ts").cast("date"), F.lit("2020-01-01")).cast("long").alias("frame_id"), "event_id", "value")
    last = e.groupBy("video", "track_id", "frame_id").agg(F.max(F.struct("event_id", "value")).alias("l"))
    v = F.col("l.value")
    return last.select("video", "track_id", "frame_id", v.alias("x1"), (v * 2).alias("y1"), (v + 30).alias("x2"), (v * 2 + 50).alias("y2"), F.lit(0.5).alias("score"))


@query("g10_l9_interpolation", """WITH t AS (SELECT user_id AS video, event_type AS track_id, CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS BIGINT) AS f, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2, 3),
n AS (SELECT *, count(*) OVER (PARTITION BY video, track_id) AS n, lead(f) OVER w AS nf, lead(v) OVER w AS nv FROM t WINDOW w AS (PARTITION BY video, track_id ORDER BY f)),
r AS (SELECT *, unnest(CASE WHEN n > 5 AND n >= 3 AND nf - f > 1 AND nf - f < 20 THEN range(0, nf - f) ELSE [0] END) AS s FROM n)
SELECT video, track_id, f + s AS frame_id, round(CASE WHEN s = 0 THEN v ELSE v + (nv - v) * s / (nf - f) END, 5) AS x1, CASE WHEN s = 0 THEN 0.5 ELSE 1.0 END AS score FROM r""")
def g10(spark, sf):
    return K.interpolate(event_tracks(spark, sf)).select("video", "track_id", "frame_id", F.round("x1", 5).alias("x1"), "score")


@query("d27_link_tracklets", """WITH t AS (SELECT user_id AS video, event_type, CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS BIGINT) AS f, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2, 3),
s AS (SELECT video, event_type || '/' || (f // 10) AS track, min(f) AS f0, arg_min(v, f) AS v0, max(f) AS f1, arg_max(v, f) AS v1 FROM t GROUP BY 1, 2),
p AS (SELECT a.video, a.track AS a, b.track AS b, b.f0 - a.f1 AS gap, sqrt((b.v0 - a.v1) ** 2 + (2 * b.v0 - 2 * a.v1) ** 2) AS away FROM s a JOIN s b ON a.video = b.video AND a.track <> b.track AND b.f0 > a.f1 AND b.f0 - a.f1 <= 30),
r AS (SELECT *, row_number() OVER (PARTITION BY video, a ORDER BY gap, away, b) AS ra, row_number() OVER (PARTITION BY video, b ORDER BY gap, away, a) AS rb FROM p WHERE away <= 500)
SELECT video, a, b, gap FROM r WHERE ra = 1 AND rb = 1""")
def d27(spark, sf):
    t = event_tracks(spark, sf).withColumn("track_id", F.concat(F.col("track_id"), F.lit("/"), F.expr("frame_id div 10").cast("string")))
    # boxes are of one size: the corner moves as the centre does, and adds no rounding of its own to ties
    return K.link_tracklets(t, max_frames=30, max_distance=500.0, place=(F.col("x1"), F.col("y1")))


def video_dets(spark, sf):
    """Every ten images are a video whose frames show the boxes of the same places."""
    return det(spark, sf).select(F.expr("image_id div 10").alias("video"), (F.col("image_id") % 10).alias("frame_id"), "det_id", "x1", "y1", "x2", "y2", "score")


def _tracker(name: str, kind: str):
    @query(name)
    def run(spark, sf):
        out = K.track(video_dets(spark, sf), kind, high=0.5, start=0.5)
        return out.groupBy("video").agg(F.count("*").alias("n"), F.countDistinct("track_id").alias("tracks"))

    return run


l2, l3, l4 = _tracker("l2_byte_tracker", "byte"), _tracker("l3_sort_tracker", "sort"), _tracker("l4_oc_tracker", "oc")


@query("l12_similarity", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def l12(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    return e.join(n, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(X.cosine(F.col("embedding"), F.col("eb")), 5).alias("cosine"))


@query("l14_running_top_k", f"WITH {DET} SELECT cls, image_id, det_id FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, image_id, det_id) AS r FROM det) WHERE r <= 50")
def l14(spark, sf):
    """Top k per class over three batches that arrive one after the other."""
    order = [F.desc("score"), F.col("image_id"), F.col("det_id")]
    d = det(spark, sf).select("cls", "image_id", "det_id", "score")
    best = None
    for k in range(3):
        batch = d.where(F.col("image_id") % 3 == k)
        best = R.first_n(batch if best is None else best.unionByName(batch), ["cls"], order, 50)
    return best.select("cls", "image_id", "det_id")


@query("m1_max_iou_assign", f"""WITH {BOTH}, {PAIRS}, own AS (SELECT image_id, cls, det_id, max(iou) AS m, arg_min(gt_id, -iou * 1000000 + gt_id * 0.0000001) AS g FROM pairs GROUP BY 1, 2, 3),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls, det_id ORDER BY iou DESC, gt_id) AS r FROM pairs) WHERE r = 1),
f AS (SELECT image_id, cls, det_id, max(gt_id) AS f FROM (SELECT *, max(iou) OVER (PARTITION BY image_id, cls, gt_id) AS top FROM pairs) WHERE iou = top AND top > 0.2 GROUP BY 1, 2, 3)
SELECT o.image_id, o.det_id, coalesce(f.f, CASE WHEN iou >= 0.5 THEN gt_id WHEN iou < 0.4 THEN 0 ELSE -1 END) AS assigned FROM o LEFT JOIN f USING (image_id, cls, det_id)""")
def m1(spark, sf):
    return A.max_iou_assign(class_pairs(spark, sf), KEYS, least=0.2).select("image_id", "det_id", "assigned")


_ALL = f"p AS (SELECT d.image_id, d.cls, d.det_id, d.score, g.gt_id, {iou_sql('d.', 'g.')} AS iou, (d.x1 + d.x2) / 2 AS px, (d.y1 + d.y2) / 2 AS py, g.x1 AS gx1, g.y1 AS gy1, g.x2 AS gx2, g.y2 AS gy2 FROM det d JOIN gt g ON d.image_id = g.image_id AND d.cls = g.cls)"


@query("m2_atss_assign", f"""WITH {BOTH}, {_ALL},
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls, gt_id ORDER BY (px - (gx1 + gx2) / 2) ** 2 + (py - (gy1 + gy2) / 2) ** 2, det_id) AS r FROM p) WHERE r <= 5),
t AS (SELECT *, avg(iou) OVER w + coalesce(stddev_samp(iou) OVER w, 0) AS t FROM n WINDOW w AS (PARTITION BY image_id, cls, gt_id))
SELECT image_id, cls, det_id, gt_id AS assigned FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls, det_id ORDER BY iou DESC, gt_id) AS q FROM t WHERE iou >= t - 1e-12 AND px > gx1 AND px < gx2 AND py > gy1 AND py < gy2) WHERE q = 1""")
def m2(spark, sf):
    return A.atss_assign(det(spark, sf), gt(spark, sf), KEYS, k=5).select("image_id", "cls", "det_id", "assigned")


@query("m3_dynamic_k_assign", f"""WITH {BOTH}, {_ALL}, c AS (SELECT *, -ln(greatest(score, 1e-7)) - 3.0 * ln(greatest(iou, 1e-7)) AS cost FROM p WHERE iou > 0),
r AS (SELECT *, row_number() OVER (w ORDER BY iou DESC, det_id) AS ri, row_number() OVER (w ORDER BY cost, det_id) AS rc FROM c WINDOW w AS (PARTITION BY image_id, cls, gt_id)),
k AS (SELECT *, greatest(1, floor(sum(CASE WHEN ri <= 10 THEN iou ELSE 0 END) OVER (PARTITION BY image_id, cls, gt_id) + 1e-9)) AS k FROM r)
SELECT image_id, cls, det_id, gt_id AS assigned FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls, det_id ORDER BY cost, gt_id) AS q FROM k WHERE rc <= k) WHERE q = 1""")
def m3(spark, sf):
    return A.dynamic_k_assign(det(spark, sf), gt(spark, sf), KEYS).select("image_id", "cls", "det_id", "assigned")


@query("m4_aligned_assign", f"""WITH {BOTH}, c AS (SELECT d.image_id, d.cls, d.det_id, g.gt_id, {iou_sql('d.', 'g.')} AS iou, d.score * pow({iou_sql('d.', 'g.')}, 6) AS m FROM det d JOIN gt g ON d.image_id = g.image_id AND d.cls = g.cls WHERE (d.x1 + d.x2) / 2 > g.x1 AND (d.x1 + d.x2) / 2 < g.x2 AND (d.y1 + d.y2) / 2 > g.y1 AND (d.y1 + d.y2) / 2 < g.y2),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls, gt_id ORDER BY m DESC, det_id) AS r FROM c)
SELECT image_id, det_id, gt_id AS assigned FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls, det_id ORDER BY iou DESC, gt_id) AS q FROM r WHERE r <= 3 AND m > 0) WHERE q = 1""")
def m4(spark, sf):
    return A.aligned_assign(det(spark, sf), gt(spark, sf), KEYS, k=3).select("image_id", "det_id", "assigned")


_MAX_IOU = """o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls, det_id ORDER BY iou DESC, gt_id) AS r FROM pairs) WHERE r = 1),
f AS (SELECT image_id, cls, det_id, max(gt_id) AS f FROM (SELECT *, max(iou) OVER (PARTITION BY image_id, cls, gt_id) AS top FROM pairs) WHERE iou = top AND top > 0 GROUP BY 1, 2, 3),
a AS (SELECT o.image_id, o.cls, o.det_id, o.iou, coalesce(f.f, CASE WHEN iou >= 0.5 THEN gt_id WHEN iou < 0.4 THEN 0 ELSE -1 END) AS assigned FROM o LEFT JOIN f USING (image_id, cls, det_id))"""


@query("m8_balanced_sampler", f"WITH {BOTH}, {PAIRS}, {_MAX_IOU} SELECT image_id, least(p, 2) AS positives, least(p, 2) + least(n, 8 - least(p, 2)) AS n FROM (SELECT image_id, count(*) FILTER (WHERE assigned > 0) AS p, count(*) FILTER (WHERE assigned = 0) AS n FROM a GROUP BY 1) WHERE p + n > 0")
def m8(spark, sf):
    a = A.max_iou_assign(class_pairs(spark, sf), KEYS)
    return A.sample_balanced(a, ["image_id"], number=8).groupBy("image_id").agg(F.count_if(F.col("assigned") > 0).alias("positives"), F.count("*").alias("n"))


@query("n7_n8_sinks", f"WITH {DET} SELECT image_id, count(*) AS n FROM det GROUP BY image_id")
def n7(spark, sf):
    """Detections written as JSON lines and as Parquet in the shared folder and read back."""
    from opalgrid.sources.sinks import scratch_round_trip

    d = det(spark, sf).select("image_id", "det_id", "score")
    return scratch_round_trip(d).groupBy("image_id").agg(F.count("*").alias("n"))
