"""Registries, scoring, images, memories and further coders, assigners and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opalgrid.functions import geometry as G, masks as K
from opalgrid.operators import assign as A, match as M, metrics as X, registry as R
from opalgrid.plans.boxes import by_image, by_image_sql, pairs as box_pairs
from opalgrid.plans.carrier import BOTH, DET, PAIRS, det, gt, inter_sql, iou_sql, query, table, union_sql
from opalgrid.plans.generators import _MAX_IOU, video_dets
from opalgrid.plans.matching import KEYS, _partial, class_pairs
from opalgrid.sources import documents as S, images as I, scoring, sinks
from opalgrid.streaming import memory, mot, tracks


@query("a1_a2_jsonl_files", "SELECT p_partkey AS row_idx, p_name AS name FROM part WHERE p_size % 2 = 0")
def a1f(spark, sf):
    """JSON lines written to files, blank lines between, and scanned with a schema, failing fast."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 2 == 0, F.to_json(F.struct(F.col("p_partkey").alias("row"), F.col("p_name").alias("name")))).otherwise("  ").alias("value"))
    path = sinks.shared_path(p, "lines")
    p.select("value").write.text(path)
    return S.read_jsonl(spark, path, "row long, name string", fail_fast=True).select(F.col("row").alias("row_idx"), "name")


@query("a17_video_index", f"WITH {DET}, t AS (SELECT image_id // 10 AS video, det_id, count(*) AS n, avg((x2 - x1) * (y2 - y1)) AS a FROM det GROUP BY 1, 2) SELECT video AS video_id, det_id AS id, n, round(a, 6) AS mean_area FROM t WHERE det_id % 3 <> 0 AND det_id % 5 <> 0 AND a BETWEEN 2500 AND 3500")
def a17(spark, sf):
    """Documents of one video each: tracks with a box or null for each frame, indexed and chosen from."""
    d = det(spark, sf).withColumns({"video": F.expr("image_id div 10"), "frame": (F.col("image_id") % 10).cast("int")})
    frames = d.groupBy("video", "det_id").agg(F.map_from_entries(F.collect_list(F.struct("frame", F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))))).alias("m"))
    boxes = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.try_element_at("m", i))
    track = F.struct(F.col("det_id").alias("id"), F.col("video").alias("video_id"), (F.col("det_id") % 3).cast("int").alias("category_id"), (F.col("det_id") % 5 == 0).cast("int").alias("iscrowd"), boxes.alias("bboxes"), F.transform(boxes, lambda b: b[2] * b[3]).alias("areas"))
    docs = frames.groupBy("video").agg(F.to_json(F.struct(F.array(F.struct(F.first("video").alias("id"), F.lit(10).alias("length"))).alias("videos"), F.collect_list(track).alias("annotations")), {"ignoreNullFields": "false"}).alias("value"))
    _, rows, _ = I.video_index(docs)
    return I.chosen_tracks(rows, categories=[1, 2], area=(2500.0, 3500.0), crowd=0).groupBy("video_id", "id").agg(F.count("*").alias("n"), F.round(F.first("mean_area"), 6).alias("mean_area"))


@query("a18_panoptic_png", "SELECT s_suppkey AS image_id, CAST((s_suppkey * 7 + r * c) % 5 * 300 AS BIGINT) AS segment_id, count(*) AS n FROM supplier, (SELECT unnest(range(8)) AS r), (SELECT unnest(range(12)) AS c) GROUP BY 1, 2")
def a18(spark, sf):
    """Segment ids written as PNG files' bytes and counted back from them."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(11))))
    pixels = s.withColumn("segment_id", ((F.col("image_id") * 7 + F.col("r") * F.col("c")) % 5 * 300).cast("long"))
    return I.panoptic_segments(I.panoptic_png(pixels, "image_id"), "image_id")


@query("k17_image_meta", "SELECT s_suppkey AS image_id, CAST(s_suppkey % 50 + 1 AS INT) AS width, CAST(s_suppkey % 7 + 1 AS INT) AS height FROM supplier")
def k17(spark, sf):
    """Sizes from headers, half of the files PNG and half JPEG."""
    w, h = F.col("s_suppkey") % 50 + 1, F.col("s_suppkey") % 7 + 1
    hexed = lambda v, n: F.lpad(F.hex(v), n, "0")
    png = F.concat(F.lit(I.PNG.hex() + "0000000d49484452"), hexed(w, 8), hexed(h, 8), F.lit("0802000000"))
    jpeg = F.concat(F.lit("ffd8ffe000040000ffc0001108"), hexed(h, 4), hexed(w, 4), F.lit("03"))
    files = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image_id"), F.unhex(F.when(F.col("s_suppkey") % 2 == 0, png).otherwise(jpeg)).alias("content"))
    return I.image_sizes(files, "image_id")


_WIDE = {"w": "(3 * (d.x2 - d.x1) / 14)", "left": "(d.x1 - (d.x2 - d.x1))", "right": "(d.x2 + (d.x2 - d.x1))"}
_LEFT = f"greatest(0, least(6, floor((g.x1 - {_WIDE['left']}) / {_WIDE['w']})))"
_RIGHT = f"greatest(0, least(6, floor(({_WIDE['right']} - g.x2) / {_WIDE['w']})))"


@query("b21_buckets", by_image_sql(l=_LEFT, r=_RIGHT, x1="g.x1", y1="g.y1", x2="g.x2", y2="g.y2"))
def b21b(spark, sf):
    """Sides as bucket and offset, and back."""
    code = G.bucket_encode(G.box(), G.box("g_"))
    b = G.bucket_decode(G.box(), code)
    return by_image(box_pairs(spark, sf), l=code["left"][0], r=code["right"][0], x1=b.x1, y1=b.y1, x2=b.x2, y2=b.y2)


@query("b24_masks", f"WITH {DET} SELECT image_id, det_id, CAST((x2 - x1) * (y2 - y1) AS BIGINT) AS area, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2 FROM det")
def b24m(spark, sf):
    """Boxes as run-length masks, their area and the boxes around them."""
    runs = det(spark, sf).select("image_id", "det_id", K.runs_of_box(G.box(), 400).alias("runs"))
    b = K.mask_box(F.col("runs"), 400)
    return runs.select("image_id", "det_id", K.mask_area(F.col("runs")).alias("area"), F.struct(*[v.alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), b, strict=True)]).alias("b")).select("image_id", "det_id", "area", "b.*")


@query("b25_polygons", f"WITH {DET} SELECT image_id, det_id, round((x2 - x1) * (y2 - y1) / 2 * 6, 6) AS area, 800 - (x1 + 5) * 2 AS x, (y1 - 3) * 3 AS y FROM det")
def b25(spark, sf):
    """Triangles translated, rescaled, sheared and turned over: areas scale, shear and flip keep them."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    t = K.flip(K.rescale(K.translate(F.array(point("x1", "y1"), point("x2", "y1"), point("x2", "y2")), 5.0, -3.0), 2.0, 3.0), width=800.0)
    return det(spark, sf).select("image_id", "det_id", F.round(G.polygon_area(K.shear(t, 0.5)), 6).alias("area"), t[0]["x"].alias("x"), t[0]["y"].alias("y"))


@query("f21_hota")
def f21h(spark, sf):
    d = video_dets(spark, sf)
    got = tracks.track(d, "byte", high=0.5, start=0.5)
    g = d.where("det_id % 3 = 1").withColumn("track_id", F.col("det_id"))
    out = mot.hota(g, got)
    return out.select("video", *[F.round(c, 4).alias(c) for c in ("hota", "det_a", "ass_a")])


def video_tracks(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Every ten images are a video; equal numbers in its images are one track of one class."""
    name = lambda df, i: df.select(F.expr("image_id div 10").alias("video"), (F.col("image_id") % 10).alias("frame_id"), i, (F.col(i) % 2).alias("cls"), "x1", "y1", "x2", "y2", *(["score"] if "score" in df.columns else []))
    return name(gt(spark, sf), "gt_id"), name(det(spark, sf), "det_id")


@query("f22_video_ap", f"""WITH RECURSIVE {BOTH}, d AS (SELECT image_id // 10 AS video, image_id % 10 AS f, det_id, det_id % 2 AS cls, score, x1, y1, x2, y2 FROM det), g AS (SELECT image_id // 10 AS video, image_id % 10 AS f, gt_id, gt_id % 2 AS cls, x1, y1, x2, y2 FROM gt),
da AS (SELECT video, cls, det_id, round(avg(score), 9) AS score, sum((x2 - x1) * (y2 - y1)) AS a FROM d GROUP BY 1, 2, 3), ga AS (SELECT video, cls, gt_id, sum((x2 - x1) * (y2 - y1)) AS a FROM g GROUP BY 1, 2, 3),
i AS (SELECT d.video, d.cls, det_id, gt_id, sum({inter_sql('d.', 'g.')}) AS i FROM d JOIN g ON d.video = g.video AND d.cls = g.cls AND d.f = g.f GROUP BY 1, 2, 3, 4),
p AS (SELECT i.video, i.cls, det_id, gt_id, i.i / (da.a + ga.a - i.i) AS iou FROM i JOIN da USING (video, cls, det_id) JOIN ga USING (video, cls, gt_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY video, cls ORDER BY score DESC, det_id) AS k FROM da),
l AS (SELECT o.video, o.cls, o.k, list(gt_id ORDER BY iou DESC, gt_id) AS want FROM p JOIN o USING (video, cls, det_id) WHERE iou >= 0.3 GROUP BY 1, 2, 3),
walk(video, cls, k, used, got) AS (
  SELECT video, cls, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM (SELECT DISTINCT video, cls FROM o)
  UNION ALL SELECT w.video, w.cls, o.k, CASE WHEN f IS NULL THEN used ELSE list_append(used, f) END, f
  FROM walk w JOIN o ON w.video = o.video AND w.cls = o.cls AND o.k = w.k + 1 LEFT JOIN l ON l.video = o.video AND l.cls = o.cls AND l.k = o.k, LATERAL (SELECT list_filter(want, lambda x: NOT list_contains(used, x))[1] AS f)),
t AS (SELECT o.cls, o.video, o.det_id, o.score, CAST(got IS NOT NULL AS INT) AS tp FROM walk w JOIN o USING (video, cls, k)),
n AS (SELECT cls, count(*) AS n_gt FROM ga GROUP BY 1),
r AS (SELECT cls, sum(tp) OVER w AS ctp, row_number() OVER w AS k FROM t WINDOW w AS (PARTITION BY cls ORDER BY score DESC, video, det_id ROWS UNBOUNDED PRECEDING)),
steps AS (SELECT unnest(range(101)) / 100.0 AS s), peak AS (SELECT cls, s, coalesce(max(ctp / k) FILTER (WHERE ctp / n_gt + 1e-12 >= s), 0) AS p FROM r JOIN n USING (cls), steps GROUP BY 1, 2)
SELECT cls, n_gt, round(avg(p), 6) AS ap FROM peak JOIN n USING (cls) GROUP BY 1, 2""")
def f22v(spark, sf):
    return X.video_ap(*video_tracks(spark, sf), threshold=0.3).withColumn("ap", F.round("ap", 6))


def with_features(spark, sf) -> DataFrame:
    """Detections of videos with a class number and an embedding of place and size."""
    d = video_dets(spark, sf).withColumn("label", (F.col("det_id") % 3).cast("int"))
    return d.withColumn("feature", F.array(F.col("x1") / 60, F.col("y1") / 60, (F.col("x2") - F.col("x1")) / 20, (F.col("y2") - F.col("y1")) / 20))


def _summary(out: DataFrame) -> DataFrame:
    return out.groupBy("video").agg(F.count("*").alias("n"), F.countDistinct("track_id").alias("tracks"))


@query("l5_strong_tracker")
def l5(spark, sf):
    """Cosine distance of embeddings weighted with motion."""
    d = with_features(spark, sf)
    size = F.sqrt(F.aggregate("feature", F.lit(1e-12), lambda s, x: s + x * x))
    return _summary(tracks.track(d.withColumn("feature", F.transform("feature", lambda x: x / size)).drop("label"), "strong", high=0.5, start=0.5))


@query("l6_quasi_dense_tracker")
def l6(spark, sf):
    return _summary(memory.track_by_memory(with_features(spark, sf), "quasi_dense"))


@query("l7_mask_track_tracker")
def l7(spark, sf):
    return _summary(memory.track_by_memory(with_features(spark, sf), "mask_track"))


def fails_at_first():
    """A scorer that needs as many tries as the request says, and never answers some."""
    seen: dict[int, int] = {}

    def call(row: dict) -> str:
        k = row["row_idx"]
        seen[k] = seen.get(k, 0) + 1
        if k % 11 == 0:
            raise ValueError("HTTP 400")
        if seen[k] <= k % 3 or k % 13 == 0:
            raise scoring.Retry("HTTP 429")
        return f"<answer>{k}</answer>"

    return call


def no_wait(seconds: float) -> None:
    pass


@query("l13_n5_resumable_scoring", "SELECT CAST(CASE WHEN o_orderkey % 11 = 0 THEN 1 WHEN o_orderkey % 13 = 0 THEN 4 ELSE o_orderkey % 3 + 1 END AS INT) AS tries, o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 AS warned, count(*) AS n FROM orders GROUP BY 1, 2")
def l13(spark, sf):
    """A run that stopped after a third of the requests, started again: each is asked for once."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_idx"))
    path = sinks.shared_path(o, "answers")
    scoring.score_missing(o.where("row_idx % 3 = 0"), path, fails_at_first, sleep=no_wait)
    out = scoring.score_missing(o, path, fails_at_first, sleep=no_wait)
    return out.groupBy("tries", F.contains("response", F.lit("[WARN]")).alias("warned")).agg(F.count("*").alias("n"))


@query("m5_top_k_hungarian", f"WITH RECURSIVE {BOTH}, {PAIRS}, {_partial('iou > 0', '1 - iou')}, best AS (SELECT image_id, cls, n, min(w) AS w FROM ways GROUP BY 1, 2, 3 QUALIFY n = max(n) OVER (PARTITION BY image_id, cls)) SELECT image_id, CAST(sum(n) AS BIGINT) AS n, round(sum(w), 6) AS cost FROM best GROUP BY 1")
def m5(spark, sf):
    """The first of two rounds; its assignment is the one-to-one optimum."""
    p = class_pairs(spark, sf).where("iou > 0").withColumn("cost", 1 - F.col("iou"))
    out = A.top_k_hungarian(p, KEYS, "det_id", "gt_id", "cost", k=2).where("round = 1")
    return out.groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


@query("m7_uniform_assign", f"""WITH {BOTH}, p AS (SELECT d.image_id, d.cls, d.det_id, g.gt_id, {iou_sql('d.', 'g.')} AS iou, abs((d.x1 + d.x2) / 2 - (g.x1 + g.x2) / 2) + abs((d.x2 - d.x1) - (g.x2 - g.x1)) + abs((d.y1 + d.y2) / 2 - (g.y1 + g.y2) / 2) + abs((d.y2 - d.y1) - (g.y2 - g.y1)) AS away FROM det d JOIN gt g ON d.image_id = g.image_id AND d.cls = g.cls),
n AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls, gt_id ORDER BY away, det_id) AS r FROM p)
SELECT image_id, cls, det_id, CASE WHEN arg_max(iou, gt_id) < 0.15 THEN -1 ELSE max(gt_id) END AS assigned FROM n WHERE r <= 2 GROUP BY 1, 2, 3""")
def m7u(spark, sf):
    return A.uniform_assign(det(spark, sf), gt(spark, sf), KEYS, k=2).select("image_id", "cls", "det_id", "assigned")


@query("m8_iou_balanced_sampler", f"WITH {BOTH}, b AS (SELECT d.image_id, d.det_id, max({iou_sql('d.', 'g.')}) AS iou FROM det d JOIN gt g ON d.image_id = g.image_id GROUP BY 1, 2 HAVING max({iou_sql('d.', 'g.')}) < 0.4) SELECT image_id, least(count(*), 6) AS n, count(*) FILTER (WHERE iou >= 0.8 / 3) >= 1 AS has_hard FROM b GROUP BY 1")
def m8i(spark, sf):
    """Negatives by the bin of their best overlap: a group that has hard ones keeps some."""
    best = M.pairs_of(gt(spark, sf), det(spark, sf), ["image_id"]).groupBy("image_id", "det_id").agg(F.max("iou").alias("iou")).where("iou < 0.4")
    out = A.sample_iou_balanced(best, ["image_id"])
    return out.groupBy("image_id").agg(F.count("*").alias("n"), F.bool_or(F.col("bin") == 2).alias("has_hard"))


@query("m8_per_instance_sampler", f"WITH {BOTH}, {PAIRS}, {_MAX_IOU} SELECT image_id, least(count(*), 6) AS n, least(count(DISTINCT assigned), 6) AS instances FROM a WHERE assigned > 0 GROUP BY 1")
def m8p(spark, sf):
    a = A.max_iou_assign(class_pairs(spark, sf), KEYS)
    return A.sample_per_instance(a, ["image_id"]).groupBy("image_id").agg(F.count("*").alias("n"), F.countDistinct("assigned").alias("instances"))


@query("m7_approx_max_iou_assign", f"WITH {BOTH}, {PAIRS.replace('pairs AS', 'single AS', 1)}, pairs AS (SELECT image_id, cls, det_id // 2 AS det_id, gt_id, max(iou) AS iou FROM single GROUP BY 1, 2, 3, 4), {_MAX_IOU} SELECT image_id, cls, det_id AS prior, assigned FROM a")
def m7a(spark, sf):
    """Two detections stand for one prior."""
    pairs = class_pairs(spark, sf).withColumn("prior", F.expr("det_id div 2"))
    return A.approx_max_iou_assign(pairs, KEYS, "prior").select("image_id", "cls", "prior", F.col("assigned").cast("long").alias("assigned"))


@query("m7_centre_region_assign", f"""WITH {BOTH}, p AS (SELECT d.image_id, d.cls, d.det_id, g.gt_id, (g.x2 - g.x1) * (g.y2 - g.y1) AS a, greatest(abs((d.x1 + d.x2) - (g.x1 + g.x2)) / (g.x2 - g.x1), abs((d.y1 + d.y2) - (g.y1 + g.y2)) / (g.y2 - g.y1)) AS off FROM det d JOIN gt g ON d.image_id = g.image_id AND d.cls = g.cls),
n AS (SELECT image_id, cls, det_id, coalesce(arg_min(gt_id, (a, gt_id)) FILTER (WHERE off < 0.2), -1) AS assigned FROM p WHERE off < 0.5 GROUP BY 1, 2, 3)
SELECT d.image_id, d.cls, d.det_id, coalesce(n.assigned, 0) AS assigned FROM det d LEFT JOIN n USING (image_id, cls, det_id)""")
def m7c(spark, sf):
    return A.centre_region_assign(det(spark, sf), gt(spark, sf), KEYS).select("image_id", "cls", "det_id", "assigned")


@query("m8_hard_sampler", f"""WITH {BOTH}, {PAIRS}, {_MAX_IOU}, l AS (SELECT a.image_id, a.det_id, assigned > 0 AS pos, CASE WHEN assigned > 0 THEN 1 - score ELSE score END AS loss FROM a JOIN det USING (image_id, cls, det_id) WHERE assigned >= 0),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, pos ORDER BY loss DESC, det_id) AS r, least(count(*) FILTER (WHERE pos) OVER (PARTITION BY image_id), 2) AS p FROM l)
SELECT image_id, det_id, pos FROM r WHERE r <= CASE WHEN pos THEN 2 ELSE 8 - p END""")
def m8h(spark, sf):
    """Eight rows of an image whose scores are most at odds with what they were assigned."""
    a = A.max_iou_assign(class_pairs(spark, sf), KEYS).join(det(spark, sf).select(*KEYS, "det_id", "score"), [*KEYS, "det_id"])
    a = a.withColumn("loss", F.when(F.col("assigned") > 0, 1 - F.col("score")).otherwise(F.col("score")))
    return A.sample_hard(a, ["image_id"], number=8).select("image_id", "det_id", (F.col("assigned") > 0).alias("pos"))


@query("f31_anchor_evolution")
def f31e(spark, sf):
    """Three anchors by differential evolution, with the mean best IoU of all boxes."""
    sizes = gt(spark, sf).select(G.width(G.box()).alias("w"), G.height(G.box()).alias("h"))
    anchors, worth = X.anchor_evolution(sizes, 3, 8.0, 128.0, generations=10)
    return spark.createDataFrame([(i, w, h, worth) for i, (w, h) in enumerate(anchors)], "anchor int, w double, h double, mean_iou double")


@query("l9_smoothed_tracks")
def l9s(spark, sf):
    """Filled tracks, smoothed: a detection's number is its track."""
    rows = det(spark, sf).select(F.expr("image_id div 10").alias("video"), F.col("det_id").alias("track_id"), (F.col("image_id") % 10).alias("frame_id"), "x1", "y1", "x2", "y2", "score")
    return tracks.smooth_tracks(tracks.interpolate(rows))


@query("n1_n2_metrics", f"""WITH {BOTH}, v AS (SELECT d.image_id % 2 AS half, d.cls, {inter_sql('d.', 'g.')} AS i, {union_sql('d.', 'g.')} AS u, {iou_sql('d.', 'g.')} AS iou FROM det d JOIN gt g ON d.image_id = g.image_id AND d.cls = g.cls AND d.det_id = g.gt_id),
s AS (SELECT cls, avg(iou) AS a, avg((iou >= 0.8)::INT) AS h, sum(i) / sum(u) AS c FROM v GROUP BY 1)
SELECT cls, 'set/' || unnest(['mean_iou', 'pr_80', 'cum_iou']) AS name, round(unnest([a, h, c]), 6) AS value FROM s""")
def n1(spark, sf):
    """Metrics by name over two batches, whose sums add up."""
    i, u = G.intersection(G.box(), G.box("g_")), G.union(G.box(), G.box("g_"))
    rows = box_pairs(spark, sf).where("det_id = gt_id").select("image_id", "cls", i.alias("i"), u.alias("u"), G.iou(G.box(), G.box("g_")).alias("iou"))
    batches = [rows.where(F.col("image_id") % 2 == k) for k in (0, 1)]
    out = R.evaluate([{"type": "overlap", "thresholds": (0.8,)}, "cumulative_overlap"], batches, ["cls"], "set/")
    return out.withColumn("value", F.round("value", 6))


def any_overlap(dets: DataFrame, gts: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """A rule of one's own: every detection that overlaps some ground truth enough is a hit."""
    hit = M.overlap_filter(dets, M.pairs_of(gts, dets, keys), keys, threshold).select(*keys, "det_id").withColumn("tp", F.lit(1))
    return dets.select(*keys, "det_id", "score").join(hit, [*keys, "det_id"], "left").withColumn("tp", F.coalesce("tp", F.lit(0))).withColumn("fp", 1 - F.col("tp"))


@query("n3_own_rule", f"WITH {BOTH}, {PAIRS}, h AS (SELECT DISTINCT image_id, cls, det_id FROM pairs WHERE iou >= 0.5) SELECT det.cls, count(h.det_id) AS tp, count(*) - count(h.det_id) AS fp FROM det LEFT JOIN h USING (image_id, cls, det_id) GROUP BY 1")
def n3(spark, sf):
    """TP and FP by a rule that is registered by name."""
    if "any_overlap" not in R.RULES.names():
        R.RULES.register("any_overlap")(any_overlap)
    out = R.RULES.get("any_overlap")(det(spark, sf), gt(spark, sf), KEYS, 0.5)
    return out.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
