"""Sources, box expressions and filters (inventory A, B, C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opalgrid.functions import geometry as G, text as T
from opalgrid.operators import rank as R
from opalgrid.plans.carrier import BOTH, DET, area_sql, det, gt, inter_sql, iou_sql, query, table, union_sql
from opalgrid.sources import documents as S

_ROUND = lambda c, n: F.round(c, 6).alias(n)


def by_image_sql(**values: str) -> str:
    """SQL of ``by_image`` over all pairs of an image and class."""
    sums = ", ".join(f"round(sum(({v}) * (d.det_id * 7 + g.gt_id)), 4) AS {n}" for n, v in values.items())
    return f"WITH {BOTH} SELECT d.image_id, count(*) AS n, {sums} FROM det d JOIN gt g ON d.image_id = g.image_id AND d.cls = g.cls GROUP BY d.image_id"


def by_image(rows: DataFrame, **values: Column) -> DataFrame:
    """Per image the number of pairs and each value summed with weights that tell the pairs apart."""
    w = F.col("det_id") * 7 + F.col("gt_id")
    return rows.groupBy("image_id").agg(F.count("*").alias("n"), *[F.round(F.sum(v * w), 4).alias(n) for n, v in values.items()])


def pairs(spark, sf) -> DataFrame:
    g = gt(spark, sf).select("image_id", "gt_id", "cls", *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    return det(spark, sf).join(g, ["image_id", "cls"])


@query("a1_jsonl_scan", f"WITH {DET} SELECT image_id, count(*) AS n, round(sum(x1 + y1 + x2 + y2), 6) AS s FROM det GROUP BY image_id")
def a1(spark, sf):
    """Detections written as JSON lines and scanned back with a schema."""
    lines = det(spark, sf).select(F.to_json(F.struct("image_id", "det_id", "x1", "y1", "x2", "y2")).alias("value"))
    rows = S.parse_jsonl(lines, "image_id long, det_id long, x1 double, y1 double, x2 double, y2 double")
    return rows.groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x1") + F.col("y1") + F.col("x2") + F.col("y2")), 6).alias("s"))


@query("a3_single_json_documents", f"WITH {DET} SELECT image_id, det_id, cls AS class_name, score, x1, x2 FROM det")
def a3(spark, sf):
    """One JSON document per image with parallel arrays."""
    d = det(spark, sf)
    docs = d.groupBy("image_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("det_id", "x1", "y1", "x2", "y2"))), lambda r: F.array(r["x1"], r["y1"], r["x2"], r["y2"])).alias("bboxes"), F.transform(F.array_sort(F.collect_list(F.struct("det_id", "score"))), lambda r: r["score"]).alias("scores"), F.transform(F.array_sort(F.collect_list(F.struct("det_id", "cls"))), lambda r: r["cls"]).alias("class_names"))).alias("value"))
    return S.parse_detections(docs).select("image_id", F.col("pos").alias("det_id"), "class_name", "score", "x1", "x2")


@query("a4_separator_blocks", "SELECT conv_id, turn AS block_idx, role AS image_file, trim(replace(replace(text, chr(10), ' '), chr(13), ' ')) AS body FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM conversations)")
def a4(spark, sf):
    """Turns as blocks between dashed lines, parsed back."""
    flat = F.trim(F.translate("text", "\n\r", "  "))
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("-" * 70 + "\n"), F.col("role"), F.lit("\n"), flat, F.lit("\n")).alias("block"))
    files = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda r: r["block"]), "").alias("value"))
    return S.parse_blocks(files, ["conv_id"]).select("conv_id", F.col("block_idx").cast("long").alias("block_idx"), "image_file", "body")


def xml_documents(spark, sf) -> DataFrame:
    """One annotation document per image, an object for each ground truth."""
    obj = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in ("<object><name>", F.col("cls"), "</name><pose>", F.col("gt_id").cast("string"), "</pose><bndbox><xmin>", F.col("x1").cast("string"), "</xmin><ymin>", F.col("y1").cast("string"), "</ymin><xmax>", F.col("x2").cast("string"), "</xmax><ymax>", F.col("y2").cast("string"), "</ymax></bndbox></object>")])
    objects = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gt_id", obj.alias("o")))), lambda r: r["o"]), "")
    return gt(spark, sf).groupBy("image_id").agg(F.concat(F.lit("<annotation><filename>"), F.first("image_id").cast("string"), F.lit(".jpg</filename>"), objects, F.lit("</annotation>")).alias("value"))


@query("a5_xml_annotations", f"WITH {BOTH} SELECT image_id || '.jpg' AS filename, gt_id AS object_index, cls AS name, x1 AS xmin, y1 AS ymin, x2 AS xmax, y2 AS ymax FROM gt")
def a5(spark, sf):
    return S.parse_annotations_xml(xml_documents(spark, sf)).select("filename", F.col("pose").cast("long").alias("object_index"), "name", "xmin", "ymin", "xmax", "ymax")


@query("a7_xml_names", f"WITH {BOTH} SELECT image_id || '.jpg' AS filename, string_agg(cls, ',' ORDER BY cls) AS names FROM (SELECT DISTINCT image_id, cls FROM gt) GROUP BY image_id")
def a7(spark, sf):
    """File name and names of the objects, read from the documents alone."""
    rows = S.parse_annotations_xml(xml_documents(spark, sf))
    return rows.groupBy("filename").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("name"))), ",").alias("names"))


@query("a8_marker_json", f"WITH {DET} SELECT image_id, det_id AS marker_id, cls AS class, x1, y1, x2, y2 FROM det")
def a8(spark, sf):
    item = F.struct(F.col("det_id").alias("marker_id"), F.array("x1", "y1", "x2", "y2").alias("bbox"), F.col("cls").alias("class"), F.lit(0).alias("label"), "score")
    docs = det(spark, sf).groupBy("image_id").agg(F.to_json(F.struct(F.first("image_id").cast("string").alias("image_name"), F.collect_list(item).alias("markers"))).alias("value"))
    return S.parse_markers(docs).select(F.col("image_name").cast("long").alias("image_id"), "marker_id", "class", "x1", "y1", "x2", "y2")


@query("a9_polymorphic_predictions", f"WITH {DET} SELECT image_id, det_id AS pos, score, x1, y2 FROM det WHERE score >= 0.25")
def a9(spark, sf):
    """Three layouts of one content: parallel arrays, an object with predictions, a bare array."""
    d = det(spark, sf).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("det_id", F.array("x1", "y1", "x2", "y2").alias("bbox"), "score"))).alias("p"))
    preds = F.transform("p", lambda r: F.struct(r["bbox"].alias("bbox"), r["score"].alias("score"), F.lit(1).alias("label")))
    arrays = F.to_json(F.struct(F.transform("p", lambda r: r["bbox"]).alias("bboxes"), F.transform("p", lambda r: r["score"]).alias("scores"), F.transform("p", lambda r: F.lit(1)).alias("labels")))
    value = F.when(F.col("image_id") % 3 == 0, arrays).when(F.col("image_id") % 3 == 1, F.to_json(F.struct(preds.alias("predictions")))).otherwise(F.to_json(preds))
    return S.parse_predictions(d.select("image_id", value.alias("value")), 0.25).select("image_id", F.col("pos").cast("long").alias("pos"), "score", "x1", "y2")


@query("a10_split_list", "SELECT o_orderkey % 10 AS split, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '.jpg' AS image_file FROM orders WHERE o_orderkey % 10 < 3")
def a10(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_orderkey") % 10).alias("split"), F.col("o_orderkey").alias("sample_index"))
    chosen = S.parse_ints(o.where("split < 3").select("split", F.concat(F.lit(" "), F.col("sample_index").cast("string"), F.lit("\n")).alias("value")), "sample_index")
    return o.join(chosen.select("sample_index").distinct(), "sample_index", "left_semi").select("split", F.concat(F.lpad(F.col("sample_index").cast("string"), 9, "0"), F.lit(".jpg")).alias("image_file"))


@query("a11_coco_lookup", f"WITH {BOTH} SELECT image_id || '.jpg' AS file_name, gt_id, cls AS class, x1, y1, x2, y2 FROM gt WHERE gt_id % 4 <> 1")
def a11(spark, sf):
    g = gt(spark, sf)
    ann = g.select((F.col("gt_id")).alias("id"), "image_id", F.col("cls").alias("category"), F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"), (F.col("gt_id") % 4 == 1).cast("int").alias("iscrowd"))
    images = g.select("image_id").distinct().select(F.col("image_id").alias("id"), F.concat(F.col("image_id").cast("string"), F.lit(".jpg")).alias("file_name"))
    cats = spark.createDataFrame([(1, "A"), (2, "N"), (3, "R")], "id int, name string")
    ann = ann.join(cats.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category").drop("category")
    return S.coco_boxes(images, ann, cats).select("file_name", F.col("id").alias("gt_id"), "class", "x1", "y1", "x2", "y2")


@query("a13_csv_annotations", f"WITH {BOTH} SELECT image_id, gt_id, cls, x1, y2 FROM gt")
def a13(spark, sf):
    lines = gt(spark, sf).select(F.concat_ws(",", "image_id", "gt_id", "cls", "x1", "y1", "x2", "y2").alias("value"))
    return S.parse_csv(lines, "image_id long, gt_id long, cls string, x1 double, y1 double, x2 double, y2 double").select("image_id", "gt_id", "cls", "x1", "y2")


@query("a14_odgt", f"WITH {BOTH} SELECT image_id, gt_id AS pos, x1, y1, x2 - x1 AS w, y2 - y1 AS h, CASE WHEN gt_id % 4 = 1 THEN 1 ELSE 0 END AS ignore FROM gt")
def a14(spark, sf):
    item = F.struct("gt_id", F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("fbox"), F.struct((F.col("gt_id") % 4 == 1).cast("int").alias("ignore")).alias("extra"))
    lines = gt(spark, sf).groupBy("image_id").agg(F.to_json(F.struct(F.first("image_id").cast("string").alias("ID"), F.array_sort(F.collect_list(item)).alias("gtboxes"))).alias("value"))
    return S.parse_odgt(lines).select(F.col("ID").cast("long").alias("image_id"), F.col("gt_id").alias("pos"), F.col("x").alias("x1"), F.col("y").alias("y1"), "w", "h", "ignore")


@query("a15_mot_text", f"WITH {DET} SELECT image_id AS frame_id, det_id AS ins_id, x1 AS x, y2 - y1 AS h, score AS conf FROM det")
def a15(spark, sf):
    lines = det(spark, sf).select(F.concat_ws(",", "image_id", "det_id", "x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), "score").alias("value"))
    return S.parse_mot(lines).select("frame_id", "ins_id", "x", "h", "conf")


@query("a16_training_log", "SELECT event_id AS iter, epoch, round(value, 6) AS loss FROM (SELECT event_id, value, CAST(event_id // 500 AS BIGINT) AS epoch FROM events)")
def a16(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    first = F.col("event_id") % 500 == 0
    line = F.to_json(F.struct(F.col("event_id").cast("double").alias("iter"), F.when(first, F.expr("event_id div 500").cast("double")).alias("epoch"), F.col("value").alias("loss")))
    log = S.parse_log(e.select("event_id", F.expr("event_id div 500").alias("part"), line.alias("value")), "event_id", ["part"])
    return log.select(F.col("iter").cast("long").alias("iter"), F.col("epoch").cast("double").alias("epoch"), F.round("loss", 6).alias("loss")).withColumn("epoch", F.col("epoch").cast("long"))


@query("a19_resume_scan", f"WITH {BOTH} SELECT DISTINCT image_id FROM det WHERE image_id NOT IN (SELECT image_id FROM gt WHERE gt_id >= 7)")
def a19(spark, sf):
    return S.not_done(det(spark, sf).select("image_id").distinct(), gt(spark, sf).where("gt_id >= 7"), "image_id")


@query("b1_intersection_union", by_image_sql(i=inter_sql("d.", "g."), u=union_sql("d.", "g.")))
def b1(spark, sf):
    return by_image(pairs(spark, sf), i=G.intersection(G.box(), G.box("g_")), u=G.union(G.box(), G.box("g_")))


@query("b2_iou", by_image_sql(iou=iou_sql("d.", "g.")))
def b2(spark, sf):
    return by_image(pairs(spark, sf), iou=G.iou(G.box(), G.box("g_")))


@query("b3_iou_legacy_and_iof", by_image_sql(iou=f"{inter_sql('d.', 'g.', 1)} / greatest({union_sql('d.', 'g.', 1)}, 1e-6)", iof=f"{inter_sql('d.', 'g.')} / greatest({area_sql('d.')}, 1e-6)"))
def b3(spark, sf):
    return by_image(pairs(spark, sf), iou=G.iou_floor(G.box(), G.box("g_"), 1), iof=G.iof(G.box(), G.box("g_")))


_ENC = "((greatest(d.x2, g.x2) - least(d.x1, g.x1)) * (greatest(d.y2, g.y2) - least(d.y1, g.y1)))"


@query("b4_giou", by_image_sql(giou=f"{iou_sql('d.', 'g.')} - ({_ENC} - {union_sql('d.', 'g.')}) / {_ENC}"))
def b4(spark, sf):
    return by_image(pairs(spark, sf), giou=G.giou(G.box(), G.box("g_")))


@query("b5_area_centre", f"WITH {DET} SELECT image_id, det_id, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h FROM det")
def b5(spark, sf):
    b = G.box()
    return det(spark, sf).select("image_id", "det_id", G.area(b).alias("area"), G.centre(b)[0].alias("cx"), G.centre(b)[1].alias("cy"), G.width(b).alias("w"), G.height(b).alias("h"))


@query("b6_b7_conversions", f"WITH {DET} SELECT image_id, det_id, x1, y1, x2, y2, round((x2 - x1) / (y2 - y1), 6) AS a FROM det")
def b6(spark, sf):
    """xyxy to xywh, cxcywh and cxcyah and back."""
    b = G.from_xywh(*G.to_xywh(G.box()))
    b = G.from_cxcywh(*G.to_cxcywh(b))
    a = G.to_cxcyah(b)
    c = G.from_cxcyah(*a)
    return det(spark, sf).select("image_id", "det_id", *[F.round(v, 6).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), c, strict=True)], _ROUND(a[2], "a"))


@query("b8_corners_project", f"WITH {DET} SELECT image_id, det_id, x1 * 2 + 5 AS x1, y1 * 3 - 1 AS y1, x2 * 2 + 5 AS x2, y2 * 3 - 1 AS y2 FROM det")
def b8(spark, sf):
    b = G.project(G.box(), [[2, 0, 5], [0, 3, -1], [0, 0, 1]])
    return det(spark, sf).select("image_id", "det_id", *[v.alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), b, strict=True)])


@query("b9_flip", f"WITH {DET} SELECT image_id, det_id, 800 - x2 AS hx1, 800 - x1 AS hx2, 800 - y2 AS vy1, 800 - y1 AS vy2, 800 - x2 AS dx1, 800 - y1 AS dy2 FROM det")
def b9(spark, sf):
    h, v, d = (G.flip(G.box(), k, 800.0, 800.0) for k in ("horizontal", "vertical", "diagonal"))
    return det(spark, sf).select("image_id", "det_id", h.x1.alias("hx1"), h.x2.alias("hx2"), v.y1.alias("vy1"), v.y2.alias("vy2"), d.x1.alias("dx1"), d.y2.alias("dy2"))


@query("b10_translate_clip", f"WITH {DET} SELECT image_id, det_id, greatest(0, least(x1 - 20, 200)) AS x1, greatest(0, least(y1 + 7, 200)) AS y1, greatest(0, least(x2 - 20, 200)) AS x2, greatest(0, least(y2 + 7, 200)) AS y2 FROM det")
def b10(spark, sf):
    b = G.clip(G.translate(G.box(), -20, 7), 200.0, 200.0)
    return det(spark, sf).select("image_id", "det_id", *[v.alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), b, strict=True)])


@query("b11_rotate_rescale", f"WITH {DET} SELECT image_id, det_id, round(100 - (y2 - 100), 6) AS x1, round(x1, 6) AS y1, round((x1 + x2) / 2 - (x2 - x1), 6) AS rx1, x2 * 0.5 AS sx2 FROM det")
def b11(spark, sf):
    r, s, c = G.rotate(G.box(), 100.0, 100.0, 90.0), G.rescale(G.box(), 0.5, 2.0), G.resize_about_centre(G.box(), 2.0, 1.0)
    return det(spark, sf).select("image_id", "det_id", F.round(r.x1, 6).alias("x1"), F.round(r.y1, 6).alias("y1"), F.round(c.x1, 6).alias("rx1"), s.x2.alias("sx2"))


@query("b12_distances", f"WITH {DET} SELECT image_id, det_id, x1, y1, x2, y2, least(greatest(10.0 - x1, 0), 49.9) AS capped FROM det")
def b12(spark, sf):
    px, py = G.centre(G.box())
    b = G.from_distances(px, py, *G.to_distances(px, py, G.box()))
    capped = G.to_distances(F.lit(10.0), py, G.box(), 50.0)[0]
    return det(spark, sf).select("image_id", "det_id", *[v.alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), b, strict=True)], capped.alias("capped"))


@query("b13_inside", f"WITH {DET} SELECT image_id, count(*) FILTER (WHERE x2 < 250 AND y2 < 260) AS inside, count(*) FILTER (WHERE x1 < 100 AND x2 > 100 AND y1 < 90 AND y2 > 90) AS holding FROM det GROUP BY image_id")
def b13(spark, sf):
    b = G.box()
    return det(spark, sf).groupBy("image_id").agg(F.count_if(G.within_image(b, 250, 260)).alias("inside"), F.count_if(G.holds_point(b, F.lit(100.0), F.lit(90.0))).alias("holding"))


@query("b14_visible", f"WITH {BOTH} SELECT image_id, gt_id FROM gt WHERE least(greatest(x2, 0), 300) > least(greatest(x1, 0), 300) AND least(greatest(y2, 0), 300) > least(greatest(y1, 0), 300) AND x2 - x1 >= 1 AND y2 - y1 >= 1")
def b14(spark, sf):
    return gt(spark, sf).where(G.visible(G.box(), 300.0, 300.0)).select("image_id", "gt_id")


@query("b15_normalised", f"WITH {DET} SELECT image_id, det_id, round(greatest(0, least(x1 / 250 * 640, 640)), 3) AS x1, round(greatest(0, least(y2 / 250 * 480, 480)), 3) AS y2 FROM det")
def b15(spark, sf):
    b = G.from_normalised(G.rescale(G.box(), 1 / 250, 1 / 250), 640, 480)
    return det(spark, sf).select("image_id", "det_id", b.x1.alias("x1"), b.y2.alias("y2"))


_LABELS = dict(enumerate(T.CHINESE))  # class numbers in the vocabulary's order


def _names_sql(label: str, rest: str, both: bool) -> str:
    return f"CASE {label} " + " ".join(f"WHEN {i} THEN '{n}{f'（{T.CHINESE[n]}）' if both else ''}'" for i, n in _LABELS.items()) + f" ELSE {rest} END"


@query("b16_b19_labels", f"SELECT p_partkey, {_names_sql('p_size % 23', "'class_' || (p_size % 23)", False)} AS class, {_names_sql('p_size % 23', "'class_' || (p_size % 23)", True)} AS both, (p_size * 37) % 180 AS hue FROM part")
def b16(spark, sf):
    label = (F.col("p_size") % 23).cast("int")
    names = F.create_map(*[F.lit(x) for kv in _LABELS.items() for x in kv])
    p = table(spark, sf, "part").select("p_partkey", T.class_of(label, names).alias("class"), T.hue(F.col("p_size")).alias("hue"))
    return p.select("p_partkey", "class", T.bilingual(F.col("class")).alias("both"), "hue")


@query("b17_alias", "SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'alpha' ELSE lower(p_brand) END AS class FROM part")
def b17(spark, sf):
    alias = spark.createDataFrame([("Brand#1", "alpha")], "p_brand string, alias string")
    p = table(spark, sf, "part")
    return p.join(F.broadcast(alias), "p_brand", "left").select("p_partkey", F.coalesce("alias", F.lower("p_brand")).alias("class"))


@query("b19_palette", "SELECT p_partkey, CAST(('0x' || substr(md5(p_name), 1, 8))::BIGINT % 32 AS INT) AS colour FROM part")
def b19(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.palette_index(F.col("p_name")).alias("colour"))


_DELTAS = {"dx": "((g.x1 + g.x2) - (d.x1 + d.x2)) / 2 / (d.x2 - d.x1)", "dh": "ln((g.y2 - g.y1) / (d.y2 - d.y1))", "bx1": "g.x1", "by2": "g.y2", "tx1": "g.x1", "ty1": "g.y1", "top": "((d.y1 + d.y2) / 2 - g.y1) / (d.y2 - d.y1) / 4"}


@query("b21_deltas", by_image_sql(**_DELTAS))
def b21(spark, sf):
    p, g = G.box(), G.box("g_")
    d = G.deltas(p, g)
    b, t = G.from_deltas(p, d), G.tblr(p, g)
    back = G.from_tblr(p, t)
    return by_image(pairs(spark, sf), dx=d[0], dh=d[3], bx1=b.x1, by2=b.y2, tx1=back.x1, ty1=back.y1, top=t[0])


@query("b22_grid_priors", "SELECT l AS level, r, c, a AS anchor, c * s - 4.0 * a AS x1, r * s + 4.0 * a AS y2 FROM (SELECT unnest([0, 1]) AS l), (SELECT unnest(range(40)) AS r), (SELECT unnest(range(40)) AS c), (SELECT unnest([1, 2]) AS a), LATERAL (SELECT 8 * (l + 1) AS s, 40 // (l + 1) AS n) WHERE r < n AND c < n")
def b22(spark, sf):
    from opalgrid.operators.assign import grid_priors

    levels = spark.createDataFrame([(0, 40, 40, 8), (1, 20, 20, 16)], "level int, rows int, cols int, stride int")
    base = spark.createDataFrame([(l, a, -4.0 * a, -4.0 * a, 4.0 * a, 4.0 * a) for l in (0, 1) for a in (1, 2)], "level int, anchor int, x1 double, y1 double, x2 double, y2 double")
    return grid_priors(levels, base).select("level", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "anchor", "x1", "y2")


@query("b24_polygon_area", f"WITH {DET} SELECT image_id, det_id, (x2 - x1) * (y2 - y1) / 2 AS area FROM det")
def b24(spark, sf):
    tri = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    return det(spark, sf).select("image_id", "det_id", G.polygon_area(tri).alias("area"))


@query("c1_c2_score_and_size", f"WITH {DET} SELECT image_id, det_id FROM det WHERE score >= 0.3 AND least(x2 - x1, y2 - y1) >= 48 AND (x2 - x1) * (y2 - y1) >= 2500")
def c1(spark, sf):
    b = G.box()
    return det(spark, sf).where((F.col("score") >= 0.3) & (F.least(G.width(b), G.height(b)) >= 48) & (G.area(b) >= 2500)).select("image_id", "det_id")


@query("c3_valid_split", f"WITH {BOTH} SELECT x1 >= 0 AND y1 >= 0 AS valid, count(*) AS n, count(DISTINCT image_id) AS images FROM gt GROUP BY 1")
def c3(spark, sf):
    ok = G.valid(G.box()) & (F.col("x1") >= 0) & (F.col("y1") >= 0)
    return gt(spark, sf).groupBy(ok.alias("valid")).agg(F.count("*").alias("n"), F.countDistinct("image_id").alias("images"))


@query("c4_whitelist", "SELECT p_partkey, lower(p_type) IN ('economy anodized', 'promo plated') OR lower(p_brand) = 'brand#3' AS kept FROM part")
def c4(spark, sf):
    names = ["  Economy  ANODIZED", "promo plated"]
    wanted = spark.createDataFrame([(n,) for n in names], "name string").select(T.name_key(F.col("name")).alias("k"))
    p = table(spark, sf, "part").withColumn("k", T.name_key(F.col("p_type")))
    hit = p.join(F.broadcast(wanted.withColumn("hit", F.lit(True))), "k", "left")
    return hit.select("p_partkey", (F.coalesce("hit", F.lit(False)) | (T.name_key(F.col("p_brand")) == "brand#3")).alias("kept"))


@query("c5_unambiguous", "SELECT o_orderkey FROM (SELECT o_orderkey, o_orderpriority AS d, min(o_orderkey) OVER w AS a, max(o_orderkey) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority)) WHERE a = b")
def c5(spark, sf):
    return R.unambiguous(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", "o_orderkey").select("o_orderkey")


@query("c6_gt_classes", f"WITH {BOTH} SELECT DISTINCT image_id, det_id FROM det SEMI JOIN gt USING (image_id, cls)")
def c6(spark, sf):
    return det(spark, sf).join(gt(spark, sf).select("image_id", "cls").distinct(), ["image_id", "cls"], "left_semi").select("image_id", "det_id")


@query("c9_images_with_annotations", f"WITH {BOTH} SELECT image_id FROM gt GROUP BY image_id HAVING bool_or(x2 - x1 > 60 AND y2 - y1 > 45)")
def c9(spark, sf):
    return gt(spark, sf).groupBy("image_id").agg(F.bool_or((F.col("x2") - F.col("x1") > 60) & (F.col("y2") - F.col("y1") > 45)).alias("ok")).where("ok").select("image_id")


@query("c10_captions", "SELECT doc_id FROM documents WHERE NOT contains(text, '<') AND NOT contains(text, '>') AND NOT contains(text, 'http') AND NOT contains(text, chr(10)) AND NOT regexp_matches(text, '[^\\x00-\\x7F]') AND len(regexp_split_to_array(trim(text), '\\s+')) < 240")
def c10(spark, sf):
    return table(spark, sf, "documents").where(T.caption_ok(F.col("text"))).select("doc_id")
