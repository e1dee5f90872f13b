"""Window, limit, set and text queries (inventory G, H, I, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opalgrid.functions import geometry as G, text as T
from opalgrid.operators import rank as R
from opalgrid.plans.carrier import BOTH, DET, det, gt, query, table

KEYS = ["image_id", "cls"]
_GEO = "(x2 - x1) * (y2 - y1) DESC, (y1 + y2) / 2 DESC, (x1 + x2) / 2 DESC, det_id"


@query("g1_ids_by_score", f"WITH {DET} SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS marker_id FROM det")
def g1(spark, sf):
    return R.numbered(det(spark, sf), ["image_id"], "score").select("image_id", "det_id", "marker_id")


@query("g2_g3_ids_by_geometry", f"WITH {DET} SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY {_GEO}) + 4 AS marker_id FROM det")
def g2(spark, sf):
    return R.numbered(det(spark, sf), ["image_id"], "spatial", start=5).select("image_id", "det_id", "marker_id")


@query("g4_reading_order", f"WITH {DET} SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id, cls ORDER BY (x1 + x2) / 2, (y1 + y2) / 2, det_id) AS lr, row_number() OVER (PARTITION BY image_id, cls ORDER BY (y1 + y2) / 2, (x1 + x2) / 2, det_id) AS tb FROM det")
def g4(spark, sf):
    d = R.numbered(det(spark, sf), KEYS, "left_to_right", "lr")
    return R.numbered(d, KEYS, "top_to_bottom", "tb").select("image_id", "det_id", "lr", "tb")


@query("g5_adjacent_gap", f"WITH {DET}, v AS (SELECT image_id, cls, (x1 + x2) / 2 - lag((x1 + x2) / 2) OVER (PARTITION BY image_id, cls ORDER BY (x1 + x2) / 2, det_id) AS g FROM det) SELECT image_id, cls, round(coalesce(min(g) / 800, 0), 6) AS min_gap FROM v GROUP BY 1, 2")
def g5(spark, sf):
    return R.adjacent_gap(det(spark, sf), KEYS, G.centre(G.box())[0]).withColumn("min_gap", F.round("min_gap", 6))


@query("g6_rank_policy", f"WITH {DET}, r AS (SELECT image_id, cls, det_id, row_number() OVER (PARTITION BY image_id, cls ORDER BY (x1 + x2) / 2, (y1 + y2) / 2, det_id) AS rank, count(*) OVER (PARTITION BY image_id, cls) AS n FROM det) SELECT image_id, det_id, rank, n FROM r WHERE n <= 3 OR rank = 1 OR rank = n")
def g6(spark, sf):
    return R.extremes(det(spark, sf), KEYS, "left_to_right").select("image_id", "det_id", "rank", "n")


@query("g7_size_extremes", f"WITH {DET}, a AS (SELECT *, (x2 - x1) * (y2 - y1) AS a FROM det), r AS (SELECT image_id, cls, det_id, a, row_number() OVER (PARTITION BY image_id, cls ORDER BY a DESC, det_id) AS hi, row_number() OVER (PARTITION BY image_id, cls ORDER BY a, det_id) AS lo FROM a) SELECT image_id, cls, max(det_id) FILTER (WHERE hi = 1) AS largest, max(det_id) FILTER (WHERE lo = 1) AS smallest, round((max(a) - min(a)) / max(a), 6) AS difference, count(*) AS n FROM r GROUP BY 1, 2")
def g7(spark, sf):
    return R.size_extremes(det(spark, sf), KEYS).withColumn("difference", F.round("difference", 6))


@query("h1_h2_skip_limit", f"WITH {DET} SELECT image_id, det_id FROM det ORDER BY score DESC, image_id, det_id LIMIT 200 OFFSET 50")
def h2(spark, sf):
    """The feature is the page: rows 51 to 250 by score."""
    return R.page(det(spark, sf).select("image_id", "det_id", "score"), [F.desc("score"), F.col("image_id"), F.col("det_id")], 50, 200).select("image_id", "det_id")


@query("h3_h5_caps", f"WITH {DET}, a AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY score DESC, det_id) AS r FROM det), b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS q FROM a WHERE r <= 3) SELECT image_id, det_id FROM b WHERE q <= 5")
def h3(spark, sf):
    return R.capped(det(spark, sf), "image_id", "cls", 3, 5).select("image_id", "det_id")


@query("h4_images_per_class", f"WITH {BOTH}, i AS (SELECT DISTINCT cls, image_id FROM gt), r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY image_id) AS r FROM i) SELECT DISTINCT image_id FROM r WHERE r <= 20")
def h4(spark, sf):
    return R.first_n(gt(spark, sf).select("cls", "image_id").distinct(), ["cls"], [F.col("image_id")], 20).select("image_id").distinct()


@query("h6_merge_to_top_n", f"WITH {DET} SELECT cls, image_id, det_id FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, image_id, det_id) AS r FROM det) WHERE r <= 100")
def h6(spark, sf):
    """Two sorted halves, each already cut, merged to the best of both."""
    order = [F.desc("score"), F.col("image_id"), F.col("det_id")]
    d = det(spark, sf)
    halves = [R.first_n(d.where(F.col("image_id") % 2 == k), ["cls"], order, 100) for k in (0, 1)]
    return R.first_n(halves[0].unionByName(halves[1]), ["cls"], order, 100).select("cls", "image_id", "det_id")


@query("h8_h9_hash_split", "SELECT labelled, count(*) AS n FROM (SELECT ('0x' || substr(md5(o_orderkey || '/3'), 1, 8))::BIGINT % 10000 < 1000 AS labelled FROM orders) GROUP BY 1")
def h8(spark, sf):
    return R.split_by_hash(table(spark, sf, "orders"), ["o_orderkey"], 10, 3).groupBy("labelled").agg(F.count("*").alias("n"))


@query("h10_shards", "SELECT CAST(o_orderkey % 8 AS INT) AS shard, count(*) AS n FROM orders GROUP BY 1")
def h10(spark, sf):
    return R.sharded(table(spark, sf, "orders"), "o_orderkey", 8).groupBy("shard").agg(F.count("*").alias("n"))


@query("h11_half_videos", "WITH f AS (SELECT DISTINCT user_id AS video, CAST(floor(epoch(ts) / 60) AS BIGINT) AS frame FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY video) AS n FROM f) SELECT video, count(*) FILTER (WHERE i < n // 2 + 1) AS first, count(*) FILTER (WHERE i >= n // 2 + 1) AS second FROM r GROUP BY video")
def h11(spark, sf):
    f = frames(spark, sf).select("video", "frame").distinct()
    return R.halves(f).groupBy("video").agg(F.count_if("first_half").alias("first"), F.count_if(~F.col("first_half")).alias("second"))


def frames(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("video"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("long").alias("frame"), "event_id", "event_type", "value")


@query("i3_chained_exclusion", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 1 AND o_custkey % 5 <> 2 AND o_orderstatus <> 'P'")
def i3(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return R.without(o, o.where("o_orderkey % 4 = 1"), o.where("o_custkey % 5 = 2"), o.where("o_orderstatus = 'P'"), on="o_orderkey").select("o_orderkey")


@query("i4_first_by_name", "SELECT p_type AS name, min(p_partkey) AS first FROM part GROUP BY p_type")
def i4(spark, sf):
    return R.first_by(table(spark, sf, "part").select("p_type", "p_partkey"), ["p_type"], [F.col("p_partkey")]).select(F.col("p_type").alias("name"), F.col("p_partkey").alias("first"))


@query("i5_ordered_distinct", "SELECT c_nationkey, string_agg(s, ',' ORDER BY f) AS segments FROM (SELECT c_nationkey, c_mktsegment AS s, min(c_custkey) AS f FROM customer GROUP BY 1, 2) GROUP BY 1")
def i5(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment"))).alias("l"))
    return c.select("c_nationkey", F.array_join(F.array_distinct(F.transform("l", lambda x: x["c_mktsegment"])), ",").alias("segments"))


@query("i6_concat_models", f"WITH {DET} SELECT image_id, m AS model, count(*) AS n FROM det, (SELECT unnest([0, 1]) AS m) WHERE m = 0 OR det_id % 2 = 0 GROUP BY 1, 2")
def i6(spark, sf):
    d = det(spark, sf)
    both = d.withColumn("model", F.lit(0)).unionByName(d.where("det_id % 2 = 0").withColumn("model", F.lit(1)))
    return both.groupBy("image_id", "model").agg(F.count("*").alias("n"))


@query("i7_first_of_frame", "SELECT video, frame, min(event_id) AS event_id FROM (SELECT user_id AS video, CAST(floor(epoch(ts) / 60) AS BIGINT) AS frame, event_id FROM events) GROUP BY 1, 2")
def i7(spark, sf):
    return R.first_by(frames(spark, sf), ["video", "frame"], [F.col("event_id")]).select("video", "frame", "event_id")


_SAID = "CASE o_orderkey % 6 WHEN 0 THEN '<answer>' || o_custkey || '</answer>' WHEN 1 THEN 'The Answer: ' || o_custkey WHEN 2 THEN '<ANSWER> ' || o_custkey || ' </ANSWER>' WHEN 3 THEN 'ID 2 or ID **' || o_custkey || '**' WHEN 4 THEN o_custkey || ' and ' || o_custkey ELSE '4 and 5' END"


def said(spark, sf):
    k = F.col("o_custkey").cast("string")
    m = F.col("o_orderkey") % 6
    text = F.when(m == 0, F.concat(F.lit("<answer>"), k, F.lit("</answer>"))).when(m == 1, F.concat(F.lit("The Answer: "), k)).when(m == 2, F.concat(F.lit("<ANSWER> "), k, F.lit(" </ANSWER>"))).when(m == 3, F.concat(F.lit("ID 2 or ID **"), k, F.lit("**"))).when(m == 4, F.concat(k, F.lit(" and "), k)).otherwise(F.lit("4 and 5"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", text.alias("t"))


@query("j1_j4_answers", "SELECT o_orderkey, CASE WHEN m IN (0, 1) THEN o_custkey END AS strict, CASE WHEN m IN (0, 1, 2) THEN o_custkey END AS tolerant, CASE WHEN m <= 4 THEN o_custkey END AS cascade, '<answer>' || coalesce(CASE WHEN m <= 4 THEN o_custkey END, 0) || '</answer>' AS tag FROM (SELECT *, o_orderkey % 6 AS m FROM orders)")
def j1(spark, sf):
    t = F.col("t")
    return said(spark, sf).select("o_orderkey", T.answer_strict(t).alias("strict"), T.answer_tolerant(t).alias("tolerant"), T.answer_cascade(t).alias("cascade"), T.answer_tag(t).alias("tag"))


@query("j5_j7_names", "SELECT p_partkey, lower(p_brand) || ' x' AS key, lower(replace(p_type, ' ', '')) AS tight, p_brand AS stem, contains(lower(p_name), 'sh') AS named FROM part")
def j5(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", T.name_key(F.concat(F.lit("  "), F.col("p_brand"), F.lit(" \t X "))).alias("key"), T.name_tight(F.col("p_type")).alias("tight"), T.stem(F.concat(F.lit("/a/b/"), F.col("p_brand"), F.lit(".tar.gz"))).alias("s"), T.mentions(F.col("p_name"), F.lit("s h")).alias("named")).withColumn("stem", F.regexp_replace("s", r"\.tar$", "")).drop("s")


@query("j6_class_mentions", "SELECT doc_id, word FROM documents, (SELECT unnest(['the', 'ofthe', 'und']) AS word) WHERE contains(lower(regexp_replace(text, '\\s+', '', 'g')), word)")
def j6(spark, sf):
    words = spark.createDataFrame([("the",), ("of the",), ("und",)], "word string")
    d = table(spark, sf, "documents").select("doc_id", T.name_tight(F.col("text")).alias("t"))
    return d.join(F.broadcast(words), F.contains("t", T.name_tight(F.col("word")))).select("doc_id", T.name_tight(F.col("word")).alias("word"))


@query("j8_j9_questions", "SELECT p_partkey, 'In this image, which marker ID corresponds to: ' || p_name || '? Answer with <answer>ID</answer>.' AS q, CASE WHEN p_size < 10 THEN '第' || ['一','二','三','四','五','六','七','八','九'][p_size] || '个' WHEN p_size % 10 = 0 THEN '第' || CASE WHEN p_size // 10 > 1 THEN ['一','二','三','四','五','六','七','八','九'][p_size // 10] ELSE '' END || '十个' ELSE '第' || CASE WHEN p_size // 10 > 1 THEN ['一','二','三','四','五','六','七','八','九'][p_size // 10] ELSE '' END || '十' || ['一','二','三','四','五','六','七','八','九'][p_size % 10] || '个' END AS nth FROM part")
def j8(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.question(F.col("p_name")).alias("q"), T.ordinal_zh(F.col("p_size")).alias("nth"))


@query("j10_bilingual_migration", "SELECT p_partkey, 'a ship（舰船） near the dam（水坝） of ' || p_brand AS q FROM part")
def j10(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.migrate_bilingual(F.concat(F.lit("a ship near the dam（水坝） of "), F.col("p_brand"))).alias("q"))


@query("j11_j13_labels", "SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 2, '0') || '_' || regexp_replace(p_type, '[^A-Za-z0-9_-]+', '_', 'g') AS dir, p_type AS clean, CASE WHEN p_size % 2 = 0 THEN 'lae' ELSE 'unknown' END AS detector, p_brand AS tail FROM part")
def j11(spark, sf):
    p = table(spark, sf, "part")
    path = F.concat(F.lit("/x/"), F.when(F.col("p_size") % 2 == 0, "LAE_run").otherwise("other"))
    return p.select("p_partkey", T.safe_class_dir(F.col("p_size"), F.col("p_type")).alias("dir"), T.clean_label(F.concat(F.regexp_replace("p_type", " ", "_"), F.lit(" (of  x)"))).alias("clean"), T.detector_name(path, {"lae": "lae", "mtp": "mtp"}).alias("detector"), T.after_slash(F.concat(F.lit("bbox/"), F.col("p_brand"))).alias("tail"))


@query("j14_j16_prompts", "WITH n AS (SELECT c_nationkey, list(s ORDER BY s) AS l FROM (SELECT DISTINCT c_nationkey, lower(c_mktsegment) AS s FROM customer) GROUP BY 1) SELECT c_nationkey, array_to_string(l, ' . ') || ' .' AS prompt, coalesce(length(l[1]) + 3, -1) AS second_at, array_to_string(l, '|') AS names, (len(l) + 1) // 2 AS n_chunks FROM n WHERE len(l) > 1")
def j14(spark, sf):
    n = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set(F.lower("c_mktsegment"))).alias("l")).where(F.size("l") > 1)
    p = T.prompt(F.col("l"))
    return n.select("c_nationkey", p.alias("prompt"), F.element_at(T.prompt_spans(F.col("l")), 2)["b"].cast("long").alias("second_at"), F.array_join(T.prompt_names(p), "|").alias("names"), F.size(T.chunks(F.col("l"), 2)).cast("long").alias("n_chunks"))


@query("j16_phrases", "SELECT p_partkey, substr(p_name, 1, 2) || ' ' || substr(p_name, 4, 3) AS phrase FROM part")
def j16(spark, sf):
    spans = F.array(F.struct(F.lit(3).alias("b"), F.lit(6).alias("e")), F.struct(F.lit(0).alias("b"), F.lit(2).alias("e")))
    return table(spark, sf, "part").select("p_partkey", T.phrase_of(F.col("p_name"), spans).alias("phrase"))


@query("j18_j20_strings", "SELECT conv_id, turn, 'data:image/png;base64,' || to_base64(encode(text)) AS url, turn % 3 = 0 OR contains(text, '[WARN]') AS warned FROM conversations")
def j18(spark, sf):
    c = table(spark, sf, "conversations")
    said = F.concat(F.col("text"), F.when(F.col("turn") % 3 == 0, "\n[WARN] HTTP 500").otherwise(""))
    return c.select("conv_id", "turn", T.data_url(F.col("text").cast("binary"), F.lit("/a/b.PNG")).alias("url"), T.warned(said).alias("warned"))


@query("j20_candidate_hint", f"WITH {DET} SELECT image_id, cls, string_agg(CAST(det_id AS VARCHAR), ', ' ORDER BY score DESC, det_id) AS hint FROM det GROUP BY 1, 2")
def j20(spark, sf):
    l = det(spark, sf).groupBy("image_id", "cls").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "det_id"))).alias("l"))
    return l.select("image_id", "cls", F.array_join(F.transform("l", lambda x: x["det_id"].cast("string")), ", ").alias("hint"))
