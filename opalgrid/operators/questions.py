"""Question rows, retries and merges (table-valued generators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from opalgrid.functions import text as T
from opalgrid.functions.geometry import area, box, centre
from opalgrid.operators.match import best_match


def referring_pairs(samples: DataFrame, markers: DataFrame, skip_unmatched: bool = True, dialect: str = "en") -> DataFrame:
    """One question per annotated object with the marker that fits it; unmatched objects are left
    out, or kept with marker -1."""
    m = best_match(samples, markers)
    m = m.where("marker_id is not null") if skip_unmatched else m.withColumn("marker_id", F.coalesce("marker_id", F.lit(-1).cast("long")))
    return m.select("image_id", "sample_id", T.question(F.col("description"), dialect).alias("question"), "marker_id", "match_iou", "match_policy", T.expected_answer(F.col("marker_id")).alias("expected_answer"))


def spatial_questions(markers: DataFrame, min_gap: float = 0.05, min_area_difference: float = 0.2, full_up_to: int = 3, dense_from: int = 13, scale: float = 800.0, image: str = "image_id", cls: str = "cls") -> DataFrame:
    """Questions of one image and class by place and size.

    single: the only one of its class. left_to_right, top_to_bottom: a rank position (all of small
    groups, else first and last) when neighbours are ``min_gap`` * scale apart. largest, smallest:
    when areas differ enough. fallback: markers that no other question covers, in groups below
    ``dense_from``. Two windows over one partitioning serve all branches; only the fallback joins.
    """
    b = box()
    (cx, cy), a = centre(b), area(b)
    w = W.partitionBy(image, cls)
    lr, tb = w.orderBy("cx", "cy", "marker_id"), w.orderBy("cy", "cx", "marker_id")
    m = markers.withColumns({"cx": cx, "cy": cy, "a": a.cast("double"), "n": F.count("*").over(w)})
    m = m.withColumns({"lr": F.row_number().over(lr), "tb": F.row_number().over(tb), "gx": F.col("cx") - F.lag("cx").over(lr), "gy": F.col("cy") - F.lag("cy").over(tb)})
    m = m.withColumns({"gap_x": F.min("gx").over(w) / scale, "gap_y": F.min("gy").over(w) / scale, "hi": F.max("a").over(w), "lo": F.min("a").over(w), "big": F.row_number().over(w.orderBy(F.desc("a"), "marker_id")), "small": F.row_number().over(w.orderBy("a", "marker_id"))})
    at_end = lambda r: (F.col("n") <= full_up_to) | (F.col(r) == 1) | (F.col(r) == F.col("n"))
    differ = (F.col("n") >= 2) & ((F.col("hi") - F.col("lo")) / F.col("hi") >= min_area_difference)
    many = F.col("n") >= 2
    kinds = F.filter(F.array(
        F.when(F.col("n") == 1, F.struct(F.lit("single").alias("kind"), F.lit(1).alias("rank"))),
        F.when(many & (F.col("gap_x") >= min_gap) & at_end("lr"), F.struct(F.lit("left_to_right").alias("kind"), F.col("lr").alias("rank"))),
        F.when(many & (F.col("gap_y") >= min_gap) & at_end("tb"), F.struct(F.lit("top_to_bottom").alias("kind"), F.col("tb").alias("rank"))),
        F.when(differ & (F.col("big") == 1), F.struct(F.lit("largest").alias("kind"), F.lit(1).alias("rank"))),
        F.when(differ & (F.col("small") == 1), F.struct(F.lit("smallest").alias("kind"), F.lit(1).alias("rank"))),
    ), lambda k: k.isNotNull())
    uncovered = F.when((F.size(kinds) == 0) & (F.col("n") < dense_from), F.array(F.struct(F.lit("fallback").alias("kind"), F.col("lr").alias("rank")))).otherwise(kinds)
    rows = m.select(image, cls, "marker_id", F.explode(uncovered).alias("q"))
    return rows.select(image, cls, "marker_id", "q.kind", F.col("q.rank").cast("long").alias("rank"), _said(F.col("q.kind"), F.col("q.rank"), F.col(cls)).alias("question"))


def _said(kind: Column, rank: Column, cls: Column) -> Column:
    name, nth = T.bilingual(cls), T.ordinal_zh(rank)
    parts = {"single": (F.lit("图中唯一的"), name), "left_to_right": (F.lit("从左到右"), nth, name), "top_to_bottom": (F.lit("从上到下"), nth, name), "largest": (F.lit("面积最大的"), name), "smallest": (F.lit("面积最小的"), name), "fallback": (F.lit("从左到右"), nth, name)}
    out = None
    for k, p in parts.items():
        text = F.concat(*p, F.lit("的编号是多少？"))
        out = F.when(kind == k, text) if out is None else out.when(kind == k, text)
    return out


def where_questions(markers: DataFrame, cls: str = "cls") -> DataFrame:
    return markers.select("image_id", "marker_id", T.question(F.col(cls), "where").alias("question"), F.struct("x1", "y1", "x2", "y2").alias("answer"))


def retry_subset(questions: DataFrame, responses: DataFrame, order: str = "row_idx", text: str = "response", strict: bool = True) -> DataFrame:
    """Questions whose response carries a warning: retry_index (from 0), original index, reason.
    With ``strict`` a response of another image than its question's raises."""
    r = responses.select(F.col(order), F.col("image_id").alias("__image"), F.col(text))
    both = questions.join(r, order)
    if strict:
        both = both.where(F.assert_true(F.col("image_id") == F.col("__image"), F.lit("responses are not aligned with questions")).isNull())
    bad = both.where(T.warned(F.col(text)))
    reason = F.trim(F.regexp_extract(text, r"\[WARN\]\s*([^\n]*)", 1))
    return bad.select(F.col(order).alias("original_index"), "image_id", reason.alias("reason"))


def indexed(df: DataFrame, order: str, name: str = "retry_index") -> DataFrame:
    """Dense numbers from 0 in order without one global window: rows are ranked inside
    buckets of the order's value range, and buckets are offset by their counts (a small table).
    ``order`` is an integer column without repeats."""
    bucket = F.expr(f"{order} div 65536")
    rows = df.withColumn("__p", bucket)
    before = rows.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__o", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.row_number().over(W.partitionBy("__p").orderBy(order)) - 1
    return rows.withColumn("__r", own).join(before, "__p").withColumn(name, (F.col("__o") + F.col("__r")).cast("long")).drop("__p", "__o", "__r")


def merged(old: DataFrame, retried: DataFrame, order: str = "row_idx", text: str = "response", placeholder: str = "<answer>0</answer>") -> DataFrame:
    """Old responses with the retried ones in their places, and what the merge has to watch:
    replaced, still_warned, placeholder."""
    n = retried.select(F.col("original_index").alias("__i"), F.col(text).alias("__t"))
    out = old.join(n, F.col(order) == F.col("__i"), "left")
    new = F.coalesce("__t", F.col(text))
    return out.select(order, "image_id", new.alias(text), F.col("__i").isNotNull().alias("replaced"), T.warned(new).alias("still_warned"), (F.trim(new) == placeholder).alias("placeholder"))


def merge_guards(result: DataFrame, n_manifest: int) -> DataFrame:
    """One row: whether as many responses were replaced as the manifest names, and none is still bad."""
    return result.agg(F.count_if("replaced").alias("n_replaced"), (F.count_if("replaced") == n_manifest).alias("complete"), F.count_if(F.col("replaced") & F.col("still_warned")).alias("n_still_warned"), F.count_if(F.col("replaced") & F.col("placeholder")).alias("n_placeholder"))


def marker_documents(markers: DataFrame, image: str = "image_id") -> DataFrame:
    """image and the JSON document of its markers, for one file per image."""
    item = F.struct("marker_id", F.array("x1", "y1", "x2", "y2").alias("bbox"), F.col("cls").alias("class"), F.round("score", 4).alias("score"))
    return markers.groupBy(image).agg(F.to_json(F.struct(F.first(image).cast("string").alias("image_name"), F.array_sort(F.collect_list(item)).alias("markers"))).alias("value"))


def xml_stub(images: DataFrame) -> DataFrame:
    """image_id and a minimal annotation document (columns file_name, width, height)."""
    part = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c.cast("string"), F.lit(f"</{tag}>"))
    return images.select("image_id", F.concat(F.lit("<annotation>"), part("filename", F.col("file_name")), F.lit("<size>"), part("width", F.col("width")), part("height", F.col("height")), F.lit("<depth>3</depth></size></annotation>")).alias("value"))
