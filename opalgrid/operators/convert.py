"""Dataset converters: relational forms of COCO, ODVG, VOC, MOT and crowd annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from opalgrid.functions.geometry import box, visible


def to_coco(boxes: DataFrame, images: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations, categories tables. ``boxes``: image_id, class, box, optional ignore."""
    ignore = F.coalesce("ignore", F.lit(0)) if "ignore" in boxes.columns else F.lit(0)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ann = boxes.join(categories.select(F.col("name").alias("class"), F.col("id").alias("category_id")), "class")
    number = F.xxhash64("image_id", "class", "x1", "y1", "x2", "y2")
    return images, ann.select(number.alias("id"), "image_id", "category_id", F.array("x1", "y1", w, h).alias("bbox"), (w * h).alias("area"), F.lit(0).alias("iscrowd"), ignore.alias("ignore")), categories


def dense_ids(df: DataFrame, order: list, name: str = "id", start: int = 0) -> DataFrame:
    """Numbers of a dimension table (classes, videos), from ``start``."""
    return df.withColumn(name, (F.row_number().over(W.orderBy(*order)) - 1 + start).cast("long"))


def to_odvg_detection(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row per image with visible instances: file name, size, instances (bbox, label, category)."""
    ok = boxes.join(images, "image_id").where(visible(box(), F.col("width"), F.col("height")))
    item = F.struct(F.array("x1", "y1", "x2", "y2").alias("bbox"), F.col("label"), F.col("class").alias("category"))
    return ok.groupBy("image_id", "file_name", "height", "width").agg(F.sort_array(F.collect_list(item)).alias("instances"))


def to_odvg_grounding(captions: DataFrame, regions: DataFrame) -> DataFrame:
    """caption and regions of each image: a phrase with all its boxes, phrases in order of first use."""
    r = regions.groupBy("image_id", "phrase").agg(F.array_sort(F.collect_list(F.struct("pos", F.array("x1", "y1", "x2", "y2").alias("b")))).alias("l"), F.min("pos").alias("first"))
    r = r.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("first", "phrase", F.transform("l", lambda x: x["b"]).alias("bbox")))).alias("regions"))
    return captions.join(r, "image_id")


def seen_unseen(annotations: DataFrame, images: DataFrame, seen: list[str], unseen: list[str], cls: str = "class") -> tuple[DataFrame, DataFrame]:
    """(image, annotation) rows of the seen classes and of the unseen ones; an image may be in both."""
    part = lambda names: annotations.where(F.col(cls).isin(*names)).join(images, "image_id", "left_semi")
    return part(seen), part(unseen)


def from_one_source(images: DataFrame, annotations: DataFrame, prefix: str) -> DataFrame:
    """Annotations of the images whose path begins with a source's prefix."""
    return annotations.join(images.where(F.col("file_name").startswith(prefix)).select("image_id"), "image_id", "left_semi")


def panoptic_to_semantic(segments: DataFrame, mapping: DataFrame, default: int = 255) -> DataFrame:
    """category ids replaced by train ids of a mapping table (category_id, train_id)."""
    return segments.join(F.broadcast(mapping), "category_id", "left").withColumn("train_id", F.coalesce("train_id", F.lit(default)))


def mot_to_coco(rows: DataFrame) -> DataFrame:
    """MOT ground truth as annotations: only considered rows of class 1, positive sizes."""
    return rows.where("conf > 0 and category_id = 1 and w > 0 and h > 0").select("video", "frame_id", "ins_id", F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"), "visibility")
