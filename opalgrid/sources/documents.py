"""Scans and parsers. ``read_*`` open files of any store that Spark reads; ``parse_*`` take a table
with the raw text in ``value``, so a scan of files and a column of documents share one path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

DASHES = "-" * 70
OBJECT = "struct<name:string,pose:string,difficult:int,description:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>"
ANNOTATION = f"filename string, size struct<width:int,height:int,depth:int>, object array<{OBJECT}>"
MARKERS = "image_name string, markers array<struct<marker_id:long,bbox:array<double>,class:string,label:int,score:double>>"
ONE = "struct<bbox:array<double>,score:double,label:int>"


def read_texts(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """value and path of text files."""
    return spark.read.text(path, wholetext=whole).select("value", F.col("_metadata.file_path").alias("path"))


def row_index(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Dense numbers from 0 of the rows of each file, in file order, without one global sort: rows
    are numbered inside their block and blocks are offset by a small table of counts. ``df`` is a
    file scan that still has its _metadata column."""
    at = df.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"))
    own = at.withColumn("__r", F.row_number().over(W.partitionBy("__f", "__b").orderBy("__m")) - 1)
    before = at.groupBy("__f", "__b").agg(F.count("*").alias("__n")).withColumn("__o", F.coalesce(F.sum("__n").over(W.partitionBy("__f").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return own.join(before, ["__f", "__b"]).withColumn(name, (F.col("__o") + F.col("__r")).cast("long")).drop("__f", "__b", "__m", "__r", "__o")


def read_jsonl(spark: SparkSession, path: str, schema: str, fail_fast: bool = False, index: bool = True) -> DataFrame:
    """JSON lines with their ordinal; blank lines are skipped. ``fail_fast`` raises on a bad line."""
    lines = spark.read.text(path)
    lines = row_index(lines) if index else lines
    return parse_jsonl(lines, schema, fail_fast)


def parse_jsonl(lines: DataFrame, schema: str, fail_fast: bool = False) -> DataFrame:
    rest = [c for c in lines.columns if c != "value"]
    mode = {"mode": "FAILFAST" if fail_fast else "PERMISSIVE"}
    return lines.where(F.trim("value") != "").select(*rest, F.from_json("value", schema, mode).alias("__j")).select(*rest, "__j.*")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return parse_blocks(read_texts(spark, path), ["path"])


def parse_blocks(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block_idx (dense from 0), image_file (first line) and body of the texts between rows of
    70 dashes. Empty blocks do not count."""
    cut = files.select(*keys, F.posexplode(F.split("value", DASHES)).alias("p", "block")).withColumn("block", F.trim(F.translate("block", "\r", ""))).withColumn("block", F.regexp_replace("block", r"^\s+|\s+$", "")).where("block <> ''")
    first = F.trim(F.substring_index("block", "\n", 1))
    body = F.trim(F.when(F.contains("block", F.lit("\n")), F.expr("substring(block, instr(block, '\n') + 1)")).otherwise(F.lit("")))
    return cut.select(*keys, (F.row_number().over(W.partitionBy(*keys).orderBy("p")) - 1).alias("block_idx"), first.alias("image_file"), body.alias("body"))


def complete_prefix(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks before the first one without a body: what an interrupted run finished."""
    broken = F.min(F.when(F.trim("body") == "", F.col("block_idx"))).over(W.partitionBy(*keys))
    return blocks.withColumn("__x", broken).where(F.col("__x").isNull() | (F.col("block_idx") < F.col("__x"))).drop("__x")


def read_annotations_xml(spark: SparkSession, path: str) -> DataFrame:
    return parse_annotations_xml(read_texts(spark, path))


def parse_annotations_xml(docs: DataFrame, strict: bool = False) -> DataFrame:
    """filename, size, pos and the fields of each object. ``strict`` raises on a box with a missing side."""
    a = docs.select(F.from_xml("value", ANNOTATION).alias("a")).select("a.filename", "a.size", F.posexplode("a.object").alias("pos", "o"))
    out = a.select("filename", "size", "pos", "o.name", "o.pose", "o.difficult", "o.description", "o.bndbox.*")
    whole = F.col("xmin").isNotNull() & F.col("ymin").isNotNull() & F.col("xmax").isNotNull() & F.col("ymax").isNotNull()
    return out.where(F.assert_true(whole, F.concat(F.lit("incomplete bndbox in "), F.col("filename"))).isNull()) if strict else out.where(whole)


def voc_shift(df: DataFrame) -> DataFrame:
    """One-based pixel boxes to zero-based."""
    return df.withColumns({c: F.col(c) - 1 for c in ("xmin", "ymin", "xmax", "ymax")})


def _box_columns(b: Column) -> list[Column]:
    return [F.get(b, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]


def parse_markers(docs: DataFrame) -> DataFrame:
    m = docs.select(F.from_json("value", MARKERS).alias("m")).select("m.image_name", F.explode("m.markers").alias("k"))
    return m.select("image_name", "k.marker_id", "k.class", "k.label", "k.score", *_box_columns(F.col("k.bbox")))


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """Marker JSON files, one per image; the file name stands in for a missing image name."""
    from opalgrid.functions.text import stem

    rows = spark.read.schema(T.StructType.fromDDL(MARKERS)).option("multiLine", True).json(path).select(F.coalesce("image_name", stem(F.col("_metadata.file_path"))).alias("image_name"), F.explode("markers").alias("k"))
    return rows.select("image_name", "k.marker_id", "k.class", "k.label", "k.score", *_box_columns(F.col("k.bbox")))


def parse_detections(docs: DataFrame) -> DataFrame:
    """Parallel arrays of one document per image: pos (from 1), class_name, score and box."""
    rest = [c for c in docs.columns if c != "value"]
    d = docs.select(*rest, F.from_json("value", "bboxes array<array<double>>, scores array<double>, labels array<int>, class_names array<string>").alias("d"))
    rows = d.select(*rest, F.posexplode(F.arrays_zip(F.col("d.bboxes").alias("b"), F.col("d.scores").alias("s"), F.col("d.class_names").alias("c"))).alias("p", "z"))
    return rows.select(*rest, (F.col("p") + 1).cast("long").alias("pos"), F.col("z.c").alias("class_name"), F.col("z.s").alias("score"), *_box_columns(F.col("z.b")))


def parse_predictions(docs: DataFrame, least: float) -> DataFrame:
    """Predictions of any of three layouts: parallel arrays, {predictions: [...]}, or a bare array."""
    rest = [c for c in docs.columns if c != "value"]
    arrays = F.from_json("value", "bboxes array<array<double>>, scores array<double>, labels array<int>")
    zipped = F.transform(F.arrays_zip(arrays["bboxes"].alias("b"), arrays["scores"].alias("s"), arrays["labels"].alias("l")), lambda z: F.struct(z["b"].alias("bbox"), z["s"].alias("score"), z["l"].alias("label")))
    listed = F.from_json("value", f"predictions array<{ONE}>")["predictions"]
    bare = F.from_json("value", f"array<{ONE}>")
    chosen = F.when(F.trim("value").startswith("["), bare).otherwise(F.coalesce(F.when(arrays["bboxes"].isNotNull(), zipped), listed))
    rows = docs.select(*rest, F.posexplode(chosen).alias("p", "d"))
    return rows.where(F.col("d.score") >= least).select(*rest, (F.col("p") + 1).alias("pos"), "d.score", "d.label", *_box_columns(F.col("d.bbox")))


def parse_ints(lines: DataFrame, name: str) -> DataFrame:
    """One integer a line; others are left out."""
    rest = [c for c in lines.columns if c != "value"]
    return lines.select(*rest, F.regexp_replace("value", r"\s+", "").try_cast("bigint").alias(name)).where(F.col(name).isNotNull())


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations, categories of one COCO document."""
    schema = "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<id:long,image_id:long,category_id:int,bbox:array<double>,area:double,iscrowd:int,ignore:int>>, categories array<struct<id:int,name:string,supercategory:string>>"
    doc = spark.read.schema(T.StructType.fromDDL(schema)).option("multiLine", True).json(path)
    return tuple(doc.select(F.inline(c)) for c in ("images", "annotations", "categories"))


def coco_boxes(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Boxes (xyxy) with file and class names; crowds are left out. Categories are a dimension table."""
    b = F.col("bbox")
    a = annotations.where(F.coalesce("iscrowd", F.lit(0)) != 1).select("id", "image_id", "category_id", F.get(b, F.lit(0)).alias("x1"), F.get(b, F.lit(1)).alias("y1"), (F.get(b, F.lit(0)) + F.get(b, F.lit(2))).alias("x2"), (F.get(b, F.lit(1)) + F.get(b, F.lit(3))).alias("y2"))
    return a.join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id").join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("class")), "category_id", "left")


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes of image files; contents are never read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return rows.where(F.lower("path").rlike(r"\.(jpe?g|png|bmp|webp|tiff?)$"))


def parse_csv(lines: DataFrame, schema: str, separator: str = ",") -> DataFrame:
    rest = [c for c in lines.columns if c != "value"]
    return lines.where(F.trim("value") != "").select(*rest, F.from_csv("value", schema, {"sep": separator}).alias("__c")).select(*rest, "__c.*")


def parse_strided(files: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of '#' blocks: name, width, height, count line by line, then count box lines."""
    rows = files.select(*keys, F.explode(F.filter(F.split("value", r"(?m)^#.*$"), lambda x: F.trim(x) != "")).alias("b")).select(*keys, F.filter(F.split("b", "\n"), lambda x: F.trim(x) != "").alias("l"))
    rows = rows.select(*keys, F.trim(F.get("l", F.lit(0))).alias("image"), F.get("l", F.lit(1)).try_cast("int").alias("width"), F.get("l", F.lit(2)).try_cast("int").alias("height"), F.slice("l", 5, F.greatest(F.size("l") - 4, F.lit(0))).alias("boxes"))
    return rows.select(*keys, "image", "width", "height", F.posexplode_outer("boxes").alias("pos", "line"))


def parse_odgt(lines: DataFrame) -> DataFrame:
    r = parse_jsonl(lines, "ID string, gtboxes array<struct<gt_id:long,fbox:array<double>,vbox:array<double>,extra:struct<ignore:int>>>")
    r = r.select("ID", F.posexplode("gtboxes").alias("pos", "g"))
    return r.select("ID", "pos", "g.gt_id", *[F.get("g.fbox", F.lit(i)).alias(n) for i, n in enumerate("xywh")], F.coalesce("g.extra.ignore", F.lit(0)).alias("ignore"))


def parse_mot(lines: DataFrame) -> DataFrame:
    """Ground truth or detection rows; short rows get conf 1, category 1, visibility 1."""
    p = F.split("value", ",")
    at = lambda i, kind: F.try_element_at(p, F.lit(i + 1)).try_cast(kind)
    names = ["frame_id", "ins_id", "x", "y", "w", "h", "conf", "category_id", "visibility"]
    kinds = ["bigint", "bigint", *["double"] * 5, "int", "double"]
    out = lines.where(F.trim("value") != "").select(*[at(i, k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))])
    return out.fillna({"conf": 1.0, "category_id": 1, "visibility": 1.0})


def parse_log(lines: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """iter, epoch, loss, time and the rest (map) of log lines; a line without an epoch has that of
    the lines before it. ``keys`` split independent logs."""
    m = lines.select(order, *keys, F.from_json("value", "map<string,double>").alias("m"))
    epoch = F.last("e", ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    out = m.withColumn("e", F.try_element_at("m", F.lit("epoch"))).withColumn("epoch", epoch)
    return out.select(order, *keys, "epoch", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("iter", "loss", "time")], F.map_filter("m", lambda k, v: F.contains(k, F.lit("/"))).alias("validation"))


def not_done(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")
