"""Sinks: JSON lines, block text, per-image documents, MOT text, tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from opalgrid.sources.documents import DASHES


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One JSON object a row. With ``order`` rows are range-partitioned and sorted, so the files in
    name order are in order."""
    rows = df if not order else df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def block_text(image: Column, body: Column) -> Column:
    return F.concat(F.lit(DASHES + "\n"), image, F.lit("\n"), body)


def write_blocks(df: DataFrame, path: str, order: list[str]) -> None:
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(block_text(F.col("image_file"), F.col("body")).alias("value")).write.mode("overwrite").text(path)


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """Documents (column value) under one folder per key: for stores that want one file per image."""
    df.select(key, "value").write.mode("overwrite").partitionBy(key).text(path)


def mot_lines(tracks: DataFrame) -> DataFrame:
    """video and the text row of a track: frame, id, x, y, w, h, score, -1, -1, -1."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return tracks.select("video", "frame_id", F.concat_ws(",", "frame_id", "track_id", F.format_number("x1", "0.000"), F.format_number("y1", "0.000"), F.format_number(w, "0.000"), F.format_number(h, "0.000"), F.format_number("score", "0.000"), F.lit("-1,-1,-1")).alias("value"))


def shared_path(df: DataFrame, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where that is unset, a temporary one on a local
    master; on a cluster each executor would write to its own disk, so that raises."""
    import tempfile

    spark = df.sparkSession
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="opalgrid-")
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, which goes when the session ends."""
    path = shared_path(df, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_round_trip(df: DataFrame) -> DataFrame:
    """``df`` through JSON lines and Parquet."""
    spark = df.sparkSession
    lines, rows = shared_path(df, "jsonl"), shared_path(df, "table")
    write_jsonl(df, lines)
    spark.read.schema(df.schema).json(lines).write.parquet(rows)
    return spark.read.schema(df.schema).parquet(rows)
