"""Identifiers, ranks, caps, sampling and set operations: windows with explicit ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from opalgrid.functions.geometry import area, box, centre

ORDERS = {
    "score": lambda: [F.desc("score"), F.col("det_id")],
    "spatial": lambda: [F.desc(area(box())), F.desc(centre(box())[1]), F.desc(centre(box())[0]), F.col("det_id")],
    "left_to_right": lambda: [centre(box())[0], centre(box())[1], F.col("det_id")],
    "top_to_bottom": lambda: [centre(box())[1], centre(box())[0], F.col("det_id")],
    "original": lambda: [F.col("det_id")],
}


def numbered(df: DataFrame, keys: list[str], order: str | list[Column], name: str = "marker_id", start: int = 1) -> DataFrame:
    """Dense numbers of each group in a named order (score, spatial, left_to_right, ...)."""
    by = ORDERS[order]() if isinstance(order, str) else order
    return df.withColumn(name, (F.row_number().over(W.partitionBy(*keys).orderBy(*by)) + (start - 1)).cast("long"))


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def capped(df: DataFrame, image: str, cls: str, per_class: int, per_image: int) -> DataFrame:
    """Best of each class of an image, then best of the image."""
    order = ORDERS["score"]()
    return first_n(first_n(df, [image, cls], order, per_class), [image], order, per_image)


def adjacent_gap(df: DataFrame, keys: list[str], value: Column, scale: float = 800.0) -> DataFrame:
    """Smallest gap of neighbours in order, over ``scale``; 0 for groups of one."""
    w = W.partitionBy(*keys).orderBy("__v", "det_id")
    gaps = df.withColumn("__v", value).withColumn("__g", F.col("__v") - F.lag("__v").over(w))
    return gaps.groupBy(*keys).agg(F.coalesce(F.min("__g") / scale, F.lit(0.0)).alias("min_gap"))


def extremes(df: DataFrame, keys: list[str], order: str, full_up_to: int = 3) -> DataFrame:
    """Rank positions worth asking for: all of small groups, else the first and the last."""
    n = F.count("*").over(W.partitionBy(*keys))
    ranked = numbered(df, keys, order, "rank").withColumn("n", n)
    return ranked.where((F.col("n") <= full_up_to) | (F.col("rank") == 1) | (F.col("rank") == F.col("n")))


def size_extremes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Largest and smallest of each group by area (first in order on ties) and their relative difference."""
    a = area(box()).cast("double")
    out = df.withColumn("__a", a).groupBy(*keys).agg(F.max(F.struct("__a", (-F.col("det_id")).alias("n"))).alias("hi"), F.min(F.struct("__a", F.col("det_id").alias("n"))).alias("lo"), F.count("*").alias("n"))
    return out.select(*keys, (-F.col("hi.n")).alias("largest"), F.col("lo.n").alias("smallest"), F.when(F.col("hi.__a") > 0, (F.col("hi.__a") - F.col("lo.__a")) / F.col("hi.__a")).otherwise(0.0).alias("difference"), "n")


def page(df: DataFrame, order: list[Column], skip: int, limit: int | None) -> DataFrame:
    """Skip and limit of an ordered table (limit None or below 1: all the rest)."""
    rows = df.orderBy(*order).offset(skip)
    return rows if not limit or limit < 1 else rows.limit(limit)


def split_by_hash(df: DataFrame, keys: list[str], percent: float, fold: int = 0) -> DataFrame:
    """labelled: whether a row falls in the fold's share, by the hash of its keys. No shuffle, any size."""
    h = F.conv(F.substring(F.md5(F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.lit(str(fold))).cast("binary")), 1, 8), 16, 10).cast("long") % 10_000
    return df.withColumn("labelled", h < int(percent * 100))


def sharded(df: DataFrame, index: str, n: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.col(index), F.lit(n)).cast("int"))


def halves(df: DataFrame, video: str = "video", frame: str = "frame") -> DataFrame:
    """first_half of each row: frames numbered from 0, the first n div 2 + 1 belong to it."""
    w = W.partitionBy(video)
    r = F.dense_rank().over(w.orderBy(frame)) - 1
    out = df.withColumn("__i", r)
    return out.withColumn("first_half", F.col("__i") < F.floor((F.max("__i").over(w) + 1) / 2) + 1).drop("__i")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order."""
    return first_n(df, keys, order, 1)


def without(df: DataFrame, *others: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in none of the others: one anti join against their union."""
    gone = others[0].select(on)
    for o in others[1:]:
        gone = gone.unionByName(o.select(on))
    return df.join(gone.distinct(), on, "left_anti")


def unambiguous(df: DataFrame, image: str, description: str, sample: str) -> DataFrame:
    """Without (image, description) groups that name more than one sample; empty descriptions stay."""
    w = W.partitionBy(image, description)
    spread = F.min(sample).over(w) != F.max(sample).over(w)
    return df.withColumn("__s", spread).where(~F.col("__s") | (F.coalesce(F.col(description), F.lit("")) == "")).drop("__s")


def coverage(splits: DataFrame, expected: DataFrame, split: str = "split", index: str = "sample_index") -> DataFrame:
    """n_overlap (indices in more than one split), n_missing and n_extra against the expected ones."""
    per = splits.groupBy(index).agg(F.countDistinct(split).alias("k"))
    both = per.withColumn("have", F.lit(1)).join(expected.select(index).distinct().withColumn("want", F.lit(1)), index, "full")
    return both.agg(F.count_if(F.col("k") > 1).alias("n_overlap"), F.count_if(F.col("have").isNull()).alias("n_missing"), F.count_if(F.col("want").isNull()).alias("n_extra"))
