"""Detections, ground truth and other abstractions projected from the driver's tables.

One integer projection is stated twice, as DataFrames and as SQL, and nothing else is shared
between a query and its oracle.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from opalgrid.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its SQL, if SQL can express it."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = functools.wraps(f)(run)
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, det_id, cls, score, x1, y1, x2, y2."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    image = F.expr("l_orderkey div 4")
    order = W.partitionBy("image_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x1 = (F.col("l_partkey") % 4) * 60 + F.col("l_suppkey") % 9
    y1 = (F.col("l_suppkey") % 4) * 60 + F.col("l_partkey") % 9
    rows = l.withColumn("image_id", image).withColumn("det_id", F.row_number().over(order).cast("long"))
    rows = rows.select("image_id", "det_id", F.col("l_returnflag").alias("cls"), (((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11 + F.col("l_linenumber") * 101) % 1000) / 1000.0).alias("score"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), (x1 + 40 + F.col("l_quantity").cast("int") % 30).cast("double").alias("x2"), (y1 + 40 + F.col("l_linenumber") * 4).cast("double").alias("y2"))
    return rows


def gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, gt_id, cls, x1, y1, x2, y2: a jittered third of the detections, 1 in 7 moved away."""
    d = det(spark, sf_dir).where("det_id % 3 = 1")
    off = F.when((F.col("image_id") + F.col("det_id")) % 7 == 0, 300).otherwise(0)
    i = F.col("det_id")
    return d.select("image_id", i.alias("gt_id"), "cls", (F.col("x1") + i % 5 - 2 + off).alias("x1"), (F.col("y1") + i % 7 - 3).alias("y1"), (F.col("x2") + i % 3 + off).alias("x2"), (F.col("y2") - i % 4).alias("y2"))


DET = """det AS MATERIALIZED (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS det_id, cls, score, CAST(a AS DOUBLE) AS x1, CAST(b AS DOUBLE) AS y1, CAST(a + 40 + q % 30 AS DOUBLE) AS x2, CAST(b + 40 + l_linenumber * 4 AS DOUBLE) AS y2
FROM (SELECT *, l_orderkey // 4 AS image_id, l_returnflag AS cls, ((l_partkey * 37 + l_suppkey * 11 + l_linenumber * 101) % 1000) / 1000.0 AS score, (l_partkey % 4) * 60 + l_suppkey % 9 AS a, (l_suppkey % 4) * 60 + l_partkey % 9 AS b, CAST(floor(l_quantity) AS INT) AS q FROM lineitem))"""
GT = """gt AS MATERIALIZED (SELECT image_id, det_id AS gt_id, cls, x1 + det_id % 5 - 2 + off AS x1, y1 + det_id % 7 - 3 AS y1, x2 + det_id % 3 + off AS x2, y2 - det_id % 4 AS y2 FROM (SELECT *, CASE WHEN (image_id + det_id) % 7 = 0 THEN 300 ELSE 0 END AS off FROM det WHERE det_id % 3 = 1))"""
BOTH = f"{DET},\n{GT}"


def inter_sql(a: str, b: str, plus: int = 0) -> str:
    p = f" + {plus}" if plus else ""
    return f"(greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1){p}, 0) * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1){p}, 0))"


def area_sql(a: str, plus: int = 0) -> str:
    p = f" + {plus}" if plus else ""
    return f"(greatest({a}x2 - {a}x1{p}, 0) * greatest({a}y2 - {a}y1{p}, 0))"


def union_sql(a: str, b: str, plus: int = 0) -> str:
    return f"({area_sql(a, plus)} + {area_sql(b, plus)} - {inter_sql(a, b, plus)})"


def iou_sql(a: str, b: str, plus: int = 0) -> str:
    return f"coalesce({inter_sql(a, b, plus)} / nullif({union_sql(a, b, plus)}, 0), 0)"


#: Pairs of one image and class, as a named subquery ``pairs``.
PAIRS = f"pairs AS (SELECT d.image_id, d.cls, g.gt_id, d.det_id, d.score, {iou_sql('d.', 'g.')} AS iou FROM det d JOIN gt g ON d.image_id = g.image_id AND d.cls = g.cls)"
