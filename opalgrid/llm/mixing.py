"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source has the same expected number of copies, target / source size. The
whole part is taken as it is; the fractional parts are rounded dependently: two fractions
meet, mass (in words) moves at random from one to the other until one of them is 0 or 1, and
the other goes on with what is left. This happens inside hashed leaves of about ``leaf_rows``
rows of one source, the largest document first against the pool of all smaller ones; a leaf
leaves at most one undecided document, a small one, and those meet again up a tree of fan-in
``fan_in``. Every document keeps its expected number of copies and each source its words, to
within the last document. Random numbers are hashes of identifier, content, seed and level:
reruns agree on any cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from opalgrid.llm.common import empty_heaps, spread, stash, tune

WORD = r"[^\x20\x09-\x0D]+"


def fill_targets(sizes: list[tuple[str | None, int]], weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Targets by source: shares by weight (sources by code point, null last, weights repeating),
    stopping at ``most`` times a source's size; the excess goes to the others by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, free, out = share * sum(size.values()), set(size), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * size[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: most * size[s] for s in over}
        left -= sum(out[s] for s in over)
        free -= over
    return out


def _meet(p: float, a: float, q: float, b: float, u: float) -> tuple[float, float]:
    """Two fractions of a and b words: mass moves one way or the other, with probabilities that
    keep both expected values, until one fraction is 0 or 1. p * a + q * b stays the same."""
    to_b, to_a = min(p * a, (1 - q) * b), min(q * b, (1 - p) * a)
    if u * (to_a + to_b) < to_a:
        return p - to_b / a, q + to_b / b
    return p + to_a / a, q - to_a / b


def _snap(p: float) -> float:
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def round_node(sizes: list[int], p: list[float], draws: list[float]) -> list[float]:
    """Rounds all fractions of a node but at most one. ``sizes`` fall. While the fractions are
    equal, each document meets the pool of all smaller ones, which share what it leaves; so the
    one left over is small. Unequal fractions (of documents left over below) meet in pairs."""
    out, n = [_snap(x) for x in p], len(p)
    if n and max(out) - min(out) < 1e-12 and 0 < out[0] < 1:
        rest, r = float(sum(sizes)), out[0]
        for i in range(n - 1):
            rest -= sizes[i]
            x, r = _meet(r, sizes[i], r, rest, draws[i])
            out[i], r = _snap(x), _snap(r)
            if r in (0.0, 1.0):
                out[i + 1 :] = [r] * (n - 1 - i)
                return out
        out[n - 1] = r
        return out
    held = None
    for i in range(n):
        if out[i] in (0.0, 1.0):
            continue
        if held is not None:
            x, y = _meet(out[held], sizes[held], out[i], sizes[i], draws[i])
            out[held], out[i] = _snap(x), _snap(y)
        held = i if 0 < out[i] < 1 else held if held is not None and 0 < out[held] < 1 else None
    return out


def _pivot(seed: int, level: int):
    """Rows sorted by node, then falling size; a node's rows are bounded by leaf size and fan-in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, rows, schema = None, [], None

        def close() -> pa.RecordBatch:
            i = {n: k for k, n in enumerate(schema.names)}
            draws = [xxhash.xxh3_64_intdigest(f"{r[i['doc_id']]}/{r[i['row_key']]}/{seed}/{level}") / 2**64 for r in rows]
            p = round_node([r[i["size"]] for r in rows], [r[i["p"]] for r in rows], draws)
            columns = list(zip(*rows, strict=True))
            columns[i["p"]] = p
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            schema = batch.schema
            s, n = schema.names.index("src"), schema.names.index("node")
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row[s], row[n]) != node:
                    if rows:
                        yield close()
                    node, rows = (row[s], row[n]), []
                rows.append(row)
        if rows:
            yield close()

    return run


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, leaf_rows: int = 4096, fan_in: int = 32, seed: int = 7) -> DataFrame:
    """doc_id, row_key, size, source_size, target, copies, taken for every row of ``docs``.

    ``row_key`` is a hash of the columns of documents and tells rows of one identifier apart.
    A null text has size 0, a null source is a source of its own (last). Documents of size 0
    take no words. Rows that repeat are rounded each for itself, and many of them in many leaves. An empty table gives an empty
    result. Sources are a dimension: one aggregated row for each goes to the driver.
    """
    tune(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), F.xxhash64(F.col("text"), F.col("source"), F.col("lang")).alias("row_key"), size.alias("size")))
    empty_heaps(docs.sparkSession)
    # rows that are equal in all would share a leaf, however many there are
    rows = spread(rows, ["doc_id", "row_key"], max(1, leaf_rows // 16))
    spark = docs.sparkSession
    sums = [(r.source, r.n) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    target = fill_targets(sums, weights, share, most)
    order = sorted(sums, key=lambda x: (x[0] is None, x[0] or ""))
    # from Arrow: a list of rows would start Python workers of their own beside those of the stages
    fields = {"source": ([s for s, _ in order], pa.string()), "src": (range(len(order)), pa.int32()), "source_size": ([n for _, n in order], pa.int64()), "target": ([float(target[s]) for s, _ in order], pa.float64())}
    table = spark.createDataFrame(pa.table({k: pa.array(v, t) for k, (v, t) in fields.items()}))
    table = F.broadcast(table) if len(order) <= 10_000 else table
    rows = rows.withColumnRenamed("source", "__s").join(table, F.col("__s").eqNullSafe(F.col("source")), "left").drop("__s", "source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumns({"whole": F.floor(rate + 1e-12).cast("long"), "p": F.when(F.col("size") > 0, rate - F.floor(rate + 1e-12)).otherwise(F.lit(0.0))}).withColumn("p", F.when(F.col("p") < 1e-12, F.lit(0.0)).otherwise(F.col("p")))
    # rows with nothing to round take no part; the others are dealt to leaves by hash
    open_rows = stash(rows.where("p > 0").groupBy("src").agg(F.count("*").alias("n")).select(F.col("src").alias("__src"), F.ceil(F.col("n") / leaf_rows).cast("long").alias("parts")))
    nodes = open_rows.agg(F.max("parts")).first()[0] or 1
    rows = rows.join(open_rows, F.col("src") == F.col("__src"), "left")
    node = F.pmod(F.xxhash64("doc_id", "row_key", "__salt", F.lit(seed)), F.coalesce("parts", F.lit(1)))
    columns = ["doc_id", "row_key", "size", "src", "source_size", "target", "whole", "node", "p"]
    rows = rows.withColumn("node", node).select(columns)
    sure = (F.col("p") == 0) | (F.col("p") == 1)
    done, level = [rows.where(sure)], 0
    rows = rows.where(~sure)
    while True:
        step = rows.repartition("src", "node").sortWithinPartitions("src", "node", F.desc("size"), "doc_id", "row_key").mapInArrow(_pivot(seed, level), rows.schema)
        step = stash(step)
        if nodes <= 1:
            u = F.pmod(F.xxhash64("doc_id", "row_key", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
            done.append(step.withColumn("p", F.when(sure, F.col("p")).otherwise((u < F.col("p")).cast("double"))))
            break
        done.append(step.where(sure))
        rows = step.where(~sure).withColumn("node", F.floor(F.col("node") / fan_in).cast("long")).select(columns)
        nodes, level = -(-nodes // fan_in), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.col("p").cast("long")
    return out.select("doc_id", "row_key", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
