"""Small solvers over many groups: one Arrow stream per partition, not one call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from opalgrid.session import ship

Columns = dict[str, np.ndarray]

#: Rows that one call of a solver of many groups gets, unless a single group has more.
BLOCK = 100_000


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first row does."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def codes(*columns: np.ndarray) -> np.ndarray:
    """Dense numbers of equal rows, in the order of the columns."""
    order = np.lexsort(columns[::-1])
    out = np.empty(len(order), int)
    out[order] = np.cumsum(changes(*[c[order] for c in columns])) - 1
    return out


def meetings(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of equal numbers, by position of the left; ``right`` is sorted."""
    first = np.searchsorted(right, left, "left")
    n = np.searchsorted(right, left, "right") - first
    i = np.repeat(np.arange(len(left)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n - first, n)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Equal keys have equal numbers; null is a key like any other."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False)


def _values(column: pa.ChunkedArray) -> np.ndarray:
    """Arrays of one length come as rows of a matrix."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], column.type.value_type)
        return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy()


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    values = np.asarray(values)
    return pa.array(values.tolist(), kind) if values.dtype.kind in "OSU" else pa.array(values).cast(kind)


def per_groups(rows: DataFrame, keys: list[str], columns: list[str], solve: Callable[[np.ndarray, Columns], tuple[np.ndarray, Columns]], schema: str, order: list[str] | None = None) -> DataFrame:
    """``solve`` gets the ``columns`` of many whole groups at once, and before them the number of each row's
    group (from 0, rising); it gives the group numbers of its rows and their columns, to which the keys are
    added in front. ``schema`` is that of the whole output, keys first.

    Rows are dealt and sorted by the keys, then by ``order`` (all columns, if not given). The number of
    parts is stated: few bytes may hold much work, and adaptive plans would put them in one task. A group is
    held whole: it must be bounded, as the candidates of one image are. Null keys are groups like any other.
    """
    spark = rows.sparkSession
    ship(spark)
    names = [f.split()[0] for f in schema.split(", ")]
    types = to_arrow_schema(spark.createDataFrame([], schema).schema).types
    block = BLOCK

    def close(table: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        at, got = solve(np.cumsum(new) - 1, {c: _values(table.column(c)) for c in columns})
        first = pa.array(np.flatnonzero(new)[at])
        out = [table.column(k).take(first).combine_chunks().cast(t) for k, t in zip(keys, types, strict=False)]
        out = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out]
        out += [_column(got[n], t) for n, t in zip(names[len(keys) :], types[len(keys) :], strict=True)]
        return pa.RecordBatch.from_arrays(out, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, enough = 0, block
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < enough:
                continue
            table = pa.Table.from_batches(held)
            new = changes(*[_numbers(table.column(k)) for k in keys])
            cut = int(np.flatnonzero(new)[-1])
            if cut:
                yield close(table.slice(0, cut), new[:cut])
                held, n = table.slice(cut).to_batches(), n - cut
            enough = max(block, 2 * n)  # a long group is not looked at again for each batch
        if n:
            table = pa.Table.from_batches(held)
            yield close(table, changes(*[_numbers(table.column(k)) for k in keys]))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    dealt = rows.select(*keys, *columns).repartition(parts, *keys).sortWithinPartitions(*keys, *(columns if order is None else order))
    return dealt.mapInArrow(run, schema)


def per_group(rows: DataFrame, keys: list[str], columns: list[str], solve: Callable[[Columns], Columns], schema: str) -> DataFrame:
    """As ``per_groups``, for a ``solve`` of one group that gives columns of equal length."""
    names = [f.split()[0] for f in schema.split(", ")][len(keys) :]

    def each(group: np.ndarray, c: Columns) -> tuple[np.ndarray, Columns]:
        ends = np.append(np.flatnonzero(changes(group)), len(group))
        got = [solve({n: v[a:b] for n, v in c.items()}) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        at = np.repeat(np.arange(len(got)), [len(next(iter(x.values()))) for x in got])
        return at, {n: np.concatenate([np.asarray(x[n]) for x in got]) for n in names}

    return per_groups(rows, keys, columns, each, schema)
