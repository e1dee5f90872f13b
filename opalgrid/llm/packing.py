"""Packing by first-fit decreasing with a tournament tree, in randomised groups.

Documents are cut into full sequences and a rest. The rests are dealt by hash into groups of
about ``group_pieces``; each group packs on its own: pieces in falling order of length go to
the first open bin that has room, found by descending a tournament tree whose inner nodes hold
the largest room below them. A group is bounded, so a task's memory is too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opalgrid.llm.common import column_of, spread, stash, trimmed, tune
from opalgrid.llm.tokens import encoder

END_ID = 1


class Tournament:
    """Rooms of bins; ``first(n)`` is the leftmost bin with room for n."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def first(self, need: int) -> int:
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < need:
                at += 1
        return at - self.leaves

    def take(self, at: int, n: int) -> None:
        room = self.room
        at += self.leaves
        room[at] -= n
        at //= 2
        while at:
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
            at //= 2


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """bin and offset of each piece; ties keep their order."""
    order = np.argsort(-lengths, kind="stable")
    tree = Tournament(max(1, len(lengths)), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        n = int(lengths[i])
        at = tree.first(n)
        bins[i], offsets[i] = at, capacity - tree.room[at + tree.leaves]
        tree.take(at, n)
    return bins, offsets


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece (and its ids, little-endian)."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        try:
            for batch in batches:
                out: list[tuple] = []
                for doc, text in zip(column_of(batch, "doc_id").to_pylist(), column_of(batch, "text").to_pylist(), strict=True):
                    ids = np.append(own.encode(text or ""), np.uint32(END_ID)).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        raw = ids[start : start + capacity].tobytes()
                        out.append((doc, start, len(raw) // 4, zlib.crc32(raw), len(ids), *([raw] if with_ids else [])))
                if out:
                    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names=names)
        finally:
            own.forget()

    extra = ", ids binary" if with_ids else ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(trimmed(run), f"doc_id long, start long, length long, ids_crc32 long, doc_tokens long{extra}")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, group_pieces: int = 16_384, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset.

    A null or empty text is one piece: the closing id. Rows that repeat are packed each for
    itself, and many of them go to many groups; a null identifier is packed like any other. An empty table gives an empty result.
    Only the lengths travel; with ``with_ids`` the ids do too.
    """
    cut = stash(pieces(docs, tokenizer_path, capacity, with_ids))
    groups = max(1, -(-cut.count() // group_pieces))
    # rows of one identifier part by their crc; rows that are equal in all, by their places
    dealt = spread(cut, ["doc_id", "start", "ids_crc32"], max(1, group_pieces // 16))
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "__salt"), F.lit(groups))).drop("__salt")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, part["offset"] = first_fit_decreasing(part["length"].to_numpy(), capacity)
        part["sequence_id"] = part["group"].to_numpy() * (1 << 32) + bins
        return part.drop(columns="group")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", `offset` long, sequence_id long"
    return dealt.groupBy("group").applyInPandas(run, schema)
