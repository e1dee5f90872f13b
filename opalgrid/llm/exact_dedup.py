"""Exact dedup by Patricia-trie owners.

Map tasks collapse equal texts they hold, so a group of copies crosses the network once per
map flush, however large it is. Length-and-content-hash partitions own the texts: sorted by
that key they enter a compressed radix trie over the full byte strings, whose terminal nodes
hold the identifier that stays and the number of rows. When the subtrees of finished keys
exceed ``trie_bytes`` they are written out as results and dropped; Spark's sort does the rest
of the spilling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opalgrid.llm.common import column_bytes, column_of, trimmed, tune

FLUSH_BYTES = 16 << 20
_LOCAL = pa.schema([("n_bytes", pa.int64()), ("digest", pa.binary()), ("body", pa.binary()), ("best", pa.int64()), ("rows", pa.int64())])
_OWNED = pa.schema([("n_bytes", pa.int64()), ("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


class Node:
    __slots__ = ("best", "children", "label", "rows")

    def __init__(self, label: bytes):
        self.label, self.children, self.rows, self.best = label, {}, 0, None


class PatriciaTrie:
    """Compressed radix trie of byte strings; a terminal node has ``rows`` > 0."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.bytes = 0

    def insert(self, key: bytes, rows: int, best: int | None, better) -> Node:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = Node(key[at:])
                self.bytes += len(child.label) + 200
                node.children[key[at]] = child
                node, at = child, len(key)
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            low, high = 1, min(len(label), len(key) - at)  # the first byte agrees
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if key.startswith(label[:middle], at) else (low, middle - 1)
            fork = Node(label[:low])
            child.label = label[low:]
            fork.children[child.label[0]] = child
            node.children[key[at]] = fork
            self.bytes += 200
            node, at = fork, at + low
        node.rows += rows
        node.best = best if node.best is None else node.best if best is None else better(node.best, best)
        return node


def _collapse(better, text_col: str, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(len(t), hashlib.sha256(t).digest(), t, b, n) for t, (b, n) in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _LOCAL, strict=True)], schema=_LOCAL)

        for batch in batches:
            for t, i in zip(column_bytes(column_of(batch, text_col)), column_of(batch, id_col).to_pylist(), strict=True):
                if (own := held.get(t)) is None:
                    held[t] = [i, 1]
                    size += len(t) + 200
                    if size > FLUSH_BYTES:
                        yield flush()
                        held, size = {}, 0
                else:
                    own[0] = i if own[0] is None else own[0] if i is None else better(own[0], i)
                    own[1] += 1
        if held:
            yield flush()

    return run


def _own(better, trie_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, ends, last = PatriciaTrie(), {}, None

        def spill() -> pa.RecordBatch:
            rows = [(*k, n.best, n.rows) for k, n in ends.items()]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _OWNED, strict=True)], schema=_OWNED)

        for batch in batches:
            for n, digest, body, best, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (n, digest)
                if key != last and trie.bytes > trie_bytes:
                    yield spill()
                    trie, ends = PatriciaTrie(), {}
                last = key
                node = trie.insert(body, rows, best, better)
                if ends.setdefault(key, node) is not node:
                    raise ValueError("two different texts share length and SHA-256")
        if ends:
            yield spill()

    return run


def owned_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", trie_bytes: int = 32 << 20) -> DataFrame:
    """One row per distinct text: n_bytes, digest (SHA-256), keep_id, group_size."""
    better = min if keep == "smallest" else max
    tune(docs.sparkSession)
    local = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).mapInArrow(trimmed(_collapse(better, "body", "id")), "n_bytes long, digest binary, body binary, best long, rows long")
    return local.repartition("n_bytes", "digest").sortWithinPartitions("n_bytes", "digest").mapInArrow(trimmed(_own(better, trie_bytes)), "n_bytes long, digest binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 added (columns of these names are replaced).

    A null text equals an empty one. Of rows that repeat text and identifier exactly one is
    not singled out: all carry kept = true. A null identifier never stays when another row of
    its text has one; a group of null identifiers alone has keep_id null and stays. An empty
    table gives an empty result. Other columns pass through.
    """
    base = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    own = F.struct(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n"), digest.alias("digest"))
    base = base.withColumn("__exact_dedup", own)
    groups = owned_texts(docs, id_col, text_col, keep).where("group_size > 1").select(F.struct("n_bytes", F.lower(F.hex("digest")).alias("digest"), "keep_id", "group_size").alias("__exact_dedup_group"))
    mine, group = F.col("__exact_dedup"), F.col("__exact_dedup_group")
    out = base.join(groups, (mine["digest"] == group["digest"]) & (mine["n"] == group["n_bytes"]), "left")
    id_ = F.col(id_col).cast("long")
    keep_id = F.when(group.isNull(), id_).otherwise(group["keep_id"])
    out = out.withColumns({"keep_id": keep_id, "group_size": F.coalesce(group["group_size"], F.lit(1).cast("long")), "kept": id_.eqNullSafe(keep_id), "text_sha256": mine["digest"]})
    return out.drop("__exact_dedup", "__exact_dedup_group")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Only the rows that stay, with the columns of ``docs``; full repeats of a row stay once. Nulls, empty
    texts and ties as in exact_dedup; an empty table gives an empty result."""
    out = exact_dedup(docs, id_col, text_col, keep).where("kept")
    single = out.where("group_size = 1").select(docs.columns)
    return single.unionByName(out.where("group_size > 1").dropDuplicates([id_col, "text_sha256"]).select(docs.columns))
