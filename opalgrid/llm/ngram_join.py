"""N-gram Jaccard join: a grouped prefix join over sets of word shingles, and its components.

Documents of equal sets are one row from the start. Shingles have one global order, by
document frequency (exact, over all sets) and hash. Two sets of sizes n and m and similarity t
share at least a = ceil(t (n + m) / (1 + t)) elements, so the first element they share stands
among the first n - a + 1 of the one and m - a + 1 of the other: only elements of these
prefixes meet, each with its place. Elements of frequency 1 link nothing, so a set whose
prefix they fill is done.

To count no more than needed, a first pass orders and counts only a fixed band of the hash
range (elements inside it come first; that is a global order too). Sets it leaves open, about
those with a near copy or of shared passages, are counted in full among themselves. Sets of
equal prefix and size form one group; groups meet over elements and are expanded to members.

Of sets that meet over an element each is first held against one pivot (linear in the list);
full sets decide. Members of one component need no further look; then pairs of different
components that an element still joins are verified, so no link between components is lost
while a cluster of n near copies costs about n checks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from opalgrid.llm.common import WordHashes, column_bytes, column_of, empty_heaps, mixed, release, stash, trimmed, tune, window_hashes
from opalgrid.llm.components import components

#: Share of the hash range whose elements come first and are counted.
BAND = 0.25
_NULL_ID = -(1 << 63)  # stands for a null identifier


def shingle_set(text: bytes, hashes: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; the whole sequence if shorter."""
    h = hashes.of(text.lower().split())  # bytes.lower() folds A-Z only
    if not len(h):
        return h
    return np.unique(mixed(window_hashes(h, k) if len(h) >= k else window_hashes(h, len(h))))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def size_band(n: Column, percent: int) -> Column:
    """A number such that sets which may be similar differ in it by one at most."""
    return F.floor(F.ln(n.cast("double")) / float(np.log(100 / percent)) * (1 - 1e-9)).cast("int")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, n, digest (two longs) and the elements of band and prefix, by hash."""
    edge = np.uint64(int(BAND * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, d1, d2, parts = [], [], [], []
            for text in column_bytes(column_of(batch, "text")):
                s = shingle_set(text, hashes, k)
                n.append(len(s))
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                d1.append(digest[0])
                d2.append(digest[1])
                parts.append(s[: max(int(np.searchsorted(s, edge)), prefix_length(len(s), percent))] if len(s) else s)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            values = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([column_of(batch, "id"), column_of(batch, "text_key"), pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "text_key", "n", "d1", "d2", "band"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(run), "id long, text_key long, n int, d1 long, d2 long, band array<long>")


def _full_sets(texts: DataFrame, k: int) -> DataFrame:
    """id, n and items; the sets of an identifier that has ``several`` go by their digests instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            parts = [shingle_set(t, hashes, k).view(np.int64) for t in column_bytes(column_of(batch, "text"))]
            n = [len(p) for p in parts]
            rows = zip(column_of(batch, "id").to_pylist(), column_of(batch, "several").to_pylist(), parts, strict=True)
            ids = [int(np.frombuffer(xxhash.xxh3_128_digest(p.tobytes()), np.int64)[0]) if several else i for i, several, p in rows]
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))], names=["id", "n", "items"])

    return texts.mapInArrow(trimmed(run), "id long, n int, items array<long>")


def _open_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """id, n, first (elements of frequency 1 before), whole (none of those at all) and prefix (the
    others of the prefix, in order) of sets that have any. ``sets``: id, n, items: all elements, or
    those of the band and at least a prefix."""
    elements = sets.select("id", F.explode("items").alias("s"))
    shared = elements.groupBy("s").agg(F.count("*").alias("df")).where("df >= 2")
    listed = elements.join(shared, "s").groupBy("id").agg(F.collect_list(F.struct("df", "s")).alias("found"))
    meta = sets.select("id", "n", F.size("items").alias("e"))
    rows = listed.join(meta, "id").withColumn("first", F.col("e") - F.size("found"))
    rows = rows.withColumn("open", F.col("n") - F.ceil(F.col("n") * percent / 100.0).cast("int") + 1 - F.col("first")).where("open > 0")
    return rows.select("id", "n", "first", (F.col("first") == 0).alias("whole"), F.transform(F.slice(F.array_sort("found"), F.lit(1), F.col("open")), lambda x: x["s"]).alias("prefix"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = column_of(batch, "a"), column_of(batch, "b")
            keep = [similar(x.values.to_numpy(), y.values.to_numpy(), percent) for x, y in zip(column_of(batch, "sa"), column_of(batch, "sb"), strict=True)]
            if any(keep):
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    sb = sets.select(F.col("id").alias("b"), F.col("items").alias("sb"))
    sa = sets.select(F.col("id").alias("a"), F.col("items").alias("sa"))
    return pairs.join(sb, "b").join(sa, "a").select("a", "b", "sa", "sb").mapInArrow(trimmed(run), "a long, b long")


def _row_components(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, n, node (null for empty sets) and component (smallest identifier) per row; nulls
    are _NULL_ID. A set is a node: the smallest identifier of its rows, or its digest where that
    identifier has other sets as well."""
    spark = docs.sparkSession
    tune(spark)
    sets = stash(_sets(docs, k, percent, id_col, text_col))
    full = sets.where("n > 0")
    several = stash(full.groupBy("id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo <> hi").select(F.col("id").alias("rep"), F.lit(True).alias("several")))
    # copies: one row for each distinct set
    reps = full.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")).join(several, "rep", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    reps = stash(reps.withColumn("key", F.when(F.col("several"), F.col("d1")).otherwise(F.col("rep"))))
    keys = reps.select(F.col("rep").alias("id"), "d1", "d2", "key")
    own = stash(full.join(keys, ["id", "d1", "d2"]).dropDuplicates(["key"]).select(F.col("key").alias("id"), "n", "band"))
    release(spark)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    open_ids = stash(_open_prefixes(own.withColumnRenamed("band", "items"), percent).select("id"))
    release(spark, own)
    open_reps = reps.join(open_ids, F.col("key") == F.col("id"), "left_semi").select(F.col("rep").alias("id"), "several").distinct()
    whole_sets = stash(_full_sets(texts.join(open_reps, "id"), k).dropDuplicates(["id"]).join(open_ids, "id", "left_semi"))
    release(spark)
    prefixes = stash(_open_prefixes(whole_sets, percent))
    release(spark)
    # groups of equal prefix and size; a prefix with an element of frequency 1 is like no other
    key = F.when(F.col("whole"), F.xxhash64("prefix")).otherwise(F.col("id"))
    keyed = prefixes.withColumn("key", key)
    heads = keyed.groupBy("n", "whole", "key").agg(F.min("id").alias("gid"))
    grouped = stash(keyed.join(heads, ["n", "whole", "key"]).select("id", "gid", "n", "first", "prefix"))
    postings = stash(grouped.where("id = gid").select("gid", "n", "first", F.posexplode("prefix").alias("i", "s")).select("s", "gid", "n", (F.col("first") + F.col("i")).alias("pos")))
    empty_heaps(spark)

    def meet(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
        """Whether a pair of these sizes may have its first common element at these places."""
        least = F.ceil((n1 + n2) * percent / (100.0 + percent))
        return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (p1 <= n1 - least) & (p2 <= n2 - least)

    pivots = postings.groupBy("s").agg(F.min(F.struct("pos", "gid", "n")).alias("p"), F.count("*").alias("c")).where("c > 1").select("s", F.col("p.gid").alias("pg"), F.col("p.n").alias("pn"), F.col("p.pos").alias("pp"))
    stars = postings.join(pivots, "s").where((F.col("gid") != F.col("pg")) & meet(F.col("n"), F.col("pos"), F.col("pn"), F.col("pp"))).select(F.least("pg", "gid").alias("a"), F.greatest("pg", "gid").alias("b"))
    first = stash(stars.unionByName(grouped.where("id <> gid").select(F.col("gid").alias("a"), F.col("id").alias("b"))).distinct())
    empty_heaps(spark)
    known = stash(components(_verified(first, whole_sets, percent)))
    release(spark)
    # lists that still hold several components: the members outside the largest meet the others
    labelled = grouped.join(known, F.col("id") == F.col("node"), "left").select("id", "gid", F.coalesce("component", "id").alias("c"))
    lists = stash(postings.join(labelled, "gid").select("s", "id", "n", "pos", size_band(F.col("n"), percent).alias("band"), "c"))
    sizes = lists.groupBy("s", "c").agg(F.count("*").alias("m"))
    major = sizes.groupBy("s").agg(F.max_by("c", F.struct("m", "c")).alias("major"), F.count("*").alias("kinds")).where("kinds > 1").select("s", "major")
    left = stash(lists.join(major, "s"))
    empty_heaps(spark)
    # members meet those of their own and the next size bands only, each band of an element for itself
    minor = left.where("c <> major").select("s", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"), F.col("id").alias("i1"), F.col("n").alias("n1"), F.col("pos").alias("p1"), F.col("c").alias("c1"))
    meets = minor.join(left, ["s", "band"]).where((F.col("c1") != F.col("c")) & meet(F.col("n1"), F.col("p1"), F.col("n"), F.col("pos")) & ((F.col("c") == F.col("major")) | (F.col("i1") < F.col("id"))))
    pairs = meets.select(F.least("i1", "id").alias("a"), F.greatest("i1", "id").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = _verified(pairs, whole_sets, percent)
    final = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    placed = reps.join(final, F.col("key") == F.col("node"), "left").select("d1", "d2", "rep", "several", F.coalesce("component", "key").alias("c"))
    # the smallest node is the smallest identifier, but where a node is a digest
    digests = stash(placed.where("several").select("c").distinct())
    smallest = stash(placed.join(digests, "c", "left_semi").groupBy("c").agg(F.min("rep").alias("least")))
    of_rep = placed.join(smallest, "c", "left").select("d1", "d2", F.coalesce("least", "c").alias("component"), F.col("c").alias("node"))
    out = sets.select("id", "text_key", "n", "d1", "d2").join(of_rep, ["d1", "d2"], "left")
    return out.select("id", "text_key", "n", "node", F.coalesce("component", "id").alias("component"))


def _back(column: str) -> Column:
    return F.when(F.col(column) != _NULL_ID, F.col(column))


def similarity_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest identifier reachable by links) per row.

    Two rows link when 100 * |A & B| >= percent * |A | B| over their shingle sets (A-Z folded).
    Texts without words, empty or null have empty sets, link with nothing and are their own
    component. Rows that repeat fall together; rows of one identifier, or of none, with different
    texts each have their own links. A null identifier sorts before all others and comes back as
    null. An empty table gives an empty result.
    """
    out = _row_components(docs, k, percent, id_col, text_col)
    return out.select(_back("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), _back("component").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """The row of the smallest identifier of each component, with the columns of ``docs``. Of several
    texts of that identifier in one component the one of the smallest hash stays; texts without
    words all stay, and so do full repeats of a row that stays. Null identifiers sort before all
    others; other columns pass through; an empty table gives an empty result."""
    out = _row_components(docs, k, percent, "doc_id", "text").where("id = component")
    linked = out.where("node is not null").groupBy("node", "id").agg(F.min("text_key").alias("text_key")).select("id", "text_key")
    kept = linked.unionByName(out.where("node is null").select("id", "text_key")).distinct().select(_back("id").alias("__id"), F.col("text_key").alias("__key"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left_semi")
