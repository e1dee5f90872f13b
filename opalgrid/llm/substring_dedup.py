"""Substring dedup: spans of ``window`` words and more that start earlier in the corpus go.

Suffix automata of reference shards give matching statistics. The reference of a corpus is the
corpus, which has no size bound, so its shards are not broadcast: they are cut along anchors
and meet the spans they can match by shuffle. Each window of ``window`` words has an anchor,
the word ``gram`` of least hash inside it; windows of equal words have equal anchors at equal
offsets. Neighbouring windows of one anchor make a context (at most 2 * window - gram words).
Only anchors seen twice go on. Contexts equal in full collapse to their first occurrence; the
distinct contexts of an anchor stream, in order of document and position, through the suffix
automaton of those before them, and a window whose matching statistic reaches ``window``
starts earlier. Then the context itself enters the automaton.

A shard is bounded: the windows of an anchor with more than ``shard`` distinct contexts are
dealt anew, by anchors of twice the length and a word, and pass through the same steps. The
windows of a long anchor that is still too common get the longest one there is, the window
itself, whose one distinct context is the window: its first occurrence stays. A reference of
bounded size (a benchmark, a licence list) is broadcast as automata: ``remove_reference``.

A row is an identifier and the hash of its text, so rows of one identifier, or of none, with
different texts are documents of their own, in the order of that hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opalgrid.llm.common import WordHashes, column_bytes, column_of, empty_heaps, mixed, release, stash, trimmed, tune, window_hashes

GRAM = 6
_NULL_ID = -(1 << 63)
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


class SuffixAutomaton:
    """Of several sequences; transitions by word hash."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def insert(self, words: list[int]) -> None:
        last = 0
        for c in words:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
                continue
            new, p = len(self.next), last
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
            last = new

    def matching(self, words: list[int]) -> list[int]:
        """Length of the longest match that ends at each word."""
        state, n, out = 0, 0, []
        for c in words:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            to = self.next[state].get(c)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            out.append(n)
        return out


class Runs(NamedTuple):
    """Contexts of a text: first window, number of windows, anchor and content keys."""

    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def runs_of(h: np.ndarray, window: int, gram: int = GRAM) -> Runs:
    """The contexts of a text of word hashes ``h``."""
    n = len(h) - window + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return Runs(empty, empty, empty, empty)
    g = mixed(window_hashes(h, gram))
    width = window - gram + 1
    at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(g, width).argmin(axis=1)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    count = np.diff(np.append(first, n))
    # content: polynomial hash of the words first .. first + count + window - 2, and the anchor's place
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h + np.uint64(1)) * _powers(len(h), _P))])
    stop = first + count + window - 1
    content = mixed((sums[stop] - sums[first]) * _powers(len(h) + 1, _INVERSE)[first] + mixed(count.astype(np.uint64) * np.uint64(64) + (at[first] - first).astype(np.uint64)))
    return Runs(first, count, g[at[first]].view(np.int64), content.view(np.int64))


ROW = ["id", "key", "start"]
_POSTINGS = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("count", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64())])
_SPANS = pa.schema([*_POSTINGS, ("words", pa.binary()), ("deep", pa.bool_())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _occurrences(texts: DataFrame, window: int) -> DataFrame:
    """The contexts of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found, sizes = [], []
            for text in column_bytes(column_of(batch, "text")):
                found.append(runs_of(hashes.of(text.split()), window))
                sizes.append(len(found[-1].start))
            if sum(sizes):
                rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                start, count, anchor, content = (np.concatenate([f[k] for f in found if len(f[k])]) for k in range(4))
                yield pa.RecordBatch.from_arrays([column_of(batch, "id").take(rows), column_of(batch, "key").take(rows), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor), pa.array(content)], schema=_POSTINGS)

    return texts.mapInArrow(trimmed(run), _ddl(_POSTINGS))


def _spans(wanted: DataFrame, window: int) -> DataFrame:
    """The wanted contexts with their words; those of a ``wide`` anchor cut anew by long anchors (``deep``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            out: list[tuple] = []
            columns = (column_of(batch, c).to_pylist() for c in ("id", "key", "starts", "wide"))
            for i, k, starts, wide, text in zip(*columns, column_bytes(column_of(batch, "text")), strict=True):
                if (i, k) in seen:
                    continue  # a row that repeats
                if len(seen) > 100_000:
                    seen.clear()
                seen.add((i, k))
                h = hashes.of(text.split())
                r = runs_of(h, window)
                for at, is_wide in zip(np.searchsorted(r.start, starts).tolist(), wide, strict=True):
                    s, n = int(r.start[at]), int(r.count[at])
                    own = h[s : s + n + window - 1]
                    if not is_wide:
                        out.append((i, k, s, n, int(r.anchor[at]), int(r.content[at]), own.tobytes(), False))
                        continue
                    for s2, n2, a2, c2 in zip(*(x.tolist() for x in runs_of(own, window, long_gram(window))), strict=True):
                        out.append((i, k, s + s2, n2, a2, c2, own[s2 : s2 + n2 + window - 1].tobytes(), True))
            if out:
                yield _batch(_SPANS, out)

    return wanted.mapInArrow(trimmed(run), _ddl(_SPANS))


def long_gram(window: int) -> int:
    return min(2 * GRAM + 1, window)


def _windows(spans: DataFrame, window: int) -> DataFrame:
    """The single windows of contexts: each is its own anchor and its own content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, k, s, a, words in zip(*(column_of(batch, c).to_pylist() for c in ("id", "key", "start", "anchor", "words")), strict=True):
                keys = mixed(window_hashes(np.frombuffer(words, np.uint64), window)).view(np.int64).tolist()
                out += [(i, k, s + j, 1, a, own) for j, own in enumerate(keys)]
            if out:
                yield _batch(_POSTINGS, out)

    return spans.mapInArrow(trimmed(run), _ddl(_POSTINGS))


def _collapsed(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first occurrence of each context (written, so that a join can split a common anchor), and
    the marks of all later ones."""
    first = stash(postings.groupBy("anchor", "content").agg(F.min(F.struct(*ROW)).alias("f")).select("anchor", "content", *[F.col(f"f.{c}").alias(c) for c in ROW]))
    copies = postings.join(first.select("anchor", "content", *[F.col(c).alias(f"f_{c}") for c in ROW]), ["anchor", "content"])
    copies = copies.where(" or ".join(f"{c} <> f_{c}" for c in ROW))
    return first, copies.select(*ROW, F.expr("shiftleft(1L, count) - 1L").alias("mask"))


def _distinct_contexts(first: DataFrame, shard: int) -> tuple[DataFrame, DataFrame]:
    """Contexts of anchors that have several, with ``wide``: more than ``shard`` of them; and those anchors."""
    kinds = stash(first.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds >= 2").select("anchor", (F.col("kinds") > shard).alias("wide")))
    return first.join(kinds, "anchor"), kinds


def _earlier(spans: DataFrame, window: int) -> DataFrame:
    """id, key, start, mask: which windows of each context start earlier (bit j: the window at start + j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = last = shard = None
        for batch in batches:
            out: list[tuple] = []
            for a, i, k, s, words in zip(*(column_of(batch, c).to_pylist() for c in ("anchor", *ROW, "words")), strict=True):
                if a != anchor:
                    anchor, last, shard = a, None, SuffixAutomaton()
                if (i, k, s) == last:
                    continue  # the same occurrence, from a repeated row
                last = (i, k, s)
                span = np.frombuffer(words, np.uint64).tolist()
                mask = 0
                if len(shard.next) > 1:
                    for j, n in enumerate(shard.matching(span)[window - 1 :]):
                        mask |= (n >= window) << j
                shard.insert(span)
                if mask:
                    out.append((i, k, s, mask))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=[*ROW, "mask"])

    dealt = spans.select("anchor", *ROW, "words").repartition("anchor").sortWithinPartitions("anchor", *ROW)
    return dealt.mapInArrow(trimmed(run), "id long, key long, start int, mask long")


def covered_words(n: int, starts: np.ndarray, masks: np.ndarray, window: int) -> np.ndarray:
    """Which of n words a marked window covers."""
    edge = np.zeros(n + window + 32, np.int32)
    for j in range(window):
        at = starts[(masks >> j) & 1 == 1] + j
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
    return np.cumsum(edge)[:n] > 0


def _kept(joined: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts, masks in zip(column_bytes(column_of(batch, "text")), column_of(batch, "starts"), column_of(batch, "masks"), strict=True):
                words = text.split()
                gone = 0
                if starts.is_valid:
                    cover = covered_words(len(words), starts.values.to_numpy().astype(np.int64), masks.values.to_numpy(), window)
                    gone = int(cover.sum())
                    rest = [w for w, c in zip(words, cover.tolist(), strict=True) if not c] if gone < len(words) else []
                else:
                    rest = words
                n_words.append(len(words))
                n_removed.append(gone)
                kept.append(b" ".join(rest))
            yield pa.RecordBatch.from_arrays([column_of(batch, "id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    joined = joined.select("id", "text", "starts", "masks")
    return joined.mapInArrow(trimmed(run), "id long, n_words long, n_removed long, kept_text string")


def substring_dedup(docs: DataFrame, window: int = 20, shard: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words, one space between) for every row.

    A word goes when a window over it starts earlier: in a smaller identifier, or earlier in the
    same document; windows are judged on the input. Null texts count as empty; texts shorter
    than a window keep all. A row repeated in full is the same occurrence, so both rows keep
    what one would. Rows of one identifier with different texts are documents of their own, in
    the order of a hash of the text. A null identifier sorts before all others and comes back as
    null. An empty table gives an empty result; other columns are left out. ``window`` is 6 to 60.
    """
    if not GRAM <= window <= 60:
        raise ValueError("window must be from 6 to 60 words")
    spark = docs.sparkSession
    tune(spark)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    every = stash(_occurrences(texts, window))
    # aggregates are written before they are joined: a join right above one keeps its partitioning,
    # and Spark can't split the task of a very common anchor there
    twice = stash(every.groupBy("anchor").agg(F.count("*").alias("seen")).where("seen >= 2").select("anchor"))
    # dealt anew by place, so that no file holds all of a common anchor
    repeated = stash(every.join(twice, "anchor").repartition("id", "start"))
    release(spark, every, twice)
    first, marks = _collapsed(repeated)
    distinct, kinds = _distinct_contexts(first, shard)
    empty_heaps(spark)
    wanted = distinct.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "wide"))).alias("w")).select("id", "key", F.col("w.start").alias("starts"), F.col("w.wide").alias("wide"))
    spans = stash(_spans(texts.join(wanted, ["id", "key"]), window))
    empty_heaps(spark)
    shards, done = spans.where("not deep"), [repeated, first, kinds, spans]
    if not kinds.where("wide").isEmpty():
        # contexts cut by long anchors: the same steps again, and after that the windows themselves
        first2, marks2 = _collapsed(spans.where("deep"))
        distinct2, kinds2 = _distinct_contexts(first2, shard)
        held = stash(spans.where("deep").join(distinct2, ["anchor", "content", *ROW]))
        empty_heaps(spark)
        single = stash(_windows(held.where("wide"), window))
        first3, marks3 = _collapsed(single)
        marks = marks.unionByName(marks2).unionByName(marks3)
        shards = shards.unionByName(held.where("not wide").select(shards.columns))
        done += [first2, kinds2, held, single, first3]
        empty_heaps(spark)
    marks = marks.unionByName(_earlier(shards, window))
    # equal marks of repeated rows fall together before they are gathered by document
    marks = stash(marks.groupBy("id", "key").agg(F.collect_set(F.struct("start", "mask")).alias("m")).select("id", "key", F.col("m.start").alias("starts"), F.col("m.mask").alias("masks")))
    release(spark, *done)
    out = _kept(texts.join(marks, ["id", "key"], "left"), window)
    return out.select(F.when(F.col("id") != _NULL_ID, F.col("id")).alias(id_col), "n_words", "n_removed", "kept_text")


def remove_reference(docs: DataFrame, reference: DataFrame, window: int = 20, most_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", shard_words: int = 200_000) -> DataFrame:
    """Like substring_dedup against the texts of a bounded ``reference`` (column text): its words
    are counted first and may be ``most_words`` at most (more raises); automata of ``shard_words`` are
    broadcast. Null texts count as empty on either side; rows that repeat, also of one identifier or
    of none, each lose what the reference holds; an empty table gives an empty result, an empty
    reference removes nothing; other columns are left out."""
    spark = docs.sparkSession
    tune(spark)
    size = reference.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    if size > most_words:
        raise ValueError(f"the reference has {size} words, more than {most_words}: use substring_dedup over the union")
    hashes, shards, room = WordHashes(), [SuffixAutomaton()], shard_words
    for row in reference.select("text").toLocalIterator():
        words = hashes.of((row.text or "").encode().split()).tolist()
        if room < len(words):
            shards.append(SuffixAutomaton())
            room = shard_words
        room -= len(words)
        shards[-1].insert(words)
    sent = spark.sparkContext.broadcast([(s.next, s.link, s.length) for s in shards])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashes = [], WordHashes()
        for parts in sent.value:
            own.append(SuffixAutomaton())
            own[-1].next, own[-1].link, own[-1].length = parts
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text in column_bytes(column_of(batch, "text")):
                words = text.split()
                h = hashes.of(words).tolist()
                cover = np.zeros(len(words), bool)
                for shard in own:
                    for end, n in enumerate(shard.matching(h), 1):
                        if n >= window:
                            cover[end - n : end] = True
                n_words.append(len(words))
                n_removed.append(int(cover.sum()))
                kept.append(b" ".join(w for w, c in zip(words, cover.tolist(), strict=True) if not c))
            yield pa.RecordBatch.from_arrays([column_of(batch, "id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "n_removed", "kept_text"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), f"`{id_col}` long, n_words long, n_removed long, kept_text string")
