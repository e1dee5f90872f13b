"""Candidate suppression and fusion.

Greedy rules are folds over one sorted array per group, so each costs one shuffle with a
partial collect and no join. Groups are the candidates of one image (and label), which
detectors bound; ``capped`` in rank.py bounds them where a source does not.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from opalgrid.functions.geometry import Box, area, iou
from opalgrid.operators.groups import per_groups

BOX = ["x1", "y1", "x2", "y2"]
#: Most rows of the configuration table that ``label_offsets`` numbers in one task.
MOST_CHUNKS = 1_000_000


def field_box(s: Column) -> Box:
    return Box(*(s[c] for c in BOX))


def overlap(a: Column, b: Column) -> Column:
    return iou(field_box(a), field_box(b))


def sorted_group(df: DataFrame, keys: list[str], score: str = "score", pos: str = "det_id") -> DataFrame:
    """keys and ``items``: the rows of a group as structs, best score first, then position."""
    rest = [c for c in df.columns if c not in (*keys, score, pos)]
    item = F.struct((-F.col(score)).alias("__k"), F.col(pos), *rest, F.col(score))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))


def opened(df: DataFrame, keys: list[str], items: Column, columns: list[str]) -> DataFrame:
    return df.select(*keys, F.inline(items)).select(*columns)


def _greedy(items: Column, threshold: float, free: Callable[[Column], Column] | None = None) -> Column:
    """Items that no kept item overlaps by more than ``threshold``. Items that are ``free`` stay
    whatever overlaps them, and suppress nothing."""
    none = F.slice(items, 1, 0)

    def step(kept: Column, x: Column) -> Column:
        hit = F.exists(kept, lambda k: (overlap(k, x) > threshold) if free is None else (~free(k) & (overlap(k, x) > threshold)))
        stays = ~hit if free is None else (free(x) | ~hit)
        return F.when(stays, F.concat(kept, F.array(x))).otherwise(kept)

    return F.aggregate(items, none, step)


def nms(df: DataFrame, keys: list[str], threshold: float, top_n: int | None = None, score: str = "score", pos: str = "det_id") -> DataFrame:
    """Greedy suppression (overlap above the threshold goes), then the best ``top_n`` of a group."""
    kept = _greedy(F.col("items"), threshold)
    return opened(sorted_group(df, keys, score, pos), keys, kept if top_n is None else F.slice(kept, 1, top_n), df.columns)


def two_band(df: DataFrame, keys: list[str], keep: float, threshold: float, score: str = "score", pos: str = "det_id") -> DataFrame:
    """Scores from ``keep`` on always stay; the others are suppressed among themselves only."""
    return opened(sorted_group(df, keys, score, pos), keys, _greedy(F.col("items"), threshold, lambda x: x[score] >= keep), df.columns)


def two_band_with_fallback(df: DataFrame, keys: list[str], least: float, keep: float, threshold: float, fallback: int = 2, score: str = "score", pos: str = "det_id") -> DataFrame:
    """Per group: two_band over scores of ``least`` and more; without any, the best few, unsuppressed."""
    items = F.col("items")
    above = F.filter(items, lambda x: x[score] >= least)
    chosen = F.when(F.size(above) > 0, _greedy(above, threshold, lambda x: x[score] >= keep)).otherwise(F.slice(items, 1, fallback))
    return opened(sorted_group(df, keys, score, pos), keys, chosen, df.columns)


def file_fallback(df: DataFrame, key: str, least: float, fallback: int = 2, score: str = "score", pos: str = "det_id") -> DataFrame:
    """Rows of ``least`` and more; a file without any gives its best few."""
    w = W.partitionBy(key)
    ranked = df.withColumns({"__any": F.max((F.col(score) >= least).cast("int")).over(w), "__r": F.row_number().over(w.orderBy(F.desc(score), pos))})
    return ranked.where((F.col(score) >= least) | ((F.col("__any") == 0) & (F.col("__r") <= fallback))).drop("__any", "__r")


def multiclass_nms(df: DataFrame, image: str, label: str, least: float, threshold: float, top_n: int, score: str = "score", pos: str = "det_id", factor: str | None = None) -> DataFrame:
    """Scores strictly above ``least`` (times ``factor``, if given), suppressed per label, best ``top_n`` of the image."""
    rows = df if factor is None else df.withColumn(score, F.col(score) * F.col(factor))
    kept = nms(rows.where(F.col(score) > least), [image, label], threshold, None, score, pos)
    w = W.partitionBy(image).orderBy(F.desc(score), pos)
    return kept.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top_n).drop("__r")


def fast_nms(df: DataFrame, keys: list[str], threshold: float, top_n: int | None = None, score: str = "score", pos: str = "det_id") -> DataFrame:
    """All at once: an item goes when any better item overlaps it, kept or not."""
    items = F.col("items") if top_n is None else F.slice("items", 1, top_n)
    kept = F.filter(items, lambda x, i: ~F.exists(F.slice(items, F.lit(1), i), lambda k: overlap(k, x) > threshold))
    return opened(sorted_group(df, keys, score, pos), keys, kept, df.columns)


def matrix_nms(df: DataFrame, keys: list[str], kernel: str = "gaussian", sigma: float = 2.0, score: str = "score", pos: str = "det_id") -> DataFrame:
    """Soft suppression: every score decays by its worst overlap with a better item, relative to
    how much that item itself was overlapped. Adds ``decayed``."""
    items = F.col("items")
    worst = lambda x, i: F.coalesce(F.array_max(F.transform(F.slice(items, F.lit(1), i), lambda k: overlap(k, x))), F.lit(0.0))
    rows = sorted_group(df, keys, score, pos).withColumn("own", F.transform(items, worst))

    def decay(x: Column, i: Column) -> Column:
        def one(k: Column, own: Column) -> Column:
            o = overlap(k, x)
            return F.exp(-sigma * (o * o - own * own)) if kernel == "gaussian" else (1 - o) / F.greatest(1 - own, F.lit(1e-9))

        return F.coalesce(F.array_min(F.zip_with(F.slice(items, F.lit(1), i), F.slice(F.col("own"), F.lit(1), i), one)), F.lit(1.0))

    factors = F.transform(items, lambda x, i: F.struct(decay(x, i).alias("factor")))
    both = F.zip_with(items, factors, lambda x, f: F.struct(x.alias("x"), f["factor"].alias("factor")))
    wide = rows.select(*keys, F.inline(both))
    return wide.select(*keys, "x.*", "factor").withColumn("decayed", F.col(score) * F.col("factor")).select(*df.columns, "decayed")


def top_k_above(df: DataFrame, key: str, least: float, k: int, score: str = "score", pos: str = "det_id") -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc(score), pos)
    return df.where(F.col(score) > least).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def merge_tiles(df: DataFrame, tiles: DataFrame, image: str, label: str, threshold: float, score: str = "score", pos: str = "det_id") -> DataFrame:
    """Detections of tiles moved by (dx, dy) of their tile, then suppressed per image and label."""
    moved = df.join(tiles, "tile_id").withColumns({"x1": F.col("x1") + F.col("dx"), "y1": F.col("y1") + F.col("dy"), "x2": F.col("x2") + F.col("dx"), "y2": F.col("y2") + F.col("dy")}).drop("dx", "dy")
    return nms(moved, [image, label], threshold, None, score, pos)


def merge_views(views: list[tuple[DataFrame, str | None]], image_width: float, image_height: float, image: str, label: str, threshold: float, top_n: int, score: str = "score", pos: str = "det_id") -> DataFrame:
    """Test-time augmentation: each view with its flip (or None) is turned back, all are suppressed together."""
    from opalgrid.functions.geometry import box, flip

    parts = []
    for k, (df, turned) in enumerate(views):
        back = df if turned is None else df.withColumns(dict(zip(BOX, flip(box(), turned, image_width, image_height), strict=True)))
        parts.append(back.withColumn(pos, F.col(pos) * len(views) + k))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return multiclass_nms(rows, image, label, -1.0, threshold, top_n, score, pos)


def label_offsets(chunks: DataFrame) -> DataFrame:
    """chunk, offset: how many labels the chunks before it hold (columns chunk, n_labels). Chunks of a
    vocabulary are configuration; more than ``MOST_CHUNKS`` raise, as one task numbers them."""
    if chunks.limit(MOST_CHUNKS + 1).count() > MOST_CHUNKS:
        raise ValueError(f"more than {MOST_CHUNKS} chunks: this is not a vocabulary")
    before = F.sum("n_labels").over(W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    return chunks.select("chunk", F.coalesce(before, F.lit(0)).cast("long").alias("offset"))


class Clusters:
    """Running sums of the clusters of many groups, groups by clusters; a cluster's box is its weighted mean."""

    def __init__(self, groups: int, rows: int, models: int):
        shape = (groups, rows)
        self.n = np.zeros(groups, int)
        self.moment, self.mass, self.total = np.zeros((*shape, 4)), np.zeros(shape), np.zeros(shape)
        self.members, self.best, self.voiced = np.zeros(shape, int), np.zeros(shape), np.zeros(shape)
        self.heard = np.zeros((*shape, models), bool)

    def nearest(self, box: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For the first groups, as many as there are boxes: the cluster of highest IoU, the first of several, and
        that IoU. No group has more than ``most`` clusters yet."""
        of = slice(0, len(box))
        if not most:
            return np.zeros(len(box), int), np.full(len(box), -np.inf)
        mass = self.mass[of, :most]
        own = self.moment[of, :most] / np.where(mass > 0, mass, 1)[..., None]
        b = box[:, None]
        sides = np.clip(np.minimum(own[..., 2:], b[..., 2:]) - np.maximum(own[..., :2], b[..., :2]), 0, None).prod(axis=2)
        whole = (own[..., 2:] - own[..., :2]).prod(axis=2) + (b[..., 2:] - b[..., :2]).prod(axis=2) - sides
        share = np.divide(sides, whole, out=np.zeros_like(sides), where=whole > 0)
        share[np.arange(most) >= self.n[of, None]] = -np.inf
        k = share.argmax(axis=1)
        return k, share[np.arange(len(box)), k]

    def add(self, k: np.ndarray, box: np.ndarray, score: np.ndarray, model: np.ndarray, weight: np.ndarray) -> None:
        at = (np.arange(len(k)), k)
        mass = np.maximum(score, 1e-12)
        self.moment[at] += mass[:, None] * box
        self.mass[at] += mass
        self.members[at] += 1
        self.best[at] = np.maximum(self.best[at], score)
        self.voiced[at] += weight
        self.total[at] += score
        self.heard[(*at, model)] = True
        self.n[: len(k)] = np.maximum(self.n[: len(k)], k + 1)


def _confidence(c: Clusters, at: tuple[np.ndarray, np.ndarray], weights: np.ndarray, mode: str, allows_overflow: bool) -> np.ndarray:
    """Fused scores of clusters. A mode is a row of a table: what is shared out, and among what weight."""
    present, total, members = c.heard[at] @ weights, c.total[at], c.members[at]
    count = members if allows_overflow else np.minimum(members, len(weights))
    table = {
        "avg": (total / members * count, weights.sum()),
        "max": (c.best[at], weights.max()),
        "box_and_model_avg": (total * present, c.voiced[at] * weights.sum()),
        "absent_model_aware_avg": (total, c.voiced[at] + weights.sum() - present),
    }
    shared, among = table[mode]
    return shared / among


def fuse_groups(group: np.ndarray, boxes: np.ndarray, scores: np.ndarray, models: np.ndarray, weights: np.ndarray, threshold: float, mode: str, allows_overflow: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted boxes fusion of many images and labels: group, box and score of the clusters. Inputs by group (from
    0) and falling weighted score. Each box joins the cluster it overlaps most, if by more than ``threshold``, or
    opens one; the first boxes of like-sized groups are placed in one step, then the second ones."""
    n = np.bincount(group)
    first = np.cumsum(n) - n
    out = []
    for size in np.unique(np.ceil(np.log2(n))):
        own = np.flatnonzero(np.ceil(np.log2(n)) == size)
        own = own[np.argsort(-n[own], kind="stable")]
        for some in np.split(own, range(step := max(1, 1_000_000 // int(n[own[0]])), len(own), step)):
            c = Clusters(len(some), int(n[some[0]]), len(weights))
            for k in range(int(n[some[0]])):
                r = first[some[: np.searchsorted(-n[some], -k, "left")]] + k
                near, share = c.nearest(boxes[r], k)
                c.add(np.where(share > threshold, near, c.n[: len(r)]), boxes[r], scores[r], models[r], weights[models[r]])
            at = np.nonzero(np.arange(c.mass.shape[1]) < c.n[:, None])
            out.append((some[at[0]], c.moment[at] / c.mass[at][:, None], _confidence(c, at, weights, mode, allows_overflow)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def weighted_boxes_fusion(df: DataFrame, image: str, label: str, weights: list[float], threshold: float = 0.55, least: float = 0.0, mode: str = "avg", score: str = "score", pos: str = "det_id", model: str = "model") -> DataFrame:
    """image, label, score and box of fused clusters. Where a box goes depends on those before it,
    so the candidates of one image and label are clustered in one pass over them."""
    w = np.asarray(weights, float)

    def solve(group: np.ndarray, g: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        s = g["__s"] * w[g[model]]
        order = np.lexsort((g[pos], -s, group))
        at, fused, out = fuse_groups(group[order], np.stack([g[c] for c in BOX], axis=1)[order], s[order], g[model][order], w, threshold, mode)
        return at, {"score": out, **{c: fused[:, i] for i, c in enumerate(BOX)}}

    kinds = dict(df.dtypes)
    rows = df.where(F.col(score) >= least).where((area(Box(*map(F.col, BOX))) > 0)).select(image, label, F.col(score).cast("double").alias("__s"), pos, model, *[F.col(c).cast("double").alias(c) for c in BOX])
    return per_groups(rows, [image, label], [pos, model, "__s", *BOX], solve, f"{image} {kinds[image]}, {label} {kinds[label]}, score double, x1 double, y1 double, x2 double, y2 double")


def pseudo_labels(df: DataFrame, image: str, label: str, least: float, threshold: float, score: str = "score", pos: str = "det_id") -> DataFrame:
    """Confident survivors as training annotations: per image a list of boxes rounded to two decimals."""
    kept = nms(df.where(F.col(score) > least), [image, label], threshold, None, score, pos)
    item = F.struct(pos, F.col(label).alias("category"), F.array(*[F.round(c, 2) for c in BOX]).alias("bbox"), F.round(score, 2).alias("score"))
    return kept.groupBy(image).agg(F.array_sort(F.collect_list(item)).alias("instances"))
