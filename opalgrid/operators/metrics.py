"""Metric families as aggregates and windows over matched rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from opalgrid.functions.geometry import area, box, intersection, safe_ratio, union, valid
from opalgrid.session import ship


def grounding_metrics(rows: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9), excluded: tuple[int, ...] = (0,), pred: str = "pred_id", target: str = "target_id") -> DataFrame:
    """One row of grounding figures. ``rows``: pred (null: unreadable), target, ground truth g_* and
    the predicted marker's box p_* (null: no such marker).

    A malformed ground truth counts as IoU 0 and adds nothing to the unions; an unreadable answer
    or missing marker counts as IoU 0 and adds the ground truth's area; an excluded id leaves all
    denominators; only readable answers enter the id accuracy.
    """
    g, p = box("g_"), box("p_")
    ok_gt, ok_pred = F.coalesce(valid(g), F.lit(False)), F.coalesce(valid(p), F.lit(False))
    read = F.col(pred).isNotNull()
    out = read & F.coalesce(F.col(pred).isin(*excluded), F.lit(False)) & ok_gt
    case = F.when(~ok_gt, "no_gt").when(~read, "unread").when(out, "excluded").when(~ok_pred, "no_marker").otherwise("resolved")
    r = rows.withColumn("case", case)
    i = F.when(F.col("case") == "resolved", intersection(g, p)).otherwise(F.lit(0.0))
    u = F.when(F.col("case") == "resolved", union(g, p)).when(F.col("case").isin("unread", "no_marker"), area(g)).otherwise(F.lit(0.0))
    r = r.withColumns({"i": i.cast("double"), "u": u.cast("double")}).withColumn("iou", F.when(F.col("case") == "resolved", safe_ratio(F.col("i"), F.col("u"))).otherwise(F.lit(0.0)))
    counted, answered = F.col("case") != "excluded", F.col("case").isin("resolved", "no_marker")
    share = lambda c: F.coalesce(F.avg(F.when(counted, c.cast("double"))), F.lit(0.0))
    return r.agg(
        F.count_if(counted).alias("n_counted"), F.count_if(answered).alias("n_answered"), F.count_if(F.col("case") == "excluded").alias("n_excluded"),
        F.count_if(F.col("case").isin("no_gt", "unread", "no_marker")).alias("n_invalid"),
        F.coalesce(F.avg(F.when(answered, (F.col(pred) == F.col(target)).cast("double"))), F.lit(0.0)).alias("id_accuracy"),
        share(F.col("iou")).alias("mean_iou"), F.coalesce(safe_ratio(F.sum("i"), F.sum("u")), F.lit(0.0)).alias("cum_iou"),
        *[share(F.col("iou") >= t).alias(f"pr_{round(t * 100)}") for t in thresholds],
    )


def score_block(score: Column, blocks: int = 512) -> Column:
    """Number of the score's block, rising with the score; null is before all. Detectors give most of
    their candidates low scores, so blocks are finer there; scores outside 0 to 1 are the last ones."""
    place = F.pow(F.greatest(F.least(score.cast("double"), F.lit(1.0)), F.lit(0.0)), F.lit(0.25))
    return F.when(score.isNull(), -1).otherwise(F.floor(place * blocks).cast("int"))


def precision_recall(tpfp: DataFrame, n_gts: DataFrame, keys: list[str], score: str = "score", ties: tuple[str, ...] = ("det_id",)) -> DataFrame:
    """Running precision and recall of each detection, in falling order of score, per group.

    No task sorts a whole group: rows are counted inside blocks of like score, and the blocks of a
    group are offset by a table of their sums (groups times 512 rows at most). ``block`` stays."""
    rows = tpfp.withColumn("block", score_block(F.col(score)))
    w = W.partitionBy(*keys, "block").orderBy(F.desc(score), *ties)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    run = rows.withColumns({"ctp": F.sum("tp").over(so_far), "cfp": F.sum("fp").over(so_far), "rank": F.row_number().over(w)})
    sums = rows.groupBy(*keys, "block").agg(F.sum("tp").alias("t"), F.sum("fp").alias("f"), F.count("*").alias("n"))
    higher = W.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*keys, "block", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"__{c}") for c in ("t", "f", "n")])
    run = run.join(before, [*keys, "block"]).withColumns({"ctp": F.col("ctp") + F.col("__t"), "cfp": F.col("cfp") + F.col("__f"), "rank": F.col("rank") + F.col("__n")}).drop("__t", "__f", "__n")
    both = F.col("ctp") + F.col("cfp")
    return run.join(n_gts, keys).withColumns({"precision": F.when(both > 0, F.col("ctp") / both).otherwise(0.0), "recall": safe_ratio(F.col("ctp"), F.col("n_gt"))})


def average_precision(curve: DataFrame, n_gts: DataFrame, keys: list[str], mode: str = "area") -> DataFrame:
    """keys, n_gt, ap: area under the precision envelope, or the mean at 11 (or 101) recalls.
    Groups without detections have ap 0; those without ground truth are left out. As in
    precision_recall, the envelope is a running maximum inside blocks, from the end, and the
    maximum of the blocks after."""
    ahead = W.partitionBy(*keys, "block").orderBy(F.desc("rank")).rowsBetween(W.unboundedPreceding, 0)
    lower = W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    tops = curve.groupBy(*keys, "block").agg(F.max("precision").alias("top"))
    tops = tops.select(*keys, "block", F.coalesce(F.max("top").over(lower), F.lit(0.0)).alias("__later"))
    best = curve.withColumn("envelope", F.max("precision").over(ahead)).join(tops, [*keys, "block"]).where("tp > 0").withColumn("envelope", F.greatest("envelope", "__later"))
    if mode == "area":
        ap = best.groupBy(*keys).agg((F.sum(F.col("envelope") * F.col("tp")) / F.first("n_gt")).alias("ap"))
    else:
        n = {"11points": 11, "101points": 101}[mode]
        # each hit holds the recall steps it is the first to reach
        before = F.when(F.col("ctp") > F.col("tp"), (F.col("ctp") - F.col("tp")) / F.col("n_gt")).otherwise(F.lit(-1.0))
        held = best.withColumn("before", before).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        held = held.where((F.col("step") / (n - 1) <= F.col("recall") + 1e-12) & (F.col("step") / (n - 1) > F.col("before") + 1e-12))
        ap = held.groupBy(*keys).agg((F.sum("envelope") / n).alias("ap"))
    return n_gts.where("n_gt > 0").join(ap, keys, "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))


def mean_ap(ap: DataFrame, by: list[str] | None = None) -> DataFrame:
    return ap.groupBy(*(by or [])).agg(F.avg("ap").alias("map"), F.count("*").alias("n_classes"))


def recall_table(best: DataFrame, thresholds: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """Recall at IoU thresholds and their mean; ``best``: one row per ground truth with iou (0: none)."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds]))
    # the small list of thresholds joins after the pairs were reduced to one row each
    return best.withColumn("threshold", t).groupBy(*(by or []), "threshold").agg(F.avg((F.col("iou") >= F.col("threshold")).cast("double")).alias("recall"), F.count("*").alias("n"))


def log_average_miss_rate(curve: DataFrame, keys: list[str], points: tuple[float, ...], n_images: Column) -> DataFrame:
    """exp(mean ln miss rate) at reference counts of false positives per image; where the curve
    starts later than a point the miss rate is 1 there."""
    c = curve.withColumns({"fppi": F.col("cfp") / n_images, "miss": 1 - F.col("recall")})
    at = c.withColumn("point", F.explode(F.array(*[F.lit(p) for p in points]))).where("fppi <= point").groupBy(*keys, "point").agg(F.max_by("miss", "rank").alias("miss"))
    grid = c.select(*keys).distinct().withColumn("point", F.explode(F.array(*[F.lit(p) for p in points])))
    return grid.join(at, [*keys, "point"], "left").groupBy(*keys).agg(F.exp(F.avg(F.ln(F.greatest(F.coalesce("miss", F.lit(1.0)), F.lit(1e-10))))).alias("mr"))


def confusion_table(pairs: DataFrame, truth: str, pred: str, ignore: int | None = None) -> DataFrame:
    rows = pairs if ignore is None else pairs.where(F.col(truth) != ignore)
    return rows.groupBy(truth, pred).agg(F.count("*").alias("n"))


def row_shares(table: DataFrame, truth: str = "gt_class") -> DataFrame:
    return table.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy(truth)))


def segmentation_scores(table: DataFrame, truth: str, pred: str, beta: float = 1.0) -> DataFrame:
    """class, iou, acc, dice, precision, recall, f_score from confusion counts."""
    both = table.select(F.col(truth).alias("cls"), "n", (F.col(truth) == F.col(pred)).cast("int").alias("hit"), F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(table.select(F.col(pred).alias("cls"), "n", F.lit(0).alias("hit"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    s = both.groupBy("cls").agg(F.sum(F.col("n") * F.col("hit")).alias("i"), F.sum(F.col("n") * F.col("t")).alias("label"), F.sum(F.col("n") * F.col("p")).alias("pred"))
    i, l, p = F.col("i"), F.col("label"), F.col("pred")
    precision, recall = safe_ratio(i, p), safe_ratio(i, l)
    return s.select("cls", safe_ratio(i, l + p - i).alias("iou"), recall.alias("acc"), safe_ratio(2 * i, l + p).alias("dice"), precision.alias("precision"), recall.alias("recall"), safe_ratio((1 + beta**2) * precision * recall, beta**2 * precision + recall).alias("f_score"))


def panoptic_quality(matched: DataFrame, gts: DataFrame, preds: DataFrame, cls: str = "category_id") -> DataFrame:
    """PQ, SQ, RQ per class. ``matched``: class and iou of hits; gts, preds: one row per segment."""
    tp = matched.groupBy(cls).agg(F.count("*").alias("tp"), F.sum("iou").alias("s"))
    n = gts.groupBy(cls).agg(F.count("*").alias("ng")).join(preds.groupBy(cls).agg(F.count("*").alias("np")), cls, "full").join(tp, cls, "left").fillna(0, ["ng", "np", "tp"]).fillna(0.0, ["s"])
    d = F.col("tp") + 0.5 * (F.col("ng") - F.col("tp")) + 0.5 * (F.col("np") - F.col("tp"))
    return n.select(cls, safe_ratio(F.col("s"), d).alias("pq"), safe_ratio(F.col("s"), F.col("tp")).alias("sq"), safe_ratio(F.col("tp").cast("double"), d).alias("rq"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column, temperature: float = 1.0) -> Column:
    return safe_ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))) / temperature


#: Most queries that one pass of ``retrieval`` holds against all rows, and so the most it broadcasts.
QUERY_BLOCK = 4096


def retrieval(features: DataFrame, queries: DataFrame, ranks: tuple[int, ...] = (1, 5, 10), key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """mAP and CMC at ranks of each query against all other features, by L2 distance.

    ``queries`` is a stated set; blocks of at most about ``QUERY_BLOCK`` of it, by hash, are broadcast
    one after the other and meet all rows.
    """
    q = queries.select(F.col(key).alias("qid"), F.col(label).alias("ql"), F.col(vector).alias("qv"))
    blocks = -(-q.count() * 5 // (4 * QUERY_BLOCK)) or 1  # a quarter of room, as hashes are uneven
    parts = [_query_scores(features, q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k), key, label, vector) for k in range(blocks)]
    per = parts[0]
    for p in parts[1:]:
        per = per.unionByName(p)
    return per.agg(F.avg(F.col("s") / F.col("n")).alias("map"), *[F.avg((F.col("first") <= r).cast("double")).alias(f"cmc_{r}") for r in ranks], F.count("*").alias("n_queries"))


def _query_scores(features: DataFrame, q: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """qid, n (relevant rows), s (sum of precisions at them), first (rank of the nearest)."""
    pairs = features.join(F.broadcast(q), F.col(key) != F.col("qid"))
    pairs = pairs.select("qid", F.col(key).alias("gid"), (F.col("ql") == F.col(label)).cast("int").alias("same"), squared_distance(F.col("qv"), F.col(vector)).alias("d"))
    w = W.partitionBy("qid").orderBy("d", "gid")
    ranked = pairs.withColumns({"rank": F.row_number().over(w), "hits": F.sum("same").over(w.rowsBetween(W.unboundedPreceding, 0))})
    return ranked.groupBy("qid").agg(F.sum("same").alias("n"), F.sum(F.when(F.col("same") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("s"), F.min(F.when(F.col("same") == 1, F.col("rank"))).alias("first")).where("n > 0")


def robustness(table: DataFrame, clean_severity: int = 0) -> DataFrame:
    """metric, P (clean), mPC (mean over corruptions), rPC (ratio) from distortion, severity, metric, value."""
    return table.groupBy("metric").agg(F.avg(F.when(F.col("severity") == clean_severity, F.col("value"))).alias("p"), F.avg(F.when(F.col("severity") > clean_severity, F.col("value"))).alias("mpc")).withColumn("rpc", safe_ratio(F.col("mpc"), F.col("p")))


def epoch_times(log: DataFrame) -> DataFrame:
    """Mean iteration time per epoch, and the slowest and fastest epoch and the deviation over epochs."""
    per = log.groupBy("epoch").agg(F.avg("time").alias("mean_time"))
    return per.agg(F.max_by("epoch", F.struct("mean_time", -F.col("epoch"))).alias("slowest"), F.min_by("epoch", F.struct("mean_time", "epoch")).alias("fastest"), F.avg("mean_time").alias("mean_time"), F.stddev_pop("mean_time").alias("std_over_epochs"))


def anchor_kmeans(boxes: DataFrame, start: list[tuple[float, float]], rounds: int = 10) -> list[tuple[float, float]]:
    """Mean sizes of k clusters of (w, h) under 1 - IoU at a common corner. Each round is one
    aggregate of k rows; only those reach the driver."""
    centres = start
    for _ in range(rounds):
        near = [F.struct((F.least(F.col("w"), F.lit(a)) * F.least(F.col("h"), F.lit(b)) / (F.col("w") * F.col("h") + a * b - F.least(F.col("w"), F.lit(a)) * F.least(F.col("h"), F.lit(b)))).alias("o"), F.lit(-i).alias("i")) for i, (a, b) in enumerate(centres)]
        got = {r.i: (r.w, r.h) for r in boxes.withColumn("i", -F.greatest(*near)["i"]).groupBy("i").agg(F.avg("w").alias("w"), F.avg("h").alias("h")).collect()}
        new = [got.get(i, c) for i, c in enumerate(centres)]
        if new == centres:
            break
        centres = new
    return centres


def anchor_evolution(boxes: DataFrame, k: int, low: float = 1.0, high: float = 512.0, members: int = 12, generations: int = 20, seed: int = 3) -> tuple[list[tuple[float, float]], float]:
    """Sizes of k anchors found by differential evolution, by area, and the mean best IoU of the boxes (w, h).

    A generation is one aggregate over sizes counted before: all its trials are judged in one pass and
    ``members`` numbers reach the driver. A trial replaces its parent if it is not worse. Null sizes count for
    nothing; without any box the figure is 0.
    """
    sizes = boxes.where("w > 0 and h > 0").groupBy("w", "h").agg(F.count("*").alias("n")).persist()
    draw = np.random.default_rng(seed)

    def judge(population: np.ndarray) -> np.ndarray:
        # a folded array literal keeps the generated code the same in every generation
        packed = F.array(*[F.struct(*[F.lit(float(v)).alias(f"v{j}") for j, v in enumerate(one)]) for one in population])
        shared = [F.least("w", F.col(f"m.v{2 * j}")) * F.least("h", F.col(f"m.v{2 * j + 1}")) for j in range(k)]
        over = [s / (F.col("w") * F.col("h") + F.col(f"m.v{2 * j}") * F.col(f"m.v{2 * j + 1}") - s) for j, s in enumerate(shared)]
        best = over[0] if k == 1 else F.greatest(*over)
        rows = sizes.select("w", "h", "n", F.posexplode(packed).alias("i", "m")).groupBy("i").agg((F.sum(best * F.col("n")) / F.sum("n")).alias("v"))
        got = {r.i: r.v for r in rows.collect()}
        return np.array([round(got.get(i, 0.0), 12) for i in range(members)])

    try:
        now = draw.uniform(low, high, (members, 2 * k))
        worth = judge(now)
        for _ in range(generations):
            trials = now.copy()
            for i in range(members):
                a, b = draw.choice(np.delete(np.arange(members), i), 2, replace=False)
                moved = now[worth.argmax()] + draw.uniform(0.5, 1.0) * (now[a] - now[b])
                taken = draw.random(2 * k) < 0.7
                taken[draw.integers(2 * k)] = True
                outside = (moved < low) | (moved > high)
                moved[outside] = draw.uniform(low, high, outside.sum())
                trials[i, taken] = moved[taken]
            got = judge(trials)
            better = got >= worth
            now[better], worth[better] = trials[better], got[better]
    finally:
        sizes.unpersist()
    top = now[worth.argmax()].reshape(k, 2)
    return [(float(a), float(b)) for a, b in top[np.argsort(top.prod(axis=1), kind="stable")]], float(worth.max())


def sequence_iou(rows: DataFrame, keys: list[str]) -> DataFrame:
    """IoU of two tracks: intersections over unions summed over frames. ``rows``: one per frame of
    either, with box columns and g_ columns, null where one side is absent."""
    a, b = box(), box("g_")
    both = a.x1.isNotNull() & b.x1.isNotNull()
    i = F.when(both, intersection(a, b)).otherwise(0.0)
    u = F.when(both, union(a, b)).when(a.x1.isNotNull(), area(a)).otherwise(area(b))
    return rows.groupBy(*keys).agg(safe_ratio(F.sum(i), F.sum(u)).alias("iou"))


def multi_target_scores(images: DataFrame) -> DataFrame:
    """Figures of expressions with any number of targets, none included. ``images``: n_gt, n_pred, hits
    (one-to-one). f1_rate: the share of images answered without any fault; t_acc: images with targets that
    get a prediction; n_acc: images without targets that get none."""
    faultless = F.when(F.col("n_gt") == 0, F.col("n_pred") == 0).otherwise((F.col("hits") == F.col("n_gt")) & (F.col("hits") == F.col("n_pred")))
    target = F.col("n_gt") > 0
    share = lambda a, b: safe_ratio(F.count_if(a & b).cast("double"), F.count_if(b))
    return images.agg(F.avg(faultless.cast("double")).alias("f1_rate"), share(F.col("n_pred") > 0, target).alias("t_acc"), share(F.col("n_pred") == 0, ~target).alias("n_acc"))


def frequency_groups(images_per_class: DataFrame, rare: int = 10, common: int = 100, n: str = "n_images") -> DataFrame:
    """Classes with their frequency group: r up to ``rare`` images, c up to ``common``, else f."""
    group = F.when(F.col(n) <= rare, "r").when(F.col(n) <= common, "c").otherwise("f")
    return images_per_class.withColumn("frequency", group)


def trapezoid_ap(curve: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ap: area under the plain curve by trapezoids between neighbouring detections. Inside a block
    of like score neighbours are windowed; the last point of the block before is looked up in a small table."""
    w = W.partitionBy(*keys, "block").orderBy("rank")
    ends = curve.groupBy(*keys, "block").agg(F.max(F.struct("rank", "recall", "precision")).alias("e"))
    higher = W.partitionBy(*keys).orderBy(F.desc("block"))
    ends = ends.select(*keys, "block", F.lag("e").over(higher).alias("e"))
    rows = curve.withColumns({"r0": F.lag("recall").over(w), "p0": F.lag("precision").over(w)}).join(ends, [*keys, "block"])
    r0 = F.coalesce("r0", "e.recall", F.lit(0.0))
    p0 = F.coalesce("p0", "e.precision", F.lit(1.0))
    return rows.groupBy(*keys).agg(F.sum((F.col("recall") - r0) * (F.col("precision") + p0) / 2).alias("ap"))


#: The twelve figures of the COCO summary: name, kind, threshold (None: all), range, detections of an image and class.
COCO_FIGURES = [
    ("AP", "ap", None, "all", 100), ("AP50", "ap", 0.5, "all", 100), ("AP75", "ap", 0.75, "all", 100), ("AP_small", "ap", None, "small", 100), ("AP_medium", "ap", None, "medium", 100), ("AP_large", "ap", None, "large", 100),
    ("AR_1", "ar", None, "all", 1), ("AR_10", "ar", None, "all", 10), ("AR_100", "ar", None, "all", 100), ("AR_small", "ar", None, "small", 100), ("AR_medium", "ar", None, "medium", 100), ("AR_large", "ar", None, "large", 100),
]
COCO_THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


#: Recalls that COCO reads precision at.
COCO_RECALLS = np.arange(101) / 100
#: Detections of an image and class that COCO reads recall at.
COCO_MOST = (1, 10, 100)


def _bits(words: np.ndarray, n: int) -> np.ndarray:
    """Rows by settings of 0 and 1 from rows of packed numbers."""
    from opalgrid.operators.match import WORD

    return np.concatenate([(words[:, [w]] >> np.arange(min(WORD, n - w * WORD))) & 1 for w in range(words.shape[1])], axis=1)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(values).ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _outcome_sums(rows: DataFrame, cls: str, n: int) -> DataFrame:
    """cls, block, setting, t, f, h (hits among the first 1, 10 and 100 of an image), summed inside tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            tp, fp = (_bits(_matrix(batch.column(c)), n) for c in ("tp", "fp"))
            place = batch.column("place").to_numpy()
            found = np.stack([tp, fp, *[tp * (place <= k)[:, None] for k in COCO_MOST]], axis=1)
            own = list(zip(batch.column(cls).to_pylist(), batch.column("block").to_pylist(), strict=True))
            number = {k: i for i, k in enumerate(dict.fromkeys(own))}
            at = np.array([number[k] for k in own], int)
            order = np.argsort(at, kind="stable")
            if len(order):
                for k, x in zip(number, np.add.reduceat(found[order], np.flatnonzero(np.diff(at[order], prepend=-1))), strict=True):
                    sums[k] = sums.get(k, 0) + x
        for (c, block), x in sums.items():
            yield pa.RecordBatch.from_pydict({cls: pa.array([c] * n, kind), "block": pa.array([block] * n, pa.int32()), "setting": pa.array(range(n), pa.int32()), "t": pa.array(x[0]), "f": pa.array(x[1]), **{f"h{k}": pa.array(x[2 + i]) for i, k in enumerate(COCO_MOST)}})

    kind = to_arrow_type(rows.schema[cls].dataType)
    sums = rows.select(cls, "block", "place", "tp", "fp").mapInArrow(run, f"{cls} {dict(rows.dtypes)[cls]}, block int, setting int, t long, f long" + "".join(f", h{k} long" for k in COCO_MOST))
    return sums.groupBy(cls, "block", "setting").agg(*[F.sum(c).alias(c) for c in ("t", "f", *[f"h{k}" for k in COCO_MOST])])


def _best_precisions(rows: DataFrame, before: DataFrame, cls: str, order: list, n: int) -> DataFrame:
    """cls, setting, step, p: the best precision of hits whose recall reaches that step of ``COCO_RECALLS``, and no
    higher one. ``before``: cls, block and arrays of a number for each setting: t and f (hits and misses in the
    blocks before) and n_gt. A block is one task, which goes through its rows without holding them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[object, np.ndarray] = {}
        t = f = n_gt = top = None
        settings = np.arange(n)
        for batch in batches:
            classes, heads = batch.column(cls).to_pylist(), np.flatnonzero(batch.column("head").to_numpy(zero_copy_only=False))
            cuts = np.unique(np.concatenate([[0], heads, heads + 1, np.arange(0, batch.num_rows, 4096), [batch.num_rows]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                if a in heads:
                    t, f, n_gt = (_matrix(part.column(c))[0] for c in ("t", "f", "n_gt"))
                    top = best.setdefault(classes[a], np.zeros(n * len(COCO_RECALLS)))
                    continue
                tp, fp = (_bits(_matrix(part.column(c)), n) for c in ("tp", "fp"))
                ctp, cfp = t + np.cumsum(tp, axis=0), f + np.cumsum(fp, axis=0)
                t, f = ctp[-1], cfp[-1]
                row, setting = np.nonzero(tp & (n_gt > 0))
                hits = ctp[row, setting]
                step = np.searchsorted(COCO_RECALLS, hits / n_gt[setting] + 1e-12, "right") - 1
                np.maximum.at(top, setting * len(COCO_RECALLS) + step, hits / (hits + cfp[row, setting]))
        for c, x in best.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_pydict({cls: pa.array([c] * len(at), kind), "setting": pa.array((at // len(COCO_RECALLS)).astype(np.int32)), "step": pa.array((at % len(COCO_RECALLS)).astype(np.int32)), "p": pa.array(x[at])})

    kind = to_arrow_type(rows.schema[cls].dataType)
    none = F.lit(None).cast("array<bigint>")
    both = rows.withColumns({"head": F.lit(False), "t": none, "f": none, "n_gt": none}).unionByName(before.withColumn("head", F.lit(True)), allowMissingColumns=True)
    spark = rows.sparkSession
    ship(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    dealt = both.repartition(parts, cls, "block").sortWithinPartitions(cls, "block", F.desc("head"), *order).select(cls, "head", "t", "f", "n_gt", "tp", "fp")
    return dealt.mapInArrow(run, f"{cls} {dict(rows.dtypes)[cls]}, setting int, step int, p double").groupBy(cls, "setting", "step").agg(F.max("p").alias("p"))


def coco_table(dets: DataFrame, gts: DataFrame, image: str, cls: str, ranges: dict[str, tuple[float, float]], thresholds: tuple[float, ...] = COCO_THRESHOLDS, most: int = 100, ties: tuple[str, ...] = ("image_id", "det_id")) -> DataFrame:
    """cls, threshold, range, n_gt, ap (101 points), ar_1, ar_10, ar_100 by the COCO rule. ``gts`` has ignore
    and iscrowd. A detection stays one row through all settings: what it is under each of them is a bit, and
    the curves of all settings are followed together, in blocks of like score."""
    from opalgrid.operators.match import coco_outcomes
    from opalgrid.sources.sinks import written

    bounds = {k: (float(lo), float(hi)) for k, (lo, hi) in ranges.items()}
    settings = [(t, n, *b) for t in thresholds for n, b in bounds.items()]
    # read twice below, so written once
    rows = written(coco_outcomes(dets.where(F.col(cls).isNotNull()), gts, [image, cls], settings, most)).withColumn("block", score_block(F.col("score")))
    size = area(box())
    counts = [F.count_if((F.col("ignore") == 0) & (size >= b[0]) & (size < b[1])).alias(n) for n, b in bounds.items()]
    n = written(gts.groupBy(cls).agg(*counts))
    sums = written(_outcome_sums(rows, cls, len(settings)))
    higher = W.partitionBy(cls, "setting").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    gone = lambda c: F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(c)
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("setting", c))), lambda x: x[c]).alias(c)
    before = sums.select(cls, "block", "setting", gone("t"), gone("f")).groupBy(cls, "block").agg(in_order("t"), in_order("f"))
    before = before.join(n.select(cls, F.array(*[F.col(s[1]) for s in settings]).alias("n_gt")), cls, "left").withColumn("n_gt", F.coalesce("n_gt", F.array_repeat(F.lit(0).cast("long"), len(settings))))
    best = _best_precisions(rows, before, cls, [F.desc("score"), *ties], len(settings))
    later = F.max("p").over(W.partitionBy(cls, "setting", F.col("threshold")).orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0))
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("setting"), F.lit(t).alias("threshold"), F.lit(r).alias("range"), F.col(r).alias("n_gt")) for i, (t, r, _, _) in enumerate(settings)]))
    grid = n.select(cls, table.alias("s")).select(cls, "s.*").where("n_gt > 0")
    steps = grid.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(COCO_RECALLS) - 1)))).join(best, [cls, "setting", "step"], "left")
    ap = steps.withColumn("e", F.coalesce(later, F.lit(0.0))).groupBy(cls, "setting").agg(F.avg("e").alias("ap"))
    found = sums.groupBy(cls, "setting").agg(*[F.sum(f"h{k}").alias(f"h{k}") for k in COCO_MOST])
    out = grid.join(ap, [cls, "setting"]).join(found, [cls, "setting"], "left")
    return out.select(cls, "threshold", "range", "n_gt", "ap", *[(F.coalesce(f"h{k}", F.lit(0)) / F.col("n_gt")).alias(f"ar_{k}") for k in COCO_MOST])


def coco_summary(table: DataFrame) -> DataFrame:
    """name, value of the twelve figures; null where no class has ground truth of a range."""
    items = []
    for name, kind, t, r, k in COCO_FIGURES:
        own = (F.col("range") == r) & (F.lit(True) if t is None else F.abs(F.col("threshold") - t) < 1e-9)
        items.append(F.struct(F.lit(name).alias("name"), F.avg(F.when(own, F.col("ap" if kind == "ap" else f"ar_{k}"))).alias("value")))
    return table.agg(F.array(*items).alias("r")).select(F.inline("r"))


def track_pairs(gts: DataFrame, preds: DataFrame, keys: list[str], frame: str = "frame_id", gt: str = "gt_id", det: str = "det_id") -> DataFrame:
    """keys, gt, det, iou of tracks that overlap in some frame: intersections summed over frames, over the
    sum of all boxes of both less those."""
    name = lambda df, i, p: df.select(*keys, frame, i, *[F.col(c).alias(p + c) for c in ("x1", "y1", "x2", "y2")])
    both = name(preds, det, "").join(name(gts, gt, "g_"), [*keys, frame]).groupBy(*keys, gt, det).agg(F.sum(intersection(box(), box("g_"))).alias("i")).where("i > 0")
    whole = lambda df, i, n: df.groupBy(*keys, i).agg(F.sum(area(box())).alias(n))
    p = both.join(whole(gts, gt, "__g"), [*keys, gt]).join(whole(preds, det, "__p"), [*keys, det])
    return p.select(*keys, gt, det, (F.col("i") / (F.col("__g") + F.col("__p") - F.col("i"))).alias("iou"))


def video_ap(gts: DataFrame, preds: DataFrame, threshold: float = 0.5, video: str = "video", cls: str = "cls", frame: str = "frame_id", gt: str = "gt_id", det: str = "det_id") -> DataFrame:
    """cls, n_gt, ap (101 points) of predicted tracks; a track's score is the mean of its boxes', to nine
    places, so that tracks of equal boxes tie."""
    from opalgrid.operators.match import take_by_score

    keys = [video, cls]
    tracks = preds.groupBy(*keys, det).agg(F.round(F.avg("score"), 9).alias("score"))
    m = take_by_score(tracks, track_pairs(gts, preds, keys, frame, gt, det), keys, threshold, det, gt)
    m = m.withColumns({"tp": F.col("matched").isNotNull().cast("int"), "fp": F.col("matched").isNull().cast("int")})
    n = gts.select(*keys, gt).distinct().groupBy(cls).agg(F.count("*").alias("n_gt"))
    return average_precision(precision_recall(m, n, [cls], ties=(video, det)), n, [cls], "101points")


def error_shares(dets: DataFrame, gts: DataFrame, groups: DataFrame, image: str = "image_id", cls: str = "cls", det: str = "det_id", gt: str = "gt_id") -> DataFrame:
    """kind, n. Detections by the first scenario that would forgive them: strict and loose overlap (c75,
    c50), any place (loc), a class of the same super-category (sim), any class (oth), background (bg);
    and fn: ground truths that no detection of their class overlaps. ``groups``: class, supercategory, a
    dimension table."""
    group = lambda df, n: df.join(groups.select(F.col(cls), F.col("supercategory").alias(n)), cls, "left")
    g = group(gts, "gs").select(image, F.col(gt), F.col(cls).alias("gc"), "gs", *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    o = safe_ratio(intersection(box(), box("g_")), union(box(), box("g_")))
    pairs = group(dets, "ds").join(g, image, "left").withColumn("o", o)
    best = lambda when, n: F.max(F.when(when, F.col("o"))).alias(n)
    b = pairs.groupBy(image, det).agg(best(F.col(cls) == F.col("gc"), "own"), best(F.col("ds") == F.col("gs"), "sim"), best(F.col("gc").isNotNull(), "any"))
    kind = F.when(F.col("own") >= 0.75, "c75").when(F.col("own") >= 0.5, "c50").when(F.col("own") >= 0.1, "loc").when(F.col("sim") >= 0.1, "sim").when(F.col("any") >= 0.1, "oth").otherwise("bg")
    found = pairs.where((F.col(cls) == F.col("gc")) & (F.col("o") >= 0.1)).select(image, gt).distinct()
    missed = gts.join(found, [image, gt], "left_anti").agg(F.lit("fn").alias("kind"), F.count("*").alias("n"))
    return b.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).unionByName(missed)
