"""Assignment solvers (numpy, no scipy) and label assignment of priors to ground truth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from opalgrid.functions.geometry import area, box, centre, holds_point, resize_about_centre
from opalgrid.operators.groups import changes, codes, per_groups


def linear_assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a minimum-cost assignment of a dense matrix (shortest augmenting paths)."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return np.empty(0, int), np.empty(0, int)
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        owner[m], j = i, m
        least, way, seen = np.full(m + 1, np.inf), np.full(m + 1, m), np.zeros(m + 1, bool)
        while owner[j] >= 0:
            seen[j] = True
            row = owner[j]
            left = c[row] - u[row] - v[:m]
            better = ~seen[:m] & (left < least[:m])
            least[:m][better], way[:m][better] = left[better], j
            masked = np.where(seen[:m], np.inf, least[:m])
            k = int(np.argmin(masked))
            step = masked[k]
            u[owner[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            j = k
        while j != m:
            owner[j] = owner[way[j]]
            j = int(way[j])
    cols = np.flatnonzero(owner[:m] >= 0)
    rows = owner[cols]
    order = np.argsort(rows)
    return (cols[np.argsort(cols)], rows[np.argsort(cols)]) if turned else (rows[order], cols[order])


def _shortest_paths(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a minimum-cost assignment of each matrix (problems, rows, columns; no more
    rows than columns). Shortest augmenting paths, all problems in step."""
    count, n, m = cost.shape
    u, v = np.zeros((count, n)), np.zeros((count, m))
    owner, taken = np.full((count, m), -1), np.full((count, n), -1)
    for root in range(n):
        short, before = np.full((count, m), np.inf), np.full((count, m), root)
        closed, reached = np.zeros((count, m), bool), np.zeros((count, n), bool)
        low, row, sink = np.zeros(count), np.full(count, root), np.full(count, -1)
        act = np.arange(count)
        while act.size:
            r = row[act]
            reached[act, r] = True
            d = (low[act] - u[act, r])[:, None] + cost[act, r] - v[act]
            s, shut = short[act], closed[act]
            better = (d < s) & ~shut
            short[act] = s = np.where(better, d, s)
            before[act] = np.where(better, r[:, None], before[act])
            j = np.where(shut, np.inf, s).argmin(axis=1)
            low[act] = s[np.arange(len(act)), j]
            closed[act, j] = True
            nxt = owner[act, j]
            free = nxt < 0
            sink[act[free]] = j[free]
            row[act[~free]] = nxt[~free]
            act = act[~free]
        reached[:, root] = False
        u += np.where(reached, low[:, None] - np.take_along_axis(short, np.maximum(taken, 0), axis=1), 0.0)
        u[:, root] += low
        v -= np.where(closed, low[:, None] - np.where(closed, short, 0.0), 0.0)
        act, j = np.arange(count), sink
        while act.size:
            r = before[act, j]
            owner[act, j] = r
            taken[act, r], j = j, taken[act, r]
            on = r != root
            act, j = act[on], j[on]
    return taken


#: Most cells of the dense matrices that are solved in step.
CELLS = 2_000_000


def heaviest_pairs(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) make a matching of greatest total weight. Nodes are whole numbers, a pair comes
    once, pairs of no weight are never made. Connected parts are solved each by itself, like-sized ones
    in step, so many small problems with nodes of their own cost little more than one."""
    out = np.zeros(len(a), bool)
    at = np.flatnonzero(weight > 0)
    if not at.size:
        return out
    a, b, weight = codes(a[at]), codes(b[at]), weight[at]
    lone = (np.bincount(a)[a] == 1) & (np.bincount(b)[b] == 1)
    out[at[lone]] = True
    at, a, b, weight = at[~lone], codes(a[~lone]), codes(b[~lone]), weight[~lone]
    if not at.size:
        return out
    part = np.arange(a.max() + 1)
    while True:
        side = np.full(b.max() + 1, len(part))
        np.minimum.at(side, b, part[a])
        now = part.copy()
        np.minimum.at(now, a, side[b])
        now = now[now]
        if (now == part).all():
            break
        part = now
    own = codes(part[a])
    n_own = own.max() + 1
    place, size = [], []
    for node in (a, b):
        home = np.zeros(node.max() + 1, int)
        home[node] = own
        order = np.argsort(home, kind="stable")
        n = np.bincount(home, minlength=n_own)
        rank = np.empty(len(home), int)
        rank[order] = np.arange(len(home)) - np.repeat(np.cumsum(n) - n, n)
        place.append(rank[node])
        size.append(n)
    wide = size[0] > size[1]
    row, col = np.where(wide[own], place[1], place[0]), np.where(wide[own], place[0], place[1])
    n, m = np.minimum(*size), np.maximum(*size)
    m = 2 ** np.ceil(np.log2(m)).astype(int)
    edges = np.argsort(own, kind="stable")
    first = np.append(0, np.cumsum(np.bincount(own)))
    for members in np.split(np.lexsort((m, n)), np.flatnonzero(np.diff(np.sort(n * (m.max() + 1) + m))) + 1):
        rows, cols = int(n[members[0]]), int(m[members[0]])
        most = max(1, CELLS // (rows * cols))
        for some in np.split(members, range(most, len(members), most)):
            k = first[some + 1] - first[some]
            e = edges[np.repeat(first[some] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            p = np.repeat(np.arange(len(some)), k)
            cost = np.zeros((len(some), rows, cols))
            cost[p, row[e], col[e]] = -weight[e]
            out[at[e]] = _shortest_paths(cost)[p, row[e]] == col[e]
    return out


def assignment_with_limit(cost: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Assignment in which leaving a row and a column alone costs ``limit`` in all: only pairs that
    are cheaper are made."""
    r, c = np.nonzero(cost < limit)
    ok = heaviest_pairs(r, c, limit - cost[r, c])
    return r[ok], c[ok]


def bipartite_matching(edges: list[tuple[int, int]]) -> dict[int, int]:
    """A matching of most pairs: right node -> left node (augmenting paths, breadth first)."""
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    left_of: dict[int, int] = {}
    right_of: dict[int, int] = {}
    for root in near:
        before: dict[int, int] = {}
        queue, at, free = [root], 0, None
        while at < len(queue) and free is None:
            a = queue[at]
            at += 1
            for b in near[a]:
                if b not in before:
                    before[b] = a
                    if b not in left_of:
                        free = b
                        break
                    queue.append(left_of[b])
        while free is not None:
            a = before[free]
            following = right_of.get(a)
            left_of[free], right_of[a] = a, free
            free = following if a != root else None
    return left_of


def max_matching(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys and n_matched: the most pairs of a group in which no side repeats. A group is one image."""

    def solve(group: np.ndarray, c: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        once = changes(group, c[a], c[b])
        g, left, right = group[once], c[a][once], c[b][once]
        ok = heaviest_pairs(codes(g, left), codes(g, right), np.ones(len(g)))
        n = np.bincount(g[ok], minlength=group[-1] + 1)
        return np.arange(len(n)), {"n_matched": n}

    kinds = dict(pairs.dtypes)
    return per_groups(pairs, keys, [a, b], solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n_matched long")


def _listed(group: np.ndarray, a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of each pair's last mention; numbers of both sides' nodes; twice each group's whole cost and more."""
    last = np.append(changes(group, a, b)[1:], True)
    whole = (np.bincount(group, weights=np.abs(cost)) + 1.0) * 2
    return np.flatnonzero(last), codes(group, a)[last], codes(group, b)[last], whole[group[last]]


def hungarian(pairs: DataFrame, keys: list[str], a: str, b: str, cost: str, limit: float | None = None) -> DataFrame:
    """keys, a, b, cost of a minimum-cost assignment per group; pairs not listed are not allowed."""

    def solve(group: np.ndarray, c: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        own = c[cost].astype(float)
        at, left, right, whole = _listed(group, c[a], c[b], own)
        at = at[heaviest_pairs(left, right, (whole if limit is None else limit) - own[at])]
        return group[at], {a: c[a][at], b: c[b][at], cost: own[at]}

    kinds = dict(pairs.dtypes)
    return per_groups(pairs, keys, [a, b, cost], solve, ", ".join(f"{k} {kinds[k]}" for k in [*keys, a, b]) + f", {cost} double")


def top_k_hungarian(pairs: DataFrame, keys: list[str], prior: str, gt: str, cost: str, k: int = 3) -> DataFrame:
    """Each ground truth is assigned up to ``k`` priors: one-to-one assignments are made again and again
    over the priors still free. keys, prior, gt, cost and round (from 1)."""

    def solve(group: np.ndarray, c: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        own = c[cost].astype(float)
        at, left, right, whole = _listed(group, c[prior], c[gt], own)
        rounds, taken = [], np.zeros(left.max() + 1, bool)
        for _ in range(k):
            open_ = np.flatnonzero(~taken[left])
            ok = open_[heaviest_pairs(left[open_], right[open_], whole[open_] - own[at[open_]])]
            taken[left[ok]] = True
            rounds.append(at[ok])
        rows = np.concatenate(rounds)
        return group[rows], {prior: c[prior][rows], gt: c[gt][rows], cost: own[rows], "round": np.repeat(np.arange(1, k + 1), [len(r) for r in rounds])}

    kinds = dict(pairs.dtypes)
    return per_groups(pairs, keys, [prior, gt, cost], solve, ", ".join(f"{x} {kinds[x]}" for x in [*keys, prior, gt]) + f", {cost} double, round int")


def max_iou_assign(pairs: DataFrame, keys: list[str], prior: str = "det_id", gt: str = "gt_id", positive: float = 0.5, negative: float = 0.4, least: float = 0.0, low_quality: bool = True) -> DataFrame:
    """assigned of each prior: gt id, 0 for background, -1 for neither (ids start at 1). A prior takes
    its best ground truth; each ground truth also keeps its best priors (the last one wins)."""
    own = pairs.groupBy(*keys, prior).agg(F.max(F.struct("iou", (-F.col(gt)).alias("n"))).alias("b"))
    base = own.select(*keys, prior, F.when(F.col("b.iou") >= positive, -F.col("b.n")).when(F.col("b.iou") < negative, F.lit(0)).otherwise(F.lit(-1)).cast("long").alias("assigned"))
    if not low_quality:
        return base
    top = F.max("iou").over(W.partitionBy(*keys, gt))
    forced = pairs.withColumn("__top", top).where((F.col("iou") == F.col("__top")) & (F.col("__top") > least)).groupBy(*keys, prior).agg(F.max(gt).alias("__f"))
    return base.join(forced, [*keys, prior], "left").withColumn("assigned", F.coalesce(F.col("__f").cast("long"), "assigned")).drop("__f")


def _with_boxes(priors: DataFrame, gts: DataFrame, keys: list[str], prior: str, gt: str) -> DataFrame:
    from opalgrid.functions.geometry import iou

    g = gts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(gt), *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return priors.join(g, on).withColumn("iou", iou(box(), box("g_")))


def atss_assign(priors: DataFrame, gts: DataFrame, keys: list[str], prior: str = "det_id", gt: str = "gt_id", k: int = 9) -> DataFrame:
    """keys, prior, assigned: per ground truth the k priors of nearest centre; positive are those
    whose IoU reaches mean + deviation of the k and whose centre lies inside."""
    pairs = _with_boxes(priors, gts, keys, prior, gt)
    (px, py), (gx, gy) = centre(box()), centre(box("g_"))
    near = pairs.withColumn("d", (px - gx) * (px - gx) + (py - gy) * (py - gy)).withColumn("r", F.row_number().over(W.partitionBy(*keys, gt).orderBy("d", prior))).where(F.col("r") <= k)
    w = W.partitionBy(*keys, gt)
    inside = holds_point(box("g_"), px, py)
    good = near.withColumn("t", F.avg("iou").over(w) + F.coalesce(F.stddev_samp("iou").over(w), F.lit(0.0))).where((F.col("iou") >= F.col("t")) & inside)
    best = good.groupBy(*keys, prior).agg(F.max(F.struct("iou", (-F.col(gt)).alias("n"))).alias("b"))
    return best.select(*keys, prior, (-F.col("b.n")).cast("long").alias("assigned"))


def dynamic_k_assign(priors: DataFrame, gts: DataFrame, keys: list[str], prior: str = "det_id", gt: str = "gt_id", candidates: int = 10, score: str = "score", iou_weight: float = 3.0) -> DataFrame:
    """Each ground truth takes its k cheapest priors, k = the sum of its best IoUs (1 at least);
    a prior wanted by several goes to the cheapest. Cost: -ln(score) - weight ln(IoU)."""
    pairs = _with_boxes(priors, gts, keys, prior, gt).where("iou > 0")
    cost = -F.ln(F.greatest(F.col(score), F.lit(1e-7))) - iou_weight * F.ln(F.greatest(F.col("iou"), F.lit(1e-7)))
    w = W.partitionBy(*keys, gt)
    ranked = pairs.withColumn("cost", cost).withColumns({"ri": F.row_number().over(w.orderBy(F.desc("iou"), prior)), "rc": F.row_number().over(w.orderBy("cost", prior))})
    ranked = ranked.withColumn("k", F.greatest(F.lit(1), F.floor(F.sum(F.when(F.col("ri") <= candidates, F.col("iou")).otherwise(0.0)).over(w) + 1e-9)))
    chosen = ranked.where("rc <= k").groupBy(*keys, prior).agg(F.min(F.struct("cost", gt)).alias("b"))
    return chosen.select(*keys, prior, F.col(f"b.{gt}").cast("long").alias("assigned"))


def aligned_assign(priors: DataFrame, gts: DataFrame, keys: list[str], prior: str = "det_id", gt: str = "gt_id", k: int = 13, alpha: float = 1.0, beta: float = 6.0, score: str = "score") -> DataFrame:
    """Per ground truth the k priors of highest score^alpha * IoU^beta whose centre lies inside."""
    pairs = _with_boxes(priors, gts, keys, prior, gt)
    px, py = centre(box())
    metric = F.pow(score, F.lit(alpha)) * F.pow("iou", F.lit(beta))
    near = pairs.where(holds_point(box("g_"), px, py)).withColumn("m", metric).withColumn("r", F.row_number().over(W.partitionBy(*keys, gt).orderBy(F.desc("m"), prior))).where((F.col("r") <= k) & (F.col("m") > 0))
    return near.groupBy(*keys, prior).agg(F.max(F.struct("iou", (-F.col(gt)).alias("n"))).alias("b")).select(*keys, prior, (-F.col("b.n")).cast("long").alias("assigned"))


def uniform_assign(priors: DataFrame, gts: DataFrame, keys: list[str], prior: str = "det_id", gt: str = "gt_id", k: int = 4, least: float = 0.15) -> DataFrame:
    """Every ground truth takes the k priors nearest in centre and size (L1), so small boxes get as many as
    large ones; a prior wanted by several goes to the largest id; those that overlap by less than
    ``least`` count as neither (-1)."""
    pairs = _with_boxes(priors, gts, keys, prior, gt)
    a, b = box(), box("g_")
    away = sum((F.abs((a[i] + a[i + 2]) / 2 - (b[i] + b[i + 2]) / 2) + F.abs((a[i + 2] - a[i]) - (b[i + 2] - b[i])) for i in (0, 1)), F.lit(0.0))
    near = pairs.withColumn("d", away).withColumn("r", F.row_number().over(W.partitionBy(*keys, gt).orderBy("d", prior))).where(F.col("r") <= k)
    best = near.groupBy(*keys, prior).agg(F.max(F.struct(F.col(gt).cast("long").alias("g"), "iou")).alias("b"))
    return best.select(*keys, prior, F.when(F.col("b.iou") < least, F.lit(-1)).otherwise(F.col("b.g")).cast("long").alias("assigned"))


def approx_max_iou_assign(pairs: DataFrame, keys: list[str], prior: str = "det_id", gt: str = "gt_id", **rules: float | bool) -> DataFrame:
    """``max_iou_assign`` for priors that stand for several boxes each: ``pairs`` has a row for each box of a
    prior and ground truth, and the best box speaks for the prior. ``rules`` go on to ``max_iou_assign``."""
    return max_iou_assign(pairs.groupBy(*keys, prior, gt).agg(F.max("iou").alias("iou")), keys, prior, gt, **rules)


def centre_region_assign(priors: DataFrame, gts: DataFrame, keys: list[str], prior: str = "det_id", gt: str = "gt_id", core: float = 0.2, shadow: float = 0.5) -> DataFrame:
    """keys, prior, assigned for all priors: the ground truth whose core (its box scaled about the centre)
    holds the prior's centre, the smallest of several; -1 if only a shadow does, else 0."""
    pairs = _with_boxes(priors, gts, keys, prior, gt)
    px, py = centre(box())
    holds = lambda scale: holds_point(resize_about_centre(box("g_"), scale, scale), px, py)
    near = pairs.where(holds(max(core, shadow))).groupBy(*keys, prior).agg(F.min(F.when(holds(core), F.struct(area(box("g_")).alias("a"), F.col(gt).cast("long").alias("g"))))["g"].alias("__g"))
    near = near.withColumn("__n", F.coalesce("__g", F.lit(-1)))
    return priors.select(*keys, prior).join(near, [*keys, prior], "left").select(*keys, prior, F.coalesce("__n", F.lit(0)).cast("long").alias("assigned"))


def sample_hard(assigned: DataFrame, keys: list[str], prior: str = "det_id", loss: str = "loss", number: int = 16, positive_share: float = 0.25) -> DataFrame:
    """Of each group the positives of greatest loss, up to share * number, and the negatives of greatest loss
    for the rest. Null losses come last; ties fall to the smaller id."""
    rows = assigned.where("assigned >= 0").withColumn("__k", F.col("assigned") > 0)
    most = int(number * positive_share)
    rank = F.row_number().over(W.partitionBy(*keys, "__k").orderBy(F.desc_nulls_last(loss), prior))
    n_pos = F.least(F.count_if("__k").over(W.partitionBy(*keys)), F.lit(most))
    rows = rows.withColumns({"__r": rank, "__p": n_pos})
    return rows.where(F.col("__r") <= F.when(F.col("__k"), F.lit(most)).otherwise(number - F.col("__p"))).drop("__k", "__r", "__p")


def sample_iou_balanced(negatives: DataFrame, keys: list[str], prior: str = "det_id", number: int = 6, bins: int = 3, most_iou: float = 0.4, seed: int = 3) -> DataFrame:
    """Up to ``number`` negatives of each group, the same share from each bin of their best IoU (column iou);
    what a bin lacks is filled from the others. Drawn by hash, so reruns agree. Adds ``bin``."""
    bin_ = F.least(F.floor(F.col("iou") / most_iou * bins), F.lit(bins - 1)).cast("int")
    draw = F.xxhash64(*keys, prior, F.lit(seed))
    rows = negatives.withColumn("bin", bin_)
    rows = rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys, "bin").orderBy(draw, prior)))
    late = (F.col("__r") > number // bins).cast("int")
    return rows.withColumn("__q", F.row_number().over(W.partitionBy(*keys).orderBy(late, draw, prior))).where(F.col("__q") <= number).drop("__r", "__q")


def sample_per_instance(assigned: DataFrame, keys: list[str], prior: str = "det_id", number: int = 6, seed: int = 3) -> DataFrame:
    """Up to ``number`` positives of each group, dealt in turns over the ground truths they belong to."""
    draw = F.xxhash64(*keys, prior, F.lit(seed))
    rows = assigned.where("assigned > 0").withColumn("__r", F.row_number().over(W.partitionBy(*keys, "assigned").orderBy(draw, prior)))
    return rows.withColumn("__q", F.row_number().over(W.partitionBy(*keys).orderBy("__r", "assigned"))).where(F.col("__q") <= number).drop("__r", "__q")


def sample_balanced(assigned: DataFrame, keys: list[str], prior: str = "det_id", number: int = 16, positive_share: float = 0.25, seed: int = 3) -> DataFrame:
    """Up to share * number positives and the rest negatives of each group, drawn by hash (reruns agree)."""
    kind = F.when(F.col("assigned") > 0, 1).when(F.col("assigned") == 0, 0)
    rows = assigned.withColumn("kind", kind).where("kind is not null")
    drawn = F.row_number().over(W.partitionBy(*keys, "kind").orderBy(F.xxhash64(*keys, prior, F.lit(seed)), prior))
    most = int(number * positive_share)
    n_pos = F.sum("kind").over(W.partitionBy(*keys))
    return rows.withColumns({"__r": drawn, "__p": F.least(n_pos, F.lit(most))}).where(F.when(F.col("kind") == 1, F.col("__r") <= most).otherwise(F.col("__r") <= number - F.col("__p"))).drop("__r", "__p", "kind")


def grid_priors(levels: DataFrame, base: DataFrame) -> DataFrame:
    """Anchors of feature maps: ``levels`` (level, rows, cols, stride) times ``base`` (level, anchor,
    x1, y1, x2, y2), shifted to every cell. Both inputs are configuration tables."""
    cells = levels.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    dx, dy = F.col("c") * F.col("stride"), F.col("r") * F.col("stride")
    return cells.join(base, "level").select("level", "r", "c", "anchor", (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"), (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"))


def grid_points(levels: DataFrame, offset: float = 0.5) -> DataFrame:
    cells = levels.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    return cells.select("level", "r", "c", ((F.col("c") + offset) * F.col("stride")).alias("x"), ((F.col("r") + offset) * F.col("stride")).alias("y"))
