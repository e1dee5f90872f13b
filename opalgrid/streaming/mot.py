"""CLEAR and identity figures of multi-object tracking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from opalgrid.functions.geometry import safe_ratio
from opalgrid.operators.assign import heaviest_pairs
from opalgrid.operators.groups import changes, codes, meetings, per_groups
from opalgrid.streaming.tracks import BOX, in_step, iou_of

#: Overlaps that HOTA averages over.
LEVELS = np.arange(0.05, 0.99, 0.05)

Columns = dict[str, np.ndarray]


def _sides(group: np.ndarray, c: Columns) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ground truth and of predictions; the number of each row's frame, over all videos, and of its track."""
    own = c["kind"] == "g"
    track = np.empty(len(group), int)
    for side in (own, ~own):
        track[side] = codes(group[side], c["track_id"][side])
    return np.flatnonzero(own), np.flatnonzero(~own), np.cumsum(changes(group, c["frame_id"])) - 1, track


def _overlaps(g: np.ndarray, p: np.ndarray, at: np.ndarray, c: Columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one frame that overlap, and their IoU."""
    boxes = np.stack([c[x] for x in BOX], axis=1)
    i, j = meetings(at[g], at[p])
    i, j = g[i], p[j]
    o = iou_of(boxes[i], boxes[j])
    return i[o > 0], j[o > 0], o[o > 0]


def clear_figures(group: np.ndarray, c: Columns, threshold: float) -> Columns:
    """Counts of many videos, one row each. Columns: kind ("g" or "p"), frame_id, track_id, box; rows sorted by
    video (numbers from 0) and frame. A pair of the frame before stays while it overlaps enough; the rest is
    assigned anew at least cost. All videos' first frames are matched in one step, then the second ones."""
    n = int(group[-1]) + 1
    g, p, at, track = _sides(group, c)
    i, j, o = _overlaps(g, p, at, c)
    i, j, o = (x[o >= threshold] for x in (i, j, o))
    last = np.full(len(g), -1)  # by track of the ground truth: the prediction's track it had
    out = {k: np.zeros(n) for k in ("hits", "switches", "overlap", "id_hits")}
    taken = np.zeros(len(group), bool)
    for e in in_step(group[i], at[i]):
        stay = e[last[track[i[e]]] == track[j[e]]]
        stay = stay[np.unique(i[stay], return_index=True)[1]]
        stay = stay[np.sort(np.unique(j[stay], return_index=True)[1])]
        taken[i[stay]] = taken[j[stay]] = True
        e = e[~taken[i[e]] & ~taken[j[e]]]
        now = np.concatenate([stay, e[heaviest_pairs(i[e], j[e], 1 + o[e])]])  # cost 1 - IoU, limit 2
        a, b, v = track[i[now]], track[j[now]], group[i[now]]
        out["hits"] += np.bincount(v, minlength=n)
        out["switches"] += np.bincount(v, (last[a] >= 0) & (last[a] != b), n)
        out["overlap"] += np.bincount(v, o[now], n)
        last[a] = b
    if len(i):
        pair = codes(track[i], track[j])
        first = np.unique(pair, return_index=True)[1]
        count = np.bincount(pair)
        ok = heaviest_pairs(track[i[first]], track[j[first]], count.astype(float))
        out["id_hits"] += np.bincount(group[i[first]][ok], count[ok], n)
    out |= {"n_gt": np.bincount(group[g], minlength=n), "n_pred": np.bincount(group[p], minlength=n)}
    return out | {"misses": out["n_gt"] - out["hits"], "false_alarms": out["n_pred"] - out["hits"]}


def hota_figures(group: np.ndarray, c: Columns) -> Columns:
    """HOTA, detection and association accuracy of many videos, the mean over overlaps. Rows as in clear_figures.
    Pairs of a frame are assigned to favour tracks that agree over the whole video."""
    n = int(group[-1]) + 1
    g, p, at, track = _sides(group, c)
    i, j, o = _overlaps(g, p, at, c)
    n_own, n_theirs = np.bincount(track[g], minlength=1), np.bincount(track[p], minlength=1)
    rows, seen = len(group), np.bincount(group, minlength=n)
    total = np.bincount(i, o, rows)[i] + np.bincount(j, o, rows)[j] - o
    pair = codes(track[i], track[j])
    first = np.unique(pair, return_index=True)[1]
    own, theirs, video = n_own[track[i[first]]], n_theirs[track[j[first]]], group[i[first]]
    alike = np.bincount(pair, np.divide(o, total, out=np.zeros_like(o), where=total > 1e-12), len(first))
    alike = alike / (own + theirs - alike)
    made = heaviest_pairs(i, j, alike[pair] * o)
    pair, o = pair[made], o[made]
    out = {k: np.zeros(n) for k in ("hota", "det_a", "ass_a")}
    for level in LEVELS:
        hits = np.bincount(pair[o >= level - 1e-12], minlength=len(first))
        tp = np.bincount(video, hits, n)
        det = tp / np.maximum(1, seen - tp)
        ass = np.bincount(video, hits * hits / np.maximum(1, own + theirs - hits), n) / np.maximum(1, tp)
        for k, x in (("hota", np.sqrt(det * ass)), ("det_a", det), ("ass_a", ass)):
            out[k] += x / len(LEVELS)
    return out


def _per_video(gts: DataFrame, preds: DataFrame, video: str, solve, schema: str) -> DataFrame:
    """One row of figures a video, which is one task; the videos of a task are measured together."""
    rows = gts.withColumn("kind", F.lit("g")).select(video, "kind", "frame_id", "track_id", *[F.col(x).cast("double").alias(x) for x in BOX])
    rows = rows.unionByName(preds.withColumn("kind", F.lit("p")).select(rows.columns[:4] + [F.col(x).cast("double").alias(x) for x in BOX]))
    rows = rows.where(F.col("frame_id").isNotNull())

    def run(group: np.ndarray, c: Columns) -> tuple[np.ndarray, Columns]:
        return np.arange(int(group[-1]) + 1), solve(group, c)

    return per_groups(rows, [video], ["frame_id", "kind", "track_id", *BOX], run, f"{video} {dict(rows.dtypes)[video]}, {schema}")


def hota(gts: DataFrame, preds: DataFrame, video: str = "video") -> DataFrame:
    """video, hota, det_a, ass_a."""
    return _per_video(gts, preds, video, hota_figures, "hota double, det_a double, ass_a double")


def figures(gts: DataFrame, preds: DataFrame, threshold: float = 0.5, video: str = "video") -> DataFrame:
    """Per video: counts, MOTA, MOTP and IDF1."""
    out = _per_video(gts, preds, video, lambda group, c: clear_figures(group, c, threshold), "n_gt long, n_pred long, hits long, misses long, false_alarms long, switches long, overlap double, id_hits long")
    lost = F.col("misses") + F.col("false_alarms") + F.col("switches")
    return out.withColumns({"mota": 1 - safe_ratio(lost, F.col("n_gt")), "motp": safe_ratio(F.col("overlap"), F.col("hits")), "idf1": safe_ratio(2.0 * F.col("id_hits"), F.col("n_gt") + F.col("n_pred"))})
