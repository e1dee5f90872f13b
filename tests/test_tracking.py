"""Trackers and their figures over many videos at once, against one video at a time."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from opalgrid.operators import assign as A
from opalgrid.streaming import mot, tracks as K


def walkers(videos: int, frames: int = 8, objects: int = 6, seed: int = 5) -> tuple[np.ndarray, ...]:
    """video, frame, box, score, embedding of objects that wander; some are missed, scores vary."""
    draw = np.random.default_rng(seed)
    v, f, k = (x.ravel() for x in np.meshgrid(np.arange(videos), np.arange(frames), np.arange(objects), indexing="ij"))
    corner = draw.uniform(0, 150, (videos, objects, 2))[v, k] + draw.normal(0, 3, (videos, objects, 2))[v, k] * f[:, None] + draw.normal(0, 1, (len(v), 2))
    box = np.concatenate([corner, corner + draw.uniform(30, 60, (videos, objects, 2))[v, k]], axis=1)
    feature = draw.normal(0, 1, (videos, objects, 3))[v, k] + draw.normal(0, 0.1, (len(v), 3))
    seen = draw.random(len(v)) < 0.85
    return v[seen], (f * (1 + v % 2))[seen], box[seen], draw.uniform(0.05, 1, len(v))[seen], (feature / np.linalg.norm(feature, axis=1, keepdims=True))[seen]


def one_by_one(v, f, box, score, feature, kind):
    out = np.full(len(v), -1)
    for video in np.unique(v):
        t = K.Tracker(kind, high=0.5, start=0.5)
        for frame in np.unique(f[v == video]):
            at = np.flatnonzero((v == video) & (f == frame))
            out[at] = t.step(int(frame), box[at], score[at], feature[at] if feature is not None else None)
    return out


def check_kind(kind):
    v, f, box, score, feature = walkers(25)
    feature = feature if kind == "strong" else None
    got = K.track_videos(v, f, box, score, feature, kind, high=0.5, start=0.5)
    assert (got == one_by_one(v, f, box, score, feature, kind)).all() and got.max() > 5


def test_sort_tracks_many_videos_in_step():
    check_kind("sort")


def test_a_thousand_videos_take_seconds():
    v, f, box, score, _ = walkers(1000)
    start = time.time()
    K.track_videos(v, f, box, score, None, "sort", high=0.5, start=0.5)
    assert time.time() - start < 10  # one video at a time: more than a minute


def test_few_bytes_are_still_dealt_over_many_tasks(spark):
    rows = spark.range(4000).select((F.col("id") % 200).alias("video"), (F.col("id") / 200).cast("long").alias("frame_id"), F.col("id").alias("det_id"), *[F.lit(float(x)).alias(c) for c, x in zip(K.BOX, (0, 0, 9, 9), strict=True)], F.lit(0.9).alias("score"))
    out = K.track(rows, "sort")
    assert out.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 4
    assert out.count() == 4000 and out.select("track_id").distinct().count() == 1
    assert K.track(rows.limit(0), "sort").count() == 0


@pytest.mark.parametrize("n", [1, 3, 6])
def test_heaviest_pairs_are_optimal(n):
    draw = np.random.default_rng(n)
    for _ in range(40):
        w = draw.uniform(-0.3, 1, (n, n + 2))
        a, b = np.nonzero(w > -1)
        far = 1000 * np.arange(len(a) + 1)[-1]
        ok = A.heaviest_pairs(np.append(a, a + far), np.append(b, b + far), np.append(w[a, b], w[a, b]))
        cost = -np.maximum(w, 0)
        r, c = A.linear_assignment(cost)
        for part in (ok[: len(a)], ok[len(a) :]):
            assert np.bincount(a[part]).max(initial=0) <= 1 and np.bincount(b[part]).max(initial=0) <= 1
            assert abs(w[a, b][part].sum() + cost[r, c].sum()) < 1e-9


def test_byte_tracks_many_videos_in_step():
    check_kind("byte")


def test_strong_tracks_many_videos_in_step():
    check_kind("strong")


def test_oc_tracks_many_videos_in_step():
    check_kind("oc")


def hota_of_one(part) -> dict:
    """HOTA, detection and association accuracy of one video, the mean over overlaps. Rows as in
    video_figures. Pairs of a frame are assigned to favour tracks that agree over the whole video."""
    frames = []
    for _, f in part.groupby("frame_id", sort=True):
        g, p = f[f["kind"] == "g"], f[f["kind"] == "p"]
        frames.append((g["track_id"].to_numpy(), p["track_id"].to_numpy(), K.iou_matrix(g[K.BOX].to_numpy(float), p[K.BOX].to_numpy(float))))
    own, theirs = (np.unique(np.concatenate([f[i] for f in frames])) for i in (0, 1))
    n_own, n_theirs, alike = np.zeros(len(own)), np.zeros(len(theirs)), np.zeros((len(own), len(theirs)))
    placed = [(np.searchsorted(own, a), np.searchsorted(theirs, b), o) for a, b, o in frames]
    for a, b, o in placed:
        n_own[a] += 1
        n_theirs[b] += 1
        total = o.sum(axis=0)[None] + o.sum(axis=1)[:, None] - o
        alike[np.ix_(a, b)] += np.divide(o, total, out=np.zeros_like(o), where=total > 1e-12)
    whole = n_own[:, None] + n_theirs[None] - alike
    alike = np.divide(alike, whole, out=np.zeros_like(alike), where=whole > 0)
    hits = np.zeros((len(mot.LEVELS), len(own), len(theirs)))
    for a, b, o in placed:
        if not o.size:
            continue
        r, c = A.linear_assignment(-(alike[np.ix_(a, b)] * o))
        for k, level in enumerate(mot.LEVELS):
            ok = o[r, c] >= level - 1e-12
            np.add.at(hits[k], (a[r[ok]], b[c[ok]]), 1)
    tp = hits.sum(axis=(1, 2))
    det = tp / np.maximum(1, n_own.sum() + n_theirs.sum() - tp)
    share = hits / np.maximum(1, n_own[None, :, None] + n_theirs[None, None] - hits)
    ass = (hits * share).sum(axis=(1, 2)) / np.maximum(1, tp)
    return {"hota": float(np.sqrt(det * ass).mean()), "det_a": float(det.mean()), "ass_a": float(ass.mean())}


def figures_input(kind="byte"):
    """Ground truth and tracks of many videos as columns, and the number of each row's video."""
    import pandas as pd

    v, f, box, score, _ = walkers(20)
    draw = np.random.default_rng(2)
    ids = K.track_videos(v, f, box, score, None, kind, high=0.5, start=0.5)
    truth = np.concatenate([np.arange(n) % 6 for n in np.bincount(v)])
    order = np.lexsort((truth, f, v))
    rows = [pd.DataFrame({"v": v, "frame_id": f, "kind": k, "track_id": t, **dict(zip(K.BOX, b.T, strict=True))}) for k, t, b in (("g", truth[order], box + draw.normal(0, 3, box.shape)), ("p", ids, box))]
    rows[0] = rows[0].drop_duplicates(["v", "frame_id", "track_id"])
    d = pd.concat([rows[0], rows[1][ids >= 0]]).sort_values(["v", "frame_id", "kind", "track_id"], ignore_index=True)
    return d, {c: d[c].to_numpy() for c in d.columns if c != "v"}, d["v"].to_numpy()


def test_hota_of_many_videos():
    d, c, v = figures_input()
    got = mot.hota_figures(v, c)
    for video, part in d.groupby("v"):
        want = hota_of_one(part)
        assert all(abs(got[k][video] - want[k]) < 1e-9 for k in want)
    assert 0.05 < got["hota"].mean() < 0.95


def clear_of_one(part, threshold: float) -> dict:
    """Counts of one video. Rows: kind ("g" or "p"), frame_id, track_id, box. A pair of the frame
    before stays while it overlaps enough; the rest is assigned anew at least cost."""
    hits = misses = alarms = switches = 0
    overlap, last, pairs = 0.0, {}, {}
    for _, f in part.groupby("frame_id", sort=True):
        g, p = f[f["kind"] == "g"], f[f["kind"] == "p"]
        gi, pi = g["track_id"].to_list(), p["track_id"].to_list()
        o = K.iou_matrix(g[K.BOX].to_numpy(float), p[K.BOX].to_numpy(float))
        free_g, free_p, now = list(range(len(gi))), list(range(len(pi))), []
        for a in range(len(gi)):
            b = pi.index(last[gi[a]]) if last.get(gi[a]) in pi else -1
            if b in free_p and o[a, b] >= threshold:
                now.append((a, b))
                free_g.remove(a)
                free_p.remove(b)
        if free_g and free_p:
            cost = np.where(o[np.ix_(free_g, free_p)] >= threshold, 1 - o[np.ix_(free_g, free_p)], 1e6)
            for a, b in zip(*A.assignment_with_limit(cost, 2.0), strict=True):
                if cost[a, b] < 1e6:
                    now.append((free_g[a], free_p[b]))
        for a, b in now:
            switches += gi[a] in last and last[gi[a]] != pi[b]
            last[gi[a]] = pi[b]
            overlap += o[a, b]
        hits, misses, alarms = hits + len(now), misses + len(gi) - len(now), alarms + len(pi) - len(now)
        for a, b in zip(*np.nonzero(o >= threshold), strict=True):
            pairs[gi[a], pi[b]] = pairs.get((gi[a], pi[b]), 0) + 1
    left, right = sorted({a for a, _ in pairs}, key=str), sorted({b for _, b in pairs}, key=str)
    m = np.zeros((len(left), len(right)))
    for (a, b), n in pairs.items():
        m[left.index(a), right.index(b)] = -n
    r, c = A.linear_assignment(m)
    return {"n_gt": int((part["kind"] == "g").sum()), "n_pred": int((part["kind"] == "p").sum()), "hits": hits, "misses": misses, "false_alarms": alarms, "switches": switches, "overlap": float(overlap), "id_hits": int(-m[r, c].sum())}


def test_clear_figures_of_many_videos():
    d, c, v = figures_input("sort")
    got = mot.clear_figures(v, c, 0.5)
    for video, part in d.groupby("v"):
        want = clear_of_one(part, 0.5)
        assert all(abs(got[k][video] - want[k]) < 1e-9 for k in want)
    assert got["switches"].sum() > 0


def test_clear_figures_where_a_video_has_no_pairs():
    d, c, v = figures_input("sort")
    far = (v == 3) & (c["kind"] == "p")
    for x in K.BOX:
        d.loc[far, x] += 1e4
    got = mot.clear_figures(v, {x: d[x].to_numpy() for x in d.columns if x != "v"}, 0.5)
    for video, part in d.groupby("v"):
        want = clear_of_one(part, 0.5)
        assert all(abs(got[k][video] - want[k]) < 1e-9 for k in want)
    assert got["hits"][3] == 0


def test_mask_tracks_of_many_videos():
    from opalgrid.streaming import memory

    v, f, box, score, feature = walkers(25)
    label = np.arange(len(v)) % 2
    got = memory.mask_track_videos(v, f, box, score, label, feature * 3)
    for video in range(25):
        one = memory.MaskTrack()
        for frame in np.unique(f[v == video]):
            at = np.flatnonzero((v == video) & (f == frame))
            assert (got[at] == one.step(int(frame), box[at], score[at], label[at], feature[at] * 3)).all()
    assert got.max() >= 5


def test_memory_tracks_are_dealt_over_many_tasks(spark):
    from opalgrid.streaming import memory

    rows = spark.range(4000).select((F.col("id") % 200).alias("video"), (F.col("id") / 200).cast("long").alias("frame_id"), F.col("id").alias("det_id"), *[F.lit(float(x)).alias(c) for c, x in zip(K.BOX, (0, 0, 9, 9), strict=True)], F.lit(0.9).alias("score"), F.lit(1).alias("label"), F.array(F.lit(1.0), F.lit(2.0)).alias("feature"))
    out = memory.track_by_memory(rows, "quasi_dense")
    assert out.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 4
    assert out.count() == 4000 and memory.track_by_memory(rows.limit(0), "mask_track").count() == 0
