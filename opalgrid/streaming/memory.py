"""Trackers that remember embeddings: quasi-dense matching and mask-track matching.

Both give ids to the detections of one video, frame by frame; ``track_by_memory`` runs them per
video, as ``tracks.track`` runs the motion trackers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from opalgrid.operators.groups import changes, per_groups
from opalgrid.streaming.tracks import BOX, in_step, iou_matrix


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


class QuasiDense:
    """Tracklets with moving averages of their embeddings, and backdrops: recent detections that are no
    track, so that a later one that looks like them does not take a track's id. Similarity is the
    mean of the softmax over memories and the softmax over detections."""

    def __init__(self, start: float = 0.8, keep: float = 0.5, match: float = 0.5, frames: int = 10, backdrop_frames: int = 1, momentum: float = 0.8, backdrop_iou: float = 0.3, same_iou: float = 0.7):
        self.start, self.keep, self.match, self.frames, self.backdrop_frames = start, keep, match, frames, backdrop_frames
        self.momentum, self.backdrop_iou, self.same_iou = momentum, backdrop_iou, same_iou
        self.tracks: dict[int, dict] = {}
        self.backdrops: list[tuple[int, np.ndarray, int]] = []
        self.next = 0

    def step(self, frame: int, boxes: np.ndarray, scores: np.ndarray, labels: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Track id of each detection; -1: no track, -2: a double of a better one."""
        out = np.full(len(boxes), -1)
        order = np.argsort(-scores, kind="stable")
        limit = np.where(scores >= self.keep, self.same_iou, self.backdrop_iou)
        over = (iou_matrix(boxes, boxes) > limit[:, None]).tolist()
        kept: list[int] = []
        for i in order.tolist():
            own = over[i]
            if any(own[j] for j in kept):
                out[i] = -2
            else:
                kept.append(i)
        ids = sorted(self.tracks)
        memory = [(self.tracks[i]["feature"], self.tracks[i]["label"], i) for i in ids] + [(f, label, -1) for _, f, label in self.backdrops]
        if memory and kept:
            raw = features[kept] @ np.stack([m[0] for m in memory]).T
            alike = (_softmax(raw, 1) + _softmax(raw, 0)) / 2 * (labels[kept][:, None] == np.array([m[1] for m in memory])[None])
            for k, i in enumerate(kept):
                j = int(alike[k].argmax())
                if alike[k, j] > self.match and memory[j][2] >= 0 and scores[i] > self.keep:
                    out[i] = memory[j][2]
                    alike[k + 1 :, j] = 0
        for i in kept:
            if out[i] == -1 and scores[i] > self.start:
                out[i], self.next = self.next, self.next + 1
        for i in kept:
            if out[i] >= 0:
                self._renew(int(out[i]), frame, boxes[i], int(labels[i]), features[i])
        loose = [i for i in kept if out[i] == -1]
        self.backdrops = [b for b in self.backdrops if frame - b[0] < self.backdrop_frames] + [(frame, features[i], int(labels[i])) for i in loose]
        self.tracks = {i: t for i, t in self.tracks.items() if frame - t["frame"] < self.frames}
        return out

    def _renew(self, i: int, frame: int, box: np.ndarray, label: int, feature: np.ndarray) -> None:
        t = self.tracks.get(i)
        if t is None:
            self.tracks[i] = {"feature": feature, "box": box, "label": label, "frame": frame, "speed": np.zeros(4), "n": 0}
            return
        t["feature"] = (1 - self.momentum) * t["feature"] + self.momentum * feature
        moved = (box - t["box"]) / max(1, frame - t["frame"])
        t["speed"] = (t["speed"] * t["n"] + moved) / (t["n"] + 1)
        t["box"], t["label"], t["frame"], t["n"] = box, label, frame, t["n"] + 1


class MaskTrack:
    """Each detection takes its likeliest track, or a new one: the log-softmax of embedding products (a new
    track counts as 0) plus weighted score, overlap and equality of class. Of detections that want
    one track the likeliest gets it; the others get none."""

    def __init__(self, weights: tuple[float, float, float] = (1.0, 2.0, 10.0)):
        self.weights, self.next = weights, 0
        self.features, self.boxes, self.labels = np.empty((0, 0)), np.empty((0, 4)), np.empty(0, int)

    def step(self, frame: int, boxes: np.ndarray, scores: np.ndarray, labels: np.ndarray, features: np.ndarray) -> np.ndarray:
        out = np.full(len(boxes), -1)
        if not self.next:
            out[:] = np.arange(len(boxes))
            self.next, self.features, self.boxes, self.labels = len(boxes), features.copy(), boxes.copy(), labels.copy()
            return out
        n = self.next
        alike = np.concatenate([np.zeros((len(boxes), 1)), features @ self.features.T], axis=1)
        a, b, c = self.weights
        worth = np.log(_softmax(alike, 1) + 1e-12) + a * np.log(np.maximum(scores, 1e-12))[:, None]
        worth[:, 1:] += b * iou_matrix(boxes, self.boxes) + c * (labels[:, None] == self.labels[None])
        want, value = worth.argmax(axis=1), worth.max(axis=1)
        for i in np.argsort(-value, kind="stable").tolist():
            if want[i] == 0:
                out[i], self.next = self.next, self.next + 1
                self.features, self.boxes, self.labels = np.vstack([self.features, features[i]]), np.vstack([self.boxes, boxes[i]]), np.append(self.labels, labels[i])
            elif want[i] - 1 < n and want[i] - 1 not in out:
                k = out[i] = want[i] - 1
                self.features[k], self.boxes[k], self.labels[k] = features[i], boxes[i], labels[i]
        return out


def _softmax_of(x: np.ndarray, valid: np.ndarray, axis: int) -> np.ndarray:
    top = np.where(valid, x, -np.inf).max(axis=axis, keepdims=True, initial=-np.inf)
    e = np.where(valid, np.exp(np.where(valid, x - np.where(np.isfinite(top), top, 0), 0)), 0.0)
    total = e.sum(axis=axis, keepdims=True)
    return np.divide(e, total, out=np.zeros_like(e), where=total > 0)


def _iou_within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of ``a`` with every one of ``b``, video by video."""
    p, q = a[:, :, None], b[:, None]
    w = np.clip(np.minimum(p[..., 2], q[..., 2]) - np.maximum(p[..., 0], q[..., 0]), 0, None)
    i = w * np.clip(np.minimum(p[..., 3], q[..., 3]) - np.maximum(p[..., 1], q[..., 1]), 0, None)
    size = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
    u = size(p) + size(q) - i
    return np.where(u > 0, i / np.where(u > 0, u, 1), 0)


class MaskTracks:
    """MaskTrack for many videos in step: memories are videos by tracks. ``step`` gets the frame's detections as
    videos by places; ``there`` says which places are taken."""

    def __init__(self, videos: int, most: int, length: int, weights: tuple[float, float, float] = (1.0, 2.0, 10.0)):
        self.weights, self.next = weights, np.zeros(videos, int)
        self.features, self.boxes, self.labels = np.zeros((videos, most, length)), np.zeros((videos, most, 4)), np.zeros((videos, most), int)

    def step(self, at: np.ndarray, frame: np.ndarray, there: np.ndarray, boxes: np.ndarray, scores: np.ndarray, labels: np.ndarray, features: np.ndarray) -> np.ndarray:
        out = np.full(there.shape, -1)
        n = self.next[at]
        width = int(n.max())
        a, b, c = self.weights
        known = np.arange(width) < n[:, None]
        alike = np.concatenate([np.zeros((*there.shape, 1)), features @ self.features[at, :width].transpose(0, 2, 1)], axis=2)
        open_ = np.broadcast_to(np.concatenate([np.ones((len(at), 1), bool), known], axis=1)[:, None], alike.shape)
        worth = np.log(_softmax_of(alike, open_, 2) + 1e-12) + a * np.log(np.maximum(scores, 1e-12))[..., None]
        worth[..., 1:] += b * _iou_within(boxes, self.boxes[at, :width]) + c * (labels[:, :, None] == self.labels[at, :width][:, None])
        worth = np.where(open_, worth, -np.inf)
        want, value = worth.argmax(axis=2), np.where(there, worth.max(axis=2), -np.inf)
        value[n == 0] = -np.arange(there.shape[1])  # first frames: all are new tracks, in their order
        order = np.argsort(-value, axis=1, kind="stable")
        taken, rows = np.zeros((len(at), width + 1), bool), np.arange(len(at))
        for i in order.T:
            w, new = want[rows, i], there[rows, i] & (want[rows, i] == 0)
            old = there[rows, i] & (w > 0) & ~taken[rows, w]
            taken[rows[old], w[old]] = True
            k = np.where(new, self.next[at], w - 1)
            self.next[at[new]] += 1
            r = rows[new | old]
            own, place, k = at[r], i[r], k[r]
            out[r, place] = k
            self.features[own, k], self.boxes[own, k], self.labels[own, k] = features[r, place], boxes[r, place], labels[r, place]
        return out


KINDS = {"quasi_dense": QuasiDense, "mask_track": MaskTrack}
#: Most numbers that a block of videos in step compares: videos by detections of a frame by tracks.
CELLS = 4_000_000


def mask_track_videos(video: np.ndarray, frame: np.ndarray, boxes: np.ndarray, scores: np.ndarray, labels: np.ndarray, features: np.ndarray, **options) -> np.ndarray:
    """Track ids of the detections of many videos (-1: none), as MaskTrack gives them to each. Rows are sorted by
    video (numbers from 0), frame and id. Videos of like size are taken together."""
    out = np.full(len(video), -1)
    if not len(video):
        return out
    n = np.bincount(video)
    turn = np.cumsum(changes(video, frame)) - 1
    place = np.arange(len(video)) - np.searchsorted(turn, turn, "left")
    deep = np.zeros(len(n), int)
    np.maximum.at(deep, video, place + 1)
    level = np.ceil(np.log2(n * deep)).astype(int)
    for size in np.unique(level):
        same = np.flatnonzero(level == size)
        step = max(1, CELLS // (int(n[same].max()) * int(deep[same].max())))
        for some in np.split(same, range(step, len(same), step)):
            number = np.full(len(n), -1)
            number[some] = np.arange(len(some))
            mine = np.flatnonzero(number[video] >= 0)
            own = MaskTracks(len(some), int(n[some].max()), features.shape[1], **options)
            for rows in in_step(video[mine], frame[mine]):
                rows = mine[rows]
                at, r = np.unique(number[video[rows]], return_inverse=True)
                shape, cell = (len(at), int(place[rows].max()) + 1), (r, place[rows])
                there = np.zeros(shape, bool)
                there[cell] = True
                dense = []
                for x in (boxes, scores, labels, features):
                    y = np.zeros((*shape, *x.shape[1:]), x.dtype)
                    y[cell] = x[rows]
                    dense.append(y)
                out[rows] = own.step(at, frame[rows], there, *dense)[cell]
    return out


def track_by_memory(dets: DataFrame, kind: str, video: str = "video", frame: str = "frame_id", **options) -> DataFrame:
    """video, frame, det_id, track_id of detections with an embedding (array column ``feature``) and an
    integer ``label``. A video is one task: its memory is sequential. Mask tracks of many videos move in step."""
    types = dict(dets.dtypes)

    def solve(group: np.ndarray, c: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        rows = (c[frame].astype(int), np.stack([c[x] for x in BOX], axis=1), c["score"], c["label"].astype(int), c["feature"].astype(float))
        if kind == "mask_track":
            ids = mask_track_videos(group, *rows, **options)
        else:
            ids, ends = np.full(len(group), -1), np.append(np.flatnonzero(changes(group, rows[0])), len(group))
            own, of = None, -1
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if group[a] != of:
                    own, of = KINDS[kind](**options), group[a]
                ids[a:b] = own.step(int(rows[0][a]), *(x[a:b] for x in rows[1:]))
        at = np.flatnonzero(ids >= 0)
        return group[at], {frame: c[frame][at], "det_id": c["det_id"][at], "track_id": ids[at]}

    rows = dets.where(F.col(frame).isNotNull()).select(video, frame, "det_id", *[F.col(c).cast("double").alias(c) for c in BOX], F.col("score").cast("double").alias("score"), F.col("label").cast("int").alias("label"), "feature")
    return per_groups(rows, [video], rows.columns[1:], solve, f"{video} {types[video]}, {frame} {types[frame]}, det_id {types['det_id']}, track_id long", order=[frame, "det_id"])
