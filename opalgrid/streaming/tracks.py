"""Tracking: gap filling in Catalyst, trackers as grouped state machines, a streaming buffer.

A tracker's state belongs to one video and moves frame by frame. In batch each video is one
grouped call over frames in order; as a stream the same step function runs on keyed state
with an event-time watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from opalgrid.operators.assign import assignment_with_limit, heaviest_pairs
from opalgrid.operators.groups import changes, meetings, per_groups
from opalgrid.session import ship

BOX = ["x1", "y1", "x2", "y2"]


def interpolate(tracks: DataFrame, min_frames: int = 5, max_gap: int = 20, video: str = "video", track: str = "track_id", frame: str = "frame_id") -> DataFrame:
    """Rows of tracks with more than ``min_frames`` rows (and three at least), gaps below ``max_gap``
    filled on the line between neighbours with score 1; shorter tracks stay as they are."""
    w = W.partitionBy(video, track)
    o = w.orderBy(frame)
    n = tracks.withColumns({"__n": F.count("*").over(w), "__next": F.lead(frame).over(o), **{f"__{c}": F.lead(c).over(o) for c in BOX}})
    gap = F.col("__next") - F.col(frame)
    fill = (F.col("__n") > min_frames) & (F.col("__n") >= 3) & (gap > 1) & (gap < max_gap)
    steps = F.when(fill, F.sequence(F.lit(0), (gap - 1).cast("int"))).otherwise(F.array(F.lit(0)))
    rows = n.withColumn("__s", F.explode(steps))
    at = F.when(F.col("__s") == 0, F.lit(0.0)).otherwise(F.col("__s") / gap)
    return rows.select(video, track, (F.col(frame) + F.col("__s")).alias(frame), *[F.when(F.col("__s") == 0, F.col(c)).otherwise(F.col(c) + (F.col(f"__{c}") - F.col(c)) * at).alias(c) for c in BOX], F.when(F.col("__s") == 0, F.col("score")).otherwise(1.0).alias("score"))


def smooth_tracks(tracks: DataFrame, length: float = 10.0, noise: float = 1.0, video: str = "video", track: str = "track_id", frame: str = "frame_id") -> DataFrame:
    """Gaussian smoothing of tracks, best after ``interpolate``: each coordinate becomes the mean of a Gaussian
    process over frames (squared exponential kernel of that length, noise relative to its variance) about the
    track's line of least squares. Frames, scores and the number of rows stay. One track is one group."""

    def solve(group: np.ndarray, g: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        n = np.bincount(group)
        first, at = np.cumsum(n) - n, g[frame].astype(float)
        value = np.stack([g[c].astype(float) for c in BOX], axis=1)
        out = np.empty_like(value)
        for size in np.unique(n):  # tracks of one length are solved in one call
            own = first[n == size]
            for some in np.split(own, range(step := max(1, 1_000_000 // int(size) ** 2), len(own), step)):
                rows = some[:, None] + np.arange(size)
                x, y = at[rows], value[rows]
                kernel = np.exp(-0.5 * ((x[:, :, None] - x[:, None, :]) / length) ** 2)
                off = (x - x.mean(axis=1, keepdims=True))[..., None]
                spread = (off**2).sum(axis=1, keepdims=True)
                slope = np.divide((off * y).sum(axis=1, keepdims=True), spread, out=np.zeros((len(y), 1, 4)), where=spread > 0)
                trend = y.mean(axis=1, keepdims=True) + off * slope
                out[rows] = trend + kernel @ np.linalg.solve(kernel + noise * np.eye(size), y - trend)
        return group, {frame: g[frame], "score": g["score"], **{c: out[:, i] for i, c in enumerate(BOX)}}

    kinds = dict(tracks.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (video, track, frame)) + "".join(f", {c} double" for c in [*BOX, "score"])
    return per_groups(tracks, [video, track], [frame, *BOX, "score"], solve, schema)


class Kalman:
    """Constant-velocity filter over centre, aspect ratio and height."""

    position, velocity = 1.0 / 20, 1.0 / 160

    def start(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = z[3]
        sd = np.array([2 * self.position * h, 2 * self.position * h, 1e-2, 2 * self.position * h, 10 * self.velocity * h, 10 * self.velocity * h, 1e-5, 10 * self.velocity * h])
        return np.append(z, np.zeros(4)), np.diag(sd**2)

    def predict(self, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mean[3]
        sd = np.array([self.position * h, self.position * h, 1e-2, self.position * h, self.velocity * h, self.velocity * h, 1e-5, self.velocity * h])
        move = np.eye(8)
        move[:4, 4:] = np.eye(4)
        return move @ mean, move @ cov @ move.T + np.diag(sd**2)

    def project(self, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mean[3]
        return mean[:4], cov[:4, :4] + np.diag(np.array([self.position * h, self.position * h, 1e-1, self.position * h]) ** 2)

    def update(self, mean: np.ndarray, cov: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, s = self.project(mean, cov)
        gain = np.linalg.solve(s, cov[:4]).T
        return mean + gain @ (z - m), cov - gain @ s @ gain.T

    def gate(self, mean: np.ndarray, cov: np.ndarray, zs: np.ndarray) -> np.ndarray:
        """Squared Mahalanobis distances of measurements."""
        m, s = self.project(mean, cov)
        d = zs - m
        return np.einsum("ij,ij->i", d, np.linalg.solve(s, d.T).T)


def to_state(b: np.ndarray) -> np.ndarray:
    w, h = b[2] - b[0], max(b[3] - b[1], 1e-6)
    return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, w / h, h])


def to_box(m: np.ndarray) -> np.ndarray:
    w = m[2] * m[3]
    return np.array([m[0] - w / 2, m[1] - m[3] / 2, m[0] + w / 2, m[1] + m[3] / 2])


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    w = np.clip(np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2]), 0, None)
    i = w[..., 0] * w[..., 1]
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    u = size(a)[:, None] + size(b)[None] - i
    return np.where(u > 0, i / np.where(u > 0, u, 1), 0)


class Tracker:
    """Tracks of one video; ``step`` takes a frame's boxes and scores and gives their track ids
    (-1: none). ``kind``: "sort" (one association), "byte" (high scores first, then low ones) or
    "oc" (adds a bonus for keeping direction and a last association with last seen boxes).
    With embeddings, "strong" mixes cosine distance into the first association."""

    def __init__(self, kind: str = "byte", high: float = 0.6, low: float = 0.1, start: float = 0.7, match: float = 0.1, retain: int = 30, confirm: int = 2, direction: float = 0.2, appearance: float = 0.9):
        self.kind, self.high, self.low, self.first, self.match, self.retain, self.confirm, self.direction, self.appearance = kind, high, low, start, match, retain, confirm, direction, appearance
        self.filter, self.tracks, self.next, self.frame0 = Kalman(), {}, 0, None

    def _associate(self, ids: list[int], boxes: np.ndarray, scores: np.ndarray | None, least: float, seen: bool = False, features: np.ndarray | None = None) -> list[tuple[int, int]]:
        if not ids or not len(boxes):
            return []
        mine = np.array([self.tracks[i]["box"] if seen else to_box(self.tracks[i]["mean"]) for i in ids])
        gain = iou_matrix(mine, boxes)
        allowed = gain > least
        value = gain * scores[None] if scores is not None else gain.copy()
        if self.kind == "oc" and not seen:
            centre = (boxes[:, :2] + boxes[:, 2:]) / 2
            for r, i in enumerate(ids):
                v, c = self.tracks[i]["speed"], (mine[r, :2] + mine[r, 2:]) / 2
                d = centre - c
                n = np.linalg.norm(d, axis=1) * max(np.linalg.norm(v), 1e-9)
                value[r] += self.direction * np.where(n > 1e-9, (d @ v) / np.maximum(n, 1e-9), 0) * 0.5
        if self.kind == "strong" and features is not None:
            own = np.array([self.tracks[i]["feature"] for i in ids])
            value = self.appearance * (own @ features.T) + (1 - self.appearance) * value
        cost = np.where(allowed, 1 - value, 1e6)
        r, c = assignment_with_limit(cost, 2.0)
        return [(ids[a], int(b)) for a, b in zip(r, c, strict=True) if allowed[a, b]]

    def _renew(self, i: int, box: np.ndarray, score: float, frame: int, feature: np.ndarray | None) -> None:
        t = self.tracks[i]
        t["mean"], t["cov"] = self.filter.update(t["mean"], t["cov"], to_state(box))
        t["speed"] = ((box[:2] + box[2:]) - (t["box"][:2] + t["box"][2:])) / 2 / max(1, frame - t["frame"])
        t["box"], t["frame"], t["hits"], t["score"] = box, frame, t["hits"] + 1, score
        if feature is not None and t["feature"] is not None:
            f = 0.9 * t["feature"] + 0.1 * feature
            t["feature"] = f / max(np.linalg.norm(f), 1e-12)

    def step(self, frame: int, boxes: np.ndarray, scores: np.ndarray, features: np.ndarray | None = None) -> np.ndarray:
        if self.frame0 is None:
            self.frame0 = frame
        self.tracks = {i: t for i, t in self.tracks.items() if frame - t["frame"] <= self.retain and (t["hits"] >= self.confirm or frame - t["frame"] <= 1 or t["born"] == self.frame0)}
        for t in self.tracks.values():
            t["mean"], t["cov"] = self.filter.predict(t["mean"], t["cov"])
        out = np.full(len(boxes), -1)
        strong = np.flatnonzero(scores >= self.high)
        weak = np.flatnonzero((scores < self.high) & (scores >= self.low)) if self.kind in ("byte", "oc") else np.empty(0, int)
        pick = lambda at: None if features is None else features[at]
        free = sorted(self.tracks)
        rounds = [(strong, scores[strong], self.match, False), (weak, None, 0.5, False)]
        if self.kind == "oc":
            rounds.append((strong, None, self.match, True))
        for at, weight, least, seen in rounds:
            at = at[out[at] < 0]
            near = [i for i in free if self.kind != "byte" or weight is not None or self.tracks[i]["frame"] == frame - 1]
            for i, k in self._associate(near, boxes[at], weight[: len(at)] if weight is not None and len(at) == len(weight) else (scores[at] if weight is not None else None), least, seen, pick(at)):
                out[at[k]] = i
                free.remove(i)
                self._renew(i, boxes[at[k]], float(scores[at[k]]), frame, None if features is None else features[at[k]])
        for k in strong:
            if out[k] < 0 and scores[k] >= self.first:
                mean, cov = self.filter.start(to_state(boxes[k]))
                self.tracks[self.next] = {"mean": mean, "cov": cov, "box": boxes[k], "frame": frame, "born": frame, "hits": 1, "score": float(scores[k]), "speed": np.zeros(2), "feature": None if features is None else features[k]}
                out[k] = self.next
                self.next += 1
        return out


def iou_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of boxes row by row."""
    w = np.clip(np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]), 0, None)
    i = w * np.clip(np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]), 0, None)
    u = (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1]) + (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) - i
    return np.where(u > 0, i / np.where(u > 0, u, 1), 0)


def in_step(group: np.ndarray, frame: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of all groups' first frames, then of their second ones, and so on. Rows are sorted by group and frame."""
    new = changes(group)
    own = np.cumsum(changes(group, frame)) - 1
    rank = own - own[new][np.cumsum(new) - 1]
    order = np.argsort(rank, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(rank[order])) + 1) if len(order) else ()


class Tracks:
    """State of the tracks of many videos, one row a track, by video and id. The filter is Kalman's: as its
    coordinates do not depend on each other, a covariance is four numbers for each of them."""

    def __init__(self, length: int):
        number, sides = (lambda: np.empty(0, int)), lambda n=4: np.empty((0, n))
        self.at = {"video": number(), "id": number(), "frame": number(), "born": number(), "hits": number(), "z": sides(), "dz": sides(), "pp": sides(), "pv": sides(), "vp": sides(), "vv": sides(), "box": sides(), "speed": sides(2), "feature": sides(length)}

    def keep(self, which: np.ndarray) -> None:
        self.at = {k: v[which] for k, v in self.at.items()}

    @staticmethod
    def _scaled(h: np.ndarray, by: float, third: float) -> np.ndarray:
        out = np.repeat((by * h)[:, None], 4, axis=1)
        out[:, 2] = third
        return out**2

    def predict(self) -> None:
        t, h = self.at, self.at["z"][:, 3]
        p, v = self._scaled(h, Kalman.position, 1e-2), self._scaled(h, Kalman.velocity, 1e-5)
        t["z"] = t["z"] + t["dz"]
        pv, vp = t["pv"] + t["vv"], t["vp"] + t["vv"]
        t["pp"], t["pv"], t["vp"], t["vv"] = (t["pp"] + t["vp"]) + pv + p, pv, vp, t["vv"] + v

    def boxes(self) -> np.ndarray:
        z = self.at["z"]
        w = z[:, 2] * z[:, 3]
        return np.stack([z[:, 0] - w / 2, z[:, 1] - z[:, 3] / 2, z[:, 0] + w / 2, z[:, 1] + z[:, 3] / 2], axis=1)

    @staticmethod
    def _state(b: np.ndarray) -> np.ndarray:
        w, h = b[:, 2] - b[:, 0], np.maximum(b[:, 3] - b[:, 1], 1e-6)
        return np.stack([(b[:, 0] + b[:, 2]) / 2, (b[:, 1] + b[:, 3]) / 2, w / h, h], axis=1)

    def renew(self, i: np.ndarray, box: np.ndarray, frame: np.ndarray, feature: np.ndarray) -> None:
        t = self.at
        s = t["pp"][i] + self._scaled(t["z"][i, 3], Kalman.position, 1e-1)
        kp, kv = t["pp"][i] / s, t["pv"][i] / s
        d = self._state(box) - t["z"][i]
        t["z"][i] += kp * d
        t["dz"][i] += kv * d
        for name, one, other in (("pp", kp, kp), ("pv", kp, kv), ("vp", kv, kp), ("vv", kv, kv)):
            t[name][i] -= one * s * other
        t["speed"][i] = ((box[:, :2] + box[:, 2:]) - (t["box"][i, :2] + t["box"][i, 2:])) / 2 / np.maximum(1, frame - t["frame"][i])[:, None]
        t["box"][i], t["frame"][i] = box, frame
        t["hits"][i] += 1
        if feature.shape[1]:
            f = 0.9 * t["feature"][i] + 0.1 * feature
            t["feature"][i] = f / np.maximum(np.linalg.norm(f, axis=1), 1e-12)[:, None]

    def start(self, video: np.ndarray, ids: np.ndarray, box: np.ndarray, frame: np.ndarray, feature: np.ndarray) -> None:
        z = self._state(box)
        none = np.zeros_like(z)
        new = {"video": video, "id": ids, "frame": frame, "born": frame, "hits": np.ones(len(ids), int), "z": z, "dz": none, "pp": self._scaled(z[:, 3], 2 * Kalman.position, 1e-2), "pv": none, "vp": none, "vv": self._scaled(z[:, 3], 10 * Kalman.velocity, 1e-5), "box": box, "speed": np.zeros((len(ids), 2)), "feature": feature}
        self.at = {k: np.concatenate([v, new[k]]) for k, v in self.at.items()}
        self.keep(np.argsort(self.at["video"], kind="stable"))


def track_videos(video: np.ndarray, frame: np.ndarray, boxes: np.ndarray, scores: np.ndarray, features: np.ndarray | None, kind: str, **options) -> np.ndarray:
    """Track ids of the detections of many videos (-1: none), as ``Tracker`` gives them to each: the first frames
    of all videos in one step, then the second ones. Rows are sorted by video (numbers from 0), frame and id."""
    o = Tracker(kind, **options)
    features = np.empty((len(boxes), 0)) if features is None else features
    out, tracks = np.full(len(boxes), -1), Tracks(features.shape[1])
    n_videos = int(video[-1]) + 1 if len(video) else 0
    following, now, there = np.zeros(n_videos, int), np.zeros(n_videos, int), np.zeros(n_videos, bool)
    frame0 = frame[changes(video)]

    def associate(free: np.ndarray, at: np.ndarray, least: float, weighted: bool, seen: bool) -> tuple[np.ndarray, np.ndarray]:
        t = tracks.at
        mine = t["box"] if seen else tracks.boxes()
        i, k = meetings(t["video"][free], video[at])
        i, k = free[i], at[k]
        gain = iou_of(mine[i], boxes[k])
        ok = gain > least
        i, k, gain = i[ok], k[ok], gain[ok]
        value = gain * scores[k] if weighted else gain
        if kind == "oc" and not seen:
            d, v = (boxes[k, :2] + boxes[k, 2:]) / 2 - (mine[i, :2] + mine[i, 2:]) / 2, t["speed"][i]
            n = np.linalg.norm(d, axis=1) * np.maximum(np.linalg.norm(v, axis=1), 1e-9)
            value = value + o.direction * np.where(n > 1e-9, (d * v).sum(axis=1) / np.maximum(n, 1e-9), 0) * 0.5
        if kind == "strong" and features.shape[1]:
            value = o.appearance * (t["feature"][i] * features[k]).sum(axis=1) + (1 - o.appearance) * value
        made = heaviest_pairs(i, k, 1 + value)  # an assignment at cost 1 - value with a limit of 2
        return i[made], k[made]

    for rows in in_step(video, frame):
        there[:] = False
        there[video[rows]], now[video[rows]] = True, frame[rows]
        t = tracks.at
        idle = now[t["video"]] - t["frame"]
        tracks.keep(there[t["video"]] & (idle <= o.retain) & ((t["hits"] >= o.confirm) | (idle <= 1) | (t["born"] == frame0[t["video"]])))
        tracks.predict()
        strong = rows[scores[rows] >= o.high]
        weak = rows[(scores[rows] < o.high) & (scores[rows] >= o.low)] if kind in ("byte", "oc") else rows[:0]
        rounds = [(strong, True, o.match, False), (weak, False, 0.5, False)]
        if kind == "oc":
            rounds.append((strong, False, o.match, True))
        free = np.ones(len(tracks.at["id"]), bool)
        for at, weighted, least, seen in rounds:
            at = at[out[at] < 0]
            t = tracks.at
            near = free if kind != "byte" or weighted else free & (t["frame"] == now[t["video"]] - 1)
            i, k = associate(np.flatnonzero(near), at, least, weighted, seen)
            out[k] = t["id"][i]
            free[i] = False
            tracks.renew(i, boxes[k], frame[k], features[k])
        new = strong[(out[strong] < 0) & (scores[strong] >= o.first)]
        if len(new):
            v = video[new]
            n = np.bincount(v, minlength=n_videos)
            out[new] = following[v] + np.arange(len(new)) - np.searchsorted(v, v, "left")
            following += n
            tracks.start(v, out[new], boxes[new], frame[new], features[new])
    return out


def track(dets: DataFrame, kind: str = "byte", video: str = "video", frame: str = "frame_id", **options) -> DataFrame:
    """Detections with track ids, per video. A video is one task, as its state is sequential; the videos of a
    task move on together. ``options`` are those of Tracker."""
    kinds = dict(dets.dtypes)
    schema = f"{video} {kinds[video]}, {frame} {kinds[frame]}, det_id {kinds['det_id']}, track_id long, x1 double, y1 double, x2 double, y2 double, score double"
    rows = dets.where(F.col(frame).isNotNull()).select(video, frame, "det_id", *[F.col(c).cast("double").alias(c) for c in BOX], F.col("score").cast("double").alias("score"), *(["feature"] if "feature" in dets.columns else []))
    columns = [c for c in rows.columns if c != video]

    def solve(group: np.ndarray, c: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        ids = track_videos(group, c[frame].astype(int), np.stack([c[x] for x in BOX], axis=1), c["score"], c.get("feature"), kind, **options)
        at = np.flatnonzero(ids >= 0)
        return group[at], {"track_id": ids[at], **{x: c[x][at] for x in (frame, "det_id", *BOX, "score")}}

    return per_groups(rows, [video], columns, solve, schema, order=[frame, "det_id"])


def link_tracklets(ends: DataFrame, video: str = "video", track_id: str = "track_id", frame: str = "frame_id", max_frames: int = 30, max_distance: float = 75.0, place: tuple[Column, Column] | None = None) -> DataFrame:
    """Pairs (a, b): b begins 1 to ``max_frames`` after a ends and near its place (the box's centre, if not
    given), the nearest in time and space for both. An interval join inside one video: starts are bucketed by frame."""
    w = W.partitionBy(video, track_id)
    cx, cy = place or ((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2)
    span = ends.withColumns({"cx": cx, "cy": cy}).groupBy(video, track_id).agg(F.min(F.struct(frame, "cx", "cy")).alias("s"), F.max(F.struct(frame, "cx", "cy")).alias("e"))
    a = span.select(video, F.col(track_id).alias("a"), "e", F.explode(F.array((F.col(f"e.{frame}") / max_frames).cast("long"), (F.col(f"e.{frame}") / max_frames).cast("long") + 1)).alias("bucket"))
    b = span.select(video, F.col(track_id).alias("b"), "s", (F.col(f"s.{frame}") / max_frames).cast("long").alias("bucket"))
    gap = F.col(f"s.{frame}") - F.col(f"e.{frame}")
    away = F.sqrt((F.col("s.cx") - F.col("e.cx")) ** 2 + (F.col("s.cy") - F.col("e.cy")) ** 2)
    p = a.join(b, [video, "bucket"]).where((gap > 0) & (gap <= max_frames) & (away <= max_distance) & (F.col("a") != F.col("b"))).select(video, "a", "b", gap.alias("gap"), away.alias("away"))
    p = p.withColumns({"ra": F.row_number().over(W.partitionBy(video, "a").orderBy("gap", "away", "b")), "rb": F.row_number().over(W.partitionBy(video, "b").orderBy("gap", "away", "a"))})
    return p.where("ra = 1 and rb = 1").select(video, "a", "b", "gap")


def running_top_k(stream: DataFrame, checkpoint: str, target: str, k: int, key: str = "cls", score: str = "score", row_id: str = "det_id"):
    """Structured Streaming: the best k of each key over all micro-batches so far, kept as a table
    under ``target``. Every batch writes a new version folder, so a replayed batch replaces only
    its own version."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = batch.limit(0) if number == 0 else spark.read.schema(batch.schema).parquet(f"{target}/v={number - 1}")
        w = W.partitionBy(key).orderBy(F.desc(score), row_id)
        both = before.unionByName(batch).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")
        both.write.mode("overwrite").parquet(f"{target}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def windowed_counts(stream: DataFrame, delay: str = "10 minutes", width: str = "5 minutes", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts of a stream per window and key; rows later than ``delay`` are left out."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def stateful_tracks(stream: DataFrame, video: str = "video", frame: str = "frame_id", time: str = "ts", delay: str = "1 minute", **options) -> DataFrame:
    """The tracker as keyed streaming state: each micro-batch of a video moves its tracker on; the
    state travels as JSON, so any executor can take over."""
    import json

    def dump(t: Tracker) -> str:
        return json.dumps({"next": t.next, "frame0": t.frame0, "tracks": {i: {k: (v.tolist() if isinstance(v, np.ndarray) else v) for k, v in x.items()} for i, x in t.tracks.items()}})

    def load(s: str) -> Tracker:
        d, t = json.loads(s), Tracker(**options)
        t.next, t.frame0 = d["next"], d["frame0"]
        t.tracks = {int(i): {k: (np.array(v) if isinstance(v, list) else v) for k, v in x.items()} for i, x in d["tracks"].items()}
        return t

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = load(state.get[0]) if state.exists else Tracker(**options)
        rows = pd.concat(list(parts)).sort_values([frame, "det_id"], ignore_index=True)
        for f, g in rows.groupby(frame, sort=True):
            ids = own.step(int(f), g[BOX].to_numpy(float), g["score"].to_numpy(float))
            yield g.assign(track_id=ids)[[video, frame, "det_id", "track_id"]]
        state.update((dump(own),))

    ship(stream.sparkSession)
    kinds = dict(stream.dtypes)
    return stream.withWatermark(time, delay).groupBy(video).applyInPandasWithState(run, f"{video} {kinds[video]}, {frame} {kinds[frame]}, det_id {kinds['det_id']}, track_id long", "state string", "append", "NoTimeout")
