"""Image files without an imaging library: sizes from headers, and segment ids of panoptic PNG files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opalgrid.session import ship

# The first bytes of PNG files, and JPEG markers that hold the frame's size.
PNG = b"\x89PNG\r\n\x1a\n"
FRAMES = frozenset([0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF])


def size_of(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG or JPEG file; None for anything else."""
    if data[:8] == PNG and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        if data[at + 1] in FRAMES:
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def image_sizes(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, width, height of files (as binaryFile reads them); null where no header is known."""
    ship(files.sparkSession)
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [size_of(d or b"") or (None, None) for d in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in found], pa.int32()) for i in (0, 1))], names=[key, "width", "height"])

    return files.select(key, content).mapInArrow(run, f"{key} {kind}, width int, height int")


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGB file of rows x columns x 3."""
    height, width, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.astype(np.uint8).reshape(height, -1)], axis=1)
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """rows x columns x 3 of an 8-bit RGB or RGBA file that is not interlaced."""
    width, height = size_of(data) or (0, 0)
    depth, colour, interlaced = data[24], data[25], data[28]
    if data[:8] != PNG or depth != 8 or colour not in (2, 6) or interlaced:
        raise ValueError("not a plain 8-bit RGB PNG")
    at, body = 8, []
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    step = 3 if colour == 2 else 4
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + step * width)
    out, before = np.zeros((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for y in range(height):
        before = out[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:], before, step)
    return out.reshape(height, width, step)[..., :3]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of pixels from its differences (the five row filters of the format)."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out = np.zeros(len(line) + step, np.int64)
    up = np.concatenate([np.zeros(step, np.int64), above.astype(np.int64)])
    for i, d in enumerate(line.tolist()):
        a, b, c = out[i], up[i + step], up[i]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i + step] = (d + guess) & 255
    return out[step:].astype(np.uint8)


def panoptic_segments(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, segment_id, n of panoptic PNG files: an id is R + 256 G + 65536 B, n its pixels."""
    ship(files.sparkSession)
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids, counts = [], [], []
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = decode_png(d).astype(np.int64)
                own, n = np.unique(p[..., 0] + 256 * p[..., 1] + 65536 * p[..., 2], return_counts=True)
                keys += [k] * len(own)
                ids += own.tolist()
                counts += n.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=[key, "segment_id", "n"])

    return files.select(key, content).mapInArrow(run, f"{key} {kind}, segment_id long, n long")


def panoptic_png(pixels: DataFrame, key: str) -> DataFrame:
    """key, content: one PNG for each key from its pixels (key, r, c, segment_id). An image is one group."""
    from opalgrid.operators.groups import per_group

    def solve(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = np.zeros((int(g["r"].max()) + 1, int(g["c"].max()) + 1, 3), np.uint8)
        for i in range(3):
            out[g["r"], g["c"], i] = (g["segment_id"] >> (8 * i)) & 255
        return {"content": np.array([encode_png(out)], object)}

    return per_group(pixels, [key], ["r", "c", "segment_id"], solve, f"{key} {dict(pixels.dtypes)[key]}, content binary")


def video_index(document: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """videos, annotations and categories of video-instance documents (JSON in ``value``). An annotation is a
    track: exploded, one row for each frame with a box (frame_id from 0)."""
    from pyspark.sql import functions as F

    schema = "videos array<struct<id:long,width:int,height:int,length:int>>, annotations array<struct<id:long,video_id:long,category_id:int,iscrowd:int,bboxes:array<array<double>>,areas:array<double>>>, categories array<struct<id:int,name:string>>"
    doc = document.select(F.from_json(value, schema).alias("d"))
    tracks = doc.select(F.inline("d.annotations")).select("id", "video_id", "category_id", "iscrowd", F.aggregate(F.filter("areas", lambda a: a.isNotNull()), F.lit(0.0), lambda s, a: s + a).alias("area_sum"), F.expr("size(filter(areas, a -> a is not null))").alias("n_areas"), F.posexplode("bboxes").alias("frame_id", "b")).where("b is not null")
    b = lambda i: F.get("b", F.lit(i))
    rows = tracks.select("id", "video_id", "category_id", "iscrowd", (F.col("area_sum") / F.col("n_areas")).alias("mean_area"), "frame_id", b(0).alias("x1"), b(1).alias("y1"), (b(0) + b(2)).alias("x2"), (b(1) + b(3)).alias("y2"))
    return doc.select(F.inline("d.videos")), rows, doc.select(F.inline("d.categories"))


def chosen_tracks(annotations: DataFrame, videos: list[int] | None = None, categories: list[int] | None = None, area: tuple[float, float] | None = None, crowd: int | None = None) -> DataFrame:
    """Tracks by video, category, mean area and crowd flag; None: any."""
    from pyspark.sql import functions as F

    tests = [F.col("video_id").isin(videos) if videos is not None else None, F.col("category_id").isin(categories) if categories is not None else None, F.col("mean_area").between(*area) if area is not None else None, F.col("iscrowd") == crowd if crowd is not None else None]
    for t in tests:
        annotations = annotations if t is None else annotations.where(t)
    return annotations
