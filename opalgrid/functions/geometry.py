"""Box geometry as Column expressions: everything stays inside whole-stage codegen.

A box is four columns; ``Box("g_")`` names ``g_x1, g_y1, g_x2, g_y2``. NaN coordinates are
treated as missing (Spark sorts NaN above all numbers, the opposite of what a threshold wants).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "", qualifier: str = "") -> Box:
    q = f"{qualifier}." if qualifier else ""
    return Box(*(F.col(f"{q}{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))


def positive(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def width(b: Box, plus: int = 0) -> Column:
    return b.x2 - b.x1 + plus


def height(b: Box, plus: int = 0) -> Column:
    return b.y2 - b.y1 + plus


def area(b: Box, plus: int = 0) -> Column:
    """Zero for boxes with a negative side."""
    return positive(width(b, plus)) * positive(height(b, plus))


def centre(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2


def intersection(a: Box, b: Box, plus: int = 0) -> Column:
    return positive(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1) + plus) * positive(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1) + plus)


def union(a: Box, b: Box, plus: int = 0) -> Column:
    return area(a, plus) + area(b, plus) - intersection(a, b, plus)


def iou(a: Box, b: Box, plus: int = 0) -> Column:
    """0 where the union is empty. ``plus`` = 1 counts pixels, as older conventions do."""
    return safe_ratio(intersection(a, b, plus), union(a, b, plus))


def iou_floor(a: Box, b: Box, plus: int = 0, eps: float = 1e-6) -> Column:
    return intersection(a, b, plus) / F.greatest(union(a, b, plus), F.lit(eps))


def iof(a: Box, b: Box, plus: int = 0, eps: float = 1e-6) -> Column:
    """Intersection over the first box (foreground)."""
    return intersection(a, b, plus) / F.greatest(area(a, plus), F.lit(eps))


def enclosing(a: Box, b: Box) -> Box:
    return Box(F.least(a.x1, b.x1), F.least(a.y1, b.y1), F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2))


def giou(a: Box, b: Box, eps: float = 1e-6) -> Column:
    u, e = F.greatest(union(a, b), F.lit(eps)), F.greatest(area(enclosing(a, b)), F.lit(eps))
    return intersection(a, b) / u - (e - u) / e


def to_xywh(b: Box) -> tuple[Column, ...]:
    return b.x1, b.y1, b.x2 - b.x1, b.y2 - b.y1


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def to_cxcywh(b: Box) -> tuple[Column, ...]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2, b.x2 - b.x1, b.y2 - b.y1


def from_cxcywh(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def to_cxcyah(b: Box) -> tuple[Column, ...]:
    """Centre, aspect ratio (width over height), height."""
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2, safe_ratio(b.x2 - b.x1, b.y2 - b.y1), b.y2 - b.y1


def from_cxcyah(cx: Column, cy: Column, a: Column, h: Column) -> Box:
    return from_cxcywh(cx, cy, a * h, h)


def corners(b: Box) -> list[tuple[Column, Column]]:
    return [(b.x1, b.y1), (b.x2, b.y1), (b.x1, b.y2), (b.x2, b.y2)]


def around(points: list[tuple[Column, Column]]) -> Box:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def project(b: Box, m: list[list[float]]) -> Box:
    """Axis-aligned hull of the corners under a 3x3 homography."""
    out = []
    for x, y in corners(b):
        px, py, pw = (x * r[0] + y * r[1] + r[2] for r in m)
        out.append((px / pw, py / pw))
    return around(out)


def flip(b: Box, direction: str, w: Column | float, h: Column | float) -> Box:
    w, h = (c if isinstance(c, Column) else F.lit(c) for c in (w, h))
    across = direction in ("horizontal", "diagonal")
    down = direction in ("vertical", "diagonal")
    if not (across or down):
        raise ValueError(f"unknown direction {direction!r}")
    return Box(w - b.x2 if across else b.x1, h - b.y2 if down else b.y1, w - b.x1 if across else b.x2, h - b.y1 if down else b.y2)


def translate(b: Box, dx: Column | float, dy: Column | float) -> Box:
    return Box(b.x1 + dx, b.y1 + dy, b.x2 + dx, b.y2 + dy)


def clip(b: Box, w: Column | float, h: Column | float) -> Box:
    w, h = (c if isinstance(c, Column) else F.lit(c) for c in (w, h))
    inside = lambda c, hi: F.greatest(F.lit(0), F.least(c, hi))
    return Box(inside(b.x1, w), inside(b.y1, h), inside(b.x2, w), inside(b.y2, h))


def rescale(b: Box, sx: float, sy: float) -> Box:
    return Box(b.x1 * sx, b.y1 * sy, b.x2 * sx, b.y2 * sy)


def resize_about_centre(b: Box, sx: float, sy: float) -> Box:
    cx, cy, w, h = to_cxcywh(b)
    return from_cxcywh(cx, cy, w * sx, h * sy)


def rotate(b: Box, cx: float, cy: float, degrees: float) -> Box:
    """Hull of the corners turned by ``degrees`` (image coordinates) about a centre."""
    import math

    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    turned = [((x - cx) * c - (y - cy) * s + cx, (x - cx) * s + (y - cy) * c + cy) for x, y in corners(b)]
    return around(turned)


def from_distances(px: Column, py: Column, left: Column, top: Column, right: Column, bottom: Column) -> Box:
    return Box(px - left, py - top, px + right, py + bottom)


def to_distances(px: Column, py: Column, b: Box, most: float | None = None, eps: float = 0.1) -> tuple[Column, ...]:
    out = (px - b.x1, py - b.y1, b.x2 - px, b.y2 - py)
    return out if most is None else tuple(F.greatest(F.lit(0.0), F.least(c, F.lit(most - eps))) for c in out)


def within_image(b: Box, w: float, h: float, border: float = 0) -> Column:
    return (b.x1 >= -border) & (b.y1 >= -border) & (b.x2 < w + border) & (b.y2 < h + border)


def overlaps_image(b: Box, w: float, h: float) -> Column:
    return (b.x2 > 0) & (b.y2 > 0) & (b.x1 < w) & (b.y1 < h)


def holds_point(b: Box, px: Column, py: Column) -> Column:
    return (px > b.x1) & (px < b.x2) & (py > b.y1) & (py < b.y2)


def visible(b: Box, w: float, h: float) -> Column:
    """Positive area once clipped to the image, and positive sides before."""
    c = clip(b, w, h)
    return (c.x2 > c.x1) & (c.y2 > c.y1) & (width(b) >= 1) & (height(b) >= 1)


def from_normalised(b: Box, w: float, h: float, digits: int = 3) -> Box:
    """Fractions of the image to pixels, clamped, rounded."""
    put = lambda c, n: F.round(F.greatest(F.lit(0.0), F.least(c * n, F.lit(float(n)))), digits)
    return Box(put(b.x1, w), put(b.y1, h), put(b.x2, w), put(b.y2, h))


def valid(b: Box) -> Column:
    """Present, no NaN, positive sides."""
    known = b.x1.isNotNull() & b.y1.isNotNull() & b.x2.isNotNull() & b.y2.isNotNull()
    return known & ~F.isnan(b.x1.cast("double")) & ~F.isnan(b.y1.cast("double")) & ~F.isnan(b.x2.cast("double")) & ~F.isnan(b.y2.cast("double")) & (b.x2 > b.x1) & (b.y2 > b.y1)


def deltas(p: Box, g: Box, means=(0.0,) * 4, stds=(1.0,) * 4) -> tuple[Column, ...]:
    """Centre and log-size offsets of ``g`` from the proposal ``p``."""
    px, py, pw, ph = to_cxcywh(p)
    gx, gy, gw, gh = to_cxcywh(g)
    raw = ((gx - px) / pw, (gy - py) / ph, F.ln(gw / pw), F.ln(gh / ph))
    return tuple((c - m) / s for c, m, s in zip(raw, means, stds, strict=True))


def from_deltas(p: Box, d: tuple[Column, ...], means=(0.0,) * 4, stds=(1.0,) * 4, ratio: float = 16 / 1000) -> Box:
    import math

    dx, dy, dw, dh = (c * s + m for c, m, s in zip(d, means, stds, strict=True))
    px, py, pw, ph = to_cxcywh(p)
    most = F.lit(abs(math.log(ratio)))
    held = lambda c: F.greatest(-most, F.least(c, most))
    return from_cxcywh(px + pw * dx, py + ph * dy, pw * F.exp(held(dw)), ph * F.exp(held(dh)))


def tblr(p: Box, g: Box, normaliser: float = 4.0) -> tuple[Column, ...]:
    """Distances of the sides of ``g`` from the centre of ``p``, over its size."""
    cx, cy = centre(p)
    w, h = width(p), height(p)
    return tuple(c / normaliser for c in ((cy - g.y1) / h, (g.y2 - cy) / h, (cx - g.x1) / w, (g.x2 - cx) / w))


def from_tblr(p: Box, t: tuple[Column, ...], normaliser: float = 4.0) -> Box:
    cx, cy = centre(p)
    w, h = width(p), height(p)
    top, bottom, left, right = (c * normaliser for c in t)
    return Box(cx - left * w, cy - top * h, cx + right * w, cy + bottom * h)


def yolo_encode(p: Box, g: Box, stride: float, eps: float = 1e-6) -> tuple[Column, ...]:
    """Offsets of centres in cells (0 to 1, 0.5 = same place) and log ratios of sizes."""
    px, py, pw, ph = to_cxcywh(p)
    gx, gy, gw, gh = to_cxcywh(g)
    held = lambda c: F.greatest(F.lit(eps), F.least(c, F.lit(1 - eps)))
    return held((gx - px) / stride + 0.5), held((gy - py) / stride + 0.5), F.ln(F.greatest(gw / pw, F.lit(eps))), F.ln(F.greatest(gh / ph, F.lit(eps)))


def yolo_decode(p: Box, t: tuple[Column, ...], stride: float) -> Box:
    px, py, pw, ph = to_cxcywh(p)
    return from_cxcywh(px + (t[0] - 0.5) * stride, py + (t[1] - 0.5) * stride, pw * F.exp(t[2]), ph * F.exp(t[3]))


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of struct<x, y>."""
    turned = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    terms = F.zip_with(points, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


#: Box forms: to and from xyxy. ``convert`` goes between any two.
FORMS = {
    "xyxy": (lambda b: tuple(b), lambda *v: Box(*v)),
    "xywh": (to_xywh, from_xywh),
    "cxcywh": (to_cxcywh, from_cxcywh),
    "cxcyah": (to_cxcyah, from_cxcyah),
}


def convert(values: tuple[Column, ...], source: str, target: str) -> tuple[Column, ...]:
    return FORMS[target][0](FORMS[source][1](*values))


def corner_by_hash(key: Column, b: Box, clearance: float = 2.0) -> tuple[Column, Column]:
    """One of the four corners, moved inside by ``clearance``, by the MD5 of a key: stable on any
    cluster. (A seeded generator per row would need Python; the choice only has to be even.)"""
    k = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % 4
    return F.when(k % 2 == 0, b.x1 + clearance).otherwise(b.x2 - clearance), F.when(k < 2, b.y1 + clearance).otherwise(b.y2 - clearance)


def bucket_encode(p: Box, g: Box, buckets: int = 14, scale: float = 3.0) -> dict[str, tuple[Column, Column]]:
    """left, top, right, bottom of ``g`` as bucket number and offset: the proposal, widened by ``scale``, is
    cut in ``buckets`` along each axis, a side is looked for in the half next to it, and the offset is
    that of the bucket's centre in bucket widths."""
    wide, half = resize_about_centre(p, scale, scale), -(-buckets // 2)
    out = {}
    for name, edge, side, size, sign in (("left", wide.x1, g.x1, wide.x2 - wide.x1, 1), ("top", wide.y1, g.y1, wide.y2 - wide.y1, 1), ("right", wide.x2, g.x2, wide.x2 - wide.x1, -1), ("bottom", wide.y2, g.y2, wide.y2 - wide.y1, -1)):
        step = size / buckets
        k = F.greatest(F.lit(0), F.least(F.lit(half - 1), F.floor(sign * (side - edge) / step)))
        out[name] = (k, (edge + sign * (k + 0.5) * step - side) / step)
    return out


def bucket_decode(p: Box, code: dict[str, tuple[Column, Column]], buckets: int = 14, scale: float = 3.0) -> Box:
    """The box that bucket_encode was given."""
    wide = resize_about_centre(p, scale, scale)
    w, h = (wide.x2 - wide.x1) / buckets, (wide.y2 - wide.y1) / buckets
    back = lambda edge, step, sign, c: edge + sign * (c[0] + 0.5) * step - c[1] * step
    return Box(back(wide.x1, w, 1, code["left"]), back(wide.y1, h, 1, code["top"]), back(wide.x2, w, -1, code["right"]), back(wide.y2, h, -1, code["bottom"]))
