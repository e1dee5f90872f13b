"""Match costs between predictions and ground truth, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from opalgrid.functions.geometry import Box, giou, iou, to_cxcywh


def l1(a: Box, b: Box, form: str = "xyxy", weight: float = 1.0) -> Column:
    x, y = (tuple(a), tuple(b)) if form == "xyxy" else (to_cxcywh(a), to_cxcywh(b))
    return weight * sum((F.abs(p - q) for p, q in zip(x, y, strict=True)), F.lit(0.0))


def overlap(a: Box, b: Box, mode: str = "iou", weight: float = 1.0) -> Column:
    return -weight * (giou(a, b) if mode == "giou" else iou(a, b))


def classification(probability: Column, weight: float = 1.0) -> Column:
    return -weight * probability


def focal(probability: Column, alpha: float = 0.25, gamma: float = 2.0, weight: float = 1.0, eps: float = 1e-12) -> Column:
    """Cost of the target class: positive minus negative focal term."""
    p = probability
    return weight * (-F.ln(p + eps) * alpha * F.pow(1 - p, F.lit(gamma)) + F.ln(1 - p + eps) * (1 - alpha) * F.pow(p, F.lit(gamma)))


def dice(a: Column, b: Column, weight: float = 1.0, eps: float = 1e-3) -> Column:
    """One minus the soft overlap of two arrays of mask values."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    both = total(F.zip_with(a, b, lambda x, y: (x * y).cast("double")))
    return weight * (1 - (2 * both + eps) / (total(F.transform(a, lambda x: x.cast("double"))) + total(F.transform(b, lambda x: x.cast("double"))) + eps))


def cross_entropy(a: Column, b: Column, weight: float = 1.0, eps: float = 1e-12) -> Column:
    """Mean binary cross entropy of predicted values a and targets b (arrays)."""
    terms = F.zip_with(a, b, lambda x, y: -(y * F.ln(x + eps) + (1 - y) * F.ln(1 - x + eps)).cast("double"))
    return weight * F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / F.size(a)
