"""Names for things a caller picks at run time, and the protocol of metrics.

A metric is additive: ``partial`` turns rows into sums per slice, sums of any number of batches
add up, and ``final`` makes figures of them. So one metric serves a whole table, batches that
arrive one after the other, and slices of a data set.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, functions as F

from opalgrid.functions.geometry import safe_ratio
from opalgrid.operators import match


class Registry:
    """name -> builder. Names are unique; an unknown one raises with the nearest that exist."""

    def __init__(self, kind: str):
        self.kind, self._builders = kind, {}

    def register(self, name: str) -> Callable[[Any], Any]:
        def put(builder: Any) -> Any:
            if name in self._builders:
                raise ValueError(f"{self.kind} {name} is registered twice")
            self._builders[name] = builder
            return builder

        return put

    def get(self, name: str) -> Any:
        if name not in self._builders:
            near = difflib.get_close_matches(name, self._builders)
            raise KeyError(f"no {self.kind} {name}" + (f"; did you mean {', '.join(near)}?" if near else ""))
        return self._builders[name]

    def build(self, setting: str | dict[str, Any]) -> Any:
        """From a name, or a dict with ``type`` and the builder's options."""
        options = {"type": setting} if isinstance(setting, str) else dict(setting)
        return self.get(options.pop("type"))(**options)

    def names(self) -> list[str]:
        return sorted(self._builders)


class Metric(Protocol):
    """``sums``: name -> column that adds up over rows; ``figures``: name -> column of those sums."""

    def sums(self) -> dict[str, Column]: ...

    def figures(self) -> dict[str, Column]: ...


METRICS = Registry("metric")
#: TP/FP rules; an own one has the arguments of match.tpfp_voc and gives keys, det_id, score, tp, fp.
RULES = Registry("rule")
for _name, _rule in match.TPFP.items():
    RULES.register(_name)(_rule)


def partial(metric: Metric, rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(*[F.sum(c).alias(n) for n, c in metric.sums().items()])


def merge(metric: Metric, parts: list[DataFrame], by: list[str] | None = None) -> DataFrame:
    """Sums of several batches added up."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*(by or [])).agg(*[F.sum(n).alias(n) for n in metric.sums()])


def final(metric: Metric, sums: DataFrame, by: list[str] | None = None, prefix: str = "") -> DataFrame:
    """by, name, value: one row for each figure."""
    items = [F.struct(F.lit(prefix + n).alias("name"), c.cast("double").alias("value")) for n, c in metric.figures().items()]
    return sums.select(*(by or []), F.inline(F.array(*items)))


def evaluate(settings: list[str | dict[str, Any]], batches: list[DataFrame], by: list[str] | None = None, prefix: str = "") -> DataFrame:
    """by, name, value of metrics by name over batches of rows."""
    out = None
    for s in settings:
        metric = METRICS.build(s)
        part = final(metric, merge(metric, [partial(metric, b, by) for b in batches], by), by, prefix)
        out = part if out is None else out.unionByName(part)
    return out


@METRICS.register("overlap")
class Overlap:
    """Mean IoU and shares of rows at thresholds. Rows: iou (null counts as 0)."""

    def __init__(self, thresholds: tuple[float, ...] = (0.5, 0.75), column: str = "iou"):
        self.thresholds, self.iou = thresholds, F.coalesce(F.col(column), F.lit(0.0))

    def sums(self) -> dict[str, Column]:
        return {"n": F.lit(1), "s": self.iou, **{f"h{i}": (self.iou >= t).cast("int") for i, t in enumerate(self.thresholds)}}

    def figures(self) -> dict[str, Column]:
        share = lambda c: safe_ratio(F.col(c).cast("double"), F.col("n"))
        return {"mean_iou": share("s"), **{f"pr_{round(100 * t)}": share(f"h{i}") for i, t in enumerate(self.thresholds)}}


@METRICS.register("cumulative_overlap")
class CumulativeOverlap:
    """Sum of intersections over sum of unions. Rows: i, u."""

    def sums(self) -> dict[str, Column]:
        return {"i": F.col("i"), "u": F.col("u")}

    def figures(self) -> dict[str, Column]:
        return {"cum_iou": safe_ratio(F.col("i"), F.col("u"))}


@METRICS.register("accuracy")
class Accuracy:
    """Share of rows whose prediction is the target; unread predictions are left out."""

    def __init__(self, pred: str = "pred_id", target: str = "target_id"):
        self.read, self.right = F.col(pred).isNotNull(), F.coalesce(F.col(pred) == F.col(target), F.lit(False))

    def sums(self) -> dict[str, Column]:
        return {"n": self.read.cast("int"), "h": (self.read & self.right).cast("int")}

    def figures(self) -> dict[str, Column]:
        return {"id_accuracy": safe_ratio(F.col("h").cast("double"), F.col("n"))}
