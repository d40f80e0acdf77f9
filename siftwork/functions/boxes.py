"""Box geometry: boxes are (x1, y1, x2, y2) with an exclusive far edge, as separate columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(x1, y1, x2, y2) -> Column:
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union, 0 where the union is empty."""
    inter = area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    return F.coalesce(inter / F.nullif(area(*a) + area(*b) - inter, F.lit(0.0)), F.lit(0.0))


def band(size: Column) -> Column:
    """Size band of an area: below 32^2 small, below 96^2 medium."""
    return F.when(size < 1024, "small").when(size < 9216, "medium").otherwise("large")


def yolo_to_xyxy(cx, cy, w, h, width, height) -> list[Column]:
    return [(cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height]


def xyxy_to_xyah(x1, y1, x2, y2) -> list[Column]:
    w, h = F.greatest(x2 - x1, F.lit(1e-6)), F.greatest(y2 - y1, F.lit(1e-6))
    return [x1 + w / 2, y1 + h / 2, w / h, h]


def xyah_to_xyxy(cx, cy, a, h) -> list[Column]:
    return [cx - a * h / 2, cy - h / 2, cx + a * h / 2, cy + h / 2]


def warp(m: Sequence[float], x1, y1, x2, y2) -> list[Column]:
    """The box around the corners after the affine map (a, b, c; d, e, f)."""
    a, b, c, d, e, f = m
    xs = [x * a + y * b + c for x in (x1, x2) for y in (y1, y2)]
    ys = [x * d + y * e + f for x in (x1, x2) for y in (y1, y2)]
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def crop(x1, y1, x2, y2, width, height, margin: float = 0.05, least: tuple[int, int] = (16, 32)) -> Column:
    """The box widened by `margin`, rounded half to even, clipped; null if too small to describe."""
    dx, dy = (x2 - x1) * margin, (y2 - y1) * margin
    cut = [F.greatest(F.lit(0), F.bround(x1 - dx)), F.greatest(F.lit(0), F.bround(y1 - dy)), F.least(width, F.bround(x2 + dx)), F.least(height, F.bround(y2 + dy))]
    cut = [c.cast("int") for c in cut]
    return F.when((cut[2] - cut[0] >= least[0]) & (cut[3] - cut[1] >= least[1]), F.struct(*[c.alias(n) for c, n in zip(cut, ("x1", "y1", "x2", "y2"), strict=True)]))


def lighting(brightness: Column, night: float = 60, dusk: float = 110) -> Column:
    return F.when(brightness < night, "night").when(brightness < dusk, "dusk").otherwise("day")


def count_error(reported: Column, truth: Column) -> Column:
    """Error of a count in percent of the truth; without truth 0 or 100."""
    return F.when(truth <= 0, F.when(reported == 0, 0.0).otherwise(100.0)).otherwise(F.round(100.0 * F.abs(reported - truth) / F.nullif(truth, F.lit(0)), 2))


def verdict(value: Column, target: float, at_least: bool = True) -> Column:
    return F.when(value >= target if at_least else value <= target, "PASS").otherwise("FAIL")
