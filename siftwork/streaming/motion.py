"""Camera motion between frames, from the boxes that neighbouring frames share.

A motion is a similarity: as complex numbers, a point z goes to m * z + t. Moving objects are
outliers to it, so that it is first taken from the pair of matches that most others agree with.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Matches below which the camera counts as still (a fixed value), how far one that agrees may be off, and pairs tried.
LEAST, TOLERANCE, TRIES = 8, 3.0, 200
STILL = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def similarity(before: np.ndarray, after: np.ndarray, seed: int = 7) -> tuple[float, ...]:
    """Six numbers, rows of the 2 x 3 matrix that takes `before` to `after` ([n, 2] each); STILL where it is undetermined."""
    a, b = (np.ascontiguousarray(x, float).view(complex).reshape(-1) for x in (before, after))
    n = len(a)
    if n < LEAST:
        return STILL
    one, two = np.triu_indices(n, 1)
    if len(one) > TRIES:
        some = np.random.default_rng(seed).choice(len(one), TRIES, replace=False)
        one, two = one[some], two[some]
    apart = a[one] - a[two]
    real = np.abs(apart) > 1e-6
    if not real.any():
        return STILL
    m = (b[one] - b[two])[real] / apart[real]
    t = b[one][real] - m * a[one][real]
    agrees = np.abs(m[:, None] * a + t[:, None] - b) <= TOLERANCE
    inside = agrees[agrees.sum(axis=1).argmax()]
    for _ in range(10):  # least squares over those that agree, until they stay the same
        x, y = a[inside], b[inside]
        x0, y0 = x.mean(), y.mean()
        spread = (np.abs(x - x0) ** 2).sum()
        if spread < 1e-9:
            return STILL
        scale = (np.conj(x - x0) * (y - y0)).sum() / spread
        shift = y0 - scale * x0
        now = np.abs(scale * a + shift - b) <= TOLERANCE
        if (now == inside).all() or now.sum() < 2:
            break
        inside = now
    return (scale.real, -scale.imag, shift.real, scale.imag, scale.real, shift.imag)


def camera_motion(detections: DataFrame, reach: float = 80.0) -> DataFrame:
    """(camera_id, frame, warp, matches): the motion from the frame before, for frames that have one before them.

    Boxes of one class match where each is the other's nearest within `reach`; equal distances: the smaller
    det_id. So of boxes with one centre only that with the smallest det_id can match, and the others are left
    out; neighbouring frames meet in cells as wide as `reach`, and a box looks at the nine around its own.
    """
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    every = detections.where(F.col("cls").isNotNull()).select("camera_id", "frame", "cls", "det_id", x.alias("x"), y.alias("y"))
    boxes = every.groupBy("camera_id", "frame", "cls", "x", "y").agg(F.min("det_id").alias("det_id"))
    cell = lambda v: F.floor(F.col(v) / F.lit(reach))
    near = lambda v: F.explode(F.sequence(cell(v) - 1, cell(v) + 1))
    placed = boxes.withColumn("_cx", cell("x")).withColumn("_cy", cell("y"))
    earlier = boxes.select("camera_id", (F.col("frame") + 1).alias("frame"), "cls", F.col("det_id").alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    around = earlier.withColumn("_cx", near("_x")).withColumn("_cy", near("_y"))
    far = F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))
    pairs = placed.join(around, ["camera_id", "frame", "cls", "_cx", "_cy"]).withColumn("far", far).where(F.col("far") <= reach)
    frame = ["camera_id", "frame"]
    own = pairs.groupBy(*frame, "det_id").agg(F.min(F.struct("far", "_id", "_x", "_y", "x", "y")).alias("p"))
    other = pairs.groupBy(*frame, "_id").agg(F.min(F.struct("far", "det_id")).alias("q")).select(*frame, "_id", F.col("q.det_id").alias("det_id"))
    both = own.select(*frame, "det_id", F.col("p._id").alias("_id"), "p").join(other, [*frame, "_id", "det_id"])
    points = both.groupBy(*frame).agg(F.array_sort(F.collect_list(F.array("p._x", "p._y", "p.x", "p.y"))).alias("points"))

    @F.pandas_udf("array<double>")
    def fitted(column: pd.Series) -> pd.Series:
        # Python runs for every row, also where the columns around it need no value: a frame without matches is STILL.
        rows = (np.array([] if points is None else [list(p) for p in points], float).reshape(-1, 4) for points in column)
        return pd.Series([list(similarity(p[:, :2], p[:, 2:])) for p in rows])

    follows = boxes.select(*frame).distinct().join(earlier.select(*frame).distinct(), frame, "left_semi")
    out = follows.join(points, frame, "left")
    still = F.array(*[F.lit(v) for v in STILL])
    return out.select(*frame, F.when(F.col("points").isNull(), still).otherwise(fitted(F.col("points"))).alias("warp"), F.coalesce(F.size("points"), F.lit(0)).alias("matches"))
