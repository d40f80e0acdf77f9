"""CLEAR-MOT, IDF1 and HOTA, without gathering a sequence or comparing all boxes of a frame.

Boxes meet in cells of a grid of their own size. A box that overlaps one box alone, which overlaps no
other, matches it at every threshold that the overlap reaches; only tracks that ever compete for a
box go through the assignment, in order of frames, each group of competing tracks by itself.

Inputs: truth (seq, frame, track_id, x1, y1, x2, y2, ign) and predictions without ign.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions import boxes as B
from siftwork.operators.assignment import solve
from siftwork.session import written

XYXY = ["x1", "y1", "x2", "y2"]
ALPHAS = tuple(round(0.05 * k, 2) for k in range(1, 20))


def _level(rows: DataFrame) -> DataFrame:
    """Rows with an area, and the power of two that the longer side of the box fits in."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    longer = F.greatest(w, h)
    return rows.where((w > 0) & (h > 0) & (longer < float("inf"))).withColumn("_own", F.ceil(F.log2(longer)).cast("int"))


def _cells(rows: DataFrame, at: Column) -> DataFrame:
    """Rows once for each cell they touch at the grids `at` (an array of levels): four cells of a grid at most."""
    size = F.pow(F.lit(2.0), F.col("_l"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    return rows.withColumn("_l", F.explode(at)).withColumn("_cx", span("x1", "x2")).withColumn("_cy", span("y1", "y2"))


def box_pairs(gt: DataFrame, pred: DataFrame, carry: list[str], keep: list[str]) -> DataFrame:
    """Pairs of a frame with an overlap above 0: seq, frame, iou, `carry` of the truth and `keep` of the predictions.

    Two boxes meet in the grid of the larger one, in the cell where their overlap begins, so that boxes
    far from each other are never compared, however many a frame has and whatever their sizes.
    """
    g, p = _level(gt.select("seq", "frame", *carry, *XYXY)), _level(pred.select("seq", "frame", *keep, *XYXY))
    levels = sorted(r[0] for r in g.select("_own").union(p.select("_own")).distinct().collect())
    if not levels:
        levels = [0]
    every = F.array(*[F.lit(k) for k in levels])
    own, upper, above = F.array("_own"), F.filter(every, lambda k: k >= F.col("_own")), F.filter(every, lambda k: k > F.col("_own"))
    cell = ["seq", "frame", "_l", "_cx", "_cy"]

    def met(left: Column, right: Column) -> DataFrame:
        a = _cells(g, left).select(*cell, *carry, *[F.col(c).alias(f"g{c}") for c in XYXY])
        both = a.join(_cells(p, right).select(*cell, *keep, *XYXY), cell)
        size = F.pow(F.lit(2.0), F.col("_l"))
        begins = (F.floor(F.greatest("gx1", "x1") / size) == F.col("_cx")) & (F.floor(F.greatest("gy1", "y1") / size) == F.col("_cy"))
        iou = B.iou([F.col(f"g{c}") for c in XYXY], [F.col(c) for c in XYXY])
        return both.where(begins).withColumn("iou", iou).where("iou > 0").select("seq", "frame", "iou", *carry, *keep)

    out = met(own, upper)
    return out if len(levels) == 1 else out.unionByName(met(above, own))


def track_groups(edges: DataFrame) -> DataFrame:
    """(seq, gt_id, group) of distinct edges (seq, gt_id, pred_id): the smallest gt_id that a chain of edges reaches.

    Labels go over the predictions to the neighbours, and then to what the label itself has come to.
    """
    edges = written(edges, "edges")
    labels = edges.select("seq", "gt_id").distinct().withColumn("group", F.col("gt_id"))
    while True:
        labels = written(labels, "labels")
        of_p = edges.join(labels, ["seq", "gt_id"]).groupBy("seq", "pred_id").agg(F.min("group").alias("_least"))
        near = edges.join(of_p, ["seq", "pred_id"]).groupBy("seq", "gt_id").agg(F.min("_least").alias("_least"))
        jump = labels.select("seq", F.col("gt_id").alias("_least"), F.col("group").alias("_then"))
        now = labels.join(near, ["seq", "gt_id"]).join(jump, ["seq", "_least"], "left")
        now = written(now.select("seq", "gt_id", "group", F.least("_least", F.coalesce("_then", "_least")).alias("_new")), "labels")
        if now.where("_new < group").isEmpty():
            return labels
        labels = now.select("seq", "gt_id", F.col("_new").alias("group"))


class Matching:
    """The overlaps of two sides, and which of them match at a threshold."""

    def __init__(self, gt: DataFrame, pred: DataFrame):
        cols = ["seq", "frame", "track_id", *XYXY]
        self.gt = written(gt.select(*cols, "ign", F.monotonically_increasing_id().alias("_g")), "truth")  # written, so that row numbers stay
        self.pred = written(pred.select(*cols, F.monotonically_increasing_id().alias("_p")), "found")
        pairs = box_pairs(self.gt.withColumnRenamed("track_id", "gt_id"), self.pred.withColumnRenamed("track_id", "pred_id"), ["gt_id", "_g", "ign"], ["pred_id", "_p"])
        frame = ["seq", "frame", "ign"]
        rivals = lambda c: F.count("*").over(Window.partitionBy(*frame, c)) > 1
        self.pairs = written(pairs.repartition(*frame).withColumn("tangled", rivals("_g") | rivals("_p")), "pairs")
        self.real = self.pairs.where("NOT ign")
        tangled = self.real.where("tangled").select("seq", "gt_id", "pred_id").distinct()
        self.groups = None if tangled.isEmpty() else track_groups(tangled)

    def plain(self) -> DataFrame:
        """Pairs of the tracks that never compete: they match wherever they overlap enough."""
        return self.real if self.groups is None else self.real.join(self.groups, ["seq", "gt_id"], "left_anti")

    def contested(self, alphas: tuple[float, ...]) -> DataFrame | None:
        """Matches (alpha, seq, frame, iou, gt_id, pred_id, _g, _p) of the others."""
        if self.groups is None:
            return None
        rows = self.real.join(self.groups, ["seq", "gt_id"]).select("seq", "group", "frame", "iou", "gt_id", "pred_id", "_g", "_p")
        ordered = rows.repartition("seq", "group").sortWithinPartitions("seq", "group", "frame", "gt_id", "_g", "pred_id", "_p")
        return ordered.mapInPandas(lambda batches: _assigned(batches, alphas), "alpha double, seq long, frame long, iou double, gt_id long, pred_id long, _g long, _p long")

    def at(self, least: float) -> DataFrame:
        """Matches (seq, frame, iou, gt_id, pred_id, _g, _p) at one threshold."""
        names = ["seq", "frame", "iou", "gt_id", "pred_id", "_g", "_p"]
        plain, contested = self.plain().where(F.col("iou") >= least).select(*names), self.contested((least,))
        return plain if contested is None else plain.unionByName(contested.select(*names))


def _assigned(batches: Iterator[pd.DataFrame], alphas: tuple[float, ...]) -> Iterator[pd.DataFrame]:
    """The matches of rows in order of group and frame; a frame and the last pairs of a group's tracks are all that is held."""
    names = ["alpha", "seq", "frame", "iou", "gt_id", "pred_id", "_g", "_p"]
    group, last, held, out = None, {}, None, []

    def done(rows: pd.DataFrame) -> None:
        nonlocal group, last
        key = (rows.seq.iloc[0], rows.group.iloc[0])
        if key != group:
            group, last = key, {alpha: {} for alpha in alphas}
        gs, ps = (rows.drop_duplicates(own).sort_values([name, own], kind="stable") for name, own in (("gt_id", "_g"), ("pred_id", "_p")))
        gid, pid, g, p = gs.gt_id.tolist(), ps.pred_id.tolist(), gs._g.tolist(), ps._p.tolist()
        overlap = np.zeros((len(g), len(p)))
        at_g, at_p = ({r: i for i, r in enumerate(own)} for own in (g, p))
        overlap[[at_g[r] for r in rows._g], [at_p[r] for r in rows._p]] = rows.iou
        place = {t: j for j, t in reversed(list(enumerate(pid)))}
        for alpha in alphas:
            of_g, used, before = {}, set(), last[alpha]
            for i, t in enumerate(gid):  # a pair holds as long as nothing replaces it, also over gaps
                j = place.get(before.get(t))
                if j is not None and j not in used and overlap[i, j] >= alpha:
                    of_g[i] = j
                    used.add(j)
            rest_g, rest_p = [i for i in range(len(g)) if i not in of_g], [j for j in range(len(p)) if j not in used]
            some = overlap[np.ix_(rest_g, rest_p)]
            if some.size and some.max() >= alpha:
                of_g |= {rest_g[a]: rest_p[b] for a, b in solve(1 - some) if some[a, b] >= alpha}
            before |= {gid[i]: pid[j] for i, j in of_g.items()}
            out.extend((alpha, group[0], rows.frame.iloc[0], overlap[i, j], gid[i], pid[j], g[i], p[j]) for i, j in of_g.items())

    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        key = held[["seq", "group", "frame"]].to_numpy()
        ends = np.append(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(held)).tolist()
        for a, b in zip([0, *ends[:-1]], ends[:-1], strict=False):  # the last frame may go on in the next batch
            done(held.iloc[a:b])
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        held = held.iloc[ends[-2] if len(ends) > 1 else 0 :]
    if held is not None and len(held):
        done(held)
    if out:
        yield pd.DataFrame(out, columns=names)


def frame_matches(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """(seq, frame, gt_id, pred_id, iou, kind): matches that stick to a box's last pair where it
    overlaps enough, the optimum for the rest, without its pairs that overlap too little; kind
    'miss', 'extra' and 'ignored' for what is left. A prediction is in one match at most."""
    both = Matching(gt, pred)
    matches = both.at(least) if both.groups is None else written(both.at(least), "matches")
    none = F.lit(None).cast("long")
    near = both.pairs.where(F.col("ign") & (F.col("iou") >= least)).select("_p").distinct().withColumn("_near", F.lit("ignored"))
    missed = both.gt.where("NOT ign").join(matches.select("_g"), "_g", "left_anti").select("seq", "frame", F.col("track_id").alias("gt_id"), none.alias("pred_id"), F.lit(0.0).alias("iou"), F.lit("miss").alias("kind"))
    extra = both.pred.join(matches.select("_p"), "_p", "left_anti").join(near, "_p", "left")
    extra = extra.select("seq", "frame", none.alias("gt_id"), F.col("track_id").alias("pred_id"), F.lit(0.0).alias("iou"), F.coalesce("_near", F.lit("extra")).alias("kind"))
    return matches.select("seq", "frame", "gt_id", "pred_id", "iou", F.lit("match").alias("kind")).unionByName(missed).unionByName(extra)


def clear_mot(matches: DataFrame) -> DataFrame:
    """MOTA, MOTP, switches, fragments, mostly tracked, partly tracked and mostly lost of all sequences."""
    own = Window.partitionBy("seq", "gt_id").orderBy("frame")
    truth = matches.where("gt_id IS NOT NULL").withColumn("hit", (F.col("kind") == "match").cast("int"))
    truth = truth.withColumn("_pred", F.last("pred_id", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    truth = truth.withColumn("switch", ((F.col("hit") == 1) & (F.col("pred_id") != F.col("_pred"))).cast("int")).withColumn("run", ((F.col("hit") == 1) & (F.coalesce(F.lag("hit").over(own), F.lit(0)) == 0)).cast("int"))
    tracks = truth.groupBy("seq", "gt_id").agg(F.count("*").alias("n"), F.sum("hit").alias("tp"), F.sum(F.coalesce("switch", F.lit(0))).alias("idsw"), F.sum("run").alias("runs"), F.sum(F.when(F.col("hit") == 1, F.col("iou"))).alias("iou"))
    share = F.col("tp") / F.col("n")
    sums = tracks.agg(F.sum("n").alias("n_gt"), F.sum("tp").alias("tp"), F.coalesce(F.sum("idsw"), F.lit(0)).alias("idsw"), F.sum("iou").alias("iou"), F.count(F.when(share >= 0.8, 1)).alias("mt"), F.count(F.when((share > 0.2) & (share < 0.8), 1)).alias("pt"), F.count(F.when(share <= 0.2, 1)).alias("ml"), F.avg(F.greatest(F.col("runs") - 1, F.lit(0))).alias("fragments"))
    fp = matches.agg(F.count(F.when(F.col("kind") == "extra", 1)).alias("fp"))
    n, tp = F.col("n_gt"), F.col("tp")
    return sums.crossJoin(fp).select("n_gt", "tp", "fp", (n - tp).alias("fn"), "idsw", F.round(1 - (n - tp + F.col("fp") + F.col("idsw")) / F.nullif(n, F.lit(0)), 6).alias("mota"), F.round(F.col("iou") / F.nullif(tp, F.lit(0)), 6).alias("motp"), "mt", "pt", "ml", F.round("fragments", 6).alias("fragments"))


def overlaps(gt: DataFrame, pred: DataFrame, least: float) -> DataFrame:
    """(seq, gt_id, pred_id, n): frames in which two tracks overlap."""
    real = gt.where(~F.col("ign")).withColumnRenamed("track_id", "gt_id")
    hit = box_pairs(real, pred.withColumnRenamed("track_id", "pred_id"), ["gt_id"], ["pred_id"]).where(F.col("iou") >= least)
    return hit.groupBy("seq", "gt_id", "pred_id").agg(F.count("*").alias("n"))


def idf1(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """Identity scores of the best global pairing of tracks; tracks never pair across sequences.

    Tracks that no chain of overlaps joins are paired by themselves: with one track on a side the best
    pair is the longest, and only other groups need the assignment.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = pdf.gt_id.astype("category").cat, pdf.pred_id.astype("category").cat
        weight = np.zeros((len(rows.categories), len(cols.categories)))
        weight[rows.codes, cols.codes] = pdf.n
        return pd.DataFrame({"idtp": [int(sum(weight[r, c] for r, c in solve(-weight)))]})

    pairs = written(overlaps(gt, pred, least), "overlaps")
    grouped = pairs.join(track_groups(pairs.select("seq", "gt_id", "pred_id")), ["seq", "gt_id"])
    each = grouped.groupBy("seq", "group").agg((F.min("gt_id") == F.max("gt_id")).alias("_a"), (F.min("pred_id") == F.max("pred_id")).alias("_b"), F.max("n").alias("idtp"))
    stars = each.where("_a OR _b").select("idtp")
    others = grouped.join(each.where("NOT (_a OR _b)").select("seq", "group"), ["seq", "group"], "left_semi")
    paired = others.groupBy("seq", "group").applyInPandas(kernel, "idtp long")
    idtp = stars.unionByName(paired).agg(F.coalesce(F.sum("idtp"), F.lit(0)).alias("idtp"))
    sizes = gt.where(~F.col("ign")).agg(F.count("*").alias("n_gt")).crossJoin(pred.agg(F.count("*").alias("n_pred")))
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    t, g, p = F.col("idtp"), F.col("n_gt"), F.col("n_pred")
    return idtp.crossJoin(sizes).select("idtp", "n_gt", "n_pred", ratio(2 * t, g + p).alias("idf1"), ratio(t, p).alias("idp"), ratio(t, g).alias("idr"))


def hota(gt: DataFrame, pred: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(alpha, hota, deta, assa), frame matches by overlap alone at each alpha; ignored boxes absorb nothing."""
    both = Matching(gt, pred)
    pair = ["seq", "gt_id", "pred_id"]
    counts = lambda rows, hit: rows.groupBy(*pair).agg(*[F.count_if(hit(a)).alias(f"n{k}") for k, a in enumerate(alphas)])
    parts = counts(both.plain(), lambda a: F.col("iou") >= a)  # one row a pair of tracks, a column an alpha
    contested = both.contested(tuple(alphas))
    if contested is not None:
        parts = parts.unionByName(counts(contested, lambda a: F.col("alpha") == a))
    of_g = both.gt.where("NOT ign").groupBy("seq", F.col("track_id").alias("gt_id")).agg(F.count("*").alias("ng"))
    of_p = both.pred.groupBy("seq", F.col("track_id").alias("pred_id")).agg(F.count("*").alias("np"))
    n_gt, n_pred = (df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0] for df, c in ((of_g, "ng"), (of_p, "np")))
    levels = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"n{k}").alias("n")) for k, a in enumerate(alphas)])
    n = F.col("n")
    found = parts.join(of_g, ["seq", "gt_id"]).join(of_p, ["seq", "pred_id"]).select("ng", "np", F.inline(levels)).where("n > 0")
    found = found.groupBy("alpha").agg(F.sum(n).alias("tp"), F.sum(n * n / (F.col("ng") + F.col("np") - n)).alias("s"))
    every = gt.sparkSession.createDataFrame([(float(a),) for a in alphas], "alpha double").where(F.lit(n_gt + n_pred > 0))
    sums = every.join(F.broadcast(found), "alpha", "left").withColumn("tp", F.coalesce("tp", F.lit(0))).withColumn("fn", F.lit(n_gt) - F.col("tp")).withColumn("fp", F.lit(n_pred) - F.col("tp"))
    deta = F.col("tp") / F.nullif(F.col("tp") + F.col("fn") + F.col("fp"), F.lit(0))
    assa = F.coalesce(F.col("s") / F.nullif(F.col("tp"), F.lit(0)), F.lit(0.0))
    return sums.select("alpha", F.round(F.sqrt(F.coalesce(deta, F.lit(0.0)) * assa), 6).alias("hota"), F.round(F.coalesce(deta, F.lit(0.0)), 6).alias("deta"), F.round(assa, 6).alias("assa"))
