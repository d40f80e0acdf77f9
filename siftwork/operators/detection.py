"""Box matching and detection metrics.

Matching is a fold in the JVM over the predictions of one image and class, best confidence first:
images are the unit of parallel work, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import boxes as B
from siftwork.operators import scan
from siftwork.session import written

XYXY = ("x1", "y1", "x2", "y2")
#: Overlaps of mAP50-95.
THRESHOLDS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))


def candidates(gt: DataFrame, pred: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Overlapping pairs by an equi-join on `keys`: gp, pp, conf, iou, ign. Rows have pos, box and, in gt, ign."""
    g = gt.select(*keys, F.col("pos").alias("gp"), *[F.col(c).alias(f"g_{c}") for c in XYXY], "ign")
    p = pred.select(*keys, F.col("pos").alias("pp"), *[F.col(c).alias(f"p_{c}") for c in XYXY], "conf")
    pairs = p.join(g, keys)
    return pairs.withColumn("iou", B.iou([F.col(f"p_{c}") for c in XYXY], [F.col(f"g_{c}") for c in XYXY])).where(F.col("iou") >= least)


def greedy(pairs: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """One-to-one matches (keys, pp, gp, iou): predictions by falling confidence take their best free box.

    Equal overlaps go to the later box. Only boxes that count are matched; see absorbed().
    """
    real = pairs.where(~F.col("ign") & (F.col("iou") >= least))
    each = real.groupBy(*keys, "pp", "conf").agg(F.collect_list(F.struct("iou", "gp")).alias("cand"))
    lists = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("key"), "pp", "cand"))).alias("ps"))
    fold = """
      aggregate(ps, CAST(array() AS ARRAY<STRUCT<pp:BIGINT,gp:BIGINT,iou:DOUBLE>>), (acc, p) -> concat(acc,
        transform(slice(reverse(sort_array(filter(p.cand, c -> NOT exists(acc, a -> a.gp = c.gp)))), 1, 1),
          c -> named_struct('pp', bigint(p.pp), 'gp', bigint(c.gp), 'iou', c.iou))))"""
    return lists.select(*keys, F.inline(F.expr(fold)))


def gathered(gt: DataFrame, pred: DataFrame, keys: list[str], least: float, truth: tuple[str, ...] = (), found: tuple[str, ...] = ()) -> DataFrame:
    """A row for each of `keys`: gs, its truth, and ps, its predictions by falling confidence, each with
    cand, the (iou, gp, ign) of the truth that overlaps enough. Nothing is joined: both sides meet in one grouping.
    """
    g = F.struct(F.col("pos").cast("long").alias("gp"), "ign", *XYXY, *truth)
    p = F.struct((-F.col("conf")).alias("key"), F.col("pos").cast("long").alias("pp"), "conf", *XYXY, *found)
    left, right = gt.select(*keys, g.alias("g")), pred.select(*keys, p.alias("p"))
    both = left.withColumn("p", F.lit(None).cast(right.schema["p"].dataType)).unionByName(right.withColumn("g", F.lit(None).cast(left.schema["g"].dataType)))
    sides = both.groupBy(*keys).agg(F.collect_list("g").alias("gs"), F.array_sort(F.collect_list("p")).alias("ps"))

    def near(p: Column) -> Column:
        pairs = F.transform("gs", lambda g: F.struct(B.iou([p[c] for c in XYXY], [g[c] for c in XYXY]).alias("iou"), g["gp"].alias("gp"), g["ign"].alias("ign")))
        return F.filter(pairs, lambda c: c["iou"] >= least)

    return sides.withColumn("ps", F.transform("ps", lambda p: F.struct(p["pp"].alias("pp"), p["conf"].alias("conf"), *[p[c].alias(c) for c in found], near(p).alias("cand"))))


def folded(ps: str, least: str) -> str:
    """greedy() in SQL over an array whose entries have pp and real, the (iou, gp) that count, best first: the list of (pp, gp, iou)."""
    return f"""
      aggregate({ps}, CAST(array() AS ARRAY<STRUCT<pp:BIGINT,gp:BIGINT,iou:DOUBLE>>), (acc, p) -> concat(acc,
        transform(slice(filter(p.real, c -> c.iou >= {least} AND NOT exists(acc, a -> a.gp = c.gp)), 1, 1),
          c -> named_struct('pp', p.pp, 'gp', c.gp, 'iou', c.iou))))"""


def with_real(sides: DataFrame, found: tuple[str, ...] = ()) -> DataFrame:
    """gathered() with real, the candidates that count, best first and later boxes first among equals, and soft, the most overlap with an ignored box."""
    real = lambda p: F.reverse(F.sort_array(F.transform(F.filter(p["cand"], lambda c: ~c["ign"]), lambda c: F.struct(c["iou"].alias("iou"), c["gp"].alias("gp")))))
    soft = lambda p: F.array_max(F.transform(F.filter(p["cand"], lambda c: c["ign"]), lambda c: c["iou"]))
    return sides.withColumn("ps", F.transform("ps", lambda p: F.struct(p["pp"].alias("pp"), p["conf"].alias("conf"), *[p[c].alias(c) for c in found], real(p).alias("real"), soft(p).alias("soft"))))


def judged(gt: DataFrame, pred: DataFrame, keys: list[str], thresholds: tuple[float, ...]) -> DataFrame:
    """(keys, pp, conf, soft, hits): every prediction with its (gp, iou) at each threshold, or null.

    soft is the most that it overlaps an ignored box. Where no prediction has a choice and none wants
    the box of another, its one candidate is its match at all thresholds that it reaches; else each
    threshold has a fold of its own.
    """
    sides = with_real(gathered(gt, pred, keys, min(thresholds))).where(F.size("ps") > 0)
    wanted = sides.withColumn("_gps", F.expr("flatten(transform(ps, p -> p.real.gp))"))
    plain = F.forall("ps", lambda p: F.size(p["real"]) <= 1) & (F.size(F.array_distinct("_gps")) == F.size("_gps"))
    levels = f"array({', '.join(f'{float(t)!r}D' for t in thresholds)})"
    none = "CAST(null AS STRUCT<gp:BIGINT,iou:DOUBLE>)"
    made = wanted.withColumn("_found", F.when(~plain, F.expr(f"transform({levels}, t -> {folded('ps', 't')})")))
    own = f"transform({levels}, t -> CASE WHEN get(p.real, 0).iou >= t THEN named_struct('gp', get(p.real, 0).gp, 'iou', get(p.real, 0).iou) ELSE {none} END)"
    fold = f"transform(_found, f -> CASE WHEN exists(f, a -> a.pp = p.pp) THEN transform(filter(f, a -> a.pp = p.pp), a -> named_struct('gp', a.gp, 'iou', a.iou))[0] ELSE {none} END)"
    each = F.expr(f"transform(ps, p -> named_struct('pp', p.pp, 'conf', p.conf, 'soft', p.soft, 'hits', CASE WHEN _found IS NULL THEN {own} ELSE {fold} END))")
    return made.select(*keys, F.inline(each))


def _verdict(hit: Column, least: float) -> tuple[Column, Column]:
    """tp and fp of a prediction: over an ignored box alone it is neither."""
    tp = hit.isNotNull()
    return tp.cast("int"), (~tp & ~F.coalesce(F.col("soft") >= least, F.lit(False))).cast("int")


def outcomes(gt: DataFrame, pred: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Every prediction with tp, fp and iou; an unmatched one over an ignored box is neither."""
    hit = F.col("hits")[0]
    tp, fp = _verdict(hit, least)
    return judged(gt, pred, keys, (least,)).select(*keys, "pp", "conf", tp.alias("tp"), fp.alias("fp"), hit["iou"].alias("iou"), hit["gp"].alias("gp"))


def _names(by: str | list[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def pr_curve(results: DataFrame, n_gt: DataFrame, by: str | list[str] = "cls") -> DataFrame:
    """Precision and recall after each prediction, in the order of confidence, for each value of `by`.

    Equal confidences are summed first; then running sums, which cut a large class into pieces.
    """
    return _curve(results.groupBy(*_names(by), "conf").agg(F.sum("tp").alias("t"), F.sum("fp").alias("f")), n_gt, _names(by))


def _curve(levels: DataFrame, n_gt: DataFrame, by: list[str]) -> DataFrame:
    """pr_curve() of (by, conf, t, f), which are written once: the running sums read them several times."""
    levels = written(levels, "levels")
    cum = scan.running(levels, by, [F.desc("conf")], -F.col("conf"), {"tp": ("sum", F.col("t")), "fp": ("sum", F.col("f"))}).join(n_gt, by)
    return cum.select(*by, "conf", "tp", "fp", (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), (F.col("tp") / F.nullif(F.col("n_gt"), F.lit(0))).alias("recall"))


def average_precision(curve: DataFrame, by: str | list[str] = "cls", points: int = 101) -> DataFrame:
    """Mean over recall levels of the best precision at that recall or a higher one.

    The best precision is taken first between two recall levels, so that `points` rows of a group are left to compare.
    """
    by = _names(by)
    level = lambda k: k * F.lit(0.01) if points == 101 else k / F.lit(float(points - 1))
    near = F.floor(F.col("recall") * (points - 1)).cast("int")
    last = F.greatest(*[F.when((level(near + d) <= F.col("recall")) & (near + d < points), near + d).otherwise(-1) for d in (-1, 0, 1)])  # the division may be off by a bit
    slots = curve.groupBy(*by, F.least(last, F.lit(points - 1)).alias("_slot")).agg(F.max("precision").alias("precision"))
    lists = slots.groupBy(*by).agg(F.collect_list(F.struct("_slot", "precision")).alias("_s"))
    best = lambda k: F.array_max(F.transform(F.filter("_s", lambda s: s["_slot"] >= k), lambda s: s["precision"]))
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), best), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return lists.select(*by, F.round(total / points, 6).alias("ap"))


def evaluate(gt: DataFrame, pred: DataFrame, thresholds: tuple[float, ...] = (0.5,), image: str = "image_id", cls: str = "cls") -> DataFrame:
    """(iou threshold, class, ap) for classes with truth; all thresholds share the candidates of one grouping.

    Predictions are counted by class and confidence, with a column a threshold, before thresholds become rows.
    """
    n_gt = gt.where(~F.col("ign")).groupBy(cls).agg(F.count("*").alias("n_gt")).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    verdicts = [_verdict(F.col("hits")[k], t) for k, t in enumerate(thresholds)]
    sums = [F.sum(v).alias(f"{name}{k}") for k, pair in enumerate(verdicts) for name, v in zip("tf", pair, strict=True)]
    wide = judged(gt, pred, [image, cls], thresholds).groupBy(cls, "conf").agg(*sums)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{k}").alias("t"), F.col(f"f{k}").alias("f")) for k, t in enumerate(thresholds)])
    ap = average_precision(_curve(wide.select(cls, "conf", F.inline(rows)), n_gt, ["threshold", cls]), ["threshold", cls])
    return n_gt.select("threshold", cls).join(ap, ["threshold", cls], "left").select("threshold", cls, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def mean_precision(ap: DataFrame, base: float = 0.5) -> DataFrame:
    """(map50, map50_95, classes): means of evaluate() over the classes, at the threshold `base` and over all of them."""
    own = F.avg(F.when(F.abs(F.col("threshold") - base) < 1e-9, F.col("ap")))
    return ap.agg(F.round(own, 6).alias("map50"), F.round(F.avg("ap"), 6).alias("map50_95"), F.count_distinct("cls").alias("classes"))


def operating_point(results: DataFrame, gt: DataFrame, conf: float = 0.25) -> DataFrame:
    """Counts, precision, recall, F1 and mean overlap of the predictions from `conf` on."""
    n = gt.where(~F.col("ign")).agg(F.count("*").alias("n_gt"))
    sums = results.where(F.col("conf") >= conf).agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"), F.round(F.avg(F.when(F.col("tp") == 1, F.col("iou"))), 6).alias("mean_iou"))
    p = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("tp") / F.nullif(F.col("n_gt"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return sums.crossJoin(n).select("tp", "fp", (F.col("n_gt") - F.col("tp")).alias("fn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), "mean_iou")


def confusion(gt: DataFrame, pred: DataFrame, least: float = 0.5, conf: float = 0.25, image: str = "image_id", cls: str = "cls") -> DataFrame:
    """(truth, predicted, n) of a match that ignores classes, with 'background' for the unmatched."""
    seen = pred.where(F.col("conf") >= conf)
    real = gt.where(~F.col("ign"))
    matched = greedy(candidates(real, seen, [image], least), [image], least)
    left = real.select(image, F.col("pos").alias("gp"), F.col(cls).alias("truth")).join(matched, [image, "gp"], "left")
    right = seen.select(image, F.col("pos").alias("pp"), F.col(cls).alias("predicted"))
    every = left.join(right, [image, "pp"], "full")
    none = F.lit("background")
    return every.groupBy(F.coalesce("truth", none).alias("truth"), F.coalesce("predicted", none).alias("predicted")).agg(F.count("*").alias("n"))
