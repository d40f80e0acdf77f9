"""Registered queries do the whole job: each test here fails on a cut of it."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.operators import assignment, detection, reports, retrieval, tracking_metrics
from siftwork.plans import adapters, catalog


def data_of(size):
    found = f"/root/testdata/{size}"
    if not os.path.isdir(found):
        pytest.skip("no test tables")
    return found


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_approximate_neighbours_against_exact_ones(spark, size):
    """Recall@10 of the registered query over its whole query set, without the query's own row."""
    data = data_of(size)
    exact, near = ({(r["qid"], r["id"]) for r in catalog.queries()[name](spark, data).collect() if r["qid"] != r["id"]} for name in ("knn_exact", "knn_approximate"))
    assert len(exact & near) >= 0.9 * len(exact) > 0


def test_all_levels_of_hota_and_average_precision(spark):
    """19 alphas and ten thresholds are registered, and each level equals a run for it alone."""
    data = data_of("sf0.001")
    hota = {r["alpha"]: r for r in catalog.queries()["track_hota"](spark, data).collect()}
    assert sorted(hota) == [round(0.05 * k, 2) for k in range(1, 20)]
    ap = {(r["threshold"], r["cls"]): r["ap"] for r in catalog.queries()["detection_ap"](spark, data).collect()}
    assert sorted({t for t, _ in ap}) == [round(0.5 + 0.05 * k, 2) for k in range(10)]
    gt, pred = adapters.truth_boxes(spark, data), adapters.found_boxes(spark, data)
    n_gt = gt.where("not ign").groupBy("cls").agg(F.count("*").alias("n_gt"))
    for t in (0.5, 0.75, 0.95):
        alone = detection.average_precision(detection.pr_curve(detection.outcomes(gt, pred, ["image_id", "cls"], t), n_gt))
        assert {c: v for (at, c), v in ap.items() if at == t} == {r["cls"]: r["ap"] for r in alone.collect()}
    truth, found = adapters.track_boxes(spark, data)
    for alpha in (0.05, 0.95):
        kinds = {r["kind"]: r["count"] for r in tracking_metrics.frame_matches(truth, found, alpha).groupBy("kind").count().collect()}
        assert hota[alpha]["deta"] == round(kinds.get("match", 0) / sum(kinds.values()), 6)


def crowd(spark, images=12, seed=3):
    """Truth and predictions of crowded images, where predictions compete for boxes and some boxes are ignored."""
    r = np.random.default_rng(seed)
    gt, pred = [], []
    for image in range(images):
        for pos in range(12):
            x, y = (float(v) for v in r.integers(0, 40, 2))
            gt.append((image, pos, "ab"[pos % 2], x, y, x + 30, y + 30, bool(r.random() < 0.2)))
            for k in range(2):
                dx, dy = (float(v) for v in r.integers(-6, 7, 2))
                pred.append((image, 2 * pos + k, "ab"[pos % 2], x + dx, y + dy, x + dx + 30, y + dy + 30, float(r.integers(30, 60)) / 100))
    box = "image_id long, pos long, cls string, x1 double, y1 double, x2 double, y2 double"
    return spark.createDataFrame(gt, box + ", ign boolean"), spark.createDataFrame(pred, box + ", conf double")


def test_boxes_are_judged_in_one_grouping_as_by_the_greedy_fold(spark):
    gt, pred = crowd(spark)
    keys = ["image_id", "cls"]
    judged = detection.judged(gt, pred, keys, detection.THRESHOLDS)
    assert "Join" not in judged._jdf.queryExecution().executedPlan().toString()  # rows are not copied a threshold and joined
    rows = judged.collect()
    assert len(rows) == pred.count()
    for k, t in enumerate(detection.THRESHOLDS):
        pairs = detection.candidates(gt, pred, keys, t)
        want = {(m["image_id"], m["cls"], m["pp"], m["gp"]) for m in detection.greedy(pairs, keys, t).collect()}
        assert {(r["image_id"], r["cls"], r["pp"], r["hits"][k]["gp"]) for r in rows if r["hits"][k]} == want
        soft = {(p["image_id"], p["cls"], p["pp"]) for p in pairs.where("ign").collect()}
        assert {(r["image_id"], r["cls"], r["pp"]) for r in rows if (r["soft"] or 0) >= t} == soft


def test_average_precision_reads_counted_levels_that_are_written_once(spark):
    rows = spark.range(2000).selectExpr("'a' AS cls", "id / 2000.0D AS conf", "CAST(id % 3 > 0 AS INT) AS tp", "CAST(id % 3 = 0 AS INT) AS fp")
    curve = detection.pr_curve(rows, rows.groupBy("cls").agg(F.sum("tp").alias("n_gt")))
    ap = detection.average_precision(curve)
    plan = ap._jdf.queryExecution().optimizedPlan().toString()
    assert all("/levels-" in f for f in curve.inputFiles()[:1]) and plan.count("Window") == 1  # before: three running sums, each over all of the one before
    points = [(r["precision"], r["recall"]) for r in curve.collect()]
    assert ap.first()["ap"] == pytest.approx(sum(max((p for p, x in points if x >= k * 0.01), default=0) for k in range(101)) / 101, abs=1e-6)
    edges = spark.createDataFrame([("a", k * 0.01, k / 100) for k in range(101)], "cls string, recall double, precision double")
    assert detection.average_precision(edges).first()["ap"] == pytest.approx(1.0)  # every level is reached by its own recall


def test_detection_failures_take_an_image_as_one_row(spark):
    gt, pred = crowd(spark)
    frames = spark.createDataFrame([(k, "night" if k % 2 else "day", "blurred") for k in range(11)], "image_id long, lighting string, blur_level string")
    found = reports.detection_failures(gt, pred, frames)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # the frames; before: ten joins
    causes = {r["cause"]: r["count"] for r in found.groupBy("cause").count().collect()}
    known, real = frames.select("image_id"), gt.where("NOT ign")
    matched = detection.greedy(detection.candidates(real, pred, ["image_id"]), ["image_id"]).join(known, "image_id").count()
    boxes, claims = (x.join(known, "image_id").count() for x in (real, pred))
    assert sum(n for c, n in causes.items() if c in ("duplicate_box_nms", "false_positive_background")) == claims - matched
    assert sum(n for c, n in causes.items() if "miss" in c or c == "localisation_drift") == boxes - matched


def matched_by_whole_frames(gt, pred, least):
    """The definition, over the full matrix of every frame: sticky pairs first, then the optimum."""
    out, last = set(), {}
    for seq, frame in sorted({r[:2] for r in gt}):
        g, p = (sorted(r[2:7] for r in rows if r[:2] == (seq, frame)) for rows in ([r for r in gt if not r[7]], pred))
        overlap = assignment.iou_matrix(np.array([r[1:] for r in g]), np.array([r[1:] for r in p]))
        of_g = {}
        for i, r in enumerate(g):
            j = next((j for j, x in enumerate(p) if x[0] == last.get((seq, r[0]))), None)
            if j is not None and j not in of_g.values() and overlap[i, j] >= least:
                of_g[i] = j
        a, b = [i for i in range(len(g)) if i not in of_g], [j for j in range(len(p)) if j not in of_g.values()]
        some = overlap[np.ix_(a, b)]
        of_g |= {a[x]: b[y] for x, y in assignment.solve(1 - some) if some[x, y] >= least}
        last |= {(seq, g[i][0]): p[j][0] for i, j in of_g.items()}
        out |= {(seq, frame, g[i][0], p[j][0]) for i, j in of_g.items()}
    return out


def test_competing_tracks_match_as_over_whole_frames(spark):
    r = np.random.default_rng(5)
    gt, pred = [], []
    for seq in range(2):
        for frame in range(25):
            for t in range(14):  # of all sizes; half of them crowd together, the others stand apart
                size = 2.0 ** (t % 6) + 3
                x = (60 + 3.0 * t if t < 7 else 1000.0 * t) + r.random() * 4
                gt.append((seq, frame, t, x, 0.0, x + size, size, t == 13))
                if r.random() < 0.85:
                    dx = r.random() * size / 2
                    pred.append((seq, frame, 100 + (t + (frame > 12) * (t < 3)) % 14, x + dx, 0.0, x + dx + size, size))
    box = "seq long, frame long, track_id long, x1 double, y1 double, x2 double, y2 double"
    g, p = spark.createDataFrame(gt, box + ", ign boolean"), spark.createDataFrame(pred, box)
    both = tracking_metrics.Matching(g, p)
    assert {x["gt_id"] for x in both.groups.collect()} <= set(range(7))  # those apart never go through the assignment
    levels = {}
    for least in (0.05, 0.3, 0.5, 0.7):
        want = matched_by_whole_frames(gt, pred, least)
        rows = tracking_metrics.frame_matches(g, p, least).collect()
        assert {(x["seq"], x["frame"], x["gt_id"], x["pred_id"]) for x in rows if x["kind"] == "match"} == want
        assert sum(x["kind"] in ("match", "miss") for x in rows) == sum(not x[7] for x in gt)
        assert sum(x["kind"] != "miss" for x in rows) == len(pred)
        levels[least] = len(want)
    for x in tracking_metrics.hota(g, p, tuple(levels)).collect():
        n = levels[x["alpha"]]
        assert x["deta"] == pytest.approx(n / (sum(not x[7] for x in gt) + len(pred) - n), abs=1e-6)


def test_a_frame_of_many_boxes_is_not_compared_pair_by_pair(spark):
    n = 40_000  # all in one frame: 1.6 billion pairs
    box = "0L AS seq, 0L AS frame, id AS track_id, id * 30.0D AS x1, 0.0D AS y1, id * 30.0D + 20 AS x2, 20.0D AS y2"
    rows = spark.range(n).selectExpr(*box.split(", "))
    gt = rows.withColumn("ign", F.lit(False))
    assert tracking_metrics.idf1(gt, rows).first()["idtp"] == n
    assert tracking_metrics.clear_mot(tracking_metrics.frame_matches(gt, rows)).first()["tp"] == n


def test_pairs_of_questions_and_documents_are_not_shuffled(spark):
    docs = spark.range(300).selectExpr("id", "concat('common words and w', id % 50, ' w', id % 7) AS text")
    asked = spark.range(40).selectExpr("id AS qid", "concat('common w', id) AS text")
    top = retrieval.bm25(docs, asked, 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid#" in plan and "hashpartitioning(id#" in plan
    assert not re.search(r"hashpartitioning\(qid#\d+L, id#", plan)  # each task keeps its k best before they meet
    assert {r["qid"] for r in top.collect()} == set(range(40))
