"""Camera motion, the tracker that takes it, and the tracker in a stream."""

import math
import os
import random

import numpy as np
import pytest
from test_values import DETECTIONS, detections

from siftwork.operators import assignment
from siftwork.plans import catalog
from siftwork.streaming import motion, tracker


def planted(n, outliers, seed, angle=0.05, scale=1.02, shift=(12.0, -7.0), noise=0.3):
    r = np.random.default_rng(seed)
    a = r.uniform(0, 1000, (n, 2))
    turn = scale * np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
    b = a @ turn.T + np.array(shift) + r.normal(0, noise, (n, 2))
    b[: int(outliers * n)] += r.uniform(20, 200, (int(outliers * n), 2))
    order = r.permutation(n)
    return a[order], b[order], (*turn[0], shift[0], *turn[1], shift[1])


@pytest.mark.parametrize("n,outliers,seed", [(8, 0.0, 0), (20, 0.4, 1), (50, 0.4, 2), (200, 0.4, 3)])
def test_planted_motion_under_outliers(n, outliers, seed):
    a, b, want = planted(n, outliers, seed)
    found = motion.similarity(a, b)
    assert motion.similarity(a, b) == found  # the seed is fixed
    moved = lambda w: a @ np.array(w).reshape(2, 3)[:, :2].T + np.array(w).reshape(2, 3)[:, 2]
    assert np.abs(moved(found) - moved(want)).max() < 1.5


def test_undetermined_motion_is_none():
    a, b, _ = planted(7, 0, 1)
    assert motion.similarity(a, b) == motion.STILL
    assert motion.similarity(np.ones((9, 2)), np.ones((9, 2)) * 3) == motion.STILL
    assert motion.similarity(np.zeros((0, 2)), np.zeros((0, 2))) == motion.STILL


def panning(frames, step, people=12, walker=True):
    rows = []
    for f in frames:
        for k in range(people):
            x = 200.0 * k + step(f) + (3.0 * f if walker and k == 0 else 0)
            rows.append(("c", f, k, "person", 0.9, x, 10.0 * k, x + 40, 10.0 * k + 80, None))
    return rows


def test_motion_from_boxes_keeps_tracks(spark):
    jump = lambda f: 0.0 if f < 10 else 70.0  # noqa: E731  the camera is pushed once
    rows = spark.createDataFrame(panning(range(20), jump), DETECTIONS)
    found = {r["frame"]: r for r in motion.camera_motion(rows).collect()}
    assert sorted(found) == list(range(1, 20)) and found[10]["matches"] == 12
    assert abs(found[10]["warp"][2] - 70) < 1 and abs(found[9]["warp"][2]) < 1 and abs(found[10]["warp"][0] - 1) < 0.01
    ids = lambda m: len({r["track_id"] for r in tracker.track(rows, tracker.TRACKERS["botsort"], m).collect()})
    assert ids(motion.camera_motion(rows)) == 12 < ids(None)
    few = spark.createDataFrame(panning(range(3), jump, 5), DETECTIONS)
    assert {tuple(r["warp"]) for r in motion.camera_motion(few).collect()} == {motion.STILL}
    assert motion.camera_motion(rows.limit(0)).count() == 0


def row(r):
    return r["camera_id"], r["frame"], r["track_id"], r["cls"], round(r["x1"], 6), round(r["y2"], 6), r["restored"]


def test_live_tracks_equal_those_of_the_batch(spark, tmp_path):
    look = [1.0] + [0.0] * 31
    every = detections(range(30), look=look) + [("c", f, 0, None, None, None, None, None, None, None) for f in range(30, 99)] + detections(range(99, 110), look=look)
    rows = spark.createDataFrame(every + [("d", *r[1:]) for r in detections([f for f in range(60) if not 20 <= f < 26])], DETECTIONS)
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    settings = tracker.TRACKERS["botsort"]
    for low, high in ((0, 17), (17, 60), (60, 200)):
        rows.where(f"frame >= {low} AND frame < {high}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        tracker.run_live(stream, out, mark, settings)  # each run goes on from the checkpoint
    tracker.run_live(spark.readStream.schema(rows.schema).parquet(source), out, mark, settings)  # nothing new
    assert sorted(row(r) for r in tracker.live_tracks(spark, out).collect()) == sorted(row(r) for r in tracker.track(rows, settings).collect())
    assert any(r["restored"] for r in tracker.live_tracks(spark, out).collect())


def test_registered_live_tracker_equals_the_batch(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    live, batch = (sorted(row(r) for r in catalog.queries()[q](spark, data).collect()) for q in ("tracker_live", "tracker_bytetrack"))
    assert live == batch and live


def test_random_motions_are_recovered():
    r = random.Random(9)
    for seed in range(30):
        a, b, want = planted(r.randint(12, 60), r.choice([0, 0.2, 0.4]), seed, r.uniform(-0.2, 0.2), r.uniform(0.9, 1.1), (r.uniform(-60, 60), r.uniform(-60, 60)))
        found = np.array(motion.similarity(a, b)).reshape(2, 3)
        assert np.abs(a @ found[:, :2].T + found[:, 2] - a @ np.array(want).reshape(2, 3)[:, :2].T - np.array(want).reshape(2, 3)[:, 2]).max() < 2


def test_motion_where_some_frames_share_no_box(spark):
    """Frames 1 and 3 follow a frame that shares nothing with them; frame 2 has matches. Rows are in one batch."""
    rows = [(0, 0, 0.0), (1, 1, 5000.0)] + [(2, k, 5000.0 + k * 50) for k in range(10)] + [(3, k, 90_000.0) for k in range(3)] + [(4, k, 90_000.0) for k in range(3)]
    df = spark.createDataFrame([("c", f, k, "person", 0.9, x, 0.0, x + 40, 80.0, None) for f, k, x in rows], DETECTIONS).coalesce(1)
    found = {r["frame"]: r for r in motion.camera_motion(df).coalesce(1).collect()}
    assert {f: r["matches"] for f, r in found.items()} == {1: 0, 2: 1, 3: 0, 4: 1}
    assert {tuple(r["warp"]) for r in found.values()} == {motion.STILL}


def test_sparse_assignment_costs_what_the_whole_matrix_costs():
    rng = np.random.default_rng(3)
    for k in range(120):
        sides = []
        for n in rng.integers(1, 14, 2):
            low = rng.random((n, 2)) * 60
            boxes = np.c_[low, low + rng.random((n, 2)) * 30 + 1]
            sides.append(boxes[rng.integers(0, max(1, n // 2), n)] if k % 2 else boxes)  # odd turns: several equal boxes
        a, b = sides
        cost = 1 - assignment.iou_matrix(a, b)
        (first, rows), (second, cols) = assignment.equal_rows(a), assignment.equal_rows(b)
        i, j, overlap = assignment.overlapping(a[first], b[second])
        x, y, c = assignment.solve_sparse(i, j, 1 - overlap, rows, cols)
        assert len(set(x)) == len(x) and len(set(y)) == len(y) and np.allclose(cost[x, y], c)
        assert abs((1 - c).sum() - sum(1 - cost[p] for p in assignment.solve(cost))) < 1e-9


def test_a_crowd_is_tracked_without_the_whole_matrix_of_a_frame(monkeypatch):
    monkeypatch.setattr(assignment, "iou_matrix", None)
    monkeypatch.setattr(tracker, "iou_matrix", None)
    monkeypatch.setattr(tracker, "within", None)
    place = np.arange(600) // 3 * 60.0  # three equal boxes at each of 200 places
    for name in ("iou", "bytetrack", "botsort"):
        state = tracker.Tracker(tracker.TRACKERS[name])
        for f in range(5):
            boxes = np.c_[place + f, np.zeros(600), place + f + 40, np.full(600, 80.0)]
            seen = state.step(f, boxes, np.full(600, 0.9), np.full(600, "person", object), np.full(600, None, object))
        assert seen.id.tolist() == list(range(1, 601)) and np.allclose(np.sort(seen.mean[:, 0]), place + 4 + 20, atol=0.5)


def test_camera_motion_of_equal_boxes_takes_the_smallest_ids(spark):
    rows = [("c", f, p * 300 + k, "person", 0.9, 100.0 * p + 5 * f, 0.0, 100.0 * p + 5 * f + 40, 80.0) for f in range(2) for p in range(10) for k in range(300)]
    found = motion.camera_motion(spark.createDataFrame(rows, "camera_id string, frame long, det_id long, cls string, conf double, x1 double, y1 double, x2 double, y2 double"))
    assert "_cx" in found._jdf.queryExecution().toString()  # cells meet, not whole frames
    (got,) = found.collect()
    assert got["matches"] == 10 and np.allclose(got["warp"], [1, 0, 5, 0, 1, 0], atol=1e-9)
