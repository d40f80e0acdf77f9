"""Hand-computed values and literal fixtures."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.functions import boxes as B
from siftwork.functions import text as T
from siftwork.functions import vectors as V
from siftwork.operators import detection, ingest, labels, metrics, reports, retrieval, tracking_metrics, tracks
from siftwork.operators.assignment import iou_matrix, solve, within
from siftwork.sources import files
from siftwork.streaming import tracker


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(0).alias("_")]).select(column.alias("x")).first()["x"]


def test_ranking_values(spark):
    hits = spark.createDataFrame([("q", f"c{k}", k) for k in range(1, 6)], "qid string, id string, rank long")
    grades = spark.createDataFrame([("q", "c2", 3), ("q", "c5", 2), ("q", "c1", 1)], "qid string, id string, grade int")
    at3, at5 = metrics.ranking(hits, grades, 3).first(), metrics.ranking(hits, grades, 5).first()
    assert at3["precision"] == pytest.approx(1 / 3, abs=1e-6) and at5["precision"] == 0.4 and at3["recall"] == 0.5 and at3["rr"] == 0.5
    assert at3["dcg"] == pytest.approx(5.416508, abs=1e-6) and at3["ndcg"] == pytest.approx(0.576667, abs=1e-5)
    assert metrics.ranking(hits, grades, 1).first()["hit"] == 0 and at3["hit"] == 1 and metrics.ranking(hits, grades, 10).first()["ap"] == pytest.approx(0.45)


def test_fusion_values(spark):
    leg = lambda ids: spark.createDataFrame([("q", i, k + 1) for k, i in enumerate(ids)], "qid string, id string, rank long")
    found = {r["id"]: r["score"] for r in retrieval.rrf([leg(["d1", "d2"]), leg(["d3", "d1"])]).collect()}
    assert found["d1"] == pytest.approx(0.032522, abs=1e-6) and found["d2"] == pytest.approx(1 / 62)


def test_dense_filter_and_empty_store(spark):
    store = spark.createDataFrame([("a", [1.0, 0.0], "md"), ("b", [0.9938837, 0.1104315], "md"), ("c", [0.0, 1.0], "txt")], "id string, vec array<float>, kind string")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, qvec array<float>")
    assert [r["id"] for r in retrieval.knn(store, q).orderBy("rank").collect()] == ["a", "b", "c"]
    assert {r["id"] for r in retrieval.knn(store, q, where={"kind": "md"}).collect()} == {"a", "b"}
    assert retrieval.knn(store, q, where={"kind": ["pdf"]}).count() == 0 and retrieval.knn(store.limit(0), q).count() == 0


def test_lexical(spark):
    docs = spark.createDataFrame([("c1", "error ERR_4092 means a failed sync"), ("c2", "travel needs approval"), ("c3", "the booking of a hotel")], "id string, text string")
    ask = lambda t: retrieval.bm25(docs, spark.createDataFrame([("q", t)], "qid string, text string")).orderBy("rank").collect()
    assert ask("what is ERR_4092")[0]["id"] == "c1" and ask("zebra") == []
    assert one(spark, T.tokenize(F.lit("The Cost of a Booking"))) == ["cost", "booking"]


BOX = "image_id long, cls string, pos long, x1 double, y1 double, x2 double, y2 double"


def outcome(spark, gts, preds):
    g = spark.createDataFrame([(1, "a", k, *map(float, b), s) for k, (b, s) in enumerate(gts)], BOX + ", ign boolean")
    p = spark.createDataFrame([(1, "a", k, *map(float, b), c) for k, (b, c) in enumerate(preds)], BOX + ", conf double")
    return [(r["tp"], r["fp"]) for r in detection.outcomes(g, p, ["image_id", "cls"]).orderBy(F.desc("conf")).collect()]


def test_matching_values(spark):
    box, near, far = (0, 0, 10, 10), (1, 0, 11, 10), (7, 0, 17, 10)
    assert outcome(spark, [(box, False)], [(box, 0.9), (near, 0.8)]) == [(1, 0), (0, 1)]
    assert outcome(spark, [(box, False)], [(near, 0.95), (box, 0.6)]) == [(1, 0), (0, 1)]
    assert outcome(spark, [(box, False)], [(far, 0.9)]) == [(0, 1)]
    assert outcome(spark, [(box, True)], [(box, 0.9)]) == [(0, 0)]
    assert outcome(spark, [(box, True), (near, False)], [(near, 0.9)]) == [(1, 0)]


def test_average_precision_value(spark):
    rows = spark.createDataFrame([("a", 0.9, 1, 0), ("a", 0.8, 0, 1), ("a", 0.7, 1, 0)], "cls string, conf double, tp int, fp int")
    n = spark.createDataFrame([("a", 2)], "cls string, n_gt long")
    assert detection.average_precision(detection.pr_curve(rows, n)).first()["ap"] == pytest.approx((51 + 50 * 2 / 3) / 101, abs=1e-6)


def boxes_of(spark, rows, ign=True):
    made = [(1, f, t, 30.0 * f, 0.0, 30.0 * f + 20, 20.0) + ((False,) if ign else ()) for f, t in rows]
    return spark.createDataFrame(made, "seq long, frame long, track_id long, x1 double, y1 double, x2 double, y2 double" + (", ign boolean" if ign else ""))


def test_tracking_values(spark):
    score = lambda g, p: tracking_metrics.clear_mot(tracking_metrics.frame_matches(boxes_of(spark, g), boxes_of(spark, p, False))).first()
    five = [(f, 1) for f in range(5)]
    r = score(five, five[:3])
    assert (r["fn"], r["mota"]) == (2, 0.6)
    six = [(f, 1) for f in range(6)]
    r = score(six, [(f, 1 if f < 3 else 2) for f in range(6)])
    assert r["idsw"] == 1 and r["mota"] == pytest.approx(5 / 6, abs=1e-6)
    r = score(six, [(f, 1 if f < 3 else 2) for f in range(6) if f != 3])
    assert (r["idsw"], r["fn"]) == (1, 1)
    g, p = boxes_of(spark, six), boxes_of(spark, six, False)
    assert all(x["hota"] == 1.0 for x in tracking_metrics.hota(g, p, (0.5, 0.9)).collect())
    assert tracking_metrics.idf1(g, p).first()["idf1"] == 1.0


def test_assignment_is_optimal():
    r = np.random.default_rng(0)
    for _ in range(80):
        n, m = map(int, r.integers(1, 6, 2))
        cost = r.integers(0, 9, (n, m)).astype(float)
        k = min(n, m)
        best = min(sum(cost[i, j] for i, j in zip(a, b, strict=True)) for a in itertools.permutations(range(n), k) for b in itertools.combinations(range(m), k))
        assert len(solve(cost)) == k and sum(cost[i, j] for i, j in solve(cost)) == best
    assert within(np.array([[0.2, 0.9], [0.8, 0.95]]), 0.9) and solve(np.zeros((0, 3))) == []
    assert iou_matrix([[0, 0, 10, 10]], [[0, 0, 10, 10], [5, 0, 15, 10]]).tolist() == [[1.0, pytest.approx(1 / 3)]]


def test_label_issues(spark):
    lines = ["0 .5 .5 .2", "x .5 .5 .2 .2", "9 .5 .5 .2 .2", "0 1.5 .5 .2 .2", "0 .5 .5 0 .2", "0 .05 .5 .4 .2", "0 .5 .5 .2 .4"]
    rows = labels.parse_labels(spark.createDataFrame([("i", k, x) for k, x in enumerate(lines)], "image_id string, line_no int, line string"), 4).orderBy("line_no").collect()
    assert [r["issue"] for r in rows] == ["bad_field_count", "unparseable", "bad_class_id", "out_of_range", "degenerate_box", "box_out_of_frame", None]
    got = spark.range(1).select(*B.yolo_to_xyxy(F.lit(0.5), F.lit(0.5), F.lit(0.2), F.lit(0.4), 1000, 500)).first()
    assert [round(x, 6) for x in got] == [400, 150, 600, 350]


def test_mot_round_trip(spark):
    rows = labels.parse_mot(spark.createDataFrame([("# x",), ("",), ("1,7,10,20,30,40",), ("2,7,10,20,30,40,0.5,1,0.2",)], "line string"))
    got = rows.orderBy("frame").collect()
    assert (got[0]["conf"], got[0]["visibility"], got[0]["ignore"], got[1]["ignore"]) == (1.0, 1.0, False, True)
    assert labels.to_mot(rows).first()["line"] == "1,7,10.00,20.00,30.00,40.00,1.0000,0,1.000"
    assert labels.to_yolo(rows, 100, 100).collect()[0]["line"] == "0 0.250000 0.400000 0.300000 0.400000"
    with pytest.raises(Exception, match="fewer than 6"):
        labels.parse_mot(spark.createDataFrame([("1,2,3",)], "line string")).collect()


def test_splits(spark):
    rows = [(i, f"s{i % 9}", f"v{i % 9}", "day" if i % 3 else "night", "train", 1) for i in range(300)]
    m = spark.createDataFrame(rows, "image_id long, scene_id string, source_video string, lighting string, split string, n_objects int")
    found = labels.assign_splits(m).collect()
    assert len({r["scene_id"] for r in found}) == len(found) == 9 and {r["split"] for r in found} == {"train", "val", "test"}
    labels.assert_no_leak(m)
    bad = m.withColumn("split", F.when(F.col("image_id") % 2 == 0, "val").otherwise("train"))
    with pytest.raises(ValueError, match="several splits"):
        labels.assert_no_leak(bad)
    assert labels.dataset_hash(m).first() == labels.dataset_hash(m.orderBy(F.desc("image_id"))).first() != labels.dataset_hash(bad).first()


def test_texts(spark):
    assert one(spark, T.join_hyphenated(F.lit("infor-\n mation"))) == "information"
    assert one(spark, T.fix_ligatures(F.lit("“ﬁne”…"))) == '"fine"...'
    assert one(spark, T.strip_page_numbers(F.lit("a\nPage 3\n- 4 -\n2/10\nb"))) == "a\nb"
    assert one(spark, T.clean(F.lit("x y  z\n\n\n\nＡ"))) == "x y z\n\nA"
    assert one(spark, T.normalize_citations(F.lit("a 【2†x】 b [03] (4)"))) == "a [2] b [3] (4)"
    v = spark.range(1).select(T.validate_citations(F.lit("yes [2] and [9] ."), F.lit(5)).alias("v")).first()["v"]
    assert v["valid"] == [2] and v["text"] == "yes [2] and ."
    j = spark.range(1).select(T.parse_judgement(F.lit('x {"faithful": 1, "relevant": 1} y')).alias("a"), T.parse_judgement(F.lit("none")).alias("b")).first()
    assert j["a"]["faithful"] == 1 and j["b"]["claim"] == "unparseable"
    assert one(spark, T.slug(F.lit("A b/C-d.md"))) == "a_b_c_d" and one(spark, T.heading(F.lit("## Scope of it"))) == "Scope of it"
    assert one(spark, V.sigmoid(F.lit(-800.0))) == 0.0 and one(spark, B.count_error(F.lit(44), F.lit(40))) == 10.0


def test_splitter_and_chunks(spark):
    text = "\n\n".join("Sentence number %d goes on for a while. And then ends." % k for k in range(60))
    pieces = ingest.split_text(text, 200)
    assert all(0 < len(p) <= 200 for p in pieces) and "".join("".join(pieces).split()) == "".join(text.split())
    assert ingest.split_text("x" * 450, 200) == ["x" * 200, "x" * 200, "x" * 50] and ingest.split_text("  ", 10) == []
    pages = spark.createDataFrame([("d", 1, "# Intro\n" + text), ("e", 1, "# Intro\n" + text), ("f", 1, None)], "doc_id string, page_no int, text string")
    chunks = ingest.chunk_pages(pages)
    kept = ingest.keep_first(chunks)
    assert kept.count() * 2 == chunks.count() and kept.select("chunk_id").distinct().count() == kept.count()
    assert {r["heading"] for r in kept.collect()} == {"Intro"}


def test_tracks(spark):
    rows = spark.createDataFrame([(1, f, "p", float(f - 3)) for f in range(8)], "track_id long, frame long, cls string, x double")
    assert [r["direction"] for r in tracks.line_crossings(rows, F.col("x")).collect()] == ["in"]
    gaps = tracks.occlusions(rows.where("frame < 2").union(spark.createDataFrame([(1, 30, "p", 0.0)], rows.schema)))
    assert gaps.first()["gap"] == 28
    assert tracks.summaries(spark.createDataFrame([(1, f, "p") for f in range(30)] + [(2, 5, "p")], "track_id long, frame long, cls string")).collect()[0]["dwell_s"] == 1.0


def detections(frames, **more):
    rows = []
    for f in frames:
        rows.append(("c", f, 0, more.get("cls", {}).get(f, "person"), more.get("conf", 0.9), 5.0 * f, 0.0, 5.0 * f + 40, 80.0, more.get("look")))
    return rows


DETECTIONS = "camera_id string, frame long, det_id long, cls string, conf double, x1 double, y1 double, x2 double, y2 double, look array<double>"


def test_tracker(spark):
    run = lambda rows, name="bytetrack": tracker.track(spark.createDataFrame(rows, DETECTIONS), tracker.TRACKERS[name]).collect()
    ids = lambda rows: {r["track_id"] for r in rows}
    gap = [f for f in range(30) if not 12 <= f < 18]
    assert len(ids(run(detections(range(20))))) == 1 and len(ids(run(detections(gap)))) == 1
    assert len(ids(run(detections(gap), "iou"))) > 1 and run(detections(range(20), conf=0.2)) == []
    mixed = run(detections(range(24), cls={f: "bus" for f in range(12, 24)}))
    assert not {r["track_id"] for r in mixed if r["cls"] == "person"} & {r["track_id"] for r in mixed if r["cls"] == "bus"}
    look = [1.0] + [0.0] * 31
    ticks = [("c", f, 0, None, None, None, None, None, None, None) for f in range(30, 99)]
    back = run(detections(range(30), look=look) + ticks + detections(range(99, 110), look=look), "botsort")
    assert len(ids(back)) == 1 and any(r["restored"] for r in back)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame(detections(range(12)), DETECTIONS)
    rows.where("frame < 6").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    rows.where("frame >= 6").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = tracker.track_stream(stream).writeStream.format("memory").queryName("tracked").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r["frame"], r["track_id"]) for r in tracker.track(rows).collect()}
    assert {(r["frame"], r["track_id"]) for r in spark.table("tracked").collect()} == want


def test_sources(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/My-Note.md").write_text("# Hi\nthere")
    (tmp_path / "docs/.hidden.md").write_text("x")
    (tmp_path / "t.csv").write_text("name;city\nAda;Paris\nBob;\n")
    assert [r["suffix"] for r in files.discover(spark, str(tmp_path / "docs")).collect()] == ["md"]
    page = files.read_text(spark, str(tmp_path / "docs")).where("doc_id = 'my_note'").first()
    assert page["title"] == "My Note" and page["char_count"] == 10
    assert [r["text"] for r in files.read_csv_documents(spark, str(tmp_path / "t.csv")).orderBy("row_no").collect()] == ["Row 1 -- name: Ada; city: Paris", "Row 2 -- name: Bob"]
    files.write_store(spark.range(3), str(tmp_path / "store"), "abc")
    assert files.read_store(spark, str(tmp_path / "store"), "abc").count() == 3
    with pytest.raises(ValueError, match="stale"):
        files.read_store(spark, str(tmp_path / "store"), "other")


def test_fixed_values_of_text(spark):
    rows = ["I could not  find information about this in the provided documents.", "Sorry. I could not find information about this in the provided documents", "I could not find any", "I found it [1].", ""]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").orderBy("k").select(T.is_refusal(F.col("t"))).collect()]
    assert got == [True, True, True, False, False]
    lines = ["Page 3", "- 7 -", "[5]", "(3)", "12 / 40", "1234", "12345", "page 3 of 10", "7 apples", "—9—"]
    kept = spark.range(1).select(T.strip_page_numbers(F.lit("\n".join(lines)))).first()[0].split("\n")
    assert kept == ["12345", "page 3 of 10", "7 apples"]
    assert spark.range(1).select(T.fix_ligatures(F.lit("ﬁ ﬅ ﬆ “x”…"))).first()[0] == 'fi st st "x"...'
    assert spark.range(1).select(T.join_hyphenated(F.lit("infor- \n mation state-\nOf"))).first()[0] == "information state-\nOf"
    text = "a [1], b 【2†L1-L3】, c ［07］ and [9] (3) [123]"
    v = spark.range(1).select(T.validate_citations(F.lit(text), F.lit(5)).alias("v"), T.citations(F.lit(text)).alias("c")).first()
    assert v.c == [1, 2, 7, 9, 12] and v.v.valid == [1, 2] and v.v.text == "a [1], b [2], c and (3)"
    words = spark.range(1).select(T.title_case(F.lit("DON'T STOP 2ND A_B")), T.heading(F.lit("REFUND POLICY & TERMS")), T.heading(F.lit("4.2. Late fees")), T.heading(F.lit("## Part ")), T.heading(F.lit("4.2 Late. fees"))).first()
    assert list(words) == ["Don'T Stop 2Nd A_B", "Refund Policy & Terms", "4.2 Late fees", "Part", None]


def test_chunks_follow_the_page(spark):
    """Starts move forward over repeated pieces, headings hold from their own start, noise breaks the carry."""
    page = "# One\n\nsame words here again and again.\n\nTWO WORDS\n\nsame words here again and again.\n\n.............................................\n\nlast part of the page with words."
    rows = ingest.pieces_of(page, 40, 12, 20, 0.8)
    assert [page[a:b] for _, a, b, _ in rows] == [p for p in ingest.split_text(page, 40) if not p.startswith("...")]
    starts = [a for _, a, _, _ in rows]
    assert starts == sorted(set(starts)) and starts[-1] == page.index("last part")
    assert [h for *_, h in rows][0] == "One" and [h for *_, h in rows][-1] == "Two Words"
    assert rows[-1][0] == "last part of the page with words."
    assert rows[1][0].startswith(ingest._tail(page[rows[0][1] : rows[0][2]], 12) + " ")
    made = spark.createDataFrame([("d", 1, page), ("d", 2, None), ("e", 1, "")], "doc_id string, page_no int, text string")
    out = ingest.chunk_pages(made, 10, 3, 20).orderBy("chunk_index").collect()
    assert [(r.text, r.char_start, r.char_end, r.heading) for r in out] == rows and [r.chunk_index for r in out] == list(range(len(rows)))


def test_pairs_hold_over_gaps(spark):
    """A track that comes back under another id after frames without a match is one switch; ignored boxes absorb nothing in HOTA."""
    gt = [(0, f, 1, 0.0, 0.0, 20.0, 20.0, False) for f in range(8)] + [(0, 2, 9, 100.0, 0.0, 120.0, 20.0, True)]
    pred = [(0, f, 5 if f < 3 else 6, 0.0, 0.0, 20.0, 20.0) for f in range(8) if f not in (3, 4)] + [(0, 2, 7, 100.0, 0.0, 120.0, 20.0)]
    g = spark.createDataFrame(gt, "seq long, frame long, track_id long, x1 double, y1 double, x2 double, y2 double, ign boolean")
    p = spark.createDataFrame(pred, "seq long, frame long, track_id long, x1 double, y1 double, x2 double, y2 double")
    r = tracking_metrics.clear_mot(tracking_metrics.frame_matches(g, p)).first()
    assert (r.idsw, r.fn, r.fp, r.tp) == (1, 2, 0, 6)
    h = tracking_metrics.hota(g, p, (0.5,)).first()
    assert h.deta == round(6 / (6 + 2 + 1), 6)


def test_reports_at_the_edges(spark):
    scenes = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "train"), ("d", "val")], "scene_id string, split string")
    sizes = spark.createDataFrame([("a", 9), ("b", 3), ("c", 5), ("d", 1)], "scene_id string, n long")
    assert {r.scene_id: r.split for r in reports.rescue_empty(scenes, sizes).collect()} == {"a": "train", "b": "test", "c": "train", "d": "val"}
    frames = spark.createDataFrame([("1", "train", "s1", "car", "day"), ("2", "train", "s2", None, "night"), ("3", "val", "s3", "", "day")], "image_id string, split string, scene_id string, classes string, lighting string")
    summary = reports.split_summary(frames)
    assert {(r.split, r.n, r.realised, r.classes) for r in summary.collect()} == {("train", 2, 0.6667, "car"), ("val", 1, 0.3333, ""), ("test", 0, 0.0, "")}
    assert {tuple(r) for r in reports.split_warnings(summary).collect()} == {("test", "empty", ""), ("val", "class_absent", "car"), ("val", "single_lighting", "day")}
    hits = spark.createDataFrame([("q", "x", 1), ("q", "gone", 2)], "qid string, id string, rank int")
    records = spark.createDataFrame([("x", "text"), ("y", "other")], "id string, body string")
    assert {(r.id, r.body) for r in reports.lookup(hits, records).collect()} == {("x", "text"), ("gone", None)}
    cases = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "b"), (5, "a")], "k int, cause string")
    assert [r.k for r in reports.diversify(cases, "cause", ["k"], 4).collect()] == [1, 2, 3, 5]
    none = spark.createDataFrame([], "judged boolean, refused boolean, faithful int, relevant int, citation_accuracy double, cited_gold boolean, violations long")
    r = reports.judge_summary(none, none.select("refused")).first()
    assert r.answered == 0 and r.faithfulness is None and r.citation_accuracy is None and r.refusal_correctness is None and r.violations == 0
    rows = spark.createDataFrame([("g", 1, 10.0), ("g", 2, 20.0), ("g", 3, 40.0), ("h", 1, 7.0)], "k string, i int, v double")
    assert {r.k: r.rate for r in reports.smoothed_rate(rows, "k", "i", "v").collect()} == {"g": round(0.9 * (0.9 * 10 + 2) + 4, 6), "h": 7.0}
    assert spark.range(1).select(ingest.embed_text(F.lit("Doc"), F.lit("Part"), F.lit("x"))).first()[0] == "[Doc > Part] x"
    empty = spark.createDataFrame([], "image_id string, split string, n_objects int")
    import hashlib

    assert reports.manifest_digest(empty).first().hash == hashlib.sha256(b"").hexdigest()[:12]


def test_manifest_digest_of_many_pieces_stays_with_the_executors(spark, monkeypatch):
    monkeypatch.setattr(reports, "PIECE", 3)
    rows = [(k // 2, "train" if k % 3 else None, k) for k in range(4000)]
    frames = spark.createDataFrame(rows, "image_id long, split string, n_objects long").repartition(7)
    lines = sorted((i, "|".join(str(x) for x in (i, s, n) if x is not None)) for i, s, n in rows)
    found = reports.manifest_digest(frames)
    monkeypatch.setattr(type(found), "toLocalIterator", None)  # nothing streams through the driver
    assert reports.manifest_digest(frames).first().hash == found.first().hash == hashlib.sha256("".join(x for _, x in lines).encode()).hexdigest()[:12]
