"""Registered queries of operators/reports.py and of detection results, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators import detection, ingest, metrics, reports, retrieval, tracking_metrics, tracks
from siftwork.plans import adapters as A
from siftwork.plans import catalog as C
from siftwork.session import pin, table, written

query = C.query

# -- retrieval and answers ---------------------------------------------------------------------


def _sparse(spark, d, k=25):
    return retrieval.bm25(A.texts(spark, d), A.questions(spark, d), k).select("qid", "id", "rank")


@query(f"WITH {C.WITH_BM25} SELECT qid, rank, s.id AS id, source, lang, n_chars FROM sparse s LEFT JOIN documents d ON d.doc_id = s.id WHERE rank <= 3")
def hit_records(spark, d):
    records = A.documents(spark, d).select(F.col("doc_id").alias("id"), "source", "lang", "n_chars")
    return reports.lookup(_sparse(spark, d, 3), records).select("qid", "rank", "id", "source", "lang", "n_chars")


def _questions(spark, d):
    q = A.questions(spark, d).select("qid")
    return q.withColumn("category", (F.col("qid") % 6).cast("string")).withColumn("answerable", F.col("qid") % 5 != 0)


@query(f"""WITH {C.WITH_GRADES}, r AS (SELECT qid, count(*) FILTER (WHERE grade >= 2) AS relevant FROM grades GROUP BY qid),
  q AS (SELECT item_id % 6 AS category, item_id % 5 <> 0 AS answerable, relevant FROM benchmark LEFT JOIN r ON qid = item_id)
  SELECT coalesce(CAST(category AS VARCHAR), 'all') AS category, count(*) AS total, count(*) FILTER (WHERE answerable) AS answerable, count(*) FILTER (WHERE NOT answerable) AS unanswerable,
    count(*) FILTER (WHERE answerable AND relevant IS NOT NULL) AS resolved, count(*) FILTER (WHERE answerable AND relevant IS NULL) AS unresolved,
    round(coalesce(avg(relevant) FILTER (WHERE answerable), 0.0), 2) AS avg_relevant FROM q GROUP BY GROUPING SETS ((category), ())""")
def golden_statistics(spark, d):
    return reports.golden_statistics(_questions(spark, d), C._grades(spark, d))


ARMS = ("A0", "A1", "A4", "A4b")


def _fused_sql(sparse_most: int) -> str:
    return f"""(SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, dr NULLS LAST, sr NULLS LAST, id) AS rank FROM (SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(dr) AS dr, min(sr) AS sr FROM (
      SELECT qid, id, rank, rank AS dr, NULL AS sr FROM dense WHERE rank <= 25 UNION ALL SELECT qid, id, rank, NULL, rank FROM sparse WHERE rank <= {sparse_most}) GROUP BY qid, id))"""


@query(f"""WITH {C.WITH_BM25}, {C.WITH_DENSE}, {C.WITH_GRADES},
  arms AS (SELECT 'A0' AS arm, qid, id, rank FROM sparse UNION ALL SELECT 'A1', qid, id, rank FROM dense UNION ALL SELECT 'A4', qid, id, rank FROM {_fused_sql(25)} UNION ALL SELECT 'A4b', qid, id, rank FROM {_fused_sql(5)}),
  ideal AS (SELECT qid, sum(CASE WHEN i <= 10 THEN (pow(2, grade) - 1) / log2(i + 1) END) AS idcg, count(*) FILTER (WHERE grade >= 2) AS n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS i FROM grades) GROUP BY qid),
  f AS (SELECT arm, h.qid, count(*) FILTER (WHERE grade >= 2) AS r, min(CASE WHEN grade >= 2 THEN rank END) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM arms h JOIN grades g ON g.qid = h.qid AND g.id = h.id WHERE rank <= 10 GROUP BY arm, h.qid),
  m AS (SELECT a.arm, qid, round(coalesce(r, 0) / 10, 6) AS precision, round(coalesce(coalesce(r, 0) / nullif(n, 0), 0.0), 6) AS recall, CAST(coalesce(r, 0) > 0 AS BIGINT) AS hit, round(coalesce(1 / first, 0.0), 6) AS rr, round(coalesce(dcg / nullif(idcg, 0), 0.0), 6) AS ndcg
    FROM ideal CROSS JOIN (SELECT unnest(['A0', 'A1', 'A4', 'A4b']) AS arm) a LEFT JOIN f USING (arm, qid)),
  means AS (SELECT arm, count(*) AS n, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(hit), 4) AS hit, round(avg(rr), 4) AS rr, round(avg(ndcg), 4) AS ndcg FROM m GROUP BY arm),
  lat AS (SELECT arm, list_sort(list(CAST((item_id * 37 + len(arm) * 11) % 100 AS DOUBLE))) AS l FROM benchmark CROSS JOIN (SELECT unnest(['A0', 'A1', 'A4', 'A4b']) AS arm) GROUP BY arm)
  SELECT means.*, round(ndcg - (SELECT ndcg FROM means WHERE arm = 'A0'), 4) AS delta_ndcg, round(precision / nullif((SELECT round(avg(least(n, 3) / 3), 6) FROM ideal), 0), 4) AS of_ceiling,
    round((l[CAST(floor((len(l) + 1) / 2) AS BIGINT)] + l[CAST(floor(len(l) / 2) + 1 AS BIGINT)]) / 2, 1) AS p50, round(l[greatest(1, CAST(floor(len(l) * 0.95::DOUBLE) AS BIGINT))], 1) AS p95 FROM means JOIN lat USING (arm)""")
def ablation_arms(spark, d):
    dense, sparse = (written(leg, "leg") for leg in C._legs(spark, d))
    fused = lambda most: retrieval.hybrid(dense, sparse.where(F.col("rank") <= most), k=10).select("qid", "id", F.col("final_rank").alias("rank"))
    hits = {"A0": sparse, "A1": dense, "A4": fused(25), "A4b": fused(5)}
    grades = C._grades(spark, d)
    per = [metrics.ranking(h.select("qid", "id", "rank"), grades).withColumn("arm", F.lit(arm)) for arm, h in hits.items()]
    every = per[0]
    for p in per[1:]:
        every = every.unionByName(p)
    arm = F.explode(F.array(*[F.lit(a) for a in ARMS])).alias("arm")
    times = A.questions(spark, d).select("qid", arm).select("arm", ((F.col("qid") * 37 + F.length("arm") * 11) % 100).cast("double").alias("ms"))
    return reports.ablation(every, times, metrics.precision_ceiling(grades, 3))


@query(f"""WITH {C.WITH_BM25}, {C.WITH_GRADES}, rel AS (SELECT qid, id FROM grades WHERE grade >= 2 AND qid % 7 <> 0),
  h AS (SELECT qid, id, CASE WHEN qid % 2 = 0 THEN rank + 3 ELSE 26 - rank END AS rank, NOT (qid % 4 = 1 AND rank <= 5) AS pooled FROM sparse WHERE rank <= 25),
  ask AS (SELECT DISTINCT qid, CASE WHEN qid % 6 = 0 THEN 'ambiguous' ELSE 'c' || (qid % 6) END AS category FROM grades),
  x AS (SELECT ask.*, EXISTS (SELECT 1 FROM rel WHERE rel.qid = ask.qid) AS gold, EXISTS (SELECT 1 FROM rel JOIN h ON h.qid = rel.qid AND h.id = rel.id WHERE rel.qid = ask.qid AND h.pooled) AS pooled,
    EXISTS (SELECT 1 FROM rel JOIN h ON h.qid = rel.qid AND h.id = rel.id WHERE rel.qid = ask.qid AND rank <= 3) AS topped,
    EXISTS (SELECT 1 FROM rel JOIN documents a ON a.doc_id = rel.id JOIN documents b ON a.source = b.source JOIN h ON h.id = b.doc_id WHERE rel.qid = ask.qid AND h.qid = ask.qid AND rank <= 3) AS same_doc FROM ask)
  SELECT qid, category, CASE WHEN NOT gold THEN 'gold_too_narrow' WHEN NOT pooled THEN 'retrieval_miss' WHEN NOT topped THEN 'reranker_misordered' WHEN same_doc THEN 'chunking_split_the_answer' WHEN category = 'ambiguous' THEN 'query_underspecified' ELSE 'embedding_semantic_gap' END AS cause FROM x WHERE NOT topped""")
def retrieval_failures(spark, d):
    """Hits as a bad re-ranker would order them, and for some questions without their best ones in the pool."""
    q = A.questions(spark, d).select("qid", F.when(F.col("qid") % 6 == 0, "ambiguous").otherwise(F.concat(F.lit("c"), (F.col("qid") % 6).cast("string"))).alias("category"))
    sparse = written(_sparse(spark, d), "sparse")
    hits = sparse.select("qid", "id", F.when(F.col("qid") % 2 == 0, F.col("rank") + 3).otherwise(26 - F.col("rank")).alias("rank"))
    grades = C._grades(spark, d).withColumn("grade", F.when(F.col("qid") % 7 == 0, 1).otherwise(F.col("grade")))
    return reports.retrieval_failures(q, hits, sparse.where(~((F.col("qid") % 4 == 1) & (F.col("rank") <= 5))), grades, A.documents(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("doc")))


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS t, min(doc_id) OVER (PARTITION BY lang) AS b FROM documents) ORDER BY t, b LIMIT 50""")
def failure_sample(spark, d):
    return reports.diversify(A.documents(spark, d).select("doc_id", "lang"), "lang", ["doc_id"], 50)


@query("""SELECT r.*, c.refusal_correctness FROM (SELECT count(*) AS answered, count(*) FILTER (WHERE turn % 3 <> 0) AS judged, count(*) FILTER (WHERE conv_id % 7 = 0) AS refused, round(avg(CASE WHEN turn % 3 <> 0 THEN CAST((conv_id + turn) % 4 <> 0 AS INTEGER) END), 3) AS faithfulness,
    round(avg(CASE WHEN turn % 3 <> 0 THEN CAST((conv_id + turn) % 5 <> 0 AS INTEGER) END), 3) AS relevance, round(avg(CASE WHEN turn % 2 = 0 THEN (conv_id % 5) / 5 END), 3) AS citation_accuracy, round(avg(CASE WHEN turn % 3 <> 0 THEN 1 - CAST((conv_id + turn) % 4 <> 0 AS INTEGER) END), 3) AS hallucination,
    round(avg(CAST(conv_id % 2 = 0 AS INTEGER)), 3) AS cited_gold, CAST(coalesce(sum(turn % 2), 0) AS BIGINT) AS violations FROM conversations) r, (SELECT round(avg(CAST(conv_id % 3 = 0 AS INTEGER)), 3) AS refusal_correctness FROM conversations WHERE turn = 0) c""")
def judge_summary(spark, d):
    c = table(pin(spark), d, "conversations")
    k, t = F.col("conv_id"), F.col("turn")
    rows = c.select((t % 3 != 0).alias("judged"), (k % 7 == 0).alias("refused"), ((k + t) % 4 != 0).cast("int").alias("faithful"), ((k + t) % 5 != 0).cast("int").alias("relevant"), F.when(t % 2 == 0, (k % 5) / 5).alias("citation_accuracy"), (k % 2 == 0).alias("cited_gold"), (t % 2).cast("long").alias("violations"))
    return reports.judge_summary(rows, c.where("turn = 0").select((k % 3 == 0).alias("refused")))


@query("""SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) LIKE '%i could not find information about this in the provided documents%' OR turn % 3 = 1 AS refusal FROM conversations""")
def refusals(spark, d):
    said = F.when(F.col("turn") % 3 == 1, F.concat(F.lit(" I  could not find "), "text")).otherwise(F.col("text"))
    return table(pin(spark), d, "conversations").select("conv_id", "turn", T.is_refusal(said).alias("refusal"))


@query("""SELECT source, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE length(text) < 50) AS scanned, count(*) FILTER (WHERE length(text) < 50) = count(*) AS unparsed FROM documents GROUP BY source""")
def document_manifest(spark, d):
    return ingest.document_manifest(A.documents(spark, d), "source")


# -- detection ---------------------------------------------------------------------------------


def _matched(keys: str, pairs: str) -> str:
    """CTEs r and w: the fold over the pairs of each `keys`, best confidence first; matches are rows of w with a gp."""
    names = [k.strip() for k in keys.split(",")]
    own, on = ", ".join(f"n.{k}" for k in names), " AND ".join(f"n.{k} = w.{k}" for k in names)
    free = "list_filter(n.cand, lambda x: NOT list_contains(w.used, x.gp))[1]"
    return f"""r AS (SELECT {keys}, pp, list({{'iou': iou, 'gp': gp}} ORDER BY iou DESC, gp DESC) AS cand, row_number() OVER (PARTITION BY {keys} ORDER BY conf DESC, pp) AS r FROM ({pairs}) GROUP BY {keys}, pp, conf),
  w AS (SELECT {keys}, r, pp, cand[1].gp AS gp, cand[1].iou AS iou, [cand[1].gp] AS used FROM r WHERE r = 1
    UNION ALL SELECT {own}, n.r, n.pp, {free}.gp, {free}.iou, CASE WHEN {free} IS NULL THEN w.used ELSE list_append(w.used, {free}.gp) END FROM w JOIN r n ON {on} AND n.r = w.r + 1)"""


def _outcomes(keys: str, preds: str, pairs: str) -> str:
    """CTEs of _matched() and o: every prediction with tp, fp and iou."""
    return f"""{_matched(keys, f"SELECT * FROM {pairs} WHERE NOT ign")},
  o AS (SELECT {keys}, pp, a.conf, CAST(w.gp IS NOT NULL AS INTEGER) AS tp, CAST(w.gp IS NULL AND s.pp IS NULL AS INTEGER) AS fp, w.iou FROM (SELECT {keys}, pos AS pp, conf FROM {preds}) a
    LEFT JOIN (SELECT * FROM w WHERE gp IS NOT NULL) w USING ({keys}, pp) LEFT JOIN (SELECT DISTINCT {keys}, pp FROM {pairs} WHERE ign) s USING ({keys}, pp))"""


def _ap(by: str) -> str:
    """CTE ap ({by}, ap) from o and n_gt."""
    return f"""lv AS (SELECT {by}, conf, sum(tp) AS t, sum(fp) AS f FROM o GROUP BY {by}, conf), cum AS (SELECT {by}, conf, sum(t) OVER v AS tp, sum(f) OVER v AS fp FROM lv WINDOW v AS (PARTITION BY {by} ORDER BY conf DESC)),
  pr AS (SELECT {by}, tp / nullif(tp + fp, 0) AS p, tp / n_gt AS r FROM cum JOIN n_gt USING ({by})),
  best AS (SELECT {by}, k, max(p) FILTER (WHERE r >= k * 0.01::DOUBLE) AS b FROM pr, range(0, 101) t(k) GROUP BY {by}, k), ap AS (SELECT {by}, round(sum(coalesce(b, 0)) / 101, 6) AS ap FROM best GROUP BY {by})"""


LEVELS = "(SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS threshold)"
C.ORACLES["detection_ap"] = f"""WITH RECURSIVE {C.WITH_BOXES}, ct AS (SELECT c.*, threshold FROM c, {LEVELS} WHERE iou >= threshold), pt AS (SELECT p.*, threshold FROM p, {LEVELS}),
  n_gt AS (SELECT threshold, cls, count(*) AS n_gt FROM g, {LEVELS} WHERE NOT ign GROUP BY ALL), {_outcomes("threshold, image_id, cls", "pt", "ct")}, {_ap("threshold, cls")}
  SELECT threshold, cls, coalesce(ap, 0.0) AS ap FROM n_gt LEFT JOIN ap USING (threshold, cls)"""
C.ORACLES["detection_operating_point"] = f"""WITH RECURSIVE {C.WITH_BOXES}, {_outcomes("image_id, cls", "p", "c")},
  s AS (SELECT CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fp), 0) AS BIGINT) AS fp, round(avg(CASE WHEN tp = 1 THEN iou END), 6) AS mean_iou, (SELECT count(*) FROM g WHERE NOT ign) AS n FROM o WHERE conf >= 0.25),
  x AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(n, 0), 0.0) AS r FROM s)
  SELECT tp, fp, n - tp AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1, mean_iou FROM x"""
#: Pairs of one image whatever the class, from an overlap of 0.1 on, without ignored boxes.
ANY_CLASS = """i0 AS (SELECT p.image_id, p.pos AS pp, g.pos AS gp, conf, greatest(0.0, least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(0.0, least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS inter, (p.x2 - p.x1) * (p.y2 - p.y1) AS ap, (g.x2 - g.x1) * (g.y2 - g.y1) AS ag
    FROM p JOIN g ON p.image_id = g.image_id WHERE NOT g.ign AND conf >= 0.25), i AS (SELECT image_id, pp, gp, conf, coalesce(inter / nullif(ap + ag - inter, 0), 0) AS iou FROM i0 WHERE coalesce(inter / nullif(ap + ag - inter, 0), 0) >= 0.1)"""
C.ORACLES["detection_confusion"] = f"""WITH RECURSIVE {C.WITH_BOXES}, {ANY_CLASS}, {_matched("image_id", "SELECT * FROM i WHERE iou >= 0.5")},
  t AS (SELECT g.image_id, g.cls AS truth, w.pp FROM g LEFT JOIN (SELECT * FROM w WHERE gp IS NOT NULL) w ON w.image_id = g.image_id AND w.gp = g.pos WHERE NOT ign)
  SELECT coalesce(truth, 'background') AS truth, coalesce(p.cls, 'background') AS predicted, count(*) AS n FROM t FULL JOIN (SELECT * FROM p WHERE conf >= 0.25) p ON p.image_id = t.image_id AND p.pos = t.pp GROUP BY ALL"""


def _frames(spark, d):
    m = A.manifest(spark, d).drop("n_objects")
    blur = F.when(F.col("image_id") % 5 == 0, "blurred").otherwise("sharp")
    return m.withColumn("blur_level", blur).withColumn("n_objects", F.col("image_id") % 30).withColumn("motion_score", (F.col("image_id") % 20).cast("double"))


WITH_FRAMES = """m AS (SELECT CAST(o_orderkey AS BIGINT) AS image_id, 's' || (o_custkey % 16) AS scene_id, CASE WHEN starts_with(o_orderpriority, '1') THEN 'night' WHEN starts_with(o_orderpriority, '2') THEN 'dusk' ELSE 'day' END AS lighting,
  ['train', 'train', 'val', 'test'][o_custkey % 4 + 1] AS split, CASE WHEN o_orderkey % 5 = 0 THEN 'blurred' ELSE 'sharp' END AS blur_level, o_orderkey % 30 AS n_objects, CAST(o_orderkey % 20 AS DOUBLE) AS motion_score FROM orders)"""


@query(f"""WITH RECURSIVE {C.WITH_BOXES}, {ANY_CLASS}, {WITH_FRAMES}, {_matched("image_id", "SELECT * FROM i WHERE iou >= 0.5")}, ok AS (SELECT image_id, pp, gp, iou FROM w WHERE gp IS NOT NULL)
  SELECT image_id, 'class_confusion' AS cause, g.cls AS cls_gt, p.cls AS cls_pred, round(ok.iou, 3) AS iou, round(p.conf, 3) AS conf FROM ok JOIN g ON g.image_id = ok.image_id AND g.pos = ok.gp JOIN p ON p.image_id = ok.image_id AND p.pos = ok.pp JOIN m ON m.image_id = ok.image_id WHERE g.cls <> p.cls
  UNION ALL SELECT g.image_id, CASE WHEN best >= 0.1 AND best < 0.5 THEN 'localisation_drift' WHEN (x2 - x1) * (y2 - y1) < 1024 THEN 'missed_small_object' WHEN lighting = 'night' THEN 'low_light_miss' WHEN blur_level = 'blurred' THEN 'motion_blur_miss' ELSE 'occlusion_miss' END, g.cls, NULL, round(coalesce(best, 0.0), 3), NULL
    FROM g JOIN m USING (image_id) LEFT JOIN (SELECT image_id, gp, max(iou) AS best FROM i GROUP BY ALL) b ON b.image_id = g.image_id AND b.gp = g.pos WHERE NOT ign AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.image_id = g.image_id AND ok.gp = g.pos)
  UNION ALL SELECT p.image_id, CASE WHEN EXISTS (SELECT 1 FROM i JOIN ok ON ok.image_id = i.image_id AND ok.gp = i.gp WHERE i.image_id = p.image_id AND i.pp = p.pos AND i.iou >= 0.4) THEN 'duplicate_box_nms' ELSE 'false_positive_background' END, NULL, p.cls, NULL, round(p.conf, 3)
    FROM p JOIN m USING (image_id) WHERE conf >= 0.25 AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.image_id = p.image_id AND ok.pp = p.pos)""".replace("SELECT image_id, 'class_confusion'", "SELECT ok.image_id, 'class_confusion'"))
def detection_failures(spark, d):
    return reports.detection_failures(A.truth_boxes(spark, d), A.found_boxes(spark, d), _frames(spark, d))


BAND = "CASE WHEN (x2 - x1) * (y2 - y1) < 1024 THEN 'small' WHEN (x2 - x1) * (y2 - y1) < 9216 THEN 'medium' ELSE 'large' END"


@query(f"""WITH RECURSIVE {C.WITH_BOXES}, bands AS (SELECT unnest(['small', 'medium', 'large']) AS band), pb AS (SELECT *, {BAND} AS band FROM p), gb AS (SELECT g.image_id, g.pos, g.cls, bands.band, g.ign OR {BAND} <> bands.band AS out FROM g, bands),
  cb AS (SELECT pb.band, c.image_id, c.cls, c.pp, c.gp, c.conf, c.iou, gb.out AS ign FROM c JOIN pb ON pb.image_id = c.image_id AND pb.pos = c.pp JOIN gb ON gb.image_id = c.image_id AND gb.pos = c.gp AND gb.band = pb.band),
  n_gt AS (SELECT band, cls, count(*) AS n_gt FROM gb WHERE NOT out GROUP BY ALL), {_outcomes("band, image_id, cls", "pb", "cb")}, {_ap("band, cls")}
  SELECT band, CAST(coalesce(sum(n_gt), 0) AS BIGINT) AS n_gt, round(avg(CASE WHEN n_gt IS NOT NULL THEN coalesce(ap, 0.0) END), 6) AS ap FROM bands LEFT JOIN n_gt USING (band) LEFT JOIN ap USING (band, cls) GROUP BY band""")
def size_band_ap(spark, d):
    return reports.size_band_ap(A.truth_boxes(spark, d), A.found_boxes(spark, d))


@query("""WITH x AS (SELECT l_returnflag AS cls, l_linenumber % 2 AS run, CAST(l_discount AS DOUBLE) AS v FROM lineitem), a AS (SELECT cls, round(avg(v), 6) AS ap FROM x WHERE run = 0 GROUP BY cls), b AS (SELECT cls, round(avg(v), 6) AS ap FROM x WHERE run = 1 GROUP BY cls)
  SELECT cls, round(abs(a.ap - b.ap), 6) AS gap, abs(a.ap - b.ap) <= 0.0005 AS ok FROM a JOIN b USING (cls)""")
def export_parity(spark, d):
    li = table(pin(spark), d, "lineitem")
    run = lambda k: li.where(F.col("l_linenumber") % 2 == k).groupBy(F.col("l_returnflag").alias("cls")).agg(F.round(F.avg(F.col("l_discount").cast("double")), 6).alias("ap"))
    return reports.parity(run(0), run(1), "cls", "ap", 0.0005)


@query("""SELECT event_type, round(avg(CAST(value AS DOUBLE)), 4) AS mean, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 4) AS p50, round(quantile_cont(CAST(value AS DOUBLE), 0.95), 4) AS p95, round(1000.0 / avg(CAST(value AS DOUBLE)), 4) AS fps FROM events GROUP BY event_type""")
def timing_summary(spark, d):
    return reports.timing_summary(table(pin(spark), d, "events").select("event_type", F.col("value").cast("double").alias("value")), "event_type", "value")


@query("""SELECT CASE l_returnflag WHEN 'A' THEN 'car' WHEN 'R' THEN 'bus' END AS cls, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1""")
def class_mapping(spark, d):
    mapping = spark.createDataFrame([("A", "car"), ("R", "bus")], "model_cls string, cls string")
    return reports.to_dataset_classes(table(pin(spark), d, "lineitem").select(F.col("l_returnflag").alias("model_cls")), mapping).groupBy("cls").agg(F.count("*").alias("n"))


# -- frames and splits -------------------------------------------------------------------------


@query(f"""WITH {WITH_FRAMES}, s AS (SELECT 'lighting:' || lighting AS slice, image_id FROM m UNION ALL SELECT 'blur:' || blur_level, image_id FROM m UNION ALL SELECT CASE WHEN n_objects > 15 THEN 'crowded:>15 objects' ELSE 'crowded:<=15 objects' END, image_id FROM m
  UNION ALL SELECT CASE WHEN motion_score >= 10 THEN 'activity:high' ELSE 'activity:low' END, image_id FROM m) SELECT slice, count(*) AS n, CAST(sum(image_id) AS BIGINT) AS total FROM s GROUP BY slice HAVING count(*) >= 3""")
def difficulty_slices(spark, d):
    return reports.difficulty_slices(_frames(spark, d)).groupBy("slice").agg(F.count("*").alias("n"), F.sum("image_id").alias("total"))


def _classed(spark, d):
    own = F.when(F.col("split") == "val", F.when(F.col("image_id") % 2 == 0, "car")).otherwise(F.when(F.col("image_id") % 3 == 0, "bus;car").otherwise("car"))
    light = F.when(F.col("split") == "test", "day").otherwise(F.col("lighting"))
    return _frames(spark, d).withColumn("classes", own).withColumn("lighting", light)


WITH_SUMMARY = f"""{WITH_FRAMES}, k AS (SELECT split, scene_id, CASE WHEN split = 'test' THEN 'day' ELSE lighting END AS lighting, CASE WHEN split = 'val' THEN CASE WHEN image_id % 2 = 0 THEN 'car' END WHEN image_id % 3 = 0 THEN 'bus;car' ELSE 'car' END AS classes FROM m),
  per AS (SELECT split, count(*) AS n, round(count(*) / (SELECT count(*) FROM k), 4) AS realised, count(DISTINCT scene_id) AS scenes, string_agg(DISTINCT lighting, ',' ORDER BY lighting) AS lightings FROM k GROUP BY split),
  cl AS (SELECT split, string_agg(DISTINCT c, ',' ORDER BY c) AS classes FROM (SELECT split, unnest(string_split(classes, ';')) AS c FROM k) GROUP BY split)"""


@query(f"WITH {WITH_SUMMARY} SELECT split, n, realised, scenes, coalesce(classes, '') AS classes, lightings FROM per LEFT JOIN cl USING (split)")
def split_summary(spark, d):
    return reports.split_summary(_classed(spark, d))


@query(f"""WITH {WITH_SUMMARY}, s AS (SELECT split, coalesce(n, 0) AS n, list_filter(string_split(coalesce(classes, ''), ','), lambda x: x <> '') AS c, list_filter(string_split(coalesce(lightings, ''), ','), lambda x: x <> '') AS l
    FROM (SELECT unnest(['train', 'val', 'test']) AS split) LEFT JOIN per USING (split) LEFT JOIN cl USING (split)), e AS (SELECT DISTINCT unnest(c) AS x FROM s), k2 AS (SELECT count(DISTINCT x) AS k FROM (SELECT unnest(l) AS x FROM s))
  SELECT split, 'empty' AS warning, '' AS subject FROM s WHERE n = 0 UNION ALL SELECT split, 'class_absent', x FROM s, e WHERE n > 0 AND NOT list_contains(c, x) UNION ALL SELECT split, 'single_lighting', l[1] FROM s, k2 WHERE n > 0 AND len(l) = 1 AND k > 1""")
def split_warnings(spark, d):
    return reports.split_warnings(reports.split_summary(_classed(spark, d)))


@query("""SELECT scene_id, CASE r WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'train' END AS split FROM (SELECT 's' || (o_custkey % 16) AS scene_id, row_number() OVER (ORDER BY count(*), 's' || (o_custkey % 16)) AS r FROM orders GROUP BY 1)""")
def rescued_splits(spark, d):
    """All scenes in one split; the empty ones take the smallest of them, in turn."""
    sizes = A.manifest(spark, d).groupBy("scene_id").agg(F.count("*").alias("n"))
    return reports.rescue_empty(sizes.select("scene_id", F.lit("train").alias("split")), sizes).select("scene_id", "split")


@query("""SELECT substr(sha256(string_agg(o_orderkey || '|' || ['train', 'train', 'val', 'test'][o_custkey % 4 + 1] || '|' || (o_orderkey % 7), '' ORDER BY o_orderkey)), 1, 12) AS hash FROM orders""")
def manifest_digest(spark, d):
    return reports.manifest_digest(A.manifest(spark, d))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS image_id, 's' || (o_custkey % 16) AS scene, printf('s%d_clip_f%06d', o_custkey % 16, o_orderkey) AS name FROM orders""")
def frame_names(spark, d):
    o = table(pin(spark), d, "orders")
    stem = F.concat(F.lit("s"), (F.col("o_custkey") % 16).cast("string"), F.lit("_clip"))
    return o.select(F.col("o_orderkey").cast("long").alias("image_id"), reports.scene_of(F.concat(F.lit("data/raw/"), stem, F.lit(".v1.mp4"))).alias("scene"), reports.image_name(stem, F.col("o_orderkey")).alias("name"))


@query("""SELECT ['train', 'train', 'val', 'test'][o_custkey % 4 + 1] AS old, CASE WHEN o_custkey % 48 < 10 THEN 'test' ELSE ['train', 'train', 'val', 'test'][o_custkey % 4 + 1] END AS split, count(*) AS n FROM orders GROUP BY ALL""")
def rewritten_splits(spark, d):
    new = spark.range(10).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("source_video"), F.lit("test").alias("split"))
    m = A.manifest(spark, d).withColumn("old", F.col("split"))
    return reports.rewrite_splits(m, new).groupBy("old", "split").agg(F.count("*").alias("n"))


# -- tracks ------------------------------------------------------------------------------------


@query(f"""WITH {C.WITH_FRAMES} SELECT a.track_id AS video, count(*) AS boxes, count(*) FILTER (WHERE b.frame IS NULL) AS unmatched FROM u a LEFT JOIN (SELECT track_id, frame FROM u WHERE frame % 3 <> 0) b ON b.track_id = a.track_id AND b.frame = a.frame GROUP BY 1""")
def label_rows(spark, d):
    rows = A.user_frames(spark, d).select(F.col("track_id").alias("video"), "frame", "cls")
    boxes = rows.where("frame % 3 <> 0").select("video", reports.frame_index(F.col("frame")).alias("frame"), F.col("cls").alias("box_cls"))
    return reports.label_rows(rows, boxes).groupBy("video").agg(F.count("*").alias("boxes"), F.count_if(F.col("box_cls").isNull()).alias("unmatched"))


@query(f"""WITH {C.WITH_FRAMES} SELECT count(*) AS n FROM (SELECT track_id FROM u WHERE frame % 10 / 10.0 >= 0.3 GROUP BY track_id HAVING count(*) >= 3)""")
def unique_tracks(spark, d):
    return reports.unique_count(A.user_frames(spark, d).withColumn("visibility", F.col("frame") % 10 / F.lit(10.0)))


@query(C.ORACLES["track_summaries"].replace("SELECT track_id, first_frame", "SELECT cls, count(*) AS unique, round(avg(dwell_s), 2) AS mean_dwell FROM (SELECT track_id, first_frame") + ") GROUP BY cls")
def dwell_by_class(spark, d):
    return reports.by_class(tracks.summaries(A.user_frames(spark, d)))


@query("""SELECT user_id, round(list_reduce(list(CAST(value AS DOUBLE) ORDER BY event_id), lambda a, x: 0.9::DOUBLE * a + 0.1::DOUBLE * x), 6) AS rate FROM events GROUP BY user_id""")
def smoothed_rates(spark, d):
    return reports.smoothed_rate(table(pin(spark), d, "events").select("user_id", "event_id", F.col("value").cast("double").alias("value")), "user_id", "event_id", "value")


@query(f"""WITH {C.WITH_CLEAR}{C.WITH_IDENTITY}{C.WITH_HOTA} SELECT clear.*, idf1, idp, idr, h.*, f.n_frames, round(coalesce(1000.0 * idsw / nullif(f.n_frames, 0), 0.0), 2) AS idsw_per_1k
  FROM clear, ident, (SELECT round(avg(hota), 4) AS hota, round(avg(deta), 4) AS deta, round(avg(assa), 4) AS assa FROM hota) h, (SELECT count(*) AS n_frames FROM (SELECT DISTINCT track_id % 16, frame FROM u)) f""")
def tracking_bundle(spark, d):
    gt, pred = A.track_boxes(spark, d)
    n = gt.where("NOT ign").select("seq", "frame").union(pred.select("seq", "frame")).distinct().agg(F.count("*").alias("n_frames"))
    return reports.tracking_bundle(tracking_metrics.clear_mot(tracking_metrics.frame_matches(gt, pred)), tracking_metrics.idf1(gt, pred), tracking_metrics.hota(gt, pred), n)


# -- means, ranks and re-ranking ---------------------------------------------------------------


@query(f"SELECT round(avg(ap) FILTER (WHERE abs(threshold - 0.5) < 1e-9), 6) AS map50, round(avg(ap), 6) AS map50_95, count(DISTINCT cls) AS classes FROM ({C.ORACLES['detection_ap']})")
def detection_map(spark, d):
    return detection.mean_precision(C.detection_ap(spark, d))


@query(f"SELECT *, round(step / 20, 2) AS tau FROM ({C.ORACLES['tau_sweep']}) ORDER BY f1 DESC, step LIMIT 1")
def best_tau(spark, d):
    return tracks.best_tau(C.tau_sweep(spark, d))


@query(f"SELECT g.*, item_id % 5 <> 0 AS answerable FROM ({C.ORACLES['refusal_gate']}) g JOIN benchmark ON item_id = qid")
def confidences(spark, d):
    """Confidence of each question's best hit, with whether it can be answered."""
    return C.refusal_gate(spark, d).join(_questions(spark, d).select("qid", "answerable"), "qid")


@query("""WITH r AS (SELECT conv_id % 4 AS arm, unnest([role, 'all']) AS category, CAST((conv_id * 37 + turn * 11 + length(text)) % 1000 AS DOUBLE) AS ms FROM conversations),
  l AS (SELECT arm, category, count(*) AS n, list_sort(list(ms)) AS l FROM r GROUP BY arm, category)
  SELECT arm, category, n, round((l[CAST(floor((n + 1) / 2) AS BIGINT)] + l[CAST(floor(n / 2) + 1 AS BIGINT)]) / 2, 6) AS p50, l[greatest(1, CAST(floor(n * 0.95::DOUBLE) AS BIGINT))] AS p95 FROM l""")
def latency_by_category(spark, d):
    c = table(pin(spark), d, "conversations")
    ms = ((F.col("conv_id") * 37 + F.col("turn") * 11 + F.length("text")) % 1000).cast("double")
    return metrics.latencies(c.select((F.col("conv_id") % 4).alias("arm"), F.col("role").alias("category"), ms.alias("ms")), ["arm"], "category")


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS n, greatest(1, count(*) OVER () // 30) AS step FROM documents) WHERE (n - 1) % step = 0 ORDER BY n LIMIT 30""")
def inspected_documents(spark, d):
    return retrieval.inspected(A.documents(spark, d).select("doc_id", "lang"), 30, "doc_id")


@query(f"""WITH {C.WITH_BM25}, {C.WITH_DENSE}, {C.WITH_GRADES}, pool AS (SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, dr NULLS LAST, sr NULLS LAST, id) AS place FROM (
    SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(dr) AS dr, min(sr) AS sr FROM (SELECT qid, id, rank, rank AS dr, NULL AS sr FROM dense WHERE rank <= 25 UNION ALL SELECT qid, id, rank, NULL, rank FROM sparse WHERE rank <= 25) GROUP BY qid, id)) WHERE place <= 40),
  qw AS (SELECT item_id AS qid, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: t NOT IN ({C.STOP}))) AS w FROM benchmark),
  dw AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: t NOT IN ({C.STOP})) AS w FROM documents),
  judged AS (SELECT pool.qid, pool.id, place, len(list_intersect(qw.w, dw.w)) / nullif(len(qw.w), 0) AS s FROM pool JOIN qw USING (qid) LEFT JOIN dw ON dw.id = pool.id)
  SELECT qid, id, round(s, 6) AS rerank_score, final_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC NULLS LAST, place) AS final_rank FROM judged) WHERE final_rank <= 10""")
def hybrid_reranked(spark, d):
    """Both legs fused and re-ranked by the share of a question's words that a document has."""
    dense, sparse = C._legs(spark, d)
    scorer = retrieval.word_overlap(A.questions(spark, d), A.texts(spark, d))
    return retrieval.hybrid(dense, sparse, k=10, scorer=scorer).select("qid", "id", F.round("rerank_score", 6).alias("rerank_score"), "final_rank")
