"""The registry of queries over the standard tables, each with its DuckDB counterpart where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import boxes as B
from siftwork.functions import text as T
from siftwork.functions import vectors as V
from siftwork.operators import asof, detection, ingest, labels, metrics, retrieval, tracking_metrics, tracks
from siftwork.plans import adapters as A
from siftwork.session import fresh_folder, pin, table, written
from siftwork.sources import lexical_index, vector_cache
from siftwork.streaming import motion, tracker

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The words left out of lexical matching, stated here again (fixed values).
STOP = """'a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'has', 'have', 'in', 'is', 'it', 'its', 'of', 'on', 'or', 'that', 'the', 'to', 'was', 'were', 'will', 'with', 'within', 'must', 'may', 'any', 'all', 'not', 'this', 'these'"""
#: Views that several counterparts start from.
WITH_TOKENS = f"tok AS (SELECT doc_id AS id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: t NOT IN ({STOP}))) AS term FROM documents)"
WITH_BM25 = f"""{WITH_TOKENS},
  post AS (SELECT term, id, count(*) AS tf FROM tok GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
  dl AS (SELECT doc_id AS id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: t NOT IN ({STOP}))) AS dl FROM documents),
  df AS (SELECT term, ln(((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM post GROUP BY term),
  idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
  q AS (SELECT item_id AS qid, term, count(*) AS qn FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: t NOT IN ({STOP}))) AS term FROM benchmark) GROUP BY ALL),
  scored AS (SELECT qid, post.id AS id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))), 6) AS score
    FROM post JOIN idf USING (term) JOIN q USING (term) JOIN dl ON dl.id = post.id GROUP BY qid, post.id),
  sparse AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0))"""
WITH_GRADES = """d AS (SELECT doc_id AS id, trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS body FROM documents),
  s AS (SELECT item_id AS qid, trim(regexp_replace(lower(span), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS span, grade FROM (
    SELECT item_id, substr(text, 60 * i + 1, CASE WHEN i = k - 1 THEN length(text) ELSE 60 END) AS span, CASE WHEN i = 0 THEN 3 ELSE 2 END AS grade
    FROM (SELECT item_id, text, k, unnest(range(k)) AS i FROM (SELECT item_id, text, greatest(1, length(text) // 60) AS k FROM benchmark)))),
  direct AS (SELECT qid, id, max(grade) AS grade FROM d JOIN s ON contains(body, span) GROUP BY ALL),
  beside AS (SELECT DISTINCT qid, b.doc_id AS id, 1 AS grade FROM direct g JOIN documents a ON a.doc_id = g.id JOIN documents b ON a.source = b.source AND a.doc_id // 100 = b.doc_id // 100 WHERE g.grade = 3),
  grades AS (SELECT qid, id, max(grade) AS grade FROM (SELECT * FROM direct UNION ALL SELECT * FROM beside) GROUP BY ALL)"""
WITH_DENSE = """dense AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
    SELECT b.item_id AS qid, c.vec_id AS id, round(list_dot_product(c.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
    FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id CROSS JOIN embeddings c)))"""
WITH_BOXES = """g AS (SELECT CAST(l_orderkey AS BIGINT) AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos, l_returnflag AS cls,
    CAST(l_partkey % 200 AS DOUBLE) AS x1, CAST(l_suppkey % 100 AS DOUBLE) AS y1, CAST(l_partkey % 200 AS DOUBLE) + 20 + CAST(l_quantity AS DOUBLE) AS x2, CAST(l_suppkey % 100 AS DOUBLE) + 20 + CAST(l_quantity AS DOUBLE) AS y2,
    l_discount < 0.01 AS ign, CAST(l_tax AS DOUBLE) AS l_tax, l_suppkey, l_partkey FROM lineitem),
  p AS (SELECT image_id, pos, CASE WHEN l_suppkey % 11 = 0 THEN 'A' ELSE cls END AS cls, x1 + l_tax * 100 AS x1, y1, x2 + l_tax * 100 AS x2, y2, 0.3::DOUBLE + ((l_partkey * 7 + pos * 13) % 100) / 200.0::DOUBLE AS conf FROM g WHERE l_tax < 0.075::DOUBLE),
  c0 AS (SELECT p.image_id, p.cls, p.pos AS pp, g.pos AS gp, conf, g.ign,
    greatest(0.0, least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(0.0, least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS inter, (p.x2 - p.x1) * (p.y2 - p.y1) AS ap, (g.x2 - g.x1) * (g.y2 - g.y1) AS ag
    FROM p JOIN g ON p.image_id = g.image_id AND p.cls = g.cls),
  c AS (SELECT image_id, cls, pp, gp, conf, ign, coalesce(inter / nullif(ap + ag - inter, 0), 0) AS iou FROM c0 WHERE coalesce(inter / nullif(ap + ag - inter, 0), 0) >= 0.5)"""
WITH_FRAMES = """u AS (SELECT track_id, frame, cls, x FROM (SELECT CAST(user_id AS BIGINT) AS track_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame, event_type AS cls, CAST(value AS DOUBLE) AS x,
    row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY event_id DESC) AS r FROM events) WHERE r = 1)"""

#: Truth rows with the prediction at the same place, if there is one, as adapters.track_boxes() makes them.
WITH_TRACKS = WITH_FRAMES + """,
  pred AS (SELECT track_id % 16 AS seq, frame, CASE WHEN frame % 5 = 0 THEN track_id + 100000 ELSE track_id END AS pred_id, track_id AS gt_id, (20.0::DOUBLE - frame % 4) / (20 + frame % 4) AS iou FROM u WHERE (frame * 7 + track_id) % 9 <> 0),
  m AS (SELECT u.track_id % 16 AS seq, u.frame, u.track_id AS gt_id, pred_id, iou FROM u LEFT JOIN pred ON pred.gt_id = u.track_id AND pred.frame = u.frame)"""
WITH_CLEAR = WITH_TRACKS + """,
  hit AS (SELECT *, CAST(coalesce(iou >= 0.5, false) AS INTEGER) AS hit, CASE WHEN iou >= 0.5 THEN pred_id END AS own FROM m),
  seen AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY gt_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, lag(hit) OVER (PARTITION BY gt_id ORDER BY frame) AS before FROM hit),
  per AS (SELECT gt_id, count(*) AS n, sum(hit) AS tp, count(*) FILTER (WHERE hit = 1 AND own <> prev) AS idsw, count(*) FILTER (WHERE hit = 1 AND coalesce(before, 0) = 0) AS runs, sum(CASE WHEN hit = 1 THEN iou END) AS iou FROM seen GROUP BY gt_id),
  sums AS (SELECT CAST(sum(n) AS BIGINT) AS n_gt, CAST(sum(tp) AS BIGINT) AS tp, (SELECT count(*) FROM pred WHERE iou < 0.5) AS fp, CAST(sum(idsw) AS BIGINT) AS idsw, sum(iou) AS iou, count(*) FILTER (WHERE tp / n >= 0.8) AS mt, count(*) FILTER (WHERE tp / n > 0.2 AND tp / n < 0.8) AS pt,
    count(*) FILTER (WHERE tp / n <= 0.2) AS ml, round(avg(greatest(runs - 1, 0)), 6) AS fragments FROM per),
  clear AS (SELECT n_gt, tp, fp, n_gt - tp AS fn, idsw, round(1 - (n_gt - tp + fp + idsw) / n_gt, 6) AS mota, round(iou / tp, 6) AS motp, mt, pt, ml, fragments FROM sums)"""
WITH_IDENTITY = """,
  pairs AS (SELECT gt_id, pred_id, count(*) AS n FROM m WHERE iou >= 0.5 GROUP BY ALL), best AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS idtp FROM (SELECT gt_id, max(n) AS n FROM pairs GROUP BY gt_id)),
  ident AS (SELECT idtp, n_gt, n_pred, round(2 * idtp / (n_gt + n_pred), 6) AS idf1, round(idtp / n_pred, 6) AS idp, round(idtp / n_gt, 6) AS idr FROM best, (SELECT count(*) AS n_gt FROM u), (SELECT count(*) AS n_pred FROM pred))"""
WITH_HOTA = """,
  alphas AS (SELECT round(k * 0.05::DOUBLE, 2) AS alpha FROM range(1, 20) AS t(k)), ng AS (SELECT gt_id, count(*) AS ng FROM u AS x(gt_id, f, c, v) GROUP BY gt_id), np AS (SELECT pred_id, count(*) AS np FROM pred GROUP BY pred_id),
  tp AS (SELECT alpha, count(*) FILTER (WHERE iou >= alpha) AS tp, count(*) AS n_gt, (SELECT count(*) FROM pred) AS n_pred FROM alphas, m GROUP BY alpha),
  tpa AS (SELECT alpha, gt_id, pred_id, count(*) AS a FROM alphas, m WHERE iou >= alpha GROUP BY ALL), ass AS (SELECT alpha, sum(a * a / (ng + np - a)) AS s FROM tpa JOIN ng USING (gt_id) JOIN np USING (pred_id) GROUP BY alpha),
  levels AS (SELECT alpha, tp / (n_gt + n_pred - tp) AS deta, coalesce(s / nullif(tp, 0), 0.0) AS assa FROM tp LEFT JOIN ass USING (alpha)),
  hota AS (SELECT alpha, round(sqrt(deta * assa), 6) AS hota, round(deta, 6) AS deta, round(assa, 6) AS assa FROM levels)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# -- retrieval --------------------------------------------------------------------------------


@query("""SELECT qid, id, score, rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
  SELECT q.vec_id AS qid, c.vec_id AS id, round(list_dot_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""")
def knn_exact(spark, d):
    return retrieval.knn(A.vectors(spark, d).select("id", "vec"), A.asked(spark, d)).select("qid", "id", "score", "rank")


@query("""SELECT qid, id, score, rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
  SELECT q.vec_id AS qid, c.vec_id AS id, round(list_dot_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0 AND c.label IN (1, 2, 3))) WHERE rank <= 10""")
def knn_filtered(spark, d):
    return retrieval.knn(A.vectors(spark, d), A.asked(spark, d), where={"label": [1, 2, 3]}).select("qid", "id", "score", "rank")


@query()
def knn_approximate(spark, d):
    return retrieval.knn_approximate(A.vectors(spark, d).select("id", "vec"), A.asked(spark, d)).select("qid", "id", "score", "rank")


@query("SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 5) AS total FROM embeddings")
def l2_normalize(spark, d):
    v = A.vectors(spark, d)
    return v.select("id", F.round(V.norm(F.col("vec")), 6).alias("norm"), F.round(F.aggregate(V.l2_normalize(F.col("vec")), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(f"WITH {WITH_TOKENS} SELECT term, count(*) AS n, count(DISTINCT id) AS df FROM tok GROUP BY term")
def term_statistics(spark, d):
    return retrieval.postings(A.texts(spark, d)).groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))


@query(f"WITH {WITH_BM25} SELECT qid, id, score, rank FROM sparse WHERE rank <= 10")
def bm25_top(spark, d):
    return retrieval.bm25(A.texts(spark, d), A.questions(spark, d)).select("qid", "id", "score", "rank")


@query(f"WITH {WITH_BM25} SELECT qid, id, score, rank FROM sparse WHERE rank <= 10")
def bm25_stored(spark, d):
    """bm25_top from an index that is written first and opened by its fingerprint."""
    docs, folder = A.texts(spark, d), fresh_folder(spark, "lexical")
    mark = lexical_index.write(docs, folder)
    return lexical_index.Index(spark, folder, mark).search(A.questions(spark, d), 10).select("qid", "id", "score", "rank")


@query("""WITH t AS (SELECT doc_id, sha256(concat('m', chr(0), text)) AS key, n_chars FROM documents WHERE text IS NOT NULL), b AS (
    SELECT 0 AS batch, doc_id AS seq, key, n_chars AS value FROM t WHERE doc_id % 2 = 0 UNION ALL SELECT 1, -doc_id, key, -n_chars FROM t WHERE doc_id % 3 = 0 UNION ALL SELECT 2, doc_id, key, 7 * n_chars FROM t WHERE doc_id % 5 = 0)
  SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY batch DESC, seq DESC, value DESC) AS r FROM b) WHERE r = 1""")
def cache_replacements(spark, d):
    """Three batches of content keys, each replacing what the earlier ones hold; the second is written twice."""
    t, folder = A.documents(spark, d).where("text IS NOT NULL"), fresh_folder(spark, "cache")
    rows = lambda where, seq, value: t.where(where).select(vector_cache.key_of("m", F.col("text")).alias("key"), seq.alias("seq"), value.alias("value"))
    i, n = F.col("doc_id"), F.col("n_chars")
    vector_cache.put(rows("doc_id % 2 = 0", i, n), folder, 0)
    for _ in range(2):
        vector_cache.put(rows("doc_id % 3 = 0", -i, -n), folder, 1)
    vector_cache.put(rows("doc_id % 5 = 0", i, 7 * n), folder, 2)
    return vector_cache.latest(spark, folder)


def _legs(spark, d, k=25):
    items = A.questions(spark, d).select("qid")
    asked = A.vectors(spark, d).join(items, F.col("id") == F.col("qid")).select("qid", F.col("vec").alias("qvec"))
    return retrieval.knn(A.vectors(spark, d).select("id", "vec"), asked, k), retrieval.bm25(A.texts(spark, d), A.questions(spark, d), k)


@query(f"""WITH {WITH_BM25}, {WITH_DENSE}, f AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(dr) AS dr, min(sr) AS sr FROM (
  SELECT qid, id, rank, rank AS dr, NULL AS sr FROM dense WHERE rank <= 25 UNION ALL SELECT qid, id, rank, NULL, rank FROM sparse WHERE rank <= 25) GROUP BY qid, id)
  SELECT qid, id, round(rrf, 6) AS score, final_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, dr NULLS LAST, sr NULLS LAST, id) AS final_rank FROM f) WHERE final_rank <= 5""")
def hybrid_rrf(spark, d):
    return retrieval.hybrid(*_legs(spark, d)).select("qid", "id", F.round("score", 6).alias("score"), "final_rank")


@query(f"""WITH {WITH_BM25} SELECT b.item_id AS qid, coalesce(score, 0.0) AS confidence, score IS NULL OR score < 60 AS refused FROM benchmark b LEFT JOIN (SELECT * FROM sparse WHERE rank = 1) t ON t.qid = b.item_id""")
def refusal_gate(spark, d):
    hits = retrieval.bm25(A.texts(spark, d), A.questions(spark, d), 1).select("qid", "id", "score", F.col("rank").alias("final_rank"), F.lit(None).cast("double").alias("rerank_score"))
    return retrieval.gate(A.questions(spark, d), hits, 60)


@query("""SELECT qid, final_rank, used FROM (SELECT conv_id AS qid, turn AS final_rank, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE used <= 1200 OR r = 1""")
def context_packing(spark, d):
    c = table(pin(spark), d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("final_rank"), "text")
    return retrieval.pack_context(c, 300).select("qid", "final_rank", "used")


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS t FROM documents) ORDER BY t, lang LIMIT 50""")
def stratified_sample(spark, d):
    return retrieval.stratified(A.documents(spark, d).select("doc_id", "lang"), 50, "lang", "doc_id")


@query("""WITH t AS (SELECT doc_id AS id, sha256(concat('m', chr(0), text)) AS key FROM documents), c AS (SELECT DISTINCT key FROM t WHERE id % 2 = 0)
  SELECT count(*) FILTER (WHERE key IN (SELECT key FROM c)) AS hits, count(*) FILTER (WHERE key NOT IN (SELECT key FROM c)) AS misses FROM t""")
def embedding_cache(spark, d):
    t = A.texts(spark, d)
    cache = t.where("id % 2 = 0").select(F.sha2(F.concat(F.lit("m"), F.lit("\0"), F.col("text")), 256).alias("key")).distinct()
    hit, miss = retrieval.cached_vectors(t, cache, "m")
    return hit.agg(F.count("*").alias("hits")).crossJoin(miss.agg(F.count("*").alias("misses")))


# -- evaluation -------------------------------------------------------------------------------


@query(f"WITH {WITH_GRADES} SELECT qid, id AS chunk_id, CAST(grade AS INTEGER) AS grade FROM grades")
def resolve_grades(spark, d):
    return ingest.resolve_grades(A.spans(spark, d), A.graded_chunks(spark, d))


def _grades(spark, d):
    """Written, as most metrics read them more than once: the texts are looked through once."""
    return written(ingest.resolve_grades(A.spans(spark, d), A.graded_chunks(spark, d)).withColumnRenamed("chunk_id", "id"), "grades")


PER_QUERY = f"""WITH {WITH_BM25}, {WITH_GRADES},
  ideal AS (SELECT qid, sum(CASE WHEN i <= 10 THEN (pow(2, grade) - 1) / log2(i + 1) END) AS idcg, count(*) FILTER (WHERE grade >= 2) AS n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS i FROM grades) GROUP BY qid),
  seen AS (SELECT h.qid, h.rank, grade, CASE WHEN grade >= 2 THEN 1 ELSE 0 END AS rel, sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY h.qid ORDER BY h.rank) AS cum FROM sparse h JOIN grades g ON g.qid = h.qid AND g.id = h.id WHERE h.rank <= 10),
  f AS (SELECT qid, sum(rel) AS r, min(CASE WHEN rel = 1 THEN rank END) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg, sum(CASE WHEN rel = 1 THEN cum / rank END) AS ap FROM seen GROUP BY qid),
  m AS (SELECT qid, round(coalesce(r, 0) / 10, 6) AS precision, round(coalesce(coalesce(r, 0) / nullif(n, 0), 0.0), 6) AS recall, CAST(coalesce(r, 0) > 0 AS BIGINT) AS hit, round(coalesce(1 / first, 0.0), 6) AS rr, round(coalesce(dcg, 0.0), 6) AS dcg,
    round(coalesce(dcg / nullif(idcg, 0), 0.0), 6) AS ndcg, round(coalesce(ap / nullif(least(n, 10), 0), 0.0), 6) AS ap FROM ideal LEFT JOIN f USING (qid))"""


@query(PER_QUERY + " SELECT * FROM m")
def ranking_metrics(spark, d):
    return metrics.ranking(retrieval.bm25(A.texts(spark, d), A.questions(spark, d)), _grades(spark, d))


@query(PER_QUERY + """ SELECT coalesce(CAST(category AS VARCHAR), 'all') AS category, count(*) AS n, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(hit), 4) AS hit, round(avg(rr), 4) AS rr, round(avg(dcg), 4) AS dcg, round(avg(ndcg), 4) AS ndcg, round(avg(ap), 4) AS ap
  FROM (SELECT *, qid % 6 AS category FROM m) GROUP BY GROUPING SETS ((), (category))""")
def macro_metrics(spark, d):
    per = metrics.macro(ranking_metrics(spark, d).withColumn("category", F.col("qid") % 6), ["category"])
    return per.withColumn("category", F.coalesce(F.col("category").cast("string"), F.lit("all")))


@query(f"WITH {WITH_GRADES} SELECT round(avg(least(n, 3) / 3), 6) AS ceiling FROM (SELECT count(*) FILTER (WHERE grade >= 2) AS n FROM grades GROUP BY qid)")
def precision_ceiling(spark, d):
    return metrics.precision_ceiling(_grades(spark, d), 3)


@query("""SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = greatest(1, CAST(floor(n * 0.95::DOUBLE) AS BIGINT))""")
def latency_p95(spark, d):
    return metrics.nearest_rank_p95(table(pin(spark), d, "events").select("event_type", "value"), "value", "event_type")


SWEEP = """WITH c AS (SELECT quality = 1 AS yes, CAST(floor((doc_id * 37) % 100 / 100.0::DOUBLE * 100 + 1e-9) AS INTEGER) AS slot FROM labels),
  t AS (SELECT CAST(step AS INTEGER) AS step, count(*) FILTER (WHERE yes AND slot >= step) AS tp, count(*) FILTER (WHERE yes AND slot < step) AS fn, count(*) FILTER (WHERE NOT yes AND slot >= step) AS fp, count(*) FILTER (WHERE NOT yes AND slot < step) AS tn FROM c, range(1, 90) r(step) GROUP BY step),
  x AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r, coalesce(tn / nullif(tn + fp, 0), 0.0) AS s FROM t),
  y AS (SELECT step, tp, fn, fp, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1, round((r + s) / 2, 6) AS balanced FROM x)"""


@query(SWEEP + " SELECT * FROM y")
def refusal_sweep(spark, d):
    rows = table(pin(spark), d, "labels").select((F.col("quality") == 1).alias("answerable"), ((F.col("doc_id") * 37) % 100 / F.lit(100.0)).alias("confidence"))
    return metrics.refusal_sweep(rows)


@query(SWEEP + " SELECT * FROM y ORDER BY balanced DESC, f1 DESC, step LIMIT 1")
def best_threshold(spark, d):
    return metrics.best_threshold(refusal_sweep(spark, d))


# -- texts and ingestion ----------------------------------------------------------------------


@query("""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+\\n', '\n', 'g'), '[ \\t\u00a0]{2,}', ' ', 'g'), '\\n{3,}', '\n\n', 'g'), E' \\t\\n\\r\\f\\x0B')) AS digest FROM documents""")
def collapse_whitespace(spark, d):
    return A.documents(spark, d).select("doc_id", F.md5(T.collapse_whitespace(F.col("text"))).alias("digest"))


@query()
def clean_documents(spark, d):
    return A.documents(spark, d).select("doc_id", T.clean(F.col("text")).alias("text"))


@query("""SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) * 1.33::DOUBLE) AS BIGINT) + CAST(floor(len(regexp_extract_all(text, '[-.,;:!?()\\[\\]{}"''/]')) / 4) AS BIGINT)) END AS tokens,
  length(text) < 30 OR (1 - len(regexp_extract_all(text, '[\\p{L}\\p{N}]')) / nullif(length(text), 0)) > 0.8 AS noise FROM documents""")
def token_estimates(spark, d):
    t = F.col("text")
    return A.documents(spark, d).select("doc_id", T.count_tokens(t).alias("tokens"), T.is_noise(t).alias("noise"))


#: Part names as lines of all kinds: headings in three forms, and others.
LINES = """SELECT CASE p_partkey % 6 WHEN 0 THEN repeat('#', CAST(p_partkey % 8 AS INTEGER)) || ' ' || p_name || ' ' WHEN 1 THEN p_size || '.' || (p_partkey % 7) || ' ' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) WHEN 2 THEN upper(p_name) || '-' || p_type
  WHEN 3 THEN '  ' || p_size || '. ' || p_type || ' AND MORE' WHEN 4 THEN p_type || ' ' || chr(39) || upper(p_name) || ' & CO' ELSE p_name END AS l FROM part"""


@query(f"""SELECT heading, count(*) AS n FROM (SELECT CASE WHEN length(l) BETWEEN 1 AND 120 THEN CASE WHEN regexp_matches(l, '^#{{1,6}}\\s+(.{{1,120}})$') THEN trim(regexp_extract(l, '^#{{1,6}}\\s+(.{{1,120}})$', 1))
  WHEN regexp_matches(l, '^(\\d+(?:\\.\\d+)*)\\.?\\s+([A-Z][^.\\n]{{2,110}})$') THEN trim(regexp_extract(l, '^(\\d+(?:\\.\\d+)*)\\.?\\s+([A-Z][^.\\n]{{2,110}})$', 1) || ' ' || regexp_extract(l, '^(\\d+(?:\\.\\d+)*)\\.?\\s+([A-Z][^.\\n]{{2,110}})$', 2))
  WHEN regexp_matches(l, '^[A-Z][A-Z0-9 &/,''\\-]{{3,80}}$') AND len(regexp_split_to_array(l, ' +')) <= 12 THEN array_to_string(list_transform(string_split(l, ''), lambda c, i: CASE WHEN i > 1 AND regexp_matches(substr(l, i - 1, 1), '\\p{{L}}') THEN lower(c) ELSE upper(c) END), '') END END AS heading
  FROM (SELECT trim(l) AS l FROM ({LINES}))) WHERE heading IS NOT NULL GROUP BY heading""")
def headings(spark, d):
    k, name, size, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string"), F.col("p_type")
    line = (
        F.when(k % 6 == 0, F.concat(F.repeat(F.lit("#"), (k % 8).cast("int")), F.lit(" "), name, F.lit(" ")))
        .when(k % 6 == 1, F.concat(size, F.lit("."), (k % 7).cast("string"), F.lit(" "), F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1000)))
        .when(k % 6 == 2, F.concat(F.upper(name), F.lit("-"), kind))
        .when(k % 6 == 3, F.concat(F.lit("  "), size, F.lit(". "), kind, F.lit(" AND MORE")))
        .when(k % 6 == 4, F.concat(kind, F.lit(" '"), F.upper(name), F.lit(" & CO")))
        .otherwise(name)
    )
    lines = table(pin(spark), d, "part").select(T.heading(line).alias("heading"))
    return lines.where("heading IS NOT NULL").groupBy("heading").agg(F.count("*").alias("n"))


@query("""SELECT page_id, coalesce(nullif(lower(regexp_replace(regexp_replace(regexp_replace(url, '\\.[^./]+$', ''), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'doc') AS slug FROM pages""")
def document_slugs(spark, d):
    return table(pin(spark), d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("""SELECT page_id, CAST(length(t) AS BIGINT) AS n, md5(t) AS digest FROM (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<noscript\\b.*?</noscript>', '', 'g'), '(?s)<[^>]+>', '\n', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM pages)""")
def html_fallback_text(spark, d):
    t = T.strip_html(F.col("html"))
    return table(pin(spark), d, "pages").select("page_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("digest"))


@query("""WITH a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text || ' [' || (turn + 1) || '] and 【' || (turn + 7) || '】', '[\\[【［](\\d{1,2})(?:[^\\]】］\\[【［]{0,40})?[\\]】］]', '[\\1]', 'g'), '\\[0(\\d)\\]', '[\\1]', 'g') AS t FROM conversations),
  e AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(t, '\\[(\\d{1,2})\\]', 1), lambda x: CAST(x AS INTEGER))) AS ids FROM a)
  SELECT conv_id, turn, CAST(len(ids) AS BIGINT) AS cited, CAST(len(list_filter(ids, lambda x: x BETWEEN 1 AND 5)) AS BIGINT) AS valid FROM e""")
def citations(spark, d):
    c = table(pin(spark), d, "conversations")
    answer = F.concat("text", F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("] and 【"), (F.col("turn") + 7).cast("string"), F.lit("】"))
    v = T.validate_citations(answer, F.lit(5))
    return c.select("conv_id", "turn", F.size(T.citations(answer)).cast("long").alias("cited"), F.size(v["valid"]).cast("long").alias("valid"))


@query("""WITH p AS (SELECT source AS doc_id, doc_id AS page, text FROM documents), n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1),
  l AS (SELECT DISTINCT doc_id, page, trim(unnest(string_split(text, '\n'))) AS line FROM p)
  SELECT doc_id, line FROM (SELECT doc_id, line, count(*) AS c FROM l WHERE length(line) BETWEEN 1 AND 120 GROUP BY ALL) JOIN n USING (doc_id) WHERE n >= 3 AND c >= greatest(2, CAST(floor(n * 0.05::DOUBLE) AS BIGINT))""")
def boilerplate_lines(spark, d):
    return ingest.boilerplate(A.pages(spark, d), ratio=0.05)


@query()
def chunks(spark, d):
    return ingest.keep_first(ingest.chunk_pages(A.pages(spark, d)))


@query("""SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents GROUP BY text""")
def content_dedup(spark, d):
    rows = A.documents(spark, d).select("doc_id", F.sha2("text", 256).alias("sha"))
    return ingest.keep_first(rows, "sha", ("doc_id",))


@query("""SELECT count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources, count(*) FILTER (WHERE length(text) < 50) AS scanned FROM documents""")
def ingest_totals(spark, d):
    return A.documents(spark, d).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.countDistinct("source").alias("sources"), F.count_if(F.length("text") < 50).alias("scanned"))


# -- boxes and detection ----------------------------------------------------------------------


@query(f"WITH {WITH_BOXES} SELECT image_id, cls, pp, gp, ign, round(iou, 6) AS iou FROM c")
def iou_pairs(spark, d):
    return detection.candidates(A.truth_boxes(spark, d), A.found_boxes(spark, d), ["image_id", "cls"]).select("image_id", "cls", "pp", "gp", "ign", F.round("iou", 6).alias("iou"))


@query(f"""WITH RECURSIVE {WITH_BOXES},
  r AS (SELECT image_id, cls, pp, list({{'iou': iou, 'gp': gp}} ORDER BY iou DESC, gp DESC) AS cand, row_number() OVER (PARTITION BY image_id, cls ORDER BY conf DESC, pp) AS r FROM c WHERE NOT ign GROUP BY image_id, cls, pp, conf),
  w AS (SELECT image_id, cls, r, pp, cand[1].gp AS gp, cand[1].iou AS iou, [cand[1].gp] AS used FROM r WHERE r = 1
    UNION ALL SELECT n.image_id, n.cls, n.r, n.pp, list_filter(n.cand, lambda x: NOT list_contains(w.used, x.gp))[1].gp, list_filter(n.cand, lambda x: NOT list_contains(w.used, x.gp))[1].iou,
      CASE WHEN list_filter(n.cand, lambda x: NOT list_contains(w.used, x.gp))[1] IS NULL THEN w.used ELSE list_append(w.used, list_filter(n.cand, lambda x: NOT list_contains(w.used, x.gp))[1].gp) END
    FROM w JOIN r n ON n.image_id = w.image_id AND n.cls = w.cls AND n.r = w.r + 1)
  SELECT image_id, cls, pp, gp, round(iou, 6) AS iou FROM w WHERE gp IS NOT NULL""")
def greedy_matches(spark, d):
    pairs = detection.candidates(A.truth_boxes(spark, d), A.found_boxes(spark, d), ["image_id", "cls"])
    return detection.greedy(pairs, ["image_id", "cls"]).select("image_id", "cls", "pp", "gp", F.round("iou", 6).alias("iou"))


@query()
def detection_ap(spark, d):
    return detection.evaluate(A.truth_boxes(spark, d), A.found_boxes(spark, d), detection.THRESHOLDS)


@query()
def detection_operating_point(spark, d):
    gt = A.truth_boxes(spark, d)
    return detection.operating_point(detection.outcomes(gt, A.found_boxes(spark, d), ["image_id", "cls"]), gt)


@query()
def detection_confusion(spark, d):
    return detection.confusion(A.truth_boxes(spark, d), A.found_boxes(spark, d))


RESULTS = "SELECT l_returnflag AS cls, CAST(l_extendedprice AS DOUBLE) AS conf, CASE WHEN l_linenumber % 3 > 0 THEN 1 ELSE 0 END AS tp, CASE WHEN l_linenumber % 3 > 0 THEN 0 ELSE 1 END AS fp FROM lineitem"


@query(f"""WITH x AS ({RESULTS}), lv AS (SELECT cls, conf, sum(tp) AS t, sum(fp) AS f FROM x GROUP BY cls, conf),
  cum AS (SELECT cls, conf, sum(t) OVER w AS tp, sum(f) OVER w AS fp FROM lv WINDOW w AS (PARTITION BY cls ORDER BY conf DESC)), g AS (SELECT cls, count(*) AS n FROM x GROUP BY cls),
  pr AS (SELECT cls, tp / (tp + fp) AS p, tp / n AS r FROM cum JOIN g USING (cls)),
  best AS (SELECT cls, k, max(p) FILTER (WHERE r >= k * 0.01::DOUBLE) AS b FROM pr, range(0, 101) t(k) GROUP BY cls, k)
  SELECT cls, round(sum(coalesce(b, 0)) / 101, 6) AS ap FROM best GROUP BY cls""")
def average_precision(spark, d):
    li = table(pin(spark), d, "lineitem")
    tp = (F.col("l_linenumber") % 3 > 0).cast("int")
    rows = li.select(F.col("l_returnflag").alias("cls"), F.col("l_extendedprice").cast("double").alias("conf"), tp.alias("tp"), (1 - tp).alias("fp"))
    return detection.average_precision(detection.pr_curve(rows, rows.groupBy("cls").agg(F.count("*").alias("n_gt"))))


@query(f"WITH {WITH_BOXES} SELECT image_id, pos, CASE WHEN (x2 - x1) * (y2 - y1) < 1024 THEN 'small' WHEN (x2 - x1) * (y2 - y1) < 9216 THEN 'medium' ELSE 'large' END AS band, round((x1 + x2) / 2, 6) AS cx, round((x2 - x1) / (y2 - y1), 6) AS aspect FROM g")
def box_geometry(spark, d):
    b = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    z = B.xyxy_to_xyah(*b)
    return A.truth_boxes(spark, d).select("image_id", "pos", B.band(B.area(*b)).alias("band"), F.round(z[0], 6).alias("cx"), F.round(z[2], 6).alias("aspect"))


# -- labels and splits ------------------------------------------------------------------------


@query("""SELECT CASE WHEN l_linenumber % 7 = 0 THEN 'bad_field_count' WHEN l_linenumber % 7 = 6 THEN 'unparseable' WHEN l_suppkey % 5 > 3 THEN 'bad_class_id' WHEN l_discount > 0.08 THEN 'out_of_range'
  WHEN l_tax = 0 THEN 'degenerate_box' ELSE 'none' END AS issue, count(*) AS n FROM lineitem GROUP BY 1""")
def label_issues(spark, d):
    li = table(pin(spark), d, "lineitem")
    w = F.when(F.col("l_tax") == 0, "0").otherwise("0.2")
    cx = F.when(F.col("l_discount") > 0.08, "1.5").otherwise("0.5")
    line = F.concat_ws(" ", (F.col("l_suppkey") % 5).cast("string"), cx, F.when(F.col("l_linenumber") % 7 == 6, "x").otherwise("0.5"), w, F.when(F.col("l_linenumber") % 7 == 0, F.lit(None)).otherwise("0.3"))
    rows = li.select(F.lit("i").alias("image_id"), F.lit(0).alias("line_no"), line.alias("line"))
    return labels.parse_labels(rows, 4).groupBy(F.coalesce("issue", F.lit("none")).alias("issue")).agg(F.count("*").alias("n"))


@query("""SELECT scene_id, CAST(count(DISTINCT split) AS BIGINT) AS splits FROM (SELECT 's' || (o_custkey % 16) AS scene_id, CASE o_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM orders) GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def split_leaks(spark, d):
    m = A.manifest(spark, d)
    return labels.leaks(m.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("image_id") % 3 + 1).cast("int"))))


@query()
def scene_splits(spark, d):
    return labels.assign_splits(A.manifest(spark, d))


@query()
def dataset_fingerprint(spark, d):
    return labels.dataset_hash(A.manifest(spark, d))


@query("""SELECT image_id, CAST(coalesce(n, 0) AS BIGINT) AS n_objects, coalesce(c, '') AS classes, CASE WHEN n > 4 THEN 'heavy' ELSE 'unknown' END AS occlusion FROM (SELECT CAST(o_orderkey AS BIGINT) AS image_id FROM orders)
  LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS c FROM lineitem GROUP BY 1) ON k = image_id""")
def manifest_enrichment(spark, d):
    boxes = table(pin(spark), d, "lineitem").select(F.col("l_orderkey").cast("long").alias("image_id"), F.col("l_returnflag").alias("cls"))
    return labels.enrich(A.manifest(spark, d).drop("n_objects"), boxes, 4).select("image_id", "n_objects", "classes", "occlusion")


@query(f"""WITH {WITH_FRAMES} SELECT track_id, frame FROM (SELECT track_id, frame, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS n FROM u WHERE frame % 15 = 0 AND x >= 5) WHERE n <= 20""")
def frame_sampling(spark, d):
    rows = A.user_frames(spark, d).select(F.col("track_id").alias("video"), "frame", F.col("x").alias("blur"))
    return labels.sample_frames(rows, 30.0, 2.0, 20).select(F.col("video").alias("track_id"), "frame")


# -- tracks -----------------------------------------------------------------------------------


@query(f"""WITH {WITH_FRAMES}, v AS (SELECT track_id, cls, row_number() OVER (PARTITION BY track_id ORDER BY count(*) DESC, cls) AS r FROM u GROUP BY track_id, cls)
  SELECT track_id, first_frame, last_frame, n_frames, cls, round((last_frame - first_frame + 1) / 30.0::DOUBLE, 6) AS dwell_s FROM (SELECT track_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_frames FROM u GROUP BY track_id) JOIN v USING (track_id) WHERE r = 1 AND n_frames >= 3""")
def track_summaries(spark, d):
    return tracks.summaries(A.user_frames(spark, d)).select("track_id", "first_frame", "last_frame", "n_frames", "cls", "dwell_s")


@query(f"""WITH {WITH_FRAMES}, s AS (SELECT *, nullif(sign(x - 100), 0) AS s FROM u), p AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s)
  SELECT track_id, frame, cls, CASE WHEN s > 0 THEN 'in' ELSE 'out' END AS direction FROM p WHERE s <> p""")
def line_crossings(spark, d):
    return tracks.line_crossings(A.user_frames(spark, d), F.col("x") - 100)


@query(f"""WITH {WITH_FRAMES} SELECT track_id, "start", "end", "end" - "start" - 1 AS gap FROM (SELECT track_id, frame AS "start", lead(frame) OVER (PARTITION BY track_id ORDER BY frame) AS "end" FROM u WHERE cls <> 'error') WHERE "end" - "start" - 1 >= 15""")
def occlusion_events(spark, d):
    return tracks.occlusions(A.user_frames(spark, d).where("cls <> 'error'"))


RANKS = """WITH r AS (SELECT q.vec_id AS qid, c.vec_id AS id, q.label = c.label AS same, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, c.vec_id) AS rank
  FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND NOT (q.label = c.label AND q.vec_id % 2 = c.vec_id % 2))"""


@query(RANKS + """, h AS (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS k FROM r WHERE same), p AS (SELECT qid, min(rank) AS first, avg(k / rank) AS ap FROM h GROUP BY qid)
  SELECT count(*) AS n, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS cmc1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS cmc5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 6) AS cmc10, round(avg(ap), 6) AS map FROM p""")
def reid_cmc_map(spark, d):
    rows = A.vectors(spark, d).select("id", F.col("label").alias("identity"), (F.col("id") % 2).alias("camera"), "vec")
    return tracks.cmc_means(tracks.identity_scores(rows, rows.where("id % 100 = 0")))


@query("""WITH n AS (SELECT a.vec_id AS id, a.label AS l, min({'d': round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6), 'o': b.vec_id, 'l': b.label}) AS b FROM embeddings a JOIN embeddings b ON a.vec_id % 7 = b.vec_id % 7 AND a.vec_id % 100 = 0 AND b.vec_id % 2 = 1 GROUP BY a.vec_id, a.label)
  SELECT id, b.o AS other, b.d AS distance, b.l = l AND b.d < 0.9 AS ok FROM n""")
def cross_camera(spark, d):
    rows = A.vectors(spark, d).select("id", F.col("label").alias("identity"), (F.col("id") % 7).alias("cls"), "vec")
    return tracks.cross_camera(rows.where("id % 100 = 0"), rows.where("id % 2 = 1"), 0.9)


@query(RANKS + """, c AS (SELECT label, vec_id FROM embeddings), p AS (SELECT q.label = c.label AS same, CAST(least(20, floor(round(1 - round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6), 6) * 20 + 1e-9)) AS INTEGER) AS slot FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND NOT (q.label = c.label AND q.vec_id % 2 = c.vec_id % 2)),
  s AS (SELECT CAST(step AS INTEGER) AS step, count(*) FILTER (WHERE same AND slot < step) AS tp, count(*) FILTER (WHERE NOT same AND slot < step) AS fp, count(*) FILTER (WHERE same AND slot >= step) AS fn FROM p, range(1, 21) t(step) GROUP BY step)
  SELECT step, tp, fp, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM s""")
def tau_sweep(spark, d):
    rows = A.vectors(spark, d).select("id", F.col("label").alias("identity"), (F.col("id") % 2).alias("camera"), "vec")
    return tracks.sweep_counts(tracks.distance_counts(rows, rows.where("id % 100 = 0")))


@query("""SELECT scene_id, v[1] AS first, v[2] AS second FROM (SELECT 's' || (o_custkey % 16) AS scene_id, list_sort(list(DISTINCT 'v' || (o_custkey % 48))) AS v FROM orders GROUP BY 1) WHERE len(v) >= 2""")
def camera_pairs(spark, d):
    return tracks.camera_pairs(A.manifest(spark, d))


@query("""SELECT e.event_id, e.user_id, coalesce(v.event_id, -1) AS view_id, coalesce(v.value, 0.0) AS value FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def last_view_before(spark, d):
    """Of each error, what its user viewed last; -1 and 0 where there is nothing."""
    e = table(pin(spark), d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    views = e.where("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("view_id"), F.col("value").cast("double").alias("value"))
    return asof.last_before(e.where("event_type = 'error'").select("event_id", "user_id", "at"), views, ["user_id"], "at", ["view_id", "value"]).drop("at").fillna(-1, ["view_id"]).fillna(0.0, ["value"])


@query(f"""WITH {WITH_FRAMES} SELECT a.track_id, a.frame, count(*) AS near, min(a.frame - b.frame) AS nearest FROM u a JOIN u b ON a.track_id = b.track_id AND a.frame - b.frame BETWEEN 0 AND 12 AND b.cls = 'click' WHERE a.cls = 'error' GROUP BY ALL""")
def clicks_within(spark, d):
    """Of each frame with an error, the frames with a click on the track in the twelve before it."""
    u = A.user_frames(spark, d)
    clicks = u.where("cls = 'click'").select("track_id", F.col("frame").alias("_f"))
    near = asof.within(u.where("cls = 'error'").select("track_id", "frame"), clicks, ["track_id"], F.col("frame"), F.col("_f"), 12)
    return near.groupBy("track_id", "frame").agg(F.count("*").alias("near"), F.min("_far").alias("nearest"))


MIXED = "list_transform(range(1, len(a) + 1), lambda i: 0.9::DOUBLE * a[i] + 0.1::DOUBLE * b[i])"


@query(f"""WITH r AS (SELECT vec_id % 20 AS track_id, vec_id AS frame, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id) - 1 AS n FROM embeddings),
  g AS (SELECT track_id, list_reduce(list(v ORDER BY frame), lambda a, b: list_transform({MIXED}, lambda x: x / sqrt(list_dot_product({MIXED}, {MIXED})))) AS v FROM r WHERE n % 2 = 0 AND n < 12 GROUP BY track_id)
  SELECT track_id, round(v[1], 6) AS first, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: i * v[i])), 5) AS weighted FROM g""")
def camera_gallery(spark, d):
    """Of each track's average look, its first component and the sum of all, weighted by their places."""
    rows = A.vectors(spark, d).select((F.col("id") % 20).alias("track_id"), F.col("id").alias("frame"), "vec")
    weighted = F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return tracks.camera_gallery(rows, 2, 6).select("track_id", F.round(F.col("vec")[0], 6).alias("first"), F.round(weighted, 5).alias("weighted"))


@query(f"WITH {WITH_CLEAR} SELECT * FROM clear")
def track_scores(spark, d):
    gt, pred = A.track_boxes(spark, d)
    return tracking_metrics.clear_mot(tracking_metrics.frame_matches(gt, pred))


@query(f"WITH {WITH_TRACKS}{WITH_IDENTITY} SELECT * FROM ident")
def track_identity(spark, d):
    return tracking_metrics.idf1(*A.track_boxes(spark, d))


@query(f"WITH {WITH_TRACKS}{WITH_HOTA} SELECT * FROM hota")
def track_hota(spark, d):
    return tracking_metrics.hota(*A.track_boxes(spark, d))


@query(f"""WITH {WITH_TRACKS}, e AS (SELECT * FROM (SELECT track_id, frame AS s, lead(frame) OVER (PARTITION BY track_id ORDER BY frame) AS t FROM u WHERE cls <> 'error') WHERE t - s - 1 >= 15),
  r AS (SELECT e.track_id, s, arg_min(pred_id, s - frame) FILTER (WHERE s - frame BETWEEN 0 AND 8) AS b, arg_min(pred_id, frame - t) FILTER (WHERE frame - t BETWEEN 0 AND 8) AS a FROM e LEFT JOIN m ON m.gt_id = e.track_id AND iou >= 0.5 GROUP BY ALL)
  SELECT count(*) AS events, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS scored, count(*) FILTER (WHERE a = b) AS recovered, round(count(*) FILTER (WHERE a = b) / nullif(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL), 0), 6) AS rate FROM r""")
def occlusion_recovery(spark, d):
    gt, pred = A.track_boxes(spark, d)
    events = tracks.occlusions(A.user_frames(spark, d).where("cls <> 'error'"))
    return tracks.recovery(events, tracking_metrics.frame_matches(gt, pred).where("kind = 'match'"))


def _detections(spark, d):
    rows = A.user_frames(spark, d)
    place = (F.col("track_id") % 40) * 60.0 + F.pmod(F.col("frame"), F.lit(6))
    return rows.select(
        F.concat(F.lit("c"), (F.col("track_id") % 16).cast("string")).alias("camera_id"), "frame", F.col("track_id").alias("det_id"), F.lit("person").alias("cls"), F.lit(0.9).alias("conf"),
        place.alias("x1"), F.lit(0.0).alias("y1"), (place + 40).alias("x2"), F.lit(80.0).alias("y2"),
    )


@query()
def tracker_bytetrack(spark, d):
    return tracker.track(_detections(spark, d), tracker.TRACKERS["bytetrack"])


def _one_camera(spark, d):
    """All users in the view of one camera that pans: each has a place, and one in five walks through it."""
    rows = A.user_frames(spark, d)
    walks = F.when(F.col("track_id") % 5 == 0, F.pmod(F.col("frame") * (F.col("track_id") % 7 + 2), F.lit(40))).otherwise(0)
    x = F.col("track_id") * 100.0 + walks + F.pmod(F.col("frame"), F.lit(50)) * 6
    return rows.select(
        F.lit("c0").alias("camera_id"), "frame", F.col("track_id").alias("det_id"), F.lit("person").alias("cls"), F.lit(0.9).alias("conf"),
        x.alias("x1"), F.lit(0.0).alias("y1"), (x + 40).alias("x2"), F.lit(80.0).alias("y2"),
    )


@query()
def camera_motion(spark, d):
    return motion.camera_motion(_one_camera(spark, d)).select("camera_id", "frame", F.transform("warp", lambda v: F.round(v, 6)).alias("warp"), "matches")


@query()
def tracker_botsort(spark, d):
    """With the camera's motion taken out."""
    detections = _detections(spark, d)
    return tracker.track(detections, tracker.TRACKERS["botsort"], motion.camera_motion(detections))


@query()
def tracker_live(spark, d):
    """tracker_bytetrack over a stream of files by time, in two runs with one checkpoint."""
    folder = fresh_folder(spark, "live")
    rows = _detections(spark, d)
    half = rows.agg(F.floor((F.min("frame") + F.max("frame")) / 2)).first()[0]
    for part in (rows.where(F.col("frame") <= half), rows.where(F.col("frame") > half)):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        tracker.run_live(stream, f"{folder}/out", f"{folder}/mark", tracker.TRACKERS["bytetrack"])
    return tracker.live_tracks(spark, f"{folder}/out")


@query()
def tracker_iou(spark, d):
    return tracker.track(_detections(spark, d), tracker.TRACKERS["iou"])


@query("""SELECT event_type, count(*) AS n, round(sum(CAST(value AS DOUBLE)), 2) AS total FROM events GROUP BY event_type""")
def event_totals(spark, d):
    return table(pin(spark), d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 2).alias("total"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


from siftwork.plans import report_queries  # noqa: E402, F401  registers its queries here
