"""The registered queries of the subpackage, over whole tables."""

from __future__ import annotations

import public_tokenizers

from siftwork.llm import common, html_crf, jaccard_join, jpeg, neardup, packing, pii, piece_bpe, quality, sharding, topk, toxicity, vector_codes


def op1_quality(spark, sf_dir):
    return quality.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op2_main_text(spark, sf_dir):
    return html_crf.main_text(common.table(spark, sf_dir, "pages"))


def op3_packing(spark, sf_dir):
    path = public_tokenizers.path
    return packing.pack(common.table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


def op4_piece_bpe(spark, sf_dir):
    return piece_bpe.piece_digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_sharding(spark, sf_dir):
    return sharding.assign(common.table(spark, sf_dir, "documents"))


def op6_media(spark, sf_dir):
    return jpeg.media_digests(common.table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def op8_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(common.table(spark, sf_dir, "documents"), words=3, percent=85)


def op9_personal_data(spark, sf_dir):
    return pii.find(common.table(spark, sf_dir, "documents"))


def op10_top_k(spark, sf_dir):
    return topk.search(common.table(spark, sf_dir, "embeddings"))


def op11_vector_codes(spark, sf_dir):
    return vector_codes.compress(common.table(spark, sf_dir, "embeddings"))


def op12_jaccard_join(spark, sf_dir):
    return jaccard_join.join(common.table(spark, sf_dir, "documents"), words=5, percent=80)


def queries() -> dict:
    found = (op1_quality, op2_main_text, op3_packing, op4_piece_bpe, op5_sharding, op6_media, op7_toxicity, op8_near_duplicates, op9_personal_data, op10_top_k, op11_vector_codes, op12_jaccard_join)
    return {f.__name__: f for f in found}


TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


NEAR_DUPLICATES = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM t
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (
  SELECT doc_id AS id, doc_id AS far FROM s UNION SELECT r.id, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.far
), c AS (SELECT id, min(far) AS component_id FROM r GROUP BY id)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.id = s.doc_id
"""


def _linked(words: int, percent: int) -> str:
    """Components of documents that link by their sets of `words`-word shingles."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(words))
    return f"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {shingle})) END AS sh FROM t
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (
  SELECT doc_id AS id, doc_id AS far FROM s UNION SELECT r.id, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.far
), c AS (SELECT id, min(far) AS component_id FROM r GROUP BY id)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id FROM s JOIN c ON c.id = s.doc_id
"""


def _vector_codes(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Rounds of assigning parts to entries and moving the entries, as one chain of tables."""
    steps = [
        """v AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""cut AS MATERIALIZED (
  SELECT r, vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM v, range({parts}) AS t(p)
)""",
        f"""b0 AS MATERIALIZED (SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY r) - 1 AS e FROM cut) WHERE e < {entries})""",
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, p, any_value(x) AS x, min(d) AS d, arg_min(e, (d, e)) AS e
  FROM (SELECT cut.*, e, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d FROM cut JOIN b{k} USING (p)) GROUP BY r, p
)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (
    SELECT p, e, list(y ORDER BY i) AS c FROM (
      SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS y FROM a{k}, range(1, 4097) AS t(i) WHERE i <= len(x) GROUP BY p, e, i
    ) GROUP BY p, e
  ) m ON m.p = b.p AND m.e = b.e
)""")
    last = rounds
    steps.append(f"sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last})")
    steps.append(f"o AS (SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY r)")
    return "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, sha"


def oracle_sql() -> dict:
    return {
        "op8_near_duplicates": NEAR_DUPLICATES,
        "op10_top_k": TOP_K,
        "op11_vector_codes": _vector_codes(),
        "op12_jaccard_join": _linked(5, 80),
    }
