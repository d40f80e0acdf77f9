"""The jobs as registered queries: each runs twice into one new folder and gives what stands there."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobs import passage_store, track_report
from siftwork.session import fresh_folder


def job1_passage_store(spark, sf_dir):
    folder = fresh_folder(spark, "job1")
    for _ in range(2):  # the second run finds nothing new
        passage_store.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return passage_store.stored(spark, f"{folder}/out")


def job2_track_report(spark, sf_dir):
    folder = fresh_folder(spark, "job2")
    for _ in range(2):
        track_report.run(spark, f"{sf_dir}/events.parquet", f"{folder}/out")
    return track_report.stored(spark, f"{folder}/out").withColumn("day", F.col("day").cast("string"))


PASSAGES = r"""
WITH c AS (
  SELECT doc_id, lang, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+\n', E'\n', 'g'), '[ \t' || chr(160) || ']{2,}', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), E' \t\n\r\f\x0B') AS text FROM documents
), l AS (SELECT doc_id, lang, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM c), p AS (
  SELECT doc_id, lang, unnest(l) AS text, unnest(range(len(l))) AS passage_no FROM l
), k AS (
  SELECT *, sha256(text) AS sha, row_number() OVER (PARTITION BY text ORDER BY doc_id, passage_no, lang) AS r FROM p
  WHERE NOT (length(text) < 30 OR (1 - len(regexp_extract_all(text, '[\p{L}\p{N}]')) / nullif(length(text), 0)) > 0.8)
)
SELECT doc_id, CAST(passage_no AS INTEGER) AS passage_no, text,
  greatest(1, CAST(floor(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) * 1.33::DOUBLE) AS BIGINT) + CAST(floor(len(regexp_extract_all(text, '[-.,;:!?()\[\]{}"''/]')) / 4) AS BIGINT)) AS token_count,
  sha, CAST(0 AS BIGINT) AS batch, lang FROM k WHERE r = 1
"""


TRACKS = """
WITH f AS (
  SELECT user_id AS track_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame, arg_max(event_type, event_id) AS cls, arg_max(value, event_id) AS x FROM events GROUP BY ALL
), d AS (SELECT *, CAST(DATE '1970-01-01' + CAST(frame // 24 AS INTEGER) AS DATE) AS day, nullif(sign(x - 100), 0) AS s FROM f), seen AS (
  SELECT day, cls, count(DISTINCT track_id) AS tracks, count(*) AS frames FROM d GROUP BY ALL
), p AS (
  SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM d
), crossed AS (SELECT day, cls, count(*) FILTER (WHERE s > 0) AS entered, count(*) FILTER (WHERE s < 0) AS gone FROM p WHERE s <> p GROUP BY ALL), hidden AS (
  SELECT day, cls, count(*) AS occlusions, sum(gap) AS occluded_frames
  FROM (SELECT *, frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) - 1 AS gap FROM d WHERE cls <> 'error') WHERE gap >= 15 GROUP BY ALL
)
SELECT cls, tracks, frames, coalesce(entered, 0) AS entered, coalesce(gone, 0) AS "left", coalesce(occlusions, 0) AS occlusions, CAST(coalesce(occluded_frames, 0) AS BIGINT) AS occluded_frames, CAST(day AS VARCHAR) AS day
FROM seen LEFT JOIN crossed USING (day, cls) LEFT JOIN hidden USING (day, cls)
"""


def queries() -> dict:
    return {f.__name__: f for f in (job1_passage_store, job2_track_report)}


def oracle_sql() -> dict:
    return {"job1_passage_store": PASSAGES, "job2_track_report": TRACKS}
