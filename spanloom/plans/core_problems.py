"""Queries of the general problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import video_periods
from ..session import table
from ..sources.raw_records import load_lines, rejected_lines


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_lines(table(spark, sf_dir, "raw_records"))


def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_lines(table(spark, sf_dir, "raw_records")).where(F.col("reason").isNull()).drop("reason")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video_periods(table(spark, sf_dir, "video_records"))


QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p2_found": p2_found}

_NUM = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_PAIR = rf"\[\s*{_NUM}\s*,\s*{_NUM}\s*\]"
ORACLE = {
    "p2_found": rf"""
WITH texts AS (
  SELECT video, coalesce(temporal_span, clue_intervals) AS t FROM video_records
  WHERE video IS NOT NULL AND trim(video, chr(9) || chr(10) || chr(13) || chr(160) || ' ') <> ''
), bad AS (
  SELECT DISTINCT t FROM texts WHERE len(list_filter(regexp_extract_all(t, '{_NUM}'), lambda x: TRY_CAST(x AS DOUBLE) IS NULL OR CAST(x AS DOUBLE) < 0 OR isinf(CAST(x AS DOUBLE)))) > 0
), spans AS (
  SELECT video, CAST(round_even(least(n[1], n[2]) * 1000, 0) AS BIGINT) AS s, CAST(round_even(greatest(n[1], n[2]) * 1000, 0) AS BIGINT) AS e
  FROM (SELECT texts.video, [CAST(x AS DOUBLE) FOR x IN regexp_extract_all(p, '{_NUM}')] AS n
        FROM texts, LATERAL (SELECT unnest(regexp_extract_all(t, '{_PAIR}')) AS p)
        WHERE t NOT IN (SELECT t FROM bad)
          AND (regexp_full_match(t, '\s*{_PAIR}\s*') OR regexp_full_match(t, '\s*\[\s*{_PAIR}\s*(,\s*{_PAIR}\s*)*\]\s*')))
), real_spans AS (SELECT DISTINCT video, s, e FROM spans WHERE s < e
), reach AS (
  SELECT *, max(e) OVER (PARTITION BY video ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM real_spans
), islands AS (
  SELECT *, sum(CASE WHEN reached IS NULL OR s > reached THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM reach
), periods AS (SELECT video, island, min(s) AS s, max(e) AS e FROM islands GROUP BY video, island
), gaps AS (SELECT video, lag(e) OVER (PARTITION BY video ORDER BY s) AS s, s AS e FROM periods)
SELECT video, 'period' AS kind, s AS start_ms, e AS end_ms FROM periods
UNION ALL SELECT video, 'gap', s, e FROM gaps WHERE s IS NOT NULL
""",
}
