"""Queries of fallbacks: missing lists, lengths and keys, failing rows, paths that are or aren't there, restarts. With their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, frames
from ..functions.udfs import guarded
from ..operators import lookup, packing, sampling
from ..session import table


def _text(values: object) -> object:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


def list_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of records as lists, written as a value or as a list of values; boxes of raw records as an empty list."""
    rows = table(spark, sf_dir, "visual_records")
    written = F.when(F.pmod("conv_id", F.lit(2)) == 0, F.to_json("image")).otherwise(F.get("image", F.lit(0)))
    return rows.groupBy("conv_id", F.array_join(arrays.scalar_or_list(written), ",").alias("images"), F.size(arrays.or_empty(F.col("bboxes"), "array<double>")).alias("n_boxes")).agg(F.count(F.lit(1)).alias("n_rows"))


def grid_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds a grid: as given for every third record, ones for the others."""
    rows = table(spark, sf_dir, "video_records").select("rec_id").distinct()
    grids = F.sequence(F.lit(1), (F.pmod("rec_id", F.lit(4)) + 1).cast("int"))
    given = F.when(F.col("rec_id") % 3 == 0, F.transform(grids, lambda g: g * 0.5))
    return rows.select("rec_id", _text(frames.seconds_per_grid(given, grids)).alias("seconds"))


def key_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of languages by a map, the code itself where the map has none."""
    names = F.create_map(*(F.lit(x) for pair in (("en", "English"), ("de", "German"), ("fr", "French")) for x in pair))
    named = table(spark, sf_dir, "documents").select(arrays.lookup_or(names, F.coalesce("lang", F.lit("none")), F.coalesce("lang", F.lit("none"))).alias("name"))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))


def cut_reflection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflection tokens lost behind a cut after four tokens."""
    ids = F.transform(F.sequence(F.lit(1), F.col("l_linenumber").cast("int") + 3), lambda i: F.pmod(F.col("l_partkey") + i, F.lit(3)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", packing.discarded_reflection_tokens(ids, 4, 1).cast("bigint").alias("n_lost"))


def skipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of languages read by a step that fails on unknown ones and on blank ones in two ways; both are skipped and counted."""

    def step(value: str | None) -> str:
        if not value:
            raise OSError("nothing to read")
        if value not in ("en", "de", "fr", "es", "zh"):
            raise ValueError(value)
        return value.upper()

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("value"))
    return guarded(rows, step).groupBy("value", "error").agg(F.count(F.lit(1)).alias("n_rows"))


def present_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of video records in a folder, but for those that are files as they stand: here every record of an even id."""
    rows = table(spark, sf_dir, "video_records").where("video is not null").groupBy("rec_id").agg(F.min("video").alias("video")).withColumn("folder", F.lit("/videos"))
    there = rows.where("rec_id % 2 = 0").select(F.col("video").alias("path"))
    return lookup.resolve_paths(rows, "video", "folder", there).select("rec_id", "resolved")


def resumed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of four workers goes on at its hundredth row."""
    return sampling.resumed(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord")), "ord", 1, 4, 100)


QUERIES = {
    "list_fallbacks": list_fallbacks,
    "grid_seconds": grid_seconds,
    "key_fallbacks": key_fallbacks,
    "cut_reflection": cut_reflection,
    "skipped_rows": skipped_rows,
    "present_paths": present_paths,
    "resumed_rows": resumed_rows,
}
ORACLE = {
    "list_fallbacks": "SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN array_to_string(image, ',') ELSE image[1] END AS images, CAST(coalesce(len(bboxes), 0) AS INTEGER) AS n_boxes, count(*) AS n_rows FROM visual_records GROUP BY ALL",
    "grid_seconds": "SELECT rec_id, array_to_string(list_transform(range(rec_id % 4 + 1), lambda i: CASE WHEN rec_id % 3 = 0 THEN (i + 1) * 0.5::DOUBLE ELSE 1.0::DOUBLE END), ',') AS seconds FROM (SELECT DISTINCT rec_id FROM video_records) v",
    "key_fallbacks": "SELECT CASE coalesce(lang, 'none') WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE coalesce(lang, 'none') END AS name, count(*) AS n_rows FROM documents GROUP BY 1",
    "cut_reflection": "SELECT l_orderkey, l_linenumber, CAST(len(list_filter(range(5, l_linenumber + 4), lambda i: (l_partkey + i) % 3 = 1)) AS BIGINT) AS n_lost FROM lineitem",
    "skipped_rows": "SELECT CASE WHEN lang IN ('en', 'de', 'fr', 'es', 'zh') THEN upper(lang) END AS value, CASE WHEN coalesce(lang, '') = '' THEN 'OSError' WHEN lang NOT IN ('en', 'de', 'fr', 'es', 'zh') THEN 'ValueError' END AS error, count(*) AS n_rows FROM documents GROUP BY 1, 2",
    "present_paths": "WITH v AS (SELECT rec_id, min(video) AS video FROM video_records WHERE video IS NOT NULL GROUP BY rec_id) SELECT rec_id, CASE WHEN video LIKE '/%' OR video LIKE 'http%' OR video IN (SELECT video FROM v WHERE rec_id % 2 = 0) THEN video ELSE '/videos/' || video END AS resolved FROM v",
    "resumed_rows": "SELECT o_orderkey AS ord FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey // 4 >= 100",
}
