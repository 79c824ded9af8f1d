"""Resolve names to files: an index by name and stem, lookups by one or two keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..session import maybe_broadcast

BROADCAST_ROWS = 1_000_000


def video_index(files: DataFrame, path: str = "path") -> DataFrame:
    """(key, path): every file that may be a video, under its name and its stem; of several, the first path in order."""
    name = X.basename(F.col(path))
    kept = files.select(F.col(path).alias("path"), name.alias("name")).where(~X.ending(F.col("name")).isin(*config.NON_VIDEO_ENDINGS) & ~F.startswith("name", F.lit(".")) & (F.col("name") != ""))
    keys = kept.select("path", F.explode(F.array_distinct(F.array("name", X.stem(F.col("name"))))).alias("key"))
    return keys.groupBy("key").agg(F.min("path").alias("path"))


def look_up(rows: DataFrame, index: DataFrame, *names: Column) -> DataFrame:
    """rows with found: the path of the first name that the index knows, by name, then by stem; null if it knows none."""
    small = maybe_broadcast(index, BROADCAST_ROWS)
    keys = [k for n in names for k in (X.basename(n), X.stem(X.basename(n)))]
    out, paths = rows, []
    for i, k in enumerate(keys):
        side = small.select(F.col("key").alias(f"_k{i}"), F.col("path").alias(f"_p{i}"))
        out = out.withColumn(f"_j{i}", k).join(side, F.col(f"_j{i}") == F.col(f"_k{i}"), "left").drop(f"_j{i}", f"_k{i}")
        paths.append(f"_p{i}")
    return out.withColumn("found", F.coalesce(*paths)).drop(*paths)


def missing(rows: DataFrame, index: DataFrame, name: str) -> DataFrame:
    """(n_missing): how many rows the index can't resolve."""
    return look_up(rows, index, F.col(name)).agg(F.sum(F.col("found").isNull().cast("bigint")).alias("n_missing"))


def resolve_paths(rows: DataFrame, path: str, folder: str, files: DataFrame) -> DataFrame:
    """rows with resolved: a path that is among the files (path), or is absolute or an address, as it is, another one in its folder."""
    known = maybe_broadcast(files.select(F.col("path").alias("_path")).distinct(), BROADCAST_ROWS)
    both = rows.join(known, F.col(path) == F.col("_path"), "left")
    return both.withColumn("resolved", F.when(F.col("_path").isNotNull(), F.col(path)).otherwise(X.in_folder(F.col(path), F.col(folder)))).drop("_path")
