"""Sources: record files, manifests, benchmarks, archives, file trees."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..config import EvalTask, task_options
from ..functions import text as X
from ..functions.answers import bracketed_letter, option_letter
from ..functions.arrays import compact_images, scalar_or_list
from ..operators.lookup import look_up, video_index
from .files import exists, first_file, first_folder, json_elements, list_files, names_in

RECORD_SCHEMA = "image string, bboxes array<array<double>>, conversations array<struct<from:string,value:string>>, video string, question string, answer string, temporal_span string, clue_intervals string"


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are one JSON array each, a row for each element with its position as ord, which survives any later filter."""
    parsed = json_elements(spark, path).select("file", "ord", F.from_json("element", schema).alias("r"))
    return parsed.select("file", "ord", "r.*")


def read_records(spark: SparkSession, path: str, name: str = "dataset") -> DataFrame:
    """Training records of one JSON array file; image may be a text or a list, spans stay JSON text."""
    rows = read_json_array(spark, path, RECORD_SCHEMA)
    return rows.withColumn("image", scalar_or_list(F.col("image"))).withColumn("ds_name", F.lit(name))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file, or of all files that it lists if it is a manifest, under their source names.

    A file is a manifest if its first element has no conversations. Every entry
    is read. Paths are relative to the manifest's folder unless absolute. Two
    entries of one name are refused: they would be one source under two weights.
    """
    head = read_json_array(spark, path, "conversations array<struct<from:string,value:string>>, data_path string, image_folder string, ds_name string")
    first = head.where("ord = 0").select("conversations").first()
    if first is None or first[0] is not None:
        return read_records(spark, path).withColumn("image_folder", F.lit(None).cast("string"))
    entries = head.select("data_path", "image_folder", "ds_name").orderBy("ord").collect()
    twice = sorted(n for n, k in Counter(m.ds_name for m in entries).items() if k > 1)
    if twice:
        raise ValueError(f"sources named twice: {twice}")
    parts = [read_records(spark, os.path.join(os.path.dirname(path), m.data_path), m.ds_name).withColumn("image_folder", F.lit(m.image_folder).cast("string")) for m in entries]
    return union_all(parts)


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, blank ones left out."""
    lines = spark.read.text(path).where(F.length(X.strip(F.col("value"))) > 0)
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_four_options(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Base64 images with options A to D: question_id, image, query, label, category. With a split (4k or 8k) path is a folder."""
    rows = spark.read.parquet(f"{path}/{config.FOUR_OPTION_FILE.format(split)}" if split else path)
    category = F.col("category") if "category" in rows.columns else F.lit("overall")
    return rows.select(F.col("index").cast("bigint").alias("question_id"), F.unbase64("image").alias("image"), X.four_option_prompt(*map(F.col, ("question", "A", "B", "C", "D"))).alias("query"), F.col("answer").alias("label"), category.alias("category"))


def read_configs(spark: SparkSession, folder: str, split: str = "val") -> DataFrame:
    """One split of several configurations, each a folder of Parquet files named by split (assets left out), the name as category."""
    parts = []
    for name in names_in(spark, folder, folders=True):
        if name == config.ASSETS_FOLDER:
            continue
        rows = spark.read.option("pathGlobFilter", f"{split}[-_.]*").parquet(f"{folder}/{name}")
        images = compact_images(*(F.col(c) for c in ("image_1", "image_2", "image_3", "image_4") if dict(rows.dtypes).get(c) in ("binary", "string")))  # a column of nulls alone has no such type
        parts.append(rows.select(F.col("idx").cast("string").alias("question_id"), images.alias("image"), X.lettered_prompt(F.col("question"), F.col("choices")).alias("query"), bracketed_letter(F.col("answer")).alias("label"), F.lit(name).alias("category")))
    return union_all(parts)


def read_first_parquet(spark: SparkSession, folder: str, preferred: str = ".parquet") -> DataFrame:
    """The table of the first Parquet file below a folder, of one with the preferred ending if there is any, with each row's position as ord."""
    path = first_file(spark, folder, preferred, ".parquet")
    if path is None:
        raise FileNotFoundError(f"no Parquet file below {folder}")
    rows = spark.read.parquet(path)
    return rows.withColumn("ord", F.col("_metadata.row_index"))


def read_url_keyed(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Video questions keyed by URL, or by videoID where the URL's isn't found; those without a file are left out."""
    key = X.url_video_id(F.col("url"), F.col("videoID"))
    found = look_up(rows.withColumn("_key", key), index, F.col("_key"), F.col("videoID")).where("found is not null")
    category = F.col("duration") if "duration" in rows.columns else F.lit("overall")
    return found.select(X.composite_id(F.col("video_id"), F.col("question_id")).alias("id"), F.col("found").alias("video"), "question", F.col("options").alias("choices"), option_letter(F.col("answer").cast("string"), F.col("options")).alias("label"), category.alias("category"))


def read_name_keyed(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Video questions keyed by name. rows carry ord, their position before any filter (read_first_parquet gives it); question_id and task_type may be missing."""
    given = F.nullif(F.col("question_id").cast("string"), F.lit("")) if "question_id" in rows.columns else F.lit(None).cast("string")
    task = F.nullif(F.col("task_type"), F.lit("")) if "task_type" in rows.columns else F.lit(None).cast("string")
    found = look_up(rows, index, F.col("video_name")).where("found is not null")
    return found.select(F.coalesce(given, X.composite_id(F.col("video_name"), F.col("ord"))).alias("id"), F.col("found").alias("video"), "question", F.col("candidates").alias("choices"), option_letter(F.col("answer").cast("string"), F.col("candidates")).alias("label"), F.coalesce(task, F.lit("overall")).alias("category"))


def read_task_folder(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """A folder of JSON arrays, one per task: id from the task's name and the position in its file."""
    schema = "video string, question string, candidates array<string>, answer string"
    rows = read_json_array(spark, os.path.join(folder, "*.json"), schema).withColumn("task", X.stem(X.basename(F.col("file"))))
    found = look_up(rows, index, F.col("video")).where("found is not null")
    return found.select(X.composite_id(F.col("task"), F.col("ord")).alias("id"), F.col("found").alias("video"), "question", F.col("candidates").alias("choices"), option_letter(F.col("answer"), F.col("candidates")).alias("label"), F.col("task").alias("category"))


def resolve_source(spark: SparkSession, source: str) -> str:
    """A folder that there is, as it is; anything else would need a download."""
    if exists(spark, source):
        return source
    raise FileNotFoundError(f"{source} is no folder")


#: Loaders of tasks by name: a function of (spark, path, options) that gives the task's table.
LOADERS: dict[str, Callable[[SparkSession, str, EvalTask], DataFrame]] = {}


def register_loader(*names: str) -> Callable:
    """Register a loader for tasks; the names must be free."""

    def add(loader: Callable[[SparkSession, str, EvalTask], DataFrame]) -> Callable:
        for name in names:
            if name in LOADERS:
                raise ValueError(f"a loader for {name} is registered already")
            LOADERS[name] = loader
        return loader

    return add


def load_task(spark: SparkSession, name: str, path: str, **given: object) -> DataFrame:
    """The table of a registered task, its options being the task's defaults and what is given beside them."""
    if name not in LOADERS:
        raise ValueError(f"no loader for {name!r}; there are {sorted(LOADERS)}")
    return LOADERS[name](spark, resolve_source(spark, path), task_options(name, **given))


@register_loader("hrbench4k", "hrbench8k")
def _four_options(spark: SparkSession, path: str, options: EvalTask) -> DataFrame:
    return read_four_options(spark, path, options.split)


@register_loader("blink")
def _configs(spark: SparkSession, path: str, options: EvalTask) -> DataFrame:
    return read_configs(spark, path, options.split or "val")


@register_loader("videomme")
def _url_keyed(spark: SparkSession, path: str, options: EvalTask) -> DataFrame:
    return read_url_keyed(read_first_parquet(spark, path, config.URL_KEYED_FILE), video_index(list_files(spark, path)))


@register_loader("mlvu")
def _name_keyed(spark: SparkSession, path: str, options: EvalTask) -> DataFrame:
    return read_name_keyed(read_first_parquet(spark, path), video_index(list_files(spark, path)))


@register_loader("mvbench")
def _task_folder(spark: SparkSession, path: str, options: EvalTask) -> DataFrame:
    return read_task_folder(spark, first_folder(spark, path, config.TASK_FOLDER) or path, video_index(list_files(spark, path)))
