"""Queries that write a table's rows in a source's layout and read them by its reader, with SQL over the table itself.

The tables written are the fixed ones (items, manifest) and, where the size
matters, the raw records and video records, which Spark writes in parts.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..functions.udfs import predict
from ..operators import automata, conversations
from ..session import scratch, table
from ..sources import files, readers
from .relation_queries import index


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items")


def _write_array(rows: DataFrame, path: str, *order: str) -> str:
    """Rows as one JSON array in order."""
    lines = rows.orderBy(*order).select(F.to_json(F.struct("*")).alias("v")).toLocalIterator()
    return files.write_text(rows.sparkSession, path, _array_parts(lines))


def _array_parts(lines: Iterator) -> Iterator[str]:
    yield "["
    for n, r in enumerate(lines):
        yield (",\n" if n else "") + r.v
    yield "]"


def _raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as raw records: the box in a reply, the question with the request for it."""
    turn = lambda who, said: F.struct(F.lit(who).alias("from"), said.alias("value"))
    box = F.format_string("[0.1, 0.2, 0.%d, 0.9]", F.pmod("item_id", F.lit(7)) + 3)
    asked = F.concat(F.col("question"), F.lit(" Please provide the bounding box coordinate of it."))
    return _items(spark, sf_dir).select("item_id", F.array(F.format_string("%d.jpg", "item_id"), F.lit("crop.jpg")).alias("image"), F.array(turn("human", asked), turn("gpt", box), turn("human", F.lit("<image>")), turn("gpt", F.col("answer"))).alias("conversations"))


def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of a raw and a normalised record file, read, told apart and normalised."""
    folder = scratch(spark, "records")
    raw = _raw_items(spark, sf_dir)
    _write_array(raw.where("item_id % 2 = 0").drop("item_id"), f"{folder}/raw.json", "image")
    ready = raw.where("item_id % 2 = 1").select("image", F.array(F.array(*map(F.lit, (0.0, 0.0, 0.5, 0.5)))).alias("bboxes"), "conversations")
    _write_array(ready, f"{folder}/ready.json", "image")
    _write_array(spark.createDataFrame([("raw.json", "/images", "raw"), ("ready.json", "/images", "ready")], "data_path string, image_folder string, ds_name string"), f"{folder}/manifest.json", "data_path")
    made = conversations.normalize_files(readers.read_sources(spark, f"{folder}/manifest.json"), "ds_name")
    return made.select("ds_name", "ord", "image", F.size("bboxes").alias("n_boxes"), F.round(F.get(F.get("bboxes", F.lit(0)), F.lit(2)), 6).alias("x1"), "question", "answer")


def source_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines with blank lines between them, written by Spark in parts and read by a schema."""
    path = scratch(spark, "lines")
    lines = F.concat(F.to_json(F.struct("doc_id", "text", "source")), F.when(F.col("doc_id") % 3 == 0, F.lit("\n \t \n")).otherwise(F.lit("")))
    table(spark, sf_dir, "documents").select(lines.alias("value")).write.text(path)
    rows = readers.read_json_lines(spark, path, "doc_id bigint, text string, source string")
    return rows.select("doc_id", F.md5("text").alias("text"), "source")


def source_four_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "four")
    options = [F.get("options", F.lit(i)).alias(c) for i, c in enumerate("ABCD")]
    rows = _items(spark, sf_dir).select(F.col("item_id").alias("index"), F.base64(F.col("benchmark").cast("binary")).alias("image"), "question", *options, "answer", F.col("task_type").alias("category"))
    rows.write.parquet(f"{folder}/{config.FOUR_OPTION_FILE.format('4k')}")
    made = readers.load_task(spark, "hrbench4k", folder)
    return made.select("question_id", F.col("image").cast("string").alias("image"), "query", "label", "category")


def source_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration for each benchmark; only the val split is read."""
    folder = scratch(spark, "configs")
    for name in [r.benchmark for r in _items(spark, sf_dir).select("benchmark").distinct().collect()]:
        image = lambda k: F.when(F.pmod("item_id", F.lit(k)) == 0, F.encode(F.lit(f"i{k}"), "UTF-8")).alias(f"image_{k}")
        own = _items(spark, sf_dir).where(F.col("benchmark") == name).select(F.col("item_id").alias("idx"), "question", F.col("options").alias("choices"), F.format_string("(%s)", "answer").alias("answer"), *map(image, (1, 2, 3, 4)))
        for split, part in (("val", "idx % 3 < 2"), ("test", "idx % 3 = 2")):
            staged = f"{folder}-{split}/{name}"
            own.where(part).coalesce(1).write.parquet(staged)
            _move_parts(spark, staged, f"{folder}/{name}", split)
    files.write_text(spark, f"{folder}/assets/readme.txt", iter(["x"]))
    return readers.load_task(spark, "blink", folder).select("question_id", F.size("image").alias("n_images"), "query", "label", "category")


def _move_parts(spark: SparkSession, staged: str, folder: str, prefix: str) -> None:
    """Parquet parts under a prefix of their own, as splits are named."""
    system, target = files.hadoop(spark, folder)
    system.mkdirs(target)
    for n, name in enumerate(n for n in files.names_in(spark, staged, folders=False) if n.endswith(".parquet")):
        system.rename(files.hadoop(spark, f"{staged}/{name}")[1], files.hadoop(spark, f"{folder}/{prefix}-{n:05d}.parquet")[1])


def _video_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the number of the video they ask about."""
    return _items(spark, sf_dir).withColumn("name", F.concat(F.lit("v"), F.lpad(F.pmod("item_id", F.lit(160)).cast("string"), 8, "0")))


def source_url_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred Parquet file among others, its rows keyed by URL or id."""
    folder = scratch(spark, "urls")
    url = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("https://tube.example/watch?v="), F.col("name")))
    rows = _video_items(spark, sf_dir).select(url.alias("url"), F.col("name").alias("videoID"), F.col("name").alias("video_id"), F.col("item_id").alias("question_id"), "question", "options", "answer", F.col("benchmark").alias("duration"))
    for name, part in (("a-other", rows.limit(0)), (config.URL_KEYED_FILE.removesuffix(".parquet"), rows)):
        part.coalesce(1).write.parquet(f"{folder}-staged/{name}")
        system, place = files.hadoop(spark, folder)
        system.mkdirs(place)
        written = next(n for n in files.names_in(spark, f"{folder}-staged/{name}", folders=False) if n.endswith(".parquet"))
        system.rename(files.hadoop(spark, f"{folder}-staged/{name}/{written}")[1], files.hadoop(spark, f"{folder}/{name}.parquet")[1])
    return readers.read_url_keyed(readers.read_first_parquet(spark, folder, config.URL_KEYED_FILE), index(spark, sf_dir)).select("id", "video", "question", "label", "category")


def source_name_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows keyed by name; without a question's id the row's position stands in the id."""
    path = scratch(spark, "names")
    rows = _video_items(spark, sf_dir).orderBy("item_id").select(F.concat("name", F.lit(".mp4")).alias("video_name"), "question", F.col("options").alias("candidates"), "answer", "task_type")
    rows.coalesce(1).write.parquet(path)
    return readers.read_name_keyed(readers.read_first_parquet(spark, path), index(spark, sf_dir)).select("id", "video", "question", "label", "category")


def source_task_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array for each benchmark in a folder named json; the id is the array's name and the position in it."""
    folder = scratch(spark, "tasks")
    rows = _video_items(spark, sf_dir).select("item_id", "benchmark", F.col("name").alias("video"), "question", F.col("options").alias("candidates"), "answer")
    for name in [r.benchmark for r in rows.select("benchmark").distinct().collect()]:
        _write_array(rows.where(F.col("benchmark") == name), f"{folder}/data/json/{name}.json", "item_id")
    place = files.first_folder(spark, folder, "json")
    return readers.read_task_folder(spark, place, index(spark, sf_dir)).select("id", "video", "label", "category")


def _zip(rows: list) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for r in rows:
            archive.writestr(f"in/{r.item_id}.txt", r.question)
    return out.getvalue()


def source_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in zip archives, unpacked where they are read and only once."""
    folder = scratch(spark, "archives")
    for part in range(2):
        system, place = files.hadoop(spark, f"{folder}/zips/{part}.zip")
        out = system.create(place, True)
        out.write(bytearray(_zip(_items(spark, sf_dir).where(F.pmod("item_id", F.lit(2)) == part).collect())))
        out.close()
    for _ in range(2):
        members = files.unpack_archives(spark, f"{folder}/zips", f"{folder}/unpacked")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/unpacked").select(F.regexp_extract("path", "/unpacked/(.*)$", 1).alias("name"), F.md5("content").alias("content"))
    return members.join(found, "name").select(X.basename(F.col("archive")).alias("archive"), "name", "size", "content")


def predicted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictor that fails on some questions: those rows alone come out empty."""

    def model(prompts):
        if prompts.str.len().mod(10).eq(0).any():
            raise ValueError("a broken prompt")
        return prompts.str.upper()

    made = predict(_items(spark, sf_dir).select(F.col("item_id").cast("string").alias("id"), F.col("question").alias("prompt")), model)
    return made.select("id", F.get("prediction", F.lit(0)).alias("prediction"))


def suppressed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids configured for even items, looked up for odd ones, the unknown token left out."""
    number = lambda *xs: F.array(*(F.lit(x).cast("bigint") for x in xs))
    configured = F.when(F.col("item_id") % 2 == 0, F.array(F.col("item_id"), F.lit(None).cast("bigint"))).otherwise(number())
    looked_up = F.array(F.lit(5).cast("bigint"), F.lit(None).cast("bigint"), F.lit(0).cast("bigint"), F.pmod("item_id", F.lit(3)))
    return _items(spark, sf_dir).select("item_id", F.array_join(F.transform(automata.suppressed_ids(configured, looked_up, 0), lambda x: x.cast("string")), ",").alias("ids"))


def task_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The options of every benchmark, some given beside the defaults."""
    rows = [(n, (o := config.task_options(n, fps=3.0 if n == "mlvu" else None)).kind, o.fps, o.max_frames, o.total_pixels, o.min_pixels, o.max_pixels) for n in sorted(config.TASKS)]
    return spark.createDataFrame(rows, "task string, kind string, fps double, max_frames bigint, total_pixels bigint, min_pixels bigint, max_pixels bigint")


QUERIES = {
    "source_records": source_records,
    "source_json_lines": source_json_lines,
    "source_four_options": source_four_options,
    "source_configs": source_configs,
    "source_url_keyed": source_url_keyed,
    "source_name_keyed": source_name_keyed,
    "source_task_folder": source_task_folder,
    "source_archives": source_archives,
    "predicted_answers": predicted_answers,
    "suppressed_ids": suppressed_ids,
    "task_presets": task_presets,
}

_NAME = "'v' || lpad(CAST(item_id % 160 AS VARCHAR), 8, '0')"
_FOUND = "(SELECT video, regexp_extract(video, '([^/]*)$', 1) AS base FROM (SELECT DISTINCT video FROM video_records WHERE video IS NOT NULL) d)"
_KEYS = r"(SELECT key, min(video) AS path FROM (SELECT video, unnest(list_distinct([base, regexp_replace(base, '([^.])\.[^.]*$', '\1')])) AS key FROM " + _FOUND + r" f WHERE base <> '' AND base NOT LIKE '.%' AND lower(regexp_extract(base, '[^.](\.[^.]*)$', 1)) NOT IN ('.jpg', '.json', '.txt', '.parquet', '.zip')) k GROUP BY key)"
_LETTER = "upper(answer)"
_TASKS = (
    ("blink", "image", 1.0, 256, 16384 * 784, 128 * 784, 460800), ("hrbench4k", "image", 1.0, 256, 16384 * 784, 3211264, 12845056), ("hrbench8k", "image", 1.0, 256, 16384 * 784, 3211264, 12845056),
    ("mlvu", "video", 3.0, 512, 20000 * 784, 50176, 460800), ("mvbench", "video", 2.0, 256, 16384 * 784, 12544, 602112), ("videomme", "video", 2.0, 512, 20000 * 784, 50176, 460800), ("vstar", "image", 1.0, 256, 16384 * 784, 128 * 784, 460800),
)
ORACLE = {
    "source_records": "SELECT CASE WHEN item_id % 2 = 0 THEN 'raw' ELSE 'ready' END AS ds_name, row_number() OVER (PARTITION BY item_id % 2 ORDER BY item_id || '.jpg') - 1 AS ord, item_id || '.jpg' AS image, 1 AS n_boxes, CASE WHEN item_id % 2 = 0 THEN CAST('0.' || (item_id % 7 + 3) AS DOUBLE) ELSE 0.5 END AS x1, CASE WHEN item_id % 2 = 0 THEN '<image>' || chr(10) || question ELSE question || ' Please provide the bounding box coordinate of it.' END AS question, CASE WHEN item_id % 2 = 0 THEN chr(10) || '<answer> ' || answer || ' </answer>' ELSE '[0.1, 0.2, 0.' || (item_id % 7 + 3) || ', 0.9]' END AS answer FROM eval_items",
    "source_json_lines": "SELECT doc_id, md5(text) AS text, source FROM documents",
    "source_four_options": "SELECT item_id AS question_id, benchmark AS image, question || chr(10) || 'Options:' || chr(10) || '(A)' || options[1] || chr(10) || '(B)' || options[2] || chr(10) || '(C)' || options[3] || chr(10) || '(D)' || options[4] AS query, answer AS label, task_type AS category FROM eval_items",
    "source_configs": "SELECT CAST(item_id AS VARCHAR) AS question_id, 1 + CAST(item_id % 2 = 0 AS INTEGER) + CAST(item_id % 3 = 0 AS INTEGER) + CAST(item_id % 4 = 0 AS INTEGER) AS n_images, question || chr(10) || 'Options:' || chr(10) || coalesce(list_aggregate(list_transform(options[1:26], lambda c, i: chr(CAST(64 + i AS INTEGER)) || '. ' || c || chr(10)), 'string_agg', ''), '') AS query, upper(answer) AS label, benchmark AS category FROM eval_items WHERE item_id % 3 < 2",
    "source_url_keyed": f"SELECT {_NAME} || '_' || item_id AS id, path AS video, question, {_LETTER} AS label, benchmark AS category FROM eval_items JOIN {_KEYS} k ON key = {_NAME}",
    "source_name_keyed": f"SELECT name || '.mp4_' || ord AS id, coalesce(a.path, b.path) AS video, question, {_LETTER} AS label, coalesce(nullif(task_type, ''), 'overall') AS category FROM (SELECT *, {_NAME} AS name, row_number() OVER (ORDER BY item_id) - 1 AS ord FROM eval_items) e LEFT JOIN {_KEYS} a ON a.key = name || '.mp4' LEFT JOIN {_KEYS} b ON b.key = name WHERE coalesce(a.path, b.path) IS NOT NULL",
    "source_task_folder": f"SELECT benchmark || '_' || ord AS id, path AS video, {_LETTER} AS label, benchmark AS category FROM (SELECT *, {_NAME} AS name, row_number() OVER (PARTITION BY benchmark ORDER BY item_id) - 1 AS ord FROM eval_items) e JOIN {_KEYS} k ON key = name",
    "source_archives": "SELECT (item_id % 2) || '.zip' AS archive, 'in/' || item_id || '.txt' AS name, CAST(octet_length(encode(question)) AS BIGINT) AS size, md5(question) AS content FROM eval_items",
    "predicted_answers": "SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN length(question) % 10 = 0 THEN '' ELSE upper(question) END AS prediction FROM eval_items",
    "suppressed_ids": "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN CAST(item_id AS VARCHAR) WHEN item_id % 3 = 0 THEN '5' ELSE '5,' || (item_id % 3) END AS ids FROM eval_items",
    "task_presets": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}', CAST({f} AS DOUBLE), CAST({m} AS BIGINT), CAST({t} AS BIGINT), CAST({lo} AS BIGINT), CAST({hi} AS BIGINT))" for n, k, f, m, t, lo, hi in _TASKS) + ") t(task, kind, fps, max_frames, total_pixels, min_pixels, max_pixels)",
}
