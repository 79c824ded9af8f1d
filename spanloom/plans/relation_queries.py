"""Queries of lookups, unions, sampling, batches, packing and metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions import text as X
from ..operators import lookup, packing, sampling, training, vectors
from ..session import scratch, table
from ..sinks import results
from ..sources.readers import read_json_array, union_all
from ..streaming.streams import END, run_to_table, run_updates, stream_metrics, stream_pack
from .scoring_queries import JUDGED, PREDICTIONS, predictions

SEED = 42
LIMITS = packing.Limits(max_tokens=4096, max_instances=4, long_threshold=2048, max_buffers=100)
SHARDS = 16


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.video_index(table(spark, sf_dir, "video_records").select(F.col("video").alias("path")).where("path is not null"))


def index_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir)


def asked_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, url, videoID: questions pointing at videos, by a URL, by an id, or at nothing."""
    number = F.lpad(F.pmod(F.col("item_id"), F.lit(160)).cast("string"), 8, "0")
    url = F.when(F.col("item_id") % 4 < 2, F.concat(F.lit("https://tube.example/watch?v=v"), number)).when(F.col("item_id") % 4 == 2, F.lit("https://tube.example/watch?v=none"))
    return table(spark, sf_dir, "eval_items").select("item_id", url.alias("url"), F.concat(F.lit("v"), number).alias("videoID"))


def lookup_two_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asked_videos(spark, sf_dir).withColumn("key", X.url_video_id(F.col("url"), F.col("videoID")))
    return lookup.look_up(rows, index(spark, sf_dir), F.col("key"), F.col("videoID")).select("item_id", "key", F.col("found").alias("video"))


def missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asked_videos(spark, sf_dir).withColumn("key", X.url_video_id(F.col("url"), F.col("videoID")))
    return lookup.missing(rows, index(spark, sf_dir), "key")


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = X.basename(F.col("doc_url"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), X.stem(name).alias("stem"), X.run_name(F.concat(F.col("doc_url"), F.lit("//"))).alias("run"), X.composite_id(F.col("source"), F.col("doc_id")).alias("id"), X.step_file(F.pmod("doc_id", F.lit(50)).cast("int")).alias("file"), X.truthy(F.col("lang")).alias("truthy"))


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    visual = table(spark, sf_dir, "visual_records").select(F.col("conv_id").alias("id"), "data_path", F.lit("visual").alias("category"), F.get("image", F.lit(0)).alias("image"))
    video = table(spark, sf_dir, "video_records").select(F.col("rec_id").alias("id"), "data_path", F.lit("video").alias("category"), "video")
    assets = table(spark, sf_dir, "manifest").select(F.lit(0).cast("bigint").alias("id"), "data_path", F.lit("assets").alias("category"))
    return union_all([visual, video, assets]).where(F.col("category") != "assets")


def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank, local = F.pmod("doc_id", F.lit(2)), F.pmod(F.floor(F.col("doc_id") / 2), F.lit(4))
    return documents(spark, sf_dir).select("doc_id", arrays.shard(F.col("doc_id"), SHARDS).alias("shard"), sampling.global_worker(rank, local, 4).alias("worker"))


def order_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order before round robin, from what each shard knows: its number and the position within."""
    sharded = documents(spark, sf_dir).select("doc_id", arrays.shard(F.col("doc_id"), 8).alias("shard"), F.floor(F.col("doc_id") / 8).alias("place"))
    return sharded.select("doc_id", (F.col("place") * 8 + F.col("shard")).alias("ord")).orderBy("ord")


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.seeded_head(documents(spark, sf_dir).select("doc_id", "n_chars"), SEED, 100, "doc_id")


def latest_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string")).alias("name"))
    return sampling.latest(steps, 3, "step")


def mixture_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.mixture_weights(documents(spark, sf_dir).withColumn("source", F.coalesce("source", F.lit("none"))), "source")


def weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "mix_targets").select("ds_name", F.col("target_share").cast("decimal(9,6)").alias("weight"))
    return sampling.weighted_draw(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", weights, "ds_name", SEED)


def drain_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders by status, drawn until all are used; the rank of the draw stands for its time."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("ord"))
    weights = rows.groupBy("status").agg((F.count(F.lit(1)) + F.length("status")).alias("weight"))
    return sampling.drain(rows, "status", "ord", weights, SEED).select("status", "ord", F.round("time", 6).alias("time"))


def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "manifest").select("data_path", F.col("image_folder").alias("folder"))
    return manifest.select("data_path", "folder", X.in_folder(F.col("data_path"), F.col("folder")).alias("path"))


def epoch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("ord"))
    return sampling.replay(parts, 3, "ord", 20000)


def chunk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = documents(spark, sf_dir).groupBy(arrays.chunk(F.col("doc_id") - 10000, 32).alias("batch")).agg(F.count(F.lit(1)).alias("n_rows"))
    return batches.select("batch", "n_rows", arrays.chunk_count(F.col("n_rows"), 5).alias("n_chunks"))


def token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch, doc_id, ids: short token lists of documents, up to 32 to a batch; of an unknown length the shortest."""
    ids = F.transform(F.sequence(F.lit(0).cast("bigint"), F.pmod(F.coalesce("n_chars", F.lit(0)), F.lit(9))), lambda i: F.pmod(F.col("doc_id") * 31 + i * 7, F.lit(50)))
    return documents(spark, sf_dir).select(arrays.chunk(F.col("doc_id"), 32).alias("batch"), "doc_id", ids.alias("ids"))


def _flat(column: object) -> object:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def pad_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_lists(spark, sf_dir)
    longest = rows.groupBy("batch").agg(F.max(F.size("ids")).alias("longest"))
    both = rows.join(longest, "batch")
    right = arrays.pad_right(F.col("ids"), F.col("longest"), 0)
    return both.select("batch", "doc_id", _flat(right).alias("right"), _flat(arrays.pad_left(F.col("ids"), F.col("longest"), 0)).alias("left"), _flat(arrays.content_mask(right, 0)).alias("mask"), _flat(arrays.pad_right(F.col("ids"), F.col("longest"), -100)).alias("labels"))


def label_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_lists(spark, sf_dir)
    made = arrays.labelled(F.slice("ids", 1, 1), F.slice("ids", 2, 2), F.slice("ids", 4, 99))
    pieces = arrays.split_by_lengths(F.col("ids"), F.array(F.lit(1), F.lit(2)))
    rows = rows.select("doc_id", made.alias("s"), F.get(pieces, F.lit(1)).alias("p"))
    return rows.select("doc_id", _flat(F.col("s.ids")).alias("ids"), _flat(F.col("s.labels")).alias("labels"), _flat(F.col("s.mask")).alias("mask"), _flat(F.col("p")).alias("second_piece"))


def lineitem_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").cast("bigint").alias("pos"), F.pmod("l_partkey", F.lit(20)).alias("label"))


def shift_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.shifted_labels(lineitem_tokens(spark, sf_dir), 7)


def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 64).alias("step"), F.col("l_discount").alias("loss_ce"), F.col("l_tax").alias("loss_align"))
    return training.metric_means(rows.withColumn("loss", vectors.combined_loss(F.col("loss_ce"), F.col("loss_align"), 0.1)), "step", "loss_ce", "loss_align", "loss")


def batch_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("bigint").alias("length"))
    return training.batch_shape(rows, "l_orderkey", "length")


def group_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("visual.blocks", "visual.merger", "model.layers", "model.norm", "merger.bias", "visual.bias")))
    name = F.concat(F.get(kinds, F.pmod("p_partkey", F.lit(6)).cast("int")), F.lit("."), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 == 0, F.lit(".bias")).otherwise(F.lit(".weight")))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), (F.col("p_size") % 2 == 0).alias("trainable"))
    return rows.select("p_partkey", training.parameter_group(F.col("name"), F.contains("name", F.lit("norm")), F.col("trainable")).alias("part"), training.max_steps(F.col("p_partkey"), 4, 8, 2).alias("steps"))


def cosine_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    other = vecs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.alignment_loss(vecs.join(other, "vec_id"), "embedding", "other", ["label"]).select("label", F.round("loss", 6).alias("loss"), "n_rows")


def column_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = vectors.column_means(table(spark, sf_dir, "embeddings"), "embedding", ["label"])
    return means.select("label", F.col("pos").cast("bigint").alias("pos"), F.round("mean", 6).alias("mean"))


def scatter_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = lineitem_tokens(spark, sf_dir).select("seq", "pos", F.when(F.col("label") < 8, F.lit(3)).otherwise(F.col("label")).alias("token"))
    slots = tokens.where("token = 3").groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    features = slots.select("seq", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("n")).withColumn("feature", F.col("seq") * 100 + F.col("n"))
    return vectors.scatter(tokens, features, 3)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard, ord, id, n_tokens: documents as samples, four characters of text being about a token."""
    n = F.greatest(F.lit(1).cast("bigint"), F.floor(F.coalesce(F.length("text"), F.lit(0)) / 4))
    rows = table(spark, sf_dir, "documents").select("doc_id", n.alias("n_tokens"))
    shards = sampling.shards_for(rows.count(), least=SHARDS)
    return rows.select(arrays.shard(F.col("doc_id"), shards).cast("int").alias("shard"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"), "n_tokens")


def pack_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_first_fit(samples(spark, sf_dir), LIMITS)


def pack_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_statistics(pack_first_fit(spark, sf_dir), LIMITS.max_tokens)


def pack_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples all long enough to stand alone: whole packs in order of arrival, longer ones cut."""
    return packing.pack_first_fit(samples(spark, sf_dir), packing.Limits(max_tokens=64, long_threshold=1))


def pack_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of one length, of which two fill a pack's number of instances: first fit pairs them in order of arrival."""
    return packing.pack_first_fit(samples(spark, sf_dir).withColumn("n_tokens", F.lit(10)), packing.Limits(max_tokens=100, max_instances=2, long_threshold=50, max_buffers=10))


def pack_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes in comes out: samples and tokens of each shard after packing, cut samples at their length."""
    packed = pack_first_fit(spark, sf_dir)
    return packed.groupBy("shard").agg(F.count_distinct("id").alias("n_samples"), F.count(F.lit(1)).alias("n_instances"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("longest"))


def rows_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = results.write_predictions(predictions(spark, sf_dir), scratch(spark, "rows"), 4)
    rows = spark.read.schema("id bigint, prediction array<string>, label string, category string").json(path)
    return rows.select("id", F.get("prediction", F.lit(0)).alias("prediction"), "label", "category")


def metrics_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = results.write_metrics(predictions(spark, sf_dir), scratch(spark, "metrics"), "videomme", 4)
    rows = spark.read.option("multiLine", True).schema("benchmark string, steps int, correct bigint, total bigint, accuracy double").json(path)
    return rows.withColumn("accuracy", F.round("accuracy", 6))


def array_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array in one file, written and read again with the rows' positions: the items, which are a fixed table."""
    rows = table(spark, sf_dir, "eval_items").select("item_id", "question", "task_type").orderBy("item_id")
    path = results.write_prediction_array(rows, scratch(spark, "array"), 7)
    return read_json_array(spark, path, "item_id bigint, question string, task_type string").select("ord", "item_id", "question", "task_type")


def stream_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "samples")
    rows = samples(spark, sf_dir)
    ends = rows.select("shard").distinct().select("shard", F.lit(1 << 60).alias("ord"), F.lit(-1).cast("bigint").alias("id"), F.lit(END).cast("bigint").alias("n_tokens"))
    rows.unionByName(ends).write.parquet(folder)
    stream = spark.readStream.schema("shard int, ord bigint, id bigint, n_tokens bigint").parquet(folder)
    return run_to_table(stream_pack(stream, LIMITS), scratch(spark, "packs"))


def stream_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.readStream.schema(table(spark, sf_dir, "lineitem").schema).parquet(f"{sf_dir}/lineitem.parquet*")
    made = stream_metrics(rows.select(F.floor(F.col("l_orderkey") / 64).alias("step"), F.col("l_discount").alias("loss_ce")), "step", "loss_ce")
    return run_updates(made, scratch(spark, "means"), "step").withColumn("loss_ce", F.round("loss_ce", 6))


def crop_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged tokens a crop of batches of 64 conversations; a box's grid in patches from its share of a square of 56."""
    side = lambda lo, hi: (F.floor(F.abs(F.get("box", F.lit(hi)) - F.get("box", F.lit(lo))) * 28) * 2 + 2).cast("bigint")
    boxes = table(spark, sf_dir, "visual_records").select("conv_id", F.explode("bboxes").alias("box")).where("forall(box, x -> abs(x) < 1e6)")
    crops = boxes.select(F.floor(F.col("conv_id") / 64).alias("batch"), F.lit(1).cast("bigint").alias("t"), side(1, 3).alias("h"), side(0, 2).alias("w"))
    return training.crop_metrics(crops, "batch")


def samples_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.samples_drawn(weighted_draw(spark, sf_dir), "ds_name")


QUERIES = {
    "index_dedupe": index_dedupe,
    "lookup_two_key": lookup_two_key,
    "missing_rows": missing_rows,
    "file_names": file_names,
    "union_sources": union_sources,
    "shard_assign": shard_assign,
    "order_restore": order_restore,
    "seeded_sample": seeded_sample,
    "latest_checkpoints": latest_checkpoints,
    "mixture_weights": mixture_weights,
    "weighted_draw": weighted_draw,
    "drain_sources": drain_sources,
    "resolved_paths": resolved_paths,
    "epoch_replay": epoch_replay,
    "chunk_batches": chunk_batches,
    "pad_and_mask": pad_and_mask,
    "label_sequences": label_sequences,
    "shift_labels": shift_labels,
    "metric_means": metric_means,
    "batch_shape": batch_shape,
    "group_params": group_params,
    "cosine_alignment": cosine_alignment,
    "column_mean": column_mean,
    "scatter_features": scatter_features,
    "pack_first_fit": pack_first_fit,
    "pack_stats": pack_stats,
    "pack_totals": pack_totals,
    "pack_alone": pack_alone,
    "pack_pairs": pack_pairs,
    "crop_metrics": crop_metrics,
    "samples_drawn": samples_drawn,
    "array_sink": array_sink,
    "rows_sink": rows_sink,
    "metrics_sink": metrics_sink,
    "stream_pack": stream_packs,
    "stream_metrics": stream_means,
}

_NAME = "regexp_extract({}, '([^/]*)$', 1)"
_STEM = r"regexp_replace({}, '([^.])\.[^.]*$', '\1')"
_FILES = f"(SELECT DISTINCT video AS path, {_NAME.format('video')} AS name FROM video_records WHERE video IS NOT NULL)"
_KEYS = f"(SELECT key, min(path) AS path FROM (SELECT path, unnest(list_distinct([name, {_STEM.format('name')}])) AS key FROM {_FILES} f WHERE name <> '' AND name NOT LIKE '.%' AND lower(regexp_extract(name, '[^.](\\.[^.]*)$', 1)) NOT IN ('.jpg', '.json', '.txt', '.parquet', '.zip')) k GROUP BY key)"
_ASKED = "(SELECT item_id, 'v' || lpad(CAST(item_id % 160 AS VARCHAR), 8, '0') AS vid, CASE WHEN item_id % 4 < 2 THEN 'v' || lpad(CAST(item_id % 160 AS VARCHAR), 8, '0') WHEN item_id % 4 = 2 THEN 'none' ELSE 'v' || lpad(CAST(item_id % 160 AS VARCHAR), 8, '0') END AS key FROM eval_items)"
_IDS = "(SELECT doc_id // 32 AS batch, doc_id, list_transform(range(coalesce(n_chars, 0) % 9 + 1), lambda i: (doc_id * 31 + i * 7) % 50) AS ids FROM documents)"
_FLAT = "array_to_string({}, ',')"
_REPEAT = "list_transform(range({n}), lambda i: {v})"
_TOKENS = "(SELECT l_orderkey AS seq, CAST(l_linenumber AS BIGINT) AS pos, l_partkey % 20 AS label FROM lineitem)"
_PARTS = "['visual.blocks', 'visual.merger', 'model.layers', 'model.norm', 'merger.bias', 'visual.bias'][1 + p_partkey % 6] || '.' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '.bias' ELSE '.weight' END"

ORACLE = {
    "index_dedupe": f"SELECT key, path FROM {_KEYS} k",
    "lookup_two_key": f"SELECT item_id, a.key, coalesce(x.path, y.path) AS video FROM {_ASKED} a LEFT JOIN {_KEYS} x ON x.key = a.key LEFT JOIN {_KEYS} y ON y.key = a.vid",
    "missing_rows": f"SELECT CAST(sum(CASE WHEN x.path IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM {_ASKED} a LEFT JOIN {_KEYS} x ON x.key = a.key",
    "file_names": f"SELECT doc_id, {_NAME.format('doc_url')} AS name, {_STEM.format(_NAME.format('doc_url'))} AS stem, {_NAME.format('doc_url')} AS run, source || '_' || doc_id AS id, 'steps' || lpad(CAST(doc_id % 50 AS VARCHAR), 3, '0') AS file, lower(trim(lang)) IN ('1', 'true', 'yes', 'y', 't') AS truthy FROM documents",
    "union_sources": "SELECT conv_id AS id, data_path, 'visual' AS category, image[1] AS image, CAST(NULL AS VARCHAR) AS video FROM visual_records UNION ALL SELECT rec_id, data_path, 'video', NULL, video FROM video_records",
    "shard_assign": f"SELECT doc_id, doc_id % {SHARDS} AS shard, doc_id % 2 * 4 + doc_id // 2 % 4 AS worker FROM documents",
    "order_restore": "SELECT doc_id, doc_id AS ord FROM documents",
    "seeded_sample": f"SELECT doc_id, n_chars FROM documents ORDER BY md5('{SEED}_' || doc_id), doc_id LIMIT 100",
    "latest_checkpoints": "SELECT o_orderkey AS step, 'checkpoint-' || o_orderkey AS name FROM orders ORDER BY step DESC LIMIT 3",
    "mixture_weights": "SELECT source, n_rows, round(n_rows / total, 6) AS weight, round(n_rows / total * 100, 2) AS percent FROM (SELECT coalesce(source, 'none') AS source, count(*) AS n_rows, sum(count(*)) OVER () AS total FROM documents GROUP BY coalesce(source, 'none')) s",
    "weighted_draw": f"""
WITH w AS (SELECT ds_name, CAST(target_share AS DECIMAL(9, 6)) AS weight FROM mix_targets),
b AS (SELECT ds_name, sum(weight) OVER (ORDER BY ds_name) - weight AS lo, CASE WHEN lead(ds_name) OVER (ORDER BY ds_name) IS NULL THEN 2 ELSE sum(weight) OVER (ORDER BY ds_name) END AS hi FROM w),
u AS (SELECT o_orderkey, CAST(('0x' || substr(md5('{SEED}_' || o_orderkey), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM orders)
SELECT o_orderkey, ds_name FROM u JOIN b ON u.u >= CAST(b.lo AS DOUBLE) AND u.u < CAST(b.hi AS DOUBLE)""",
    "drain_sources": f"""
WITH w AS (SELECT o_orderstatus AS status, count(*) + length(o_orderstatus) AS weight FROM orders GROUP BY o_orderstatus)
SELECT status, o_orderkey AS ord, round(sum(-ln(1 - CAST(('0x' || substr(md5('{SEED}_' || status || '_' || o_orderkey), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE) / weight) OVER (PARTITION BY status ORDER BY o_orderkey), 6) AS time
FROM orders JOIN w ON w.status = orders.o_orderstatus""",
    "resolved_paths": "SELECT data_path, image_folder AS folder, CASE WHEN data_path LIKE '/%' OR data_path LIKE 'http%' OR coalesce(image_folder, '') = '' THEN data_path ELSE rtrim(image_folder, '/') || '/' || data_path END AS path FROM manifest",
    "epoch_replay": "SELECT p_partkey - 1 AS ord, CAST(e AS INTEGER) AS epoch, e * 20000 + p_partkey - 1 AS position FROM part, range(3) r(e)",
    "chunk_batches": "SELECT (doc_id - 10000) // 32 AS batch, count(*) AS n_rows, (count(*) + 4) // 5 AS n_chunks FROM documents GROUP BY (doc_id - 10000) // 32",
    "pad_and_mask": f"""
SELECT batch, doc_id, {_FLAT.format(f"ids || {_REPEAT.format(n='longest - len(ids)', v='0')}")} AS "right", {_FLAT.format(f"{_REPEAT.format(n='longest - len(ids)', v='0')} || ids")} AS "left",
{_FLAT.format(f"list_transform(ids || {_REPEAT.format(n='longest - len(ids)', v='0')}, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)")} AS mask, {_FLAT.format(f"ids || {_REPEAT.format(n='longest - len(ids)', v='-100')}")} AS labels
FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS longest FROM {_IDS} i) p""",
    "label_sequences": f"SELECT doc_id, {_FLAT.format('ids')} AS ids, {_FLAT.format('list_transform(ids, lambda x, i: CASE WHEN i <= 3 THEN -100 ELSE x END)')} AS labels, {_FLAT.format('list_transform(ids, lambda x: 1)')} AS mask, {_FLAT.format('ids[2:3]')} AS second_piece FROM {_IDS} i",
    "shift_labels": f"SELECT seq, pos, label, CASE WHEN lead(label) OVER w = 7 THEN -100 ELSE lead(label) OVER w END AS target, lag(label) OVER w AS before FROM {_TOKENS} t WINDOW w AS (PARTITION BY seq ORDER BY pos, label)",
    "metric_means": "SELECT l_orderkey // 64 AS step, count(*) AS n_micro, round(avg(l_discount), 6) AS loss_ce, round(avg(l_tax), 6) AS loss_align, round(avg(l_discount + 0.1::DOUBLE * l_tax), 6) AS loss FROM lineitem GROUP BY l_orderkey // 64",
    "batch_shape": "SELECT l_orderkey, count(*) AS n_rows, max(CAST(l_quantity AS BIGINT)) AS max_len, count(*) * max(CAST(l_quantity AS BIGINT)) AS padded_tokens, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens FROM lineitem GROUP BY l_orderkey",
    "group_params": f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CASE WHEN contains(n, 'merger') THEN 'merger' WHEN contains(n, 'visual') THEN 'visual' ELSE 'other' END || CASE WHEN contains(n, 'norm') OR contains(n, 'bias') THEN '_no_decay' ELSE '_decay' END END AS part, p_partkey // 64 AS steps FROM (SELECT *, {_PARTS} AS n FROM part) p",
    "cosine_alignment": "SELECT a.label, round(1 - avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS loss, count(*) AS n_rows FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY a.label",
    "column_mean": "SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) e GROUP BY label, pos",
    "scatter_features": f"SELECT seq, pos, seq * 100 + row_number() OVER (PARTITION BY seq ORDER BY pos) AS feature FROM {_TOKENS} t WHERE label < 8",
    "pack_totals": f"SELECT CAST(doc_id % greatest({SHARDS}, (SELECT (count(*) + 49999) // 50000 FROM documents)) AS INTEGER) AS shard, count(*) AS n_samples, count(*) AS n_instances, CAST(sum(n) AS BIGINT) AS n_tokens, max(n) AS longest FROM (SELECT doc_id, least(greatest(1, coalesce(length(text), 0) // 4), {LIMITS.max_tokens}) AS n FROM documents) d GROUP BY 1",
    "crop_metrics": "SELECT batch, count(*) AS n_crops, CAST(round_even((CAST(sum(h * w) AS BIGINT) // 4) / CAST(count(*) AS DOUBLE), 0) AS BIGINT) AS tokens_gen FROM (SELECT conv_id // 64 AS batch, CAST(floor(abs(b[4] - b[2]) * 28) * 2 + 2 AS BIGINT) AS h, CAST(floor(abs(b[3] - b[1]) * 28) * 2 + 2 AS BIGINT) AS w FROM (SELECT conv_id, unnest(bboxes) AS b FROM visual_records) v WHERE len(list_filter(b, lambda x: NOT abs(x) < 1e6)) = 0) c GROUP BY batch",
    "array_sink": "SELECT row_number() OVER (ORDER BY item_id) - 1 AS ord, item_id, question, task_type FROM eval_items",
    "rows_sink": f"SELECT id, prediction, label, category FROM ({PREDICTIONS}) p",
    "metrics_sink": f"SELECT 'videomme' AS benchmark, 4 AS steps, CAST(sum(ok) AS BIGINT) AS correct, count(*) AS total, round(sum(ok) / count(*), 6) AS accuracy FROM ({JUDGED}) j",
    "stream_metrics": "SELECT l_orderkey // 64 AS step, count(*) AS n_micro, round(avg(l_discount), 6) AS loss_ce FROM lineitem GROUP BY l_orderkey // 64",
}
_SHARD = f"CAST(doc_id % greatest({SHARDS}, (SELECT (count(*) + 49999) // 50000 FROM documents)) AS INTEGER)"
_PLACED = f"(SELECT doc_id, greatest(1, coalesce(length(text), 0) // 4) AS n, {_SHARD} AS shard, row_number() OVER (PARTITION BY {_SHARD} ORDER BY doc_id) - 1 AS place FROM documents)"
ORACLE["pack_alone"] = f"SELECT shard, place AS pack_id, 0 AS instance_ord, doc_id AS id, least(n, 64) AS n_tokens, CASE WHEN n > 64 THEN 'truncated' ELSE 'packed' END AS status FROM {_PLACED} p"
ORACLE["pack_pairs"] = f"SELECT shard, place // 2 AS pack_id, CAST(place % 2 AS INTEGER) AS instance_ord, doc_id AS id, CAST(10 AS BIGINT) AS n_tokens, 'packed' AS status FROM {_PLACED} p"
ORACLE["samples_drawn"] = f"SELECT ds_name, count(*) AS n_drawn FROM ({ORACLE['weighted_draw']}) d GROUP BY ds_name"
