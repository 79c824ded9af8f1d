"""Queries of the pipeline from conversations to padded packs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import arrays
from ..functions import text as X
from ..operators import conversations, packing, sampling
from ..session import checkpointed, table
from . import record_queries

SEED = 42
LIMITS = packing.Limits(max_tokens=512, max_instances=4, long_threshold=256, max_buffers=100)
SHARDS = 16


def chat_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.chat_samples(record_queries.turns(spark, sf_dir))


def chat_sample_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and sums of each conversation's ids and labels."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return chat_samples(spark, sf_dir).select("conv_id", F.size("ids").cast("bigint").alias("n_tokens"), F.size(F.filter("labels", lambda x: x != config.IGNORE_INDEX)).cast("bigint").alias("n_labels"), total("ids").alias("ids_sum"), total("labels").alias("labels_sum"))


def role_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by role; a role that isn't known would raise."""
    return table(spark, sf_dir, "conversations").groupBy(X.strict_role(F.col("role")).alias("role")).agg(F.count(F.lit(1)).alias("n_turns"))


def drawn_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard, ord, id, n_tokens, source: conversations in the order in which their sources, drawn by weight, run empty.

    A source is the first word of a record's path; its weight is the number of
    its records, and the time of a draw stands for its place.
    """
    source = F.coalesce(F.nullif(F.regexp_extract("data_path", r"([A-Za-z]+)", 1), F.lit("")), F.lit("none"))
    owners = table(spark, sf_dir, "visual_records").groupBy("conv_id").agg(F.min(source).alias("source"))
    rows = checkpointed(chat_samples(spark, sf_dir).select("conv_id", F.size("ids").cast("bigint").alias("n_tokens")).join(owners, "conv_id"))
    weights = rows.groupBy("source").agg(F.count(F.lit(1)).alias("weight"))
    times = sampling.drain(rows, "source", "conv_id", weights, SEED)
    shards = sampling.shards_for(rows.count(), least=SHARDS)
    return rows.join(times, ["source", "conv_id"]).select(arrays.shard(F.col("conv_id"), shards).cast("int").alias("shard"), F.col("time").alias("ord"), F.col("conv_id").alias("id"), "n_tokens", "source")


def packed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_first_fit(drawn_samples(spark, sf_dir), LIMITS)


def collated_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each padded pack: rows, their common length, tokens that are none of padding, labels that count."""
    made = packing.collate(packed_samples(spark, sf_dir), chat_samples(spark, sf_dir).withColumnRenamed("conv_id", "id"), LIMITS.max_tokens)
    content = F.size(F.filter("mask", lambda x: x == 1)).cast("bigint")
    labels = F.size(F.filter("labels", lambda x: x != config.IGNORE_INDEX)).cast("bigint")
    return made.groupBy("shard", "pack_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("ids")).alias("length"), F.min(F.size("ids")).alias("least"), F.sum(content).alias("n_tokens"), F.sum(labels).alias("n_labels"))


def collated_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and tokens of each shard after drawing, packing and padding: none is lost on the way."""
    return collated_packs(spark, sf_dir).groupBy("shard").agg(F.sum("n_rows").alias("n_samples"), F.sum("n_tokens").alias("n_tokens"))


QUERIES = {"chat_sample_sums": chat_sample_sums, "role_check": role_check, "packed_samples": packed_samples, "collated_packs": collated_packs, "collated_totals": collated_totals}

_TOKENS = rf"list_transform(regexp_extract_all({{}}, '{arrays.RULE_TOKEN.replace('{', '{{').replace('}', '}}')}'), lambda w: CAST('0x' || substr(md5(w), 1, 7) AS BIGINT))"
_SYSTEM = f"'{config.TURN_START}system' || chr(10) || '{config.SYSTEM_MESSAGE}{config.TURN_END}' || chr(10)"
_HEAD = r"regexp_extract(response, '(?s)^(.*?\n)', 1)"
_SUMS = f"""
SELECT conv_id, CAST(sum(len(a) + len(s)) AS BIGINT) + len({_TOKENS.format(_SYSTEM)}) AS n_tokens, CAST(sum(len(s)) AS BIGINT) AS n_labels,
  CAST(sum(coalesce(list_sum(a), 0) + coalesce(list_sum(s), 0)) AS BIGINT) + CAST(list_sum({_TOKENS.format(_SYSTEM)}) AS BIGINT) AS ids_sum,
  CAST(sum(coalesce(list_sum(s), 0) - 100 * len(a)) AS BIGINT) - 100 * len({_TOKENS.format(_SYSTEM)}) AS labels_sum
FROM (SELECT conv_id, {_TOKENS.format(f"(prompt || {_HEAD})")} AS a, {_TOKENS.format(f"substr(response, length({_HEAD}) + 1)")} AS s FROM ({record_queries.ORACLE['chat_pairs']}) c WHERE prompt IS NOT NULL AND response IS NOT NULL) t
GROUP BY conv_id"""
ORACLE = {
    "chat_sample_sums": _SUMS,
    "role_check": "SELECT CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE role END AS role, count(*) AS n_turns FROM conversations GROUP BY 1",
    "collated_totals": f"""
SELECT CAST(conv_id % greatest({SHARDS}, ((SELECT count(*) FROM ({_SUMS}) z) + 49999) // 50000) AS INTEGER) AS shard, count(*) AS n_samples, CAST(sum(least(n_tokens, {LIMITS.max_tokens})) AS BIGINT) AS n_tokens
FROM ({_SUMS}) s WHERE conv_id IN (SELECT conv_id FROM visual_records) GROUP BY 1""",
}
