"""Queries of the language problems over the test tables, and their SQL where there is any."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, table
from .containers import fill_containers
from .encoding import count_tokens, encode_texts
from .leakage import MATCH, WINDOW, find_leaks, training_texts
from .mixing import draw_mixture, plan_mixture, record_languages, source_table, sourced_records
from .pairs import all_replies, broken_pairs, conversation_pairs, record_pairs
from .shapes import listing_pages


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos, turns = table(spark, sf_dir, "video_records"), table(spark, sf_dir, "conversations")
    return broken_pairs(record_pairs(videos).unionByName(conversation_pairs(turns)), all_replies(videos, turns))


def _leaks(spark: SparkSession, sf_dir: str, edited: bool) -> DataFrame:
    texts = training_texts(table(spark, sf_dir, "video_records"), table(spark, sf_dir, "conversations"))
    return find_leaks(texts, table(spark, sf_dir, "eval_items"), edited=edited)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments as good as twelve equal words, of which those are kept that hold them in a row."""
    return _leaks(spark, sf_dir, edited=False).where((F.col("score") >= MATCH * WINDOW) & (F.col("run") >= WINDOW)).select("tbl", "rec_id", "item_id")


def p4_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak by its alignment, edited copies included."""
    return _leaks(spark, sf_dir, edited=True).withColumn("kind", F.when(F.col("run") >= WINDOW, F.lit("exact")).otherwise(F.lit("edited")))


def _mixture(spark: SparkSession, sf_dir: str, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sourced records and the plan of their mixture; full plans as many uses as there are records."""
    manifest = table(spark, sf_dir, "manifest")
    records = checkpointed(sourced_records(table(spark, sf_dir, "visual_records"), table(spark, sf_dir, "video_records"), manifest))
    return records, plan_mixture(records, table(spark, sf_dir, "mix_targets"), source_table(manifest), ["domain"], records.count() if full else None)


def p5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw_mixture(*_mixture(spark, sf_dir))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p5_shares_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mixture as large as all records: what small sources can't fill passes to siblings before ancestors."""
    return _mixture(spark, sf_dir, full=True)[1]


def _language_mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three uses for four records, so that small sources fall short and others have room, in a tree of domain, language and source."""
    manifest, videos = table(spark, sf_dir, "manifest"), table(spark, sf_dir, "video_records")
    records = sourced_records(table(spark, sf_dir, "visual_records"), videos, manifest)
    records = checkpointed(records.join(record_languages(videos, table(spark, sf_dir, "conversations")), ["tbl", "rec_id"], "left").withColumn("lang", F.coalesce("lang", F.lit("other"))))
    return records, plan_mixture(records, table(spark, sf_dir, "mix_targets"), source_table(manifest), ["domain"], records.count() * 3 // 4, by=["lang"])


def p5_language_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares where a small source's shortage passes to sources of its domain and language, then of its domain, then to all."""
    return _language_mixture(spark, sf_dir)[1]


def p5_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw_mixture(*_language_mixture(spark, sf_dir), by=["lang"])


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_containers(count_tokens(table(spark, sf_dir, "documents")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing_pages(table(spark, sf_dir, "documents"))


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_aligned": p4_aligned, "p5_mix": p5_mix, "p5_shares": p5_shares, "p5_shares_full": p5_shares_full, "p5_language_shares": p5_language_shares, "p5_language_mix": p5_language_mix, "p6_ids": p6_ids, "p7_containers": p7_containers, "p8_found": p8_found}
_PLAIN_LETTERS = string.digits + string.ascii_letters + ".,!?"
_WIDE_LETTERS = "".join(chr(ord(c) + 0xFEE0) for c in _PLAIN_LETTERS)
#: NFKC is said for full-width letters only, which is all that the tables need.
_FOLD = rf"lower(regexp_replace(translate({{}}, '{_WIDE_LETTERS}', '{_PLAIN_LETTERS}'), '\p{{{{Cf}}}}', '', 'g'))"
_WORDS = r"regexp_extract_all({}, '[\pL\pN]+')"
_GRAMS = "unnest(list_transform(range(greatest(len({0}) - 11, 0)), lambda i: array_to_string({0}[i + 1:i + 12], ' ')))"
ORACLE: dict[str, str] = {
    "p4_found": f"""
WITH sentences AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY n) AS place, w FROM (
    SELECT item_id, n, {_WORDS.format('part')} AS w FROM (SELECT item_id, unnest(range(len(parts))) AS n, unnest(parts) AS part FROM (SELECT item_id, regexp_split_to_array({_FOLD.format('question')}, '[.?!]+') AS parts FROM eval_items) q) p
  ) x WHERE len(w) > 0
), kept AS (
  SELECT item_id, place, w, place - row_number() OVER (PARTITION BY item_id ORDER BY place) AS stretch FROM sentences
  WHERE array_to_string(w, ' ') NOT IN (SELECT array_to_string(w, ' ') FROM sentences GROUP BY array_to_string(w, ' ') HAVING count(DISTINCT item_id) >= 10)
), passages AS (SELECT item_id, flatten(list(w ORDER BY place)) AS p FROM kept GROUP BY item_id, stretch),
wanted AS (SELECT DISTINCT item_id, {_GRAMS.format('p')} AS gram FROM passages),
texts AS (SELECT 'video_records' AS tbl, rec_id, question AS text FROM video_records UNION ALL SELECT 'conversations', conv_id, text FROM conversations),
said AS (SELECT DISTINCT tbl, rec_id, {_GRAMS.format('w')} AS gram FROM (SELECT tbl, rec_id, {_WORDS.format(_FOLD.format('text'))} AS w FROM texts) t)
SELECT DISTINCT tbl, rec_id, item_id FROM said JOIN wanted USING (gram)""",
}
