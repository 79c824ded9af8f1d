"""Queries of answer parsing, prompts and scoring, with their SQL.

Predictions are the answers of video_records; each is set against the item of
eval_items that its rec_id points to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.answers import EXPLICIT, bracketed_letter, gold_letter, option_letter, predicted_letter
from ..operators import scoring
from ..operators.conversations import one_delivery
from ..operators.sampling import next_valid
from ..session import maybe_broadcast, table

ITEMS = 400
FIRST_ITEM = 7001
ITEM_STEP = 3


def item_of(rec: Column) -> Column:
    """The item a record is set against."""
    return F.pmod(rec, F.lit(ITEMS)) * ITEM_STEP + FIRST_ITEM


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = one_delivery(table(spark, sf_dir, "video_records").select("rec_id", "answer", "loaded_at"), ["rec_id"])
    items = table(spark, sf_dir, "eval_items").select("item_id", "answer", "task_type").withColumnRenamed("answer", "label")
    joined = answers.withColumn("item_id", item_of(F.col("rec_id"))).join(maybe_broadcast(items, 1_000_000), "item_id")
    return joined.select(F.col("rec_id").alias("id"), F.array("answer").alias("prediction"), "label", F.col("task_type").alias("category"))


def score_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(predictions(spark, sf_dir))


def score_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_with_total(predictions(spark, sf_dir))


def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.report(scoring.score(predictions(spark, sf_dir)))


def parse_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").where(F.col("role").isin("gpt", "assistant"))
    return said.groupBy("conv_id", "turn").agg(F.min("text").alias("t")).select("conv_id", "turn", predicted_letter(F.col("t")).alias("letter"), gold_letter(F.col("t")).alias("gold"))


def option_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items")
    text = F.get("options", (F.pmod("item_id", F.lit(4))).cast("int"))
    return items.select("item_id", option_letter(F.col("answer"), F.col("options")).alias("from_letter"), option_letter(text, F.col("options")).alias("from_text"), bracketed_letter(F.concat(F.lit("("), F.lower("answer"), F.lit(")"))).alias("bracketed"))


def prompt_lettered(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items")
    q, o = F.col("question"), F.col("options")
    return items.select("item_id", X.lettered_prompt(q, o).alias("lettered"), X.instructed_prompt(q, o).alias("instructed"), X.task_prompt("blink", X.lettered_prompt(q, o)).alias("with_task"), X.task_prompt("vstar", X.instructed_prompt(q, o)).alias("replaced"))


def prompt_abcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items")
    return items.select("item_id", X.four_option_prompt(F.col("question"), *(F.get("options", F.lit(i)) for i in range(4))).alias("prompt"))


def eval_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items")
    message = X.user_message(F.array(F.concat(F.lit("images/"), F.col("item_id").cast("string"), F.lit(".jpg"))), F.col("question"), 3136, 12845056)
    return items.select("item_id", F.posexplode(message["content"]).alias("part", "c")).select("item_id", "part", F.col("c.type").alias("kind"), F.col("c.ref").alias("ref"), F.col("c.text").alias("body"), F.col("c.max_pixels").alias("max_pixels"))


def next_valid_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = predictions(spark, sf_dir).select("id", predicted_letter(F.get("prediction", F.lit(0))).isNotNull().alias("valid"))
    return next_valid(letters, "id", "valid").select(F.col("ord").alias("id"), "taken")


def decode_failure_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("id", F.coalesce(F.get("prediction", F.lit(0)), F.lit("")).alias("prediction"), "label", F.coalesce("category", F.lit("overall")).alias("category"))


QUERIES = {
    "score_by_category": score_by_category,
    "score_rollup": score_rollup,
    "score_report": score_report,
    "parse_letter": parse_letter,
    "option_letter": option_letters,
    "prompt_lettered": prompt_lettered,
    "prompt_abcd": prompt_abcd,
    "eval_messages": eval_messages,
    "next_valid_row": next_valid_row,
    "decode_failure_default": decode_failure_default,
}


def strip_sql(text: str) -> str:
    return rf"regexp_replace({text}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"


def letter_sql(text: str) -> str:
    """SQL of predicted_letter."""
    t = strip_sql(f"regexp_replace({text}, '<[^>]*>', ' ', 'g')")
    hit = lambda p, o: f"nullif(regexp_extract({t}, '{p}', 1{o}), '')"
    return f"upper(coalesce({', '.join(hit(p, ', ' + chr(39) + 'i' + chr(39)) for p in EXPLICIT)}, {hit('(?:^|[^_' + chr(92) + 'pL' + chr(92) + 'pN])([A-Z])(?:[^_' + chr(92) + 'pL' + chr(92) + 'pN]|$)', '')}))"


PREDICTIONS = f"""
SELECT v.rec_id AS id, v.answer AS prediction, e.answer AS label, e.task_type AS category
FROM (SELECT rec_id, arg_min(struct_pack(a := answer), loaded_at).a AS answer FROM video_records GROUP BY rec_id) v
JOIN eval_items e ON e.item_id = (v.rec_id % {ITEMS}) * {ITEM_STEP} + {FIRST_ITEM}
"""
JUDGED = f"""
SELECT coalesce(category, 'overall') AS category, CASE WHEN {letter_sql('prediction')} = coalesce({letter_sql('label')}, upper({strip_sql('label')})) THEN 1 ELSE 0 END AS ok
FROM ({PREDICTIONS}) p
"""
_LETTERED = "coalesce(list_aggregate(list_transform(options[1:26], lambda c, i: chr(CAST(64 + i AS INTEGER)) || '. ' || c || chr(10)), 'string_agg', ''), '')"
_SENTENCE = "Answer with the option''s letter from the given choices directly."
_INSTRUCTION = "chr(10) || 'Output the letter of the correct answer only.'"

ORACLE = {
    "score_by_category": f"SELECT category, count(*) AS total, CAST(sum(ok) AS BIGINT) AS correct, round(sum(ok) / count(*), 6) AS accuracy FROM ({JUDGED}) j GROUP BY category",
    "score_rollup": f"SELECT category, CAST(grouping(category) AS INTEGER) AS is_overall, count(*) AS total, CAST(sum(ok) AS BIGINT) AS correct, round(sum(ok) / count(*), 6) AS accuracy FROM ({JUDGED}) j GROUP BY ROLLUP (category)",
    "score_report": f"SELECT category, format('Category: {{}} - Accuracy: {{}}/{{}} = {{:.2f}}', category, correct, total, accuracy * 100) AS line FROM (SELECT category, count(*) AS total, CAST(sum(ok) AS BIGINT) AS correct, round(sum(ok) / count(*), 6) AS accuracy FROM ({JUDGED}) j GROUP BY category) s",
    "parse_letter": f"SELECT conv_id, turn, {letter_sql('t')} AS letter, coalesce({letter_sql('t')}, upper({strip_sql('t')})) AS gold FROM (SELECT conv_id, turn, min(text) AS t FROM conversations WHERE role IN ('gpt', 'assistant') GROUP BY conv_id, turn) s",
    "option_letter": "SELECT item_id, upper(answer) AS from_letter, chr(CAST(64 + list_position(options, options[1 + item_id % 4]) AS INTEGER)) AS from_text, upper(substr('(' || lower(answer) || ')', 2, 1)) AS bracketed FROM eval_items",
    "prompt_lettered": f"SELECT item_id, question || chr(10) || 'Options:' || chr(10) || {_LETTERED} AS lettered, question || chr(10) || {_LETTERED} || '{_SENTENCE}' AS instructed, question || chr(10) || 'Options:' || chr(10) || {_LETTERED} || {_INSTRUCTION} AS with_task, replace(question || chr(10) || {_LETTERED} || '{_SENTENCE}', '{_SENTENCE}', {_INSTRUCTION}) AS replaced FROM eval_items",
    "prompt_abcd": "SELECT item_id, question || chr(10) || 'Options:' || chr(10) || '(A)' || options[1] || chr(10) || '(B)' || options[2] || chr(10) || '(C)' || options[3] || chr(10) || '(D)' || options[4] AS prompt FROM eval_items",
    "eval_messages": "SELECT item_id, 0 AS part, 'image' AS kind, 'images/' || item_id || '.jpg' AS ref, CAST(NULL AS VARCHAR) AS body, CAST(12845056 AS BIGINT) AS max_pixels FROM eval_items UNION ALL SELECT item_id, 1, 'text', NULL, question, NULL FROM eval_items",
    "next_valid_row": f"SELECT id, coalesce(first_value(CASE WHEN ok THEN id END IGNORE NULLS) OVER (ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), min(CASE WHEN ok THEN id END) OVER ()) AS taken FROM (SELECT id, {letter_sql('prediction')} IS NOT NULL AS ok FROM ({PREDICTIONS}) p) s",
    "decode_failure_default": f"SELECT id, coalesce(prediction, '') AS prediction, label, coalesce(category, 'overall') AS category FROM ({PREDICTIONS}) p",
}
