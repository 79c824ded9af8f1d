"""Conversations: raw records to internal ones, turns to chat pairs, box counts to turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrays import ignored, rule_tokens
from ..session import maybe_broadcast

BROADCAST_ROWS = 1_000_000
#: Turn numbers of a conversation that are looked at together.
BLOCK = 4096


def normalize_raw(records: DataFrame) -> DataFrame:
    """Raw records (image array, conversations array of from, value) as (image, bboxes, question, answer).

    Every reply that is only a box gives one, its numbers clamped; the question
    is the first human turn without the request for a box, with a placeholder;
    the answer the last reply that is neither empty nor a box, in answer tags.
    Records without a question or an answer are left out.
    """
    said = lambda t: F.coalesce(t["value"], F.lit(""))
    replies = F.filter("conversations", lambda t: t["from"] == "gpt")
    boxes = F.filter(F.transform(F.filter(replies, lambda t: X.is_box(said(t))), lambda t: X.box_numbers(said(t))), lambda b: F.size(b) == 4)
    asked = F.get(F.filter("conversations", lambda t: t["from"] == "human"), F.lit(0))
    question = F.when(asked.isNotNull(), X.with_placeholder(X.strip(X.without_box_request(said(asked)))))
    answers = F.filter(F.transform(replies, lambda t: X.strip(said(t))), lambda v: (v != "") & ~X.is_box(v))
    answer = F.try_element_at(answers, F.lit(-1))
    keys = [c for c in records.columns if c not in ("image", "conversations")]
    made = records.select(*keys, F.get("image", F.lit(0)).alias("image"), boxes.alias("bboxes"), question.alias("question"), answer.alias("a"))
    return made.where("question is not null and a is not null").select(*keys, "image", "bboxes", "question", X.wrap_answer(F.col("a")).alias("answer"))


def normalize_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """As normalize_raw, from one row a turn (key, turn, role, text, image): (key, image, bboxes, question, answer).

    The question and the answer are minima and maxima, so a conversation's
    turns are combined before the shuffle; only its boxes are gathered.
    """
    said = F.coalesce("text", F.lit(""))
    reply, box = F.col("role") == "gpt", X.is_box(said)
    numbers = X.box_numbers(said)
    words = X.strip(said)
    spoken = reply & (words != "") & ~X.is_box(words)
    made = turns.groupBy(key).agg(
        F.min("image").alias("image"),
        F.transform(F.array_sort(F.collect_list(F.when(reply & box & (F.size(numbers) == 4), F.struct("turn", numbers.alias("box"))))), lambda b: b["box"]).alias("bboxes"),
        F.min_by(said, F.when(F.col("role") == "human", F.col("turn"))).alias("q"),
        F.max_by(words, F.when(spoken, F.col("turn"))).alias("a"),
    )
    made = made.withColumn("question", F.when(F.col("q").isNotNull(), X.with_placeholder(X.strip(X.without_box_request(F.col("q"))))))
    return made.where("question is not null and a is not null").select(key, "image", "bboxes", "question", X.wrap_answer(F.col("a")).alias("answer"))


def normalize_files(records: DataFrame, by: str = "file") -> DataFrame:
    """(by, ord, image, bboxes, question, answer) of record files, each raw or normalised already, told by its first record.

    A raw file has no boxes beside its conversations; its records go through
    normalize_raw. Those of others pass through, their question and answer being
    the first human and the first gpt turn. A file's kind is looked up by one
    row a file. Records carry by, ord, image (array), bboxes and conversations.
    """
    kinds = records.groupBy(by).agg(F.min_by(F.col("bboxes").isNull() & F.col("conversations").isNotNull(), "ord").alias("_raw"))
    told = records.select(by, "ord", "image", "bboxes", "conversations").join(maybe_broadcast(kinds, BROADCAST_ROWS), by)
    raw = normalize_raw(told.where("_raw").select(by, "ord", "image", "conversations"))
    first = lambda role: F.get(F.filter("conversations", lambda t: t["from"] == role), F.lit(0))["value"]
    ready = told.where(~F.col("_raw")).select(by, "ord", F.get("image", F.lit(0)).alias("image"), "bboxes", first("human").alias("question"), first("gpt").alias("answer"))
    return raw.select(*ready.columns).unionByName(ready)


def turns_to_records(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turns in order as (key, image array, conversations array). A conversation's turns are one row; a record is bounded."""
    folded = turns.groupBy(key).agg(F.min("image").alias("i"), F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value")))).alias("c"))
    return folded.select(key, F.array("i").alias("image"), F.transform("c", lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"))


def one_delivery(df: DataFrame, keys: list[str], by: str = "loaded_at") -> DataFrame:
    """Of rows delivered again, the first."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("r"))
    return first.select(*keys, "r.*").select(*df.columns)


def placed_turns(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """turns with n, their place in their conversation, and led, whether that begins with a system turn.

    Places are counted in blocks of turn numbers and carried on by one row a
    block, so a very long conversation is no single task.
    """
    rows = turns.withColumn("_block", F.floor(F.col("turn") / block))
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn")
    blocks = rows.groupBy("conv_id", "_block").agg(F.count(F.lit(1)).alias("_size"), F.min_by(F.coalesce(F.col("role") == "system", F.lit(False)), "turn").alias("_system"))
    by_conv = Window.partitionBy("conv_id").orderBy("_block")
    carried = blocks.select("conv_id", "_block", (F.sum("_size").over(by_conv) - F.col("_size")).alias("_before"), F.first("_system").over(by_conv).alias("led"))
    placed = rows.withColumn("_n", F.row_number().over(inside) - 1).join(carried, ["conv_id", "_block"])
    return placed.withColumn("n", F.col("_before") + F.col("_n")).drop("_n", "_before", "_block")


def chat_pairs(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, pair, prompt, response): turns paired two by two after a leading system turn; a last unpaired turn has a null response."""
    own = placed_turns(turns, block).withColumn("lead", F.col("led").cast("int")).where("not (n = 0 and led)").withColumn("n", F.col("n") - F.col("lead"))
    pair = own.groupBy("conv_id", F.floor(F.col("n") / 2).alias("pair")).agg(F.max(F.when(F.col("n") % 2 == 0, F.struct("role", "text"))).alias("p"), F.max(F.when(F.col("n") % 2 == 1, F.struct("role", "text"))).alias("r"))
    say = lambda t: F.when(t.isNotNull(), X.chat_text(X.chat_role(t["role"]), X.mark_media(t["text"])))
    return pair.select("conv_id", "pair", say(F.col("p")).alias("prompt"), say(F.col("r")).alias("response"))


def chat_samples(turns: DataFrame, tokenize: Callable[[Column], Column] = rule_tokens, block: int = BLOCK) -> DataFrame:
    """(conv_id, ids, labels): every conversation as one training sample.

    It begins with the system turn; then come the pairs, each prompt with the
    head of its response, none of it labelled, and the response with its turn
    end, which is. A pair without both sides is left out. tokenize gives the
    token ids of a text column; a sample's pairs are put together in one row,
    which is what a sample is.
    """
    pairs = chat_pairs(turns, block).where(F.col("prompt").isNotNull() & F.col("response").isNotNull())
    head = F.regexp_extract("response", r"(?s)^(.*?\n)", 1)
    body = F.substring("response", F.length(head) + 1, F.length("response"))
    asked, said = tokenize(F.concat(F.col("prompt"), head)), tokenize(body)
    parts = pairs.select("conv_id", F.struct("pair", asked.alias("asked"), said.alias("said")).alias("p")).groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    begin = tokenize(X.system_turn())
    ids = F.concat(begin, F.flatten(F.transform("p", lambda p: F.concat(p["asked"], p["said"]))))
    labels = F.concat(ignored(F.size(begin)), F.flatten(F.transform("p", lambda p: F.concat(ignored(F.size(p["asked"])), p["said"]))))
    return parts.select("conv_id", ids.alias("ids"), labels.alias("labels"))


def counts_by_turn(turns: DataFrame, counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, counts): the record's box counts on its first reply, an empty array elsewhere.

    The first reply is found by one row a block of turns, and only that block
    has a partner in the join, so a very long conversation is no single task.
    """
    rows = turns.withColumn("_block", F.floor(F.col("turn") / block))
    heads = rows.where(X.chat_role(F.col("role")) == "assistant").groupBy("conv_id", "_block").agg(F.min("turn").alias("first"))
    first = heads.groupBy("conv_id").agg(F.min_by(F.struct("_block", "first"), "first").alias("f")).select("conv_id", "f.*").join(counts, "conv_id")
    none = F.array().cast("array<bigint>")
    return rows.join(first, ["conv_id", "_block"], "left").select("conv_id", "turn", F.when(F.col("turn") == F.col("first"), F.coalesce("counts", none)).otherwise(none).alias("counts"))
