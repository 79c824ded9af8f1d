"""Queries of records, conversations, boxes and frames, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ImagePreset, VideoPreset
from ..functions import frames, geometry
from ..functions import text as X
from ..operators import automata, conversations
from ..operators.intervals import span_pairs
from ..session import table

IMAGE, VIDEO = ImagePreset(), VideoPreset()
#: Fixed values of the queries: token ids, image sides, clip lengths.
START, TOKEN, END, STOP = 7, 8, 9, 2
STEPS = 4
PREFIX = [101, 102, 103]
LETTERS = [65, 66, 67, 68]


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.one_delivery(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, at, box, w, h: boxes of visual records, with image sides derived from the id."""
    rows = conversations.one_delivery(table(spark, sf_dir, "visual_records").select("conv_id", "bboxes", "loaded_at"), ["conv_id"])
    sides = ((F.pmod("conv_id", F.lit(900)) + 60).cast("int").alias("w"), (F.pmod(F.col("conv_id") * 7, F.lit(700)) + 40).cast("int").alias("h"))
    return rows.select("conv_id", F.posexplode("bboxes").alias("box_no", "box"), *sides)


def role_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", X.chat_role(F.col("role")).alias("role"))


def placeholder_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", X.mark_media(F.col("text")).alias("marked"), X.with_placeholder(F.col("text")).alias("with_placeholder"))


def box_count_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crop tokens of each record's boxes in order, boxes without a crop as 0."""
    tokens = geometry.crop_tokens(F.col("box"), F.col("w"), F.col("h"), IMAGE.crop_min_pixels, IMAGE.crop_max_pixels)
    lists = boxes(spark, sf_dir).select("conv_id", F.struct("box_no", tokens.alias("n")).alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lists.select("conv_id", F.array_join(F.transform("x", lambda x: x["n"].cast("string")), ",").alias("counts"))


def reflection_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = F.array(F.pmod("turn", F.lit(3)), F.lit(0).cast("bigint"), F.pmod("conv_id", F.lit(2)))
    said = turns(spark, sf_dir).where(F.col("role").isin("gpt", "assistant"))
    return said.select("conv_id", "turn", X.reflect(F.col("text"), small).alias("image_text"), X.reflect(F.col("text"), F.array(F.lit(0))).alias("skipped_text"), X.reflect_video(F.col("text"), F.pmod("conv_id", F.lit(4))).alias("video_text"))


def assistant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = boxes(spark, sf_dir).groupBy("conv_id").agg(F.array(F.count(F.lit(1))).alias("counts"))
    return conversations.counts_by_turn(turns(spark, sf_dir), counts).select("conv_id", "turn", F.coalesce(F.get("counts", F.lit(0)), F.lit(0)).alias("n_boxes"))


def chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.chat_pairs(turns(spark, sf_dir))


def raw_record_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = conversations.normalize_turns(turns(spark, sf_dir))
    return made.select("conv_id", "image", F.size("bboxes").alias("n_boxes"), F.round(F.get(F.get("bboxes", F.lit(0)), F.lit(2)), 6).alias("first_x1"), "question", "answer")


def bbox_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).withColumn("o", geometry.ordered_box(F.col("box"))).withColumn("p", geometry.pixel_box(F.col("o"), F.col("w"), F.col("h")))
    return rows.select("conv_id", "box_no", F.round(geometry.area(F.col("o")), 6).alias("area"), *(F.col(f"p.{c}").alias(f"p{c}") for c in ("x0", "y0", "x1", "y1")), geometry.is_sliver(F.col("p")).alias("sliver"))


def crop_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("conv_id", "box_no", geometry.crop_tokens(F.col("box"), F.col("w"), F.col("h"), IMAGE.crop_min_pixels, IMAGE.crop_max_pixels, IMAGE.area_threshold).alias("tokens"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, pairs, fps, total: readable spans of records, with clip figures derived from the id."""
    rows = conversations.one_delivery(table(spark, sf_dir, "video_records").select("rec_id", "temporal_span", "loaded_at"), ["rec_id"])
    fps = (F.pmod("rec_id", F.lit(5)) * 5 + 10).cast("double")
    return rows.select("rec_id", span_pairs(F.col("temporal_span")).alias("pairs"), fps.alias("fps"), (F.pmod(F.col("rec_id") * 13, F.lit(30000)) + 1).cast("bigint").alias("total"))


def span_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).where("pairs is not null").select("rec_id", F.size("pairs").alias("n"), F.round(F.get(F.get("pairs", F.lit(0)), F.lit(0)), 6).alias("first_lo"), F.round(F.get(F.element_at("pairs", -1), F.lit(1)), 6).alias("last_hi"))


def clue_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir).where("pairs is not null").withColumn("r", frames.frame_ranges(F.col("pairs"), F.col("fps"), F.col("total")))
    return rows.select("rec_id", F.array_join(F.transform(frames.clue_frames(F.col("r"), VIDEO.clue_frames), lambda x: x.cast("string")), ",").alias("frames"))


def frame_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = frames.train_frame_count(F.col("total"), F.col("fps"), VIDEO.fps, VIDEO.max_frames)
    pixels = frames.frame_pixels(F.col("train_frames"), VIDEO.min_pixels, VIDEO.max_pixels, VIDEO.max_tokens)
    return spans(spark, sf_dir).select("rec_id", n.alias("train_frames"), frames.eval_frame_count(F.col("total"), F.col("fps"), 2.0, 512).alias("eval_frames")).withColumn("frame_pixels", F.round(pixels, 3))


def uniform_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = frames.train_frame_count(F.col("total"), F.col("fps"), VIDEO.fps, 16)
    return spans(spark, sf_dir).select("rec_id", F.array_join(F.transform(frames.uniform_frames(F.col("total"), n), lambda x: x.cast("string")), ",").alias("frames"))


def decode_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda c: c.cast("bigint")
    rows = turns(spark, sf_dir).withColumn("tokens", F.transform(F.sequence(F.lit(0), F.col("turn").cast("int") + 5), lambda i: long(F.pmod(F.col("conv_id") + i * 3, F.lit(12)))))
    forced = automata.forced_tokens(F.col("tokens"), START, TOKEN, END, STEPS)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return rows.select("conv_id", "turn", text(forced).alias("forced"), text(automata.allowed_tokens(F.col("tokens"), START, TOKEN, END, PREFIX, LETTERS, STOP)).alias("allowed"))


QUERIES = {
    "role_map": role_map,
    "placeholder_rewrite": placeholder_rewrite,
    "reflection_prefix": reflection_prefix,
    "assistant_counts": assistant_counts,
    "chat_pairs": chat_pairs,
    "raw_record_normalize": raw_record_normalize,
    "bbox_geometry": bbox_geometry,
    "crop_tokens": crop_tokens,
    "box_count_lists": box_count_lists,
    "span_normalize": span_normalize,
    "clue_frames": clue_frames,
    "frame_budget": frame_budget,
    "uniform_frames": uniform_frames,
    "decode_automaton": decode_automaton,
}

_TURNS = "(SELECT conv_id, turn, r.role AS role, r.text AS text, r.image AS image FROM (SELECT conv_id, turn, arg_min(struct_pack(role := role, text := text, image := image), loaded_at) AS r FROM conversations GROUP BY conv_id, turn) d)"
_ROLE = "CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE role END"
_MARK = "regexp_replace(text, '\\n?<image>\\n?', '<|vision_start|><|image_pad|><|vision_end|>', 'g')"
_PLAIN = "replace(replace(text, '<answer> ', 'The answer is: '), ' </answer>', '')"
_STRIP = r"regexp_replace({}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"
_BLOCK = "CASE WHEN ({0}) > 0 THEN '<BOR>' || repeat('<VR>', CAST({0} AS BIGINT)) || '<EOR>' ELSE '' END"
_BOX = X.PURE_BOX
_BOXES = "(SELECT conv_id, unnest(range(len(b))) AS box_no, unnest(b) AS box, CAST(conv_id % 900 + 60 AS INTEGER) AS w, CAST(conv_id * 7 % 700 + 40 AS INTEGER) AS h FROM (SELECT conv_id, arg_min(struct_pack(b := bboxes), loaded_at).b AS b FROM visual_records GROUP BY conv_id) d)"
_CL = "least(greatest(box[{}], 0), 1)"
_ORDERED = f"(SELECT conv_id, box_no, w, h, least({_CL.format(1)}, {_CL.format(3)}) AS x0, least({_CL.format(2)}, {_CL.format(4)}) AS y0, greatest({_CL.format(1)}, {_CL.format(3)}) AS x1, greatest({_CL.format(2)}, {_CL.format(4)}) AS y1 FROM {_BOXES} b)"
_PIX1 = f"(SELECT *, (x1 - x0) * (y1 - y0) AS area, CAST(least(round_even(x0 * w, 0), w - 1) AS INTEGER) AS px0, CAST(least(round_even(y0 * h, 0), h - 1) AS INTEGER) AS py0 FROM {_ORDERED} o)"
_PIX = f"(SELECT *, CAST(least(w, greatest(px0 + 1, round_even(x1 * w, 0))) AS INTEGER) AS px1, CAST(least(h, greatest(py0 + 1, round_even(y1 * h, 0))) AS INTEGER) AS py1 FROM {_PIX1} p)"
_SLIVER = "(least(px1 - px0, py1 - py0) <= 0 OR greatest(px1 - px0, py1 - py0) >= 200 * least(px1 - px0, py1 - py0))"
_NEAR = "greatest(round_even({} / 28.0, 0) * 28, 28)"
_FIT = f"CASE WHEN {_NEAR.format('cw')} * {_NEAR.format('ch')} > {IMAGE.crop_max_pixels} THEN greatest(floor({{0}} / sqrt(CAST(cw AS DOUBLE) * ch / {IMAGE.crop_max_pixels}) / 28) * 28, 28) WHEN {_NEAR.format('cw')} * {_NEAR.format('ch')} < {IMAGE.crop_min_pixels} THEN ceil({{0}} * sqrt({IMAGE.crop_min_pixels} / (CAST(cw AS DOUBLE) * ch)) / 28) * 28 ELSE {_NEAR.format('{0}')} END"
_NUM = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_PAIR = rf"\[\s*{_NUM}\s*,\s*{_NUM}\s*\]"
_SPANS = rf"""(SELECT rec_id, CAST(rec_id % 5 * 5 + 10 AS DOUBLE) AS fps, CAST(rec_id * 13 % 30000 + 1 AS BIGINT) AS total,
  CASE WHEN (regexp_full_match(t, '\s*{_PAIR}\s*') OR regexp_full_match(t, '\s*\[\s*{_PAIR}\s*(,\s*{_PAIR}\s*)*\]\s*'))
    AND len(list_filter(regexp_extract_all(t, '{_NUM}'), lambda x: coalesce(CASE WHEN CAST(x AS DOUBLE) < 0 OR isinf(CAST(x AS DOUBLE)) THEN 1 END, 0) = 1)) = 0
  THEN list_transform(regexp_extract_all(t, '{_PAIR}'), lambda p: [CAST(x AS DOUBLE) FOR x IN regexp_extract_all(p, '{_NUM}')]) END AS pairs
  FROM (SELECT rec_id, arg_min(struct_pack(t := temporal_span), loaded_at).t AS t FROM video_records GROUP BY rec_id) d)"""
_AT = "greatest(least(CAST(round_even({}(p[1], p[2]) * fps, 0) AS BIGINT), total - 1), 0)"
_RANGES = f"(SELECT rec_id, list_transform(pairs, lambda p: [{_AT.format('least')}, {_AT.format('greatest')}]) AS r FROM {_SPANS} s WHERE pairs IS NOT NULL)"
_LIN = "list_transform(range(CAST({n} AS BIGINT)), lambda i: CAST(round_even({lo} + i * (CASE WHEN {n} > 1 THEN CAST({hi} - {lo} AS DOUBLE) / ({n} - 1) ELSE 0.0 END), 0) AS BIGINT))"
_SHARE = "greatest(round_even(3 * (q[2] - q[1]) / span, 0), 1)"
_TRAIN = "least(greatest(CAST(round_even(least(greatest(total / greatest(fps, 1e-6) * 1.0, 4.0), {m}.0, CAST(total AS DOUBLE)) / 2, 0) AS BIGINT) * 2, 2), total)"
_TOKENS = "(SELECT conv_id, turn, list_transform(range(turn + 6), lambda i: (conv_id + i * 3) % 12) AS tokens FROM (SELECT DISTINCT conv_id, turn FROM conversations) d)"
_GEN = f"list_position(list_reverse(tokens), {END})"

ORACLE = {
    "role_map": f"SELECT conv_id, turn, {_ROLE} AS role FROM {_TURNS} t",
    "placeholder_rewrite": f"SELECT conv_id, turn, {_MARK} AS marked, CASE WHEN contains(text, '<image>') THEN text ELSE '<image>' || chr(10) || text END AS with_placeholder FROM {_TURNS} t",
    "reflection_prefix": f"SELECT conv_id, turn, CASE WHEN turn % 3 > 0 OR conv_id % 2 > 0 THEN {_BLOCK.format('turn % 3')} || {_BLOCK.format('conv_id % 2')} || {_PLAIN} ELSE {_STRIP.format(_PLAIN)} END AS image_text, {_STRIP.format(_PLAIN)} AS skipped_text, {_BLOCK.format('conv_id % 4')} || text AS video_text FROM {_TURNS} t WHERE role IN ('gpt', 'assistant')",
    "assistant_counts": f"SELECT t.conv_id, turn, CASE WHEN turn = min(CASE WHEN {_ROLE} = 'assistant' THEN turn END) OVER (PARTITION BY t.conv_id) THEN coalesce(n, 0) ELSE 0 END AS n_boxes FROM {_TURNS} t LEFT JOIN (SELECT conv_id, count(*) AS n FROM {_BOXES} b GROUP BY conv_id) c ON c.conv_id = t.conv_id",
    "chat_pairs": f"""
WITH placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, CAST(first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'system' AS INTEGER) AS lead FROM {_TURNS} t),
own AS (SELECT conv_id, n - lead AS n, '<|im_start|>' || {_ROLE} || chr(10) || {_MARK} || '<|im_end|>' || chr(10) AS said FROM placed WHERE NOT (n = 0 AND lead = 1))
SELECT conv_id, n // 2 AS pair, max(CASE WHEN n % 2 = 0 THEN said END) AS prompt, max(CASE WHEN n % 2 = 1 THEN said END) AS response FROM own GROUP BY conv_id, n // 2""",
    "raw_record_normalize": rf"""
WITH folded AS (SELECT conv_id, min(image) AS image, list(struct_pack(role := role, v := coalesce(text, '')) ORDER BY turn) AS c FROM {_TURNS} t GROUP BY conv_id),
parts AS (SELECT conv_id, image, list_filter(c, lambda t: t.role = 'human') AS asked, list_transform(list_filter(c, lambda t: t.role = 'gpt'), lambda t: t.v) AS said FROM folded),
made AS (SELECT conv_id, image,
  list_filter(list_transform(list_filter(said, lambda v: regexp_matches({_STRIP.format('v')}, '{_BOX}')), lambda v: [least(greatest(CAST(x AS DOUBLE), 0), 1) FOR x IN regexp_extract_all(v, '[-+]?\d+(?:\.\d+)?')[1:4]]), lambda b: len(b) = 4) AS boxes,
  {_STRIP.format("regexp_replace(asked[1].v, '(?is)" + chr(92) + "s*Please provide the bounding box coordinate.*', '')")} AS q,
  list_filter([{_STRIP.format('v')} FOR v IN said], lambda v: v <> '' AND NOT regexp_matches(v, '{_BOX}'))[-1] AS a, len(asked) AS n_asked FROM parts)
SELECT conv_id, image, len(boxes) AS n_boxes, round(boxes[1][3], 6) AS first_x1, CASE WHEN contains(q, '<image>') THEN q ELSE '<image>' || chr(10) || q END AS question, chr(10) || '<answer> ' || a || ' </answer>' AS answer FROM made WHERE n_asked > 0 AND a IS NOT NULL""",
    "bbox_geometry": f"SELECT conv_id, box_no, round(area, 6) AS area, px0, py0, px1, py1, {_SLIVER} AS sliver FROM {_PIX} p",
    "crop_tokens": f"SELECT conv_id, box_no, CASE WHEN area <= 0 OR area >= 1.0 OR {_SLIVER} THEN 0 ELSE CAST(CAST(({_FIT.format('cw')}) AS BIGINT) * CAST(({_FIT.format('ch')}) AS BIGINT) // 784 AS BIGINT) END AS tokens FROM (SELECT *, px1 - px0 AS cw, py1 - py0 AS ch FROM {_PIX} p) q",
    "span_normalize": f"SELECT rec_id, len(pairs) AS n, round(pairs[1][1], 6) AS first_lo, round(pairs[-1][2], 6) AS last_hi FROM {_SPANS} s WHERE pairs IS NOT NULL",
    "clue_frames": f"""
WITH s AS (SELECT rec_id, r, CASE WHEN list_sum([q[2] - q[1] FOR q IN r]) = 0 THEN 1 ELSE list_sum([q[2] - q[1] FOR q IN r]) END AS span FROM {_RANGES} x),
f AS (SELECT rec_id, list_sort(list_distinct(flatten(list_transform(r, lambda q: {_LIN.format(n=_SHARE, lo='q[1]', hi='q[2]')})))) AS f FROM s)
SELECT rec_id, array_to_string(CASE WHEN len(f) > 3 THEN list_transform({_LIN.format(n='3', lo='0', hi='(len(f) - 1)')}, lambda i: f[1 + i]) ELSE f END, ',') AS frames FROM f""",
    "frame_budget": f"SELECT *, round(least(200704.0, greatest(least(602112.0, 20000 * 784 * 0.9::DOUBLE / train_frames * 2), 105369.0)), 3) AS frame_pixels FROM (SELECT rec_id, {_TRAIN.format(m=256)} AS train_frames, greatest(CASE WHEN n >= 2 THEN n - n % 2 ELSE n END, 1) AS eval_frames FROM (SELECT *, CAST(least(round_even(total / fps * 2.0, 0), 512, total) AS BIGINT) AS n FROM {_SPANS} s) x) y",
    "uniform_frames": f"SELECT rec_id, array_to_string({_LIN.format(n='n', lo='0', hi='(total - 1)')}, ',') AS frames FROM (SELECT *, {_TRAIN.format(m=16)} AS n FROM {_SPANS} s) x",
    "decode_automaton": f"""
SELECT conv_id, turn, array_to_string(flatten(list_transform(tokens, lambda t: CASE WHEN t = {START} THEN [t] || [{', '.join([str(TOKEN)] * STEPS)}, {END}] ELSE [t] END)), ',') AS forced,
  CASE WHEN len(tokens) = 0 THEN '{START}' WHEN NOT list_contains(tokens, {END}) THEN '{TOKEN}' WHEN {_GEN} - 1 < {len(PREFIX)} THEN CAST([{', '.join(map(str, PREFIX))}][{_GEN}] AS VARCHAR) WHEN {_GEN} - 1 = {len(PREFIX)} THEN '{','.join(map(str, LETTERS))}' ELSE '{STOP}' END AS allowed
FROM {_TOKENS} x""",
}
ORACLE["box_count_lists"] = f"SELECT conv_id, string_agg(CAST(tokens AS VARCHAR), ',' ORDER BY box_no) AS counts FROM ({ORACLE['crop_tokens']}) c GROUP BY conv_id"
