"""Merge overlapping intervals per key into periods and list the gaps between them.

session_window with a duration per row merges what overlaps. A key may hold a
third of all rows, so the merge runs per (key, time bucket): the buckets of a
key go to different tasks, and one summary row per bucket carries the furthest
end onwards. Nothing but those summaries is ever gathered by key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Longest time that is kept, in milliseconds: microseconds of a timestamp must hold it.
MAX_MS = 9_000_000_000_000_000
BUCKET_MS = 600_000

_NUMBER = r"(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
_PAIR = rf"\[[ \t\r\n]*{_NUMBER}[ \t\r\n]*,[ \t\r\n]*{_NUMBER}[ \t\r\n]*\]"
_MARK = "\u0001"


def span_pairs(text: Column) -> Column:
    """JSON text of a pair of times, or a non-empty list of pairs, as array<array<double>>.

    Null where the text is anything else or a number is negative or not finite.
    Stays in the JVM; the grammar is checked by replacing each pair by a mark.
    """
    skeleton = F.regexp_replace(F.regexp_replace(text, _PAIR, _MARK), r"[ \t\r\n]+", "")
    listed = F.replace(skeleton, F.lit(_MARK + ","), F.lit("")) == f"[{_MARK}]"
    shaped = ((skeleton == _MARK) | listed) & ~F.contains(text, F.lit(_MARK))
    parts = F.regexp_extract_all(text, F.lit(f"({_PAIR})"), F.lit(1))
    side = rf"({_NUMBER})[^,]*,[^0-9-]*({_NUMBER})"
    pairs = F.transform(parts, lambda p: F.array(*(F.regexp_extract(p, side, i).cast("double") for i in (1, 2))))
    fit = F.forall(pairs, lambda p: (F.array_min(p) >= 0) & (F.array_max(p) < F.lit(float("inf"))))
    return F.when(shaped & fit, pairs)


def to_ms(seconds: Column) -> Column:
    return F.least(F.rint(seconds * 1000), F.lit(float(MAX_MS))).cast("bigint")


def merge_intervals(spans: DataFrame, key: str, start: str, end: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(key, kind, start_ms, end_ms): kind "period" per merged stretch, "gap" between neighbouring periods.

    start and end are whole milliseconds. Reversed pairs are turned round;
    pairs of zero length or with a null end, and rows with a null key, are
    ignored; stretches that touch are one. Repeated rows and extra columns,
    whatever their names, change nothing; an empty table gives no rows.
    """
    lo, hi = F.least(start, end), F.greatest(start, end)
    whole = F.col(start).isNotNull() & F.col(end).isNotNull() & F.col(key).isNotNull()
    rows = spans.where(whole).select(F.col(key).alias("k"), lo.alias("s"), hi.alias("e")).where("s < e")
    rows = rows.groupBy("k", "s").agg(F.max("e").alias("e"))  # combined before the shuffle, so repeats cost nothing
    rows = rows.withColumn("b", F.floor(F.col("s") / bucket_ms))
    duration = F.concat((F.col("e") - F.col("s")).cast("string"), F.lit(" milliseconds"))
    session = F.session_window(F.timestamp_millis("s"), duration)
    merged = rows.groupBy("k", "b", session.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    merged = checkpointed(merged.select("k", "b", F.unix_millis("w.start").alias("s"), F.unix_millis("w.end").alias("e")))

    in_bucket = Window.partitionBy("k", "b").orderBy("s")
    before = in_bucket.rowsBetween(Window.unboundedPreceding, -1)
    buckets = merged.groupBy("k", "b").agg(F.max("e").alias("far"))
    of_key = Window.partitionBy("k").orderBy("b")
    carry = buckets.select("k", "b", F.max("far").over(of_key.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"), F.max("far").over(Window.partitionBy("k")).alias("last"))
    opened = merged.join(carry, ["k", "b"]).withColumn("reached", F.greatest("carry", F.max("e").over(before)))
    opened = opened.where(F.col("reached").isNull() | (F.col("s") > F.col("reached"))).select("k", "b", "s", "reached", "last")

    heads = opened.groupBy("k", "b").agg(F.min_by("reached", "s").alias("head"), F.max("last").alias("last"))
    after = heads.select("k", "b", F.coalesce(F.lead("head").over(of_key), "last").alias("next_end"))
    closed = opened.join(after, ["k", "b"]).withColumn("end_ms", F.coalesce(F.lead("reached").over(in_bucket), "next_end"))
    period = F.struct(F.lit("period").alias("kind"), F.col("s").alias("start_ms"), F.col("end_ms"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("reached").alias("start_ms"), F.col("s").alias("end_ms"))
    both = F.when(F.col("reached").isNull(), F.array(period)).otherwise(F.array(period, gap))
    return closed.select(F.col("k").alias(key), F.explode(both).alias("r")).select(key, "r.kind", "r.start_ms", "r.end_ms")


def video_periods(records: DataFrame) -> DataFrame:
    """Periods and gaps of each non-blank video's spans.

    temporal_span is used, or clue_intervals where temporal_span is null; text
    that can't be read adds nothing. Times become whole milliseconds, halves to
    even, and none lies beyond MAX_MS.
    """
    pairs = span_pairs(F.coalesce("temporal_span", "clue_intervals"))
    named = records.where(F.regexp_replace("video", r"(?U)[\s\x1C-\x1F]+", "") != "")
    spans = named.select("video", F.explode(pairs).alias("p")).select("video", to_ms(F.get("p", F.lit(0))).alias("lo"), to_ms(F.get("p", F.lit(1))).alias("hi"))
    return merge_intervals(spans, "video", "lo", "hi")
