"""Shards, seeded orders, weighted draws, epochs, and the next valid record.

Order comes from md5(seed_id), so that any engine can check it; it is not the
order of another library's generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import maybe_broadcast

BROADCAST_ROWS = 1_000_000


def seeded_key(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("_", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def unit_interval(key: Column) -> Column:
    """An md5 key as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(16**8))


def shards_for(rows: int, per_shard: int = 50_000, least: int = 1) -> int:
    return max(least, -(-rows // per_shard))


def resumed(df: DataFrame, ord: str, worker: int, workers: int, position: int = 0) -> DataFrame:
    """A worker's rows of a source dealt out round robin, from its position on: the rows that it hasn't seen before."""
    return df.where((F.pmod(F.col(ord), F.lit(workers)) == worker) & (F.floor(F.col(ord) / workers) >= position))


def global_worker(rank: Column, local: Column, workers: int) -> Column:
    return rank * workers + local


def seeded_head(df: DataFrame, seed: int | None, limit: int | None, *ids: str) -> DataFrame:
    """The first rows of a seeded order; seed 0 or null keeps the order of the ids, no limit takes all."""
    order = [seeded_key(seed, *(F.col(c) for c in ids))] if seed else []
    ordered = df.orderBy(*order, *ids)
    return ordered if limit is None else ordered.limit(limit)


def mixture_weights(df: DataFrame, source: str) -> DataFrame:
    """(source, n_rows, weight, percent) of each source."""
    counted = df.groupBy(source).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counted.agg(F.sum("n_rows").alias("all_rows"))
    share = F.col("n_rows") / F.col("all_rows")
    return counted.join(F.broadcast(total)).select(source, "n_rows", F.round(share, 6).alias("weight"), F.round(share * 100, 2).alias("percent"))


def weighted_draw(steps: DataFrame, step: str, weights: DataFrame, source: str, seed: int, buckets: int = 4096) -> DataFrame:
    """(step, source): a source drawn for each step by its weight, weights summing to 1; those without a positive weight are never drawn.

    The unit interval is cut into buckets, and each source stands in those that
    its stretch touches; a step looks only at the sources of its bucket, by an
    equal key. So the cost of a step doesn't grow with the sources, and their
    list is broadcast only if it is small.
    """
    w = Window.orderBy(source)
    upper = F.sum("weight").over(w)
    bounds = weights.where("weight > 0").select(source, (upper - F.col("weight")).cast("double").alias("_lo"), F.when(F.lead(source).over(w).isNull(), F.lit(2.0)).otherwise(upper.cast("double")).alias("_hi"))
    last = F.least(F.floor(F.col("_hi") * buckets), F.lit(buckets - 1))
    stretches = bounds.withColumn("_bucket", F.explode(F.sequence(F.least(F.floor(F.col("_lo") * buckets), last), last)))
    drawn = steps.select(step, unit_interval(seeded_key(seed, F.col(step))).alias("_u")).withColumn("_bucket", F.floor(F.col("_u") * buckets))
    found = drawn.join(maybe_broadcast(stretches, BROADCAST_ROWS), "_bucket")
    return found.where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).select(step, source)


def samples_drawn(drawn: DataFrame, source: str) -> DataFrame:
    """(source, n_drawn): how often each source was drawn."""
    return drawn.groupBy(source).agg(F.count(F.lit(1)).alias("n_drawn"))


def drain(df: DataFrame, source: str, ord: str, weights: DataFrame, seed: int, block: int = 100_000) -> DataFrame:
    """(source, ord, time): the order in which sources drawn by weight, each in its own order, run empty.

    Every row of a source waits an exponential time of the source's weight as
    rate. Sorted by time, each step is a draw among the sources still live with
    their weights renormalised; an empty one just falls out. Sums run per block
    of a source and are carried on by one row per block. Sources without a
    positive weight are never drawn.
    """
    small = maybe_broadcast(weights.where("weight > 0").select(source, F.col("weight").cast("double").alias("_w")), BROADCAST_ROWS)
    wait = -F.log(F.lit(1.0) - unit_interval(seeded_key(seed, F.col(source), F.col(ord)))) / F.col("_w")
    rows = df.select(source, ord).join(small, source).select(source, ord, wait.alias("_wait"), F.floor(F.col(ord) / block).alias("_block"))
    sums = rows.groupBy(source, "_block").agg(F.sum("_wait").alias("_sum"))
    carried = F.sum("_sum").over(Window.partitionBy(source).orderBy("_block")) - F.col("_sum")
    inside = F.sum("_wait").over(Window.partitionBy(source, "_block").orderBy(ord).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(sums.select(source, "_block", carried.alias("_carry")), [source, "_block"]).select(source, ord, (F.col("_carry") + inside).alias("time"))


def replay(df: DataFrame, epochs: int, ord: str, n_rows: int) -> DataFrame:
    """Every row once per epoch, at position epoch * n_rows + ord."""
    ids = F.sequence(F.lit(0), F.lit(epochs - 1))
    return df.withColumn("epoch", F.explode(ids)).withColumn("position", F.col("epoch") * F.lit(n_rows) + F.col(ord))


def next_valid(df: DataFrame, ord: str, valid: str, block: int = 100_000) -> DataFrame:
    """(ord, taken): of each row the next valid one, itself included, the first again after the last.

    Blocks of rows are looked at apart; a block whose tail holds no valid row
    takes the first of the blocks after it. taken is null if no row is valid.
    """
    rows = df.select(F.col(ord).alias("ord"), F.when(F.col(valid), F.col(ord)).alias("v")).withColumn("block", F.floor(F.col("ord") / block))
    heads = rows.where("v is not null").groupBy("block").agg(F.min("v").alias("head"))
    blocks = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).join(heads, "block", "left")
    ahead = Window.orderBy("block")
    after = blocks.select("block", F.coalesce(F.first("head", ignorenulls=True).over(ahead.rowsBetween(1, Window.unboundedFollowing)), F.min("head").over(Window.partitionBy())).alias("after"))
    inside = Window.partitionBy("block").orderBy("ord").rowsBetween(0, Window.unboundedFollowing)
    found = rows.withColumn("here", F.first("v", ignorenulls=True).over(inside)).join(maybe_broadcast(after, BROADCAST_ROWS), "block")
    return found.select("ord", F.coalesce("here", "after").alias("taken"))


def latest(df: DataFrame, keep: int, *order: str) -> DataFrame:
    """The last rows by order: retention of checkpoints."""
    return df.orderBy(*(F.col(c).desc() for c in order)).limit(keep)
