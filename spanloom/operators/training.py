"""Labels, metrics and parameter groups of a training run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config


def shifted_labels(tokens: DataFrame, masked: int) -> DataFrame:
    """tokens (seq, pos, label) with target: the next position's label, the masked token ignored; and before: the previous label. Repeated positions stand in the order of their labels."""
    by = Window.partitionBy("seq").orderBy("pos", "label")
    after = F.lead("label").over(by)
    return tokens.select("seq", "pos", "label", F.when(after == masked, F.lit(config.IGNORE_INDEX)).otherwise(after).alias("target"), F.lag("label").over(by).alias("before"))


def metric_means(metrics: DataFrame, step: str, *names: str) -> DataFrame:
    """Means of the metrics' micro batches for each step."""
    return metrics.groupBy(step).agg(F.count(F.lit(1)).alias("n_micro"), *(F.round(F.avg(n), 6).alias(n) for n in names))


def batch_shape(rows: DataFrame, batch: str, length: str) -> DataFrame:
    """Rows, padded length and tokens of each batch."""
    return rows.groupBy(batch).agg(F.count(F.lit(1)).alias("n_rows"), F.max(length).alias("max_len"), (F.count(F.lit(1)) * F.max(length)).alias("padded_tokens"), F.sum(length).alias("tokens"))


def crop_metrics(crops: DataFrame, batch: str) -> DataFrame:
    """(batch, n_crops, tokens_gen): of each batch's crop grids (t, h, w) their number and the merged tokens of one on average.

    The sum of patches is merged as a whole, and the mean rounded half to even.
    """
    merged = F.floor(F.sum(F.col("t") * F.col("h") * F.col("w")) / config.MERGE**2)
    return crops.groupBy(batch).agg(F.count(F.lit(1)).alias("n_crops"), F.rint(merged / F.count(F.lit(1))).cast("bigint").alias("tokens_gen"))


def max_steps(rows: Column, batch: int, world: int, accumulation: int) -> Column:
    return F.floor(rows / (accumulation * world * batch))


def parameter_group(name: Column, norm: Column, trainable: Column, special: bool = True) -> Column:
    """The optimizer group of a parameter: decay or not, and visual, merger or other; null if it isn't trained."""
    decay = F.when(~norm & ~F.contains(name, F.lit("bias")), F.lit("decay")).otherwise(F.lit("no_decay"))
    part = F.when(F.contains(name, F.lit("merger")), F.lit("merger")).when(F.contains(name, F.lit("visual")), F.lit("visual")).otherwise(F.lit("other")) if special else F.lit("other")
    return F.when(trainable, F.concat_ws("_", part, decay))
