"""Vector arithmetic of the data plane: alignment loss, column means, feature scatter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def alignment_loss(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """1 - mean cosine of rows, by group."""
    return pairs.groupBy(*by).agg((1 - F.avg(cosine(F.col(a), F.col(b)))).alias("loss"), F.count(F.lit(1)).alias("n_rows"))


def combined_loss(ce: Column, align: Column, weight: float) -> Column:
    return ce + F.lit(weight) * align if weight > 0 else ce


def column_means(rows: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """(by, pos, mean): means over rows for each position."""
    flat = rows.select(*by, F.posexplode(vector).alias("pos", "x"))
    return flat.groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def scatter(tokens: DataFrame, features: DataFrame, placeholder: int) -> DataFrame:
    """(seq, pos, feature): the n-th feature of a sequence on its n-th placeholder; unequal numbers raise.

    tokens: seq, pos, token; features: seq, n (from 1), feature.
    """
    slots = tokens.where(F.col("token") == placeholder).withColumn("n", F.row_number().over(Window.partitionBy("seq").orderBy("pos")))
    both = slots.join(features, ["seq", "n"], "full")
    wrong = F.col("pos").isNull() | F.col("feature").isNull()
    checked = F.when(wrong, F.raise_error(F.lit("placeholders and features differ in number"))).otherwise(F.col("feature"))
    return both.select("seq", "pos", checked.alias("feature"))
