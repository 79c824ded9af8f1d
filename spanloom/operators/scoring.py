"""Score predictions: accuracy overall and per category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import gold_letter, predicted_letter


def accuracy(correct: Column, total: Column) -> Column:
    """correct / total, 0.0 of nothing."""
    return F.when(total > 0, correct / total).otherwise(F.lit(0.0))


def judged(predictions: DataFrame) -> DataFrame:
    """Predictions (id, prediction array, label, category) with their letters and whether they agree.

    Only the first prediction counts; an empty or null list, or text without a
    letter, is wrong. A null category is "overall".
    """
    letter = predicted_letter(F.get("prediction", F.lit(0)))
    gold = gold_letter(F.col("label").cast("string"))
    return predictions.select("id", F.coalesce("category", F.lit("overall")).alias("category"), letter.alias("letter"), gold.alias("gold"), F.coalesce(letter == gold, F.lit(False)).alias("is_correct"))


def score(predictions: DataFrame) -> DataFrame:
    """(category, total, correct, accuracy)."""
    counted = judged(predictions).groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("is_correct").cast("bigint")).alias("correct"))
    return counted.select("category", "total", "correct", F.round(accuracy(F.col("correct"), F.col("total")), 6).alias("accuracy"))


def score_with_total(predictions: DataFrame) -> DataFrame:
    """As score, with the overall row (category null) from the same pass."""
    counted = judged(predictions).rollup("category").agg(F.grouping("category").cast("int").alias("is_overall"), F.count(F.lit(1)).alias("total"), F.sum(F.col("is_correct").cast("bigint")).alias("correct"))
    return counted.select("category", "is_overall", "total", "correct", F.round(accuracy(F.col("correct"), F.col("total")), 6).alias("accuracy"))


def summary(predictions: DataFrame, benchmark: str, steps: int) -> DataFrame:
    """One row: benchmark, steps, correct, total, accuracy and the counts by category."""
    by = score(predictions)
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.struct("correct", "total")))))
    one = by.agg(F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), pairs.alias("by_category"))
    return one.select(F.lit(benchmark).alias("benchmark"), F.lit(steps).alias("steps"), "correct", "total", accuracy(F.col("correct"), F.col("total")).alias("accuracy"), "by_category")


def report(scores: DataFrame) -> DataFrame:
    """Lines of a printed report, percent with two decimals."""
    return scores.select("category", F.format_string("Category: %s - Accuracy: %d/%d = %.2f", "category", "correct", "total", F.col("accuracy") * 100).alias("line"))
