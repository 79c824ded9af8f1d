"""Sinks: predictions, metrics, checkpoints kept."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from textwrap import indent

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import summary
from ..sources.files import write_text


def result_folder(out: str, benchmark: str, checkpoint: str) -> str:
    """Folder of a run: the benchmark in capitals, then the checkpoint's last segment."""
    return os.path.join(out, benchmark.upper(), checkpoint.rstrip("/").split("/")[-1])


def write_predictions(predictions: DataFrame, folder: str, steps: int) -> str:
    """Rows as JSON lines in parts, overwriting; _SUCCESS marks a whole result."""
    path = os.path.join(folder, f"steps{steps:03d}.json")
    predictions.write.mode("overwrite").json(path)
    return path


def write_prediction_array(predictions: DataFrame, folder: str, steps: int) -> str:
    """Rows as one indented JSON array in one file, overwriting: the layout of small results. Rows stream through the driver, one partition at a time."""
    spark = predictions.sparkSession

    def parts() -> Iterator[str]:
        yield "["
        for n, row in enumerate(predictions.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("v")).toLocalIterator()):
            yield ("," if n else "") + "\n" + indent(json.dumps(json.loads(row.v), indent=2, ensure_ascii=False), "  ")
        yield "\n]\n"

    return write_text(spark, os.path.join(folder, f"steps{steps:03d}.json"), parts())


def write_metrics(predictions: DataFrame, folder: str, benchmark: str, steps: int) -> str:
    """One JSON object with counts and accuracy, overall and by category: a row, whatever the data. Written to the folder's own file system."""
    row = summary(predictions, benchmark, steps).select(F.to_json(F.struct("*")).alias("value")).first()
    path = os.path.join(folder, f"steps{steps:03d}.metrics.json")
    return write_text(predictions.sparkSession, path, iter([json.dumps(json.loads(row[0]), indent=2)]))
