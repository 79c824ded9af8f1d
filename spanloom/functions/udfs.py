"""Extension points: a predictor over batches, and a table function over archives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

from ..sources.files import archive_members


def predict(prompts: DataFrame, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """(id, prediction array): a model's answers to (id, prompt), batch by batch.

    A batch that fails is asked again row by row, so that only the rows that
    fail themselves get empty answers.
    """

    def ask(said: pd.Series) -> list[str]:
        try:
            return [x or "" for x in model(said)]
        except Exception:
            return [y for i in range(len(said)) for y in ask(said.iloc[i : i + 1])] if len(said) > 1 else [""] * len(said)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "prediction": [[x] for x in ask(batch["prompt"])]})

    return prompts.select("id", "prompt").mapInPandas(run, "id string, prediction array<string>")


def guarded(rows: DataFrame, step: Callable[[str], str | None], skip: tuple[type[Exception], ...] = (ValueError, OSError)) -> DataFrame:
    """(id, value, error) of a step over (id, value): the error's kind where a row fails in one of the ways to skip; other failures end the query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values: list[str | None] = []
            errors: list[str | None] = []
            for value in batch["value"]:
                try:
                    values.append(step(value))
                    errors.append(None)
                except skip as e:
                    values.append(None)
                    errors.append(next(k.__name__ for k in skip if isinstance(e, k)))
            yield pd.DataFrame({"id": batch["id"], "value": pd.Series(values, dtype="object"), "error": pd.Series(errors, dtype="object")})

    return rows.select("id", "value").mapInPandas(run, "id string, value string, error string")


class ArchiveIndex:
    """The members of a zip archive. Register with register_archive_index."""

    def eval(self, path: str) -> Iterator[tuple[str, int]]:
        for _, member in archive_members(path):
            yield member.filename, member.file_size


def register_archive_index(spark: object) -> object:
    function = udtf(ArchiveIndex, returnType="name string, size bigint")
    spark.udtf.register("archive_index", function)
    return function
