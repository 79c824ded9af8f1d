"""Decoding automata: the forced reflection window, and the constrained answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def forced_tokens(tokens: Column, start: int, token: int, end: int, steps: int) -> Column:
    """A token sequence with the window forced in after each start: steps tokens, then the end.

    Folds the sequence with a state of mode and tokens left: the model's own
    tokens pass outside the window.
    """
    out = F.array().cast("array<bigint>")
    window = F.concat(F.array_repeat(F.lit(token).cast("bigint"), steps), F.array(F.lit(end).cast("bigint")))
    return F.aggregate(tokens, out, lambda acc, t: F.when(t == start, F.concat(acc, F.array(t.cast("bigint")), window)).otherwise(F.concat(acc, F.array(t.cast("bigint")))))


def allowed_tokens(generated: Column, start: int, token: int, end: int, prefix: list[int], letters: list[int], stop: int) -> Column:
    """The tokens that may follow what has been generated: start, window, answer prefix, a letter, stop."""
    longs = lambda xs: F.array(*(F.lit(x).cast("bigint") for x in xs))
    last_end = F.size(generated) - F.array_position(F.reverse(generated), F.lit(end).cast("bigint")).cast("int")
    k = F.size(generated) - last_end - 1
    return (
        F.when(F.size(generated) == 0, longs([start]))
        .when(~F.array_contains(generated, F.lit(end).cast("bigint")), longs([token]))
        .when(k < len(prefix), F.array(F.get(longs(prefix), k)))
        .when(k == len(prefix), longs(letters[:26]))
        .otherwise(longs([stop]))
    )


def suppressed_ids(configured: Column, looked_up: Column, unknown: int) -> Column:
    """The configured ids, or else those looked up, without nulls and the unknown token."""
    known = F.filter(F.array_compact(looked_up), lambda x: x != unknown)
    return F.when(F.size(F.array_compact(configured)) > 0, F.array_compact(configured)).otherwise(known)
