"""Token sequences: labels, masks, padding, splitting. Column functions, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


#: A marker, a word or a sign.
RULE_TOKEN = r"<\|[a-z_]+\|>|</?[A-Za-z]+>|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def rule_tokens(text: Column) -> Column:
    """Token ids by a plain rule: markers, words and single signs, each by its hash. A stand-in where no vocabulary is at hand; any Column function of its kind may take its place."""
    words = F.regexp_extract_all(text, F.lit(f"({RULE_TOKEN})"), F.lit(1))
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("bigint"))


def pad_right(ids: Column, size: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value).cast("bigint"), (size - F.size(ids)).cast("int")))


def pad_left(ids: Column, size: Column, value: int) -> Column:
    return F.concat(F.array_repeat(F.lit(value).cast("bigint"), (size - F.size(ids)).cast("int")), ids)


def ignored(n: Column) -> Column:
    """Labels that don't count."""
    return F.array_repeat(F.lit(config.IGNORE_INDEX).cast("bigint"), n.cast("int"))


def labelled(system: Column, prompt: Column, response: Column) -> Column:
    """ids, labels and mask of a turn: only the response is labelled."""
    ids = F.concat(system, prompt, response)
    return F.struct(ids.alias("ids"), F.concat(ignored(F.size(system) + F.size(prompt)), response).alias("labels"), F.array_repeat(F.lit(1).cast("bigint"), F.size(ids)).alias("mask"))


def content_mask(ids: Column, pad: int) -> Column:
    """1 where a token isn't the padding."""
    return F.transform(ids, lambda x: (x != pad).cast("bigint"))


def split_by_lengths(ids: Column, lengths: Column) -> Column:
    """A concatenation cut into pieces of the given lengths."""
    starts = F.transform(lengths, lambda n, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + x))
    return F.transform(F.arrays_zip(starts.alias("s"), lengths.alias("n")), lambda p: F.slice(ids, p["s"].cast("int") + 1, p["n"].cast("int")))


def or_empty(values: Column, kind: str) -> Column:
    """An array, an empty one for null."""
    return F.coalesce(values, F.array().cast(f"array<{kind}>"))


def scalar_or_list(text: Column, kind: str = "string") -> Column:
    """JSON text of a value or of a list of values, as a list."""
    return F.coalesce(F.from_json(text, f"array<{kind}>"), F.when(~text.rlike(r"^\s*\["), F.array(F.regexp_replace(text, r'^\s*"|"\s*$', "").cast(kind))))


def chunk(ordinal: Column, size: int) -> Column:
    return F.floor(ordinal / size)


def chunk_count(rows: Column, size: int) -> Column:
    return F.floor((rows + size - 1) / size)


def shard(ordinal: Column, n: int) -> Column:
    """Round robin."""
    return F.pmod(ordinal, F.lit(n))


def compact_images(*columns: Column) -> Column:
    return F.array_compact(F.array(*columns))


def lookup_or(mapping: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(mapping, key), default)
