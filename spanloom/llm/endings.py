"""How the words of a corpus of replies stand: at sentence ends, before other words, at the end of a reply.

One pass counts every word and those word pairs and triples that are asked for.
Each batch is turned into word codes and counted by sorting, so that a few
thousand sums leave Python instead of a row for every word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import maybe_broadcast, spread

BROADCAST_ROWS = 1_000_000

_WIDE = "぀-ヿ㐀-鿿豈-﫿"
TOKEN = re.compile(rf"[{_WIDE}]|[^\W_{_WIDE}]+")
_ASCII_TOKEN = re.compile(r"[A-Za-z0-9]+")
_ASCII_MARKED_TOKEN = re.compile(r"[A-Za-z0-9]+|[.!?]+")
_MARKED_TOKEN = re.compile(rf"[{_WIDE}]|[^\W_{_WIDE}]+|[.!?。！？…]+")
#: Format characters, which part no words.
_FORMAT = regex.compile(r"\p{Cf}+")
_END, _DOTS, _REPLY = 0, 1, 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CODES: dict[str, int] = {}


def folded(text: str) -> str:
    """NFKC, without format characters."""
    return text if text.isascii() else _FORMAT.sub("", unicodedata.normalize("NFKC", text))


def find_tokens(text: str) -> list[str]:
    """The words of a text, single characters of scripts written without blanks."""
    return (_ASCII_TOKEN if text.isascii() else TOKEN).findall(text)


def code(word: str) -> int:
    """A word's code; the lowest numbers mark ends."""
    found = _CODES.get(word)
    if found is None:
        if len(_CODES) > 500_000:
            _CODES.clear()
        found = _CODES[word] = max(xxhash.xxh64_intdigest(word), 3)
    return found


def gram_code(words: list[str]) -> int:
    """The code of one to three words in order, as a signed integer."""
    total = 0
    for w in words:
        total = total * int(_BASE) + code(w)
    return _signed(total)


def tail_codes(words: list[str]) -> tuple[int, int | None, int | None, int | None]:
    """The codes of the last word, of the one before it, of both, and of the last three; None for what there are too few words for."""
    *before, last = map(code, words)
    if not before:
        return _signed(last), None, None, None
    base = int(_BASE)
    two = before[-1] * base + last
    three = _signed(before[-2] * base * base + two) if len(before) > 1 else None
    return _signed(last), _signed(before[-1]), _signed(two), three


def _signed(number: int) -> int:
    number &= 0xFFFFFFFFFFFFFFFF
    return number - (1 << 64) if number >> 63 else number


def _codes(reply: str) -> list[int]:
    out = []
    text = folded(reply)
    for w in (_ASCII_MARKED_TOKEN if text.isascii() else _MARKED_TOKEN).findall(text):
        if w[0] in ".!?。！？…":
            out.append(_DOTS if w.startswith("..") or "…" in w else _END)
        else:
            out.append(code(w.lower()))
    return out


COUNTS = "h bigint, word string, n bigint, ends bigint, goes_on bigint, last bigint"
_ARROW = pa.schema([("h", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("ends", pa.int64()), ("goes_on", pa.int64()), ("last", pa.int64())])


def count_codes(replies: list[list[int]]) -> list[tuple[np.ndarray, ...]]:
    """(code, n, ends, goes_on, last) of the words, the pairs and the triples of replies given as codes."""
    flat = np.fromiter((c for r in replies for c in (*r, _REPLY)), dtype=np.uint64)
    if not len(flat):
        return []
    is_word = flat > _REPLY
    after = np.append(flat[1:], np.uint64(_REPLY))
    reply = np.cumsum(flat == _REPLY)
    at = np.flatnonzero(is_word)
    last = np.zeros(len(flat), dtype=bool)
    if len(at):
        last[at] = np.append(reply[at[1:]] != reply[at[:-1]], True)
    out = []
    gram, whole = flat, is_word
    for n in (1, 2, 3):
        if n > 1:
            gram = np.append(np.uint64(0), gram[:-1]) * _BASE + flat
            whole = is_word & np.append(False, whole[:-1])
        place = np.flatnonzero(whole)
        if not len(place):
            break
        keys, inverse = np.unique(gram[place], return_inverse=True)
        sums = [np.bincount(inverse, weights=w, minlength=len(keys)).astype(np.int64) for w in (after[place] == _END, after[place] > _REPLY, last[place])]
        out.append((keys.view(np.int64), np.bincount(inverse, minlength=len(keys)), *sums))
    return out


def _count_batches(batches: Iterator[pa.RecordBatch], prepare: Callable[[str], str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _CODES.clear()
        found = count_codes([_codes(prepare(r)) for r in batch.column(0).to_pylist() if r])
        names = {c - (1 << 64) if c >> 63 else c: w for w, c in _CODES.items()}
        for n, (keys, *sums) in enumerate(found, 1):
            words = [names.get(k) for k in keys.tolist()] if n == 1 else [None] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(words, pa.string()), *map(pa.array, sums)], schema=_ARROW)


def count_endings(replies: DataFrame, prepare: Callable[[str], str], wanted: DataFrame) -> DataFrame:
    """(h, word, n, ends, goes_on, last) of every word, and of those wanted codes (h) that stand for pairs or triples.

    n counts occurrences, ends those before a sentence's end (an ellipsis is
    none), goes_on those before another word, last those that are the last word
    of a reply, each reply as prepare leaves it. word is null for pairs and
    triples.
    """
    rows = spread(replies.where(F.length("reply") > 0).select("reply"))
    counted = rows.mapInArrow(lambda batches: _count_batches(batches, prepare), COUNTS)
    marked = maybe_broadcast(wanted.select("h", F.lit(True).alias("wanted")), BROADCAST_ROWS)
    kept = counted.join(marked, "h", "left").where("word is not null or wanted")
    return kept.groupBy("h").agg(F.max("word").alias("word"), *(F.sum(c).alias(c) for c in ("n", "ends", "goes_on", "last")))


def longest_rivals(words: DataFrame, rare: DataFrame) -> DataFrame:
    """(g1, longer): of each rare word g1, how often the most frequent longer word that begins with it occurs.

    words: word, n. Only prefixes as long as some rare word are looked at.
    """
    lengths = rare.agg(F.collect_set(F.length("g1")).alias("lengths"))
    size = F.length("word")
    parts = words.join(F.broadcast(lengths)).select("n", F.col("word"), F.explode(F.filter("lengths", lambda k: k < size)).alias("k"))
    parts = parts.groupBy(F.substring("word", F.lit(1), F.col("k")).alias("g1")).agg(F.max("n").alias("longer"))
    return parts.join(maybe_broadcast(rare, BROADCAST_ROWS), "g1")
