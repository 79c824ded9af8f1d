"""Find evaluation questions that stand, wholly or in part, in training texts.

Every window of consecutive words of an item is represented by seeds: the rarest
of its word n-grams that occur in the corpus, then the rarest that has no word
in common with it, and so on. An edited word spoils only one of them, and a
rarer n-gram of another record's copy doesn't hide an edited one. Texts that
hold a seed are aligned with the item by Smith-Waterman over words, which
scores edited copies as well; the longest run of equal words in the alignment
matrix tells whether a passage was copied word for word. An alignment as good as
that many equal words in a row, or as good as most of the passage, is a leak.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed, spread

#: Words a leaked passage must have, words of a seed, items from which on a sentence is boilerplate.
WINDOW = 12
SEED = 4
SHARED_BY = 10
#: Words of the items that are looked for together.
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of a passage's best score from which on its alignment is a leak, however short the passage.
EDITED_SHARE = 0.6
#: Cells of the alignment matrices that are worked on together.
CELLS = 1 << 19

_WORD = re.compile(r"[^\W_]+")
_FORMAT = frozenset(c for part in (range(0x20000), range(0xE0000, 0xE0080)) for c in map(chr, part) if unicodedata.category(c) == "Cf")
_SENTENCE_END = re.compile(r"[.?!]+")


def fold(text: str) -> str:
    """NFKC, without format characters, lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if not _FORMAT.isdisjoint(text):
            text = "".join(c for c in text if c not in _FORMAT)
    return text.lower()


def words_of(text: str) -> list[str]:
    return _WORD.findall(fold(text))


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences(texts: pd.Series) -> pd.Series:
    """Sentences that hold words, each as its words joined by single blanks."""
    return pd.Series([[s for p in _SENTENCE_END.split(fold(t)) if (s := " ".join(_WORD.findall(p)))] if t else [] for t in texts], dtype="object")


_BASE = np.uint64(0x9E3779B97F4A7C15)
_CODES: dict[str, int] = {}


def word_codes(words: list[str]) -> list[int]:
    if len(_CODES) > 500_000:
        _CODES.clear()
    return [_CODES.get(w) or _CODES.setdefault(w, xxhash.xxh64_intdigest(w) or 1) for w in words]


def batch_grams(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of every word n-gram of a batch of texts; hashes are signed 64-bit integers."""
    codes, sizes = [], []
    for t in texts:
        found = word_codes(words_of(t)) if t else []
        codes += found
        sizes.append(len(found))
    code = np.array(codes, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(code)) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes) if len(code) else np.empty(0, dtype=np.int64)
    count = max(len(code) - n + 1, 0)
    total = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        total = total * _BASE + code[k : k + count]
    whole = owner[:count] == owner[n - 1 :] if count else np.empty(0, dtype=bool)
    hashes = (total ^ (total >> np.uint64(29))).view(np.int64)
    return owner[:count][whole], at[:count][whole], hashes[whole]


def item_passages(items: DataFrame, shared_by: int = SHARED_BY) -> DataFrame:
    """(item_id, passage): the question in stretches of words, parted where a sentence of shared_by or more items stood."""
    parts = items.select("item_id", F.posexplode(sentences("question")).alias("at", "sentence"))
    parts = parts.dropDuplicates(["item_id", "at", "sentence"])
    common = parts.groupBy("sentence").agg(F.count_distinct("item_id").alias("n")).where(F.col("n") >= shared_by)
    kept = parts.join(common, "sentence", "left_anti")
    lists = kept.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "sentence"))).alias("s"))
    joined = F.aggregate(
        "s",
        F.struct(F.lit(-2).alias("at"), F.lit("").alias("text")),
        lambda acc, x: F.struct(x["at"].alias("at"), F.concat(acc["text"], F.when(x["at"] == acc["at"] + 1, F.lit(" ")).otherwise(F.lit("\n")), x["sentence"]).alias("text")),
        lambda acc: F.filter(F.split(acc["text"], "\n"), lambda p: p != ""),
    )
    return lists.select("item_id", F.explode(joined).alias("passage"))


def align_all(pairs: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(Smith-Waterman scores, longest runs of equal words) of pairs (passage, text) of word codes, none of them 0.

    Pairs of like length go through the recurrence together, one passage word
    of all of them at a time.
    """
    scores, runs = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
    order = sorted((i for i, (a, b) in enumerate(pairs) if a and b), key=lambda i: len(pairs[i][1]))
    while order:
        longest = len(pairs[order[-1]][1])
        some = order[-max(1, CELLS // longest) :]
        del order[-len(some) :]
        depth = max(len(pairs[i][0]) for i in some)
        x, y = np.zeros((len(some), depth), dtype=np.uint64), np.ones((len(some), longest), dtype=np.uint64)
        x[:], y[:] = _NO_WORD, _NO_TEXT
        for k, i in enumerate(some):
            a, b = pairs[i]
            x[k, : len(a)], y[k, : len(b)] = a, b
        slope = np.arange(longest + 1, dtype=np.int32) * -GAP
        row, run = np.zeros((len(some), longest + 1), dtype=np.int32), np.zeros((len(some), longest + 1), dtype=np.int32)
        best, most = np.zeros(len(some), dtype=np.int32), np.zeros(len(some), dtype=np.int32)
        step = np.zeros_like(row)
        for k in range(depth):
            same = y == x[:, k, None]
            np.maximum(row[:, :-1] + np.where(same, MATCH, MISMATCH), row[:, 1:] + GAP, out=step[:, 1:])
            np.maximum(step, 0, out=step)
            row = np.maximum(np.maximum.accumulate(step + slope, axis=1) - slope, 0)
            run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            np.maximum(best, row.max(axis=1), out=best)
            np.maximum(most, run.max(axis=1), out=most)
        scores[some], runs[some] = best, most
    return scores, runs


_NO_WORD, _NO_TEXT = np.uint64(0), np.uint64(2**64 - 1)


def align(a: list[str], b: list[str]) -> tuple[int, int]:
    """(Smith-Waterman score, longest run of equal words) of two lists of words."""
    scores, runs = align_all([(word_codes(a), word_codes(b))])
    return int(scores[0]), int(runs[0])


@dataclass
class Seeds:
    """Passages of items, and the n-grams that stand for them: grams in order, holders[i] the passages that grams[i] is a seed of."""

    ids: list[int | None]
    passages: list[list[int]]
    grams: np.ndarray
    holders: list[list[int]]

    @classmethod
    def choose(cls, ids: list[int | None], passages: list[str], counts: dict[int, int], window: int, n: int, edited: bool) -> Seeds:
        """The seeds of every window by the grams' counts in the corpus; without edited one a window, and none of a window that holds a gram that the corpus lacks."""
        owner, _, gram = batch_grams(passages, n)
        holders: dict[int, set[int]] = {}
        for k, own in enumerate(np.split(gram, np.searchsorted(owner, np.arange(1, len(passages)))) if passages else []):
            rated = [(counts.get(g, 0), g, at) for at, g in enumerate(own.tolist())]
            for start in range(len(rated) - (window - n)):
                here = rated[start : start + window - n + 1]
                for _, g, _ in apart(here, n) if edited else [min(here)] if min(here)[0] else []:
                    holders.setdefault(g, set()).add(k)
        order = sorted(holders)
        return cls(ids, [word_codes(p.split(" ")) for p in passages], np.array(order, dtype=np.int64), [sorted(holders[g]) for g in order])


def apart(grams: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """Of a window's grams (count, gram, position) those that occur, by rarity, each that shares no word with one taken before."""
    taken: list[tuple[int, int, int]] = []
    for g in sorted(g for g in grams if g[0]):
        if all(abs(g[2] - t[2]) >= n for t in taken):
            taken.append(g)
    return taken


def _places(grams: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which grams are wanted, their places among the wanted)."""
    if not len(wanted):
        return np.zeros(len(grams), dtype=bool), np.empty(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(wanted, grams), len(wanted) - 1)
    hit = wanted[at] == grams
    return hit, at[hit]


def count_grams(texts: DataFrame, wanted: np.ndarray, n: int) -> dict[int, int]:
    """In how many texts each of the wanted n-grams stands. Only sums leave the workers."""
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), dtype=np.int64)
        for batch in batches:
            owner, _, gram = batch_grams(batch.column(0).to_pylist(), n)
            hit, place = _places(gram, sent.value)
            pairs = np.unique(owner[hit] * np.int64(len(total)) + place)
            total += np.bincount(pairs % max(len(total), 1), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(sent.value[some]), pa.array(total[some])], ["gram", "n"])

    rows = spread(texts.select("text")).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in rows.collect()}


def align_seeded(texts: DataFrame, seeds: Seeds, n: int) -> DataFrame:
    """(tbl, rec_id, item_id, score, run, share) of each text with each passage of which it holds a seed, in one pass over the texts."""
    sent = texts.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        for batch in batches:
            words = batch.column(2).to_pylist()
            owner, _, gram = batch_grams(words, n)
            hit, place = _places(gram, s.grams)
            found = sorted({(t, k) for t, g in zip(owner[hit].tolist(), place.tolist(), strict=True) for k in s.holders[g]})
            text = {t: word_codes(words_of(words[t])) for t in {t for t, _ in found}}
            scores, runs = align_all([(s.passages[k], text[t]) for t, k in found])
            rows = batch.select(["tbl", "rec_id"]).take(pa.array([t for t, _ in found], pa.int64()))
            share = [float(x) / (MATCH * len(s.passages[k])) for x, (_, k) in zip(scores, found, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([s.ids[k] for _, k in found], pa.int64()), pa.array(scores, pa.int64()), pa.array(runs, pa.int64()), pa.array(share, pa.float64())], ["tbl", "rec_id", "item_id", "score", "run", "share"])

    return spread(texts).mapInArrow(run, "tbl string, rec_id bigint, item_id bigint, score bigint, run bigint, share double")


def find_leaks(texts: DataFrame, items: DataFrame, window: int = WINDOW, seed: int = SEED, shared_by: int = SHARED_BY, edited: bool = True, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(tbl, rec_id, item_id, score, run, share): training records that leak an item.

    texts: tbl, rec_id, text (several rows of a record count as one). score is
    the best Smith-Waterman score of the record's texts with the item's
    passages, run the longest run of equal consecutive words, share the score's
    share of what the passage would score whole. Given are the records whose
    score is that of window equal words or more or, with edited, whose share is
    EDITED_SHARE or more; so every record with a run of at least window words
    is among them. Without edited, candidates that can't hold such a run are
    left out.

    The items are the query set: they are sent to the workers in blocks of
    about block_words words, and each block takes two passes over the texts,
    which are never shuffled. Null or empty texts and questions, and items
    shorter than the window, match nothing; null ids are kept as ids; repeated
    rows change nothing; extra columns are ignored; empty tables give an empty
    result.
    """
    passages = item_passages(items.select(F.col("item_id").cast("bigint").alias("item_id"), "question"), shared_by).withColumn("words", F.size(F.split("passage", " ")))
    passages = checkpointed(passages.where(F.col("words") >= window).distinct())
    blocks = max(1, -(-(passages.agg(F.sum("words")).first()[0] or 0) // block_words))
    rows = texts.selectExpr("cast(tbl as string) tbl", "cast(rec_id as bigint) rec_id", "text").where(F.length("text") > 0)
    parts = []
    for k in range(blocks):
        some = passages.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == k).orderBy("item_id", "passage").collect()
        ids, questions = [r.item_id for r in some], [r.passage for r in some]
        counts = count_grams(rows, np.unique(batch_grams(questions, seed)[2]), seed)
        parts.append(align_seeded(rows, Seeds.choose(ids, questions, counts, window, seed, edited), seed))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = found.groupBy("tbl", "rec_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "run", "share")))
    return best.where((F.col("score") >= MATCH * window) | (F.lit(edited) & (F.col("share") >= EDITED_SHARE)))


def training_texts(videos: DataFrame, conversations: DataFrame) -> DataFrame:
    """(tbl, rec_id, text): questions of video records and turns of conversations of any role."""
    first = videos.select(F.lit("video_records").alias("tbl"), "rec_id", F.col("question").alias("text"))
    return first.unionByName(conversations.select(F.lit("conversations").alias("tbl"), F.col("conv_id").alias("rec_id"), "text"))
