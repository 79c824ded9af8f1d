"""Encode texts with a public byte-level BPE vocabulary by prefix dynamic programming.

For every prefix of a byte string the encoding ends in one token, and that last
token is unique: of the vocabulary's tokens that end the prefix, it is the one
that BPE would leave unmerged beside the last token of what lies before it. The
table of last tokens therefore grows byte by byte, gives the encoding of every
prefix by walking back, takes appended bytes without looking at the start
again, and after an edit needs new entries only until they agree with the old
ones over the length of the longest token.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: White space of the Unicode standard, and the pattern that splits a text before the merges.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

#: Words up to this many characters are remembered, and so many of them, in each Python worker.
REMEMBERED_LENGTH = 48
REMEMBERED_WORDS = 200_000
#: Rows of a result batch.
BATCH_ROWS = 512


class PrefixTable:
    """The last token of every prefix of a byte string; grows and changes in place."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; earlier entries stay as they are."""
        start = len(self.data)
        self.data += more
        self._fill(start, len(self.data), None, 0)

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace data[start:stop]; returns how many entries were computed anew."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start]
        return self._fill(start, len(self.data), old, shift, settled_from=start + len(new))

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first end bytes, by default of all."""
        at, found, sizes = len(self.data) if end is None else end, [], self.vocabulary.sizes
        while at:
            token = self.last[at - 1]
            found.append(token)
            at -= sizes[token]
        found.reverse()
        return found

    def _fill(self, start: int, stop: int, old: list[int] | None, shift: int, settled_from: int = 0) -> int:
        voc, last = self.vocabulary, self.last
        sizes, stands, longest = voc.sizes, voc.stands_beside, voc.longest
        base = max(0, start - longest)
        ending: list[list[int]] = [[] for _ in range(start, stop)]
        agreed = 0
        matches = voc.automaton.iter(self.data[base:stop].decode("latin-1"))
        pending = next(matches, None)
        for at in range(start, stop):
            here = ending[at - start]
            while pending is not None and pending[0] + base <= at:
                if pending[0] + base == at:
                    here.append(pending[1])
                pending = next(matches, None)
            for token in here:  # the longest first
                before = at + 1 - sizes[token]
                if not before or stands(last[before - 1], token):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            if old is not None and at >= settled_from:
                agreed = agreed + 1 if old[at - shift] == last[at] else 0
                if agreed > longest:
                    last.extend(old[at - shift + 1 :])
                    return at + 1 - start
        return stop - start


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.pieces: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.sizes = {i: len(t) for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.parts: dict[int, tuple[int, int]] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        """From lines of a base64 token and its rank."""
        pairs = (line.split() for line in data.splitlines() if line.strip())
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens that the merge named token joins; a single byte gives itself twice."""
        found = self.parts.get(token)
        if found is None:
            piece, found = self.pieces[token], (token, token)
            for cut in range(1, len(piece)):
                left, right = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if left is not None and right is not None and max(left, right) < token and self._apart(left, right, token):
                    found = left, right
                    break
            self.parts[token] = found
        return found

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge ranked below limit crosses the border of left and right while both are built up."""
        pieces, ranks = self.pieces, self.ranks
        while True:
            joined = ranks.get(pieces[left] + pieces[right])
            if joined is not None and joined < limit:
                return False
            undo_left = self.sizes[left] > 1 and (left > right or self.sizes[right] == 1)
            if undo_left:  # the later of the two merges is undone first; ties across the border go to the left
                limit = min(limit, left)
                left = self.halves(left)[1]
            elif self.sizes[right] > 1:
                limit = min(limit, right + 1)
                right = self.halves(right)[0]
            else:
                return True

    def stands_beside(self, left: int, right: int) -> bool:
        """Whether BPE leaves left and right unmerged beside each other."""
        key = left, right
        found = self.beside.get(key)
        if found is None:
            if len(self.beside) >= 1_000_000:
                self.beside.clear()
            found = self.beside[key] = self._apart(left, right, 1 << 60)
        return found

    def encode_word(self, word: str) -> list[int]:
        """The tokens of one piece of the split text."""
        data = word.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        return [whole] if whole is not None else PrefixTable(self, data).tokens()

    def encode(self, text: str) -> list[int]:
        """The tokens of a text; strings that look like special tokens are ordinary text."""
        words, flat = self.words, []
        for word in split_text(text):
            ids = words.get(word)
            if ids is None:
                ids = self.encode_word(word)
                if len(word) <= REMEMBERED_LENGTH:
                    if len(words) >= REMEMBERED_WORDS:
                        words.clear()
                    words[word] = ids
            flat.extend(ids)
        return flat

    def count(self, text: str) -> int:
        return len(self.encode(text))


_ASCII = re.compile(ASCII_PATTERN)
_ANY = regex.compile(PATTERN)


def split_text(text: str) -> list[str]:
    return (_ASCII if text.isascii() else _ANY).findall(text)


class GrowingText:
    """Token ids of a text that takes appends; only its last three words are split again."""

    def __init__(self, vocabulary: Vocabulary, text: str = "") -> None:
        self.vocabulary = vocabulary
        self.words: list[str] = []
        self.ids: list[list[int]] = []
        self.append(text)

    def append(self, more: str) -> None:
        tail = "".join(self.words[-3:]) + more
        del self.words[-3:], self.ids[-3:]
        words = split_text(tail)
        self.words += words
        self.ids += map(self.vocabulary.encode_word, words)

    def tokens(self) -> list[int]:
        return [i for ids in self.ids for i in ids]


def read_vocabulary(path: str) -> bytes:
    """The bytes of a vocabulary file, read by the driver alone."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def vocabulary(data: bytes) -> Vocabulary:
    """Parsed once in each Python worker."""
    return Vocabulary.parse(data)


def _encode_batches(batches: Iterator[pa.RecordBatch], voc: Vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(start, BATCH_ROWS)
            flat: list[int] = []
            ends = np.zeros(part.num_rows + 1, dtype=np.int32)
            for i, text in enumerate(part.column(1).to_pylist()):
                if text:
                    flat += voc.encode(text)
                ends[i + 1] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])


def _count_batches(batches: Iterator[pa.RecordBatch], voc: Vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [voc.count(text) if text else 0 for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])


def _run(documents: DataFrame, path: str, step: Callable, schema: str) -> DataFrame:
    """A step over the batches of (doc_id, text), the vocabulary sent along as a broadcast of its file, some hundred kilobytes."""
    rows = spread(documents.selectExpr("cast(doc_id as bigint) doc_id", "text"))
    sent = documents.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    return rows.mapInArrow(lambda batches: step(batches, vocabulary(sent.value)), schema)


def encode_texts(documents: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, ids) for every row: the ids of text, an empty list for an empty or null text.

    One pass without a shuffle. Repeated rows come out as often as they came
    in; a null doc_id stays null; other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    return _run(documents, path, _encode_batches, "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for every row, by the rules of encode_texts."""
    return _run(documents, path, _count_batches, "doc_id bigint, n_tokens bigint")
