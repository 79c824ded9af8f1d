"""Find pages of keywords, links, menus or product tags by the shapes of their lines.

Links are masked first, so that their dots end no sentence. Each line is cut
into pieces at sentence ends and list separators, and every piece is reduced to
a shape: its number of words, its capitals, its digits, its separator and its
links. Pieces that read as sentences, code or data are prose; of the rest, the
few shapes that recur in a page are its listing. A page is flagged when its
listing takes more than half of its characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import spread
from .endings import folded

#: Share of the characters that a page's listing must exceed; entries that make a list, and links that make one.
SHARE = 0.5
LEAST_PIECES = 7
LEAST_LINKS = 3
LEAST_GAPS = 8
#: Pieces that a page must list for each of the shapes they are of: listings are of few shapes.
PIECES_A_SHAPE = 2
#: Most words of a listed piece, and words from which on a piece without punctuation may be a run of keywords.
PIECE_WORDS = 6
RUN_WORDS = 10
#: Share of a run's words that must stand in word pairs seen before in the page.
RUN_REPEATED = 0.5
#: Share of a sentence's words that a phrase repeated in it must take; share of different words that rules it out.
REPEATED_PHRASE = 0.45
FRESH_WORDS = 0.8

_ANCHOR = re.compile(r"(?P<open><a\b[^<>]*+>)|</a\s*+>", re.IGNORECASE)
_BRACKET = re.compile(r"[\[\n]|\]\(?")
_TARGET = re.compile(r"(?:[^()\s]++|\([^()\s]*+\))*+(?:[ \t]++\"[^\"\n]*+\")?\)")
_ADDRESS = re.compile(r"(?:https?://|www\.)[^\s<>\"'|，、；]++|(?<![\w.+\-])[\w.+\-]++@[\w\-]++(?:\.[\w\-]++)++", re.IGNORECASE)
_MARK = "\ue000"
_MARKUP = re.compile(r"<[/|]?[A-Za-z_][\w|\-]*/?>")
_BREAK = re.compile(r"\r\n|[\n\r\v\f\x85\u2028\u2029]|<br\s*/?>|</?(?:p|li|ul|ol|div|td|tr)\s*>", re.IGNORECASE)
_ENDS = re.compile(r"[.!?…][\"'”’»)\]]?\s+|[。！？]")
_CLOSING = frozenset(".!?…。！？\"'”’»)]")
_TERMINAL = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s*\Z")
_SEPARATOR = regex.compile(r"\s*(?:[^\p{L}\p{M}\p{N}\s'’\-.%&+()_:\"“”$€£@!?]+|\s[-–—:]+\s)\s*")
_GAPS = re.compile(r"\t+| {2,}")
_SCRIPT = regex.compile(r"(?P<l>\p{Latin})|(?P<w>[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}])|(?P<c>\p{Cyrillic})|(?P<g>\p{Greek})|(?P<a>\p{Arabic})|(?P<h>\p{Hebrew})|(?P<x>\p{L})")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}" + _MARK + r"]+(?:['’\-.][\p{L}\p{M}\p{N}]+)*")
_ASCII_WORD = re.compile(r"[A-Za-z0-9]+(?:['\-.][A-Za-z0-9]+)*")
_MAY_LINK = ("://", "www.", "](", "<a", "<A", "@", "WWW.", "Www.")
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}]")
_CODE = re.compile(r"^\s*(?:[\[\]{}]+,?|```.*|\"[^\"]*\"\s*:.*|[{\[](?:[^\"]*\".*|[\d\s.,eE+\-\[\]]*)[}\]],?)\s*$")


def _anchors(text: str) -> Iterator[tuple[int, int]]:
    """Spans of <a ...>...</a>, whatever tags and however much text they hold."""
    start = None
    for found in _ANCHOR.finditer(text):
        if found["open"]:
            start = found.start()
        elif start is not None:
            yield start, found.end()
            start = None


def _labels(text: str) -> Iterator[tuple[int, int]]:
    """Spans of [label](target) and ![label](target); one may be the label of another."""
    begun: list[int] = []
    for found in _BRACKET.finditer(text):
        mark = found[0]
        if mark == "[":
            begun.append(found.start())
        elif mark == "\n":
            begun.clear()
        elif begun:
            start = begun.pop()
            if mark == "](" and (target := _TARGET.match(text, found.end())):
                yield start - (text[start - 1 : start] == "!"), target.end()


def masked(text: str) -> tuple[str, list[str]]:
    """A text with a mark for each link, and the links. Time grows with the text alone."""
    text = text.replace(_MARK, "")
    if not any(x in text for x in _MAY_LINK):
        return text, []
    spans = list(_anchors(text)) if "</a" in text or "</A" in text else []
    if "](" in text:
        spans += _labels(text)
    spans += (m.span() for m in _ADDRESS.finditer(text))
    spans.sort(key=lambda s: (s[0], -s[1]))
    parts, links, at = [], [], 0
    for start, end in spans:
        if start >= at:
            parts.append(text[at:start])
            links.append(text[start:end])
            at = end
    parts.append(text[at:])
    return f" {_MARK} ".join(parts), links


def _size(piece: str) -> int:
    return len("".join(piece.split()))


def _words(piece: str) -> list[str]:
    return (_ASCII_WORD if piece.isascii() else _WORD).findall(piece)


def _units(piece: str) -> list[str]:
    """What phrases are made of: words, or the single characters of scripts written without blanks."""
    wide = _WIDE.findall(piece) if not piece.isascii() else []
    return wide if len(wide) * 2 > _size(piece) else [w.casefold() for w in _words(piece)]


def _sentences(line: str) -> list[str]:
    """A line cut after its sentence ends."""
    out, at = [], 0
    for found in _ENDS.finditer(line):
        out.append(line[at : found.end()])
        at = found.end()
    out.append(line[at:])
    return out


def _is_sentence(piece: str, parts: list[str]) -> bool:
    """Whether a piece, also given cut at blanks, ends like a sentence and isn't a list with a full stop."""
    if not parts or parts[-1][-1] not in _CLOSING or not _TERMINAL.search(piece):
        return False
    if piece.isascii():
        if len(parts) < 4:
            return False
        if piece.count(",") + piece.count(";") + piece.count("|") + piece.count("/") < 4:
            return True
    elif len(_words(piece)) < 4 and len(_WIDE.findall(piece)) < 6:
        return False
    cells = [c for c in _SEPARATOR.split(piece) if c]
    return len(cells) < 5 or sum(max(len(_words(c)), len(_WIDE.findall(c)) / 2) for c in cells) / len(cells) > 3


def _is_fresh(piece: str, parts: list[str]) -> bool:
    """Whether the words between a sentence's blanks differ so much that no phrase of it can recur; a quick look at most sentences."""
    return piece.isascii() and len({p.lower() for p in parts}) > len(parts) * FRESH_WORDS


def _repeats_itself(units: list[str], times: int = 2) -> bool:
    """Whether phrases, used so many times or more, make up most of a sentence."""
    if len(set(units)) > len(units) * FRESH_WORDS:
        return False
    pairs = Counter(zip(units, units[1:], strict=False))
    covered = {i + k for i, p in enumerate(zip(units, units[1:], strict=False)) if pairs[p] >= times for k in (0, 1)}
    return len(covered) >= REPEATED_PHRASE * len(units)


def _cells(piece: str) -> list[str]:
    """A piece cut at separators; at wide gaps, or at blanks of a script written without them, if that gives a list."""
    cells = [c for c in _SEPARATOR.split(piece) if c and not c.isspace()]
    if len(cells) < 3:
        gaps = [c for c in _GAPS.split(piece.strip()) if c]
        if len(gaps) >= LEAST_GAPS:
            return gaps
        blanks = piece.split()
        if len(blanks) >= LEAST_GAPS and sum(bool(_WIDE.match(b)) for b in blanks) * 2 > len(blanks):
            return blanks
    return cells


def shape(piece: str, separator: str) -> str:
    """Word count, capitals, digits, separator class and links of a piece."""
    words = _words(piece)
    wide = len(_WIDE.findall(piece))
    count = min(len(words), PIECE_WORDS) if wide < 2 else 2
    capitals = "".join(sorted({"A" if w.isupper() and len(w) > 1 else "a" if w[:1].islower() else "T" if w[:1].isupper() else "" for w in words})) if not wide else "w"
    script = _SCRIPT.search(piece)
    return f"{script.lastgroup if script else '-'}{count}{capitals}{'9' if any(c.isdigit() for c in piece) else ''}{separator}{'@' if _MARK in piece else ''}"


def _bigrams(units: list[str]) -> list[tuple[str, str]]:
    return list(zip(units, units[1:], strict=False))


def listing_share(text: str) -> tuple[float, int, int, int]:
    """(share of characters in the listing, number of its pieces, of its shapes, of its links) of one page."""
    text = folded(text)
    plain, links = masked(text)
    link_sizes = iter([_size(x) for x in links])
    total = 0  # characters, markup of single words and listing alike
    pieces: list[tuple[str, int]] = []  # shape, characters
    runs: list[tuple[list[str], int]] = []
    stuffed: list[tuple[list[str], int]] = []
    sentences: list[tuple[str, int]] = []
    code = False
    for line in _BREAK.split(plain):
        if not line.strip():
            continue
        if "<" in line:
            bare = _MARKUP.sub(" ", line)
            total += _size(line) - _size(bare)
            line = bare
        if line.lstrip().startswith("```"):
            code = not code
        if code or _CODE.match(line):
            total += _size(line) - line.count(_MARK) + sum(next(link_sizes) for _ in range(line.count(_MARK)))
            continue
        for piece in _sentences(line):
            n_links = piece.count(_MARK) if links else 0
            parts = piece.split()
            size = sum(map(len, parts))
            if n_links:
                size += sum(next(link_sizes) for _ in range(n_links)) - n_links
            total += size
            if not size:
                continue
            if not n_links and _is_sentence(piece, parts):
                if not _is_fresh(piece, parts) and _repeats_itself(units := _units(piece)):
                    stuffed.append((units, size))
                else:
                    sentences.append((piece, size))
                continue
            words = _words(piece)
            own = [w for w in words if w != _MARK]
            if n_links and len(own) <= PIECE_WORDS * n_links:
                pieces += [(f"{min(len(own) // n_links, PIECE_WORDS)}@", size // n_links)] * n_links
                continue
            if n_links and _is_sentence(piece, parts):
                continue
            cells = _cells(piece)
            counts = [max(len(_words(c)), (len(_WIDE.findall(c)) + 1) // 2 if _WIDE.search(c) else 0) for c in cells]
            short = [n <= PIECE_WORDS for n in counts]
            if len(cells) == 1 and counts[0] > PIECE_WORDS or sum(short) * 2 < len(cells):
                runs.append(([u for u in _units(piece) if u != _MARK], size))
                continue
            listed = sum(map(_size, cells)) or 1
            for c, fits in zip(cells, short, strict=True):
                if fits and _SCRIPT.search(c):
                    pieces.append((shape(c, "s" if len(cells) > 2 else "l"), size * _size(c) // listed))
    if not total:
        return 0.0, 0, 0, 0
    recurring = Counter(s for s, _ in pieces)
    linked = sum(n for s, n in recurring.items() if "@" in s)
    top = {s for s, n in recurring.items() if n > 1 or "@" in s and linked > 1}
    listed_size = sum(n for s, n in pieces if s in top)
    count = sum(recurring[s] for s in top)
    seen = Counter(b for units, _ in runs for b in _bigrams(units))
    for units, size in runs:
        pairs = _bigrams(units)
        if len(units) >= RUN_WORDS and _one_script(units) and sum(seen[b] > 1 for b in pairs) >= RUN_REPEATED * len(pairs):
            listed_size += size
            count += len(units) // 3
            top.add("run")
    if len(stuffed) == 1 and not _repeats_itself(stuffed[0][0], 3):
        stuffed = []  # said twice, once in the page
    if stuffed:
        phrases = Counter(p for units, _ in stuffed for p in set(_bigrams(units)))
        common = {p for p, n in phrases.items() if n * 2 >= len(stuffed)} if len(stuffed) > 1 else set()
        like = [(units, n) for piece, n in sentences if _mostly(units := _units(piece), common)]
        for units, size in stuffed + like:
            listed_size += size
            count += len(units) // 3  # a phrase has two or three words
        top.add("phrase")
    return listed_size / total, count, len(top), linked


def _one_script(words: list[str]) -> bool:
    """Whether nine words in ten are of the same script; scraps of many scripts are no keywords."""
    scripts = Counter(m.lastgroup for w in words if (m := _SCRIPT.search(w)))
    return bool(scripts) and max(scripts.values()) * 10 >= 9 * sum(scripts.values())


def _mostly(words: list[str], pairs: set[tuple[str, str]]) -> bool:
    """Whether the pairs cover most of the words."""
    covered = {i + k for i, p in enumerate(_bigrams(words)) if p in pairs for k in (0, 1)}
    return len(covered) >= REPEATED_PHRASE * len(words)


SHARES = "doc_id bigint, share double, pieces int, shapes int, links int"


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [listing_share(t) if t else (0.0, 0, 0, 0) for t in batch.column(1).to_pylist()]
        share, *counts = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(share, pa.float64()), *(pa.array(c, pa.int32()) for c in counts)], ["doc_id", "share", "pieces", "shapes", "links"])


def listing_shares(documents: DataFrame) -> DataFrame:
    """(doc_id, share, pieces, shapes, links) of every row: how much of its text is listing. One pass, no shuffle.

    Null, empty and blank texts have share 0. Repeated rows come out as often
    as they came in; extra columns are ignored; an empty table gives an empty
    result.
    """
    rows = spread(documents.selectExpr("cast(doc_id as bigint) doc_id", "text"))
    return rows.mapInArrow(_score, SHARES)


def is_listing(share: float, pieces: int, shapes: int, links: int) -> bool:
    """Whether a page's figures make it a listing: more than half of it, of few shapes, and long enough to be a list at all."""
    return share > SHARE and shapes * PIECES_A_SHAPE <= pieces and (pieces >= LEAST_PIECES or links >= LEAST_LINKS)


def listing_pages(documents: DataFrame) -> DataFrame:
    """(doc_id) of the pages that are listings, by the rule of is_listing."""
    x = listing_shares(documents)
    few = x.shapes * PIECES_A_SHAPE <= x.pieces
    return x.where((x.share > SHARE) & few & ((x.pieces >= LEAST_PIECES) | (x.links >= LEAST_LINKS))).select("doc_id")
