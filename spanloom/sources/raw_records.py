"""Load lines of record files, parting unreadable rows from readable ones.

CSV lines go through pyarrow's reader in blocks: its invalid-row callback
yields the rows with a wrong number of fields, every field is read as a string,
and the list fields are cast afterwards, so a failing cell is labelled instead
of failing the load. What the reader is lenient about (a quote inside an
unquoted field, an unclosed quote, text after a closing quote) is rejected by
the quoting grammar before the block is built. JSON lines are parsed strictly.
"""

from __future__ import annotations

import io
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: The keys and fields of each kind of record, the video endings, the reasons in order of precedence.
FIELDS = {
    "visual": ("image", "bboxes", "conversations"),
    "video": ("video", "question", "answer", "temporal_span"),
}
VIDEO_BASE = frozenset(("video", "question", "answer"))
SPAN_KEYS = frozenset(("temporal_span", "clue_intervals"))
VISUAL_KEYS = frozenset(FIELDS["visual"])
VIDEO_NAME = re.compile(r"[^/]+\.(?:mp4|mkv|webm|mov|avi)\Z", re.IGNORECASE | re.DOTALL)
CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")
REASONS = ("syntax", "columns", "video", "temporal_span", "bboxes")

_UNQUOTED = r'[^",\r\n]*'
_QUOTED = r'"[^"]*(?:""[^"]*)*"'
CSV_GRAMMAR = re.compile(rf"(?:{_QUOTED}|{_UNQUOTED})(?:,(?:{_QUOTED}|{_UNQUOTED}))*\Z")

LOADED_SCHEMA = (
    "line_id bigint, layout string, kind string, reason string, image array<string>, bboxes array<array<double>>, "
    "conversations string, video string, question string, answer string, temporal_span array<array<double>>"
)
_LOADED_ARROW = pa.schema(
    [
        ("line_id", pa.int64()),
        ("layout", pa.string()),
        ("kind", pa.string()),
        ("reason", pa.string()),
        ("image", pa.list_(pa.string())),
        ("bboxes", pa.list_(pa.list_(pa.float64()))),
        ("conversations", pa.string()),
        ("video", pa.string()),
        ("question", pa.string()),
        ("answer", pa.string()),
        ("temporal_span", pa.list_(pa.list_(pa.float64()))),
    ]
)
_LABEL_ARROW = pa.schema([("line_id", pa.int64()), ("reason", pa.string())])


def _whole(digits: str) -> int | float:
    return int(digits) if len(digits) < 300 else float(digits)


_DECODER = json.JSONDecoder(parse_int=_whole)


def parse_json(text: str) -> tuple[bool, object]:
    """(readable, value). NaN and Infinity are read as numbers; nesting too deep to read is unreadable."""
    try:
        return True, _DECODER.decode(text)
    except (ValueError, RecursionError):
        return False, None


def _number(x: object) -> bool:
    return type(x) in (int, float) and math.isfinite(x)


def _pair(x: object) -> bool:
    return isinstance(x, list) and len(x) == 2 and all(_number(v) and v >= 0 for v in x)


def cast_span(value: object) -> list[list[float]] | None:
    """A pair or a non-empty list of pairs as a list of pairs; None where it is neither."""
    if _pair(value):
        return [[float(v) for v in value]]
    if isinstance(value, list) and value and all(map(_pair, value)):
        return [[float(v) for v in p] for p in value]
    return None


def cast_boxes(value: object) -> list[list[float]] | None:
    """A list of lists of four finite numbers; None where it isn't one."""
    if isinstance(value, list) and all(isinstance(b, list) and len(b) == 4 and all(map(_number, b)) for b in value):
        return [[float(v) for v in b] for b in value]
    return None


def video_ok(value: object) -> bool:
    if not isinstance(value, str):
        return False
    name = value.strip()
    return not CONTROL.search(name) and VIDEO_NAME.fullmatch(name.rpartition("/")[2]) is not None


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _check(kind: str, cells: dict[str, object]) -> tuple[str | None, dict[str, object]]:
    """The first failing cell's reason, and the cells cast to their types."""
    if kind == "video":
        if not video_ok(cells["video"]):
            return "video", {}
        span = cast_span(cells["temporal_span"])
        if span is None:
            return "temporal_span", {}
        return None, {"video": cells["video"], "question": _text(cells["question"]), "answer": _text(cells["answer"]), "temporal_span": span}
    boxes = cast_boxes(cells["bboxes"])
    if boxes is None:
        return "bboxes", {}
    image = cells["image"]
    images = [_text(x) for x in image] if isinstance(image, list) else None if image is None else [_text(image)]
    return None, {"image": images, "bboxes": boxes, "conversations": _text(cells["conversations"])}


def _load_json(kind: str | None, line: str) -> tuple[str | None, dict[str, object]]:
    ok, value = parse_json(line)
    if not ok or not isinstance(value, dict):
        return "syntax", {}
    keys = set(value)
    if kind == "video":
        spans = keys - VIDEO_BASE
        if not VIDEO_BASE <= keys or not spans or not spans <= SPAN_KEYS:
            return "columns", {}
        first = value.get("temporal_span")
        return _check(kind, value | {"temporal_span": value.get("clue_intervals") if first is None else first})
    if kind != "visual" or keys != VISUAL_KEYS:
        return "columns", {}
    return _check(kind, value)


def _load_csv(kind: str | None, lines: list[tuple[int, str]]) -> Iterator[tuple[int, str | None, dict[str, object]]]:
    """Labels for CSV lines of one kind; lines are (position, text)."""
    fields = FIELDS.get(kind)
    block = []
    for at, line in lines:
        if not CSV_GRAMMAR.match(line):
            yield at, "syntax", {}
        elif fields is None:
            yield at, "columns", {}
        else:
            block.append((at, line))
    if not block:
        return
    rejected: list[int] = []

    def invalid(row: pacsv.InvalidRow) -> str:
        rejected.append(int(row.text.partition(",")[0]))
        return "skip"

    data = "".join(f"{n},{line}\n" for n, (_, line) in enumerate(block)).encode()
    names = ["ord", *fields]
    read = pacsv.read_csv(
        io.BytesIO(data),
        read_options=pacsv.ReadOptions(use_threads=False, block_size=len(data) + 64, column_names=names),
        parse_options=pacsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=invalid),
        convert_options=pacsv.ConvertOptions(column_types={"ord": pa.int64()} | {f: pa.string() for f in fields}, strings_can_be_null=False),
    )
    for n in rejected:
        yield block[n][0], "columns", {}
    columns = [read.column(c).to_pylist() for c in names]
    for n, *cells in zip(*columns, strict=True):
        row: dict[str, object] = dict(zip(fields, cells, strict=True))
        for c in ("temporal_span", "bboxes"):
            if c in row:
                ok, value = parse_json(row[c])
                row[c] = value if ok else None
        yield block[n][0], *_check(kind, row)


def _blank(line: str | None) -> bool:
    return line is None or not line.strip()


def _run(batches: Iterator[pa.RecordBatch], values: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, layouts, kinds, lines = (batch.column(c).to_pylist() for c in ("line_id", "layout", "kind", "line"))
        done: dict[int, tuple[str | None, dict[str, object]]] = {}
        tables: dict[str | None, list[tuple[int, str]]] = {}
        for i, line in enumerate(lines):
            if _blank(line):
                continue
            line = line.removesuffix("\r")
            if layouts[i] == "jsonl":
                done[i] = _load_json(kinds[i], line)
            elif layouts[i] == "csv":
                tables.setdefault(kinds[i], []).append((i, line))
            else:
                done[i] = "syntax", {}
        for kind, rows in tables.items():
            for i, reason, cells in _load_csv(kind, rows):
                done[i] = reason, cells
        if values:
            out = [{"line_id": ids[i], "layout": layouts[i], "kind": kinds[i], "reason": r} | c for i, (r, c) in sorted(done.items())]
            yield pa.RecordBatch.from_pylist(out, schema=_LOADED_ARROW)
        else:
            out = [{"line_id": ids[i], "reason": r} for i, (r, _) in sorted(done.items()) if r]
            yield pa.RecordBatch.from_pylist(out, schema=_LABEL_ARROW)


def load_lines(lines: DataFrame) -> DataFrame:
    """Every non-blank line with its typed cells, or with the reason why it can't be read.

    Input: line_id, layout (jsonl or csv), kind (visual or video), line; other
    columns are ignored, whatever their names. Valid rows have a null reason.
    Null and blank lines never come out. A layout that isn't known counts as
    "syntax", a kind that isn't known as "columns". Repeated rows come out as
    often as they came in. Of a key given twice in an object, the last counts.
    An empty table gives an empty result.
    """
    wanted = spread(lines.select("line_id", "layout", "kind", "line"))
    return wanted.mapInArrow(lambda batches: _run(batches, True), LOADED_SCHEMA)


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(line_id, reason): one row per failing line_id, by the rules of load_lines.

    Only failing rows are shuffled. Where lines that share an id fail for
    several reasons, the first of REASONS is given. A null line_id is an id.
    """
    wanted = spread(lines.select("line_id", "layout", "kind", "line"))
    failed = wanted.mapInArrow(lambda batches: _run(batches, False), "line_id bigint, reason string")
    rank = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))
    first = failed.groupBy("line_id").agg(F.min(rank).alias("at"))
    return first.select("line_id", F.element_at(F.array(*map(F.lit, REASONS)), F.col("at").cast("int")).alias("reason"))
