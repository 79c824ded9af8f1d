import csv
import json
import math
import re

import duckdb
import pytest

from spanloom.sources.raw_records import load_lines, rejected_lines

GRAMMAR = re.compile(r'(?:[^",\r\n]*|"(?:[^"]|"")*")(?:,(?:[^",\r\n]*|"(?:[^"]|"")*"))*\Z')
SCHEMA = "line_id bigint, data_path string, layout string, kind string, line string"
VIDEO = '{"video": "clips/a.mp4", "question": "q", "answer": "a", "temporal_span": %s}'


def number(x):
    return type(x) in (int, float) and math.isfinite(x)


def pair(x):
    return isinstance(x, list) and len(x) == 2 and all(number(v) and v >= 0 for v in x)


def expected(layout, kind, line):
    """The rules, line by line."""
    if line is None or not line.strip():
        return None
    line = line[:-1] if line.endswith("\r") else line
    if layout == "csv":
        if not GRAMMAR.match(line):
            return "syntax"
        names = ("image", "bboxes", "conversations") if kind == "visual" else ("video", "question", "answer", "temporal_span")
        cells = next(csv.reader([line]))
        if len(cells) != len(names):
            return "columns"
        row = dict(zip(names, cells, strict=True))
        for c in ("bboxes", "temporal_span"):
            if c in row:
                try:
                    row[c] = json.loads(row[c])
                except ValueError:
                    row[c] = None
    else:
        try:
            row = json.loads(line)
        except ValueError:
            return "syntax"
        if not isinstance(row, dict):
            return "syntax"
        spans = set(row) - {"video", "question", "answer"}
        if kind == "video" and not ({"video", "question", "answer"} <= set(row) and spans and spans <= {"temporal_span", "clue_intervals"}):
            return "columns"
        if kind == "visual" and set(row) != {"image", "bboxes", "conversations"}:
            return "columns"
        if kind == "video" and row.get("temporal_span") is None:
            row["temporal_span"] = row.get("clue_intervals")
    if kind == "visual":
        b = row["bboxes"]
        return None if isinstance(b, list) and all(isinstance(x, list) and len(x) == 4 and all(map(number, x)) for x in b) else "bboxes"
    v = row["video"].strip() if isinstance(row["video"], str) else "\x00"
    if any(ord(c) < 32 or 127 <= ord(c) < 160 for c in v) or not re.fullmatch(r".+\.(mp4|mkv|webm|mov|avi)", v.split("/")[-1], re.I):
        return "video"
    s = row["temporal_span"]
    return None if pair(s) or isinstance(s, list) and s and all(map(pair, s)) else "temporal_span"


def test_against_the_rules(spark, small):
    want = {}
    for i, layout, kind, line in duckdb.sql(f"SELECT line_id, layout, kind, line FROM '{small}/raw_records.parquet'").fetchall():
        if why := expected(layout, kind, line):
            want[i] = why
    got = {r.line_id: r.reason for r in rejected_lines(spark.read.parquet(f"{small}/raw_records.parquet")).collect()}
    assert got == want and want


@pytest.mark.parametrize(
    "layout, kind, line, reason",
    [
        ("jsonl", "video", VIDEO % "[1, 2]", None),
        ("jsonl", "video", VIDEO % "[1, 2]" + "\r", None),
        ("jsonl", "video", VIDEO % "[[1, 2], [3, 4.5e1]]", None),
        ("jsonl", "video", VIDEO % "[NaN, 2]", "temporal_span"),
        ("jsonl", "video", VIDEO % "[1e999, 2]", "temporal_span"),
        ("jsonl", "video", VIDEO % "[-1, 2]", "temporal_span"),
        ("jsonl", "video", VIDEO % "[true, 2]", "temporal_span"),
        ("jsonl", "video", VIDEO % "[]", "temporal_span"),
        ("jsonl", "video", VIDEO % '"[1, 2]"', "temporal_span"),
        ("jsonl", "video", VIDEO % ("[1, " + "9" * 400 + "]"), "temporal_span"),
        ("jsonl", "video", (VIDEO % "[1, 2]").replace("a.mp4", ".mp4"), "video"),
        ("jsonl", "video", (VIDEO % "[1, 2]").replace("clips/a.mp4", "  clips/a.MKV "), None),
        ("jsonl", "video", (VIDEO % "[1, 2]").replace('"clips/a.mp4"', "5"), "video"),
        ("jsonl", "video", (VIDEO % "[1, 2]").replace("a.mp4", "a\\t.mp4"), "video"),
        ("jsonl", "video", (VIDEO % "null")[:-1] + ', "clue_intervals": [3, 4]}', None),
        ("jsonl", "video", (VIDEO % "[1, 2]").replace('"video"', '"Video"'), "columns"),
        ("jsonl", "video", VIDEO % "[1, 2]" + VIDEO % "[1, 2]", "syntax"),
        ("jsonl", "video", "[" * 100_000, "syntax"),
        ("jsonl", "visual", '{"image": "a", "bboxes": [], "conversations": []}', None),
        ("jsonl", "visual", '{"image": "a", "bboxes": null, "conversations": []}', "bboxes"),
        ("jsonl", "visual", '{"image": "a", "bboxes": [[1, 2, 3]], "conversations": []}', "bboxes"),
        ("csv", "visual", 'a,"[[0, 1, 2, 3]]","[]"', None),
        ("csv", "visual", 'a,"[[0, 1, 2, 3]]","[]",', "columns"),
        ("csv", "visual", "a;b;c", "columns"),
        ("csv", "visual", 'a, "[]",[]', "syntax"),
        ("csv", "visual", 'a,"[]" ,[]', "syntax"),
        ("csv", "visual", 'a,[],"[]', "syntax"),
        ("csv", "video", 'clips/a.mov,q,a,"[1, 2]"', None),
        ("csv", "video", "clips/a.mov,q,a,", "temporal_span"),
        ("csv", "video", ',q,a,"[1, 2]"', "video"),
        ("csv", "video", '"clips/a ""b"".avi",q,"a\nb","[1, 2]"', None),
        ("csv", "other", "a", "columns"),
        ("xml", "video", "a", "syntax"),
        (None, None, "a", "syntax"),
        ("csv", "video", "", None),
        ("csv", "video", " \t\r", None),
        ("csv", "video", None, None),
        ("csv", "video", "clips/" + "x" * 2_000_000 + ".mp4,q,a,[1;2]", "temporal_span"),
    ],
)
def test_line(spark, layout, kind, line, reason):
    df = spark.createDataFrame([(1, "p", layout, kind, line)], SCHEMA)
    assert [r.reason for r in rejected_lines(df).collect()] == ([reason] if reason else [])


def test_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rejected_lines(empty).count() == load_lines(empty).count() == 0
    repeated = spark.createDataFrame([(1, "p", "csv", "visual", "a", "x")] * 3 + [(None, "p", "csv", "visual", "a", "y")], SCHEMA + ", reason string")
    assert sorted((r.line_id or 0, r.reason) for r in rejected_lines(repeated).collect()) == [(0, "columns"), (1, "columns")]
    assert load_lines(repeated).count() == 4


def test_values_are_typed(spark):
    df = spark.createDataFrame([(1, "p", "csv", "visual", 'a.jpg,"[[0, 1, 2, 3]]","[{""from"": ""human""}]"'), (2, "p", "jsonl", "video", VIDEO % "[2, 1]")], SCHEMA)
    got = {r.line_id: r for r in load_lines(df).collect()}
    assert got[1].image == ["a.jpg"] and got[1].bboxes == [[0.0, 1.0, 2.0, 3.0]] and got[1].conversations == '[{"from": "human"}]'
    assert got[2].video == "clips/a.mp4" and got[2].temporal_span == [[2.0, 1.0]] and got[2].reason is None
