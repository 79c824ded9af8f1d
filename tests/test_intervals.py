import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators.intervals import merge_intervals, span_pairs, video_periods


def brute(spans):
    out = []
    for key in {k for k, *_ in spans if k is not None}:
        mine = sorted({(min(a, b), max(a, b)) for k, a, b in spans if k == key and None not in (a, b) and a != b})
        merged = []
        for a, b in mine:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(key, "period", a, b) for a, b in merged]
        out += [(key, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:], strict=False)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed):
    r = random.Random(seed)
    spans = [(r.choice(["a", "a", "a", "b", "c"]), (s := r.randrange(0, 60_000)), s + r.choice([-900, 0, 1, 40, 900, 25_000])) for _ in range(400)]
    spans = [(k, a, max(b, 0)) for k, a, b in spans]
    df = spark.createDataFrame(spans, "k string, s bigint, e bigint")
    assert sorted(map(tuple, merge_intervals(df, "k", "s", "e", bucket_ms=1000).collect())) == brute(spans)


def test_edges(spark):
    spans = [("a", 0, 10), ("a", 10, 20), ("a", 20, 20), ("a", 31, 30), ("a", None, 5), (None, 1, 2), ("a", 0, 10), ("long", 0, 10**15), ("long", 10**15 + 1, 10**15 + 2)]
    df = spark.createDataFrame([(*s, "x", 1) for s in spans], "video string, s bigint, e bigint, kind string, k int")
    assert sorted(map(tuple, merge_intervals(df, "video", "s", "e").collect())) == brute(spans)
    assert merge_intervals(df.limit(0), "video", "s", "e").count() == 0


@pytest.mark.parametrize(
    "text, pairs",
    [
        ("[1, 2]", [[1.0, 2.0]]),
        (" [ [ 1 , 2.5e0 ] ,\n[3,4]] ", [[1.0, 2.5], [3.0, 4.0]]),
        ("[-0.0, 1]", [[-0.0, 1.0]]),
        ("[]", None),
        ("[[]]", None),
        ("null", None),
        ("", None),
        ("[1, 2", None),
        ("[1, 2], [3, 4]", None),
        ("[[1, 2],]", None),
        ("[[1, 2], 3]", None),
        ("[1, 2, 3]", None),
        ('["1", "2"]', None),
        ("[01, 2]", None),
        ("[1., 2]", None),
        ("[.5, 2]", None),
        ("[NaN, 2]", None),
        ("[1e999, 2]", None),
        ("[-1, 2]", None),
        ("[[[1, 2]]]", None),
        ("\u0001", None),
        (None, None),
        ("[" + ",".join(["[1,2]"] * 20_000) + "]", [[1.0, 2.0]] * 20_000),
    ],
)
def test_span_text(spark, text, pairs):
    assert spark.createDataFrame([(text,)], "t string").select(span_pairs(F.col("t"))).first()[0] == pairs


def test_video_records(spark):
    rows = [("v", "[2.0005, 1]", None), ("v", None, "[2, 3]"), ("v", "bad", "[90, 91]"), ("v", "null", "[90, 91]"), (" ", "[1, 2]", None), (None, "[1, 2]", None), ("w", "[[1, 1], [5, 4]]", None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "video string, temporal_span string, clue_intervals string, s int")
    assert sorted(map(tuple, video_periods(df).collect())) == [("v", "period", 1000, 3000), ("w", "period", 4000, 5000)]
