"""Golden vectors of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import arrays, frames, geometry
from spanloom.functions import text as X
from spanloom.functions.answers import bracketed_letter, gold_letter, option_letter, predicted_letter


@pytest.fixture
def value(spark):
    return lambda column: spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    "said, letter",
    [
        ("B<|im_end|>", "B"),
        ("<BOR><VR><EOR>The answer is: C", "C"),
        ("The answer is (B).", "B"),
        ("(d) because", "D"),
        ("c.", "C"),
        ("Answer: A", "A"),
        ("The answer is wrong", "W"),
        ("I think B", "I"),
        ("no idea", None),
        ("<BOR><VR>", None),
        ("", None),
        (None, None),
        ("Die Gärtnerin", None),
    ],
)
def test_predicted_letter(value, said, letter):
    assert value(predicted_letter(F.lit(said).cast("string"))) == letter


@pytest.mark.parametrize("label, letter", [("(B)", "B"), ("yes", "YES"), ("3", "3"), (" b ", "B"), (None, None)])
def test_gold_letter(value, label, letter):
    assert value(gold_letter(F.lit(label).cast("string"))) == letter


@pytest.mark.parametrize("answer, choices, letter", [("b", ["x"], "B"), ("cat", ["dog", "cat"], "B"), ("The cat", ["dog"], "THE CAT"), ("A", ["B", "A"], "A")])
def test_option_letter(value, answer, choices, letter):
    assert value(option_letter(F.lit(answer), F.array(*map(F.lit, choices)))) == letter


def test_bracketed_letter(value):
    assert [value(bracketed_letter(F.lit(x))) for x in ("(b)", "c")] == ["B", "C"]


@pytest.mark.parametrize(
    "counts, want",
    [([2, 0, 1], "<BOR><VR><VR><EOR><BOR><VR><EOR>\nThe answer is: X"), ([0], "The answer is: X"), ([], "\nThe answer is: X")],
)
def test_reflect(value, counts, want):
    column = F.array(*map(F.lit, counts)) if counts else F.array().cast("array<int>")
    assert value(X.reflect(F.lit("\n<answer> X </answer>"), column)) == want


def test_texts(value):
    assert value(X.mark_media(F.lit("a\n<image>\nb"))) == "a<|vision_start|><|image_pad|><|vision_end|>b"
    assert value(X.mark_media(F.lit("<video>"), video=True)) == "<|vision_start|><|video_pad|><|vision_end|>"
    assert value(X.without_box_request(F.lit("q? please PROVIDE the bounding box coordinate x\ny"))) == "q?"
    assert value(X.is_box(F.lit(" [0.1, 0.2, 0.3, 4] "))) and not value(X.is_box(F.lit("0.1, 0.2, 0.3")))
    assert value(X.box_numbers(F.lit("[-1, 0.5, 9.8, 1, 7]"))) == [0.0, 0.5, 1.0, 1.0]
    assert value(X.lettered(F.array(*map(F.lit, range(30))))).splitlines()[-1] == "Z. 25"
    assert value(X.url_video_id(F.lit("u/watch?v=a?watch?v=b"), F.lit("c"))) == "b"
    assert value(X.url_video_id(F.lit(None).cast("string"), F.lit("c"))) == "c"
    assert [value(X.stem(F.lit(x))) for x in ("a.b.mp4", ".hidden", "plain")] == ["a.b", ".hidden", "plain"]
    assert value(X.run_name(F.lit("org/name//"))) == "name"
    assert value(X.step_file(F.lit(4))) == "steps004"
    assert value(X.composite_id(F.lit("a"), F.lit(None).cast("string"))) is None
    with pytest.raises(ValueError):
        X.task_prompt("other", F.lit("q"))


def _box(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_boxes(value):
    box = geometry.ordered_box(_box(0.125, 0.5, 0.375, 0.9))
    assert round(value(geometry.area(box)), 9) == 0.1
    assert tuple(value(geometry.pixel_box(box, F.lit(100), F.lit(50)))) == (12, 25, 38, 45)
    assert tuple(value(geometry.ordered_box(_box(9.8, 0, 0.2, 1)))) == (0.2, 0.0, 1.0, 1.0)
    low, high = 16 * 784, 128 * 784
    assert value(geometry.crop_tokens(_box(0, 0, 1, 1), F.lit(100), F.lit(50), low, high)) == 0
    assert value(geometry.crop_tokens(_box(0.3, 0.3, 0.3, 0.9), F.lit(100), F.lit(50), low, high)) == 0
    assert value(geometry.crop_tokens(_box(0, 0, 0.9, 0.001), F.lit(500), F.lit(50), low, high)) == 0
    assert 16 <= value(geometry.crop_tokens(_box(0, 0, 0.5, 0.5), F.lit(100), F.lit(50), low, high)) <= 128
    assert value(geometry.grid_tokens(F.lit(3), F.lit(2), F.lit(3))) == 4


@pytest.mark.parametrize(
    "intervals, fps, total, want",
    [([[3, 7.5]], 30, 300, [90, 158, 225]), ([[0, 1], [2, 6]], 10, 100, [0, 20, 60]), ([[1, 1], [2, 2], [3, 3], [4, 4]], 10, 100, [10, 30, 40]), ([], 10, 100, [0])],
)
def test_clue_frames(value, intervals, fps, total, want):
    spans = F.array(*(_box(*p) for p in intervals)) if intervals else F.array().cast("array<array<double>>")
    assert value(frames.clue_frames(frames.frame_ranges(spans, F.lit(float(fps)), F.lit(total)))) == want


@pytest.mark.parametrize("total, fps, n", [(300, 30, 10), (270, 30, 8), (3, 30, 3), (7, 1, 7)])
def test_train_frames(value, total, fps, n):
    assert value(frames.train_frame_count(F.lit(total), F.lit(float(fps)), 1.0, 128)) == n


@pytest.mark.parametrize("total, fps, target, cap, n", [(300, 30, 2.0, 256, 20), (75, 30, 1.0, 256, 2), (1, 30, 1.0, 256, 1), (None, 30, 1.0, 256, 256), (10, 0, 1.0, 256, 10)])
def test_eval_frames(value, total, fps, target, cap, n):
    assert value(frames.eval_frame_count(F.lit(total).cast("int"), F.lit(float(fps)), target, cap)) == n


def test_arrays(value):
    ids = F.array(*map(F.lit, (1, 2, 3))).cast("array<bigint>")
    assert value(arrays.pad_right(ids, F.lit(5), 0)) == [1, 2, 3, 0, 0] and value(arrays.pad_left(ids, F.lit(4), 9)) == [9, 1, 2, 3]
    made = value(arrays.labelled(F.slice(ids, 1, 1), F.slice(ids, 2, 1), F.slice(ids, 3, 1)))
    assert made.ids == [1, 2, 3] and made.labels == [-100, -100, 3] and made["mask"] == [1, 1, 1]
    assert value(arrays.split_by_lengths(ids, F.array(F.lit(2), F.lit(0), F.lit(1)))) == [[1, 2], [], [3]]
    assert value(arrays.scalar_or_list(F.lit('"a.jpg"'))) == ["a.jpg"] and value(arrays.scalar_or_list(F.lit('["a", "b"]'))) == ["a", "b"]
    assert value(arrays.compact_images(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))) == ["a", "b"]
    assert value(arrays.chunk_count(F.lit(10), 4)) == 3
    assert value(arrays.lookup_or(F.create_map(F.lit("a"), F.lit(1)), F.lit("b"), F.lit(0))) == 0
    assert value(frames.seconds_per_grid(F.lit(None).cast("array<double>"), F.array(F.lit(1), F.lit(2)))) == [1.0, 1.0]
