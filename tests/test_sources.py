import base64
import io
import json
import zipfile

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom import config
from spanloom.functions import text as X
from spanloom.functions.udfs import predict, register_archive_index
from spanloom.operators import automata, conversations, lookup, sampling, scoring, training, vectors
from spanloom.sinks import results
from spanloom.sources import files, readers

RAW = [
    {"image": ["a.jpg", "a.jpg###[1,2,3,4]"], "conversations": [{"from": "human", "value": "What? Please provide the bounding box coordinate of it."}, {"from": "gpt", "value": "[0.1, 0.2, 1.3, 0.4]"}, {"from": "human", "value": "<image>"}, {"from": "gpt", "value": " a cup "}]},
    {"image": "b.jpg", "conversations": [{"from": "human", "value": "<image> Who?"}, {"from": "gpt", "value": "(0, 0, 1, 1)"}]},
    {"image": "c.jpg", "conversations": [{"from": "gpt", "value": "alone"}]},
]


def test_records_and_manifest(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RAW))
    (tmp_path / "m.json").write_text(json.dumps([{"data_path": "a.json", "image_folder": "i", "ds_name": "one"}, {"data_path": "a.json", "image_folder": "j", "ds_name": "two"}]))
    direct = readers.read_sources(spark, str(tmp_path / "a.json"))
    assert [(r.ord, r.image, r.ds_name) for r in direct.orderBy("ord").collect()] == [(0, RAW[0]["image"], "dataset"), (1, ["b.jpg"], "dataset"), (2, ["c.jpg"], "dataset")]
    listed = readers.read_sources(spark, str(tmp_path / "m.json"))
    assert sorted((r.ds_name, r.image_folder, r.ord) for r in listed.collect()) == [(n, f, i) for n, f in (("one", "i"), ("two", "j")) for i in range(3)]
    made = conversations.normalize_raw(direct.select("ord", "image", "conversations")).collect()
    assert [tuple(r) for r in made] == [(0, "a.jpg", [[0.1, 0.2, 1.0, 0.4]], "<image>\nWhat?", "\n<answer> a cup </answer>")]
    (tmp_path / "twice.json").write_text(json.dumps([{"data_path": "a.json", "image_folder": "i", "ds_name": "one"}] * 2))
    with pytest.raises(ValueError, match="twice"):
        readers.read_sources(spark, str(tmp_path / "twice.json"))


def test_turns_are_normalised_as_records(spark, small):
    turns = conversations.one_delivery(spark.read.parquet(f"{small}/conversations.parquet"), ["conv_id", "turn"])
    same = lambda df: sorted(map(repr, df.select("conv_id", "image", "bboxes", "question", "answer").collect()))
    assert same(conversations.normalize_turns(turns)) == same(conversations.normalize_raw(conversations.turns_to_records(turns)))
    assert conversations.normalize_turns(turns.limit(0)).count() == 0


def test_files_are_normalised_as_their_first_record_says(spark, tmp_path):
    ready = [{"image": "r.jpg", "bboxes": [[0, 0, 1, 1]], "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"image": "s.jpg", "bboxes": [], "conversations": []}]
    for name, rows in (("raw", RAW), ("ready", ready)):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    both = readers.union_all([readers.read_records(spark, str(tmp_path / f"{n}.json"), n) for n in ("raw", "ready")])
    got = sorted((r.ds_name, r.ord, r.image, r.question, r.answer) for r in conversations.normalize_files(both, "ds_name").collect())
    assert got == [("raw", 0, "a.jpg", "<image>\nWhat?", "\n<answer> a cup </answer>"), ("ready", 0, "r.jpg", "q", "a"), ("ready", 1, "s.jpg", None, None)]
    assert conversations.normalize_files(both.limit(0), "ds_name").count() == 0


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(values, max_size=8), st.integers(1, 40), st.booleans())
def test_elements_of_an_array(rows, chunk, spaced):
    text = json.dumps(rows, ensure_ascii=False, indent=2 if spaced else None)
    assert [json.loads(e) for e in files.elements(io.BytesIO(text.encode("utf-8", "surrogatepass") if text.isascii() else text.encode()), chunk)] == rows


@pytest.mark.parametrize("chunk", [1, 2, 3])
def test_numbers_that_go_on(chunk):
    rows = [1.5, -2e5, 1e-7, 10, 0.25, "a,b]", [1.5], {"a": 2.5}, True, None]
    assert [json.loads(e) for e in files.elements(io.BytesIO(json.dumps(rows).encode()), chunk)] == rows


@pytest.mark.parametrize("text", ["", "  ", "{}", "[1 2]", "[1, 2", '["a', "[1,, x]"])
def test_broken_arrays(text):
    with pytest.raises(ValueError):
        list(files.elements(io.BytesIO(text.encode()), 3))


def test_json_lines(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question_id": "1", "text": "t"}\n\n  \n{"question_id": "2"}\n')
    assert sorted(map(tuple, readers.read_json_lines(spark, str(tmp_path / "q.jsonl"), "question_id string, text string").collect()), key=repr) == [("1", "t"), ("2", None)]


def test_benchmarks(spark, tmp_path):
    pd.DataFrame({"index": [1, 2], "image": [base64.b64encode(b"px").decode()] * 2, "question": ["q", "q"], "A": ["a", None], "B": ["b"] * 2, "C": ["c"] * 2, "D": ["d"] * 2, "answer": ["A", "B"]}).to_parquet(tmp_path / "hr.parquet")
    got = readers.read_four_options(spark, str(tmp_path / "hr.parquet")).orderBy("question_id").collect()
    assert got[0].query == "q\nOptions:\n(A)a\n(B)b\n(C)c\n(D)d" and bytes(got[0].image) == b"px" and got[0].category == "overall" and got[1].query is None
    for name in ("beta", "alpha", "assets"):
        (tmp_path / "cfg" / name).mkdir(parents=True)
        pd.DataFrame({"idx": ["other split"]}).to_parquet(tmp_path / "cfg" / name / "test-0.parquet")
        pd.DataFrame({"idx": ["x"], "question": ["q"], "choices": [["u", "v"]], "answer": ["(B)"], "image_1": [b"1"], "image_2": [None if name == "beta" else b"2"]}).to_parquet(tmp_path / "cfg" / name / "val-0.parquet")
    got = readers.read_configs(spark, str(tmp_path / "cfg")).collect()
    assert sorted((r.category, r.label, len(r.image), r.query) for r in got) == [("alpha", "B", 2, "q\nOptions:\nA. u\nB. v\n"), ("beta", "B", 1, "q\nOptions:\nA. u\nB. v\n")]


def test_video_benchmarks(spark, tmp_path):
    files = spark.createDataFrame([("/d/one.mp4",), ("/c/one.mkv",), ("/c/.one.mp4",), ("/c/two.JPG",), ("/e/sub/two.webm",), ("/b/one.mp4",)], "path string")
    index = lookup.video_index(files)
    assert {r.key: r.path for r in index.collect()} == {"one.mp4": "/b/one.mp4", "one": "/b/one.mp4", "one.mkv": "/c/one.mkv", "two.webm": "/e/sub/two.webm", "two": "/e/sub/two.webm"}
    rows = spark.createDataFrame([("u/watch?v=one", "zz", "v1", "1", "q", ["a", "b"], "b", "short"), ("u/watch?v=no", "two", "v2", "2", "q", ["a"], "A", "long"), (None, "two", "v3", "3", "q", ["a"], "A", "long"), (None, "no", "v4", "4", "q", ["a"], "A", "long")], "url string, videoID string, video_id string, question_id string, question string, options array<string>, answer string, duration string")
    assert sorted((r.id, r.video, r.label) for r in readers.read_url_keyed(rows, index).collect()) == [("v1_1", "/b/one.mp4", "B"), ("v2_2", "/e/sub/two.webm", "A"), ("v3_3", "/e/sub/two.webm", "A")]
    named = spark.createDataFrame([(0, "gone.mp4", "q", ["a"], "a"), (1, "x/one.avi", "q", ["a"], "a")], "ord bigint, video_name string, question string, candidates array<string>, answer string")
    assert [tuple(r) for r in readers.read_name_keyed(named, index).collect()] == [("x/one.avi_1", "/b/one.mp4", "q", ["a"], "A", "overall")]
    assert lookup.missing(named, index, "video_name").first()[0] == 1
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "task.json").write_text(json.dumps([{"video": "gone", "question": "q", "candidates": ["a"], "answer": "a"}, {"video": "two", "question": "q", "candidates": ["a", "b"], "answer": "b"}]))
    assert [(r.id, r.label, r.category) for r in readers.read_task_folder(spark, str(tmp_path / "t"), index).collect()] == [("task_1", "B", "task")]


def test_positions_of_parquet_rows(spark, tmp_path):
    pd.DataFrame({"video_name": list("abc")}).to_parquet(tmp_path / "b.parquet")
    pd.DataFrame({"video_name": ["z"]}).to_parquet(tmp_path / "a.parquet")
    assert [tuple(r) for r in readers.read_first_parquet(spark, str(tmp_path), "b.parquet").where("video_name = 'c'").collect()] == [("c", 2)]
    assert readers.read_first_parquet(spark, str(tmp_path), "none.parquet").first().video_name == "z"
    (tmp_path / "bare").mkdir()
    (tmp_path / "bare" / "x.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        readers.read_first_parquet(spark, str(tmp_path / "bare"))


def test_archives(spark, tmp_path):
    (tmp_path / "s").mkdir()
    with zipfile.ZipFile(tmp_path / "s" / "a.zip", "w") as z:
        z.writestr("in/v.mp4", b"xx")
        z.writestr("in/empty", b"")
    target = str(tmp_path / "t")
    for _ in range(2):
        members = files.unpack_archives(spark, str(tmp_path / "s"), target)
        assert sorted((r.name, r.size) for r in members.collect()) == [("in/empty", 0), ("in/v.mp4", 2)]
    assert (tmp_path / "t" / "in" / "v.mp4").read_bytes() == b"xx" and (tmp_path / "t" / "in" / "empty").read_bytes() == b""
    assert sorted(r.path.removeprefix(target) for r in files.list_files(spark, target).collect()) == ["/in/v.mp4"]
    (tmp_path / "bad").mkdir()
    with zipfile.ZipFile(tmp_path / "bad" / "b.zip", "w") as z:
        z.writestr("../out.txt", b"x")
    with pytest.raises(Exception, match="leads out"):
        files.unpack_archives(spark, str(tmp_path / "bad"), str(tmp_path / "u"))
    assert not (tmp_path / "out.txt").exists()
    assert files.first_file(spark, str(tmp_path / "s"), ".none", ".zip").endswith("s/a.zip") and files.first_file(spark, str(tmp_path), ".x") is None
    assert files.first_folder(spark, str(tmp_path), "s").endswith("/s") and files.first_folder(spark, str(tmp_path), "nowhere") is None
    register_archive_index(spark)
    assert sorted(tuple(r) for r in spark.sql(f"SELECT * FROM archive_index('{tmp_path}/s/a.zip')").collect()) == [("in/empty", 0), ("in/v.mp4", 2)]


def test_tasks(spark, tmp_path):
    assert config.task_options("mlvu", fps=3.0, max_frames=None) == config.EvalTask("video", 3.0, 512, 20000 * 784, 50176, 460800)
    with pytest.raises(ValueError):
        config.task_options("nothing")
    with pytest.raises(TypeError):
        config.task_options("mlvu", colour=1)
    with pytest.raises(ValueError, match="registered"):
        readers.register_loader("blink")(lambda *a: None)
    with pytest.raises(ValueError, match="no loader"):
        readers.load_task(spark, "nothing", str(tmp_path))
    with pytest.raises(FileNotFoundError):
        readers.load_task(spark, "blink", str(tmp_path / "x"))


def test_scores_and_sinks(spark, tmp_path):
    rows = [("1", ["The answer is B"], "B", "x"), ("2", ["no idea"], "A", "x"), ("3", [], "A", None), ("4", None, "(C)", None), ("5", ["c"], "(C)", None)]
    df = spark.createDataFrame(rows, "id string, prediction array<string>, label string, category string")
    assert sorted(map(tuple, scoring.score(df).collect())) == [("overall", 3, 1, 0.333333), ("x", 2, 1, 0.5)]
    assert scoring.summary(df.limit(0), "b", 1).first().accuracy == 0.0
    folder = results.result_folder(str(tmp_path), "vstar", "org/run/")
    assert folder.endswith("VSTAR/run")
    path = results.write_metrics(df, folder, "vstar", 3)
    found = json.loads(open(path).read())
    assert path.endswith("steps003.metrics.json") and found["by_category"]["x"] == {"correct": 1, "total": 2}
    assert spark.read.json(results.write_predictions(df, folder, 3)).count() == 5
    array = json.loads(open(results.write_prediction_array(df.orderBy("id"), folder, 4)).read())
    assert [r["id"] for r in array] == list("12345") and array[3]["prediction"] is None and json.loads(open(results.write_prediction_array(df.limit(0), folder, 5)).read()) == []


def test_predictor(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, prompt string")
    assert sorted(map(tuple, predict(df, lambda p: p.str.upper()).collect()), key=repr) == [("1", ["A"]), ("2", ["B"])]
    assert [r.prediction for r in predict(df, lambda p: 1 / 0).collect()] == [[""], [""]]

    def half(prompts):
        if "b" in set(prompts):
            raise ValueError
        return prompts

    assert sorted(map(tuple, predict(df, half).collect()), key=repr) == [("1", ["a"]), ("2", [""])]


def test_automata(spark):
    longs = lambda *xs: F.array(*(F.lit(x) for x in xs)).cast("array<bigint>")
    value = lambda c: spark.range(1).select(c).first()[0]
    assert value(automata.forced_tokens(longs(1, 7, 2), 7, 8, 9, 2)) == [1, 7, 8, 8, 9, 2]
    allowed = lambda *g: value(automata.allowed_tokens(longs(*g), 7, 8, 9, [101, 102], [65, 66], 2))
    assert [allowed(), allowed(7), allowed(7, 9), allowed(7, 9, 101), allowed(9, 101, 102), allowed(9, 1, 1, 1)] == [[7], [8], [101], [102], [65, 66], [2]]
    assert value(automata.suppressed_ids(longs(), F.array(F.lit(5), F.lit(None).cast("int"), F.lit(0)), 0)) == [5]


def test_scatter_counts_must_agree(spark):
    tokens = spark.createDataFrame([(1, 0, 3), (1, 1, 3)], "seq int, pos int, token int")
    good = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "seq int, n int, feature string")
    assert sorted(map(tuple, vectors.scatter(tokens, good, 3).collect())) == [(1, 0, "a"), (1, 1, "b")]
    with pytest.raises(Exception, match="differ in number"):
        vectors.scatter(tokens, good.limit(1), 3).collect()


def test_sampling(spark):
    df = spark.range(10).withColumn("ok", F.col("id").isin(2, 5))
    assert [r.taken for r in sampling.next_valid(df, "id", "ok", block=3).orderBy("ord").collect()] == [2, 2, 2, 5, 5, 5, 2, 2, 2, 2]
    assert [r.id for r in sampling.seeded_head(df, 0, 3, "id").collect()] == [0, 1, 2]
    assert sampling.seeded_head(df, 42, None, "id").count() == 10
    assert [r.id for r in sampling.latest(df, 2, "id").collect()] == [9, 8]


def test_weighted_draw(spark):
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("c", 0.0), ("d", 0.25)], "s string, weight double")
    got = sampling.weighted_draw(spark.range(2000), "id", weights, "s", 42, buckets=8)
    counts = {r.s: r.n_drawn for r in sampling.samples_drawn(got, "s").collect()}
    assert sum(counts.values()) == 2000 and set(counts) == {"a", "b", "d"} and abs(counts["a"] - 1000) < 100
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sampling.weighted_draw(spark.range(2000), "id", weights, "s", 42).collect()))
    many = spark.range(20_000).selectExpr("cast(id as string) s", "1 / 20000d weight")
    assert sampling.weighted_draw(spark.range(500), "id", many, "s", 42).count() == 500


def test_long_conversations_are_split(spark):
    roles = ["system", "human", "gpt", "user", "assistant", "human"]
    rows = [("a", i * 3, r, f"t{i}") for i, r in enumerate(roles)] + [("b", i, "human" if i % 2 == 0 else "gpt", f"u{i}") for i in range(9)]
    turns = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")
    counts = spark.createDataFrame([("a", [4, 5]), ("c", [1])], "conv_id string, counts array<bigint>")
    for make in (lambda n: conversations.chat_pairs(turns, n), lambda n: conversations.counts_by_turn(turns, counts, n), lambda n: conversations.chat_samples(turns, block=n)):
        whole = sorted(map(repr, make(4096).collect()))
        assert whole and sorted(map(repr, make(2).collect())) == whole
    assert {(r.conv_id, r.turn): r.counts for r in conversations.counts_by_turn(turns, counts, 2).collect() if r.counts} == {("a", 6): [4, 5]}
    assert conversations.chat_pairs(turns.limit(0)).count() == 0


def test_chat_samples(spark):
    turns = spark.createDataFrame([("a", 0, "human", "who ?"), ("a", 1, "gpt", "he did"), ("a", 2, "human", "alone")], "conv_id string, turn bigint, role string, text string")
    length = lambda text: F.transform(F.split(text, "\\s+"), lambda w: F.length(w).cast("bigint"))
    row = conversations.chat_samples(turns, length).first()
    assert len(row.ids) == len(row.labels) and row.labels[-3:] == [2, 13, 0] and all(x == -100 for x in row.labels[:-3]) and row.ids[-3:] == [2, 13, 0]


def test_roles(spark):
    value = lambda c: spark.range(1).select(c).first()[0]
    assert [value(X.strict_role(F.lit(r))) for r in ("human", "assistant", "system")] == ["user", "assistant", "system"]
    for role in ("robot", None):
        with pytest.raises(Exception, match="unknown role"):
            value(X.strict_role(F.lit(role).cast("string")))


def test_crop_metrics(spark):
    crops = spark.createDataFrame([(1, 1, 2, 3), (1, 1, 4, 4), (2, 1, 2, 5)], "b int, t int, h int, w int")
    assert sorted(map(tuple, training.crop_metrics(crops, "b").collect())) == [(1, 2, 2), (2, 1, 2)]
    assert training.crop_metrics(crops.limit(0), "b").count() == 0


def test_drain(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", i) for i in range(50)] + [("c", 0)], "s string, ord bigint")
    weights = spark.createDataFrame([("a", 9.0), ("b", 1.0), ("c", 0.0)], "s string, weight double")
    got = sampling.drain(df, "s", "ord", weights, 42, block=7).orderBy("time").collect()
    assert len(got) == 100 and {r.s for r in got} == {"a", "b"}
    for name in "ab":
        assert [r.ord for r in got if r.s == name] == list(range(50))
    assert sum(r.s == "a" for r in got[:50]) > 35
    assert sampling.drain(df.limit(0), "s", "ord", weights, 42).count() == 0
