import random
import re
import unicodedata

import pytest

from spanloom.llm.leakage import align, align_all, find_leaks, words_of

TEXTS = "tbl string, rec_id bigint, text string, score string"
ITEMS = "item_id bigint, question string, passage string"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def brute(texts, items, shared=10, window=12):
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) != "Cf").lower()
    words = lambda t: re.findall(r"[^\W_]+", t)
    split = {(i, n): [tuple(words(s)) for s in re.split(r"[.?!]+", fold(q)) if words(s)] for n, (i, q) in enumerate(items) if q}
    owners = {}
    for (i, _), ss in split.items():
        for s in ss:
            owners.setdefault(s, set()).add(i)
    grams = {}
    for (i, _), ss in split.items():
        run = []
        for s in [*ss, None]:
            if s is None or len(owners[s]) >= shared:
                for k in range(len(run) - window + 1):
                    grams.setdefault(tuple(run[k : k + window]), set()).add(i)
                run = []
            else:
                run += s
    out = set()
    for tbl, rec, text in texts:
        w = words(fold(text or ""))
        for k in range(len(w) - window + 1):
            out |= {(tbl, rec, i) for i in grams.get(tuple(w[k : k + window]), ())}
    return out


def found(spark, texts, items):
    t = spark.createDataFrame([(*r, "x") for r in texts], TEXTS)
    i = spark.createDataFrame([(*r, "x") for r in items], ITEMS)
    return {(r.tbl, r.rec_id, r.item_id) for r in find_leaks(t, i).collect() if r.run >= 12}


def test_align():
    assert align("a b c d".split(), "x a b c y".split()) == (6, 3)
    assert align("a b c d".split(), "a b z c d".split()) == (7, 2)
    assert align([], ["a"]) == (0, 0)


def test_words():
    assert words_of("Left-footed ＡＢ zero​width 3.5 _x_") == ["left", "footed", "ab", "zerowidth", "3", "5", "x"]


def test_cases(spark):
    boiler = "This very sentence stands in many of the items and says nothing at all about any of them here."
    items = [(1, LONG.title() + "?"), (2, "Short question?"), (3, None), (4, ""), *((10 + k, boiler + f" number{k} " + LONG.replace("one", f"first{k}")) for k in range(10))]
    texts = [
        ("a", 1, "Well: " + LONG.upper().replace(" ", ", ")),
        ("a", 2, " ".join(LONG.split()[:11])),
        ("a", 3, " ".join(LONG.split()[:6]) + " x " + " ".join(LONG.split()[6:])),
        ("a", 4, boiler),
        ("a", 5, None),
        ("a", 6, ""),
        ("a", 1, "unrelated"),
        (None, None, "​".join(LONG)),
        ("b", 7, "first3 " + " ".join(LONG.split()[1:])),
        ("b", 7, "first3 " + " ".join(LONG.split()[1:])),
    ]
    want = brute(texts, items)
    assert found(spark, texts, items) == want and {("a", 1, 1), (None, None, 1), ("b", 7, 13)} <= want and ("a", 4, 10) not in want


def test_align_all_agrees_with_a_plain_table():
    r = random.Random(3)

    def plain(a, b):
        score = {(i, j): 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
        run = dict(score)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                same = a[i - 1] == b[j - 1]
                score[i, j] = max(0, score[i - 1, j - 1] + (2 if same else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
                run[i, j] = run[i - 1, j - 1] + 1 if same else 0
        return max(score.values()), max(run.values())

    pairs = [([r.randrange(1, 5) for _ in range(r.randrange(0, 9))], [r.randrange(1, 5) for _ in range(r.randrange(0, 30))]) for _ in range(200)]
    scores, runs = align_all(pairs)
    assert list(zip(scores.tolist(), runs.tolist(), strict=True)) == [plain(a, b) for a, b in pairs]


def test_edited_copies(spark):
    """An edited copy is found, alone as well as beside a whole copy of the same item."""
    a, b = LONG.split(), [f"w{i}" for i in range(24)]
    cut = lambda words, *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    items = spark.createDataFrame([(1, LONG, "x"), (2, " ".join(b), "x")], ITEMS)
    rows = [("alone", 1, cut(a, 5)), ("whole", 2, " ".join(b)), ("beside", 3, cut(b, 7, 15)), ("other", 4, "nothing of it"), ("little", 5, " ".join(b[:6]))]
    texts = spark.createDataFrame([(*r, "x") for r in rows], TEXTS)
    got = {(r.tbl, r.item_id): r.run for r in find_leaks(texts, items).collect()}
    assert got == {("alone", 1): 8, ("whole", 2): 24, ("beside", 2): 8}
    assert {r.tbl for r in find_leaks(texts, items, edited=False).collect()} == {"whole"}
    assert {(r.tbl, r.item_id): r.run for r in find_leaks(texts, items, block_words=10).collect()} == got


@pytest.mark.parametrize("every", [12, 8, 6])
def test_recall_of_edited_copies(spark, every):
    """Copies with one word in so many changed, left out or put in, beside whole copies of the same items and unrelated texts."""
    r = random.Random(every)
    vocabulary = [f"word{i}" for i in range(400)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]

    def edit(words):
        out, offset = [], r.randrange(every)
        for i, w in enumerate(words):
            how = r.randrange(3) if i % every == offset else None
            out += [w] if how is None else [r.choice(vocabulary)] if how == 0 else [] if how == 1 else [w, r.choice(vocabulary)]
        return out

    questions = [say(r.randrange(14, 40)) for _ in range(60)]
    rows = [("edited", i, " ".join(say(5) + edit(q) + say(9))) for i, q in enumerate(questions)]
    rows += [("whole", i, " ".join(q)) for i, q in enumerate(questions[:30])] + [("other", i, " ".join(say(40))) for i in range(200)]
    texts = spark.createDataFrame([(*row, "x") for row in rows], TEXTS)
    got = {(x.tbl, x.rec_id, x.item_id) for x in find_leaks(texts, spark.createDataFrame([(i, " ".join(q), "x") for i, q in enumerate(questions)], ITEMS)).collect()}
    assert sum(("edited", i, i) in got for i in range(60)) >= 0.9 * 60
    assert sum(("whole", i, i) in got for i in range(30)) == 30 and not any(t == "other" for t, _, _ in got)


def test_empty(spark):
    assert found(spark, [], [(1, LONG)]) == set() == found(spark, [("a", 1, LONG)], [])


def test_query(spark, small):
    from spanloom.llm.queries import p4_found

    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{small}/{name}.parquet").select(*cols).collect()]
    texts = [("video_records", *r) for r in read("video_records", "rec_id", "question")] + [("conversations", *r) for r in read("conversations", "conv_id", "text")]
    assert {tuple(r) for r in p4_found(spark, small).collect()} == brute(texts, read("eval_items", "item_id", "question"))


def test_sql(spark, small):
    from spanloom.llm.queries import ORACLE, p4_found
    from tests.oracle import connect, same

    same(p4_found(spark, small), ORACLE["p4_found"], connect(small))
