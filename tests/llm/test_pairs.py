import datetime

import pytest

from spanloom.llm.endings import count_endings, gram_code, longest_rivals, tail_codes
from spanloom.llm.languages import same_language
from spanloom.llm.pairs import broken_pairs, conversation_pairs, is_copy, is_empty, is_refusal, judge, lcs, record_pairs, tail_of

Q = "What does the cyclist do with the old umbrella?"


@pytest.mark.parametrize(
    "reply, defect",
    [
        (None, "empty"),
        ("", "empty"),
        ("<answer>  </answer>", "empty"),
        ("The answer is:", "empty"),
        ("n/a", "empty"),
        ("​", "empty"),
        ("—", "empty"),
        ("[no answer]", "empty"),
        ("None.", None),
        ("No", None),
        ("0", None),
        ("(A)", None),
        ("[0.1, 0.2, 0.3, 0.4]", None),
        (Q, "copy"),
        (Q.upper(), "copy"),
        ("Q: " + Q, "copy"),
        (Q + " " + Q, "copy"),
        ("The answer is: " + Q, "copy"),
        ("with the old umbrella", None),
        (Q + " The cyclist lifts it over the wall and walks away.", None),
        ("I'm sorry, but I can't help with that.", "refusal"),
        ("Unfortunately, I don’t have the ability to see images.", "refusal"),
        ("Diese Frage möchte ich nicht beantworten.", "refusal"),
        ("Je préfère ne pas répondre à cette question.", "refusal"),
        ("抱歉，我无法回答这个问题。", "refusal"),
        ("That is not a topic I will get into.", "refusal"),
        ("My apologies, this falls beyond my remit.", "refusal"),
        ("Nope, I would sooner leave that one alone.", "refusal"),
        ("I don't do descriptions of people.", "refusal"),
        ("I cannot tell you that, it would be improper.", "refusal"),
        ("The rules of this service forbid me to answer.", "refusal"),
        ("The picture shows a lot of things, and there are many more of them behind the wall, but after some thought I will not describe any of that.", "refusal"),
        ("Dazu möchte ich lieber nichts sagen.", "refusal"),
        ("Nous ne pouvons pas répondre à cela.", "refusal"),
        ("Prefiero no hablar de eso.", "refusal"),
        ("这个要求我无法满足。", "refusal"),
        ("I can see a cup, and I am not sure about the rest.", None),
        ("The door cannot be opened because the umbrella blocks it.", None),
        ("The guard refuses to hand over the umbrella and walks off.", None),
        ('The notice says "Sorry, I cannot help with that".', None),
        ("Die Köchin trägt den Werkzeugkasten und sagt nichts.", "wrong_language"),
        ("Женщина ставит кружку.", "wrong_language"),
        ('The sign reads "Bitte nicht stören" in red letters.', None),
        ("He lifts it for two reasons: first,", "truncated"),
        ('The card carries the words "folded', "truncated"),
        ("[0.1, 0.2, 0.3,", "truncated"),
        ("<answer> [0.1, 0.2, 0.3, 0. </answer>", "truncated"),
        ("(0.1, 0.2", "truncated"),
        ("[[0.1, 0.2, 0.3, 0.4], [0.1, 0.2", "truncated"),
        ("(3", "truncated"),
        ("3) 4", None),
        ("The cyclist lifts the umbrella.", None),
    ],
)
def test_judge(reply, defect):
    assert judge(Q, reply)[0] == defect


def test_asked_for_a_language():
    assert judge("How would the sign read in German?", "Die Köchin trägt den Werkzeugkasten und sagt nichts.")[0] is None
    assert same_language("Was macht die Köchin mit dem Eimer?", "The cook lifts the bucket and walks away.") is False
    assert same_language("谁？", "B") is None
    assert same_language("Que fait la jardinière à côté de la fontaine ?", "Al fondo se ve que alguien espera junto al mostrador y no dice nada.") is False


def test_parts():
    assert lcs(list("abcbdab"), list("bdcaba")) == 4 and lcs([], ["a"]) == 0
    assert is_empty("...") and not is_empty("\U0001f642") and not is_copy(Q, "umbrella") and not is_refusal("")
    assert not is_refusal("Le gardien refuse de rendre le parapluie.") and not is_refusal("保安拒绝交出箱子。") and not is_refusal("La niña no puede alcanzar el estante.")
    assert tail_of("It stops.") == ("stopped", ["it", "stops"]) and tail_of("Stop.") is None and tail_of("Why?") is None
    assert tail_of("the red cup") == ("short", ["the", "red", "cup"]) and tail_of("cup") is None and tail_of("It fades. ...") is None
    assert tail_of("He takes the...") == ("open", ["he", "takes", "the"])
    assert tail_of("1. a cup 2. a jar 3.")[0] == "cut"


PAIRS = "tbl string, rec_id bigint, turn bigint, prompt string, reply string, defect string"


CASES = {
    "The man lifts the umbrel": True,
    "The man lifts the umbrel.": True,
    "The man lifts the.": True,
    "A girl turns": True,
    "The man lifts the": True,
    "The man lifts the kettle": False,
    "The man lifts the kettle.": False,
    "A girl turns the basket over slowly": False,
    "the kettle": False,
    "the ket": True,
    "No": False,
    "The man lifts the ladder...": False,
    "A girl turns the...": True,
    "It fades, and then the ladder comes back.": False,
}


@pytest.mark.parametrize("times", [1, 20])
def test_truncated_by_the_corpus(spark, times):
    """The verdicts are the same in a corpus of twenty times the size, cut replies included."""
    nouns = ("basket", "kettle", "umbrella", "ladder", "background")
    whole = [f"The man lifts the {n}. A girl turns the {n} over slowly." for n in nouns for _ in range(60)] + ["It fades, and then the ladder comes back."] * 5
    rows = [("t", i, 0, Q, r, "x") for i, r in enumerate(CASES)]
    spanish = ["El hombre no dice nada."] * 40  # "no" goes on here, and is an answer all the same
    hidden = ["The man li\u200bfts the um\u00adbrella."] * 40  # format characters part no words
    corpus = spark.createDataFrame([(r,) for r in [*whole, *spanish, *hidden, *CASES, None, ""]] * times, "reply string")
    got = {r.rec_id: r.defect for r in broken_pairs(spark.createDataFrame(rows, PAIRS), corpus).collect()}
    assert got == {i: "truncated" for i, cut in enumerate(CASES.values()) if cut}


def test_counts_of_endings(spark):
    texts = ["The cup falls. The cup falls", "a cup... the cup!", "cup", None, ""]
    wanted = spark.createDataFrame([(gram_code(["the", "cup"]),), (gram_code(["the", "cup", "falls"]),)], "h bigint")
    got = {r.h: (r.word, r.n, r.ends, r.goes_on, r.last) for r in count_endings(spark.createDataFrame([(t,) for t in texts], "reply string"), str, wanted).collect()}
    assert got[gram_code(["cup"])] == ("cup", 5, 1, 2, 2) and got[gram_code(["falls"])] == ("falls", 2, 1, 0, 1)
    assert got[gram_code(["the", "cup"])] == (None, 3, 1, 2, 1) and got[gram_code(["the", "cup", "falls"])] == (None, 2, 1, 0, 1)
    assert len(got) == 6  # the, cup, falls, a and the two asked for


def test_codes_of_tails():
    for words in (["a"], ["a", "b"], ["the", "old", "cup"]):
        parts = (words[-1:], words[-2:-1], words[-2:] if len(words) > 1 else [], words if len(words) > 2 else [])
        assert tail_codes(words) == tuple(gram_code(p) if p else None for p in parts)


def test_rivals(spark):
    words = spark.createDataFrame([("turn", 3), ("turns", 9), ("turned", 12), ("cup", 8), ("x" * 5000, 1)], "word string, n bigint")
    rare = spark.createDataFrame([("turn",), ("tur",), ("cup",)], "g1 string")
    assert {r.g1: r.longer for r in longest_rivals(words, rare).collect()} == {"turn": 12, "tur": 12}


def test_prompts_and_empty_tables(spark):
    rows = [("t", 1, 0, None, "n/a", "x"), ("t", 2, 0, " \n", "n/a", "x"), ("t", 3, 0, "<image>", "n/a", "x"), ("t", 4, 0, "Why?", "n/a", "x"), ("t", None, None, "Why?", None, "x")]
    df = spark.createDataFrame(rows, PAIRS)
    got = sorted((str(r.rec_id), r.defect) for r in broken_pairs(df, df.select("reply")).collect())
    assert got == [("4", "empty"), ("None", "empty")]
    assert broken_pairs(df.limit(0), df.select("reply").limit(0)).count() == 0


def test_pairing(spark):
    t = datetime.datetime(2031, 1, 1)
    turns = [(1, 0, "system", "s"), (1, 1, "human", "q1"), (1, 2, "gpt", "a1"), (1, 3, "human", "<image>"), (1, 4, "gpt", "a2"), (1, 5, "user", "q2"), (1, 5, "user", "q2"), (2, 0, "user", "q"), (2, 2, "assistant", "late"), (3, 0, "human", "<image>"), (3, 1, "gpt", "a"), (4, 4095, "human", "edge"), (4, 4096, "gpt", "over"), (4, 4097, "human", "<image>"), (4, 4098, "gpt", "more")]
    df = spark.createDataFrame([(*r, t, "x") for r in turns], "conv_id bigint, turn bigint, role string, text string, loaded_at timestamp, block string")
    got = sorted(((r.rec_id, r.turn, r.prompt, r.reply) for r in conversation_pairs(df).collect()), key=repr)
    assert got == sorted([(1, 1, "q1", "a1"), (1, 3, "q1", "a2"), (1, 5, "q2", None), (2, 0, "q", None), (3, 0, None, "a"), (4, 4095, "edge", "over"), (4, 4097, "edge", "more")], key=repr)
    for block in (1, 2, 3):
        assert sorted(((r.rec_id, r.turn, r.prompt, r.reply) for r in conversation_pairs(df, block).collect()), key=repr) == got
    records = spark.createDataFrame([(1, "q", "old", t), (1, "q", "new", t + datetime.timedelta(1)), (2, None, None, None)], "rec_id bigint, question string, answer string, loaded_at timestamp")
    assert sorted((r.rec_id, r.prompt, r.reply) for r in record_pairs(records).collect()) == [(1, "q", "new"), (2, None, None)]


def test_query(spark, small):
    from spanloom.llm.queries import p3_found

    got = p3_found(spark, small)
    assert got.columns == ["tbl", "rec_id", "turn", "defect"]
    rows = got.collect()
    assert rows and len({r[:3] for r in rows}) == len(rows)
