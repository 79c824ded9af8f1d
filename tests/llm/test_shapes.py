import random

import pytest

from spanloom.llm.shapes import is_listing, listing_pages, listing_share, masked, shape

PROSE = " ".join(f"The {a} lifts the {b} and walks over to the {c}." for a, b, c in zip(["man", "girl", "cook"] * 5, ["cup", "jar", "box"] * 5, ["gate", "shelf", "door"] * 5, strict=True))
r = random.Random(0)
WORDS = ["tripod", "ring light", "camera bag", "drone", "gimbal", "light box", "webcam"]
KEYS = [f"{r.choice(['best', 'cheap', 'buy', '4k', 'near me'])} {r.choice(WORDS)}" for _ in range(60)]
LINKS = [f"https://shop{i}.example/{w.replace(' ', '-')}?id={i}" for i, w in enumerate(WORDS * 4)]

SPAM = {
    "lines": "\n".join(KEYS),
    "commas": ", ".join(KEYS),
    "pipes": " | ".join(KEYS).upper(),
    "emoji": " \U0001f525 ".join(KEYS),
    "run": " ".join(KEYS * 2),
    "hashtags": "".join("#" + k.replace(" ", "") for k in KEYS),
    "links": " ".join(LINKS),
    "markdown": "\n".join(f"- [{k}]({u})" for k, u in zip(KEYS, LINKS, strict=False)),
    "anchors": "<br>".join(f'<a href="{u}">{k}</a>' for k, u in zip(KEYS, LINKS, strict=False)),
    "titled": "\n".join(f"{k} - {u}" for k, u in zip(KEYS, LINKS, strict=False)),
    "tags": "; ".join(f"{w.title()} A{i}4 -{i}%" for i, w in enumerate(WORDS * 5)),
    "menu": " > ".join(["Home", "Gallery", "Contact", "Help", "Log in", "Cart", "About us"] * 4),
    "gaps": "   ".join(["Home", "Gallery", "Contact", "Help", "Log in", "Cart", "About us"] * 4),
    "stuffed": "Why cheap tripod? Because cheap tripod is cheap tripod. Order cheap tripod, compare cheap tripod, love cheap tripod. cheap tripod! cheap tripod or cheap tripod sale?" * 3,
    "wide": "三脚架特价 | 镜头折扣 | 无人机批发 | " * 12,
    "wide blanks": "三脚架特价 镜头折扣 无人机批发 " * 12,
    "eleven links": " ".join(LINKS[:11]),
    "three links": "\n".join(LINKS[:3]),
    "long attributes": "\n".join(f'<a title="{"x" * 1200}" href="/{i}">Garden chairs</a>' for i in range(20)),
    "inner tags": "\n".join(f'<a href="/{i}"><span class="n"><b>Garden</b> chairs</span></a>' for i in range(11)),
    "picture links": "\n".join(f"[![{k}](/{i}.png)](/shop/{i}_(new) \"{k}\")" for i, k in enumerate(KEYS[:11])),
    "long labels": "\n".join(f"[{k * 40}](/{i})" for i, k in enumerate(KEYS[:11])),
    "menu in brackets": "\n".join(["[Home] [About] [Contact]", "[Shop] [Cart] [Help]", "[Log in] [Terms] [Jobs]"] * 2),
    "one long run": " ".join(["cheap tripod best tripod buy tripod cheap tripod"] * 3) + ".",
    "wide run": "三脚架特价无人机批发三脚架特价无人机批发" * 4 + "。",
    "eight tags": ", ".join(KEYS[:8]),
    "most": PROSE[:200] + "\n" + ", ".join(KEYS),
}
HAM = {
    "prose": PROSE,
    "some": PROSE + "\n" + ", ".join(KEYS[:12]),
    "links in prose": " ".join(f"See {u} for what the man did with the cup in the second part of the film." for u in LINKS),
    "questions": "\n".join(f"Q: What does the {w} do with the cup?\nA: It falls." for w in WORDS * 3),
    "code": "```json\n" + "\n".join('{"video": "a.mp4", "tags": ["a", "b"]},' for _ in range(30)) + "\n```\nThe list above is whole.",
    "table": PROSE[:150] + "\n" + "\n".join(f"20{i} | {i}.5 | {i}" for i in range(10, 40)),
    "wide prose": "背景里有人在架子左边等着，什么也没说。" * 12,
    "scraps": "Ελληνική תמונה don't we'll tab\tcells " * 3,
    "said twice": "In the background there is the tray at the market stall at the market stall.",
    "markup": "<image>\n<video>\n<BOR><VR><VR><VR><VR><VR><VR><EOR>\nA cup.",
    "marks in words": "zero\u200bwidth\u200bjoiner\u200bparts\u200bno\u200bword\u200bat\u200ball",
    "one link": "The whole list of the cups stands at https://shop.example/cups and nowhere else at all, says the cook.",
    "short": "one | two | three",
    "blank": " \n\t ",
}


@pytest.mark.parametrize("name", SPAM)
def test_listing(name):
    assert is_listing(*listing_share(SPAM[name])), listing_share(SPAM[name])


@pytest.mark.parametrize("name", HAM)
def test_prose(name):
    assert not is_listing(*listing_share(HAM[name])), listing_share(HAM[name])


def test_many_shapes_count():
    """Listing text in a ninth shape counts as that in the first."""
    kinds = ["cup", "Cup", "CUP", "cup 4", "Cup 4", "CUP 4", "red cup", "Red Cup", "RED CUP", "red cup 4", "a red cup", "A Red Cup"]
    share, pieces, shapes, _ = listing_share(", ".join(k for k in kinds for _ in range(3)))
    assert shapes > 8 and pieces == 36 and share > 0.9


def test_masked():
    text = 'a <A href=x><i>b</i></A> c [d](e(f)g "h") ![i](j) [k] www.l.example, m@n.example <a href=o> p'
    assert masked(text)[1] == ["<A href=x><i>b</i></A>", '[d](e(f)g "h")', "![i](j)", "www.l.example,", "m@n.example"]
    assert masked("no link") == ("no link", [])


def test_shape():
    assert shape("best Tripod 4k", "s") != shape("best tripod", "s") == shape("cheap drone", "s")


def test_long_texts():
    for text in ("<a " * 50_000, "<a>" * 100_000, "[" * 100_000, "](" * 100_000, "[](" * 100_000, "[a](b" * 100_000, "[a](b(" * 100_000, "x" * 500_000, "a@" * 50_000, ", ".join(KEYS * 300)):
        listing_share(text)


def test_tables(spark):
    rows = [(i, t, 1.0) for i, t in enumerate([*SPAM.values(), *HAM.values(), None, ""])] + [(0, SPAM["lines"], 1.0), (None, SPAM["lines"], 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, share double")
    got = [x.doc_id for x in listing_pages(df).collect()]
    assert sorted(str(x) for x in got) == sorted(str(i) for i in [*range(len(SPAM)), 0, None])
    assert listing_pages(df.limit(0)).count() == 0


def test_query(spark, small):
    from spanloom.llm.queries import p8_found

    assert p8_found(spark, small).count() > 0
