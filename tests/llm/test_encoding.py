import base64
import random

import pytest

from spanloom.llm.encoding import DEFAULT_VOCABULARY, GrowingText, PrefixTable, count_tokens, encode_texts, read_vocabulary, vocabulary

tiktoken = pytest.importorskip("tiktoken")
#: Fixed value: the published pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACES = "\t\n\x0b\x0c\r \x85\xa0       　\x1c\x1f᠎​﻿"


@pytest.fixture(scope="module")
def public():
    with open(DEFAULT_VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def texts(n, seed=0):
    r = random.Random(seed)
    alphabets = ["abcdefgh ing tion the ", "'s're'll x!?. ", "äöüß éè 中文字 привет 😀👩‍🚒", SPACES + "ab", "0123456789 -=_", "xxxx", "日本語 한국어 ไทย हिन्दी"]
    return ["".join(r.choice(r.choice(alphabets[i % 7 :] or alphabets)) for _ in range(r.randrange(0, 60))) for i in range(n)]


def test_equals_the_public_encoder(public):
    voc = vocabulary(read_vocabulary(DEFAULT_VOCABULARY))
    for t in [*texts(1500), "", "<|endoftext|>", "x" * 5000, "-=" * 3000, " " * 3000, "中" * 2000, *("a" + s + "b" + s + s + "!" for s in SPACES)]:
        assert voc.encode(t) == public(t), repr(t)[:80]


def test_every_prefix_and_appending(public):
    voc, data = vocabulary(read_vocabulary(DEFAULT_VOCABULARY)), b"internationalisation"
    table = PrefixTable(voc)
    for i in range(len(data)):
        table.append(data[i : i + 1])
    for end in range(len(data) + 1):
        assert table.tokens(end) == public(data[:end].decode())


def test_edits_need_few_entries():
    voc, r = vocabulary(read_vocabulary(DEFAULT_VOCABULARY)), random.Random(1)
    for _ in range(60):
        table = PrefixTable(voc, "".join(r.choice("abcdefgh ing tion") for _ in range(2000)).encode())
        at = r.randrange(0, 1500)
        computed = table.edit(at, at + r.randrange(0, 9), b"xyz")
        assert table.last == PrefixTable(voc, table.data).last and computed < 700


def test_growing_text(public):
    voc = vocabulary(read_vocabulary(DEFAULT_VOCABULARY))
    for t in texts(40, 3):
        grown = GrowingText(voc)
        for i in range(0, len(t), 5):
            grown.append(t[i : i + 5])
        assert grown.tokens() == public(t)


def test_tables(spark, public):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", "x"), (None, "<|endoftext|>", "x"), (4, "long " * 40_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    want = sorted((str(i), public(t or "")) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids) for r in encode_texts(df).collect()) == want
    assert sorted((str(r.doc_id), r.n_tokens) for r in count_tokens(df).collect()) == sorted((i, len(x)) for i, x in want)
    assert encode_texts(df.limit(0)).count() == count_tokens(df.limit(0)).count() == 0


def test_query(spark, small, public):
    from spanloom.llm.queries import p6_ids

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in p6_ids(spark, small).collect()}
    assert got == {k: public(v or "") for k, v in texts.items()}
