import math
import random
from collections import defaultdict

import pytest

from spanloom.llm.containers import LevelPacker, container_fill, fill_containers


def brute(sizes, capacity):
    """Sum of squares by trying every level."""
    count, out = [0] * (capacity + 1), 0
    for s in sizes:
        options = []
        for h in [0, *[h for h in range(1, capacity - s + 1) if count[h]]]:
            after = count[:]
            if h:
                after[h] -= 1
            after[h + s] += 1
            options.append((sum(c * c for c in after[1:capacity]), h == 0, -h, h, after))
        *_, h, count = min(options)
        out += h == 0
    return out, count


def test_packer_minimises_the_sum_of_squares():
    r = random.Random(5)
    for _ in range(30):
        sizes = [r.randrange(1, 21) for _ in range(60)]
        packer = LevelPacker(20)
        for s in sizes:
            packer.place(s)
        used, count = brute(sizes, 20)
        assert packer.used == used and packer.count[1:20].tolist() == count[1:20]


def test_packer_edges():
    packer = LevelPacker(10)
    assert packer.place(0) == (0, 0) and packer.place(10) == (0, 0) and packer.place(3) == (1, 0) and packer.place(7) == (1, 3)
    with pytest.raises(ValueError):
        packer.place(11)


def check(df, sizes, capacity, **options):
    packed = fill_containers(df, capacity, **options).collect()
    places = defaultdict(list)
    tokens = defaultdict(int)
    for p in packed:
        assert 0 <= p.n_tokens <= capacity
        places[p.container_id].append((p.container_start, p.container_start + p.n_tokens))
        tokens[p.doc_id] += p.n_tokens
    for spans in places.values():
        at = 0
        for a, b in sorted(spans):
            assert a == at or a == b == 0
            at = max(at, b)
        assert at <= capacity
    assert dict(tokens) == sizes
    return len(places), packed


def test_tables(spark):
    r = random.Random(2)
    sizes = {i: r.choice([0, 1, 5, 30, 64, 65, 200, r.randrange(1, 64)]) for i in range(3000)}
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes.items()], "doc_id bigint, n_tokens bigint, container_id string")
    used, packed = check(df, sizes, 64, shard_containers=64)
    least = math.ceil(sum(sizes.values()) / 64)
    assert used <= least * 1.05
    assert all(p.piece == 0 for p in packed if sizes[p.doc_id] <= 64)
    assert sum(p.n_tokens for p in container_fill(fill_containers(df, 64)).collect()) == sum(sizes.values())


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 130), (3, 130)], "doc_id bigint, n_tokens bigint")
    used, packed = check(df, {1: 0, 2: 0, 3: 260}, 64)
    assert used == 5 and sorted((p.piece, p.n_tokens) for p in packed if p.doc_id == 3) == [(0, 64), (0, 64), (1, 64), (1, 64), (2, 2), (2, 2)]
    assert fill_containers(df.limit(0)).count() == 0


def test_query(spark, small):
    from spanloom.llm.queries import p6_ids, p7_containers

    sizes = {r.doc_id: len(r.ids) for r in p6_ids(spark, small).collect()}
    packed = p7_containers(spark, small).collect()
    got = defaultdict(int)
    for p in packed:
        got[p.doc_id] += p.n_tokens
    assert dict(got) == sizes
    assert len({p.container_id for p in packed}) <= math.ceil(sum(sizes.values()) / 4096) + 1
