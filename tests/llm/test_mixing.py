import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm.mixing import draw_mixture, exact_total, fill, plan_budgets, plan_mixture, source_table


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 10), st.integers(0, 50)), min_size=1, max_size=8), st.integers(0, 400))
def test_fill(parts, budget):
    weights, capacities = [w for w, _ in parts], [c for _, c in parts]
    got = fill(weights, capacities, budget)
    assert sum(got) == min(budget, sum(capacities)) and all(0 <= g <= c for g, c in zip(got, capacities, strict=True))


def test_shortage_goes_to_siblings_first():
    sources = [
        {"ds_name": "a", "domain": "x", "target_share": 0.25, "capacity": 10},
        {"ds_name": "b", "domain": "x", "target_share": 0.25, "capacity": 500},
        {"ds_name": "c", "domain": "y", "target_share": 0.5, "capacity": 500},
    ]
    assert plan_budgets(sources, ["domain"], 200) == [10, 90, 100]
    sources[1]["capacity"] = 20
    assert plan_budgets(sources, ["domain"], 200) == [10, 20, 170]
    assert plan_budgets(sources, [], 10_000) == [10, 20, 500]
    assert exact_total([0.25, 0.25, 0.5], [10, 20, 500]) == 40


def tables(spark, counts):
    records = spark.createDataFrame([(f"t{i % 2}", i, s, "x") for s, n in counts.items() for i in range(n)], "tbl string, rec_id bigint, ds_name string, use string")
    targets = spark.createDataFrame([(" A ", 0.5, 2), ("b", 0.3, 1), ("none", 0.2, 3), (None, 0.1, 1)], "ds_name string, target_share double, max_repeats int")
    groups = spark.createDataFrame([("a", "x"), ("b", "y"), ("none", "x")], "ds_name string, domain string")
    return records, targets, groups


@pytest.mark.parametrize("total", [None, 0, 7, 100, 10_000])
def test_draw(spark, total):
    records, targets, groups = tables(spark, {"a": 40, "b": 90, "unlisted": 5})
    plan = plan_mixture(records, targets, groups, ["domain"], total)
    rows = {r.ds_name: r for r in plan.collect()}
    drawn = [tuple(r) for r in draw_mixture(records, plan).collect()]
    used = Counter(r[2] for r in drawn)
    assert used == {k: r.used for k, r in rows.items() if r.used}
    assert len(set(drawn)) == len(drawn) and sorted(drawn) == sorted(map(tuple, draw_mixture(records, plan).collect()))
    for k, r in rows.items():
        uses = Counter(x[:3] for x in drawn if x[2] == k).values()
        assert r.used <= r.capacity and (not uses or max(uses) - min([*uses, *[0] * (len(uses) < r.n_records)]) <= 1)
    assert sum(r.actual_share for r in rows.values()) == pytest.approx(1 if used else 0)
    if total is None:
        assert used["a"] + used["b"] == 160 and used["a"] == 80


def test_edges(spark):
    records, targets, groups = tables(spark, {"a": 1})
    empty = plan_mixture(records.limit(0), targets, groups, ["domain"])
    assert empty.count() == 3 and draw_mixture(records.limit(0), empty).count() == 0
    assert draw_mixture(records, plan_mixture(records, targets.limit(0), groups, [])).count() == 0
    manifest = spark.createDataFrame([("./d//a.json", "/images/a", "One "), ("d/a.json", None, "one"), ("d/b.json", "videos", None), (None, "v", "two")], "data_path string, image_folder string, ds_name string")
    assert [tuple(r) for r in source_table(manifest).collect()] == [("d/a.json", "one", "images")]


def test_large_source_is_cut_by_buckets(spark):
    records = spark.range(60_000).selectExpr("'t' tbl", "id rec_id", "'a' ds_name")
    targets = spark.createDataFrame([("a", 1.0, 1)], "ds_name string, target_share double, max_repeats int")
    for total in (1, 12_345, 59_999):
        plan = plan_mixture(records, targets, records.select("ds_name").limit(1), [], total)
        assert draw_mixture(records, plan, seed=random.randrange(9)).count() == total


def test_query(spark, small):
    from spanloom.llm.queries import p5_mix, p5_shares

    shares = {r.ds_name: r for r in p5_shares(spark, small).collect()}
    used = Counter(r.ds_name for r in p5_mix(spark, small).collect())
    assert len(shares) == 14 and used == {k: r.used for k, r in shares.items() if r.used}


def test_query_redistributes(spark, small):
    from spanloom.llm.queries import p5_shares, p5_shares_full

    exact, full = ({r.ds_name: r for r in q(spark, small).collect()} for q in (p5_shares, p5_shares_full))
    total = sum(r.n_records for r in full.values())
    assert full.keys() == exact.keys() and sum(r.used for r in full.values()) == total > sum(r.used for r in exact.values())
    short = [r for r in full.values() if r.used == r.capacity > 0 and r.used < math.floor(r.target_share * total)]
    assert short and not any(r.used < math.floor(r.target_share * sum(x.used for x in exact.values())) for r in exact.values() if r.capacity)
    videos = [full[k] for k in ("clip_moments", "cook_clips", "gate_cam", "sport_short")]
    assert all(abs(r.used - r.target_share * total) <= 1 for r in videos)  # the short ones have siblings with room
    assert any(r.used > r.target_share * total + 1 for r in full.values())


def test_shortage_stays_in_the_language_first():
    leaf = lambda name, lang, share, capacity: {"ds_name": name, "domain": "x", "lang": lang, "target_share": share, "capacity": capacity}
    sources = [leaf("a", "en", 0.2, 10), leaf("b", "en", 0.2, 500), leaf("a", "de", 0.3, 500), leaf("b", "de", 0.3, 500)]
    assert plan_budgets(sources, ["domain", "lang"], 100) == [10, 30, 30, 30]
    sources[1]["capacity"] = 15
    assert plan_budgets(sources, ["domain", "lang"], 100) == [10, 15, 38, 37]


def test_query_by_language(spark, small):
    """The leaves' shortages are taken inside their domain and language as far as there is room, as a plain fill of each group says."""
    from spanloom.llm.queries import p5_language_mix, p5_language_shares

    rows = p5_language_shares(spark, small).collect()
    total = sum(r.n_records for r in rows) * 3 // 4
    assert sum(r.used for r in rows) == total and {r.lang for r in rows} >= {"en", "de", "fr", "es"}
    groups = {}
    for r in rows:
        groups.setdefault((r.domain, r.lang), []).append(r)
    for leaves in groups.values():
        assert [r.used for r in leaves] == fill([r.target_share for r in leaves], [r.capacity for r in leaves], sum(r.used for r in leaves))
    short = [r for r in rows if r.used == r.capacity and r.used * 3 <= 2 * r.target_share * total]
    assert any(s.used > s.target_share * total + 1 for r in short for s in groups[r.domain, r.lang])
    for leaves in groups.values():  # what has room in its own language takes the shortage, so the language keeps its share
        if any(r.used < r.capacity for r in leaves):
            assert sum(r.used for r in leaves) >= sum(r.target_share for r in leaves) * total - 1
    assert Counter((r.lang, r.ds_name) for r in p5_language_mix(spark, small).collect()) == {(r.lang, r.ds_name): r.used for r in rows if r.used}


@pytest.mark.parametrize("total", [None, 0, 37, 300, 10_000])
def test_plans_of_workers_and_driver_agree(spark, total):
    r = random.Random(8)
    names = [f"s{i}" for i in range(12)]
    records = spark.createDataFrame([("t", i, r.choice(names[:10]), r.choice(["en", "de", None])) for i in range(400)], "tbl string, rec_id bigint, ds_name string, lang string")
    targets = spark.createDataFrame([(n, r.random() / 6, r.randrange(1, 4)) for n in names] + [("S1 ", None, None)], "ds_name string, target_share double, max_repeats int")
    groups = spark.createDataFrame([(n, r.choice(["x", "y"])) for n in names[:11]], "ds_name string, domain string")
    for by in ((), ("lang",)):
        plan = lambda bound: sorted(tuple(round(c, 9) if isinstance(c, float) else c for c in row) for row in plan_mixture(records, targets, groups, ["domain"], total, by, bound).fillna("").collect())  # noqa: E731, B023
        assert plan(1) == plan(1000)
