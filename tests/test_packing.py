import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.operators.packing import DISCARDED, Limits, Packer, Sample, collate, discarded_reflection_tokens, pack_first_fit
from spanloom.streaming.streams import END, run_to_table, run_updates, stream_metrics, stream_pack


def packs(lengths, limits, cuttable=lambda i: True):
    packer, out = Packer(limits), []
    for i, n in enumerate(lengths):
        out += packer.add(Sample(i, n, cuttable(i)))
    return packer, out


def by_pack(rows):
    found = {}
    for pack, _, _, n, status in rows:
        found.setdefault(pack if status != DISCARDED else None, []).append(n)
    return found


def test_golden_trace():
    packer, out = packs([30, 50, 20, 70, 45, 55], Limits(100, 4, 60, 100))
    assert by_pack(out) == {0: [30, 50], 1: [70]}
    assert by_pack(packer.flush()) == {2: [20, 45], 3: [55]}


def test_golden_overflow():
    packer, out = packs([40, 70], Limits(100, 4, 90, 2))
    assert by_pack(out) == {0: [70]} and [b.tokens for b in packer.held] == [40]


def test_long_samples():
    _, out = packs([150, 150, 100], Limits(100, 4, 60, 100), cuttable=lambda i: i != 1)
    assert [r[3:] for r in out] == [(100, "truncated"), (150, "discarded"), (100, "packed")]
    assert by_pack(packs([40, 60], Limits(100, 4, 90, 9, tight=True))[1]) == {0: [40, 60]}
    with pytest.raises(ValueError):
        Limits(100, 4, 200, 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 140), max_size=80), st.integers(2, 5), st.integers(2, 12))
def test_invariants(lengths, instances, buffers):
    limits = Limits(100, instances, 60, buffers)
    packer, out = packs(lengths, limits)
    out += packer.flush()
    assert sorted(r[2] for r in out) == list(range(len(lengths)))
    for pack, ns in by_pack(out).items():
        assert pack is None or len(ns) <= instances
        assert pack is None or sum(ns) <= 100
    for pack in {r[0] for r in out}:
        ids = [r[2] for r in out if r[0] == pack]
        assert pack == -1 or ids == sorted(ids)


def test_tables(spark):
    schema = "shard int, ord bigint, id bigint, n_tokens bigint, cuttable boolean, pack_id string"
    df = spark.createDataFrame([(0, 1, 1, 30, True, "x"), (0, 1, 1, 30, None, "x"), (1, 5, 2, None, True, "x")], schema)
    got = sorted((r.shard, r.id, r.n_tokens) for r in pack_first_fit(df, Limits(100, 4, 60, 10)).collect())
    assert got == [(0, 1, 30), (0, 1, 30), (1, 2, 0)]
    assert pack_first_fit(df.limit(0)).count() == 0


def test_discarded_reflection_tokens(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(discarded_reflection_tokens(F.array(*map(F.lit, (8, 1, 8, 8))), 1, 8)).first()[0] == 2


def test_stream_equals_batch(spark, small):
    from spanloom.plans import relation_queries as q

    same = lambda df: sorted(map(tuple, df.select("shard", "instance_ord", "id", "n_tokens", "status").collect()))
    assert same(q.stream_packs(spark, small)) == same(q.pack_first_fit(spark, small))


def test_stream_metrics_equal_batch(spark, small):
    from spanloom.plans import relation_queries as q

    same = lambda df: sorted(map(tuple, df.select("step", "n_micro", "loss_ce").collect()))
    assert same(q.stream_means(spark, small)) == same(q.metric_means(spark, small))


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    """A stream stopped between two files packs as one that never stopped; a third start adds nothing."""
    schema = "shard int, ord bigint, id bigint, n_tokens bigint"
    lengths = [(i % 2, i, i, (i * 37) % 90 + 1) for i in range(60)]
    limits = Limits(100, 4, 60, 10)

    def start():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        return sorted(tuple(r) for r in run_to_table(stream_pack(stream, limits), str(tmp_path / "out")).select("shard", "pack_id", "instance_ord", "id", "n_tokens", "status").collect())

    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add(lengths[:31])
    first = start()
    add(lengths[31:])
    add([(s, 1 << 60, -1, END) for s in (0, 1)])
    whole = start()
    assert first and set(first) < set(whole) and start() == whole
    assert whole == sorted(tuple(r) for r in pack_first_fit(spark.createDataFrame(lengths, schema), limits).collect())


def test_updated_means_go_on(spark, tmp_path):
    add = lambda rows: spark.createDataFrame(rows, "step bigint, loss double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def start():
        stream = spark.readStream.schema("step bigint, loss double").parquet(str(tmp_path / "in"))
        return sorted(tuple(r) for r in run_updates(stream_metrics(stream, "step", "loss"), str(tmp_path / "out"), "step").collect())

    add([(1, 1.0), (1, 2.0), (2, 5.0)])
    assert start() == [(1, 2, 1.5), (2, 1, 5.0)]
    add([(1, 6.0), (3, 1.0)])
    assert start() == [(1, 3, 3.0), (2, 1, 5.0), (3, 1, 1.0)] == start()


def test_collate(spark):
    packed = spark.createDataFrame([(0, 0, 0, 1, 2, "packed"), (0, 0, 1, 2, 1, "packed"), (0, 1, 0, 3, 2, "truncated"), (0, -1, 0, 4, 9, "discarded")], "shard int, pack_id bigint, instance_ord int, id bigint, n_tokens bigint, status string")
    samples = spark.createDataFrame([(1, [5, 6], [-100, 6], "x"), (2, [7], [7], "x"), (3, [1, 2, 3], [1, 2, 3], "x"), (4, [9] * 9, [9] * 9, "x"), (5, [0], [0], "x")], "id bigint, ids array<bigint>, labels array<bigint>, pack_id string")
    got = {r.id: (r.pack_id, r.ids, r.labels, r.mask) for r in collate(packed, samples, 2).collect()}
    assert got == {1: (0, [5, 6], [-100, 6], [1, 1]), 2: (0, [7, 0], [7, -100], [1, 0]), 3: (1, [1, 2], [1, 2], [1, 1])}
    assert collate(packed.limit(0), samples, 2).count() == 0
