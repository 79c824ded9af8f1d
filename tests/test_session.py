import pytest

from spanloom import session


def started(spark, make):
    """Jobs that make() starts."""
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    out = make()
    return out, len(set(tracker.getJobIdsForGroup(None)) - before)


def test_spread_runs_nothing(spark, small):
    scan = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source")
    dealt, jobs = started(spark, lambda: session.spread(scan))
    assert jobs == 0 and dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    grouped = scan.groupBy("source").count()
    same, jobs = started(spark, lambda: session.spread(grouped))
    assert jobs == 0 and same is grouped


def test_keyed_serves_a_later_aggregation(spark, small):
    scan = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source")
    plan = session.keyed(scan, "source").groupBy("source").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_checkpoints_need_a_shared_folder_on_a_cluster(monkeypatch):
    class Nowhere:
        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

        def sc(self):
            return self

    class Context:
        master = "spark://host:7077"
        _jsc = Nowhere()

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="share"):
        session.checkpoint_folder(Session())


def test_scratch_folders_differ(spark):
    assert session.scratch(spark, "a") != session.scratch(spark, "a")


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    df = spark.createDataFrame([("x" * 1000, [1, 2], 3), (None, None, None)], "s string, a array<int>, n int")
    assert session.small_enough(df, 2) and not session.small_enough(df, 1) and not session.small_enough(df, 2, 1000)
    assert session.small_enough(df.limit(0), 0, 0)
    broadcast = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert broadcast(session.maybe_broadcast(df, 2)) and not broadcast(session.maybe_broadcast(df, 2, 1000))
