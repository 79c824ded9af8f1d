"""Session helpers shared by every operator: settings, tables, checkpoints, spreading."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from functools import reduce
from operator import add
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side of a join is broadcast, whatever its rows.
BROADCAST_BYTES = 64 << 20
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("spanloom")
    settings = DEFAULTS | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(cores)} | conf
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers that don't find it on their path."""
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    known = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    if str(root) not in known and sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spanloom-"), "spanloom"), "zip", root, "spanloom"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one Parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of checkpoints and scratch tables, shared by all executors.

    It is the cluster's spark.checkpoint.dir. Only a local session, whose
    executors are this machine, may do without one and gets a temporary folder;
    elsewhere an executor's own disk would hide files from the others, so a
    missing setting is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="spanloom-checkpoint-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table that a query writes and reads again."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage that outlives an executor.

    Files of checkpoints that nothing refers to any longer are removed by
    Spark's cleaner where spark.cleaner.referenceTracking.cleanCheckpoints is
    set, as in DEFAULTS.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy Python stages on a plain scan at least one partition per core.

    A scan of a large table already has more partitions than cores and passes
    through unshuffled; only a small one is dealt out again. Where the plan has
    a shuffle, counting partitions would run it, so it passes through as well:
    see keyed.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "AdaptiveSparkPlan" in plan:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by keys into spark.sql.shuffle.partitions parts that stay apart.

    For aggregations and windows by (some of) these keys whose rows then go
    through CPU-heavy Python: they use this shuffle, and adaptive execution
    doesn't merge its parts, light in bytes as they may be.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row's values take: texts by their length, nested values by that of their JSON, others eight."""
    sizes = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.coalesce(F.octet_length(f.name), F.lit(0)) + 8)
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) + 8)
        else:
            sizes.append(F.lit(8))
    return reduce(add, sizes, F.lit(0)).cast("bigint")


def small_enough(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most max_rows rows of at most max_bytes together, looking at no more than that many rows."""
    n, size = df.select(row_bytes(df).alias("_bytes")).limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def maybe_broadcast(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast df only if its rows and bytes are proven to lie under the bounds."""
    return F.broadcast(df) if small_enough(df, max_rows, max_bytes) else df
