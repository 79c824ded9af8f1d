"""Structured Streaming forms of the packer and of the metric means."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.packing import SCHEMA, Limits, Packer, Sample

END = -1


def stream_pack(samples: DataFrame, limits: Limits | None = None) -> DataFrame:
    """First-fit packs of a stream of (shard, ord, id, n_tokens).

    Each shard's buffers are its state and survive a restart by the stream's
    checkpoint. A row with n_tokens END (-1) flushes its shard.
    """
    limits = limits or Limits()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        packer: Packer = pickle.loads(state.get[0]) if state.exists else Packer(limits)
        rows = pd.concat(list(parts)).sort_values(["ord", "id"], kind="stable")
        out: list[tuple] = []
        for i, n in zip(rows["id"], rows["n_tokens"], strict=True):
            out += packer.flush() if n == END else packer.add(Sample(int(i), int(n)))
        state.update((pickle.dumps(packer),))
        made = pd.DataFrame(out, columns=["pack_id", "instance_ord", "id", "n_tokens", "status"])
        made.insert(0, "shard", pd.Series([key[0]] * len(made), dtype="int32"))
        yield made

    return samples.groupBy("shard").applyInPandasWithState(step, SCHEMA, "packer binary", "append", GroupStateTimeout.NoTimeout)


def stream_metrics(metrics: DataFrame, step: str, *names: str) -> DataFrame:
    """Running means of the micro batches of each step: for update or complete mode."""
    return metrics.groupBy(step).agg(F.count(F.lit(1)).alias("n_micro"), *(F.avg(n).alias(n) for n in names))


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Drive an appending stream over what is there now into a Parquet table of a folder, and read it.

    The stream's position and state lie in the folder as well, so a second call
    with the same folder goes on where the first stopped, also after a loss of
    the driver; files of a batch that was cut off are never read.
    """
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/position").trigger(availableNow=True).start(f"{folder}/table")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def run_updates(stream: DataFrame, folder: str, *keys: str) -> DataFrame:
    """Drive a stream of updated aggregates over what is there now; of each key the latest values.

    Every batch of updates is a part of the table, overwritten if it is
    repeated after a loss.
    """

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/table/part={batch}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/position").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    parts = stream.sparkSession.read.option("recursiveFileLookup", "true").parquet(f"{folder}/table")
    values = [c for c in stream.columns if c not in keys]
    return parts.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v")).select(*keys, "v.*")
