"""Put texts into containers of fixed capacity by sum-of-squares packing.

An item goes to the fill level that leaves the sum of squared counts of the
partly filled containers smallest; the counts stand in an array by level. Items
are placed one by one in the order of their ids and never moved again. They
are dealt to shards of bounded size that are packed independently, so a shard
wastes at most about one container in a thousand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

CAPACITY = 4096
#: Capacity of a shard, in containers, and the most items it may hold.
SHARD_CONTAINERS = 1024
SHARD_ITEMS = 100_000
#: Tasks that shards are dealt to at most.
MOST_TASKS = 20_000


class LevelPacker:
    """Containers by fill level. place() gives the container of an item and where in it the item begins."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0

    def _new(self) -> int:
        self.used += 1
        return self.used - 1

    def place(self, size: int) -> tuple[int, int]:
        """Items of size 0 go to the first container, at its start; a size over the capacity is refused."""
        cap, count = self.capacity, self.count
        if size > cap:
            raise ValueError("an item exceeds the capacity")
        if not size:
            if not self.used:
                self.open[0].append(self._new())
            return 0, 0
        best, level = 2 * count[size] + 1 if size < cap else 0, 0
        levels = np.flatnonzero(count[1 : cap - size + 1]) + 1
        if len(levels):
            after = levels + size
            change = 2 * (count[after] - count[levels] + 1)
            change[after == cap] = 1 - 2 * count[levels[after == cap]]
            least = change.min()
            if least <= best:
                level = int(levels[change == least][-1])
        if level:
            container = self.open[level].pop()
            count[level] -= 1
        else:
            container = self.open[0].pop() if self.open[0] else self._new()
        if level + size < cap:
            self.open[level + size].append(container)
            count[level + size] += 1
        return container, level


def _pack_shard(items: pd.DataFrame, capacity: int) -> pd.DataFrame:
    items = items.sort_values(["doc_id", "piece"], kind="stable")  # an order of arrival that every run repeats
    packer = LevelPacker(capacity)
    placed = [packer.place(int(n)) for n in items["n_tokens"]]
    base = items["shard"].astype("int64") * (1 << 32)
    at = np.array(placed, dtype=np.int64).reshape(-1, 2)
    return items.assign(container_id=base + at[:, 0], container_start=at[:, 1])[["doc_id", "piece", "token_start", "n_tokens", "container_id", "container_start"]]


def fill_containers(sizes: DataFrame, capacity: int = CAPACITY, shard_containers: int = SHARD_CONTAINERS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The container of every text or piece of (doc_id, n_tokens).

    (doc_id, piece, token_start, n_tokens, container_id, container_start): a
    text over the capacity is cut into full pieces and a rest, others stay
    whole (piece 0). A text of no tokens, or with a null count, lies at the
    start of some container. Repeated rows are packed as often as they came in;
    extra columns are ignored; an empty table gives an empty result.
    """
    counted = sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.greatest(F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    kept = checkpointed(counted)
    full = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1))
    total, items = kept.agg(F.sum("n"), F.sum(full)).first()
    shards = max(1, -(-(total or 0) // (shard_containers * capacity)), -(-(items or 0) // shard_items))
    start = F.col("piece") * capacity
    pieces = (
        kept.select("doc_id", "n", F.monotonically_increasing_id().alias("row"), F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)).alias("piece"))
        .select("doc_id", "piece", start.alias("token_start"), F.least(F.lit(capacity), F.col("n") - start).alias("n_tokens"), F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"))
    )
    schema = "doc_id bigint, piece bigint, token_start bigint, n_tokens bigint, container_id bigint, container_start bigint"
    spread_out = pieces.repartition(int(min(shards, MOST_TASKS)), "shard")  # light in bytes, heavy in work: not to be merged
    return spread_out.groupBy("shard").applyInPandas(lambda rows: _pack_shard(rows, capacity), schema)


def container_fill(packed: DataFrame) -> DataFrame:
    """(container_id, n_pieces, n_tokens) of each container."""
    return packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
