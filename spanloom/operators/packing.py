"""First-fit packing of sample lengths into bounded batches.

The state works on lengths only: a shard's samples arrive in order, and what
comes out is a list of (pack, instance, sample, tokens, status). The same state
class serves the batch adapter (applyInPandas per shard) and the streaming one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.arrays import pad_right

PACKED, TRUNCATED, DISCARDED = "packed", "truncated", "discarded"
SCHEMA = "shard int, pack_id bigint, instance_ord int, id bigint, n_tokens bigint, status string"


@dataclass(frozen=True)
class Limits:
    """max_tokens and max_instances of a pack, length from which a sample stands alone, buffers held."""

    max_tokens: int = 16384
    max_instances: int = 4
    long_threshold: int = 4096
    max_buffers: int = 100
    allow_overflow: bool = True
    tight: bool = False

    def __post_init__(self) -> None:
        if self.threshold > self.max_tokens:
            raise ValueError("the long threshold exceeds the tokens of a pack")

    @property
    def threshold(self) -> int:
        return self.long_threshold or self.max_tokens // 2


@dataclass(frozen=True)
class Sample:
    """A sample's id and length; whether cutting it at the pack's limit keeps images and reflection tokens whole."""

    id: int
    tokens: int
    cuttable: bool = True


@dataclass
class Buffer:
    """Samples gathered so far; first is the ordinal of its first sample, kept when a buffer is split off."""

    samples: list[Sample]
    first: int = 0

    @property
    def tokens(self) -> int:
        return sum(s.tokens for s in self.samples)

    @property
    def is_single(self) -> bool:
        return self.first + len(self.samples) == 1


@dataclass
class Packer:
    """Buffers in descending length, and the packs made ready."""

    limits: Limits
    held: list[Buffer] = field(default_factory=list)
    packs: int = 0

    def _find(self, sample: Sample) -> Buffer | None:
        lim = self.limits
        if sample.tokens >= lim.threshold:
            return None
        spare = None
        for at, buffer in enumerate(self.held):
            if len(buffer.samples) >= lim.max_instances:
                continue
            if buffer.tokens + sample.tokens <= lim.max_tokens:
                return self.held.pop(at)
            if lim.allow_overflow and len(self.held) >= lim.max_buffers // 2:
                spare = at
        return None if spare is None else self.held.pop(spare)

    def _hold(self, buffer: Buffer) -> None:
        size = buffer.tokens
        at = next((i for i, b in enumerate(self.held) if b.tokens < size), len(self.held))
        self.held.insert(at, buffer)

    def _settle(self, buffer: Buffer) -> Iterator[tuple[Buffer, str]]:
        """Buffers to emit, with their status; the rest is held."""
        lim = self.limits
        if buffer.is_single:
            sample = buffer.samples[0]
            if sample.tokens < lim.threshold:
                self._hold(buffer)
            elif sample.tokens <= lim.max_tokens:
                yield buffer, PACKED
            elif sample.cuttable:
                yield Buffer([Sample(sample.id, lim.max_tokens)]), TRUNCATED
            else:
                yield buffer, DISCARDED
            return
        if lim.tight and buffer.tokens == lim.max_tokens:
            yield buffer, PACKED
            return
        if buffer.tokens < lim.max_tokens:
            if len(buffer.samples) < lim.max_instances:
                self._hold(buffer)
            else:
                yield buffer, PACKED
            return
        while buffer.tokens >= lim.max_tokens:
            left = Buffer(buffer.samples[:-1], buffer.first)
            right = Buffer(buffer.samples[-1:], buffer.first + len(buffer.samples) - 1)
            if left.tokens < right.tokens:
                left, right = right, left
            yield left, PACKED
            buffer = right
        self._hold(buffer)

    def _rows(self, buffer: Buffer, status: str) -> list[tuple[int, int, int, int, str]]:
        pack = -1 if status == DISCARDED else self.packs
        self.packs += status != DISCARDED
        return [(pack, i, s.id, s.tokens, status) for i, s in enumerate(buffer.samples)]

    def add(self, sample: Sample) -> list[tuple[int, int, int, int, str]]:
        """Take a sample; the rows of what is ready then."""
        found = self._find(sample)
        buffer = Buffer([sample]) if found is None else Buffer([*found.samples, sample], found.first)
        out = []
        for ready, status in self._settle(buffer):
            out += self._rows(ready, status)
        while len(self.held) > self.limits.max_buffers:
            out += self._rows(self.held.pop(0), PACKED)
        return out

    def flush(self) -> list[tuple[int, int, int, int, str]]:
        """The rows of all that is still held, longest first."""
        out = []
        while self.held:
            out += self._rows(self.held.pop(0), PACKED)
        return out


def pack_shard(rows: pd.DataFrame, limits: Limits) -> pd.DataFrame:
    rows = rows.sort_values(["ord", "id"], kind="stable")
    packer, out = Packer(limits), []
    for i, n, c in zip(rows["id"], rows["n_tokens"], rows["cuttable"], strict=True):
        out += packer.add(Sample(int(i), int(n), bool(c)))
    out += packer.flush()
    made = pd.DataFrame(out, columns=["pack_id", "instance_ord", "id", "n_tokens", "status"])
    made.insert(0, "shard", rows["shard"].iloc[0] if len(rows) else 0)
    return made


def pack_first_fit(samples: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Pack samples (shard, ord, id, n_tokens, and cuttable if there is such a column) shard by shard.

    Arrival order is ord, then id. pack_id counts per shard; a discarded sample
    has pack_id -1. A shard is one ordered stream, so their number must grow
    with the data (see sampling.shards_for). Null lengths count as 0; repeated
    rows are packed as often as they came in; an empty table gives none.
    """
    limits = limits or Limits()
    cut = F.coalesce(F.col("cuttable"), F.lit(True)) if "cuttable" in samples.columns else F.lit(True)
    rows = samples.select(F.col("shard").cast("int").alias("shard"), "ord", F.col("id").cast("bigint").alias("id"), F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)).alias("n_tokens"), cut.alias("cuttable"))
    apart = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")  # light in bytes, heavy in work: not to be merged
    return apart.groupBy("shard").applyInPandas(lambda part: pack_shard(part, limits), SCHEMA)


def collate(packed: DataFrame, samples: DataFrame, max_tokens: int, pad: int = 0) -> DataFrame:
    """(shard, pack_id, instance_ord, id, ids, labels, mask) of what is packed: every pack's rows padded on the right to its longest.

    samples: id, ids, labels, unique by id. A sample cut by the packer keeps its
    first max_tokens tokens; a discarded one is left out. Padding has the id
    pad, no label and no mask.
    """
    kept = packed.where(F.col("status") != DISCARDED).select("shard", "pack_id", "instance_ord", "id", F.col("n_tokens").alias("_n"))
    longest = kept.groupBy("shard", "pack_id").agg(F.max("_n").alias("_longest"))
    rows = kept.join(longest, ["shard", "pack_id"]).join(samples.select("id", "ids", "labels"), "id")
    cut = lambda c: F.slice(c, F.lit(1), F.col("_n").cast("int"))
    mask = F.array_repeat(F.lit(1).cast("bigint"), F.col("_n").cast("int"))
    return rows.select("shard", "pack_id", "instance_ord", "id", pad_right(cut("ids"), F.col("_longest"), pad).alias("ids"), pad_right(cut("labels"), F.col("_longest"), config.IGNORE_INDEX).alias("labels"), pad_right(mask, F.col("_longest"), 0).alias("mask"))


def pack_statistics(packed: DataFrame, max_tokens: int) -> DataFrame:
    """Per shard: packs, instances, tokens, unused tokens and discarded samples."""
    kept = F.col("status") != DISCARDED
    per_pack = packed.groupBy("shard", "pack_id", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    return per_pack.groupBy("shard").agg(
        F.sum(kept.cast("bigint")).alias("packs"),
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("instances"),
        F.sum(F.when(kept, F.col("t")).otherwise(0)).alias("tokens"),
        F.sum(F.when(kept, max_tokens - F.col("t")).otherwise(0)).alias("unused"),
        F.sum(F.when(~kept, F.col("n")).otherwise(0)).alias("discarded"),
    )


def discarded_reflection_tokens(ids: object, cut: int, token: int) -> object:
    """How many of an array's tokens after the cut are reflection tokens."""
    return F.size(F.filter(F.slice(ids, cut + 1, F.greatest(F.size(ids) - cut, F.lit(0))), lambda x: x == token))
