"""Mix sources to target weights, repeating small sources a capped number of times.

Weights are propagated through a tree of sources (say domain, language,
source). A node that can't fill its budget passes the shortage to its siblings
and only what they can't take to its ancestors' siblings. Each leaf then takes
whole epochs and a prefix of one more, every epoch being a seeded permutation
of the leaf. The prefix is cut by sums over hash buckets, so no source is ever
sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed, maybe_broadcast
from .languages import language_of

SEED = 42
#: Sources (or parts of them) up to which a mixture is planned on the driver.
MAX_DRIVER = 100_000
#: Rows of a hash bucket aimed at; the bucket in which a prefix ends is sorted in one task.
BUCKET_ROWS = 20_000
BROADCAST_ROWS = 1_000_000


@dataclass
class Node:
    """A source, or a group of nodes. A leaf has a weight and a capacity of its own."""

    name: str
    weight: float = 0.0
    capacity: int = 0
    children: dict[str, Node] = field(default_factory=dict)
    budget: int = 0

    def close(self) -> None:
        """Sum weights and capacities up from the leaves."""
        for child in self.children.values():
            child.close()
        if self.children:
            self.weight = sum(c.weight for c in self.children.values())
            self.capacity = sum(c.capacity for c in self.children.values())

    def spend(self, budget: int) -> None:
        """Hand a budget down; what a child can't take goes to its siblings."""
        self.budget = min(budget, self.capacity)
        children = [self.children[k] for k in sorted(self.children)]
        for child, part in zip(children, fill([c.weight for c in children], [c.capacity for c in children], self.budget), strict=True):
            child.spend(part)


def fill(weights: list[float], capacities: list[int], budget: int) -> list[int]:
    """Whole parts of a budget in proportion to weights, none over its capacity.

    Shares of the capped are spread over the others by weight, then, should
    only children without weight have room, over those by capacity. Remainders
    go to the largest fractions, the first of equal ones.
    """
    budget = min(budget, sum(capacities))
    parts = [0.0] * len(weights)
    for measure in (weights, capacities):
        free = {i for i, w in enumerate(measure) if w > 0 and parts[i] < capacities[i]}
        left = budget - sum(parts)
        while free and left > 1e-9:
            total = sum(measure[i] for i in free)
            full = {i for i in free if parts[i] + left * measure[i] / total >= capacities[i]}
            if not full:
                for i in free:
                    parts[i] += left * measure[i] / total
                break
            for i in full:
                parts[i] = float(capacities[i])
            free -= full
            left = budget - sum(parts)
    whole = [min(math.floor(p + 1e-9), c) for p, c in zip(parts, capacities, strict=True)]
    order = sorted(range(len(parts)), key=lambda i: (whole[i] - parts[i], i))
    rest = budget - sum(whole)
    while rest > 0:
        given = 0
        for i in order:
            if rest and whole[i] < capacities[i] and (parts[i] > 0 or sum(whole) >= sum(parts)):
                whole[i] += 1
                rest -= 1
                given += 1
        if not given:
            break
    return whole


def exact_total(shares: list[float], capacities: list[int]) -> int:
    """The largest total at which every source that has records can take its whole share."""
    limits = [c / s for s, c in zip(shares, capacities, strict=True) if s > 0 and c > 0]
    return math.floor(min(limits) + 1e-6) if limits else 0


def plan_budgets(sources: list[dict], levels: list[str], total: int | None) -> list[int]:
    """Records to take of each source; sources have ds_name, target_share, capacity and the levels above them."""
    if total is None:
        total = exact_total([s["target_share"] for s in sources], [s["capacity"] for s in sources])
    root, leaves = Node(""), []
    for s in sources:
        node = root
        for level in [*levels, "ds_name"]:
            node = node.children.setdefault(str(s[level]), Node(str(s[level])))
        node.weight, node.capacity = s["target_share"], s["capacity"]
        leaves.append(node)
    root.close()
    root.spend(total)
    return [leaf.budget for leaf in leaves]


def source_name(name: Column) -> Column:
    """Names that differ in case or outer blanks are one source."""
    return F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))


def clean_path(path: Column) -> Column:
    """A path without outer blanks, leading ./ and doubled slashes."""
    trimmed = F.regexp_replace(path, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, "/+", "/"), r"^(?:\./)+", "")


def source_table(manifest: DataFrame) -> DataFrame:
    """(path, ds_name, domain): the source of each record file; of a file listed for several sources, the first by name."""
    rows = manifest.select(clean_path(F.col("data_path")).alias("path"), source_name(F.col("ds_name")).alias("ds_name"), F.regexp_extract(F.coalesce("image_folder", F.lit("")), "^/*([^/]*)", 1).alias("domain"))
    rows = rows.where(F.col("path").isNotNull() & F.col("ds_name").isNotNull())
    one = rows.groupBy("path").agg(F.min("ds_name").alias("ds_name"))
    domains = rows.groupBy("ds_name").agg(F.max("domain").alias("domain"))
    return one.join(domains, "ds_name").select("path", "ds_name", "domain")


def sourced_records(visuals: DataFrame, videos: DataFrame, manifest: DataFrame) -> DataFrame:
    """(tbl, rec_id, ds_name) of every record whose file the manifest lists, redelivery ignored."""

    def one(df: DataFrame, tbl: str, key: str) -> DataFrame:
        latest = df.groupBy(F.col(key).alias("rec_id")).agg(F.max(F.struct("loaded_at", "data_path")).alias("p"))
        return latest.select(F.lit(tbl).alias("tbl"), "rec_id", clean_path(F.col("p.data_path")).alias("path"))

    records = one(visuals, "visual_records", "conv_id").unionByName(one(videos, "video_records", "rec_id"))
    return records.join(maybe_broadcast(source_table(manifest).select("path", "ds_name"), BROADCAST_ROWS), "path").select("tbl", "rec_id", "ds_name")


@F.pandas_udf(T.StringType())
def spoken(texts: pd.Series) -> pd.Series:
    """The language of each text; "other" where it can't be told."""
    return pd.Series([language_of(t) if t else "other" for t in texts], dtype="object")


def record_languages(videos: DataFrame, turns: DataFrame) -> DataFrame:
    """(tbl, rec_id, lang) of records by their own text: a video record's question, a conversation's first prompt that is more than a marker."""
    asked = F.regexp_replace("text", r"(?iU)<image>|\s+please provide the bounding box.*|^\s+|\s+$", "")
    prompts = turns.where(F.col("role").isin("human", "user")).select(F.col("conv_id").alias("rec_id"), "turn", asked.alias("text")).where(F.length("text") > 0)
    first = prompts.groupBy("rec_id").agg(F.min(F.struct("turn", "text"))["text"].alias("text"))
    last = videos.groupBy("rec_id").agg(F.max(F.struct("loaded_at", "question"))["question"].alias("text"))
    both = first.select(F.lit("visual_records").alias("tbl"), "rec_id", "text").unionByName(last.select(F.lit("video_records").alias("tbl"), "rec_id", "text"))
    return both.select("tbl", "rec_id", spoken("text").alias("lang"))


def plan_mixture(records: DataFrame, targets: DataFrame, groups: DataFrame, levels: list[str], total: int | None = None, by: Sequence[str] = (), max_driver: int = MAX_DRIVER) -> DataFrame:
    """(levels, by, ds_name, target_share, max_repeats, n_records, capacity, used, actual_share) of each source with a target.

    records: tbl, rec_id, ds_name; targets: ds_name, target_share, max_repeats;
    groups: ds_name and the levels above it. by names columns of records that
    stand in the tree between the levels and the source and part it: a source's
    share is divided among its parts by their records. total is the number of
    records to draw; by default the largest at which every source that has
    records takes exactly its share. Shares of sources named alike are added,
    the least of their max_repeats holds; null shares count 0, null max_repeats
    1, null parts "other". A source without records takes none and its share
    passes on. Up to max_driver sources are planned on the driver, more of them
    level by level on the workers, to the same result.
    """
    spark = records.sparkSession
    names = targets.select(source_name(F.col("ds_name")).alias("ds_name"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("s"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).cast("bigint").alias("m"))
    wanted = names.where(F.col("ds_name").isNotNull()).groupBy("ds_name").agg(F.sum("s").alias("target_share"), F.min("m").alias("max_repeats"))
    counts = records.groupBy("ds_name", *(F.coalesce(c, F.lit("other")).alias(c) for c in by)).agg(F.count(F.lit(1)).alias("n_records"))
    above = groups.groupBy("ds_name").agg(*(F.max(F.col(c)).alias(c) for c in levels)) if levels else groups.select("ds_name").distinct()
    paths = [*levels, *by, "ds_name"] if by else ["ds_name"]
    whole = counts.groupBy("ds_name").agg(F.sum("n_records").alias("all_records"))
    leaves = wanted.join(counts, "ds_name", "left").join(whole, "ds_name", "left").join(above, "ds_name", "left").fillna(0, ["n_records"])
    part = F.coalesce(F.col("n_records") / F.col("all_records"), F.lit(1.0))
    columns = [*dict.fromkeys([*levels, *by, "ds_name"])]
    leaves = leaves.select(*columns, (F.col("target_share") * part).alias("target_share"), "max_repeats", "n_records", (F.col("n_records") * F.col("max_repeats")).alias("capacity"))
    schema = ", ".join(f"{c} string" for c in paths) + ", target_share double, max_repeats bigint, n_records bigint, capacity bigint, used bigint, actual_share double"
    leaves = checkpointed(leaves)
    if leaves.limit(max_driver + 1).count() > max_driver:
        return plan_by_levels(leaves, [*levels, *by], total).select(*paths, "target_share", "max_repeats", "n_records", "capacity", "used", "actual_share")
    rows = [r.asDict() for r in leaves.orderBy("ds_name", *by).collect()]
    budgets = plan_budgets(rows, [*levels, *by], total)
    drawn = sum(budgets)
    out = [(*(r[c] for c in paths), float(r["target_share"]), r["max_repeats"], r["n_records"], r["capacity"], used, used / drawn if drawn else 0.0) for r, used in zip(rows, budgets, strict=True)]
    return spark.createDataFrame(out, schema)


def _sharing(path: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Share a node's budget among its children, the nodes of a path's last column."""

    def share(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(path[-1], kind="stable")
        budget = int(min(group["budget"].iloc[0], group["capacity"].sum()))
        return group.assign(budget=fill(group["weight"].tolist(), group["capacity"].tolist(), budget))[[*path, "budget"]]

    return share


def plan_by_levels(leaves: DataFrame, levels: list[str], total: int | None) -> DataFrame:
    """leaves with used and actual_share, planned level by level on the workers: for more sources than a driver should hold.

    Each step shares the budgets of the nodes of one level among their
    children, as Node.spend does; a task holds the children of one node.
    """
    spark = leaves.sparkSession
    if total is None:
        limit = leaves.where("target_share > 0 and capacity > 0").agg(F.min(F.col("capacity") / F.col("target_share"))).first()[0]
        total = math.floor(limit + 1e-6) if limit is not None else 0
    named = leaves.withColumns({f"_{c}": F.coalesce(F.col(c), F.lit("None")) for c in levels})
    path = [f"_{c}" for c in levels]
    room = leaves.agg(F.coalesce(F.sum("capacity"), F.lit(0))).first()[0]
    budgets = spark.createDataFrame([(min(total, room),)], "budget bigint")
    for depth in range(len(path) + 1):
        above, child = path[:depth], path[depth] if depth < len(path) else "ds_name"
        nodes = named.groupBy(*above, child).agg(F.sum("target_share").alias("weight"), F.sum("capacity").alias("capacity"))
        given = nodes.join(budgets, above) if above else nodes.join(F.broadcast(budgets))

        schema = ", ".join(f"{c} string" for c in [*above, child]) + ", budget bigint"
        grouped = given.groupBy(*above) if above else given.groupBy("budget")
        budgets = checkpointed(grouped.applyInPandas(_sharing([*above, child]), schema))
    used = named.join(budgets, [*path, "ds_name"]).withColumn("used", F.col("budget")).drop("budget", *path)
    total_used = used.agg(F.sum("used").alias("_all"))
    return used.join(F.broadcast(total_used)).withColumn("actual_share", F.when(F.col("_all") > 0, F.col("used") / F.col("_all")).otherwise(F.lit(0.0))).drop("_all")


def draw_mixture(records: DataFrame, plan: DataFrame, seed: int = SEED, by: Sequence[str] = ()) -> DataFrame:
    """(tbl, rec_id, ds_name, use): the drawn records, one row for each use, use counting from 1.

    A source takes used div n_records whole epochs and the first used mod
    n_records records of the next, in the order of md5(seed_epoch_tbl_id). The
    same rows, plan and seed always give the same result. Sources without a
    plan give none. (tbl, rec_id) must be unique; extra columns are ignored. by
    is that of plan_mixture.
    """
    leaf = ["ds_name", *by]
    records = records.withColumns({c: F.coalesce(c, F.lit("other")) for c in by}) if by else records
    shares = plan.where("used > 0").select(*leaf, "n_records", F.expr("used div n_records").alias("epochs"), (F.col("used") % F.col("n_records")).alias("rest"))
    most = plan.agg(F.max("n_records")).first()[0] or 0
    digits = max(2, math.ceil(math.log(max(most / BUCKET_ROWS, 1), 16)))
    key = F.md5(F.concat_ws("_", F.lit(seed).cast("string"), F.col("epochs").cast("string"), F.coalesce("tbl", F.lit("")), F.coalesce(F.col("rec_id").cast("string"), F.lit(""))))
    rows = records.select("tbl", "rec_id", *leaf).join(maybe_broadcast(shares, BROADCAST_ROWS), leaf).withColumn("h", key).withColumn("bucket", F.substring("h", 1, digits))
    sums = rows.where("rest > 0").groupBy(*leaf, "rest", "bucket").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*leaf).orderBy("bucket")
    before = sums.withColumn("before", F.sum("n").over(order) - F.col("n")).where("before < rest")
    ends = checkpointed(before.select(*leaf, "bucket", "before", (F.col("before") + F.col("n") > F.col("rest")).alias("split")))
    placed = rows.join(maybe_broadcast(ends, BROADCAST_ROWS), [*leaf, "bucket"], "left")
    split = F.coalesce("split", F.lit(False))
    inner = placed.where(split).withColumn("rank", F.row_number().over(Window.partitionBy(*leaf, "bucket").orderBy("h", "tbl", "rec_id")))
    uses = inner.select("tbl", "rec_id", *leaf, (F.col("epochs") + (F.col("before") + F.col("rank") <= F.col("rest")).cast("bigint")).alias("uses")).unionByName(
        placed.where(~split).select("tbl", "rec_id", *leaf, (F.col("epochs") + F.col("before").isNotNull().cast("bigint")).alias("uses"))
    )
    return uses.where("uses > 0").select("tbl", "rec_id", *leaf, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("uses"))).alias("use"))
