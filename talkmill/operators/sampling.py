"""Repeatable samples: every order is md5 of seed and key, so no result depends on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled
from .metrics import order_statistics
from .queues import BROADCAST_RUNS, numbered


def draw(seed: str, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in keys)))


def tercile_cuts(rows: DataFrame, score: str) -> DataFrame:
    """One row (low, high): scores at index floor((n-1)/3) and floor(2(n-1)/3) of the sorted scores."""
    _, found = order_statistics(rows, score, lambda n: [(n - 1) // 3, 2 * (n - 1) // 3])
    low, high = found or (None, None)
    return rows.sparkSession.createDataFrame([(low, high)], "low double, high double")


def tercile(score: Column) -> Column:
    return F.when(score <= F.col("low"), "low").when(score <= F.col("high"), "mid").otherwise("high")


def water_fill(strata: DataFrame, parent: list[str], child: str, seed: str) -> DataFrame:
    """strata (parent.., child, available, quota of the parent) -> parent.., child, quota: one unit to each child with room per round, in md5 order of the round, until the parent's quota is out."""
    units = strata.select(*parent, child, "quota", F.explode(F.sequence(F.lit(1).cast("long"), F.least("available", "quota"))).alias("pass"))
    order = Window.partitionBy(*(parent or [F.lit(1)])).orderBy("pass", draw(seed, child, "pass"))
    return units.withColumn("rank", F.row_number().over(order)).where("rank <= quota").groupBy(*parent, child).agg(F.count("*").alias("quota"))


def stratified_sample(rows: DataFrame, key: str, levels: list[str], size: int, seed: str) -> DataFrame:
    """`size` rows spread evenly over nested levels as far as there are rows, numbered in md5 order. Keys are unique.

    Quotas come from the small table of counts. As draws are even, the first of a stratum lie below a limit that counts and quota
    give, six deviations and some beyond what is needed; so few rows are numbered, without one task for a stratum.
    Should a stratum have too few below its limit, all rows are numbered instead, with the same result.
    """
    available = rows.count()
    if size < 1 or size > available:
        raise ValueError(f"size {size} must be from 1 to {available}")
    quota = None
    for depth, level in enumerate(levels):
        parent = levels[:depth]
        counts = rows.groupBy(*parent, level).agg(F.count("*").alias("available"))
        counts = counts.withColumn("quota", F.lit(size).cast("long")) if quota is None else counts.join(quota, parent)
        quota = water_fill(counts, parent, level, seed)
    limits = settled(counts.select(*levels, "available").join(quota, levels))
    share = F.least(F.lit(1.0), (F.col("quota") + 6 * F.sqrt("quota") + 20) / F.col("available"))
    narrow = rows.select(key, *levels).withColumn("__draw", draw(seed, key)).join(F.broadcast(limits) if limits.count() <= BROADCAST_RUNS else limits, levels)
    below = F.conv(F.left("__draw", F.lit(8)), 16, 10).cast("double") <= share * 2.0**32
    first = lambda some: settled(numbered(some, "__draw", key, within=tuple(levels)).where("number <= quota").select(key, *levels))
    chosen = first(narrow.where(below))
    held = chosen.groupBy(*levels).agg(F.count("*").alias("held"))
    if not limits.join(held, levels, "left").where(F.coalesce("held", F.lit(0)) < F.least("quota", "available")).isEmpty():
        chosen = first(narrow)
    chosen = chosen.select(key)
    picked = rows.join(chosen, key)
    return picked.withColumn("sample_no", F.row_number().over(Window.orderBy(draw(f"{seed}|order", key), key)))


def balanced_subset(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """At most `most` rows, taken in turn from the groups in the order in which these first appear."""
    first = rows.groupBy(group).agg(F.min(order).alias("first"))
    place = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("turn", F.row_number().over(place)).where(F.col("turn") <= most).join(F.broadcast(first), group).orderBy("turn", "first").limit(most).drop("turn", "first")


def sample_per_group(rows: DataFrame, group: str, key: str, k: int, seed: str) -> DataFrame:
    place = Window.partitionBy(group).orderBy(draw(seed, key), key)
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).drop("place")


def stratified_split(rows: DataFrame, label: str, key: str, test: float, validation: float, seed: str) -> DataFrame:
    """rows plus split: of each class `test` of all, then `validation` of what is left, rounded; the rest is train. No class is sorted in one task."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    n_test = F.round(F.col("n") * test)
    n_val = F.round((F.col("n") - n_test) * validation)
    ranked = numbered(rows.withColumn("__draw", draw(seed, key)), "__draw", key, within=(label,)).join(counts, label)
    return ranked.withColumn("split", F.when(F.col("number") <= n_test, "test").when(F.col("number") <= n_test + n_val, "validation").otherwise("train")).drop("number", "n", "__draw")


def keep_one(rows: DataFrame, key: str, order: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order) if last else F.asc(order)))).where("place = 1").drop("place")
