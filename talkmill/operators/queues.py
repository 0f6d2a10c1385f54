"""Review queues: ordered unions, numbering, cascading priorities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled


def numeric_key(key: Column) -> Column:
    """A sort key: whole numbers by their value, then what isn't one."""
    value = F.trim(key).try_cast("long")
    return F.struct(value.isNull().alias("other"), value.alias("value"))


def ordered_union(*parts: DataFrame) -> DataFrame:
    """Parts in turn, with part telling which."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)))


#: Runs (of one group in one partition) up to which their offsets are broadcast; beyond, they are joined by shuffle.
BROADCAST_RUNS = 200_000


def numbered(rows: DataFrame, *order, within: tuple[str, ...] = ()) -> DataFrame:
    """rows plus number, from 1 in a total order (of each group of `within`), without one task for all or for a group.

    Rows are dealt by range and sorted once, and kept with their partition and place in it: were they dealt twice, the
    bounds could differ. A group's rows in one partition are a run; runs are counted, and each starts after the group's
    runs before it. There are no more runs than partitions and groups together.
    """
    ranged = rows.withColumns({"__group": F.struct(*within) if within else F.lit(0), "__order": F.struct(*within, *order)})
    split = settled(ranged.repartitionByRange("__order").sortWithinPartitions("__order").drop("__order").withColumn("__at", F.monotonically_increasing_id()))
    split = split.withColumn("__part", F.shiftright("__at", 33))
    runs = split.groupBy("__group", "__part").agg(F.count("*").alias("size"), F.min("__at").alias("start"))
    earlier = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settled(runs.select("__group", "__part", (F.coalesce(F.sum("size").over(earlier), F.lit(0)) - F.col("start") + 1).alias("__offset")))
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_RUNS else offsets
    return split.join(offsets, ["__group", "__part"]).withColumn("number", F.col("__at") + F.col("__offset")).drop("__group", "__part", "__at", "__offset")


def priority_queue(review: DataFrame, key: str, order: str, rules: list[tuple[str, Column]], limit: int) -> DataFrame:
    """review plus bucket, rank, reason: rules fill up to `limit` in turn, each key once under its first rule and row; the rest is backup.
    The last rule takes any row, so the cascade equals ranking by (first matching rule, order)."""
    rule, name = F.lit(len(rules)), F.lit("balanced_fill")
    for i, (n, test) in reversed(list(enumerate(rules))):
        rule, name = F.when(test, i).otherwise(rule), F.when(test, n).otherwise(name)
    marked = review.withColumns({"__rule": rule, "__name": name})
    first = marked.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__rule", order))).where("__n = 1")
    top = first.orderBy("__rule", order).limit(limit).select(key, F.col("__rule").alias("r"), F.col(order).alias("o"))
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy("r", "o"))).select(F.col(key).alias("__key"), F.col("o").alias("__o"), "rank")
    out = marked.join(F.broadcast(ranked), (F.col(key) == F.col("__key")) & (F.col(order) == F.col("__o")), "left")
    picked = F.col("rank").isNotNull()
    return out.withColumns({"bucket": F.when(picked, "priority").otherwise("backup"), "reason": F.when(picked, F.col("__name")).otherwise("")}).drop("__rule", "__name", "__key", "__o")
