"""Pivots, expansions, controls and blind copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settled
from .queues import numbered
from .sampling import draw


def round_robin(good: DataFrame, bad: DataFrame, group: str, order: str, bad_order: str, other: str = "other") -> DataFrame:
    """(order, bad_order): the k-th good row of a group with a bad row, number k modulo theirs: of the same group, or of
    group `other` (null groups are it) where it has none, or of all where that has none either. Without bad rows there is no pair.

    No group is sorted in one task (numbered()); only counts by group say where a group's partners come from.
    """
    return _in_turn(_in_groups(good, group, order, other), bad, group, order, bad_order, other)


def _in_groups(rows: DataFrame, group: str, order: str, other: str) -> DataFrame:
    """(group, order, k): rows numbered from 0 in their group."""
    return numbered(rows.select(F.coalesce(group, F.lit(other)).alias(group), order), order, within=(group,)).select(group, order, (F.col("number") - 1).alias("k"))


def _in_turn(good: DataFrame, bad: DataFrame, group: str, order: str, bad_order: str, other: str) -> DataFrame:
    """round_robin() of good rows that are numbered already."""
    b = _in_groups(bad, group, bad_order, other).select(bad_order, F.col(group).alias("__of"), F.col("k").alias("r"))
    n = b.groupBy("__of").agg(F.count("*").alias("n"))
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max(F.when(F.col("__of") == other, F.col("n"))), F.lit(0)).alias("others"))
    source = settled(
        good.select(group).distinct().join(n, F.col(group) == F.col("__of"), "left").crossJoin(F.broadcast(total)).select(
            group, F.when(F.col("n") > 0, F.col(group)).when(F.col("others") > 0, other).alias("__of"), F.when(F.col("n") > 0, F.col("n")).when(F.col("others") > 0, F.col("others")).otherwise(F.col("total")).alias("n")
        )
    )
    if not source.where("__of is null and n > 0").isEmpty():
        every = numbered(bad.select(bad_order), bad_order).select(bad_order, F.lit(None).cast(b.schema["__of"].dataType).alias("__of"), (F.col("number") - 1).alias("r"))
        b = b.unionByName(every)
    asked = good.join(source.where("n > 0"), group).select(order, "__of", F.pmod("k", "n").alias("r"))
    return asked.join(b, asked["__of"].eqNullSafe(b["__of"]) & (asked["r"] == b["r"])).select(order, bad_order)


def blind(rows: DataFrame, hidden: list[str], blanks: list[str]) -> DataFrame:
    """rows without what raters must not see, and with empty columns for their answers."""
    return rows.drop(*hidden).withColumns({b: F.lit("") for b in blanks})


def unpivot_scores(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, source, score)."""
    return rows.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("source"), F.col(c).alias("score")) for c in columns))).alias("x")).select(key, "x.*")


def distributions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of several columns at once."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns))).alias("x"))
    return long.groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def seeded_swap(rows: DataFrame, key: str, a: str, b: str, seed: str) -> DataFrame:
    """rows with a and b exchanged where the hash of the key is odd, and swapped telling so."""
    odd = F.conv(F.substring(draw(seed, key), 1, 1), 16, 10).cast("int") % 2 == 1
    return rows.withColumns({"swapped": odd, a: F.when(odd, F.col(b)).otherwise(F.col(a)), b: F.when(odd, F.col(a)).otherwise(F.col(b))})


def control_pairs(clean: DataFrame, partner: DataFrame, negative: DataFrame, boundary: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """(pair_type, good, other, left, right, swapped): clean against another clean row, a negative, a flagged one, and itself (a tie). Each side has (key, group)."""

    numbers = _in_groups(clean, group, key, "other")

    def against(kind: str, other: DataFrame) -> DataFrame:
        renamed = other.select(F.col(key).alias("other"), group)
        return _in_turn(numbers, renamed, group, key, "other", "other").select(F.lit(kind).alias("pair_type"), F.col(key).alias("good"), "other")

    itself = clean.select(F.lit("duplicate_tie").alias("pair_type"), F.col(key).alias("good"), F.col(key).alias("other"))
    every = against("clean", partner).unionByName(against("negative", negative)).unionByName(against("boundary", boundary)).unionByName(itself)
    return seeded_swap(every.withColumns({"pair_key": F.concat_ws("/", "pair_type", "good"), "left": F.col("good"), "right": F.col("other")}), "pair_key", "left", "right", seed).drop("pair_key")


def counted_exclusions(marked: DataFrame, reasons: list[str]) -> DataFrame:
    """(exclusion, n) of each reason, in their order and 0 where none has it."""
    counts = marked.agg(*(F.count_if(F.col("exclusion") == r).alias(r) for r in reasons))
    return counts.select(F.posexplode(F.array(*(F.struct(F.lit(r).alias("exclusion"), F.col(r).alias("n")) for r in reasons))).alias("position", "x")).select("position", "x.*")


def pair_profile(pairs: DataFrame, counted: list[str], texts: list[str], reasons: str, most: int = 20) -> DataFrame:
    """(part, value, n) of a package of pairs: total, counts of each column's values, least, largest and mean length of the
    texts (mean to one place, as text), and the `most` commonest reasons, of equals the first by name."""
    total = pairs.agg(F.count("*").alias("n")).select(F.lit("total").alias("part"), F.lit("pairs").alias("value"), F.col("n").cast("double"))
    counts = distributions(pairs, counted).select(F.concat(F.lit("by_"), F.col("column")).alias("part"), "value", F.col("n").cast("double"))
    lengths = pairs.select(F.explode(F.array(*(F.length(F.coalesce(t, F.lit(""))) for t in texts))).alias("x"))
    spans = lengths.agg(F.coalesce(F.min("x"), F.lit(0)).alias("min"), F.coalesce(F.max("x"), F.lit(0)).alias("max"), F.coalesce(F.round(F.avg("x"), 1), F.lit(0.0)).alias("avg"))
    spans = spans.select(F.explode(F.array(*(F.struct(F.lit(n).alias("value"), F.col(n).cast("double").alias("n")) for n in ("min", "max", "avg")))).alias("s")).select(F.lit("length").alias("part"), "s.value", "s.n")
    common = pairs.select(F.explode(reasons).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)
    return total.unionByName(counts).unionByName(spans).unionByName(common.select(F.lit("top_reason").alias("part"), "value", F.col("n").cast("double")))
