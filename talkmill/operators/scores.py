"""From repeated judge scores to winners and preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_dimensions(scores: Column, active: list[str]) -> Column:
    """map<string,int> of the active dimensions; missing or invalid ones are 0."""
    value = lambda d: F.coalesce(F.when(F.element_at(scores, d).rlike("^[012]$"), F.element_at(scores, d).cast("int")), F.lit(0))
    return F.create_map(*(x for d in active for x in (F.lit(d), value(d))))


def truncated_median(column: str) -> Column:
    """Aggregate: the median, cut to an integer."""
    return F.percentile(column, 0.5).cast("int")


def upper_median(raw: Column) -> Column:
    """Of a ;-joined list, ignoring what is no integer: the upper of the middle two; null if nothing is left."""
    values = F.array_sort(F.array_compact(F.transform(F.split(raw, ";"), lambda x: F.when(F.trim(x).rlike("^[+-]?[0-9]+$"), F.trim(x).cast("int")))))
    return F.get(values, (F.size(values) / 2).cast("int"))


def consolidate(repeats: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, er, ip, ex (truncated medians), boundary (any), reason (the first flagged one), rationale (the first)."""
    return repeats.groupBy(*keys).agg(
        *(truncated_median(c).alias(c) for c in ("er", "ip", "ex")),
        F.bool_or("boundary").alias("boundary"),
        F.coalesce(F.min(F.when(F.col("boundary"), F.struct(order, "reason")))["reason"], F.lit("")).alias("reason"),
        F.min(F.struct(order, "rationale"))["rationale"].alias("rationale"),
    )


def _ranked(candidates: DataFrame, group: str, total: str, flag: str, position: str) -> DataFrame:
    best = Window.partitionBy(group).orderBy(F.desc(total), position)
    return candidates.where(~F.col(flag)).withColumn("place", F.row_number().over(best))


def best_candidates(candidates: DataFrame, group: str, total: str, flag: str, position: str, name: str, fallback: str = "") -> DataFrame:
    """(group, best): the largest total among unflagged ones, the first of equals; fallback if all are flagged."""
    top = candidates.groupBy(group).agg(F.min(F.when(~F.col(flag), F.struct(-F.col(total), F.col(position), F.col(name).alias("name"))))["name"].alias("best"))
    return top.withColumn("best", F.coalesce("best", F.lit(fallback)))


def preference_pairs(candidates: DataFrame, group: str, total: str, flag: str, position: str, name: str) -> DataFrame:
    """(group, winner, loser): the two best unflagged candidates, unless their totals are equal."""
    two = _ranked(candidates, group, total, flag, position).where("place <= 2")
    made = two.groupBy(group).agg(*(F.max(F.when(F.col("place") == k, F.col(c))).alias(f"{c}_{k}") for k in (1, 2) for c in (name, total)))
    return made.where(F.col(f"{total}_1") > F.col(f"{total}_2")).select(group, F.col(f"{name}_1").alias("winner"), F.col(f"{name}_2").alias("loser"))


def metric_deltas(pairs: DataFrame, scores: DataFrame, group: str, name: str, metric: Column) -> DataFrame:
    """pairs plus delta: the winner's metric less the loser's; pairs without both scores drop out. metric is any expression over scores."""
    m = scores.select(group, F.col(name).alias("name"), metric.alias("metric"))
    won = pairs.join(m.withColumnRenamed("name", "winner").withColumnRenamed("metric", "won"), [group, "winner"])
    return won.join(m.withColumnRenamed("name", "loser").withColumnRenamed("metric", "lost"), [group, "loser"]).withColumn("delta", F.col("won") - F.col("lost")).drop("won", "lost")


def rescore_runs(runs: DataFrame) -> DataFrame:
    """Each run with change and flip flags against the original: er, ip, ex and first_er, first_ip, first_ex."""
    flags = {f"{d}_changed": F.col(d) != F.col(f"first_{d}") for d in ("er", "ip", "ex")}
    flags |= {f"{d}_flip": F.array_sort(F.array(F.col(d), F.col(f"first_{d}"))) == F.array(F.lit(1), F.lit(2)) for d in ("er", "ip", "ex")}
    return runs.withColumns(flags)


def rescore_summary(runs: DataFrame, keys: list[str], repeat: str) -> DataFrame:
    """By key: values in order of repeats, numbers of changes, whether repeats differ, and whether both 1 and 2 occur, original included."""

    def listed(d: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(repeat, d))), lambda x: x[d].cast("string")), ";")

    aggs = []
    for d in ("er", "ip", "ex"):
        aggs += [
            listed(d).alias(f"{d}_values"), F.count_if(F.col(d) != F.col(f"first_{d}")).alias(f"{d}_changes"),
            (F.min(d) != F.max(d)).alias(f"{d}_unstable"), ((F.bool_or(F.col(d) == 1) | F.bool_or(F.col(f"first_{d}") == 1)) & (F.bool_or(F.col(d) == 2) | F.bool_or(F.col(f"first_{d}") == 2))).alias(f"{d}_flip"),
        ]
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), *aggs)
