"""Pair tables, order-swapped judgements, and what they agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.judge import map_choice, normalize_tags


def parse_judgement(rows: DataFrame, raw: str, keys: tuple[str, ...], audits: tuple[str, ...]) -> DataFrame:
    """rows plus winner (A, B or tie), comparisons (map by key), audit, error: of a missing or unknown winner or comparison."""
    text = F.coalesce(F.regexp_extract(F.col(raw), r"(?s)\{.*\}", 0), F.lit(""))

    def choice(value: Column) -> Column:
        plain = F.upper(F.regexp_replace(F.lower(F.trim(value)), "^candidate[ _]?", ""))
        return F.when(plain.isin("A", "B"), plain).when(plain.isin("TIE", "EQUAL", "DRAW"), "tie")

    winner = choice(F.get_json_object(text, "$.winner"))
    compared = {k: choice(F.get_json_object(text, f"$.epitome_comparison.{k}")) for k in keys}
    audit = F.coalesce(F.from_json(F.get_json_object(text, "$.audit"), "array<string>"), F.array().cast("array<string>"))
    error = F.when(F.try_parse_json(F.nullif(text, F.lit(""))).isNull(), "no_json").when(winner.isNull(), "winner")
    for k, c in compared.items():
        error = error.when(c.isNull(), f"comparison:{k}")
    return rows.withColumns({"winner": winner, "comparisons": F.create_map(*(x for k, c in compared.items() for x in (F.lit(k), c))), "audit": normalize_tags(audit, audits), "error": error})


def pair_table(long: DataFrame, key: str, candidate: str, columns: list[str], shared: list[str], names: tuple[str, str] = ("c1", "c2")) -> DataFrame:
    """One row per key with both candidates' columns (c1_x, c2_x) and the shared ones from either; incomplete pairs drop out."""
    side = F.struct(*columns, *shared)
    wide = long.where(F.col(candidate).isin(*names)).groupBy(key).agg(*(F.min(F.when(F.col(candidate) == n, side)).alias(n) for n in names))
    a, b = names
    return wide.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        key, *(F.coalesce(F.nullif(F.col(f"{a}.{s}"), F.lit("")), F.col(f"{b}.{s}")).alias(s) for s in shared), *(F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in names for c in columns)
    )


def conflicts(long: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, value, conflict) where values within a key differ, else the one value."""
    x = long.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.nullif(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns))).alias("x"))
    return x.groupBy(key, "x.column").agg(F.max("x.value").alias("value"), (F.min("x.value") != F.max("x.value")).alias("conflict")).withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def filter_pairs(pairs: DataFrame, rules: list[tuple[str, Column]], text: str, order: str) -> DataFrame:
    """pairs plus exclusion: the first rule that holds, or duplicate_text for a text that an earlier pair already has; '' if kept."""
    why = F.lit("")
    for name, test in reversed(rules):
        why = F.when(test, name).otherwise(why)
    marked = pairs.withColumn("exclusion", why)
    first = marked.where("exclusion = ''").groupBy(text).agg(F.min(order).alias("first_of_text"))
    joined = marked.join(first, text, "left")
    again = (F.col("exclusion") == "") & (F.col(order) > F.col("first_of_text"))
    return joined.withColumn("exclusion", F.when(again, "duplicate_text").otherwise(F.col("exclusion"))).drop("first_of_text")


def swap_orders(pairs: DataFrame) -> DataFrame:
    """Each pair in both display orders."""
    return pairs.withColumn("display", F.explode(F.array(F.lit("ab"), F.lit("ba"))))


def order_stability(judged: DataFrame, keys: list[str], winner: str = "winner") -> DataFrame:
    """keys, first, second (original winners by order), stable, invalid; judged has display and winner (null: no parse)."""
    back = judged.withColumn("original", map_choice(F.col(winner), F.col("display")))
    both = back.groupBy(*keys).agg(F.max(F.when(F.col("display") == "ab", F.col("original"))).alias("first"), F.max(F.when(F.col("display") == "ba", F.col("original"))).alias("second"))
    invalid = F.col("first").isNull() | F.col("second").isNull()
    return both.withColumns({"invalid": invalid, "stable": ~invalid & (F.col("first") == F.col("second")) & F.col("first").isin("A", "B")}).withColumn("stable", F.coalesce("stable", F.lit(False)))


def majority(samples: DataFrame, key: str) -> DataFrame:
    """By pair: stable votes, unstable and invalid numbers, winner, confidence and selection method from its samples."""
    s = samples.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(F.col("stable") & (F.col("first") == "A")).alias("votes_a"), F.count_if(F.col("stable") & (F.col("first") == "B")).alias("votes_b"),
        F.count_if(~F.col("invalid") & ~F.col("stable")).alias("unstable"), F.count_if("invalid").alias("invalid"),
    )
    top, low = F.greatest("votes_a", "votes_b"), F.least("votes_a", "votes_b")
    won = (F.col("invalid") == 0) & (top >= F.ceil(F.col("n") / 2)) & (top > low)
    return s.withColumns(
        {
            "winner": F.when(won, F.when(F.col("votes_a") > F.col("votes_b"), "A").otherwise("B")),
            "confidence": F.when(F.col("invalid") > 0, "invalid").when(~won, "unstable").when(top == F.col("n"), "unanimous").when(low > 0, "split_majority").otherwise("majority_with_unstable"),
            "method": F.when(F.col("invalid") > 0, "invalid").when(won, "pairwise_stable").otherwise("pointwise_tiebreak"),
        }
    )


def evaluation_rows(human: DataFrame, pairwise: DataFrame, pointwise: DataFrame, key: str) -> DataFrame:
    """human plus the two automatic winners and why a row is left out: no human choice, no stable judge, no formal pointwise result."""
    joined = human.join(pairwise, key, "left").join(pointwise, key, "left")
    why = (
        F.when(~F.coalesce(F.col("human_winner").isin("A", "B"), F.lit(False)), "human").when(F.col("pair_winner").isNull(), "critic").when(F.col("point_winner").isNull(), "pointwise").otherwise("")
    )
    return joined.withColumn("exclusion", why)


def agreement(rows: DataFrame) -> DataFrame:
    """One row: numbers left out and why, agreement of both winners on the rest (null if there is none), their difference, tie rate."""
    kept = F.col("exclusion") == ""
    n = F.count_if(kept)
    right = lambda c: F.count_if(kept & (F.col(c) == F.col("human_winner")))
    return rows.agg(
        F.count("*").alias("rows"), n.alias("kept"), *(F.count_if(F.col("exclusion") == x).alias(f"without_{x}") for x in ("human", "critic", "pointwise")),
        F.try_divide(right("pair_winner"), n).alias("pair_agreement"), F.try_divide(right("point_winner"), n).alias("point_agreement"), F.try_divide(right("pair_winner") - right("point_winner"), n).alias("difference"),
        F.try_divide(F.count_if(F.col("human_winner") == "tie"), F.count("*")).alias("tie_rate"),
    )


def verdict(kept: Column, rate: Column, difference: Column) -> Column:
    """inconclusive below 12 rows; continue from 0.70 and better; stop to 0.55 and no better; else review."""
    return F.when(kept < 12, "inconclusive").when((rate >= 0.70) & (difference > 0), "continue").when((rate <= 0.55) & (difference <= 0), "stop").otherwise("review")
