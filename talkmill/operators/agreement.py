"""Rater agreement and reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def consensus(a: Column, b: Column) -> Column:
    """The mean of two ratings, halves up."""
    return F.floor((a + b) / 2 + 0.5).cast("int")


def kappa(a: Column, b: Column) -> Column:
    """Aggregate: quadratic-weighted kappa from one pass of integer sums; null if no disagreement is expected."""
    n = F.count(F.when(a.isNotNull() & b.isNotNull(), 1))
    sums = {k: F.sum(x) for k, x in (("d", (a - b) * (a - b)), ("aa", a * a), ("bb", b * b), ("a", a), ("b", b))}
    return 1 - F.try_divide((n * sums["d"]).cast("double"), n * sums["aa"] + n * sums["bb"] - 2 * sums["a"] * sums["b"])


def distribution(column: Column, values: tuple[int, ...] = (0, 1, 2)) -> Column:
    """Aggregate: counts of fixed values as JSON, zeros too."""
    return F.to_json(F.struct(*(F.count_if(column == x).alias(str(x)) for x in values)))


def reliability(rows: DataFrame, dimensions: dict[str, float]) -> DataFrame:
    """One row per dimension: n, both kappas, threshold, pass, four distributions. rows has a_<d>, b_<d>, m_<d>; dimensions gives thresholds."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(t).alias("threshold"), *(F.col(f"{s}_{d}").alias(s) for s in "abm")) for d, t in dimensions.items()))).alias("x")).select("x.*")
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    out = long.withColumn("c", consensus(a, b)).groupBy("dimension", "threshold").agg(
        F.count("*").alias("n"), kappa(a, b).alias("human_kappa"), kappa(F.col("c"), m).alias("model_kappa"), *(distribution(F.col(s)).alias(f"dist_{s}") for s in "abcm")
    )
    return out.withColumn("passed", F.coalesce((F.col("human_kappa") >= F.col("threshold")) & (F.col("model_kappa") >= F.col("threshold")), F.lit(False)))


def gate(rows: DataFrame, tests: list[tuple[str, Column]], counts: dict[str, Column]) -> DataFrame:
    """One row: counts, blocking reasons, PASS or FAIL. counts are aggregates; tests are over their names; no rows block too."""
    summed = rows.agg(F.count("*").alias("total"), *(c.alias(n) for n, c in counts.items()))
    reasons = F.array_compact(F.array(F.when(F.col("total") == 0, "no_rows"), *(F.when((F.col("total") > 0) & t, n) for n, t in tests)))
    return summed.withColumn("reasons", F.array_join(reasons, ";")).withColumn("decision", F.when(F.col("reasons") == "", "PASS").otherwise("FAIL"))


def comparison_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """by.., matches and invalid rows of two models, and in how many rows either does better or neither. rows: one_er, one_ip,
    other_er, other_ip (whether a score matches the human's), one_failed, other_failed; a failed run matches nothing."""
    total = lambda m: F.when(F.col(f"{m}_failed"), 0).otherwise(F.coalesce(F.col(f"{m}_er").cast("int"), F.lit(0)) + F.coalesce(F.col(f"{m}_ip").cast("int"), F.lit(0)))
    marked = rows.withColumns({"__one": total("one"), "__other": total("other")})
    return marked.groupBy(*by).agg(
        F.count("*").alias("rows"), F.sum("__one").alias("matches_one"), F.sum("__other").alias("matches_other"), F.count_if("one_failed").alias("invalid_one"), F.count_if("other_failed").alias("invalid_other"),
        F.count_if(F.col("__one") > F.col("__other")).alias("better_one"), F.count_if(F.col("__other") > F.col("__one")).alias("better_other"), F.count_if(F.col("__one") == F.col("__other")).alias("ties"),
    )


def pairwise_summary(runs: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Summaries of pairwise runs by grouping sets (null: all): valid, stable and order rates, accuracies, boundary rates, the distribution of winners, mean duration.

    runs: ok, stable, consistent, correct, strict, lenient, expected (A, B, tie or null), boundary (A, B, none or null), winner
    (null: unstable), tie (stable tie), duration. Rates are null where nothing counts, rounded to 4 places.
    """
    ok = F.col("ok")

    def rate(test: str, when: Column | None = None) -> Column:
        counts = ok if when is None else ok & F.coalesce(when, F.lit(False))
        return F.round(F.avg(F.when(counts, F.coalesce(F.col(test), F.lit(False)).cast("int"))), 4)

    expected, boundary = F.col("expected"), F.col("boundary")
    won = F.when(F.col("tie"), "tie").otherwise(F.coalesce("winner", F.lit("unstable")))
    columns = sorted({c for s in sets for c in s})
    return runs.groupingSets(sets, *columns).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.round(F.avg(ok.cast("int")), 4).alias("valid_rate"), rate("stable").alias("stable_rate"), rate("consistent").alias("order_rate"),
        rate("correct", expected.isin("A", "B", "tie")).alias("accuracy_all"), rate("correct", expected.isin("A", "B")).alias("accuracy_no_tie"), rate("correct", expected == "tie").alias("accuracy_tie"),
        rate("strict").alias("boundary_strict"), rate("lenient").alias("boundary_lenient"), rate("strict", boundary.isin("A", "B")).alias("recall_strict"), rate("lenient", boundary.isin("A", "B")).alias("recall_lenient"),
        rate("strict", boundary == "none").alias("none_strict"), *(F.count_if(ok & (won == w)).alias(f"won_{w}") for w in ("A", "B", "tie", "unstable")), F.round(F.avg(F.when(ok, F.col("duration"))), 1).alias("mean_duration"),
    )
