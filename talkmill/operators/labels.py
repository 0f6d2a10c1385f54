"""Profiles of labelled examples and their strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.judge import string_array


def safe_list(raw: Column) -> Column:
    """A JSON list as it is, other text as a list of one, null and blank as none."""
    empty = F.array().cast("array<string>")
    return F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", empty).when(raw.rlike(r"^\s*\["), F.coalesce(F.from_json(raw, "array<string>"), empty)).otherwise(F.array(raw))


def reason_hit(reasons: Column, keys: list[str]) -> Column:
    """Whether any key is part of any reason."""
    return F.exists(reasons, lambda r: F.exists(string_array(keys), lambda k: F.contains(r, k)))


def sequence_key(items: Column, codes: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    return F.array_join(F.transform(items, lambda x: F.coalesce(F.element_at(table, x), x)), ">")


def ordered_counts(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(value, n, position): counts with null as unknown; listed values have their place, others come after."""
    position = F.array_position(string_array(order), F.col("value"))
    counts = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("position", F.when(position > 0, position).otherwise(len(order) + 1))


def crosstab(rows: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    """by and one count for each listed value; absent ones are 0."""
    return rows.groupBy(by).agg(*(F.count_if(F.col(column) == x).alias(x) for x in values))


def row_shares(table: DataFrame, values: list[str]) -> DataFrame:
    """Counts as percent of their row; an empty row is 0."""
    total = sum((F.col(x) for x in values[1:]), F.col(values[0]))
    return table.select(*(c for c in table.columns if c not in values), *(F.coalesce(F.try_divide(100.0 * F.col(x), total), F.lit(0.0)).alias(x) for x in values))


def transitions(items: Column) -> Column:
    """(from, to) of neighbours in an array."""
    pairs = F.zip_with(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(F.size(items) > 1, pairs).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def strategy_stats(rows: DataFrame, scenario: str, items: str) -> DataFrame:
    """(scenario, kind, name, n) of rows, strategies, first strategies and transitions, with a null scenario for all together: one pass, by grouping sets."""
    kinds = F.concat(
        F.array(F.struct(F.lit("rows").alias("kind"), F.lit("").alias("name"))), F.transform(items, lambda s: F.struct(F.lit("strategy").alias("kind"), s.alias("name"))),
        F.when(F.size(items) > 0, F.array(F.struct(F.lit("first").alias("kind"), F.get(items, F.lit(0)).alias("name")))).otherwise(F.array().cast("array<struct<kind:string,name:string>>")),
        F.transform(transitions(F.col(items)), lambda t: F.struct(F.lit("transition").alias("kind"), F.concat(t["a"], F.lit("->"), t["b"]).alias("name"))),
    )
    long = rows.select(scenario, F.explode(kinds).alias("k")).select(scenario, "k.kind", "k.name")
    return long.groupingSets([[scenario, "kind", "name"], ["kind", "name"]], scenario, "kind", "name").agg(F.count("*").alias("n"))


def strategy_prior(stats: DataFrame, scenario: str, limits: dict[str, int]) -> DataFrame:
    """(scenario, kind, prior): the most common names of each kind as name(n), joined; of equals the first name."""
    from pyspark.sql import Window

    order = Window.partitionBy(scenario, "kind").orderBy(F.desc("n"), "name")
    allowed = F.coalesce(F.element_at(F.create_map(*(x for k, n in limits.items() for x in (F.lit(k), F.lit(n)))), F.col("kind")), F.lit(0))
    kept = stats.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= allowed)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "n"))), lambda x: F.concat(x["name"], F.lit("("), x["n"].cast("string"), F.lit(")"))), ", ")
    return kept.groupBy(scenario, "kind").agg(text.alias("prior"))
