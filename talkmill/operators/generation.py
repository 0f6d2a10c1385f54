"""The generation grid: cells, quotas, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.judge import string_array


def variant(values: list[str], index: Column) -> Column:
    return F.element_at(string_array(values), F.pmod(index, F.lit(len(values))).cast("int") + 1)


def cells(personas: DataFrame, scenarios: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """All persona x scenario cells of two small dimensions, or those wanted; raises on a wanted cell that doesn't exist."""
    grid = personas.crossJoin(F.broadcast(scenarios))
    if wanted is None:
        return grid
    unknown = wanted.join(grid, ["persona", "scenario"], "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"unknown cell {unknown[0]}")
    return grid.join(F.broadcast(wanted), ["persona", "scenario"], "left_semi")


def quotas(grid: DataFrame, explicit: DataFrame, multipliers: DataFrame, per_cell: int, probe: int | None = None) -> DataFrame:
    """grid plus target: an explicit quota, else the probe's, else per_cell times the scenario's multiplier, rounded up."""
    usual = F.lit(probe) if probe is not None else F.ceil(per_cell * F.coalesce("multiplier", F.lit(1.0)))
    return grid.join(explicit, ["persona", "scenario"], "left").join(multipliers, "scenario", "left").withColumn("target", F.coalesce("quota", usual).cast("long")).drop("quota", "multiplier")


def work_list(grid: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per missing item of a cell; index goes on from the rows that exist."""
    done = existing.groupBy("persona", "scenario").agg(F.count("*").alias("done"))
    left = grid.join(done, ["persona", "scenario"], "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return left.where("done < target").withColumn("index", F.explode(F.sequence("done", F.col("target") - 1))).drop("done", "target")


def prompts(work: DataFrame, template: str, subs: list[str], tones: list[str], run_id: str) -> DataFrame:
    """work plus subscenario, tags, prompt, prompt_hash, id; template takes persona, scenario and subscenario."""
    from ..functions.text import hash16, sample_id

    sub, tags = variant(subs, F.col("index")), F.array_distinct(F.array(variant(tones, F.col("index")), variant(subs, F.col("index"))))
    made = work.withColumns({"subscenario": sub, "tags": tags})
    made = made.withColumn("prompt", F.format_string(template, "persona", "scenario", "subscenario"))
    return made.withColumns({"prompt_hash": hash16(F.col("prompt")), "id": sample_id(F.lit(run_id), F.col("index"))})
