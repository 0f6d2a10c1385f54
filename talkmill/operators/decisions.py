"""Small decisions over scores, scorer outcomes and safety levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.judge import string_array


def optional_projection(rows: DataFrame, always: list[str], optional: dict[str, bool], bucket: tuple[str, str] | None = None) -> DataFrame:
    """Some columns always, others if asked for; rows of one bucket, or all."""
    kept = rows if bucket is None else rows.where(F.col(bucket[0]) == bucket[1])
    return kept.select(*always, *(c for c, wanted in optional.items() if wanted))


def safety_action(level: Column, unavailable: Column) -> tuple[Column, Column]:
    """(blocks, message class): what can't be judged always blocks, yellow never does."""
    return unavailable | (level == "red"), F.when(unavailable, "unavailable").when(level == "red", "referral").when(level == "yellow", "caution").otherwise("none")


def matched_signals(level: Column, keywords: Column, rules: Column, otherwise: str, most: int = 12) -> Column:
    """None for green; else the keywords, the rules if there are none, or a constant."""
    return (
        F.when(level == "green", F.array().cast("array<string>")).when(F.size(keywords) > 0, F.slice(keywords, 1, most)).when(F.size(rules) > 0, F.slice(rules, 1, most)).otherwise(string_array([otherwise]))
    )


def dimensions_of(rows: DataFrame, table: DataFrame, key: str, default: list[str]) -> DataFrame:
    """rows plus their key's dimensions from a small table, or the default."""
    return rows.join(F.broadcast(table), key, "left").withColumn("dimensions", F.coalesce("dimensions", string_array(default)))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def separation(pairs: DataFrame) -> dict[str, Column]:
    """Of a pair table: c1 feels more, c2 solves more, neither is flagged, and all three."""
    flags = {"emotion": F.col("c1_er") > F.col("c2_er"), "solution": F.col("c2_ip") > F.col("c1_ip"), "clean": ~(F.col("c1_boundary") | F.col("c2_boundary"))}
    return flags | {"separated": flags["emotion"] & flags["solution"] & flags["clean"]}


def exportable() -> Column:
    """No preference leaves by tie-break or default, unresolved, unvalidated or inconclusive. Columns: method, resolved, validated, inconclusive."""
    return ~F.col("method").isin("pointwise_tiebreak", "default") & F.col("resolved") & F.col("validated") & ~F.col("inconclusive")


def issues(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold, joined by |."""
    return F.array_join(F.array_compact(F.array(*(F.when(t, n) for n, t in tests.items()))), "|")


def model_prediction(failed: Column, stable: Column, tie: Column, winner: Column) -> Column:
    return F.when(failed, "failed").when(~stable, "unstable").when(tie, "tie").otherwise(winner)


def scorer_outcome(error: Column, level: Column, rationale: Column) -> tuple[Column, Column]:
    """(reason, detail): an exception, a level that isn't green, or nothing."""
    return F.when(error.isNotNull(), "f1_exception").when(level != "green", "f1_non_green").otherwise(""), F.when(error.isNotNull(), error).when(level != "green", rationale).otherwise("")


def with_default(parsed: Column, **fields) -> Column:
    """A parsed struct, or one of these values where parsing failed."""
    return F.coalesce(parsed, F.struct(*(F.lit(v).alias(k) for k, v in fields.items())))


def pick_orientation(candidates: DataFrame, key: str, orientation: str) -> DataFrame:
    """The first candidate of an orientation for each key."""
    rows = candidates.where(F.col("orientation") == orientation)
    return rows.groupBy(key).agg(F.min(F.struct("cand_no", "candidate_id")).alias("x")).select(key, "x.candidate_id")


def without_orientation(candidates: DataFrame, key: str, orientation: str) -> DataFrame:
    """Keys that have no candidate of an orientation: the error list of pick_orientation."""
    return candidates.select(key).distinct().join(candidates.where(F.col("orientation") == orientation), key, "left_anti")


def stage(history: Column) -> Column:
    return F.when(F.size(history) == 0, "first_contact").otherwise("follow_up")


def context(cards: Column, external: Column, k: int, enabled: bool = True) -> Column:
    """The first k cards, then external ones, at most k and their number together; only external ones if disabled."""
    return F.slice(F.concat(F.slice(cards, 1, k) if enabled else F.array().cast("array<string>"), external), 1, F.lit(k) + F.size(external))


def secondary_safety(raw: Column) -> dict[str, Column]:
    """level, unavailable, signals, rationale of a judge's secondary safety JSON: what is missing or no object, or has an
    unknown level, counts as yellow and unavailable, with the signal that says why."""
    value = F.trim(F.coalesce(raw, F.lit("")))
    there = value.startswith("{") & F.try_parse_json(F.when(value.startswith("{"), value)).isNotNull()
    level = F.trim(F.get_json_object(value, "$.risk_level"))
    known = there & F.coalesce(level.isin("green", "yellow", "red"), F.lit(False))
    listed = F.get_json_object(value, "$.matched_signals")
    signals = F.when(F.coalesce(listed.startswith("["), F.lit(False)), F.coalesce(F.from_json(listed, "array<string>"), string_array([]))).otherwise(string_array([]))
    return {
        "level": F.when(known, level).otherwise("yellow"),
        "unavailable": ~known,
        "signals": F.when(~there, string_array(["secondary_safety_missing"])).when(~known, string_array(["secondary_safety_invalid"])).otherwise(signals),
        "rationale": F.when(known, F.coalesce(F.nullif(F.trim(F.get_json_object(value, "$.rationale")), F.lit("")), F.lit("reviewed"))).otherwise("unavailable"),
    }


#: Own patterns of questions that push or only seem to ask.
PUSHY = r"(?i)why don't you|shouldn't you|you must|isn't it obvious"


def turn_checks(pairs: DataFrame, first: Column, passes: Column) -> dict[str, Column]:
    """Checks of a pair table (c1_text, c2_text, c1_er, c2_er, c1_ip, c2_ip): a first turn asks nothing and doesn't push (later
    ones pass these), c1 feels more, c2 solves more, and whether all or any candidates pass; passes: array of booleans."""
    texts = [F.coalesce(F.col(f"{c}_text"), F.lit("")) for c in ("c1", "c2")]
    asks = texts[0].rlike("[?？]") | texts[1].rlike("[?？]")
    pushes = texts[0].rlike(PUSHY) | texts[1].rlike(PUSHY)
    more = lambda a, b: F.coalesce(F.col(a) > F.col(b), F.lit(False))
    return {
        "no_question": ~first | ~asks, "no_push": ~first | ~pushes, "c1_er_more": more("c1_er", "c2_er"), "c2_ip_more": more("c2_ip", "c1_ip"),
        "all_pass": F.forall(passes, lambda x: x), "any_pass": F.exists(passes, lambda x: x),
    }
