"""Scores, tags and raw judge output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_array(values) -> Column:
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def score(raw: Column, policy: str) -> Column:
    """A 0..2 score from JSON text. strict: anything else is null. lenient: null or text is 0, fractions are cut, the
    range is kept. clamp: as lenient, then clamped to 0..2."""
    value = F.expr("try_cast(0 as int)") if raw is None else F.try_to_number(raw, F.lit("S9999999999.99999")).cast("double")
    if policy == "strict":
        return F.when(raw.rlike("^[012]$"), raw.cast("int"))
    cut = F.coalesce(F.floor(F.abs(value)) * F.signum(value), F.lit(0.0)).cast("int")
    if policy == "lenient":
        return F.when(cut.between(0, 2), cut).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(2), cut))


def normalize_tags(tags: Column, known) -> Column:
    """Known tags, each once, in order."""
    return F.array_distinct(F.filter(tags, lambda t: t.isin(*known)))


def append_tags(rationale: Column, tags: Column, mark: str = "audit_tags=") -> Column:
    """rationale with its tags at the end, once."""
    return F.when((F.size(tags) == 0) | F.contains(rationale, F.lit(mark)), rationale).otherwise(F.concat(rationale, F.lit(f" [{mark}"), F.array_join(tags, ","), F.lit("]")))


def read_tags(rationale: Column, mark: str = "audit_tags=") -> Column:
    """The tags that append_tags left."""
    found = F.regexp_extract(rationale, rf"\[{mark}([^\]]*)\]", 1)
    return F.when(found == "", F.array().cast("array<string>")).otherwise(F.split(found, ","))


#: The audit tags, and those that cap both ER and IP at 1.
AUDIT_TAGS = (
    "template_low_information", "forced_positive_reframe", "unsupported_third_party_motive", "third_party_excuse", "unsupported_fact_completion",
    "hard_boundary_fabrication", "relationship_decision_risk", "adult_coaching_question", "low_pressure_binary_question",
)
CAPPING_TAGS = ("template_low_information", "forced_positive_reframe", "unsupported_fact_completion", "hard_boundary_fabrication", "relationship_decision_risk")


def cap_scores(er: Column, ip: Column, ex: Column, boundary: Column, reason: Column, tags: Column, both_cap: tuple[str, ...] = CAPPING_TAGS) -> dict[str, Column]:
    """Caps that tags put on scores; they compose."""

    def has(*names: str) -> Column:
        return F.arrays_overlap(tags, string_array(names))

    low = has(*both_cap)
    ip_low = low | has("unsupported_third_party_motive")
    fake = has("hard_boundary_fabrication")
    return {
        "er": F.when(low, F.least(er, F.lit(1))).otherwise(er),
        "ip": F.when(has("third_party_excuse"), 0).when(ip_low, F.least(ip, F.lit(1))).otherwise(ip),
        "ex": F.when(has("adult_coaching_question"), F.least(ex, F.lit(1))).otherwise(ex),
        "boundary": boundary | fake,
        "reason": F.when(fake & (reason == ""), "hard_boundary_fabrication").otherwise(reason),
    }


def weighted_total(er: Column, ip: Column, ex: Column, casel: Column) -> Column:
    """ER + IP + EX and half the mean of the other scores, if there are any (casel: an array)."""
    mean = F.try_divide(F.aggregate(casel, F.lit(0.0), lambda s, x: s + x), F.size(casel))
    return er + ip + ex + 0.5 * F.coalesce(mean, F.lit(0.0))


def pointwise_winner(total_a: Column, total_b: Column, flag_a: Column, flag_b: Column) -> Column:
    """'' if both are flagged, the other if one is, else the larger total, or tie."""
    return (
        F.when(flag_a & flag_b, "").when(flag_a, "c2").when(flag_b, "c1").when(total_a > total_b, "c1").when(total_b > total_a, "c2").otherwise("tie")
    )


def map_choice(choice: Column, order: Column) -> Column:
    """A choice between displayed A and B as the original's, by display order ab or ba; others stay."""
    swapped = F.when(choice == "A", "B").when(choice == "B", "A").otherwise(choice)
    return F.when(order == "ba", swapped).otherwise(choice)
