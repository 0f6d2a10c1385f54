"""Classification metrics, policy sweeps, latencies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import softmax
from .rules import lowered_level

CLASSES = ("green", "yellow", "red")


def confusion(rows: DataFrame, by: list[str], truth: str = "truth", level: str = "level", weight: str | None = None) -> DataFrame:
    """by.. and nine counts n_<truth>_<level>, by partial aggregation of the rows as they stream; a row counts as many times as its weight says."""
    here = lambda t, p: (F.col(truth) == t) & (F.col(level) == p)
    counted = lambda t, p: F.count_if(here(t, p)) if weight is None else F.coalesce(F.sum(F.when(here(t, p), F.col(weight))), F.lit(0))
    return rows.groupBy(*by).agg(*(counted(t, p).alias(f"n_{t}_{p}") for t in CLASSES for p in CLASSES))


def measures() -> dict[str, Column]:
    """Accuracy, balanced accuracy, macro and weighted F1, F1 by class, and the cost objective, from a confusion() row. Supports are at least 1."""
    n = {(t, p): F.col(f"n_{t}_{p}") for t in CLASSES for p in CLASSES}
    total = sum(n.values(), F.lit(0))
    row = {t: sum((n[t, p] for p in CLASSES), F.lit(0)) for t in CLASSES}
    column = {p: sum((n[t, p] for t in CLASSES), F.lit(0)) for p in CLASSES}
    recall = {t: n[t, t] / F.greatest(row[t], F.lit(1)) for t in CLASSES}
    f1 = {t: 2 * n[t, t] / F.greatest(row[t] + column[t], F.lit(1)) for t in CLASSES}
    macro = (f1["green"] + f1["yellow"] + f1["red"]) / 3
    rate = lambda t, p: n[t, p] / F.greatest(row[t], F.lit(1))
    return {
        "accuracy": (n["green", "green"] + n["yellow", "yellow"] + n["red", "red"]) / F.greatest(total, F.lit(1)), "balanced": (recall["green"] + recall["yellow"] + recall["red"]) / 3, "macro_f1": macro,
        "weighted_f1": sum((f1[t] * row[t] for t in CLASSES), F.lit(0.0)) / F.greatest(total, F.lit(1)), **{f"f1_{t}": f1[t] for t in CLASSES},
        "green_to_red": rate("green", "red"), "objective": macro - 2 * rate("green", "red") - 1.5 * rate("yellow", "red") - 3 * rate("red", "green"),
    }


def policy_sweep(scored: DataFrame, alphas: list[float], temperatures: list[float], reds: list[float], yellows: list[float], modes: list[str], rounded: int = 9) -> DataFrame:
    """One row per setting: alpha, temperature, red, yellow, mode, val_objective, test_green_to_red, test_macro_f1 and rank; the best has rank 1.

    scored: split (validation or test), truth, base and keyword (logits of CLASSES as arrays; alpha weighs the keywords'
    share), idiom, bullying, negated, red_necessary. Settings whose yellow threshold is no more than half the red one are
    left out. Thresholds are monotone, so rows are first folded to counts by (split, truth, signals, thresholds passed)
    of each alpha and temperature; the thresholds and modes sweep that small table. Text never comes along.
    """
    flags = ["idiom", "bullying", "negated", "red_necessary"]
    reds, yellows = sorted(reds), sorted(yellows)
    heats = F.array(*(F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(t)).alias("temperature")) for a in alphas for t in temperatures))
    rows = scored.select("split", "truth", *flags, "base", "keyword", F.explode(heats).alias("h")).select("split", "truth", *flags, "base", "keyword", "h.alpha", "h.temperature")
    logits = F.zip_with("base", "keyword", lambda b, k: b + F.col("alpha") * k)
    p = rows.withColumn("p", softmax(logits, F.col("temperature")))
    passed = lambda x, limits: sum((F.when(x >= float(t), 1).otherwise(0) for t in limits), F.lit(0))
    danger, any_ = F.col("p")[2], F.col("p")[1] + F.col("p")[2]
    folded = p.select("split", "truth", *flags, "alpha", "temperature", passed(danger, reds).alias("i"), passed(any_, yellows).alias("j"), (danger >= 0.8).alias("sure"))
    cells = folded.groupBy(*folded.columns).agg(F.count("*").alias("n"))
    grid = [(r, y, m, i, j) for i, r in enumerate(reds) for j, y in enumerate(yellows) for m in modes if y > r * 0.5]
    names = ("red", "yellow", "mode", "at", "or_at")
    settings = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(names, g))) for g in grid))
    swept = cells.withColumn("s", F.explode(settings)).select(*cells.columns, "s.*")
    yellow = F.col("j") > F.col("or_at")
    plain = F.when(F.col("i") > F.col("at"), "red").when(yellow, "yellow").otherwise("green")
    level = lowered_level(plain, yellow, F.col("sure"), {f: F.col(f) for f in flags}, F.col("mode"))
    keys = ["alpha", "temperature", "red", "yellow", "mode"]
    judged = confusion(swept.withColumn("level", level), [*keys, "split"], weight="n").withColumns(measures())
    pick = lambda split, m: F.round(F.max(F.when(F.col("split") == split, F.col(m))), rounded)
    table = judged.groupBy(*keys).agg(pick("validation", "objective").alias("val_objective"), pick("test", "green_to_red").alias("test_green_to_red"), pick("test", "macro_f1").alias("test_macro_f1"))
    # As many rows as there are settings, whatever the data.
    best = Window.orderBy(F.desc("val_objective"), "test_green_to_red", F.desc("test_macro_f1"), *keys)
    return table.withColumn("rank", F.row_number().over(best))


#: Bits that one pass of order_statistics() settles.
DIGIT = 16


def order_patterns(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned longs in the same order: the bits of those below zero turned over, the sign bit of the others set; -0 is 0."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def from_pattern(pattern: int) -> float:
    """The double of an order pattern."""
    bits = pattern & ((1 << 63) - 1) if pattern >> 63 else pattern ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def order_statistics(rows: DataFrame, value: str, places) -> tuple[int, list[float]]:
    """(n, the values at the places(n) of all n sorted ones, nulls and NaN aside), exactly, -0 as 0.

    Radix selection over the values' order patterns: a pass counts the next 16 bits of all values whose bits so far are those
    of a place, for all places at once, and four passes settle 64 bits, whatever the values are. Tasks count batch by
    batch and partial sums follow; what comes back is at most 65,536 counts for each place.
    """
    x = rows.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")

    def counts(prefixes: list[int], done: int) -> dict[int, list[tuple[int, int]]]:
        """By prefix of `done` bits: (next digit, count), in order."""
        known = np.array(sorted(prefixes), np.uint64)

        def run(batches):
            for batch in batches:
                key = order_patterns(batch.column(0).to_numpy())
                if done:
                    top = key >> np.uint64(64 - done)
                    at = np.minimum(np.searchsorted(known, top), len(known) - 1)
                    key, at = key[known[at] == top], at[known[at] == top]
                else:
                    at = np.zeros(len(key), np.int64)
                digit = (key >> np.uint64(64 - done - DIGIT)) & np.uint64((1 << DIGIT) - 1)
                found, n = np.unique(at.astype(np.int64) << DIGIT | digit.astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["k", "c"])

        table: dict[int, list[tuple[int, int]]] = {int(p): [] for p in known}
        for r in sorted(x.mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()):
            table[int(known[r.k >> DIGIT])].append((r.k & ((1 << DIGIT) - 1), r.c))
        return table

    first = counts([0], 0)
    n = sum(c for _, c in first[0])
    open_ = [(0, place) for place in places(n)] if n else []
    for done in range(0, 64, DIGIT):
        table = first if done == 0 else counts(list({p for p, _ in open_}), done)
        further = []
        for prefix, place in open_:
            for digit, c in table[prefix]:
                if place < c:
                    further.append((prefix << DIGIT | digit, place))
                    break
                place -= c
        open_ = further
        if not open_:
            break
    return n, [from_pattern(p) for p, _ in open_]


def latencies(rows: DataFrame, value: str) -> DataFrame:
    """One row: n, mean, median, least, most, and p95 at index round(0.95 (n - 1)), halves to even; null values don't count."""
    _, found = order_statistics(rows, value, lambda n: [(n - 1) // 2, n // 2, round(0.95 * (n - 1))])
    low, high, p95 = found or (None, None, None)
    middle = None if low is None else low if low == high else low / 2 + high / 2
    stats = rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return stats.select("n", "mean", F.lit(middle).cast("double").alias("median"), "least", "most", F.lit(p95).cast("double").alias("p95"))
