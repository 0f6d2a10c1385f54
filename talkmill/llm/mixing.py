"""Mixing sources to target weights: temperature, budgets, and block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh

#: Rows up to which the table of sources' blocks is broadcast; beyond, it is joined by shuffle on (source, block).
BROADCAST_ROWS = 200_000
#: Exponents tried at once, and how often the interval is narrowed to the two that enclose the limit.
TRIED, ROUNDS = 32, 4


def token_length(text: Column) -> Column:
    """A cheap count of tokens: one more than the spaces of a text, none for an empty one."""
    filled = F.coalesce(text, F.lit(""))
    return F.when(filled == "", 0).otherwise(F.octet_length(filled) - F.octet_length(F.replace(filled, F.lit(" "), F.lit(""))) + 1).cast("long")


def _measures(sources: DataFrame, exponents: list[float], budget: float) -> dict[float, tuple[float, float, float]]:
    """By exponent: entropy of the weights, most repetitions of a source, sum of powers. One aggregate for all."""
    power = F.pow("share", "x")
    tried = sources.select("share", "tokens", F.explode(F.array(*map(F.lit, exponents))).alias("x"))
    rows = tried.groupBy("x").agg(F.sum(power).alias("z"), F.sum(power * F.log("share") * F.col("x")).alias("p"), F.max(power / F.col("tokens")).alias("r")).collect()
    return {r.x: (math.log(r.z) - r.p / r.z, budget * r.r / r.z, r.z) for r in rows}


def find_exponent(sources: DataFrame, budget: float, entropy: float | None, repeats: float | None) -> float:
    """The exponent in [0, 1] at which weights reach `entropy`, as a share of the most (the log of the number of sources),
    unless a source would then be drawn more than `repeats` times; then the least exponent that keeps to that. 1, the
    natural shares, if none does. Both measures fall as the exponent grows, so each limit is bracketed and the bracket
    narrowed. sources: (tokens, share), positive."""
    if entropy is None and repeats is None:
        return 1.0
    n = sources.count()

    def least(good) -> float:
        """The least exponent that is good; those above are."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            tried = [low + (high - low) * i / (TRIED - 1) for i in range(TRIED)]
            fine = [good(m) for _, m in sorted(_measures(sources, tried, budget).items())]
            at = fine.index(True) if True in fine else TRIED - 1
            low, high = tried[max(0, at - 1)], tried[at]
        return high

    wanted = 1.0 if entropy is None else least(lambda m: m[0] <= entropy * math.log(n) + 1e-12)
    held = 0.0 if repeats is None else least(lambda m: m[1] <= repeats)
    return held if entropy is None else max(wanted, held)


def mix_hashes(doc_id: Column, text: Column, seed: str = "mix") -> tuple[Column, Column]:
    """What orders a source's blocks' documents: the hash that deals them to blocks, and the one that orders them within."""
    return F.xxhash64(F.lit(seed), doc_id, text), F.xxhash64(F.lit(f"{seed} inside"), doc_id, text)


def mix_sources(
    docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", budget: float = 1.0, entropy: float | None = 0.95, repeats: float | None = 2.0, blocks: int = 1024, seed: str = "mix", tokens: str | None = None,
    names: tuple[str, str, str] = ("__tokens", "__epoch", "__at"), counted: Callable[[DataFrame, str], DataFrame] | None = None, hashes: tuple[str, str] | None = None,
) -> DataFrame:
    """docs, all columns, each row as often as the mix draws it, plus `names`: __tokens, __epoch (from 1) and __at.

    tokens: a column of token counts (null as 0); without it the cheap token_length stands in, which suits only texts with
    spaces between words. counted: instead, what gives a table that column; it is asked for all rows once, for sums that texts
    don't come along with, and then for rows of the blocks where budgets end, and __tokens is left out. hashes: columns with
    what mix_hashes() gives, for docs without texts. budget: tokens to draw, as a multiple of all. Shares of tokens are raised to find_exponent's power and
    normalised to weights; a source's budget is its weight's part. It is realised as whole passes over its documents and
    a part of one more. Documents fall into `blocks` by a hash of id and text, and each source's blocks stand in an order
    by hash. Whole blocks are drawn while the budget lasts; in the one where it ends documents follow another hash, by parts
    of that hash's first twelve bits and within the part where it ends one by one, and the last is the one that begins before the end. __at, from 0 to 1, is where a block begins in its source's
    stream, so sorting by it interleaves the sources by weight.

    Null sources are one source; null and empty texts have no tokens and come with their block. A source without any
    tokens has no weight, and its documents come once. Repeated rows are drawn each on their own. An empty table gives no rows. Columns of docs
    may have any names but `names`, which is an error. Only sums by block and part, and the documents of each source's last part, are shuffled; a task gets no more
    than one part of a source, a four-millionth of it.
    """
    key = F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"))
    outer, inner = map(F.col, hashes) if hashes else mix_hashes(F.col(doc_id), F.col(text), seed)
    if clash := {c.lower() for c in docs.columns} & {n.lower() for n in names}:
        raise ValueError(f"docs has columns {sorted(clash)}")
    key_, block_, plan_, copies_, part_, done_ = fresh(docs, "__key", "__block", "__plan", "__copies", "__part", "__done")
    tokens_, epoch_, at_ = names
    rows = docs.withColumns({key_: key, block_: F.pmod(outer, F.lit(blocks))})
    if counted is None:
        rows = rows.withColumn(tokens_, token_length(F.col(text)) if tokens is None else F.coalesce(F.col(tokens).cast("long"), F.lit(0)))
        with_tokens = lambda df: df
    else:
        with_tokens = lambda df: counted(df, tokens_)
    counts = rows if counted is None else with_tokens(rows.select(key_, block_, text))
    sums = cut(counts.groupBy(F.col(key_).alias("__key"), F.col(block_).alias("__block")).agg(F.sum(tokens_).alias("size")))
    sources = sums.groupBy("__key").agg(F.sum("size").alias("tokens"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    sources = cut(sources.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))))
    spoken = sources.where("tokens > 0")
    weight = F.lit(0.0)
    if total:
        exponent = find_exponent(spoken, budget * total, entropy, repeats)
        weight = F.pow("share", F.lit(exponent)) / F.lit(_measures(spoken, [exponent], budget * total)[exponent][2])
    plan = sources.withColumn("drawn", F.when(F.col("tokens") > 0, F.round(weight * (budget * total)).cast("long")))
    order = Window.partitionBy("__key").orderBy(F.xxhash64(F.lit(seed), "__key", "__block"), "__block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).join(plan, "__key")
    passes = F.when(F.col("tokens") > 0, F.expr("drawn div nullif(tokens, 0)")).otherwise(1)
    room = F.when(F.col("tokens") > 0, F.expr("drawn % nullif(tokens, 0) - before")).otherwise(0)
    stream = F.struct("size", "before", "tokens", "drawn", passes.alias("passes"), room.alias("room")).alias(plan_)
    placed = cut(placed.select(F.col("__key").alias(key_), F.col("__block").alias(block_), stream))
    if placed.count() <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    dealt = rows.join(placed, [key_, block_])
    p = lambda name: F.col(f"{plan_}.{name}")
    ends = (p("room") > 0) & (p("room") < p("size"))
    whole = dealt.where(~ends).withColumn(copies_, p("passes") + ((p("room") > 0) & (p("room") >= p("size"))).cast("long"))
    # A block where a budget ends falls into parts by the first bits of its documents' hashes, which keeps their order; only
    # the part where it ends is gone through document by document.
    open_ = with_tokens(dealt.where(ends)).withColumn(part_, F.shiftright(inner, 52))
    inside = Window.partitionBy(key_, block_).orderBy(part_).rowsBetween(Window.unboundedPreceding, -1)
    parts = open_.groupBy(key_, block_, part_).agg(F.sum(tokens_).alias("__size")).withColumn(done_, F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    parts = cut(parts)
    if parts.count() <= BROADCAST_ROWS:
        parts = F.broadcast(parts)
    open_ = open_.join(parts, [key_, block_, part_])
    room = p("room") - F.col(done_)
    here = (room > 0) & (room <= F.col("__size"))
    within = Window.partitionBy(key_, block_, part_).orderBy(inner, F.col(doc_id)).rowsBetween(Window.unboundedPreceding, -1)
    started = F.coalesce(F.sum(tokens_).over(within), F.lit(0))
    ended = open_.where(here).withColumn(copies_, p("passes") + (started < room).cast("long"))
    sure = open_.where(~here).withColumn(copies_, p("passes") + (room > 0).cast("long"))
    partial = ended.unionByName(sure).drop(part_, done_, "__size")
    if counted is not None:
        partial = partial.drop(tokens_)
    drawn = whole.unionByName(partial).where(F.col(copies_) > 0).withColumn(epoch_, F.explode(F.sequence(F.lit(1).cast("long"), copies_)))
    at = F.when(p("drawn") > 0, ((F.col(epoch_) - 1) * p("tokens") + p("before")) / p("drawn")).otherwise(0.0)
    return drawn.withColumn(at_, at).select(*(F.col(f"`{c}`") for c in docs.columns), *([tokens_] if counted is None else []), epoch_, at_)
